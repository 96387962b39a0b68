"""The rule catalogue, in scan order: by category, then family, then rule."""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from . import (
    android, api, auth, business, command, cors, credentials, csrf, database, dependencies,
    deserialization, docker, encryption, files, frontend, headers, infrastructure, jwt, kubernetes,
    ldap, logs, oauth, ssrf, ssti, terraform, tokens, xss, xxe,
)
from .model import CATEGORY_LABELS, SEVERITY_LABELS, Rule, Rx, rx
from .texts import TEXTS

FAMILIES: dict[str, list[Rule]] = {
    "auth": auth.RULES, "jwt": jwt.RULES, "oauth": oauth.RULES, "ldap": ldap.RULES,
    "xss": xss.RULES, "deserialization": deserialization.RULES, "ssti": ssti.RULES, "xxe": xxe.RULES,
    "csrf": csrf.RULES, "cors": cors.RULES, "encryption": encryption.RULES,
    "api": api.RULES, "ssrf": ssrf.RULES, "command": command.RULES, "database": database.RULES,
    "files": files.RULES, "credentials": credentials.RULES, "tokens": tokens.RULES,
    "frontend": frontend.RULES, "business": business.RULES, "logs": logs.RULES,
    "dependencies": dependencies.RULES, "infrastructure": infrastructure.RULES,
    "headers": headers.RULES, "docker": docker.RULES, "terraform": terraform.RULES,
    "kubernetes": kubernetes.RULES, "android": android.RULES,
}


def _described(r: Rule) -> Rule:
    message, suggestion = TEXTS.get(r.code, (r.message or r.code, r.suggestion))
    return replace(r, message=message, suggestion=suggestion)


@lru_cache(maxsize=None)
def _catalogue() -> tuple[Rule, ...]:
    rules = [_described(r) for family in FAMILIES.values() for r in family]
    order = list(CATEGORY_LABELS)
    return tuple(sorted(rules, key=lambda r: order.index(r.category)))


def all_rules() -> list[Rule]:
    return list(_catalogue())


def rules_in(category: str) -> list[Rule]:
    return [r for r in _catalogue() if r.category == category]


def rule(code: str) -> Rule | None:
    return next((r for r in _catalogue() if r.code == code), None)


def family(name: str) -> list[Rule]:
    codes = {r.code for r in FAMILIES[name]}
    return [r for r in _catalogue() if r.code in codes]


def history_rules(mode: str = "secrets") -> list[Rule]:
    """Rules worth running over old commits: vendor tokens and the graver credential rules."""
    kept = family("tokens") + [
        r for r in family("credentials")
        if r.severity > 0 and (mode == "all" or r.category == "secrets-credentials")
    ]
    return kept
