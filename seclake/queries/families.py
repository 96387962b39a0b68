"""One query per rule family, over derived source files and over the raw texts."""

from __future__ import annotations


from ..operators.matching import scan_rules
from ..plans.scan import scan
from ..plans.sql import findings_view
from ..plans.workspace import shared_folder
from ..rules import Rule, all_rules, family
from ..rules.tables import SCHEMA, rule_rows, rules_of
from . import corpus, oracle
from .registry import ORACLES, query

_NAMES = [
    "auth", "jwt", "oauth", "ldap", "xss", "deserialization", "ssti", "xxe", "csrf", "cors", "headers",
    "encryption", "api", "ssrf", "command", "database", "files", "frontend", "business", "logs",
    "dependencies", "infrastructure", "docker", "terraform", "kubernetes", "android", "credentials", "tokens",
]
COLUMNS = ["repo", "path", "line", "col", "code", "severity", "category", "pattern"]


def _register(number: int, name: str) -> None:
    rules = family(name)
    key = f"fam{number:02d}_{name}"

    def register(key: str, chosen: list[Rule]) -> None:
        @query(key, f"WITH {oracle.findings(chosen, corpus.CODE)}\nSELECT {', '.join(COLUMNS)} FROM findings")
        def matched(spark, sf):
            return scan_rules(corpus.code(spark, sf), chosen).select(*COLUMNS)

    # Rules that look at more than the line and the path have a query of their own.
    plain = [r for r in rules if not oracle.needs_context(r)]
    rest = [r for r in rules if oracle.needs_context(r)]
    if plain:
        register(key, plain)
    if rest:
        register(key + "_in_context" if plain else key, rest)


for _i, _name in enumerate(_NAMES, 1):
    _register(_i, _name)


def _whole(key: str, read, files_sql: str) -> None:
    @query(key, f"WITH {oracle.findings(all_rules(), files_sql)}\nSELECT {', '.join(COLUMNS)} FROM findings")
    def whole(spark, sf):
        return scan_rules(read(spark, sf), all_rules()).select(*COLUMNS)


_whole("scan_documents", corpus.documents, corpus.DOCUMENTS)
_whole("scan_pages", corpus.pages, corpus.PAGES)
_whole("scan_conversations", corpus.conversations, corpus.CONVERSATIONS)


@query("scan_code_all_rules")
def scan_code(spark, sf):
    """The whole command-line scan: gates, every rule, taint."""
    return scan(corpus.code(spark, sf)).select(*COLUMNS)


@query("scan_documents_all_rules")
def scan_documents_all(spark, sf):
    return scan(corpus.documents(spark, sf)).select(*COLUMNS)


@query("scan_pages_all_rules")
def scan_pages_all(spark, sf):
    return scan(corpus.pages(spark, sf)).select(*COLUMNS)


@query("scan_conversations_all_rules")
def scan_conversations_all(spark, sf):
    return scan(corpus.conversations(spark, sf)).select(*COLUMNS)


@query("rul01_rules_as_rows", ORACLES["scan_documents"].replace(corpus.DOCUMENTS, corpus.CODE))
def rules_as_rows(spark, sf):
    """The catalogue written as a table of rules, read again, and run."""
    folder = shared_folder(spark)
    rule_rows(spark, all_rules()).write.parquet(folder)
    return scan_rules(corpus.code(spark, sf), rules_of(spark.read.schema(SCHEMA).parquet(folder))).select(*COLUMNS)


@query("sql01_findings_view")
def view_of_findings(spark, sf):
    """Findings by rule of some files, asked in SQL."""
    corpus.code(spark, sf).createOrReplaceTempView("seclake_files")
    findings_view(spark, "seclake_files", "seclake_findings")
    return spark.sql("SELECT repo, code, severity, count(*) AS found FROM seclake_findings WHERE language = 'javascript' AND path LIKE 'src/%' GROUP BY repo, code, severity")
