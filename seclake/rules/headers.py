"""Missing response headers."""

from .model import CODE, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "HDR001", "infrastructure-deployment", WARNING, REMINDER,
        match=[
            rx(r"res\.(?:set|setHeader|header)\s*\(", "i"),
            rx(r"response\.(?:set|setHeader|header)\s*\(", "i"),
        ],
        unless_near=[
            rx(r"X-Frame-Options", "i"),
            rx(r"frameguard", "i"),
            rx(r"helmet\s*\(", "i"),
        ],
    ),
    Rule(
        "HDR002", "infrastructure-deployment", WARNING, REMINDER,
        match=[
            rx(r"res\.(?:set|setHeader|header)\s*\(", "i"),
            rx(r"response\.(?:set|setHeader|header)\s*\(", "i"),
        ],
        unless_near=[
            rx(r"X-Content-Type-Options", "i"),
            rx(r"noSniff", "i"),
            rx(r"helmet\s*\(", "i"),
        ],
    ),
    Rule(
        "HDR003", "infrastructure-deployment", INFO, REMINDER,
        match=[
            rx(r"res\.(?:set|setHeader|header)\s*\(", "i"),
            rx(r"response\.(?:set|setHeader|header)\s*\(", "i"),
        ],
        unless_near=[
            rx(r"Referrer-Policy", "i"),
            rx(r"referrerPolicy", "i"),
            rx(r"helmet\s*\(", "i"),
        ],
    ),
    Rule(
        "HDR004", "infrastructure-deployment", INFO, REMINDER,
        match=[
            rx(r"app\.listen\s*\(", "i"),
            rx(r"createServer\s*\(", "i"),
        ],
        unless_near=[
            rx(r"Permissions-Policy", "i"),
            rx(r"Feature-Policy", "i"),
            rx(r"permittedCrossDomainPolicies", "i"),
            rx(r"helmet\s*\(", "i"),
        ],
        only_paths=[
            rx(r"\.(?:js|ts|mjs|cjs)$", "i"),
        ],
    ),
    Rule(
        "HDR005", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"res\.(?:json|send)\s*\(.*(?:token|password|secret|ssn|creditCard)", "i"),
            rx(r"response\.(?:json|send)\s*\(.*(?:token|password|secret|ssn|creditCard)", "i"),
        ],
        unless=[
            rx(r"Cache-Control", "i"),
            rx(r"no-store", "i"),
        ],
        unless_near=[
            rx(r"Cache-Control", "i"),
            rx(r"no-store", "i"),
            rx(r"no-cache", "i"),
        ],
    ),
]
