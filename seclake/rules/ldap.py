"""LDAP filters built from input."""

from .model import CODE, ERROR, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "LDAP001", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"""\(\s*[a-zA-Z]+\s*=\s*['"]?\s*\+\s*(?:req|request|ctx|params|body|query|user|input|userInput|name)"""),
            rx(r"\(\s*[a-zA-Z]+\s*=\$\{\s*(?:req|request|ctx)\.(?:query|body|params)"),
            rx(r"""f['"][^'"]*\([\w]+=\{(?:request\.|flask\.request\.|user_input|username)"""),
        ],
    ),
    Rule(
        "LDAP002", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"""\.search\s*\(\s*[^,]+,\s*['"]\([\w]+=['"]\s*\+\s*(?:request\.|user)"""),
            rx(r"""\.search\s*\(\s*[^,]+,\s*String\.format\s*\(\s*['"]\([\w]+=%s\)['"]\s*,\s*(?!.*filterEncode)"""),
        ],
        unless_near=[
            rx(r"LdapEncoder\.filterEncode"),
            rx(r"LdapName\b"),
        ],
    ),
    Rule(
        "LDAP003", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"""\bsearch_s\s*\(\s*[^,]+,\s*[^,]+,\s*['"]\([\w]+=%s\)['"]\s*%\s*(?:request\.|input|username)"""),
            rx(r"""\bsearch_s\s*\(\s*[^,]+,\s*[^,]+,\s*f['"]\([\w]+=\{(?!.*escape_filter_chars)"""),
        ],
        unless_near=[
            rx(r"escape_filter_chars"),
        ],
    ),
]
