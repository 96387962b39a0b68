"""OAuth flows."""

from .model import CODE, ERROR, INFO, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "OAUTH001", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"(?:req|request|ctx)\.(?:query|body|params)\.(?:code|authorization_code)\b"),
        ],
        unless_near=[
            rx(r"\.(?:state|nonce)\b"),
            rx(r"verifyState\s*\("),
            rx(r"checkState\s*\("),
            rx(r"storedState", "i"),
            rx(r"sessionState", "i"),
        ],
    ),
    Rule(
        "OAUTH002", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"response_type=(?:code|token)(?![\s\S]{0,300}state=)"),
        ],
    ),
    Rule(
        "OAUTH003", "auth-access-control", WARNING, CODE,
        match=[
            rx(r"grant_type=authorization_code(?![\s\S]{0,300}code_verifier=)"),
        ],
        unless_near=[
            rx(r"code_verifier"),
            rx(r"code_challenge"),
            rx(r"pkce", "i"),
        ],
    ),
    Rule(
        "OAUTH004", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"\b(?:res|response)\.(?:redirect|location)\s*\(\s*(?:req|request|ctx)\.(?:query|body|params)\.(?:redirect_uri|next|url|returnTo|return_to|continue)\b", "i"),
        ],
        unless_near=[
            rx(r"isAllowedRedirect\s*\("),
            rx(r"validateRedirect\s*\("),
            rx(r"allowedRedirects?\s*[:.=]", "i"),
            rx(r"""\.startsWith\s*\(\s*['"](?:/|https://)"""),
        ],
    ),
    Rule(
        "OAUTH005", "auth-access-control", WARNING, CODE,
        match=[
            rx(r"""\bresponse_type\s*[:=]\s*['"]?token\b"""),
        ],
    ),
    Rule(
        "OAUTH006", "auth-access-control", INFO, CODE,
        match=[
            rx(r"""\bscope\s*[:=]\s*['"](?:\*|all|.*\.\*)['"]""", "i"),
        ],
    ),
]
