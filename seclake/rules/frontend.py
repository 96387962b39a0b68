"""Browser code."""

from .model import CODE, ERROR, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "FE001", "frontend-security", ERROR, CODE,
        match=[
            rx(r"\beval\s*\("),
            rx(r"new\s+Function\s*\("),
            rx(r"""setTimeout\s*\(\s*['"`]"""),
            rx(r"""setInterval\s*\(\s*['"`]"""),
        ],
        code_only=True,
    ),
    Rule(
        "FE002", "frontend-security", WARNING, CODE,
        match=[
            rx(r"""postMessage\s*\([^,]+,\s*['"]\*['"]\s*\)"""),
        ],
    ),
    Rule(
        "FE003", "frontend-security", WARNING, REMINDER,
        match=[
            rx(r"""target\s*=\s*['"]_blank['"]""", "i"),
        ],
        unless_near=[
            rx(r"""rel\s*=\s*['"][^'"]*noopener[^'"]*noreferrer[^'"]*['"]""", "i"),
            rx(r"""rel\s*=\s*['"][^'"]*noreferrer[^'"]*noopener[^'"]*['"]""", "i"),
            rx(r"rel\s*=\s*\{[^}]*noopener[^}]*noreferrer[^}]*\}", "i"),
            rx(r"rel\s*=\s*\{[^}]*noreferrer[^}]*noopener[^}]*\}", "i"),
        ],
    ),
    Rule(
        "FE004", "frontend-security", WARNING, CODE,
        match=[
            rx(r"<iframe(?![^>]*sandbox)[^>]*>", "i"),
        ],
    ),
    Rule(
        "FE005", "frontend-security", WARNING, CODE,
        match=[
            rx(r"""<script\s+src\s*=\s*['"]https?://(?![^'"]*localhost)[^'"]*['"](?![^>]*integrity)[^>]*>""", "i"),
        ],
    ),
    Rule(
        "FE006", "frontend-security", WARNING, CODE,
        match=[
            rx(r"document\.cookie\s*=", "i"),
        ],
    ),
    Rule(
        "FE007", "frontend-security", WARNING, CODE,
        match=[
            rx(r"__proto__"),
            rx(r"\bconstructor\s*\["),
        ],
        code_only=True,
    ),
    Rule(
        "FE007a", "frontend-security", ERROR, CODE,
        match=[
            rx(r"\bObject\.assign\s*\(\s*\{[^}]*\}\s*,\s*(?:req|request|ctx)\.(?:body|query|params)"),
            rx(r"\bObject\.assign\s*\(\s*[\w$]+\s*,\s*(?:req|request|ctx)\.(?:body|query|params)"),
        ],
        unless_near=[
            rx(r"\bvalidate(?:Body|Input|Schema)\s*\("),
            rx(r"\bzod\.|\bjoi\.", "i"),
            rx(r"\.parse\s*\("),
        ],
    ),
    Rule(
        "FE007b", "frontend-security", ERROR, CODE,
        match=[
            rx(r"\b_\.(?:merge|mergeWith|defaultsDeep)\s*\(\s*[^,]+,\s*(?:req|request|ctx)\.(?:body|query|params)"),
        ],
        unless_near=[
            rx(r"lodash@(?:4\.17\.21|4\.18|5\.|6\.|7\.)"),
        ],
    ),
    Rule(
        "FE007c", "frontend-security", WARNING, CODE,
        match=[
            rx(r"\{\s*\.\.\.(?:req|request|ctx)\.(?:body|query|params)"),
        ],
        unless_near=[
            rx(r"\bvalidate(?:Body|Input|Schema)\s*\("),
            rx(r"\bzod\.|\bjoi\.", "i"),
            rx(r"\.parse\s*\("),
        ],
    ),
    Rule(
        "FE008", "frontend-security", INFO, REMINDER,
        match=[
            rx(r"cdn\.|unpkg\.com|cdnjs|jsdelivr", "i"),
        ],
    ),
    Rule(
        "FE009", "frontend-security", INFO, REMINDER,
        match=[
            rx(r"checkValidity\s*\("),
            rx(r"setCustomValidity\s*\("),
            rx(r"\.validity\."),
            rx(r"reportValidity\s*\("),
        ],
    ),
    Rule(
        "FE010", "frontend-security", WARNING, CODE,
        match=[
            rx(r"window\.open\s*\(\s*(?:req|request|params|query|body|user|url|href|input|data)\b", "i"),
            rx(r"window\.open\s*\(\s*\w+\s*[+,]"),
        ],
        unless=[
            rx(r"encodeURI", "i"),
            rx(r"validateUrl", "i"),
            rx(r"isValidUrl", "i"),
            rx(r"whitelist", "i"),
            rx(r"allowedUrl", "i"),
        ],
    ),
    Rule(
        "FE011", "frontend-security", WARNING, CODE,
        match=[
            rx(r"""(?:localStorage|sessionStorage)\.setItem\s*\(\s*['"].*(?:token|password|secret|session|auth|jwt|credential|apiKey|api_key)""", "i"),
        ],
    ),
    Rule(
        "FE012", "frontend-security", ERROR, CODE,
        match=[
            rx(r"(?:location\.hash|location\.search|location\.href|document\.URL|document\.referrer).*\.innerHTML", "i"),
            rx(r"\.innerHTML\s*=.*(?:location\.hash|location\.search|location\.href|document\.URL|document\.referrer)", "i"),
            rx(r"document\.write\s*\(.*(?:location\.hash|location\.search|location\.href|document\.URL|document\.referrer)", "i"),
        ],
    ),
    Rule(
        "FE013", "frontend-security", WARNING, CODE,
        match=[
            rx(r"(?:window\.location|location\.href|location\.assign|location\.replace)\s*=\s*(?:req|request|params|query|url|href|input|data)\b", "i"),
            rx(r"res\.redirect\s*\(\s*(?:req|request)\.", "i"),
        ],
        unless=[
            rx(r"whitelist", "i"),
            rx(r"allowedUrl", "i"),
            rx(r"validateUrl", "i"),
            rx(r"isValidUrl", "i"),
            rx(r"safeRedirect", "i"),
        ],
    ),
]
