"""Outbound calls with a caller-chosen URL."""

from .model import CODE, ERROR, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.
REQUEST = r"(?:req|request|ctx|context)\.(?:query|body|params|input|url|headers|cookies)"
REQUEST_USER = r"(?:req|request)\.user\.[\w]+"
URL_VARIABLE = r"\b(?:userUrl|targetUrl|redirectUrl|webhookUrl|callbackUrl|externalUrl|destination|dest|input|targetHost)\b"
URL_CHECKED = [
    rx(r"isAllowedHost|isInAllowlist|validateUrl|sanitizeUrl|SafeUrl\.|url\.allowlist", "i"),
    rx(r"new\s+URL\s*\([^)]+\)[\s\S]{0,80}(?:allowlist|hostname\s*===?|host\s*===?)", "i"),
    rx(r"\bssrf(?:-|_)?guard", "i"),
]

RULES = [
    Rule(
        "SSRF001", "api-security", ERROR, CODE,
        match=[
            rx(r"\bfetch\s*\(\s*(?:`[^`]*\$\{[^}]*(?:" + REQUEST + r"|" + REQUEST_USER + r")|" + REQUEST + r"|" + REQUEST_USER + r"|" + URL_VARIABLE + r")"),
        ],
        unless_near=URL_CHECKED,
        code_only=True,
    ),
    Rule(
        "SSRF002", "api-security", ERROR, CODE,
        match=[
            rx(r"\baxios(?:\.(?:get|post|put|delete|patch|head|request))?\s*\(\s*(?:`[^`]*\$\{[^}]*(?:" + REQUEST + r"|" + REQUEST_USER + r")|" + REQUEST + r"|" + REQUEST_USER + r"|" + URL_VARIABLE + r")"),
        ],
        unless_near=URL_CHECKED,
        code_only=True,
    ),
    Rule(
        "SSRF003", "api-security", ERROR, CODE,
        match=[
            rx(r"\bhttps?\.(?:get|request)\s*\(\s*(?:`[^`]*\$\{[^}]*(?:" + REQUEST + r"|" + REQUEST_USER + r")|" + REQUEST + r"|" + REQUEST_USER + r"|" + URL_VARIABLE + r")"),
        ],
        unless_near=URL_CHECKED,
        code_only=True,
    ),
    Rule(
        "SSRF004", "api-security", ERROR, CODE,
        match=[
            rx(r"\brequests\.(?:get|post|put|delete|patch|head|request)\s*\(\s*(?:request\.(?:args|form|json|values)|flask\.request\.(?:args|form|json)|g\.request\.)", "i"),
        ],
        unless_near=URL_CHECKED,
        code_only=True,
    ),
    Rule(
        "SSRF005", "api-security", ERROR, CODE,
        match=[
            rx(r"\burllib\.request\.urlopen\s*\(\s*(?:request\.|flask\.request\.|\w*(?:user|target|input)[\w]*url)", "i"),
            rx(r"\burlopen\s*\(\s*(?:request\.|flask\.request\.|\w*(?:user|target|input)[\w]*url)", "i"),
        ],
        unless_near=URL_CHECKED,
        code_only=True,
    ),
    Rule(
        "SSRF006", "api-security", ERROR, CODE,
        match=[
            rx(r"\b(?:restTemplate|restClient)\.(?:getForObject|exchange|postForObject|execute)\s*\([^)]*\brequest\.(?:getParameter|getQueryString|getHeader)", "i"),
            rx(r"\bnew\s+URL\s*\(\s*request\.(?:getParameter|getQueryString|getHeader)", "i"),
            rx(r"\bHttpRequest\.newBuilder\s*\(\s*\)\.uri\s*\(\s*URI\.create\s*\([^)]*request\.(?:getParameter|getHeader)", "i"),
        ],
        unless_near=URL_CHECKED,
    ),
    Rule(
        "SSRF007", "api-security", ERROR, CODE,
        match=[
            rx(r"\bcurl_setopt\s*\([^,]+,\s*CURLOPT_URL\s*,\s*\$_(?:GET|POST|REQUEST|COOKIE)", "i"),
            rx(r"\bfile_get_contents\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", "i"),
            rx(r"\bfopen\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)", "i"),
        ],
    ),
    Rule(
        "SSRF008", "api-security", ERROR, CODE,
        match=[
            rx(r"\bhttp\.(?:Get|Post|Head|PostForm|NewRequest)\s*\(\s*(?:r\.URL\.Query\(\)|r\.FormValue|r\.Form\.Get|c\.Query|c\.PostForm)"),
        ],
    ),
    Rule(
        "SSRF009", "api-security", WARNING, CODE,
        match=[
            rx(r"\b(?:const|let|var)\s+\w*(?:webhook|callback|redirect)\w*\s*=\s*(?:req|request|ctx)\.(?:query|body|params|input)", "i"),
        ],
        unless_near=URL_CHECKED,
    ),
]
