"""HTML sinks and input validation."""

from .model import CODE, ERROR, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "XSS001", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\.innerHTML\s*="),
            rx(r"\.outerHTML\s*="),
        ],
        code_only=True,
    ),
    Rule(
        "XSS002", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"document\.write\s*\("),
            rx(r"document\.writeln\s*\("),
        ],
        code_only=True,
    ),
    Rule(
        "XSS003", "input-validation-xss", WARNING, CODE,
        match=[
            rx(r"""['"].*<[a-z].*['"].*\+.*(?:req|request|params|query|body)\.""", "i"),
        ],
    ),
    Rule(
        "XSS004", "input-validation-xss", WARNING, CODE,
        match=[
            rx(r"dangerouslySetInnerHTML"),
        ],
        unless=[
            rx(r"JSON\.stringify", "i"),
            rx(r"DOMPurify", "i"),
            rx(r"sanitize\w*\s*\(", "i"),
            rx(r"purify", "i"),
        ],
        unless_near=[
            rx(r"JSON\.stringify", "i"),
            rx(r"DOMPurify\.sanitize", "i"),
            rx(r"sanitizeHtml", "i"),
            rx(r"application/ld\+json", "i"),
        ],
    ),
    Rule(
        "XSS005", "input-validation-xss", WARNING, CODE,
        match=[
            rx(r"\{!!.*!!\}"),
            rx(r"\|\s*safe\b"),
        ],
    ),
    Rule(
        "XSS006", "input-validation-xss", WARNING, REMINDER,
        match=[
            rx(r"req\.(?:body|query|params)\.\w+\s*[;)]"),
            rx(r"request\.(?:GET|POST|form)\[", "i"),
        ],
    ),
    Rule(
        "XSS007", "input-validation-xss", WARNING, CODE,
        match=[
            rx(r"bypassSecurityTrust(?:Html|Script|Style|Url|ResourceUrl)"),
        ],
    ),
    Rule(
        "XSS008", "input-validation-xss", INFO, REMINDER,
        match=[
            rx(r"Content-Security-Policy", "i"),
        ],
    ),
    Rule(
        "XSS009", "input-validation-xss", WARNING, REMINDER,
        match=[
            rx(r"req\.(?:body|query|params)\.\w+\s*(?:&&|!==?\s*(?:undefined|null|''))"),
            rx(r"request\.(?:form|args|GET|POST)\[.*\]\s*(?:and|is\s+not\s+None|!=\s*None)", "i"),
        ],
    ),
    Rule(
        "XSS010", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"<script[^>]*>.*\$\{"),
            rx(r"<script[^>]*>.*\+\s*(?:req|request|params|query|body|user)", "i"),
            rx(r"""['"]<script[^>]*>['"].*\+"""),
        ],
    ),
    Rule(
        "XSS011", "input-validation-xss", WARNING, CODE,
        match=[
            rx(r"""(?:href|src|action)\s*=\s*['"`].*\$\{.*(?:req|request|params|query|body|user)""", "i"),
            rx(r"""(?:redirect|url|link)\s*(?:=|\()\s*['"`].*\+\s*(?:req|request|params|query|body)\.""", "i"),
            rx(r"encodeURI(?:Component)?\s*\(\s*\)\s*"),
        ],
    ),
    Rule(
        "XSS012", "input-validation-xss", WARNING, REMINDER,
        match=[
            rx(r"app\.(?:post|put|patch)\s*\(", "i"),
            rx(r"router\.(?:post|put|patch)\s*\(", "i"),
        ],
        unless_near=[
            rx(r"Content-Type", "i"),
            rx(r"express\.json", "i"),
            rx(r"bodyParser", "i"),
            rx(r"multer", "i"),
            rx(r"express\.urlencoded", "i"),
        ],
    ),
    Rule(
        "XSS013", "input-validation-xss", INFO, REMINDER,
        match=[
            rx(r"req\.body\.\w+", "i"),
        ],
        unless_near=[
            rx(r"joi\.", "i"),
            rx(r"zod\.", "i"),
            rx(r"yup\.", "i"),
            rx(r"express-validator", "i"),
            rx(r"\.validate\s*\(", "i"),
            rx(r"\.parse\s*\(", "i"),
            rx(r"\.safeParse\s*\(", "i"),
        ],
    ),
    Rule(
        "XSS014", "input-validation-xss", WARNING, CODE,
        match=[
            rx(r"res\.(?:send|write)\s*\(.*(?:req|request)\.", "i"),
            rx(r"response\.(?:send|write)\s*\(.*(?:req|request)\.", "i"),
        ],
        unless=[
            rx(r"escapeHtml", "i"),
            rx(r"encode", "i"),
            rx(r"sanitize", "i"),
            rx(r"DOMPurify", "i"),
            rx(r"res\.json", "i"),
        ],
    ),
    Rule(
        "XSS015", "input-validation-xss", WARNING, CODE,
        match=[
            rx(r"\.innerHTML\s*="),
        ],
        unless_near=[
            rx(r"DOMPurify", "i"),
            rx(r"sanitize-?html", "i"),
            rx(r"xss\s*\(", "i"),
            rx(r"sanitize\s*\(", "i"),
            rx(r"purify", "i"),
        ],
    ),
    Rule(
        "XSS016", "input-validation-xss", INFO, REMINDER,
        match=[
            rx(r"res\.render\s*\(", "i"),
            rx(r"\.ejs", "i"),
            rx(r"\.hbs", "i"),
            rx(r"\.pug", "i"),
        ],
        unless_near=[
            rx(r"escapeHtml", "i"),
            rx(r"encodeURIComponent", "i"),
            rx(r"sanitize", "i"),
            rx(r"autoEscape", "i"),
        ],
    ),
]
