"""Ciphers, keys, transport and personal data."""

from .model import ADVISORY, CODE, ERROR, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "ENC001", "encryption-data-protection", ERROR, CODE,
        match=[
            rx(r"createCipher\s*\("),
            rx(r"""['"]md5['"]""", "i"),
            rx(r"""['"]sha1['"]""", "i"),
            rx(r"""['"]des['"]""", "i"),
            rx(r"""['"]rc4['"]""", "i"),
            rx(r"""MessageDigest\.getInstance\s*\(\s*['"](?:MD5|SHA-?1)['"]""", "i"),
            rx(r"hashlib\.(?:md5|sha1)\s*\(", "i"),
        ],
    ),
    Rule(
        "ENC002", "encryption-data-protection", ERROR, CODE,
        match=[
            rx(r"""(?:encryption|cipher|aes|crypto)[_\s]*(?:key|iv|nonce)\s*[:=]\s*['"][^'"]+['"]""", "i"),
            rx(r"""createCipheriv\s*\(\s*['"][^'"]+['"],\s*['"][^'"]+['"]""", "i"),
        ],
    ),
    Rule(
        "ENC003", "encryption-data-protection", WARNING, CODE,
        match=[
            rx(r"""['"]http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0)""", "i"),
        ],
        unless=[
            rx(r"example\.com|example\.org|example\.net", "i"),
            rx(r"\[.*\]\(http", "i"),
        ],
        code_only=True,
    ),
    Rule(
        "ENC004", "encryption-data-protection", ERROR, CODE,
        match=[
            rx(r"rejectUnauthorized\s*:\s*false", "i"),
            rx(r"InsecureSkipVerify\s*:\s*true", "i"),
            rx(r"ssl_verify\s*[:=]\s*false", "i"),
            rx(r"""NODE_TLS_REJECT_UNAUTHORIZED.*['"]0['"]"""),
            rx(r"CERT_NONE"),
        ],
    ),
    Rule(
        "ENC005", "encryption-data-protection", WARNING, CODE,
        match=[
            rx(r"Math\.random\s*\("),
        ],
        unless=[
            rx(r"(?:id|key|index|seed|color|opacity|position|width|height|left|top|zIndex|order|delay|duration)\s*[:=]", "i"),
            rx(r"className", "i"),
            rx(r"style\s*[:=]", "i"),
            rx(r"animation", "i"),
            rx(r"Math\.random\s*\(\s*\)\s*\.\s*toString", "i"),
        ],
    ),
    Rule(
        "ENC006", "encryption-data-protection", ERROR, CODE,
        match=[
            rx(r"""['"](?:aes|des).*ecb['"]""", "i"),
            rx(r"MODE_ECB"),
        ],
    ),
    Rule(
        "ENC007", "encryption-data-protection", WARNING, CODE,
        match=[
            rx(r"console\.log\s*\(.*(?:password|secret|token|credential|ssn|credit.?card)", "i"),
            rx(r"print\s*\(.*(?:password|secret|token|credential)", "i"),
            rx(r"logger\.(?:info|debug|warn|error)\s*\(.*(?:password|secret|token)", "i"),
        ],
        unless=[
            rx(r"mask\w*\s*\(", "i"),
            rx(r"redact\w*\s*\(", "i"),
            rx(r"anonymize\w*\s*\(", "i"),
            rx(r"temporary passwords", "i"),
            rx(r"password requirements", "i"),
            rx(r"password policy", "i"),
        ],
        unless_near=[
            rx(r"mask\w*\s*\(", "i"),
            rx(r"redact\w*\s*\(", "i"),
            rx(r"anonymize\w*\s*\(", "i"),
        ],
    ),
    Rule(
        "ENC008", "encryption-data-protection", INFO, REMINDER,
        match=[
            rx(r"\b(?:ssn|social_security|credit.?card|date.?of.?birth|passport)\b", "i"),
        ],
        unless=[
            rx(r"className", "i"),
            rx(r"class\s*=", "i"),
            rx(r"classList", "i"),
            rx(r"css", "i"),
            rx(r"style", "i"),
        ],
        code_only=True,
    ),
    Rule(
        "ENC009", "encryption-data-protection", WARNING, REMINDER,
        match=[
            rx(r"Strict-Transport-Security", "i"),
        ],
    ),
    Rule(
        "ENC010", "encryption-data-protection", WARNING, CODE,
        match=[
            rx(r"(?:console\.log|logger\.\w+|print)\s*\([^)]*\b\w+\.(?:email|phone|address|ssn|social.?security|credit.?card|passport)\b", "i"),
            rx(r"(?:console\.log|logger\.\w+|print)\s*\([^)]*\b(?:user|customer|client|person)(?:Email|Phone|Address|SSN|Passport)\b", "i"),
        ],
        unless=[
            rx(r"mask\w*\s*\(", "i"),
            rx(r"redact\w*\s*\(", "i"),
            rx(r"anonymize\w*\s*\(", "i"),
            rx(r"sanitize\w*\s*\(", "i"),
            rx(r"\*{3,}"),
            rx(r"\.slice\s*\(\s*-?\d", "i"),
            rx(r"\.substring\s*\(", "i"),
            rx(r"\.replace\s*\(.*\*", "i"),
            rx(r"filename|filepath|pathname|dirname|basename", "i"),
            rx(r"classname|typename|tagname|nodename|elementname", "i"),
            rx(r"username|hostname|servername|databasename", "i"),
            rx(r"languagename|frameworkname|packagename", "i"),
            rx(r"displayname|appname|sitename", "i"),
            rx(r"email.*config|config.*email", "i"),
            rx(r"schema|model|interface|type\s+\w+", "i"),
        ],
        unless_near=[
            rx(r"mask\w*\s*\(", "i"),
            rx(r"redact\w*\s*\(", "i"),
            rx(r"anonymize\w*\s*\(", "i"),
        ],
    ),
    Rule(
        "ENC011", "encryption-data-protection", INFO, ADVISORY,
        match=[
            rx(r"(?:backup|dump|export).*(?:database|db|sql|mongo)", "i"),
            rx(r"(?:database|db|sql|mongo).*(?:backup|dump|export)", "i"),
        ],
    ),
    Rule(
        "ENC012", "encryption-data-protection", INFO, ADVISORY,
        match=[
            rx(r"(?:userData|userProfile|personalData|userRecord)", "i"),
            rx(r"(?:gdpr|data.?subject|right.?to.?erasure|data.?portability)", "i"),
        ],
    ),
]
