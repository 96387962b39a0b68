"""Kotlin and Android apps."""

from .model import CODE, ERROR, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.
KOTLIN_ONLY = [
    rx(r"\.kts?$", "i"),
]

RULES = [
    Rule(
        "KT-AUTH001", "auth-access-control", WARNING, CODE,
        match=[
            rx(r"\.setJavaScriptEnabled\s*\(\s*true\s*\)"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-AUTH002", "auth-access-control", ERROR, CODE,
        match=[
            rx(r"\.addJavascriptInterface\s*\("),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-AUTH003", "auth-access-control", WARNING, CODE,
        match=[
            rx(r"sendBroadcast\s*\(\s*(?!.*permission)"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-AUTH004", "auth-access-control", WARNING, CODE,
        match=[
            rx(r"\.registerReceiver\s*\("),
        ],
        unless=[
            rx(r"RECEIVER_NOT_EXPORTED"),
            rx(r"RECEIVER_EXPORTED"),
            rx(r"LocalBroadcastManager"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-AUTH005", "auth-access-control", WARNING, CODE,
        match=[
            rx(r'Intent\s*\(\s*"[^"]*"\s*\)'),
            rx(r"Intent\s*\(\s*\)"),
        ],
        unless=[
            rx(r"setPackage"),
            rx(r"setClassName"),
            rx(r"setComponent"),
            rx(r"ComponentName"),
            rx(r"explicit", "i"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-AUTH006", "auth-access-control", INFO, REMINDER,
        match=[
            rx(r"setOnClickListener", "i"),
            rx(r"setOnTouchListener", "i"),
        ],
        unless_near=[
            rx(r"filterTouchesWhenObscured", "i"),
            rx(r"FILTER_TOUCHES_WHEN_OBSCURED"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-XSS001", "input-validation-xss", WARNING, CODE,
        match=[
            rx(r"\.setAllowFileAccess\s*\(\s*true\s*\)"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-XSS002", "input-validation-xss", WARNING, CODE,
        match=[
            rx(r"\.setAllowContentAccess\s*\(\s*true\s*\)"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-XSS003", "input-validation-xss", WARNING, CODE,
        match=[
            rx(r"MIXED_CONTENT_ALWAYS_ALLOW"),
            rx(r"setMixedContentMode\s*\(\s*0\s*\)"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-XSS004", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"onReceivedSslError[\s\S]*?\.proceed\s*\("),
            rx(r"SslErrorHandler.*\.proceed\s*\("),
            rx(r"handler\.proceed\s*\(\s*\)"),
        ],
        unless_near=[
            rx(r"handler\.cancel\s*\("),
            rx(r"super\.onReceivedSslError"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-ENC001", "encryption-data-protection", WARNING, CODE,
        match=[
            rx(r"\bnew\s+Random\s*\("),
            rx(r"\bRandom\s*\(\s*\)\b"),
            rx(r"java\.util\.Random\s*\("),
        ],
        unless=[
            rx(r"SecureRandom"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-ENC002", "encryption-data-protection", WARNING, CODE,
        match=[
            rx(r"getSharedPreferences\s*\("),
        ],
        unless=[
            rx(r"EncryptedSharedPreferences", "i"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-ENC003", "encryption-data-protection", ERROR, CODE,
        match=[
            rx(r'SecretKeySpec\s*\(\s*"[^"]+"'),
            rx(r"SecretKeySpec\s*\(\s*'[^']+'"),
            rx(r"SecretKeySpec\s*\(\s*byteArrayOf\s*\("),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-ENC004", "encryption-data-protection", WARNING, CODE,
        match=[
            rx(r'Cipher\.getInstance\s*\(\s*"(?:DES|RC4|Blowfish|AES/ECB)', "i"),
            rx(r'MessageDigest\.getInstance\s*\(\s*"(?:MD5|SHA-?1)"', "i"),
        ],
        unless=[
            rx(r"checksum", "i"),
            rx(r"fingerprint", "i"),
            rx(r"etag", "i"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-ENC005", "encryption-data-protection", WARNING, CODE,
        match=[
            rx(r"""cleartextTrafficPermitted\s*=\s*["']?true""", "i"),
            rx(r"usesCleartextTraffic\s*=\s*true", "i"),
            rx(r"""android:usesCleartextTraffic\s*=\s*["']true["']""", "i"),
        ],
        only_paths=[
            rx(r"\.kts?$", "i"),
            rx(r"\.xml$", "i"),
        ],
    ),
    Rule(
        "KT-ENC006", "encryption-data-protection", WARNING, REMINDER,
        match=[
            rx(r"OkHttpClient\.Builder\s*\("),
            rx(r"OkHttpClient\s*\("),
            rx(r"Retrofit\.Builder\s*\("),
        ],
        unless_near=[
            rx(r"CertificatePinner", "i"),
            rx(r"certificatePinner", "i"),
            rx(r"\.sslSocketFactory\s*\("),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-FILE001", "file-handling", ERROR, CODE,
        match=[
            rx(r"MODE_WORLD_READABLE|MODE_WORLD_WRITEABLE"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-FILE002", "file-handling", WARNING, CODE,
        match=[
            rx(r"getExternalStorageDirectory\s*\("),
            rx(r"Environment\.getExternalStorage"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-DB001", "database-security", WARNING, CODE,
        match=[
            rx(r"@RawQuery"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-LOG001", "logging-monitoring", INFO, CODE,
        match=[
            rx(r"\bLog\.[dvie]\s*\("),
            rx(r"\bLog\.wtf\s*\("),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-LOG002", "logging-monitoring", WARNING, CODE,
        match=[
            rx(r"ClipData\.newPlainText\s*\(.*(?:password|token|secret|key|ssn|credit)", "i"),
            rx(r"clipboardManager.*(?:password|token|secret|key|credential)", "i"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
    Rule(
        "KT-CRED001", "secrets-credentials", ERROR, CODE,
        match=[
            rx(r'(?:API_KEY|apiKey|api_key|SECRET_KEY|secretKey|PASSWORD|password)\s*[:=]\s*"[^"]{8,}"'),
            rx(r"(?:API_KEY|apiKey|api_key|SECRET_KEY|secretKey|PASSWORD|password)\s*[:=]\s*'[^']{8,}'"),
        ],
        unless=[
            rx(r"BuildConfig\."),
            rx(r"getString\s*\("),
            rx(r"System\.getenv"),
            rx(r"getenv\s*\("),
            rx(r"TODO", "i"),
            rx(r"PLACEHOLDER", "i"),
            rx(r"example", "i"),
        ],
        only_paths=KOTLIN_ONLY,
    ),
]
