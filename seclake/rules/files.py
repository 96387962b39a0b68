"""Paths, uploads and storage buckets."""

from .model import CODE, ERROR, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "FILE001", "file-handling", ERROR, CODE,
        match=[
            rx(r"(?:readFile|readFileSync|createReadStream)\s*\(.*(?:req|request|params|query|body)\.", "i"),
            rx(r"open\s*\(.*(?:req|request|params|query)\.", "i"),
        ],
    ),
    Rule(
        "FILE002", "file-handling", WARNING, REMINDER,
        match=[
            rx(r"upload\.(?:single|array|fields)\s*\("),
            rx(r"multer\s*\("),
        ],
    ),
    Rule(
        "FILE003", "file-handling", WARNING, CODE,
        match=[
            rx(r"""writeFileSync\s*\(\s*['"]/tmp/""", "i"),
            rx(r"tempfile\.", "i"),
            rx(r"os\.CreateTemp", "i"),
        ],
    ),
    Rule(
        "FILE004", "file-handling", WARNING, CODE,
        match=[
            rx(r"followSymlinks\s*:\s*true", "i"),
        ],
    ),
    Rule(
        "FILE005", "file-handling", WARNING, CODE,
        match=[
            rx(r"0o?777"),
            rx(r"0o?766"),
            rx(r"0o?776"),
        ],
    ),
    Rule(
        "FILE006", "file-handling", ERROR, CODE,
        match=[
            rx(r"path\.join\s*\(.*(?:req|request|params|query|body)\.", "i"),
            rx(r"path\.resolve\s*\(.*(?:req|request|params|query|body)\.", "i"),
        ],
    ),
    Rule(
        "FILE007", "file-handling", INFO, REMINDER,
        match=[
            rx(r"upload.*(?:public|static|www|htdocs|webroot)", "i"),
            rx(r"""destination\s*:\s*['"].*(?:public|static)""", "i"),
        ],
    ),
    Rule(
        "FILE008", "file-handling", WARNING, REMINDER,
        match=[
            rx(r"\.originalname", "i"),
            rx(r"req\.file\b", "i"),
            rx(r"req\.files\b", "i"),
        ],
    ),
    Rule(
        "FILE009", "file-handling", ERROR, CODE,
        match=[
            rx(r"""(?:acl|ACL)\s*[:=]\s*['"]public-read['"]""", "i"),
            rx(r"PublicRead"),
            rx(r"allUsers.*(?:storage|bucket|iam|role|binding|permission|acl)", "i"),
            rx(r"(?:storage|bucket|iam|role|binding|permission|acl).*allUsers", "i"),
            rx(r"public\s*:\s*true.*(?:bucket|storage|blob)", "i"),
        ],
        unless=[
            rx(r"<Select", "i"),
            rx(r"<Option", "i"),
            rx(r"SelectItem", "i"),
            rx(r"MenuItem", "i"),
            rx(r"""value\s*=\s*["']""", "i"),
            rx(r"""label\s*=\s*["']""", "i"),
        ],
    ),
    Rule(
        "FILE010", "file-handling", INFO, REMINDER,
        match=[
            rx(r"getSignedUrl", "i"),
            rx(r"presigned", "i"),
            rx(r"generateSignedUrl", "i"),
            rx(r"s3\.getObject", "i"),
        ],
    ),
    Rule(
        "FILE011", "file-handling", INFO, REMINDER,
        match=[
            rx(r"storage\.rules", "i"),
            rx(r"firebaseStorage", "i"),
            rx(r"StorageReference", "i"),
            rx(r"s3\.putObject", "i"),
            rx(r"BlobServiceClient", "i"),
        ],
    ),
    Rule(
        "FILE012", "file-handling", ERROR, CODE,
        match=[
            rx(r"\.(?:exe|sh|bat|cmd|ps1|msi|dll|so|bin)\b.*(?:upload|file|allow)", "i"),
            rx(r"(?:upload|file|allow).*\.(?:exe|sh|bat|cmd|ps1|msi|dll|so|bin)\b", "i"),
        ],
    ),
    Rule(
        "FILE013", "file-handling", INFO, REMINDER,
        match=[
            rx(r"S3Client", "i"),
            rx(r"new\s+Storage\s*\(", "i"),
            rx(r"BlobServiceClient", "i"),
            rx(r"CloudStorageClient", "i"),
        ],
    ),
    Rule(
        "FILE014", "file-handling", WARNING, CODE,
        match=[
            rx(r"""\.(?:endsWith|match)\s*\(\s*['"]\.(?:jpg|png|pdf|doc)""", "i"),
            rx(r"""\.split\s*\(\s*['"]\.['"].*pop""", "i"),
            rx(r"path\.extname", "i"),
        ],
    ),
]
