"""Infrastructure as code."""

from .model import CODE, ERROR, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.
TERRAFORM_ONLY = [
    rx(r"\.tf(vars)?$", "i"),
    rx(r"\.hcl$", "i"),
]

RULES = [
    Rule(
        "TF001", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"""cidr_blocks\s*=\s*\[\s*["']0\.0\.0\.0/0["']"""),
            rx(r"""source_security_group_id\s*=\s*["']sg-[0-9a-f]+["']\s*#\s*(?:public|internet)""", "i"),
            rx(r"""ipv6_cidr_blocks\s*=\s*\[\s*["']::/0["']"""),
        ],
        only_paths=TERRAFORM_ONLY,
    ),
    Rule(
        "TF002", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"""\bacl\s*=\s*["'](?:public-read|public-read-write|authenticated-read)["']"""),
            rx(r"\bblock_public_acls\s*=\s*false"),
            rx(r"\bblock_public_policy\s*=\s*false"),
            rx(r"\bignore_public_acls\s*=\s*false"),
            rx(r"\brestrict_public_buckets\s*=\s*false"),
        ],
        only_paths=TERRAFORM_ONLY,
    ),
    Rule(
        "TF003", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"""\bactions\s*=\s*\[[^\]]*["']\*["']""", "i"),
            rx(r"""\bresources\s*=\s*\[[^\]]*["']\*["']""", "i"),
            rx(r'"Action"\s*:\s*(?:\[\s*)?"\*"'),
            rx(r'"Resource"\s*:\s*(?:\[\s*)?"\*"'),
            rx(r"""\baction\s*=\s*["']\*["']""", "i"),
            rx(r"""\bresource\s*=\s*["']\*["']""", "i"),
        ],
        only_paths=TERRAFORM_ONLY,
    ),
    Rule(
        "TF004", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"publicly_accessible\s*=\s*true"),
        ],
        only_paths=TERRAFORM_ONLY,
    ),
    Rule(
        "TF005", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"""\bresource\s+["']aws_s3_bucket["'](?![\s\S]{0,400}server_side_encryption_configuration)"""),
            rx(r"""\bresource\s+["']aws_ebs_volume["'](?![\s\S]{0,400}encrypted\s*=\s*true)"""),
            rx(r"""\bresource\s+["']aws_db_instance["'](?![\s\S]{0,600}storage_encrypted\s*=\s*true)"""),
        ],
        only_paths=TERRAFORM_ONLY,
    ),
    Rule(
        "TF006", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"""\b(?:master_)?password\s*=\s*["'][^"']{4,}["']""", "i"),
        ],
        unless=[
            rx(r"var\.|local\.|data\.aws_secretsmanager_|random_password\."),
            rx(r"sensitive\s*=\s*true"),
        ],
        only_paths=TERRAFORM_ONLY,
    ),
    Rule(
        "TF007", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"\blogging\s*\{[^}]*enabled\s*=\s*false"),
            rx(r"""\bflow_log.*\bLogDestination\s*=\s*(?:null|""|''\s*)"""),
        ],
        only_paths=TERRAFORM_ONLY,
    ),
    Rule(
        "TF008", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"""\bpolicy_arn\s*=\s*["']arn:aws:iam::aws:policy/AdministratorAccess["']"""),
            rx(r"\bmanaged_policy_arns\s*=\s*\[[^\]]*AdministratorAccess"),
        ],
        only_paths=TERRAFORM_ONLY,
    ),
    Rule(
        "TF009", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"""\bprotocol\s*=\s*["']HTTP["']\s*(?![\s\S]{0,300}default_action\s*\{[\s\S]*?redirect)"""),
        ],
        only_paths=TERRAFORM_ONLY,
    ),
    Rule(
        "TF010", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r'"Principal"\s*:\s*\{\s*"AWS"\s*:\s*"arn:aws:iam::\d+:root"\s*\}\s*,\s*"Action"\s*:\s*"kms:\*"'),
            rx(r'Principal\s*=\s*\{\s*AWS\s*=\s*"arn:aws:iam::\d+:root"\s*\}\s*\n\s*Action\s*=\s*"kms:\*"'),
        ],
        only_paths=TERRAFORM_ONLY,
    ),
]
