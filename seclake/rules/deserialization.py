"""Unsafe object loading."""

from .model import CODE, ERROR, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "DESER001", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\b(?:pickle|cPickle|_pickle|dill|joblib)\.(?:loads|load)\s*\("),
            rx(r"\bshelve\.open\s*\("),
        ],
    ),
    Rule(
        "DESER002", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bmarshal\.(?:loads|load)\s*\("),
        ],
    ),
    Rule(
        "DESER003", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\byaml\.unsafe_load\w*\s*\("),
        ],
    ),
    Rule(
        "DESER004", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\byaml\.load\s*\([^)]*\)(?!\s*,\s*Loader\s*=\s*(?:yaml\.)?(?:SafeLoader|BaseLoader))"),
        ],
        unless=[
            rx(r"Loader\s*=\s*(?:yaml\.)?(?:SafeLoader|BaseLoader)"),
            rx(r"yaml\.safe_load"),
        ],
    ),
    Rule(
        "DESER005", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bObjectInputStream\s*\([^)]*\)[^;]*\.readObject\s*\("),
            rx(r"\.\s*readObject\s*\(\s*\)[^;]*\s*;[\s\S]{0,160}?ObjectInputStream"),
            rx(r"new\s+ObjectInputStream\s*\("),
        ],
    ),
    Rule(
        "DESER006", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bBinaryFormatter\s*\(\s*\)\s*\.\s*Deserialize\s*\("),
            rx(r"\bSoapFormatter\s*\(\s*\)\s*\.\s*Deserialize\s*\("),
            rx(r"\bNetDataContractSerializer\s*\(\s*\)\s*\.\s*ReadObject\s*\("),
            rx(r"\bLosFormatter\s*\(\s*\)\s*\.\s*Deserialize\s*\("),
        ],
    ),
    Rule(
        "DESER007", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bunserialize\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)"),
            rx(r"\bunserialize\s*\(\s*(?:file_get_contents|base64_decode)\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)"),
        ],
    ),
    Rule(
        "DESER008", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\beval\s*\(\s*(?:req|request|ctx)\.(?:query|body|params|headers)"),
            rx(r"\bnew\s+Function\s*\(\s*(?:req|request|ctx)\.(?:query|body|params|headers)"),
            rx(r"\bvm\.(?:runInNewContext|runInThisContext|runInContext|createScript|Script)\s*\(\s*(?:req|request|ctx)\.(?:query|body|params|headers)"),
        ],
    ),
    Rule(
        "DESER009", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bYAML\.load\s*\(\s*(?:params|request|cookies)"),
            rx(r"\bMarshal\.load\s*\(\s*(?:params|request|cookies)"),
            rx(r"\bPsych\.load\s*\("),
        ],
    ),
]
