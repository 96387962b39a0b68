"""Server-side templates built from input."""

from .model import CODE, ERROR, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.
REQUEST = r"(?:req|request|ctx|context)\.(?:query|body|params|input|url)"

RULES = [
    Rule(
        "SSTI001", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\brender_template_string\s*\(\s*(?:request\.(?:args|form|json|values)|flask\.request\.|params\.)"),
        ],
    ),
    Rule(
        "SSTI002", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bjinja2?\.Template\s*\(\s*(?:request\.|flask\.request\.|params\.)", "i"),
            rx(r"\bEnvironment\s*\([^)]*\)[\s\S]{0,120}?\.from_string\s*\(\s*(?:request\.|flask\.request\.|params\.)", "i"),
            rx(r"\.from_string\s*\(\s*(?:request\.(?:args|form|json|values)|flask\.request\.)", "i"),
        ],
    ),
    Rule(
        "SSTI003", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bejs\.(?:render|compile)\s*\(\s*" + REQUEST),
        ],
    ),
    Rule(
        "SSTI004", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bHandlebars\.(?:compile|precompile)\s*\(\s*" + REQUEST),
        ],
    ),
    Rule(
        "SSTI005", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\b(?:pug|jade)\.(?:render|compile)\s*\(\s*" + REQUEST),
        ],
    ),
    Rule(
        "SSTI006", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bERB\.new\s*\(\s*(?:params|request|cookies)\["),
            rx(r"\bErubi(?:s|::)?\.new\s*\(\s*(?:params|request|cookies)\["),
        ],
    ),
    Rule(
        "SSTI007", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bVelocity\.evaluate\s*\(\s*[^,]+,\s*[^,]+,\s*[^,]+,\s*request\.(?:getParameter|getHeader)"),
            rx(r"\bvelocityEngine\.evaluate\s*\([^)]*request\.(?:getParameter|getHeader)"),
            rx(r"\bnew\s+Template\s*\(\s*[^,]+,\s*new\s+StringReader\s*\(\s*request\.(?:getParameter|getHeader)"),
        ],
    ),
    Rule(
        "SSTI008", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bTwig_Environment[^;]*->render\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE)"),
            rx(r"""\bSmarty[^;]*->fetch\s*\(\s*['"]string:[^'"]*\$_(?:GET|POST|REQUEST|COOKIE)"""),
        ],
    ),
]
