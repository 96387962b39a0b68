"""XML parsers that resolve external entities."""

from .model import CODE, ERROR, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.
HARDENED = [
    rx(r"""setFeature\s*\(\s*['"]http://apache\.org/xml/features/(?:disallow-doctype-decl|nonvalidating/load-(?:external-dtd|dtd-grammar))['"]\s*,\s*(?:true|false)\s*\)"""),
    rx(r"""setFeature\s*\(\s*['"]http://xml\.org/sax/features/external-(?:general|parameter)-entities['"]\s*,\s*false\s*\)"""),
    rx(r"setExpandEntityReferences\s*\(\s*false\s*\)"),
    rx(r"setXIncludeAware\s*\(\s*false\s*\)"),
    rx(r"\.XmlResolver\s*=\s*null"),
    rx(r"DtdProcessing\.(?:Prohibit|Ignore)"),
    rx(r"resolve_entities\s*=\s*False"),
    rx(r"no_network\s*=\s*True"),
    rx(r"defusedxml"),
    rx(r"libxml_disable_entity_loader\s*\(\s*true\s*\)"),
    rx(r"LIBXML_NONET"),
]

RULES = [
    Rule(
        "XXE001", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bDocumentBuilderFactory\.newInstance\s*\(\s*\)"),
        ],
        unless_near=HARDENED,
    ),
    Rule(
        "XXE002", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bSAXParserFactory\.newInstance\s*\(\s*\)"),
        ],
        unless_near=HARDENED,
    ),
    Rule(
        "XXE003", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bXMLInputFactory\.newInstance\s*\(\s*\)"),
            rx(r"\bXMLInputFactory\.newFactory\s*\(\s*\)"),
        ],
        unless_near=HARDENED,
    ),
    Rule(
        "XXE004", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\blxml\.etree\.(?:fromstring|parse|XML|ElementTree|iterparse)\s*\("),
            rx(r"\betree\.(?:fromstring|parse|XML|iterparse)\s*\("),
        ],
        unless_near=HARDENED + [
            rx(r"XMLParser\s*\([^)]*resolve_entities\s*=\s*False"),
            rx(r"XMLParser\s*\([^)]*no_network\s*=\s*True"),
            rx(r"from\s+defusedxml"),
        ],
    ),
    Rule(
        "XXE005", "input-validation-xss", WARNING, CODE,
        match=[
            rx(r"\bxml\.etree\.ElementTree\.(?:parse|fromstring|iterparse)\s*\("),
            rx(r"\bxml\.sax\.(?:parse|parseString|make_parser)\s*\("),
            rx(r"\bxml\.dom\.minidom\.(?:parse|parseString)\s*\("),
        ],
        unless_near=[
            rx(r"from\s+defusedxml"),
            rx(r"defusedxml\."),
        ],
    ),
    Rule(
        "XXE006", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\bnew\s+XmlDocument\s*\(\s*\)"),
            rx(r"\bnew\s+XmlTextReader\s*\("),
        ],
        unless_near=HARDENED,
    ),
    Rule(
        "XXE007", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"DtdProcessing\s*=\s*DtdProcessing\.Parse"),
        ],
    ),
    Rule(
        "XXE008", "input-validation-xss", WARNING, CODE,
        match=[
            rx(r"\bsimplexml_load_(?:string|file)\s*\("),
            rx(r"\bDOMDocument\s*\(\s*\)"),
        ],
        unless_near=[
            rx(r"libxml_disable_entity_loader\s*\(\s*true\s*\)"),
            rx(r"LIBXML_NONET"),
            rx(r"LIBXML_DTDLOAD"),
            rx(r"PHP_VERSION_ID\s*>=\s*80000"),
        ],
    ),
    Rule(
        "XXE009", "input-validation-xss", ERROR, CODE,
        match=[
            rx(r"\blibxmljs2?\.parseXml\s*\([^)]*noent\s*:\s*true"),
            rx(r"\blibxmljs2?\.parseXmlString\s*\([^)]*noent\s*:\s*true"),
        ],
    ),
]
