"""Cluster manifests."""

from .model import CODE, ERROR, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.
YAML_ONLY = [
    rx(r"\.ya?ml$", "i"),
]
YAML_SKIP = [
    rx(r"[\\/]\.github[\\/]", "i"),
    rx(r"docker-?compose\.ya?ml$", "i"),
]

RULES = [
    Rule(
        "K8S001", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"^\s*privileged:\s*true\b", "m"),
        ],
        only_paths=YAML_ONLY,
        skip_paths=YAML_SKIP,
    ),
    Rule(
        "K8S002", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"^\s*hostNetwork:\s*true\b", "m"),
        ],
        only_paths=YAML_ONLY,
        skip_paths=YAML_SKIP,
    ),
    Rule(
        "K8S003", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"^\s*hostPID:\s*true\b", "m"),
            rx(r"^\s*hostIPC:\s*true\b", "m"),
        ],
        only_paths=YAML_ONLY,
        skip_paths=YAML_SKIP,
    ),
    Rule(
        "K8S004", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"^\s*runAsUser:\s*0\b", "m"),
            rx(r"^\s*allowPrivilegeEscalation:\s*true\b", "m"),
        ],
        only_paths=YAML_ONLY,
        skip_paths=YAML_SKIP,
    ),
    Rule(
        "K8S005", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"^\s*hostPath:\s*$", "m"),
        ],
        only_paths=YAML_ONLY,
        skip_paths=YAML_SKIP,
    ),
    Rule(
        "K8S006", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"""add:\s*\[?["']?(?:SYS_ADMIN|NET_ADMIN|SYS_PTRACE|SYS_MODULE|SYS_RAWIO|NET_RAW|DAC_READ_SEARCH|BPF)["']?"""),
        ],
        only_paths=YAML_ONLY,
        skip_paths=YAML_SKIP,
    ),
    Rule(
        "K8S007", "infrastructure-deployment", ERROR, CODE,
        match=[
            rx(r"""verbs:\s*\[\s*["']\*["']\s*\]"""),
            rx(r"""resources:\s*\[\s*["']\*["']\s*\]"""),
        ],
        only_paths=YAML_ONLY,
        skip_paths=YAML_SKIP,
    ),
    Rule(
        "K8S008", "infrastructure-deployment", WARNING, CODE,
        match=[
            rx(r"^\s*type:\s*(?:NodePort|LoadBalancer)\b", "m"),
        ],
        unless_near=[
            rx(r"loadBalancerSourceRanges:"),
            rx(r"externalTrafficPolicy:\s*Local"),
            rx(r"\binternal:\s*true"),
        ],
        only_paths=YAML_ONLY,
        skip_paths=YAML_SKIP,
    ),
]
