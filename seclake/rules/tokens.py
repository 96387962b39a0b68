"""Access tokens that carry a vendor prefix, as each vendor documents them publicly."""

from .model import CODE, ERROR, WARNING, Rule, rx

CATEGORY = "secrets-credentials"


def _token(number: int, severity: int, *patterns: str) -> Rule:
    return Rule(f"TOKEN{number:03d}", CATEGORY, severity, CODE, match=[rx(p) for p in patterns])


# Published token shapes, numbered in order.
RULES = [
    _token(1, ERROR, r"\bsk-ant-[A-Za-z0-9]{2,10}-[A-Za-z0-9_-]{32,}"),
    _token(2, ERROR, r"\bsk-(?:proj-|svcacct-)?[A-Za-z0-9]{32,}"),
    _token(3, ERROR, r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    _token(4, ERROR, r"\bAIza[A-Za-z0-9_-]{35}", r"\bya29\.[A-Za-z0-9_-]{20,}", r"\bGOCSPX-[A-Za-z0-9_-]{28}"),
    _token(5, ERROR, r"\b(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    _token(6, WARNING, r"\b(?:sk|rk)_test_[A-Za-z0-9]{16,}"),
    _token(7, ERROR, r"\bSK[0-9a-f]{32}\b", r"\bAC[0-9a-f]{32}\b"),
    _token(8, ERROR, r"\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    _token(9, ERROR, r"\bkey-[0-9a-f]{32}\b"),
    _token(10, ERROR, r"\bnpm_[A-Za-z0-9]{36}"),
    _token(11, ERROR, r"\bdckr_pat_[A-Za-z0-9_-]{27}"),
    _token(12, ERROR, r"\bshp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}"),
    _token(13, ERROR, r"\bsecret_[A-Za-z0-9]{43}\b", r"\bntn_[A-Za-z0-9]{40,}"),
    _token(14, ERROR, r"\blin_(?:api|oauth)_[A-Za-z0-9]{40}"),
    _token(15, ERROR, r"\bfigd_[A-Za-z0-9_-]{40}"),
    _token(16, ERROR, r"\bdapi[0-9a-f]{32}\b"),
    _token(17, ERROR, r"\bhf_[A-Za-z0-9]{34}"),
    _token(
        18, ERROR,
        r"\bBot\s+[MNO][A-Za-z0-9_-]{23,25}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27,38}",
        r"[Dd]iscord\w*\s*[:=]\s*['\"][MNO][A-Za-z0-9_-]{23,25}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27,38}",
    ),
    _token(19, WARNING, r"discord(?:app)?\.com/api/webhooks/\d{17,20}/[A-Za-z0-9_-]{60,}"),
    _token(20, ERROR, r"\bATBB[A-Za-z0-9]{32}"),
    _token(21, ERROR, r"\bATATT3[A-Za-z0-9_=-]{40,}"),
    _token(22, ERROR, r"\bdo[opr]_v1_[0-9a-f]{64}"),
    _token(23, ERROR, r"\bsntry[su]_[A-Za-z0-9_=+/-]{40,}"),
    _token(24, ERROR, r"\bPMAK-[0-9a-f]{24}-[0-9a-f]{34}"),
    _token(25, ERROR, r"\bpul-[0-9a-f]{40}\b"),
    _token(26, ERROR, r"\bsq0(?:atp|csp)-[A-Za-z0-9_-]{22,43}", r"\bEAAA[A-Za-z0-9_-]{60}"),
    _token(27, ERROR, r"\bGR1348941[A-Za-z0-9_-]{20}", r"\bglrt-[A-Za-z0-9_-]{20}"),
    _token(28, ERROR, r"\bhttps?://[A-Za-z0-9._%-]+:[^@\s/'\"]{3,}@[A-Za-z0-9.-]+"),
]
