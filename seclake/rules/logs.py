"""Secrets in logs and audit reminders."""

from .model import ADVISORY, CODE, ERROR, INFO, REMINDER, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "LOG001", "logging-monitoring", INFO, REMINDER,
        match=[
            rx(r"(?:login|signIn|authenticate)\s*(?:\(|=)", "i"),
        ],
    ),
    Rule(
        "LOG002", "logging-monitoring", INFO, REMINDER,
        match=[
            rx(r"(?:unauthorized|forbidden|403|accessDenied|access_denied)", "i"),
        ],
    ),
    Rule(
        "LOG003", "logging-monitoring", INFO, REMINDER,
        match=[
            rx(r"(?:isAdmin|is_admin|role.*admin|adminAction|privileged)", "i"),
        ],
    ),
    Rule(
        "LOG004", "logging-monitoring", INFO, REMINDER,
        match=[
            rx(r"(?:updateRole|changeRole|setPermission|grantAccess|revokeAccess)", "i"),
            rx(r"(?:update|change|modify).*(?:role|permission|access)", "i"),
        ],
    ),
    Rule(
        "LOG005", "logging-monitoring", ERROR, CODE,
        match=[
            rx(r"(?:console\.log|logger\.\w+|log\.\w+|print)\s*\(.*[\s,{(+]password\s*[,}):\]]", "i"),
            rx(r"(?:console\.log|logger\.\w+|log\.\w+|print)\s*\(.*[\s,{(+]passwd\s*[,}):\]]", "i"),
            rx(r"(?:console\.log|logger\.\w+|log\.\w+|print)\s*\(.*\+\s*password", "i"),
            rx(r"(?:console\.log|logger\.\w+|log\.\w+|print)\s*\(.*\$\{.*password", "i"),
        ],
        unless=[
            rx(r"temporary passwords", "i"),
            rx(r"password requirements", "i"),
            rx(r"password policy", "i"),
            rx(r"password must", "i"),
            rx(r"password has been", "i"),
            rx(r"reset password", "i"),
        ],
    ),
    Rule(
        "LOG006", "logging-monitoring", ERROR, CODE,
        match=[
            rx(r"(?:console\.log|logger\.\w+|log\.\w+|print)\s*\(.*(?:api[_-]?key|apiSecret|secret[_-]?key|access[_-]?key)", "i"),
        ],
    ),
    Rule(
        "LOG007", "logging-monitoring", INFO, ADVISORY,
        match=[
            rx(r"(?:winston|bunyan|pino|log4js|morgan)\s*(?:\(|\.)", "i"),
            rx(r"createLogger", "i"),
        ],
    ),
    Rule(
        "LOG008", "logging-monitoring", INFO, ADVISORY,
        match=[
            rx(r"logFile|log_file|logPath|log_path|logDir", "i"),
        ],
    ),
    Rule(
        "LOG009", "logging-monitoring", INFO, REMINDER,
        match=[
            rx(r"(?:export|download).*(?:data|report|csv|pdf)", "i"),
            rx(r"(?:rotate|regenerate|revoke).*(?:key|token|secret)", "i"),
        ],
    ),
]
