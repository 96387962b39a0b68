"""Payment, trial and quota logic."""

from .model import CODE, INFO, REMINDER, WARNING, Rule, rx

# Fixed values from here on: codes, levels, kinds and patterns decide the findings.

RULES = [
    Rule(
        "BIZ001", "business-logic-payment", WARNING, REMINDER,
        match=[
            rx(r"(?:isPremium|isPro|isSubscribed|hasPlan|planType)\s*(?:&&|\?)", "i"),
            rx(r"(?:premium|subscription|plan)\s*[:=]\s*(?:true|false)", "i"),
        ],
        info_paths=[
            rx(r"\.tsx$", "i"),
            rx(r"\.jsx$", "i"),
            rx(r"components?/", "i"),
            rx(r"pages?/", "i"),
            rx(r"views?/", "i"),
            rx(r"hooks?/", "i"),
        ],
    ),
    Rule(
        "BIZ002", "business-logic-payment", WARNING, REMINDER,
        match=[
            rx(r"(?:payment|checkout).*(?:success|complete|confirmed)", "i"),
            rx(r"(?:onSuccess|onApprove|paymentIntent).*(?:status|result)", "i"),
        ],
    ),
    Rule(
        "BIZ003", "business-logic-payment", WARNING, REMINDER,
        match=[
            rx(r"refund", "i"),
        ],
    ),
    Rule(
        "BIZ004", "business-logic-payment", WARNING, REMINDER,
        match=[
            rx(r"(?:trial|freeTrial|free_trial|trialEnd|trial_end)", "i"),
            rx(r"trialPeriod", "i"),
        ],
        skip_paths=[
            rx(r"seed", "i"),
            rx(r"fixtures?", "i"),
            rx(r"migrations?", "i"),
            rx(r"mock", "i"),
        ],
        info_paths=[
            rx(r"scripts?/", "i"),
            rx(r"admin/", "i"),
            rx(r"tools?/", "i"),
            rx(r"internal/", "i"),
        ],
    ),
    Rule(
        "BIZ005", "business-logic-payment", INFO, REMINDER,
        match=[
            rx(r"(?:cancel|unsubscribe).*(?:subscription|plan|membership)", "i"),
            rx(r"(?:subscription|plan|membership).*(?:cancel|unsubscribe)", "i"),
        ],
    ),
    Rule(
        "BIZ006", "business-logic-payment", INFO, REMINDER,
        match=[
            rx(r"(?:stripe|paypal|paddle|braintree|chargebee)", "i"),
        ],
    ),
    Rule(
        "BIZ007", "business-logic-payment", WARNING, REMINDER,
        match=[
            rx(r"(?:quota|usage|limit|remaining).*(?:count|check|enforce|exceeded)", "i"),
            rx(r"(?:count|check|enforce|exceeded).*(?:quota|usage|limit|remaining)", "i"),
        ],
        unless=[
            rx(r"limitCount", "i"),
            rx(r"limitToFirst", "i"),
            rx(r"limitToLast", "i"),
            rx(r"\.limit\s*\(", "i"),
            rx(r"LIMIT\s+\d+", "i"),
            rx(r"OFFSET", "i"),
            rx(r"pageSize", "i"),
            rx(r"perPage", "i"),
            rx(r"per_page", "i"),
            rx(r"pagination", "i"),
        ],
    ),
    Rule(
        "BIZ008", "business-logic-payment", WARNING, CODE,
        match=[
            rx(r"(?:req|request)\.(?:body|query|params)\.(?:count|usage|consumed|used)", "i"),
        ],
    ),
    Rule(
        "BIZ009", "business-logic-payment", INFO, REMINDER,
        match=[
            rx(r"(?:reset|renew).*(?:quota|usage|limit|allowance)", "i"),
            rx(r"(?:quota|usage|limit|allowance).*(?:reset|renew)", "i"),
        ],
    ),
]
