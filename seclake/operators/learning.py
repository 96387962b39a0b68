"""What past actions say about rules: rates, likelihood, insights, hot zones, safe helpers.

The input is an append-only action log (repo, ts, code, action, language, path, detected_at,
line_text) with actions detected, fixed, ignored, false_positive, verified and fix_failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_bucket

# Functions known to clean input, the rules they neutralise, and words that name such functions.
KNOWN_HELPERS = {
    "DOMPurify.sanitize": ["XSS"], "sanitize": ["XSS"], "escape": ["XSS"], "escapeHtml": ["XSS"],
    "encodeURIComponent": ["XSS"], "encodeURI": ["XSS"], "validator.isEmail": ["XSS"],
    "validator.escape": ["XSS"], "xss": ["XSS"], "helmet": ["CORS", "XSS", "CSRF"], "csurf": ["CSRF"],
    "csrf": ["CSRF"], "bcrypt.hash": ["CRED", "AUTH"], "argon2.hash": ["CRED", "AUTH"],
    "crypto.createHash": ["ENC"], "parameterized": ["DB", "SQL"], "prepare": ["DB", "SQL"],
}
_CALL = r"([a-zA-Z_$][\w$.]*)\s*\("
_NOT_HELPERS = ["if", "for", "while", "switch", "function", "return", "require", "import", "console"]
_HELPER_WORDS = r"(?i)sanitiz|valid|escap|encod|purg|clean|filter|strip"
MIN_SEEN = 5


def _n(*actions: str) -> Column:
    return F.sum(F.when(F.col("action").isin(*actions), 1).otherwise(0))


def rule_stats(actions: DataFrame, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """Counters per rule, with the time from detection to action."""
    settled = F.col("action").isin("fixed", "ignored", "false_positive", "verified") & F.col("detected_at").isNotNull()
    took = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.col("detected_at").cast("timestamp"))
    detected = F.when(F.col("action") == "detected", F.col("ts"))
    return actions.groupBy(*keys).agg(
        _n("detected").alias("detections"), _n("false_positive").alias("fps"), _n("fixed").alias("fixed"),
        _n("ignored").alias("ignored"), _n("verified").alias("verified"), _n("fix_failed").alias("fix_failed"),
        F.min("ts").alias("first_seen_at"), F.max(detected).alias("last_fired_at"),
        F.sum(F.when(settled, took).otherwise(0)).alias("resolution_ms"),
        F.sum(F.when(settled, 1).otherwise(0)).alias("resolutions"),
    )


def language_stats(actions: DataFrame) -> DataFrame:
    return actions.groupBy("code", "language").agg(
        _n("detected").alias("lang_detections"), _n("false_positive").alias("lang_fps"),
        _n("fixed", "verified").alias("lang_fixed"),
    )


def bucket_stats(actions: DataFrame) -> DataFrame:
    return actions.groupBy("code", path_bucket(F.col("path")).alias("bucket")).agg(
        _n("detected").alias("bucket_detections"), _n("false_positive").alias("bucket_fps")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def fp_rate() -> Column:
    return _ratio(F.col("fps"), F.col("fps") + F.col("fixed") + F.col("verified"))


def effectiveness() -> Column:
    return _ratio(F.col("fixed") + F.col("verified"), F.col("detections"))


def fix_success() -> Column:
    return _ratio(F.col("fixed"), F.col("fixed") + F.col("fix_failed"))


def rule_rates(stats: DataFrame) -> DataFrame:
    return stats.select(
        "code", fp_rate().alias("fp_rate"), effectiveness().alias("effectiveness"), fix_success().alias("fix_success"),
        _ratio(F.col("resolution_ms"), F.col("resolutions")).alias("mean_resolution_ms"),
    )


def likely_real(places: DataFrame, actions: DataFrame) -> DataFrame:
    """Chance that a rule's finding is real at (code, language, path); 0.5 when little is known."""
    stats = rule_stats(actions).select("code", "detections", "fps", "fixed", "verified")
    joined = (
        places.withColumn("bucket", path_bucket(F.col("path"))).join(stats, "code", "left")
        .join(language_stats(actions), ["code", "language"], "left").join(bucket_stats(actions), ["code", "bucket"], "left")
    )
    base = 1 - fp_rate()
    lang_all = F.col("lang_fps") + F.col("lang_fixed")
    with_lang = F.when(lang_all >= 3, base * 0.6 + (1 - F.col("lang_fps") / lang_all) * 0.4).otherwise(base)
    # Only detections make the divisor, so a bucket without any is left out.
    enough = (F.col("bucket_fps") + F.col("bucket_detections") >= 3) & (F.col("bucket_detections") > 0)
    with_bucket = F.when(
        enough, with_lang * 0.8 + (1 - F.col("bucket_fps") / F.nullif("bucket_detections", F.lit(0))) * 0.2
    ).otherwise(with_lang)
    score = F.when(F.coalesce("detections", F.lit(0)) < MIN_SEEN, 0.5).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), with_bucket))
    )
    return joined.withColumn("likely_real", score).select(*places.columns, "likely_real")


def rule_insights(stats: DataFrame) -> DataFrame:
    """(code, type, value): noisy, effective, never acted on, fixes that fail."""
    acted = F.col("fps") + F.col("fixed") + F.col("verified") + F.col("ignored")
    tries = F.col("fixed") + F.col("fix_failed")
    fail = F.col("fix_failed") / F.nullif(tries, F.lit(0))
    found = F.array_compact(F.array(
        F.when((acted >= MIN_SEEN) & (fp_rate() >= 0.7), F.struct(F.lit("high_fp_rate").alias("type"), fp_rate().alias("value"))),
        F.when((F.col("detections") >= MIN_SEEN) & (effectiveness() >= 0.6),
               F.struct(F.lit("highly_effective").alias("type"), effectiveness().alias("value"))),
        F.when((F.col("detections") >= 10) & (acted == 0),
               F.struct(F.lit("never_acted_on").alias("type"), F.col("detections").cast("double").alias("value"))),
        F.when((tries >= 3) & (fail >= 0.5), F.struct(F.lit("ai_fix_struggles").alias("type"), fail.alias("value"))),
    ))
    return stats.select("code", F.explode(found).alias("i")).select("code", "i.*").orderBy(F.col("value").desc(), "code", "type")


def category_champions(stats: DataFrame) -> DataFrame:
    """Rule families of which nine in ten findings are resolved."""
    grouped = stats.groupBy(F.regexp_replace("code", r"\d+$", "").alias("family")).agg(
        F.sum("detections").alias("total"), F.sum(F.col("fixed") + F.col("verified")).alias("resolved")
    )
    return grouped.where((F.col("total") >= 5) & (F.col("resolved") >= F.col("total") * 0.9))


def overall_fix_success(stats: DataFrame) -> DataFrame:
    total = stats.agg(F.sum(F.col("fixed") + F.col("fix_failed")).alias("attempts"), F.sum("fixed").alias("succeeded"))
    rate = F.floor(F.col("succeeded") / F.col("attempts") * 100 + 0.5).cast("int")
    return total.where(F.col("attempts") >= 5).select(
        "attempts", "succeeded", rate.alias("rate"), F.when(rate >= 80, "celebration").otherwise("info").alias("severity")
    )


def hot_zones(actions: DataFrame) -> DataFrame:
    """Path buckets with at least five detections, riskiest first."""
    zones = actions.groupBy(path_bucket(F.col("path")).alias("zone")).agg(
        _n("detected").alias("total"), _n("false_positive").alias("fps")
    ).where(F.col("total") >= 5)
    confirmed = F.greatest(F.lit(0), F.col("total") - F.col("fps"))
    return zones.select(
        "zone", confirmed.alias("confirmed"), "total", (F.col("fps") / F.col("total")).alias("fp_rate"),
        (confirmed / F.col("total")).alias("risk"),
    ).orderBy(F.col("risk").desc(), "zone")


def helper_names(text: Column, dismissed: Column) -> Column:
    """array<string>: known helpers on a line, and for dismissals also calls that sound like helpers.

    A name counts once per way it was found, as each is an observation of its own.
    """
    known = F.array(*[F.when(text.contains(k), F.lit(k)) for k in KNOWN_HELPERS])
    calls = F.filter(
        F.regexp_extract_all(text, F.lit(_CALL), F.lit(1)),
        lambda c: ~c.isin(_NOT_HELPERS) & c.rlike(_HELPER_WORDS),
    )
    return F.array_compact(F.concat(known, F.when(dismissed, calls).otherwise(F.array().cast("array<string>"))))


def safe_helpers(actions: DataFrame) -> DataFrame:
    """(repo, function, codes, observed, confidence, source) learned from fixes and dismissals.

    The first sighting sets the confidence (0.7 for a fix, 0.5 for a dismissal), each further one adds
    0.1, and a fix outranks a dismissal as the source. Codes are a set of at most the number of rules.
    """
    seen = actions.where(F.col("action").isin("fixed", "false_positive") & F.col("line_text").isNotNull()).select(
        "repo", "code", "ts", F.when(F.col("action") == "fixed", "ai_fix").otherwise("user_fp").alias("source"),
        F.explode(helper_names(F.col("line_text"), F.col("action") == "false_positive")).alias("function"),
    )
    # Fold to one row per (function, rule) first, so that a popular function spreads over its rules.
    folded = seen.groupBy("repo", "function", "code").agg(
        F.count("*").alias("n"), F.min(F.struct("ts", "source")).alias("first"),
        F.max(F.when(F.col("source") == "ai_fix", 1).otherwise(0)).alias("by_fix"),
    )
    grouped = folded.groupBy("repo", "function").agg(
        F.sort_array(F.collect_set("code")).alias("codes"), F.sum("n").alias("observed"),
        F.min("first").alias("first"), F.max("by_fix").alias("by_fix"),
    )
    start = F.when(F.col("first.source") == "ai_fix", 0.7).otherwise(0.5)
    return grouped.select(
        "repo", "function", "codes", "observed",
        F.round(F.least(F.lit(1.0), start + 0.1 * (F.col("observed") - 1)), 10).alias("confidence"),
        F.when(F.col("by_fix") == 1, "ai_fix").otherwise("user_fp").alias("source"),
    )


def usage_rollup(actions: DataFrame) -> DataFrame:
    """Counters per rule and the languages it ran on; no paths and no text."""
    stats = rule_stats(actions).select("code", "detections", "fps", "fixed", "ignored", "verified", "fix_failed")
    langs = actions.groupBy("code", "language").agg(F.lit(1).alias("x")).groupBy("code").agg(
        F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages")
    )
    return stats.join(langs, "code").withColumn("fix_success", fix_success())


def learning_table(actions: DataFrame, sort: str = "detections", ascending: bool = False) -> DataFrame:
    stats = rule_stats(actions)
    shown = stats.select(
        "code", "detections", fp_rate().alias("fp_rate"), effectiveness().alias("effectiveness"),
        fix_success().alias("fix_success"), "fixed", "ignored", "fps", "verified", "fix_failed",
    )
    key = F.col(sort)
    return shown.orderBy(key.asc() if ascending else key.desc(), "code")
