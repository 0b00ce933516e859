"""URL admission, robots rules, audits, politeness and capture choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import text as T
from marketloom.functions.prices import row_id
from marketloom.operators import skew

# ---- fixed values ----
MIN_CRAWL_DELAY = 2.5
MAX_WAIT_SECONDS = 5.0
LOCAL_NAMES = ("localhost", "::1", "[::1]")
PRIVATE_HOST = r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
APPROVED = "APPROVED"
BLOCKED = "BLOCKED_BY_ROBOTS"
TIER_RANKS = {"httpx": 1, "curl_cffi": 2, "playwright": 3}
# ---- end of fixed values ----

NOT_HTTPS = "REJECTED_SCHEME"
PRIVATE = "REJECTED_PRIVATE_ADDRESS"
NO_HOST = "REJECTED_HOST"


def is_https(url: Column) -> Column:
    return F.coalesce(T.url_scheme(url) == "https", F.lit(False))


def is_private_host(host: Column) -> Column:
    return host.isin(*LOCAL_NAMES) | host.rlike(PRIVATE_HOST)


def admit(urls: DataFrame) -> DataFrame:
    """Add ``host`` and ``verdict`` (APPROVED or the reason of refusal) to each ``url``."""
    verdict = (
        F.when(~is_https(F.col("url")), NOT_HTTPS)
        .when(F.col("host").isNull(), NO_HOST)
        .when(F.coalesce(is_private_host(F.col("host")), F.lit(False)), PRIVATE)
        .otherwise(APPROVED)
    )
    return urls.withColumn("host", T.url_host(F.col("url"))).withColumn("verdict", verdict)


def robots_rules(robots: DataFrame) -> DataFrame:
    """Robots files (``host, robots_txt``) to rule rows ``host, agent, kind, value, line_no``.

    Neighbouring user-agent lines share the rules below them. A host has one
    file, so the windows below see the lines of one file only.
    """
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = (
        robots.select("host", F.posexplode(F.split("robots_txt", r"\r?\n")).alias("line_no", "raw"))
        .withColumn("kind", F.lower(F.trim(F.regexp_extract(line, r"^([^:]+):", 1))))
        .withColumn("value", F.trim(F.regexp_extract(line, r"^[^:]+:(.*)$", 1)))
        .filter(F.col("kind").isin("user-agent", "allow", "disallow", "crawl-delay"))
        .withColumn("is_agent", F.col("kind") == "user-agent")
    )
    order = Window.partitionBy("host").orderBy("line_no")
    opens = F.col("is_agent") & ~F.coalesce(F.lag("is_agent").over(order), F.lit(False))
    blocks = lines.withColumn("opens", opens.cast("int")).withColumn(
        "block", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    agents = blocks.filter("is_agent").select("host", "block", F.lower("value").alias("agent"))
    rules = blocks.filter("NOT is_agent").select("host", "block", "kind", "value", "line_no")
    return rules.join(agents, ["host", "block"]).select(
        "host", "agent", "kind", "value", F.col("line_no").cast("int").alias("line_no"), F.col("block").cast("int")
    )


def host_policy(rules: DataFrame, user_agent: str) -> DataFrame:
    """One row per host: ordered path rules and delay, for this agent and for ``*``.

    The arrays hold the lines of one robots file each.
    """
    token = user_agent.split("/")[0].lower()
    named = (F.col("agent") != "*") & F.contains(F.lit(token), F.col("agent"))
    own = rules.filter(named | (F.col("agent") == "*")).withColumn("named", named)
    first_block = F.min(F.when(F.col("named"), F.col("block"))).over(Window.partitionBy("host"))
    own = own.withColumn("own_block", first_block)
    mine = F.when(F.col("own_block").isNull(), F.col("agent") == "*").otherwise(
        F.col("block") == F.col("own_block")
    )
    star = F.col("agent") == "*"
    is_path = F.col("kind").isin("allow", "disallow")
    rule = F.struct(
        "line_no",
        F.col("value").alias("path"),
        ((F.col("kind") == "allow") | (F.col("value") == "")).alias("allow"),
    )
    delay = F.struct("line_no", F.col("value").try_cast("double").alias("delay"))
    is_delay = F.col("kind") == "crawl-delay"
    return own.groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(is_path & mine, rule))).alias("own_rules"),
        F.sort_array(F.collect_list(F.when(is_path & star, rule))).alias("star_rules"),
        F.max(F.when(is_delay & mine, delay))["delay"].alias("own_delay"),
        F.max(F.when(is_delay & star, delay))["delay"].alias("star_delay"),
    )


def _permits(rules: Column, path: Column) -> Column:
    hits = F.filter(rules, lambda r: F.startswith(path, r["path"]))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["allow"], F.lit(True))


def apply_robots(admitted: DataFrame, policy: DataFrame, min_delay: float = MIN_CRAWL_DELAY) -> DataFrame:
    """Add ``robots_allowed`` and ``crawl_delay``; a host without a file allows everything.

    The policy side has one row per host, so a host with very many URLs is
    split by the adaptive skew join.
    """
    path = T.url_path(F.col("url"))
    allowed = _permits(F.col("own_rules"), path) | _permits(F.col("star_rules"), path)
    own = F.when(F.col("own_delay") > 0, F.col("own_delay"))
    delay = F.coalesce(own, F.col("star_delay"), F.lit(0.0))
    return (
        skew.join(admitted, policy, ["host"])
        .withColumn("robots_allowed", F.when(F.col("own_rules").isNull(), True).otherwise(allowed))
        .withColumn("crawl_delay", F.greatest(F.lit(float(min_delay)), delay))
        .drop("own_rules", "star_rules", "own_delay", "star_delay")
    )


def audits(checked: DataFrame, run_id: str, agent_version: str = "guard/1") -> DataFrame:
    """One audit row per URL, refused and blocked ones included."""
    status = (
        F.when(F.col("verdict") != APPROVED, F.col("verdict"))
        .when(~F.col("robots_allowed"), BLOCKED)
        .otherwise(APPROVED)
    )
    return checked.select(
        row_id("audit_", F.col("url"), F.lit(run_id)).alias("audit_id"),
        F.lit(run_id).alias("pipeline_id"),
        F.col("url").alias("source_url"),
        (F.col("verdict") == APPROVED).alias("robots_checked"),
        F.col("robots_allowed"),
        F.col("crawl_delay").alias("crawl_delay_applied_seconds"),
        *([F.col("pii_scrubbed_count")] if "pii_scrubbed_count" in checked.columns else []),
        status.alias("compliance_status"),
        F.lit(agent_version).alias("agent_version"),
    )


def audit_summary(audit_rows: DataFrame) -> DataFrame:
    """Audits and masked entities by status, with each status' share of all audits."""
    by_status = audit_rows.groupBy("compliance_status").agg(
        F.count(F.lit(1)).alias("audits"),
        F.sum("pii_scrubbed_count").cast("bigint").alias("pii_total"),
    )
    # a handful of statuses: the window runs over those rows, not over the audits
    share = F.col("audits") / F.sum("audits").over(Window.partitionBy(F.lit(1)))
    return by_status.withColumn("share", F.round(share, 6))


def politeness_schedule(checked: DataFrame) -> DataFrame:
    """Earliest start of each fetch in seconds after the first one on its host; URLs are visited in hash order."""
    order = ["url_hash", "url"]
    sliced = skew.range_slices(checked.withColumn("url_hash", F.md5("url")), ["host"], order, "range")
    wait = F.least(F.col("crawl_delay"), F.lit(MAX_WAIT_SECONDS))
    return skew.prefix(sliced, ["host"], order, "range", wait, "start_seconds").drop("range")


def best_capture(captures: DataFrame, key: str = "page_id") -> DataFrame:
    """First success from the preferred fetch tier upwards; keys without one are kept with nulls.

    ``captures``: key, tier_rank, preferred_rank, status_code, content.
    Success is a status below 400 and, below tier 3, content that is not thin.
    """
    good = (
        (F.col("tier_rank") >= F.col("preferred_rank"))
        & (F.col("status_code") < 400)
        & (~T.is_thin(F.col("content")) | (F.col("tier_rank") == TIER_RANKS["playwright"]))
    )
    pick = F.min_by(
        F.when(good, F.struct("tier_rank", "status_code", "content")), F.when(good, F.col("tier_rank"))
    )
    return captures.groupBy(key).agg(pick.alias("best")).select(key, "best.*")


def fetch_outcomes(checked: DataFrame, best: DataFrame, key: str = "page_id") -> DataFrame:
    """OK, SKIPPED (refused or blocked) or ERROR (no tier succeeded) for every source."""
    refused = (F.col("verdict") != APPROVED) | ~F.col("robots_allowed")
    status = F.when(refused, "SKIPPED").when(F.col("tier_rank").isNull(), "ERROR").otherwise("OK")
    return checked.join(best.select(key, "tier_rank"), key, "left").withColumn("outcome", status)
