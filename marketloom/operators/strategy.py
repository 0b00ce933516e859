"""Recommendations, corroborated trends and battlecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import prices as P
from marketloom.functions import text as T
from marketloom.operators import skew, substrings
from marketloom.operators.deltas import fallback

# ---- fixed values ----
MIN_SOURCES = 2
LONG_CONTEXT = 128_000
ADVANTAGES = 3
DROP = "PRICE_DECREASE"
SINGLE_SOURCE = "[Single-Source] "
NO_DATA = "No competitor data available for analysis."
QUIET = "No significant pricing changes detected since last analysis. "
MACRO_DROP_TITLE = "Multiple Competitors Reducing Prices"
NEW_TIER_TITLE = "New Tier Launched by "
NEW_TIER_RATIONALE = " introduced a new tier: "
DROP_TREND_TITLE = "Market-Wide Token Price Deflation across {n} Competitors"
ISOLATED_TITLE = "Isolated Price Reduction"
ENTERPRISE_TREND_TITLE = "Shift Toward Gated Enterprise Pricing ({n} Providers)"
FEATURE_TREND_TITLE = "Prompt Caching Standardized across {n} Competitors"
EQUILIBRIUM_TITLE_HEAD = "Established Pricing Equilibrium among "
EQUILIBRIUM_TITLE_TAIL = " Tracked Competitors"
PRESENCE = "Active presence in "
OPTIONS = "Tier options: "
GATED_WEAKNESS = "Requires high volume for tiered discount scaling"
OPEN_WEAKNESS = "Limited enterprise SLA disclosures"
POSTURE = "Entry token pricing starts at "
SECOND_WEAKNESS = "Complex pricing matrix creates developer calculation friction"
COUNTER = ("Position against ", " on transparent pricing, faster time-to-first-token, and simplified billing.")
TALK_TRACK = ("When competing against ", ", emphasize pricing advantages and context window capabilities.")
MACRO_DROP_RATIONALE = (" price reductions detected across ", ". This signals an industry-wide margin compression trend.")
MACRO_DROP_STEP = (
    "Evaluate defensive pricing options. Consider introducing a competitive batch/volume discount tier to retain price-sensitive customers."
)
NEW_TIER_STEP = "Evaluate feature parity and positioning against this new offering."
DROP_TREND_RATIONALE = ("Independent downward price adjustments observed across ", ". Inference commodity pricing is compressing margins.")
DROP_TREND_STEP = "Pivot marketing from raw token cost to reliability, latency, and context-caching SLAs."
ISOLATED_DETAILS = " dropped pricing, but competitors have not matched this move yet."
ENTERPRISE_RATIONALE = (
    "Providers including ", " are steering high-throughput customers toward custom sales contracts and private clusters."
)
ENTERPRISE_STEP = "Introduce a transparent 'Contact Sales' tier with defined minimum commit gates."
FEATURE_RATIONALE = (
    "Prompt caching discounts (up to 50-90%) adopted by ", ". Failure to support caching puts developer retention at risk."
)
FEATURE_STEP = "Deploy prompt cache discount pricing on long-context models."
EQUILIBRIUM_RATIONALE = ("Analyzed pricing across ", ". No destabilizing price wars detected.")
EQUILIBRIUM_STEP = "Benchmark input/output token spreads against median tier rates."
ENTERPRISE_NAMES, EQUILIBRIUM_NAMES = 3, 4
# ---- end of fixed values ----

NAMES_SHOWN = 3
#: A sentence names this many companies and counts the others; all are rows.
NAMES_LISTED = 20


def _names(companies: DataFrame, shown: int, count_others: bool = True) -> Column:
    """The first names in order as one text, and how many more there are; a scalar over distinct ``company_name``."""
    some = companies.orderBy("company_name").limit(shown)
    text = F.array_join(F.array_sort(F.collect_list("company_name")), ", ")
    listed = some.agg(text).scalar()
    if not count_others:
        return listed
    more = companies.agg(F.count(F.lit(1))).scalar() - shown
    return F.concat(listed, F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def _around(pair: tuple[str, str], text: Column) -> Column:
    return F.concat(F.lit(pair[0]), text, F.lit(pair[1]))


def executive_lines(records: DataFrame, deltas: DataFrame) -> DataFrame:
    """The executive summary as rows: the counting sentence, then one row per company.

    The roster grows with the data, so it is never joined into one string.
    """
    roster = records.groupBy("company_name").agg(F.count(F.lit(1)).alias("n"))
    changes = deltas.agg(
        F.struct(
            F.count(F.lit(1)).alias("changes"),
            F.count_if(F.col("strategic_severity") == "CRITICAL").alias("critical"),
            F.count_if(F.col("strategic_severity") == "HIGH").alias("high"),
        )
    ).scalar()
    row = (
        roster.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("companies"))
        .withColumn("c", changes)
        .select("records", "companies", "c.*")
    )
    head = F.concat(
        F.lit("Analyzed "), F.col("records").cast("string"), F.lit(" competitor product(s) across "),
        F.col("companies").cast("string"), F.lit(" companies. "),
    )
    found = F.concat(
        F.lit("Detected "), F.col("changes").cast("string"), F.lit(" market changes ("),
        F.col("critical").cast("string"), F.lit(" critical, "), F.col("high").cast("string"), F.lit(" high severity). "),
    )
    quiet = F.lit(QUIET)
    sentence = F.when(
        F.col("companies") == 0, NO_DATA
    ).otherwise(F.concat(head, F.when(F.col("changes") > 0, found).otherwise(quiet)))
    return row.select(F.lit("summary").alias("kind"), sentence.alias("line")).unionByName(
        roster.select(F.lit("company").alias("kind"), F.col("company_name").alias("line"))
    )


def company_sources(records: DataFrame) -> DataFrame:
    """Distinct company and source url pairs."""
    return records.select("company_name", "source_url").distinct()


def _dropping(deltas: DataFrame) -> DataFrame:
    return deltas.filter(F.col("delta_type") == DROP).select(F.col("competitor_name").alias("company_name"))


def macro_price_drop_sources(records: DataFrame, deltas: DataFrame) -> DataFrame:
    """Every source of the companies with price drops, one row each."""
    return records.join(_dropping(deltas), "company_name", "left_semi").select(
        F.lit(MACRO_DROP_TITLE).alias("title"), "source_url"
    ).distinct()


def macro_price_drop(records: DataFrame, deltas: DataFrame, shown: int = 3) -> DataFrame:
    """One PRICING recommendation when at least two price drops occurred.

    ``drops`` counts drops, not companies. The first ``shown`` sources are listed and all are counted;
    ``macro_price_drop_sources`` has them as rows.
    """
    drops = _dropping(deltas)
    sources = macro_price_drop_sources(records, deltas)
    listed = sources.orderBy("source_url").limit(shown).agg(F.array_sort(F.collect_list("source_url")))
    per_company = drops.groupBy("company_name").agg(F.count(F.lit(1)).alias("n"))
    total = per_company.agg(F.sum("n").alias("drops"), F.count(F.lit(1)).alias("companies"))
    row = (
        total.filter(F.col("drops") >= MIN_SOURCES)
        .withColumn("corroborating_sources", listed.scalar())
        .withColumn("corroboration_count", sources.agg(F.count(F.lit(1))).scalar())
    )
    rationale = F.concat(F.col("drops").cast("string"), _around(MACRO_DROP_RATIONALE, _names(per_company.select("company_name"), NAMES_LISTED)))
    return row.select(
        F.lit("PRICING").alias("category"),
        F.lit(MACRO_DROP_TITLE).alias("title"),
        rationale.alias("rationale"),
        F.lit(MACRO_DROP_STEP).alias("actionable_next_step"),
        "drops", "companies", "corroborating_sources", "corroboration_count",
    )


def new_tier_sources(records: DataFrame, deltas: DataFrame) -> DataFrame:
    """Every source behind each new-tier recommendation, one row each."""
    advised = new_tier_recommendations(records, deltas).select("company_name", "title", "rationale")
    return advised.join(company_sources(records), "company_name").select("title", "rationale", "source_url")


def new_tier_recommendations(records: DataFrame, deltas: DataFrame) -> DataFrame:
    """One PRODUCT_ROADMAP recommendation per new tier, with up to two sources; ``new_tier_sources`` has all.

    Sources are gathered per company, so both sides of the join are small per key.
    """
    sources = (
        skew.top_n(
            company_sources(records).withColumn("n", F.lit(1)), ["company_name"], [F.col("source_url")], 2
        )
        .groupBy("company_name")
        .agg(F.array_sort(F.collect_list("source_url")).alias("corroborating_sources"))
    )
    counts = company_sources(records).groupBy("company_name").agg(F.count(F.lit(1)).alias("corroboration_count"))
    per_company = sources.join(counts, "company_name")
    tiers = deltas.filter(F.col("delta_type") == "NEW_TIER").withColumnRenamed("competitor_name", "company_name")
    return tiers.join(per_company, "company_name", "left").select(
        "company_name",
        F.lit("PRODUCT_ROADMAP").alias("category"),
        F.concat(F.lit(NEW_TIER_TITLE), F.col("company_name")).alias("title"),
        F.concat(F.col("company_name"), F.lit(NEW_TIER_RATIONALE), F.col("new_value"), F.lit(".")).alias("rationale"),
        F.lit(NEW_TIER_STEP).alias("actionable_next_step"),
        "corroborating_sources",
        F.coalesce("corroboration_count", F.lit(0)).cast("bigint").alias("corroboration_count"),
    )


def rule_based(records: DataFrame, deltas: DataFrame) -> DataFrame:
    """Recommendations from the changes alone, with the sources shown: the macro price drop and every new tier."""
    columns = ["category", "title", "rationale", "actionable_next_step", "corroborating_sources", "corroboration_count"]
    return macro_price_drop(records, deltas).select(*columns).unionByName(new_tier_recommendations(records, deltas).select(*columns))


def _trend(companies: DataFrame, category: str, title: str, rationale: tuple[str, str], step: str, named: int | None = None) -> DataFrame:
    """A macro trend, one row per corroborating company, when enough distinct companies agree.

    The rationale names the first ``named`` companies, or ``NAMES_LISTED`` and how many more there are.
    """
    n = companies.agg(F.count(F.lit(1))).scalar()
    names = _names(companies, NAMES_LISTED) if named is None else _names(companies, named, count_others=False)
    return (
        companies.withColumn("corroboration_count", n)
        .filter(F.col("corroboration_count") >= MIN_SOURCES)
        .select(
            F.lit("macro").alias("scope"),
            F.lit(category).alias("category"),
            F.replace(F.lit(title), F.lit("{n}"), F.col("corroboration_count").cast("string")).alias("title"),
            _around(rationale, names).alias("rationale"),
            F.lit(step).alias("actionable_next_step"),
            F.col("company_name").alias("source"),
            "corroboration_count",
        )
    )


def price_drop_signal(deltas: DataFrame) -> DataFrame:
    """PRICING_COMPRESSION when two or more companies cut prices, an isolated move when one did."""
    companies = (
        deltas.filter(F.contains("delta_type", F.lit("DECREASE")) & F.col("competitor_name").isNotNull())
        .select(F.col("competitor_name").alias("company_name"))
        .distinct()
    )
    macro = _trend(companies, "PRICING_COMPRESSION", DROP_TREND_TITLE, DROP_TREND_RATIONALE, DROP_TREND_STEP)
    lone = companies.agg(F.count(F.lit(1)).alias("corroboration_count"), F.min("company_name").alias("source")).filter(
        F.col("corroboration_count") == 1
    )
    return macro.unionByName(
        lone.select(
            F.lit("isolated").alias("scope"),
            F.lit("PRICING").alias("category"),
            F.lit(ISOLATED_TITLE).alias("title"),
            F.concat("source", F.lit(ISOLATED_DETAILS)).alias("rationale"),
            F.lit(None).cast("string").alias("actionable_next_step"),
            "source",
            "corroboration_count",
        )
    )


def enterprise_signal(records: DataFrame) -> DataFrame:
    companies = records.filter("enterprise_terms_mentioned").select("company_name").distinct()
    return _trend(companies, "ENTERPRISE_GATING", ENTERPRISE_TREND_TITLE, ENTERPRISE_RATIONALE, ENTERPRISE_STEP, ENTERPRISE_NAMES)


def feature_signal(records: DataFrame, word: str = "cache") -> DataFrame:
    """Companies that name the feature in a tier or in their rate limits, given any tier."""
    tier_hit = F.exists("pricing_tiers", lambda t: F.contains(F.lower(t["model_or_tier_name"]), F.lit(word)))
    limit_hit = F.contains(F.lower("rate_limits_summary"), F.lit(word)) & (F.size("pricing_tiers") > 0)
    companies = (
        records.filter(F.coalesce(tier_hit, F.lit(False)) | F.coalesce(limit_hit, F.lit(False)))
        .select("company_name")
        .distinct()
    )
    return _trend(companies, "FEATURE_PARITY", FEATURE_TREND_TITLE, FEATURE_RATIONALE, FEATURE_STEP)


def with_equilibrium(trends: DataFrame, records: DataFrame) -> DataFrame:
    """The trends, with POSITIONING rows for the first two companies when none is a macro trend; isolated moves stay beside either."""
    n = records.agg(F.count(F.lit(1))).scalar()
    companies = records.select("company_name").distinct()
    first = companies.orderBy("company_name").limit(MIN_SOURCES)
    names = _names(companies, EQUILIBRIUM_NAMES, count_others=False)
    spare = (
        first.withColumn("n", n)
        .filter(F.col("n") >= MIN_SOURCES)
        .select(
            F.lit("macro").alias("scope"),
            F.lit("POSITIONING").alias("category"),
            F.concat(
                F.lit(EQUILIBRIUM_TITLE_HEAD), F.col("n").cast("string"),
                F.lit(EQUILIBRIUM_TITLE_TAIL),
            ).alias("title"),
            _around(EQUILIBRIUM_RATIONALE, names).alias("rationale"),
            F.lit(EQUILIBRIUM_STEP).alias("actionable_next_step"),
            F.col("company_name").alias("source"),
            F.lit(MIN_SOURCES).cast("bigint").alias("corroboration_count"),
        )
    )
    macro = F.col("scope") == "macro"
    return fallback(trends.filter(macro), spare).unionByName(trends.filter(~macro))


def cited_in_known(cited: DataFrame, known: DataFrame, gram: int = 8) -> DataFrame:
    """Distinct ``source`` strings that are a substring of some known ``url``.

    Strings present verbatim are settled by an equi-join. The rest meet the
    urls on one gram each, the one the fewest urls contain, and are then
    checked verbatim; a string with a gram no url has is settled at once.
    Strings shorter than a gram are compared with all url pieces of their length.
    """
    sources = cited.select("source").distinct()
    urls = known.select("url").distinct()
    exact = sources.join(urls, sources["source"] == urls["url"], "left_semi")
    rest = sources.join(urls, sources["source"] == urls["url"], "left_anti")

    def grams(col: str, size) -> Column:
        starts = F.sequence(F.lit(1), F.length(col) - size + 1)
        return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(col), i, size)))

    long_enough = F.length("source") >= gram
    url_grams = urls.filter(F.length("url") >= gram).select(
        "url", F.explode(grams("url", F.lit(gram))).alias("gram")
    )
    frequency = url_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("urls"))
    needle_grams = rest.filter(long_enough).select("source", F.explode(grams("source", F.lit(gram))).alias("gram"))
    rarest = (
        needle_grams.join(frequency, "gram", "left")
        .groupBy("source")
        .agg(F.min_by("gram", F.coalesce("urls", F.lit(0))).alias("gram"))
    )
    found = (
        url_grams.join(rarest, "gram").filter(F.contains("url", F.col("source"))).select("source").distinct()
    )
    short = rest.filter(~long_enough).withColumn("size", F.length("source"))
    pieces = urls.select("url", F.explode(F.sequence(F.lit(1), F.lit(gram - 1))).alias("size")).filter(
        F.length("url") >= F.col("size")
    )
    pieces = pieces.select(F.explode(grams("url", F.col("size"))).alias("piece")).distinct()
    brief = short.join(pieces, short["source"] == pieces["piece"], "left_semi").select("source")
    return exact.unionByName(found).unionByName(brief)


def enforce_corroboration(claims: DataFrame, known: DataFrame, minimum: int = MIN_SOURCES) -> DataFrame:
    """Keep claims by their distinct known sources: enough keep, one is marked, none drop.

    ``claims``: rec_id, title, source (one row per cited source). Comes out with one row per source that held,
    each with the claim's ``corroboration_count``.
    """
    valid = cited_in_known(claims, known)
    kept = skew.join(claims, valid, ["source"], "left_semi").select("rec_id", "title", "source").distinct()
    counted = kept.groupBy("rec_id", "title").agg(F.count(F.lit(1)).alias("corroboration_count"))
    n = F.col("corroboration_count")
    shown = F.when(n >= minimum, F.col("title")).otherwise(F.concat(F.lit(SINGLE_SOURCE), F.col("title")))
    held = counted.filter((n >= minimum) | (n == 1))
    return skew.join(kept, held, ["rec_id", "title"], "inner").select(
        "rec_id", shown.alias("title"), "source", "corroboration_count"
    )


def synthesis_prompts(records: DataFrame, deltas: DataFrame, date: str, template: str, changes: int = 100) -> DataFrame:
    """Prompts (company_name, part, prompt) of a company's record and its changes, ``changes`` of them in a part.

    A company's tiers are one record, its changes may be any number, so they are numbered and cut. A company without
    changes has one part with none.
    """
    body = ["metric_name", "delta_type", "old_value", "new_value"]
    rows = deltas.select(F.col("competitor_name").alias("company_name"), *body)
    numbered = skew.numbered(rows, ["company_name"], body, "__n")
    part = F.floor((F.col("__n") - 1) / changes).cast("bigint").alias("part")
    parts = numbered.groupBy("company_name", part).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("__n", *body))), lambda c: F.struct(*[c[b] for b in body]))).alias("deltas")
    )
    told = records.select("company_name", F.to_json(F.struct("company_name", "product_name", "pricing_tiers")).alias("records"))
    prompt = T.render(template, current_date=F.lit(date), deltas=F.coalesce("deltas", F.lit("[]")), records=F.col("records"))
    return skew.join(told, parts, ["company_name"]).select("company_name", F.coalesce("part", F.lit(0)).alias("part"), prompt.alias("prompt"))


def battlecards(records: DataFrame) -> DataFrame:
    """Strengths, vulnerabilities, entry price and posture, counter strategy per record; argmin over the tiers inside the row."""
    priced = F.filter("pricing_tiers", lambda t: t["input_price_per_m_tokens"].isNotNull())
    cheapest = F.array_min(
        F.transform(priced, lambda t: F.struct(t["input_price_per_m_tokens"].alias("price"), t["model_or_tier_name"].alias("tier")))
    )
    names = F.transform(F.slice("pricing_tiers", 1, NAMES_SHOWN), lambda t: t["model_or_tier_name"])
    options = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("Standard")
    shown = F.filter(F.array("company_name"), lambda c: (c != "") & (c != "Unknown"))
    return (
        records.filter(F.size(shown) == 1)
        .withColumn("cheapest", cheapest)
        .select(
            F.col("company_name").alias("competitor"),
            F.concat(F.lit(PRESENCE), F.col("product_name")).alias("strength_presence"),
            F.concat(F.lit(OPTIONS), options).alias("strength_tiers"),
            F.when(F.col("enterprise_terms_mentioned"), GATED_WEAKNESS)
            .otherwise(OPEN_WEAKNESS)
            .alias("vulnerability"),
            F.lit(SECOND_WEAKNESS).alias("second_vulnerability"),
            F.concat(
                F.lit(POSTURE), T.money(F.col("cheapest.price"), "/1M", absent="Custom")
            ).alias("pricing_posture"),
            F.col("cheapest.tier").alias("cheapest_tier"),
            _around(COUNTER, F.col("company_name")).alias("counter_strategy"),
        )
    )


def price_advantages(offers: DataFrame, k: int = ADVANTAGES) -> DataFrame:
    """The ``k`` largest advantages of each company's tiers over dearer tiers of other companies.

    The largest percentages lie between a company's k cheapest tiers and the k
    dearest foreign tiers. No company can hold more than k of the 2k dearest
    tiers when each lists only its k dearest, so 2k tiers, one short array,
    serve every company exactly.
    """
    priced = offers.filter(F.col("input_price").isNotNull()).select("company_name", "tier_name", "input_price")
    by_name = [F.col("company_name"), F.col("tier_name")]
    dearest_own = skew.top_n(priced, ["company_name"], [F.col("input_price").desc(), F.col("tier_name")], k)
    dearest = dearest_own.orderBy(F.col("input_price").desc(), *by_name).limit(2 * k)
    ceiling = dearest.agg(
        F.collect_list(
            F.struct(F.col("company_name").alias("company"), F.col("tier_name").alias("tier"), F.col("input_price").alias("price"))
        ).alias("tiers")
    )
    cheapest = skew.top_n(priced, ["company_name"], [F.col("input_price"), F.col("tier_name")], k).drop("rank")
    rows = cheapest.withColumn("ceiling", ceiling.scalar())
    dearer = F.filter(
        "ceiling", lambda c: (c["company"] != F.col("company_name")) & (c["price"] > F.col("input_price"))
    )
    pairs = rows.select("company_name", "tier_name", "input_price", F.explode(dearer).alias("o"))
    pct = (F.col("o.price") - F.col("input_price")) / F.col("o.price") * 100
    scored = pairs.select(
        "company_name", "tier_name", F.col("o.company").alias("other_company"), F.col("o.tier").alias("other_tier"),
        pct.alias("pct_cheaper"),
    )
    order = [F.col("pct_cheaper").desc(), F.col("tier_name"), F.col("other_company"), F.col("other_tier")]
    return skew.top_n(scored, ["company_name"], order, k)


def advantage_lines(offers: DataFrame, k: int = ADVANTAGES) -> DataFrame:
    """Up to ``k`` lines per company: price advantages first, then long-context tiers."""
    cheaper = price_advantages(offers, k).select(
        "company_name",
        F.lit(0).alias("kind"),
        F.col("rank").cast("bigint").alias("pos"),
        F.concat(
            F.col("tier_name"), F.lit(" input pricing is "), F.col("pct_cheaper").cast("decimal(18,0)").cast("string"),
            F.lit("% cheaper than "), F.col("other_company"), F.lit("'s "), F.col("other_tier"),
        ).alias("line"),
    )
    wide = skew.top_n(
        offers.filter(F.col("context_tokens") >= LONG_CONTEXT).select("company_name", "tier_name", "context_tokens"),
        ["company_name"],
        [F.col("context_tokens").desc(), F.col("tier_name")],
        k,
    ).select(
        "company_name",
        F.lit(1).alias("kind"),
        F.col("rank").cast("bigint").alias("pos"),
        F.concat(
            F.col("tier_name"), F.lit(" supports "), F.format_number("context_tokens", 0), F.lit(" token context window")
        ).alias("line"),
    )
    lines = skew.top_n(cheaper.unionByName(wide), ["company_name"], [F.col("kind"), F.col("pos")], k)
    return lines.select("company_name", F.col("rank").cast("bigint").alias("line_no"), "line")


def cards(offers: DataFrame, k: int = ADVANTAGES) -> DataFrame:
    """Battlecards keyed by competitor: (competitor, part, line_no, line), when there are two companies or more.

    Parts are ``our_advantages``, up to ``k`` lines, and ``recommended_talk_track``.
    """
    companies = offers.select("company_name").distinct()
    track = companies.select(
        F.col("company_name").alias("competitor"), F.lit("recommended_talk_track").alias("part"),
        F.lit(1).cast("bigint").alias("line_no"), _around(TALK_TRACK, F.col("company_name")).alias("line"),
    )
    won = advantage_lines(offers, k).select(
        F.col("company_name").alias("competitor"), F.lit("our_advantages").alias("part"), "line_no", "line"
    )
    enough = companies.limit(2).agg(F.count(F.lit(1))).scalar() >= 2
    return won.unionByName(track).withColumn("__enough", enough).filter("__enough").drop("__enough")


def match_profiles(records: DataFrame, profiles: list[str], name: str, position: str) -> DataFrame:
    """For each profile word the first record whose name contains it, ignoring case; null if none.

    The words are a short list in the code, so they travel inside the plan.
    """
    spark = records.sparkSession
    words = F.array(*[F.lit(p) for p in profiles])
    hits = records.select(
        F.explode(F.filter(words, lambda w: F.contains(F.lower(name), F.lower(w)))).alias("profile"),
        F.col(position), F.col(name),
    )
    first = hits.groupBy("profile").agg(
        F.min(position).alias(position), F.min_by(name, position).alias(name), F.count(F.lit(1)).alias("matches")
    )
    listed = spark.createDataFrame([(p,) for p in profiles], "profile string")
    return listed.join(first, "profile", "left")


def match_catalog(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``company_name`` to pages: the first entry whose name is in the host or url, or whose url is in the page's url.

    Pages: page_id, host, url. Catalog: company_name, source_url, position; the least position wins. Case is ignored; empty names
    and urls match nothing. Pages and catalog may be of any size: they meet by substrings' own keys.
    """
    entry = F.struct("position", "company_name")
    names = catalog.select(F.lower("company_name").alias("needle"), entry.alias("entry"), F.lit("n").alias("kind"))
    sources = catalog.select(F.lower("source_url").alias("needle"), entry.alias("entry"), F.lit("u").alias("kind"))
    # one look for names and urls; a name counts in hosts and urls, an address in urls only
    known = names.unionByName(sources).select(F.struct("entry", "kind").alias("needle_id"), "needle")
    needles = known.groupBy("needle", F.col("needle_id.kind").alias("kind")).agg(F.min("needle_id.entry").alias("entry"))
    needles = needles.select(F.concat("kind", "needle").alias("needle_id"), "needle", "entry")
    hosts = pages.select(F.lower("host").alias("text")).distinct().select(F.concat(F.lit("h"), "text").alias("hay_id"), "text")
    urls = pages.select(F.lower("url").alias("text")).distinct().select(F.concat(F.lit("u"), "text").alias("hay_id"), "text")
    pairs = substrings.containing(hosts.unionByName(urls), needles.select("needle_id", "needle"))
    valid = pairs.filter(~(F.startswith("needle_id", F.lit("u")) & F.startswith("hay_id", F.lit("h"))))
    best = (
        skew.join(valid, needles.select("needle_id", "entry"), ["needle_id"], "inner")
        .groupBy("hay_id").agg(F.min("entry").alias("entry"))
    )
    of_host = best.select(F.expr("substring(hay_id, 2)").alias("text"), F.col("entry").alias("e1")).filter(F.startswith("hay_id", F.lit("h")))
    of_url = best.select(F.expr("substring(hay_id, 2)").alias("text"), F.col("entry").alias("e2")).filter(F.startswith("hay_id", F.lit("u")))
    keyed = pages.withColumn("__host", F.struct(F.lower("host").alias("t"))).withColumn("__url", F.struct(F.lower("url").alias("t")))
    joined = keyed.join(of_host.select(F.struct(F.col("text").alias("t")).alias("__host"), "e1"), "__host", "left").join(
        of_url.select(F.struct(F.col("text").alias("t")).alias("__url"), "e2"), "__url", "left"
    )
    return joined.withColumn("company_name", F.least("e1", "e2")["company_name"]).select(*pages.columns, "company_name")
