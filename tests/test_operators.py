import math
import random
import urllib.robotparser

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.operators import (
    admission, deltas, evaluation, extraction, grounding, matrix, reports, strategy, training, vectors,
)
from marketloom.session import scratch_path
from marketloom.sources import sinks

TIER_SCHEMA = f"company_name string, product_name string, source_url string, pricing_tiers array<{schemas.TIER}>, " \
    "enterprise_terms_mentioned boolean, rate_limits_summary string, extraction_confidence double, citation_text string, source_text string"


def tier(name, low=None, high=None, context=None):
    return (name, low, high, None, context, None, None, None, "USD", [])


def record(company, tiers, text="", citation="", confidence=0.9, enterprise=False, limits=None):
    url = f"https://{company.lower()}.example.com/pricing"
    return (company, "API", url, tiers, enterprise, limits, confidence, citation, text)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), TIER_SCHEMA)


PAGE = "Acme pricing. Fast model costs $2.50 in and $10 out. Slow model costs $0.15."


def test_grounded_and_invented_records(spark):
    true = record("Acme", [tier("Fast", 2.5, 10.0)], PAGE, "Acme pricing. Fast model costs something")
    false = record("Bogus", [tier("Ultra", 77.0, 99.5)], PAGE, "no such words here")
    good, bad = grounding.ground(frame(spark, true, false)).collect()
    assert good["grounding_ratio"] == 1.0 and good["ungrounded_fields"] == []
    assert bad["grounding_ratio"] == 0.0
    assert bad["ungrounded_fields"] == [
        "company_name:Bogus", "tier_name:Ultra", "price:77.00", "price:99.50", "citation_text_mismatch",
    ]


def test_grounding_edges(spark):
    empty, unknown = grounding.ground(
        frame(spark, record("Acme", [], ""), record("Unknown", [], PAGE))
    ).collect()
    assert (empty["grounding_ratio"], empty["ungrounded_fields"]) == (0.0, ["source_text_empty"])
    assert unknown["grounding_ratio"] == 0.5


def test_confidence(spark):
    rows = frame(
        spark,
        record("Acme", [tier("Fast", 2.5, 10.0)], PAGE, "Acme pricing. Fast model"),
        record("Bogus", [tier("Ultra", 77.0, 99.5)], PAGE, "totally absent phrase"),
        ("", "", "", [], None, None, 0.0, "", PAGE),
    )
    good, bad, empty = grounding.validate(rows).collect()
    assert good["extraction_confidence"] == 1.0 and good["is_valid"]
    assert bad["extraction_confidence"] == 0.4 and not bad["is_valid"]
    assert 0 <= empty["extraction_confidence"] <= 1


def test_sanity_and_completeness(spark):
    rows = frame(spark, record("A", [tier("x", -1.0, 5.0)]), record("B", []), record("C", [tier("x", 100.0, 1.0)]))
    got = [r[0] for r in rows.select(grounding.sanity()).collect()]
    assert got[0] == pytest.approx(1 - 1.5 / 3) or got[0] < 1
    assert got[1] == 1.0
    assert got[2] == pytest.approx(1 - 0.5 / 3)
    assert rows.select(grounding.completeness()).first()[0] == pytest.approx(7 / 8)


def test_sanitize(spark):
    rows = frame(spark, record("A", [tier("  ", -2.0, 3.0, 128000), tier(" x ", 1.0)]))
    a, b = rows.select(grounding.sanitize_tiers(F.col("pricing_tiers"))).first()[0]
    assert a["model_or_tier_name"] == "" or a["model_or_tier_name"] == "Standard Tier"
    assert a["input_price_per_m_tokens"] is None and a["context_window_tokens"] == 128000
    assert b["model_or_tier_name"] == "x"


def offers(spark, *rows):
    return spark.createDataFrame(
        [(c, "API", f"https://{c}.example.com", t, i, o, n) for c, t, i, o, n in rows],
        "company_name string, product_name string, source_url string, tier_name string, input_price double, output_price double, context_tokens bigint",
    )


def test_tier_diff(spark):
    old = offers(spark, ("a", "x", 10.0, 20.0, 1), ("a", "gone", 1.0, 1.0, 1), ("a", "same", 1.0, 1.0, 1), ("lost", "x", 1.0, 1.0, 1), ("z", "x", 0.0, None, 1))
    new = offers(spark, ("a", "x", 5.0, 22.0, 1), ("a", "new", 1.0, 1.0, 1), ("a", "same", 1.0, 1.0, 1), ("fresh", "x", 1.0, 1.0, 1), ("z", "x", 2.0, 3.0, 1))
    rows = {r["metric_name"]: r for r in deltas.tier_diff(old, new).filter("competitor_name = 'a'").collect()}
    assert set(rows) == {"x_input_price", "x_output_price", "gone", "new"}
    drop = rows["x_input_price"]
    assert (drop["delta_type"], drop["old_value"], drop["new_value"]) == ("PRICE_DECREASE", "$10.00/1M", "$5.00/1M")
    assert (drop["percentage_change"], drop["strategic_severity"]) == (-50.0, "CRITICAL")
    assert rows["x_output_price"]["strategic_severity"] == "MEDIUM"
    assert (rows["gone"]["delta_type"], rows["gone"]["new_value"]) == ("TIER_REMOVED", "REMOVED")
    assert (rows["new"]["delta_type"], rows["new"]["new_value"], rows["new"]["old_value"]) == ("NEW_TIER", "NEW: new", None)
    rest = deltas.tier_diff(old, new).filter("competitor_name <> 'a'").collect()
    assert [(r["competitor_name"], r["percentage_change"], r["strategic_severity"]) for r in rest] == [("z", None, "CRITICAL")]
    assert deltas.tier_diff(old, old).count() == 0


def drops(spark, *companies):
    return spark.createDataFrame([(c, "PRICE_DECREASE", "x", None, "y", "HIGH") for c in companies],
                                 "competitor_name string, delta_type string, metric_name string, old_value string, new_value string, strategic_severity string")


def test_trend_and_isolated_move(spark):
    two = strategy.price_drop_signal(drops(spark, "a", "b", "b")).collect()
    assert {r["scope"] for r in two} == {"macro"} and {r["source"] for r in two} == {"a", "b"}
    assert {r["corroboration_count"] for r in two} == {2}
    one = strategy.price_drop_signal(drops(spark, "a", "a")).collect()
    assert [(r["scope"], r["source"]) for r in one] == [("isolated", "a")]
    assert strategy.price_drop_signal(drops(spark)).count() == 0


def test_battlecard(spark):
    rows = frame(spark, record("Acme", [tier("Big", 9.0), tier("Small", 1.0)], enterprise=True), record("Unknown", []), record("None", []))
    cards = {r["competitor"]: r for r in strategy.battlecards(rows).collect()}
    assert set(cards) == {"Acme", "None"}
    assert cards["Acme"]["pricing_posture"].endswith("$1.00/1M") and cards["Acme"]["cheapest_tier"] == "Small"
    assert cards["None"]["pricing_posture"].endswith("Custom") and cards["None"]["strength_tiers"].endswith("Standard")


def test_advantages_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"c{c}", f"t{t}", float(rng.randint(1, 40)), None, rng.choice([1000, 200000])) for c in range(6) for t in range(7)]
    got = {(r["company_name"], r["rank"]): round(r["pct_cheaper"], 9) for r in strategy.price_advantages(offers(spark, *rows)).collect()}
    expected = {}
    for company in {r[0] for r in rows}:
        pct = sorted(
            ((o[2] - m[2]) / o[2] * 100 for m in rows for o in rows if m[0] == company != o[0] and m[2] < o[2]), reverse=True
        )[:3]
        expected.update({(company, i + 1): round(p, 9) for i, p in enumerate(pct)})
    assert got == expected
    assert strategy.advantage_lines(offers(spark, *rows)).groupBy("company_name").count().filter("count > 3").count() == 0


def test_cited_in_known_equals_brute_force(spark):
    rng = random.Random(4)
    urls = ["https://" + "".join(rng.choice("ab.") for _ in range(14)) + "/pricing" for _ in range(60)]
    cited = urls[:3] + ["".join(rng.choice("ab./:") for _ in range(rng.randint(1, 10))) for _ in range(150)] + [u[4:19] for u in urls[:5]] + ["zz", "pricing"]
    got = strategy.cited_in_known(
        spark.createDataFrame([(c,) for c in cited], "source string"), spark.createDataFrame([(u,) for u in urls], "url string")
    )
    assert sorted(r[0] for r in got.collect()) == sorted({c for c in cited if any(c in u for u in urls)})


def test_snippet_join_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["ab", "b", "abc", "c", "a"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    got = grounding.snippet_in_documents(
        spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")
    )
    expected = {
        (i, d) for i, s in items for d, t in docs if s and (" ".join(s.split()[:4]) if len(s.split()) >= 3 else s) in t
    }
    assert {tuple(r) for r in got.collect()} == expected


def test_matched_tiers_equal_brute_force(spark):
    rng = random.Random(6)
    def side():
        return [(s, f"t{t}", rng.choice([None, round(rng.random(), 3)]), rng.choice([None, round(rng.random() / 5, 3)])) for s in "ab" for t in range(60)]
    gold, pred = side(), side()
    schema = "sample_id string, tier_name string, input_price double, output_price double"
    got = evaluation.matched_tiers(spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema), 0.05)
    def close(a, b):
        return a is None and b is None or (a is not None and b is not None and abs(a - b) <= 0.05)
    expected = {(p[0], p[1]) for p in pred if any(p[0] == g[0] and close(p[2], g[2]) and close(p[3], g[3]) for g in gold)}
    assert {tuple(r) for r in got.collect()} == expected


def test_perfect_prediction(spark):
    schema = "sample_id string, tier_name string, input_price double, output_price double"
    side = spark.createDataFrame([("a", "x", 1.0, 2.0)], schema)
    grounded = spark.createDataFrame([("a", 1.0, 0, True)], "sample_id string, grounding_ratio double, ungrounded_count int, schema_valid boolean")
    row = evaluation.metrics(evaluation.per_sample(side, side, grounded)).first()
    assert (row["matched_tiers"], row["tier_precision"], row["tier_recall"], row["tier_f1"]) == (1, 1.0, 1.0, 1.0)
    assert {r["status"] for r in evaluation.status_table(evaluation.metrics(evaluation.per_sample(side, side, grounded))).collect()} == {"PASSED"}
    none = evaluation.metrics(evaluation.per_sample(side.limit(0), side, grounded)).first()
    assert (none["tier_precision"], none["tier_recall"], none["hallucination_rate"]) == (1.0, 0.0, 0.0)


def test_admission(spark):
    urls = ["http://example.com/pricing", "https://127.0.0.1/admin", "https://10.0.0.5/secrets", "https://169.254.1.1/x", "https://Example.com/p", "not a url"]
    rows = admission.admit(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    got = {r["url"]: r["verdict"] for r in rows}
    assert got["https://Example.com/p"] == "APPROVED"
    assert [got[u] for u in urls[:4]] == ["REJECTED_SCHEME"] + ["REJECTED_PRIVATE_ADDRESS"] * 3
    assert got["not a url"] == "REJECTED_SCHEME"


ROBOTS = [
    "User-agent: *\nDisallow: /private\nAllow: /\nCrawl-delay: 4",
    "User-agent: other\nUser-agent: loombot\nAllow: /open\nDisallow: /\n\nUser-agent: *\nDisallow: /star",
    "# all open\nUser-agent: *\nDisallow:",
    "User-agent: loombot\nCrawl-delay: 9\nDisallow: /a # not here\n\nUser-agent: *\nDisallow: /b",
    "User-agent: *\nDisallow: /",
    "",
]


def test_robots_equal_the_standard_parser(spark):
    agent = "loombot/1.0"
    paths = ["/", "/private/x", "/open/1", "/star", "/a/b", "/b?q=1", "/other"]
    files = [(f"h{i}.example.com", t) for i, t in enumerate(ROBOTS)]
    urls = [(f"https://{h}{p}",) for h, _ in files for p in paths] + [("https://none.example.com/x",)]
    policy = admission.host_policy(admission.robots_rules(spark.createDataFrame(files, "host string, robots_txt string")), agent)
    rows = admission.apply_robots(admission.admit(spark.createDataFrame(urls, "url string")), policy).collect()
    assert len(rows) == len(urls)
    parsers = {}
    for host, text in files:
        parsers[host] = urllib.robotparser.RobotFileParser()
        parsers[host].parse(text.splitlines())
    for row in rows:
        parser = parsers.get(row["host"])
        allowed = parser is None or parser.can_fetch(agent, row["url"]) or parser.can_fetch("*", row["url"])
        delay = (parser.crawl_delay(agent) or parser.crawl_delay("*")) if parser else None
        assert row["robots_allowed"] == bool(allowed), row
        assert row["crawl_delay"] == max(2.5, delay or 0), row


def test_repair_passes(spark):
    def flaky():
        def answer(prompts: pd.Series, attempt: int) -> pd.Series:
            return prompts.map(lambda p: '{"ok": 1}' if "easy" in p or (attempt == 2 and "hard" in p) else "{broken")

        return answer

    pages = spark.createDataFrame([(1, "u1", "easy"), (2, "u2", "hard"), (3, "u3", "never")], "page_id int, url string, text string")
    rows = {r["page_id"]: (r["attempt"], r["payload"] is not None) for r in extraction.extract(pages, flaky, "page_id").collect()}
    assert rows == {1: (0, True), 2: (2, True), 3: (2, False)}


def test_model_price_list(spark):
    rows = [("openco/m1", "0.0000025", "0.00001", 1), ("noslash", "1", "1", 2), ("openco/m2/x", "0", None, 3)]
    rows += [(f"big/m{i}", "0.000001", "0.000001", 10 + i) for i in range(12)]
    models = spark.createDataFrame(rows, "id string, prompt string, completion string, pos int")
    got = extraction.model_price_list(models, "pos").orderBy("pos").collect()
    assert (got[0]["company_name"], got[0]["tier_name"], got[0]["input_price"], got[0]["output_price"]) == ("Openco", "m1", 2.5, 10.0)
    assert (got[1]["tier_name"], got[1]["input_price"], got[1]["output_price"]) == ("m2/x", None, None)
    assert [r["tier_no"] for r in got if r["company_name"] == "Big"] == list(range(1, 13))
    assert extraction.model_price_list(models, "pos", per_company=8).filter("company_name = 'Big'").count() == 8


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    copies = np.repeat(base[:1], 60, axis=0) + rng.standard_normal((60, 16)) * 0.01  # one hot cluster
    data = np.vstack([base, copies, base[:10], base[10:20] * 3, base[20:30] + rng.standard_normal((10, 16)) * 0.02])
    rows = [(i, "a" if i % 3 else "b", [float(x) for x in v]) for i, v in enumerate(data)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, company string, embedding array<float>"), 16)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    sims = unit @ unit.T
    expected = {
        i: any(sims[i, j] >= 0.995 and rows[i][1] == rows[j][1] for j in range(i)) for i in range(len(rows))
    }
    assert {r["vec_id"]: r["is_duplicate"] for r in got.collect()} == expected
    assert any(expected.values()) and not all(expected.values())


@pytest.mark.parametrize("crowded, levels", [(12, 3), (12, 0), (5, 1)])
def test_crowded_buckets_grow_and_are_tiled(spark, crowded, levels):
    """Few signs make large buckets of vectors that are near, but not near enough; a third of all lies in one direction."""
    rng = np.random.default_rng(4)
    head = rng.standard_normal(6)
    data = np.vstack([head + rng.standard_normal((120, 6)) * 0.08, rng.standard_normal((200, 6)), np.repeat(head[None], 30, axis=0) * rng.uniform(1, 2, (30, 1))])
    data = np.vstack([data, data[100:140] + rng.standard_normal((40, 6)) * 0.002])
    rows = [(i, None if i % 5 == 0 else "a", [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    frame = spark.createDataFrame(rows, "vec_id bigint, company string, embedding array<float>")
    got = vectors.near_duplicates(frame, 6, bits=3, crowded=crowded, deeper=4, levels=levels)
    unit = np.array([r[2] for r in rows]) / np.linalg.norm([r[2] for r in rows], axis=1, keepdims=True)
    sims = unit @ unit.T
    expected = {i: any(sims[i, j] >= 0.995 and rows[i][1] == rows[j][1] for j in range(i)) for i in range(len(rows))}
    assert {r["vec_id"]: r["is_duplicate"] for r in got.collect()} == expected
    assert 0.1 < sum(expected.values()) / len(expected) < 0.9


@pytest.mark.parametrize("threshold", [0.995, 0.9, 0.8])
def test_bands_follow_the_threshold(threshold):
    bands = vectors.bands_for(threshold, 14, 1e-9)
    rng = np.random.default_rng(2)
    a = rng.standard_normal((400, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.standard_normal(a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    keys = vectors._signs(16, bands, 14, [11])
    left = np.stack(keys(pd.Series(list(a))))
    right = np.stack(keys(pd.Series(list(threshold * a + np.sqrt(1 - threshold**2) * z))))
    assert (left == right).any(axis=1).all()
    with pytest.raises(ValueError):
        vectors.bands_for(0.5, 14, 1e-9)


def test_text_vectors():
    a, b = vectors.text_vector("x"), vectors.text_vector("y")
    assert np.array_equal(a, vectors.text_vector("x")) and not np.array_equal(a, b)
    assert np.linalg.norm(a) == pytest.approx(1, abs=1e-5)


def test_nearest_to(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])], "vec_id bigint, embedding array<float>")
    assert [r["vec_id"] for r in vectors.nearest_to(rows, [1.0, 0.0], 2).collect()] == [1, 3]


def test_no_records_summary(spark):
    empty = spark.createDataFrame([], "company_name string")
    lines = strategy.executive_lines(empty, drops(spark)).collect()
    assert [r["line"] for r in lines] == ["No competitor data available for analysis."]


def test_report_leaves_out_empty_sections(spark):
    rows = spark.createDataFrame([("k", "text")], "sort_key string, line string")
    sections = {reports.SUMMARY: rows, reports.CHANGES: rows.limit(0), reports.MATRIX: rows.limit(0)}
    lines = reports.report("r", "# T", sections, "now", "all", rows).collect()
    assert {r["section_no"] for r in lines} == {reports.HEAD, reports.SUMMARY, reports.MATRIX, reports.NOTE}
    assert reports.NO_MATRIX in {r["line"] for r in lines}


def test_samples(spark):
    pages = spark.createDataFrame([(1, " <p>x</p> ", "Acme"), (2, "", "Gone")], "sample_id int, dom string, company_name string")
    negatives = spark.createDataFrame([(3, "<p>terms</p>"), (4, "<p>jobs</p>")], "sample_id int, dom string")
    chats = training.chat_samples(training.all_samples(pages, negatives)).collect()
    assert len(chats) == 3 and all([m["role"] for m in r["messages"]] == ["system", "user", "assistant"] for r in chats)
    assert '"company_name":"Unknown"' in [r for r in chats if r["sample_id"] == 3][0]["messages"][2]["content"]


def test_long_conversation_is_cut_into_parts(spark):
    turns = spark.createDataFrame([(1, i, "user", str(i)) for i in range(25)], "conv_id int, turn int, role string, text string")
    parts = training.conversations(turns, turns_per_part=10).orderBy("part").collect()
    assert [len(r["messages"]) for r in parts] == [10, 10, 5]
    assert [m["content"] for r in parts for m in r["messages"]] == [str(i) for i in range(25)]


def test_violations(spark):
    rows = spark.createDataFrame(
        [("Acme", "u", 1.5, ["s"], 1), ("", None, 0.5, [], 0)],
        "company_name string, source_url string, extraction_confidence double, corroborating_sources array<string>, corroboration_count int",
    )
    a, b = [r["violations"] for r in grounding.violations(rows).collect()]
    assert a == ["confidence_out_of_range"]
    assert b == ["company_name_missing", "source_url_missing", "no_corroborating_source", "corroboration_count_below_one"]


def test_matrix_sort_puts_missing_prices_last(spark):
    rows = offers(spark, ("a", "x", None, 1.0, 1), ("a", "y", 2.0, 1.0, 1), ("a", "z", 1.0, 1.0, 1))
    assert [r["tier_name"] for r in matrix.sort_rows(rows, "input_asc").collect()] == ["z", "y", "x"]
    assert [r["tier_name"] for r in matrix.sort_rows(rows, "input_desc").collect()] == ["y", "z", "x"]


def test_feature_signal_needs_a_tier(spark):
    rows = frame(spark, record("A", [], limits="cache ok"), record("B", [tier("cache x")]), record("C", [tier("y")], limits="Cache too"))
    assert {r["source"] for r in strategy.feature_signal(rows).collect()} == {"B", "C"}


def test_hosts_are_found_or_refused(spark):
    cases = {
        "https://my_host.example.com/private": ("my_host.example.com", "APPROVED"),
        "https://10_0.internal/x": ("10_0.internal", "APPROVED"),
        "https:///x": (None, "REJECTED_HOST"),
        "https://a.example.com/p?q=a|b": ("a.example.com", "APPROVED"),
        "https://user:pw@10.0.0.5:8443/x": ("10.0.0.5", "REJECTED_PRIVATE_ADDRESS"),
        "http://a.example.com": ("a.example.com", "REJECTED_SCHEME"),
        "HTTPS://LOCALHOST\\@good.example.com/": ("localhost", "REJECTED_PRIVATE_ADDRESS"),
        "nonsense": (None, "REJECTED_SCHEME"),
    }
    rows = admission.admit(spark.createDataFrame([(u,) for u in cases], "url string")).collect()
    assert {r["url"]: (r["host"], r["verdict"]) for r in rows} == cases


def test_isolated_moves_do_not_hide_the_equilibrium(spark):
    trends = spark.createDataFrame(
        [("isolated", "PRICING", "one", "why", "what", "Acme", 1)],
        "scope string, category string, title string, rationale string, actionable_next_step string, source string, corroboration_count bigint",
    )
    records = spark.createDataFrame([("Acme",), ("Bolt",)], "company_name string")
    got = strategy.with_equilibrium(trends, records).collect()
    assert sorted((r["scope"], r["source"]) for r in got) == [("isolated", "Acme"), ("macro", "Acme"), ("macro", "Bolt")]


def test_repeated_tier_names_count_each(spark):
    schema = "sample_id string, tier_name string, input_price double, output_price double"
    pred = spark.createDataFrame([("s", "T", 1.0, 2.0), ("s", "T", 1.0, 2.0), ("s", "T", 1.01, 2.0)], schema)
    gold = spark.createDataFrame([("s", "T", 1.0, 2.0)], schema)
    assert evaluation.matched_tiers(pred, gold, 0.05).count() == 3


def test_a_repeated_tier_is_its_last_listing(spark):
    schema = "company_name string, product_name string, tier_name string, input_price double, output_price double, pos int"
    old = spark.createDataFrame([("a", "z", "t", 5.0, 6.0, 1)], schema)
    new = spark.createDataFrame([("a", "b", "t", 9.0, 1.0, 1), ("a", "b", "t", 3.0, 4.0, 2)], schema)
    rows = deltas.tier_diff(old, new, "pos").collect()
    assert sorted((r["metric_name"], r["new_value"], r["product_name"]) for r in rows) == [
        ("t_input_price", "$3.00/1M", "b"), ("t_output_price", "$4.00/1M", "b")
    ]


def test_repaired_answers_and_non_objects(spark):
    def model():
        first = {"p1": "42", "p2": '{"ok": 1}', "p3": "null", "p4": '{"bad": ', "p5": "[1]"}

        def answer(prompts, attempt):
            def one(prompt):
                if attempt == 0:
                    return next(v for k, v in first.items() if k in prompt)
                if "42" in prompt:
                    return '{"root_cause": "a number", "remedy": "an object", "corrected_output": {"ok": 2}}'
                return '{"critique": "still nothing"}'

            return prompts.map(one)

        return answer

    pages = spark.createDataFrame([(i, f"https://x/p{i}", "text") for i in range(1, 6)], "id int, url string, text string")
    got = {r["id"]: r for r in extraction.extract(pages, model, "id").collect()}
    assert (got[2]["attempt"], got[2]["payload"]) == (0, '{"ok": 1}')
    assert (got[1]["attempt"], got[1]["payload"], got[1]["root_cause"]) == (1, '{"ok":2}', "a number")
    assert all(got[i]["payload"] is None and got[i]["attempt"] == 2 and got[i]["error"] for i in (3, 4, 5))


def test_csv_quotes_strings_only(spark, tmp_path):
    frame = spark.createDataFrame([('a "b", c', 1.5, None), (None, None, "x\\y")], "s string, n double, t string").coalesce(1)
    sinks.csv(frame, str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("*.csv")
    assert file.read_text().splitlines() == ["s,n,t", '"a ""b"", c",1.5,', ',,"x\\y"']


def test_long_pages_are_read_to_their_end(spark):
    """Tiers all over a page of many prompts, also where a passage fails first and where two passages meet."""

    import json
    import re

    def reader():
        def one(prompt, attempt):
            if attempt == 0 and "<broken>" in prompt:
                return "no idea"
            tiers = [{"name": n, "price": int(p)} for n, p in re.findall(r"\[(t\d+) = (\d+)\]", prompt)]
            return json.dumps({"corrected_output": {"tiers": tiers}} if attempt else {"company": "Acme", "tiers": tiers})

        return lambda prompts, attempt: prompts.map(lambda p: one(p or "", attempt))

    listed = [(f"t{i}", i) for i in range(60)] + [("t1", 7)]
    text = "".join(f"[{n} = {p}]".ljust(397, "x") for n, p in listed)
    broken = text.replace("[t40", "<broken>[t40")
    pages = spark.createDataFrame([(1, "u", text), (2, "u", broken), (3, "u", "[t1 = 1]"), (4, "u", ""), (5, "u", None)], "page_id int, url string, text string")
    answer = "company string, tiers array<struct<name:string,price:int>>"
    rows = {r.page_id: r for r in extraction.extract(pages, reader, "page_id", answer=answer).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    for i in (1, 2):
        tiers = [(t["name"], t["price"]) for t in json.loads(rows[i].payload)["tiers"]]
        assert sorted(tiers) == sorted(listed) and tiers[-1] == ("t1", 7) and rows[i].error is None
    assert rows[2].attempt == 1 and json.loads(rows[3].payload)["tiers"] == [{"name": "t1", "price": 1}]


def test_unsound_answers_are_asked_again(spark):
    """An object that breaks a rule goes round with the rule in its prompt; what stays unsound counts as it is, with its error."""

    def model():
        def one(prompt, attempt):
            if attempt == 0:
                return '{"company_name": "", "n": 1}' if "bad" in prompt else '{"company_name": "Acme", "n": 1}'
            assert "no name" in prompt and "RECENT ACTIONS:\nlooked" in prompt
            return '{"corrected_output": {"company_name": "", "n": 3}}' if "worse" in prompt else '{"corrected_output": {"company_name": "Mended", "n": 2}}'

        return lambda prompts, attempt: prompts.map(lambda p: one(p, attempt))

    def check(answer, text):
        return F.when(answer["company_name"] == "", F.concat(F.lit("no name in "), text))

    pages = spark.createDataFrame([(1, "u", "good"), (2, "u", "bad"), (3, "u", "bad worse")], "id int, url string, text string")
    got = extraction.extract(pages, model, "id", answer="company_name string, n int", check=check, recent=F.lit("looked"))
    rows = {r["id"]: (r["attempt"], r["payload"], r["error"]) for r in got.collect()}
    assert rows[1] == (0, '{"company_name": "Acme", "n": 1}', None)
    assert rows[2][0] == 1 and '"Mended"' in rows[2][1] and rows[2][2] is None
    assert rows[3][0] == 2 and '"n":3' in rows[3][1] and rows[3][2] == "no name in bad worse"


def test_answers_of_passages_are_united_by_their_type(spark):
    shape = extraction.StructType.fromDDL("name string, flag boolean, n int, items array<struct<a:int>>")
    rows = [(['{"name":"","flag":false,"items":[{"a":1},{"a":2}]}', '{"name":"x","n":4,"items":[{"a":3},{"a":1}]}', '{"name":"y","flag":true,"n":5,"items":null}'],), (['{"name":null}', "{}"],)]
    got = spark.createDataFrame(rows, "p array<string>").select(extraction.united(F.col("p"), shape).alias("u")).collect()
    assert got[0].u == '{"name":"x","flag":true,"n":4,"items":[{"a":2},{"a":3},{"a":1}]}'
    assert got[1].u == "{}"


def test_tables_of_the_store_have_their_own_columns(spark):
    path = scratch_path(spark, "store")
    sinks.append_to(spark.createDataFrame([("u", 7, "x")], "url string, content_length bigint, more string"), path, "raw_documents", "r1")
    sinks.append_to(spark.createDataFrame([("v",)], "url string"), path, "raw_documents", "r2")
    rows = sinks.read_table(spark, path, "raw_documents")
    assert [f.name for f in rows.schema] == [f.name for f in extraction.StructType.fromDDL(sinks.TABLES["raw_documents"])]
    assert {(r.pipeline_id, r.url, r.content_length) for r in rows.collect()} == {("r1", "u", 7), ("r2", "v", None)}


def test_pairs_that_only_share_a_bucket_never_meet_their_vectors(spark, monkeypatch):
    met, verified = [], vectors._verified
    monkeypatch.setattr(vectors, "_verified", lambda pairs, *rest: met.append(pairs.count()) or verified(pairs, *rest))
    rng = np.random.default_rng(6)
    data = rng.standard_normal((150, 24))
    data = np.vstack([data, data[:20] + rng.standard_normal((20, 24)) * 0.01])
    rows = [(i, "a", [float(x) for x in v]) for i, v in enumerate(data)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, company string, embedding array<float>"), 24, bits=3)
    assert {r["vec_id"] for r in got.filter("is_duplicate").collect()} == set(range(150, 170))
    assert sum(met) < 200


@pytest.mark.parametrize("threshold", [0.995, 0.9])
def test_sketches_of_near_pairs_are_alike(threshold):
    limit, p = vectors.sketch_limit(threshold, 1e-9), math.acos(threshold) / math.pi
    tail = [sum(math.comb(126, i) * p**i * (1 - p) ** (126 - i) for i in range(at + 1, 127)) for at in (limit, limit - 1)]
    assert tail[0] <= 1e-9 < tail[1] and limit < 126 * 0.5


def test_ids_that_repeat_with_other_vectors(spark):
    """Two vectors of one id lie in the same buckets; both are compared with later ones."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        one = rng.standard_normal(16)
        two = one + rng.standard_normal(16) * 0.5
        rows += [(i, f"c{i}", one), (i, f"c{i}", two), (100 + i, f"c{i}", (one if i % 2 else two) + rng.standard_normal(16) * 0.01)]
    frame = spark.createDataFrame([(i, c, [float(x) for x in v]) for i, c, v in rows], "vec_id bigint, company string, embedding array<float>")
    got = vectors.near_duplicates(frame, 16, bits=1).filter("is_duplicate").select("vec_id").distinct().collect()
    assert {r["vec_id"] for r in got} == set(range(100, 160))
