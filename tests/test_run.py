"""Two whole runs over captured pages: admission, extraction, changes, report."""

import json
import re

import pandas as pd
import pytest

from marketloom import schemas
from marketloom.plans.competitive_run import Run, execute
from marketloom.session import scratch_path

FILLER = "<p>" + "Our models are fast and fair. " * 8 + "</p>"
SOURCES = [
    ("a", "Acme", "https://acme.example.com/pricing", None, None, None, None, None),
    ("b", "Bolt", "https://bolt.example.com/pricing", None, None, None, None, True),
    ("c", "Off", "https://off.example.com/pricing", None, None, None, None, False),
    ("d", "Plain", "http://plain.example.com/pricing", None, None, None, None, True),
    ("e", "Shy", "https://shy.example.com/private/pricing", None, None, None, None, True),
]
ROBOTS = [("shy.example.com", "User-agent: *\nDisallow: /private")]


def page(company, *tiers):
    rows = "".join(f"<tr><td>{name}</td><td>${low} / 1M</td><td>${high}</td></tr>" for name, low, high in tiers)
    return f"<html><nav>menu</nav><h1>{company} API pricing today</h1>{FILLER}<table>{rows}</table>mail sales@{company.lower()}.example.com</html>"


def captures(spark, pages):
    rows = [(i, 1, 403, "") for i in pages] + [(i, 2, 200, html) for i, html in pages.items()]
    return spark.createDataFrame(rows, "id string, tier_rank int, status_code int, html string")


def test_two_runs(spark):
    def reader():
        def answer(prompts: pd.Series, attempt: int) -> pd.Series:
            def one(prompt):
                name = re.search(r"### (\w+) API pricing", prompt)
                if name is None:
                    return "no idea"
                if name[1] == "Bolt" and attempt == 0:
                    return '{"broken": '
                tiers = [
                    {"model_or_tier_name": t.strip(), "input_price_per_m_tokens": f"${low} / 1M", "output_price_per_m_tokens": float(high)}
                    for t, low, high in re.findall(r"\|  \| ([\w ]+?) ?\| \$([\d.]+) / 1M ?\| \$([\d.]+)", prompt)
                ] or [
                    {"model_or_tier_name": t.strip(), "input_price_per_m_tokens": f"${low} / 1M", "output_price_per_m_tokens": float(high)}
                    for t, low, high in re.findall(r"\| ([\w]+) \| \$([\d.]+) / 1M \| \$([\d.]+)", prompt)
                ]
                body = {"company_name": name[1], "product_name": "API", "pricing_tiers": tiers, "citation_text": f"{name[1]} API pricing today"}
                return "```json\n" + json.dumps(body) + "\n```"

            return prompts.map(one)

        return answer

    base = scratch_path(spark, "runs")
    sources = spark.createDataFrame(SOURCES, schemas.SOURCE)
    robots = spark.createDataFrame(ROBOTS, "host string, robots_txt string")
    first_pages = {
        "a": page("Acme", ("Fast", "2.50", "10.00"), ("Slow", "0.50", "1.00")),
        "b": page("Bolt", ("Nano", "4.00", "8.00")),
        "e": page("Shy", ("X", "1.00", "1.00")),
    }
    one = Run("run-1", f"{base}/1", "2024-01-01")
    row = execute(spark, one, sources, captures(spark, first_pages), robots, reader).first()
    assert (row["attempted"], row["scraped"], row["extracted"], row["flagged"], row["deltas"]) == (4, 2, 2, 0, 0)
    audits = {r["source_url"]: r["compliance_status"] for r in spark.read.parquet(one.table("compliance_audits")).collect()}
    assert audits["http://plain.example.com/pricing"] == "REJECTED_SCHEME"
    assert audits["https://shy.example.com/private/pricing"] == "BLOCKED_BY_ROBOTS"
    texts = [r["content_markdown"] for r in spark.read.parquet(one.table("documents")).collect()]
    assert all("[REDACTED_EMAIL]" in t and "menu" not in t for t in texts)
    report = "\n".join(r["value"] for r in spark.read.text(one.table("report")).collect())
    assert "| Acme | Fast | $2.50 | $10.00 |" in report and "Detected Market Changes" not in report

    second_pages = {**first_pages, "a": page("Acme", ("Fast", "1.00", "10.00"), ("Turbo", "9.00", "9.50"))}
    two = Run("run-2", f"{base}/2", "2024-01-08", previous=one.out)
    row = execute(spark, two, sources, captures(spark, second_pages), robots, reader).first()
    # Bolt's page is unchanged, so only Acme is read again
    assert (row["scraped"], row["extracted"], row["deltas"]) == (2, 1, 3)
    changes = {r["metric_name"]: r["delta_type"] for r in spark.read.parquet(two.table("deltas")).collect()}
    assert changes == {"Fast_input_price": "PRICE_DECREASE", "Slow": "TIER_REMOVED", "Turbo": "NEW_TIER"}
    moves = {(r["scope"], r["title"]) for r in spark.read.parquet(two.table("insights")).collect()}
    assert ("isolated", "Isolated Price Reduction") in moves and ("advice", "New Tier Launched by Acme") in moves
    report = "\n".join(r["value"] for r in spark.read.text(two.table("report")).collect())
    assert "NEW: Turbo" in report and "Detected Market Changes" in report and "| Bolt | Nano |" in report


def test_three_runs_with_two_pages_each(spark):
    """An unchanged page is not read again, yet its tiers stay: no false removal, no lost change, no empty run."""

    def reader():
        def one(prompt):
            name = re.search(r"### (\w+) API pricing", prompt)[1]
            tiers = [
                {"model_or_tier_name": t, "input_price_per_m_tokens": float(low), "output_price_per_m_tokens": float(high)}
                for t, low, high in re.findall(r"\| (\w+) ?\| \$([\d.]+) / 1M ?\| \$([\d.]+)", prompt)
            ]
            return json.dumps({"company_name": name, "product_name": "API", "pricing_tiers": tiers, "citation_text": f"{name} API pricing today"})

        return lambda prompts, attempt: prompts.map(one)

    base = scratch_path(spark, "runs")
    names = {"a1": "Acme", "a2": "Acme", "b1": "Bolt", "b2": "Bolt"}
    sources = spark.createDataFrame(
        [(i, n, f"https://{n.lower()}.example.com/{i}", None, None, None, None, True) for i, n in names.items()], schemas.SOURCE
    )
    robots = spark.createDataFrame(ROBOTS, "host string, robots_txt string")
    pages = {
        "a1": page("Acme", ("Fast", "2.50", "10.00")), "a2": page("Acme", ("Slow", "0.50", "1.00")),
        "b1": page("Bolt", ("Nano", "4.00", "8.00")), "b2": page("Bolt", ("Mega", "20.00", "40.00")),
    }
    previous, seen = None, []
    for number, change in enumerate([{}, {"b1": page("Bolt", ("Nano", "5.00", "8.00"))}, {"a1": page("Acme", ("Fast", "0.25", "10.00"))}, {}]):
        pages = {**pages, **change}
        run = Run(f"run-{number}", f"{base}/{number}", "2024-01-01", previous=previous)
        row = execute(spark, run, sources, captures(spark, pages), robots, reader).first()
        changes = {(r["competitor_name"], r["metric_name"], r["delta_type"]) for r in spark.read.parquet(run.table("deltas")).collect()}
        seen.append((row["extracted"], row["records"], spark.read.parquet(run.table("offers")).count(), changes))
        previous = run.out
    assert seen == [
        (4, 4, 4, set()),
        (1, 4, 4, {("Bolt", "Nano_input_price", "PRICE_INCREASE")}),
        (1, 4, 4, {("Acme", "Fast_input_price", "PRICE_DECREASE")}),
        (0, 4, 4, set()),
    ]
    report = "\n".join(r["value"] for r in spark.read.text(f"{previous}/report").collect())
    assert "| Acme | Fast | $0.25 | $10.00 |" in report and "| Bolt | Mega |" in report


def test_a_failed_run_says_so(spark):
    run = Run("bad", f"{scratch_path(spark, 'runs')}/bad", "2024-01-01", previous="/nowhere/at/all")
    sources = spark.createDataFrame(SOURCES, schemas.SOURCE)
    robots = spark.createDataFrame(ROBOTS, "host string, robots_txt string")
    with pytest.raises(Exception):
        execute(spark, run, sources, captures(spark, {"a": page("Acme", ("Fast", "1", "2"))}), robots, lambda: None)
    row = spark.read.parquet(run.table("runs")).first()
    assert (row["pipeline_id"], row["status"]) == ("bad", "FAILED") and row["error"]
