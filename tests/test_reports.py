"""Reports as files: one per run, lines in order, nothing left behind by a job that failed."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marketloom.session import scratch_path
from marketloom.sources import report_files, sinks


def lines(spark, runs, n):
    rows = spark.range(n).select(F.explode(F.array(*[F.lit(r) for r in runs])).alias("pipeline_id"), "id")
    return rows.select(
        "pipeline_id", (F.col("id") % 3).cast("int").alias("section_no"), F.lpad(F.col("id").cast("string"), 8, "0").alias("sort_key"),
        F.concat(F.col("pipeline_id"), F.lit(" line "), F.col("id").cast("string")).alias("line"),
    )


def local(path):
    return Path(path.removeprefix("file:"))


def test_one_file_per_run_in_reading_order(spark):
    path = scratch_path(spark, "files")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.report(lines(spark, ["run-aaaa-1", "other"], 4000), path, F.lit("2024-05-06").cast("date"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(p.name for p in local(path).iterdir() if p.is_file())
    assert files == ["report_20240506_other.md", "report_20240506_run-aaaa.md"]
    want = [f"other line {i}" for s in range(3) for i in range(4000) if i % 3 == s]
    assert (local(path) / files[0]).read_text().splitlines() == want
    assert not list((local(path) / "_pieces").iterdir())


def test_a_failed_job_leaves_no_report(spark):
    path = scratch_path(spark, "files")
    spark.dataSource.register(report_files.ReportFiles)
    broken = lines(spark, ["run"], 3000).select(
        F.lit("report.md").alias("file"), F.when(F.col("sort_key") == "00002999", F.raise_error(F.lit("no"))).otherwise(F.col("line")).alias("line")
    )
    with pytest.raises(Exception):
        broken.write.format("report_files").mode("append").save(path)
    assert not (local(path) / "report.md").exists()


def test_empty_lines_are_kept(spark):
    path = scratch_path(spark, "files")
    rows = spark.createDataFrame([("r", 1, "0", "a"), ("r", 1, "1", ""), ("r", 1, "2", None), ("r", 2, "0", "é")], "pipeline_id string, section_no int, sort_key string, line string")
    sinks.report(rows, path, F.lit("2024-05-06").cast("date"))
    assert (local(path) / "report_20240506_r.md").read_text() == "a\n\n\né\n"


def test_a_file_is_read_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(report_files, "CHUNK", 7)
    folder = local(scratch_path(spark, "digests"))
    folder.mkdir(parents=True)
    texts = {"a.md": "é\n\n" * 50 + "end" + "\n" * 20, "b.md": "", "c.md": "\n\n", "d.md": "one\r\n two", "e.md": "1234567\n890123\n"}
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    reader = report_files.ReportReader(folder.as_uri())
    found = {row[0]: row[1:] for part in reader.partitions() for row in reader.read(part)}
    want = {n: (t.rstrip("\n").count("\n") + 1, hashlib.md5(t.rstrip("\n").encode()).hexdigest()) for n, t in texts.items()}
    assert found == want


def test_files_are_written_from_batches(spark, tmp_path):
    import pyarrow as pa

    class Task:
        partitionId = taskAttemptId = lambda self: 3

    names = ["a.md"] * 3 + ["b.md"] * 2 + ["c.md"]
    batches = [pa.record_batch({"file": names[i : i + 2], "line": [str(i), None]}) for i in (0, 2, 4)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("pyspark.TaskContext.get", lambda: Task())
        writer = report_files.ReportWriter(tmp_path.as_uri())
        writer.commit([writer.write(iter(batches))])
    assert {f.name: f.read_text() for f in tmp_path.glob("*.md")} == {"a.md": "0\n\n2\n", "b.md": "\n4\n", "c.md": "\n"}


def test_payload_and_report_read_the_stage_tables_only(spark):
    from datetime import datetime

    from marketloom.plans import price_queries

    folder = scratch_path(spark, "tables")
    days = [datetime(1995, 1, 1), datetime(1999, 1, 1)]
    items = [(1, p, s, 1, 2.0, 100.0 * p + s + 10 * i, 0.0, 0.0, "A", "F", day) for i, day in enumerate(days) for p in (1, 2) for s in (1, 2)]
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    rows = spark.createDataFrame(items, schema).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    rows.write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "B#1", "BIG"), (2, "B#2", "BIG")], "p_partkey bigint, p_brand string, p_type string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(1, "S#1"), (2, "S#2")], "s_suppkey bigint, s_name string").write.parquet(f"{folder}/supplier.parquet")
    offers, changes = price_queries._stages(spark, folder)
    assert offers.count() == 4 and changes.count() == 4
    payload = price_queries.json_payload(spark, folder)
    assert not [f for f in payload.inputFiles() if "lineitem" in f]
    found = payload.filter("part = 'competitors'").select("a", "b", "n").collect()
    assert sorted(map(tuple, found)) == [(f"S#{i}", f"https://s-{i}.example.com/pricing", 2) for i in (1, 2)]
