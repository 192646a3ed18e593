"""Data source, table functions, streams, exact medians, reports in one shuffle."""

import io
import json
import os
import random
import statistics
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, StringEndsWith

from tallyframe import sources, store, streaming
from tallyframe.operators import analysis, layout, quantiles
from tallyframe.plans import texts
from tallyframe.sources import table_functions
from tallyframe.sources.filings import Filings, PushingReader, Reader
from tests.test_statement import LINES, as_csv, xlsx

SF = "/root/testdata/sf0.001"


def folder(tmp_path, files):
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


FILES = {"a/a.xlsx": xlsx(LINES), "b.csv": as_csv(LINES), "c.pdf": b"%PDF-1.7", "d.xlsx": b"PK\x03\x04 no", "e.txt": b"x", "f.csv": b"", "g.csv": b"x" * 9000, "h.pdf": b"nothing"}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_data_source_equals_files(spark, tmp_path):
    path = folder(tmp_path, FILES)
    spark.dataSource.register(Filings)
    got = spark.read.format("filings").option("limit", 8000).load(path)
    files = spark.createDataFrame([(f"{path}/{k}", len(v), bytearray(v)) for k, v in FILES.items()], "path string, length long, content binary")
    assert rows(got) == rows(sources.tokens_of_files(files, 8000)) and got.filter("code is null").select("doc_id").distinct().count() == 2
    assert {k.rpartition("/")[2]: v for k, v in got.filter("code is not null").select("doc_id", "code").collect()} == {
        "c.pdf": "UNREADABLE_PDF", "d.xlsx": "UNREADABLE_SPREADSHEET", "e.txt": "UNSUPPORTED_FORMAT", "f.csv": "EMPTY_FILE", "g.csv": "FILE_TOO_LARGE", "h.pdf": "CORRUPT_PDF"}
    assert spark.read.format("filings").load(folder(tmp_path / "none", {"x.txt": b""})).filter("code is null").count() == 0


def test_files_that_are_ruled_out_are_not_opened(spark, tmp_path):
    """Files are listed; then those that nothing may open are made unreadable, and the tasks don't mind."""
    path = folder(tmp_path, {"a.csv": as_csv(LINES), "b.csv": as_csv(LINES), "e.txt": b"x", "g.csv": b"x" * 9000})
    read = PushingReader({"path": path, "limit": "8000"})
    other = GreaterThan(("x",), 1.0)
    assert list(read.pushFilters([In(("doc_id",), (f"{path}/a.csv", f"{path}/e.txt", f"{path}/g.csv")), IsNotNull(("doc_id",)), other])) == [other]
    (share,) = read.partitions()
    for gone in ("b.csv", "e.txt", "g.csv"):
        os.remove(f"{path}/{gone}")
    got = list(read.read(share))
    assert {r[-1] for r in got} == {None, "UNSUPPORTED_FORMAT", "FILE_TOO_LARGE"} and {r[0].rpartition("/")[2] for r in got} == {"a.csv", "e.txt", "g.csv"}
    fine = PushingReader({"path": folder(tmp_path, {"k/e.txt": b"x"})})
    assert list(fine.pushFilters([IsNull(("code",)), StringEndsWith(("doc_id",), ".csv")])) == [IsNull(("code",))]
    assert [f.path.rpartition("/")[2] for s in fine.partitions() for f in s.files] == ["a.csv"]
    exact = PushingReader({"path": path})
    assert not list(exact.pushFilters([EqualTo(("doc_id",), f"{path}/k/e.txt")])) and [f.code for s in exact.partitions() for f in s.files] == ["UNSUPPORTED_FORMAT"]


def test_filters_reach_the_listing(spark, tmp_path):
    path = folder(tmp_path, {"a.csv": as_csv(LINES), "b.csv": as_csv(LINES), "e.txt": b"x"})
    spark.dataSource.register(Filings)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format("filings").option("push", "true").load(path)
        one = read.filter(F.col("doc_id") == f"{path}/a.csv")
        assert {r[0] for r in one.select("doc_id").collect()} == {f"{path}/a.csv"} and read.filter(F.col("doc_id").endswith(".txt")).select("code").collect()[0][0] == "UNSUPPORTED_FORMAT"
        assert one.rdd.getNumPartitions() == 1 and read.filter("doc_id = 'none'").count() == 0
        with redirect_stdout(io.StringIO()) as plan:
            one.explain("formatted")
        assert "a.csv" not in plan.getvalue().partition("BatchScan")[0].partition("Filter")[2], plan.getvalue()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_files_are_dealt_by_size(tmp_path):
    path = folder(tmp_path, {f"{i:02}.csv": b"x" * n for i, n in enumerate([400, 500, 300, 5000, 10, 20])} | {"z.txt": b"x" * 9000})
    shares = Reader({"path": path, "part_bytes": "1000"}).partitions()
    assert [[f.length for f in s.files] for s in shares] == [[400, 500], [300], [5000], [10, 20, 9000]]


def test_data_source_as_a_stream(spark, tmp_path):
    path = folder(tmp_path / "in", {"1.csv": as_csv(LINES), "2.txt": b"x"})
    spark.dataSource.register(Filings)
    seen = []

    def run():
        stream = spark.readStream.format("filings").option("per_batch", 2).load(path)
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").foreachBatch(lambda df, n: seen.extend((n, r[0].rpartition("/")[2]) for r in df.select("doc_id").distinct().collect())).start()
        query.processAllAvailable()
        query.stop()

    run()
    folder(tmp_path / "in", {"3.csv": as_csv(LINES), "4.csv": b"a,b", "5.csv": b""})
    run()
    assert sorted(name for _, name in seen) == ["1.csv", "2.txt", "3.csv", "4.csv", "5.csv"] and len({n for n, _ in seen}) >= 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_table_functions_equal_data_frames(spark):
    tokens = texts.token_pages(spark, SF, skew=7.0, spacing=12.0).filter("cast(doc_id as int) < 400").cache()
    tokens.createOrReplaceTempView("tokens")
    table_functions.register(spark)
    call = lambda f: spark.sql(f"SELECT * FROM {f}(TABLE(tokens) PARTITION BY (doc_id, page) ORDER BY token_seq)")
    read = layout.pages(tokens).cache()
    lines = layout.page_lines(read)
    assert rows(call("page_rows")) == rows(lines.select("doc_id", "page", "row_seq", "y", "label", "text", F.size("words")))
    assert rows(call("page_columns")) == rows(layout.page_columns(read))
    assert rows(call("page_cells")) == rows(lines.select("doc_id", "page", "row_seq", F.explode("cells").alias("c")).select("doc_id", "page", "row_seq", "c.column_index", "c.value", "c.confidence", "c.raw"))
    assert rows(call("page_matches")) == rows(layout.aligned(read).select("doc_id", "page", "row_seq", "label", "value_seq", "confidence"))
    with pytest.raises(Exception, match="token_seq"):
        spark.sql("SELECT * FROM page_rows(TABLE(SELECT doc_id, page, text FROM tokens))").collect()


def test_stream_reads_equal_files_once_and_leaves_nothing(spark, tmp_path):
    """A file that comes again, under another name and in another batch, has no second report; a batch that comes again leaves its folder as it was; scratch is gone."""
    folder(tmp_path / "in", {"a.xlsx": xlsx(LINES), "b.csv": as_csv(LINES)})
    target, sink = str(tmp_path / "out"), streaming.into(str(tmp_path / "out"))
    before, batches = list(store._WRITTEN), []

    def kept(df, n):
        sink(df, n)
        once = rows(spark.read.json(f"{target}/batch={n}").select("doc_id", "confidence"))
        sink(df, n)  # as after a failure between the write and the commit
        assert rows(spark.read.json(f"{target}/batch={n}").select("doc_id", "confidence")) == once
        batches.append(n)

    for more in ({}, {"c.csv": as_csv(LINES), "d/a.xlsx": xlsx(LINES)}, {"e.txt": b"what"}):
        folder(tmp_path / "in", more)
        streaming.watch(spark, str(tmp_path / "in"), str(tmp_path / "ck"), kept).awaitTermination()
    names = [r["doc_id"].rpartition("/")[2] for r in spark.read.json(target).select("doc_id").collect()]
    assert sorted(names) == ["a.xlsx", "b.csv"] or sorted(names) == ["a.xlsx", "b.csv", "e.txt"]
    assert store._WRITTEN == before and batches


@pytest.mark.parametrize("kind", ["spread", "ties", "one value", "far"])
def test_medians_of_large_groups(spark, kind):
    rng = random.Random(kind)
    value = {"spread": lambda: rng.uniform(-5, 5), "ties": lambda: float(rng.choice([1, 2, 2, 2, 3, 9])), "one value": lambda: 4.0, "far": lambda: rng.choice([1e300, -1e300, 1e-300, 0.0, rng.random()])}[kind]
    data = [("big", value()) for _ in range(5000)] + [("odd", value()) for _ in range(601)] + [("few", value()) for _ in range(4)] + [(None, value()) for _ in range(700)] + [("none", None), ("big", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(3)
    got = {r["g"]: r["median"] for r in quantiles.medians(df, ["g"], "x", small=50).collect()}
    want = {g: statistics.median(v) if (v := [x for k, x in data if k == g and x is not None]) else None for g in {g for g, _ in data}}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12, abs=0) if want[g] is not None else got[g] is None for g in want)
    assert quantiles.medians(df.limit(0), ["g"], "x").count() == 0


def test_report_parts_meet_in_one_shuffle(spark):
    a = spark.createDataFrame([("d", 2, "x"), ("d", 1, "y"), ("e", 3, None)], "doc_id string, n int, t string")
    b = spark.createDataFrame([("f", 5)], "doc_id string, m long")
    one = spark.createDataFrame([("d", 1.5), ("e", None)], "doc_id string, sure double")
    out = analysis.together({"a": a, "b": b}, {"o": one})
    got = {r["doc_id"]: (list(map(tuple, r["a"])), list(map(tuple, r["b"])), r["sure"]) for r in out.collect()}
    assert got == {"d": ([(1, "y"), (2, "x")], [], 1.5), "e": ([(3, None)], [], None), "f": ([], [(5,)], None)}
    with redirect_stdout(io.StringIO()) as plan:
        analysis.together({"a": a, "b": b}, {"o": one}).explain()
    assert plan.getvalue().count("Exchange hashpartitioning") == 1 and "Join" not in plan.getvalue()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_report_json_of_every_document(spark):
    from tallyframe.plans import ledger

    got = [json.loads(r["report"]) for r in ledger.queries()["report_json"](spark, SF).collect()]
    assert len(got) > 10 and all(r["statement"] and r["metrics"] and r["checks"] and r["summary"] and 0 < r["confidence"] <= 1 for r in got)
    assert all([x["ord"] for x in r["statement"]] == sorted(x["ord"] for x in r["statement"]) for r in got)
