import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import amounts, captions, headers
from tallyframe.functions.chart import COMPOSITION, CONCEPTS, LEAVES


# Amounts as scans have them, and what they are.
@pytest.mark.parametrize(
    ("text", "value"),
    [("1,17,68,77,414", 1176877414), ("1,176,877,414", 1176877414), ("(17,95,893)", -1795893), ("-26,11,863", -2611863), ("12,34,567.89", 1234567.89), ("1234.5", 1234.5), ("1.43.80.70.840", 1438070840), ("80.00.94.216", 800094216), ("5t,39,75,424", 513975424), ("2t,35,tI,7 10", 213511710), ("8,80,54,8I9", 88054819), ('1,r7,68"77.414', 1176877414), ("1.43.80", 143.80)],
)
def test_amounts(text, value):
    assert amounts.parse_amount(text)[0] == pytest.approx(value)


@pytest.mark.parametrize("text", ["Total", "Inventories", "", "DIRECTOR", None])
def test_prose_is_no_amount(text):
    assert amounts.parse_amount(text) is None


def test_shape():
    assert all(map(amounts.is_amount, ("1,17,68,77,414", "(2,70,56,594)")))
    assert not any(map(amounts.is_amount, ("2024", "12", "1", "Trade payables", "")))


@given(st.integers(0, 10**17))
def test_indian_grouping_round_trip(n):
    value, confidence, repaired, _ = amounts.parse_amount(amounts.indian_groups(n))
    assert value == float(n) and not repaired and confidence >= 0.85


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, above = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != d)))
    return row[-1]


@given(st.text("abcdefg", max_size=12), st.text("abcdefg", max_size=8))
def test_substring_distance_bounds(a, b):
    assert captions.substring_distance(a, b) == min((levenshtein(a[i:j], b) for i in range(len(a) + 1) for j in range(i, len(a) + 1)), default=len(b))
    assert captions.substring_distance(a, a) == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.from_regex(r"\A[-(]?[0-9]{1,3}(,[0-9]{2,3}){0,6}[-)]?\Z"), st.text("0123456789lO,.()-% ", max_size=22), st.text("01234567899lIi|!tTrOoQDSsBZzgqbG,.'\"_;:J \u00a0–—-()%₹$x", max_size=14)), min_size=1, max_size=40))
def test_amount_column_equals_parser(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select(amounts.parse_amount_column(F.col("t")).alias("x")).collect()
    assert [r["x"] and tuple(r["x"]) for r in got] == [*map(amounts.parse_amount, texts), None]


def test_money():
    assert amounts.money(12_345_678) == "₹1.23 Cr" and amounts.money(-250_000) == "-₹2.50 L" and amounts.money(1234.5) == "₹1,235"
    assert amounts.money(1_500_000, "$", False) == "$1.50M" and amounts.fixed(1.005, 2) == "1.00" and amounts.fixed(0.125, 2) == "0.13"


def test_every_synonym_is_its_own_concept():
    assert len(CONCEPTS) == 29 and sum(len(c["synonyms"]) for c in CONCEPTS) == 105 and len(LEAVES) == 21 and len(COMPOSITION) == 8
    every = [(s, c) for c in CONCEPTS for s in c["synonyms"]]
    for sections in ([None] * len(every), [c["section"] for _, c in every]):
        assert [k for k, _ in captions.classified([s for s, _ in every], sections)] == [c["concept"] for _, c in every]


def test_prose_and_short_texts_have_no_concept():
    assert captions.classified(["theaccompanyingnoteswereapprovedbytheboard", "ab", ""], [None] * 3) == [(None, None)] * 3 and captions.classified([], []) == []


def test_classify_joins_back(spark):
    rows = [("a) Trade Payables", "liabilities"), ("Trade  payables", "liabilities"), ("Trade payables", None), ("x", None), (None, None)]
    got = captions.classify(spark.createDataFrame(rows, "label string, section string")).collect()
    assert len(got) == 5 and sorted(repr(r["concept"]) for r in got) == ["'tradePayables'"] * 3 + ["None"] * 2
    scores = {(r["label"], r["section"]): r["label_score"] for r in got if r["concept"]}
    assert scores["a) Trade Payables", "liabilities"] == scores["Trade  payables", "liabilities"] > scores["Trade payables", None]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("label", "section"), [("ASSETS", "assets"), ("Equity and Liabilities", "liabilities"), ("Shareholders' Funds", "equity"), ("Total assets", None), ("Trade payables", None)])
def test_sections(spark, label, section):
    assert one(spark, captions.section_of(F.lit(label))) == section


# Which letters of a header are read as digits of a year.
@pytest.mark.parametrize(("text", "year"), [("31st March 2O24", 2024), ("19b4", 1984), ("Zoll", None), ("2o2l", 2021), ("no year", None), ("FY 1949", None), ("2050", None), ("|99S", 1995)])
def test_years(spark, text, year):
    assert one(spark, headers.year(F.lit(text))) == year


def test_headers(spark):
    assert one(spark, headers.month(F.lit("31st Mar 2024"))) == 3 and one(spark, headers.unit_scale(F.lit("Amounts in USD thousands"))) == 1000.0 and one(spark, headers.unit_label(F.lit("in Rs. crores"))) == "Crore"
    assert one(spark, headers.currency(F.lit("stated in USD"))) == "USD" and one(spark, headers.currency(F.lit("none"))) == "INR"
    label = lambda t, y: one(spark, headers.header_label(F.lit(t), F.lit(y).cast("int")))
    assert label("(Amount in Rs.) 31st Mar 2024", 2024) == "31st Mar 2024" and label("2024", 2024) == "FY 2024" and label("Now", None) == "Now" and label("", None) == "Period"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("0123456789lIOSBJ,.'-() %x", min_size=1, max_size=8), min_size=1, max_size=20))
def test_one_shape_for_columns_and_texts(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(amounts.looks_like_amount(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [amounts.is_amount(t) for t in texts]


def test_display():
    from tallyframe.functions import display as d

    assert d.money(1_500, "USD") == "$1.5K" and d.money(None) == "—" and d.exact(1234567.5) == "₹12,34,567.5" and d.exact(-1234.0, "USD") == "$-1,234"
    assert d.metric(0.456, "percent") == "45.6%" and d.metric(1.5, "times") == "1.50×" and d.change(0.05, None, "percent") == "+5.0 pts"
    assert d.change(-2e7, -0.25, "currency") == "-₹2.00 Cr (-25.0%)" and d.change(1.0, 0.5, "ratio") == "+50.0%" and d.change(None, None, "ratio") is None
    assert d.file_size(2048) == "2 KB" and d.duration(1500) == "1.5 s" and d.lower_first("Total") == "total" and d.lower_first("EPS grew") == "EPS grew"


def test_display_columns(spark):
    from tallyframe.functions import display as d

    frame = spark.createDataFrame([(1234567.5, 0.25, "INR", "currency"), (None, None, None, "percent"), (0.456, 0.1, "USD", "percent")], "v double, s double, c string, k string")
    got = frame.select(d.money_column(F.col("v"), F.col("c")).alias("a"), d.exact_column(F.col("v"), F.col("c")).alias("b"), d.metric_column(F.col("v"), F.col("k"), F.col("c")).alias("m"), d.change_column(F.col("v"), F.col("s"), F.col("k"), F.col("c")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("₹12.35 L", "₹12,34,567.5", "₹12.35 L", "+₹12.35 L (+25.0%)"), ("—", "—", "—", None), ("$0", "$0.46", "45.6%", "+45.6 pts")]
    assert one(spark, d.file_size_column(F.lit(2048))) == "2 KB" and one(spark, d.duration_column(F.lit(1500))) == "1.5 s"
    assert one(spark, d.lower_first_column(F.lit("EPS grew"))) == "EPS grew" and one(spark, d.lower_first_column(F.lit("Total"))) == "total"
    assert one(spark, d.confidence_tier(F.lit(0.797))) == "High" and one(spark, d.confidence_tier(F.lit(0.6))) == "Moderate" and one(spark, d.confidence_tier(F.lit(0.2))) == "Low"
    assert one(spark, d.improving(F.lit(-1.0), F.lit(False))) is True and one(spark, d.improving(F.lit(1.0), F.lit(None).cast("boolean"))) is None and one(spark, d.arrow(F.lit(0.0))) == "level"
    text = one(spark, d.provenance(F.lit("extracted"), F.lit(0.9), F.lit("Cash"), F.lit("1,000"), F.lit(2), F.lit(True)))
    assert text.splitlines() == ["Caption: Cash", "Printed as: 1,000", "Page 2", "Source: read from the document, confidence 90%", "Digits were repaired."]


def test_health():
    from tallyframe.config import Config, health

    assert health(Config())["status"] == "ok" and health()["upload_limit"] == 15 * 1024 * 1024


WORN = st.tuples(st.sampled_from([s for c in CONCEPTS for s in c["synonyms"]]), st.integers(0, 60), st.sampled_from(["", "z", "qq", "total"]), st.sampled_from(["", "x", "funds", "payable"]), st.integers(0, 3))


def damaged(synonym, at, before, after, kind):
    k = at % len(synonym)
    return before + {0: synonym, 1: synonym[:k] + "7" + synonym[k + 1 :], 2: synonym[:k] + synonym[k + 1 :], 3: synonym[:k] + "71" + synonym[k + 2 :]}[kind] + after


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(WORN, st.sampled_from([None, "", "assets", "liabilities", "equity"])), min_size=30, max_size=60))
def test_classify_equals_comparison_with_all_synonyms(spark, rows):
    rows = [(damaged(*w), section) for w, section in rows] + [(None, None), ("", "assets"), ("zz", None), ("nothing of the kind", "equity")]
    got = captions.classify(spark.createDataFrame(rows, "bare string, section string"), bare="bare").collect()
    want = captions.classified([b or "" for b, _ in rows], [s or None for _, s in rows])
    key = lambda b, s, c, p: (b or "", s or "", c or "", round(p or 0.0, 9))
    assert sorted(key(*r) for r in got) == sorted(key(*r, *w) for r, w in zip(rows, want, strict=True))


def test_normal_forms_are_made_of_distinct_texts(spark):
    """No caption is normalised in the pass over all captions, nor twice among the distinct ones; missing labels and sections, and those that mean the same, keep their rows."""
    rows = [("a) Trade Payables", "liabilities"), ("Trade  payables", "liabilities"), ("Trade payables", None), ("Trade payables", ""), ("x", None), ("", "assets"), (None, "assets"), (None, None)]
    made, settled = [], captions.settled
    captions.settled = lambda df, name: made.append(df) or settled(df, name)
    try:
        got = captions.classify(spark.createDataFrame(rows * 40, "label string, section string"))
    finally:
        captions.settled = settled
    times = [df._jdf.queryExecution().optimizedPlan().toString().count(captions.MARKER) for df in (got, *made)]
    assert times[0] == 0 and max(times) <= 2
    by = {tuple(r)[:2]: (r["count"], r["concept"], r["label_score"]) for r in got.groupBy("label", "section", "concept", "label_score").count().collect()}
    assert set(by) == set(rows) and {n for n, _, _ in by.values()} == {40}
    want = captions.classified(["tradepayables"] * 4 + ["x", "", "", ""], [s or None for _, s in rows])
    assert [by[r][1] for r in rows] == [c for c, _ in want] and all(abs((by[r][2] or 0) - (p or 0)) < 1e-9 for r, (_, p) in zip(rows, want, strict=True))


@given(st.lists(WORN, min_size=1, max_size=20))
def test_a_piece_is_left_whole(found):
    """Every synonym within its tolerance of a part of a text shares a piece with it."""
    texts = [damaged(*w) for w in found]
    far = captions.substring_distances(texts, captions._SYNONYMS)
    for t, own in zip(texts, far, strict=True):
        near = [s for s, d in zip(captions._SYNONYMS, own, strict=True) if d <= captions.tolerance(len(s))]
        assert near and all(any(x in t for x in captions.pieces(s)) for s in near)
        assert captions.pair_distances([t] * len(own), captions._SYNONYMS).tolist() == own.tolist()


def test_look_up_spreads_frequent_and_missing_keys(spark):
    """A third of the rows has one key and a third none; no partition of the join holds more than twice the mean."""
    from tallyframe.operators import joins

    rows = spark.range(12_000).select("id", F.when(F.col("id") % 3 == 0, "often").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 500)).alias("key"), F.lit("s").alias("section"))
    table = spark.createDataFrame([("often", "s", 1, "a"), *((f"k{i}", "s", i, None) for i in range(0, 500, 2)), ("unused", "s", 5, "b")], "key string, section string, v int, w string")
    often = joins.frequent(rows.groupBy("key", "section").count().filter("key is not null"), ["key", "section"])
    assert ("often", "s") in {tuple(r) for r in often.collect()}
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        some = joins.frequent(rows.groupBy("key", "section").count().filter("key is not null"), ["key", "section"], share=20)  # few enough to leave keys to the shuffle
        out = joins.look_up(rows, table, ["key", "section"], some)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) <= 2 * 12_000 / 8
        got = {r["id"]: (r["v"], r["w"]) for r in out.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    key = lambda i: "often" if i % 3 == 0 else f"k{i % 500}" if i % 3 == 1 else None
    known = {r["key"]: (r["v"], r["w"]) for r in table.collect()}
    assert got == {i: known.get(key(i), (None, None)) for i in range(12_000)}
