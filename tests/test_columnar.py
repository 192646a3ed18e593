"""Pages in columns against layout's own functions, a page at a time."""

import time
from itertools import groupby

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.operators import columnar, layout
from tallyframe.plans import texts

_FIELDS = ("doc_id", "page", "page_name", "page_width", "page_height", *layout.FIELDS)
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]


def batch(tokens):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*tokens, strict=True), _TYPES, strict=True)], _FIELDS)


@pytest.fixture(scope="module")
def kinds(spark):
    return layout._arrow(layout.PAGE, spark.range(1))[5:]


def plainly(tokens):
    """What pages() is to make, by layout's functions for one page."""
    out = []
    for _, own in groupby(tokens, key=lambda t: t[:2]):
        own = list(own)
        rows, columns = layout.read_page([t[5:] for t in own], own[0][1] or 1, own[0][3])
        at, offset = {id(r): i for i, r in enumerate(rows)}, layout.vertical_offset(rows)
        matched = {at[id(a)]: (at[id(b)] if b else None, sure) for a, b, sure in layout.align(rows, offset)}
        lines = []
        for i, r in enumerate(rows):
            cells = [{"column_index": c.column, "value": c.value, "confidence": c.confidence, "repaired": c.repaired, "raw": c.raw, "x": c.x, "width": c.width} for c in r.cells]
            seq, sure = matched.get(i, (None, 0.0))
            words = [{"text": t[0], "x": t[1], "width": t[2]} for t in r.tokens]
            lines.append({"row_seq": i, "y": r.y, "label": r.label, "label_start": r.start, "label_end": r.end, "text": " ".join(t[0] for t in r.tokens), "words": words, "cells": cells, "value_seq": seq, "sure": sure})
        out.append((lines, columns, offset))
    return out


def in_columns(tokens, kinds, size=7):
    """The same through columnar, in batches of so many tokens."""
    whole = batch(tokens)
    out = []
    for own in columnar.whole_pages(whole.slice(i, size) for i in range(0, len(tokens), size)):
        whose, made = columnar.page_rows(columnar.Pages(own), kinds)
        assert whose.tolist() == list(range(len(made[0])))
        out += zip(*(m.to_pylist() for m in made), strict=True)
    return out


_TEXT = st.sampled_from([
    "Cash", "Trade  payables", " Stock:", "Stock:", " Equity and liabilities", "ASSETS", "ſhareholderſ funds", "Shareholder's funds", "iv)", "x" * 95, "", "   ", None, "İt\x1cem", "a\tb",
    "1,234", "12,34,567", "1,23", "12", "2024", "54321", "(9,876)", "(9,876", "4,321-", "l,234", "1.43.80", "7%", "tOl", "12,345.50", "₹ 1,000", "—", "9" * 19, "1,000,000,000,000,000,000", "100", "99", "12,34,56,7", "1 234", "٣,٣٣٣",
])
_TOKEN = st.tuples(_TEXT, st.sampled_from([0, 20, 60, 66, 300, 340, 345, 400, 402, 430, 450.25]), st.sampled_from([0.1, 0.2, 0.7, 3, 7, 12, 24, 26, 31.3, 40, 693.1]), st.sampled_from([0, 4, 6, 18, 48, 50.3]), st.sampled_from([0, 1.5, 8, 8, 8, 30]), st.sampled_from([False, True, None]))
_PAGE = st.tuples(st.sampled_from([None, "a", "b"]), st.sampled_from([None, 1, 2]), st.sampled_from([150.0, 595.0, 840.3]), st.lists(_TOKEN, min_size=1, max_size=40))


@settings(max_examples=1500, deadline=None)
@given(st.lists(_PAGE, min_size=1, max_size=5, unique_by=lambda p: p[:2]), st.integers(1, 50))
def test_as_page_by_page(kinds, pages, size):
    tokens = [(doc, page, None, width, 842.0, i, t[0], float(t[1]), float(t[2]), float(t[3]), float(t[4]), t[5]) for doc, page, width, own in pages for i, t in enumerate(own)]
    want = plainly(tokens)
    assert in_columns(tokens, kinds, size) == want


_LINE = st.tuples(st.sampled_from([2.0, 7.0, 10.0, 12.0, 13.0, 24.0]), st.sampled_from(["Cash", "Stock:", "", "Equity and liabilities"]), st.sampled_from([(), ("1,234",), ("1,234", "12,34,567"), ("l,234", "5,678", "1.43.80")]), st.sampled_from([0.0, 7.0]))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(_LINE, min_size=1, max_size=20), min_size=1, max_size=4))
def test_labels_and_figures_as_page_by_page(kinds, sheets):
    """Labels that have figures of their own, and labels that compete for them."""
    tokens = []
    for k, lines in enumerate(sheets):
        y = 700.0
        for i, (step, label, figures, lower) in enumerate(lines):
            y -= step
            own = [(label, 60.0, y, 40.0), *((t, 380.0 + 70 * j - 6 * len(t), y - lower, 6.0 * len(t)) for j, t in enumerate(figures))]
            tokens += [(f"d{k}", 1, None, 595.0, 842.0, 10 * i + j, *t, 8.0, False) for j, t in enumerate(own)]
    assert in_columns(tokens, kinds, 100) == plainly(tokens)


def test_a_batch_is_given_out_when_its_pages_end(kinds):
    """Long pages aren't gathered: each is given out once the next begins, however few pages that makes."""
    tokens = [(f"d{k}", 1, None, 595.0, 842.0, i, "Cash", 60.0, -20.0 * i, 24.0, 8.0, False) for k in range(4) for i in range(300)]
    taken = []

    def some():
        for i in range(0, len(tokens), 100):
            taken.append(i)
            yield batch(tokens[i : i + 100])

    seen = [(len(taken), own.num_rows) for own in columnar.whole_pages(some())]
    assert seen == [(4, 300), (7, 300), (10, 300), (12, 300)]


def test_many_small_pages_are_quick(kinds):
    """20,000 pages of 7 lines: the loop over dictionaries took some 40 microseconds a token."""
    tokens = []
    for k in range(2_000):
        for i in range(7):
            y = 700.0 - 24 * i
            tokens += [(str(k), 1, None, 595.0, 842.0, 10 * i + j, w, 60.0 + 70 * j, y, 30.0, 8.0, False) for j, w in enumerate(("plain", "steel", "brass"))]
            tokens += [(str(k), 1, None, 595.0, 842.0, 10 * i + 5, f"1,{i:02},{k % 900 + 100}", 402.0, y, 48.0, 8.0, False), (str(k), 1, None, 595.0, 842.0, 10 * i + 6, "2,34,567", 492.0, y, 48.0, 8.0, False)]
    own = batch(tokens)
    began = time.perf_counter()
    for _ in range(10):
        columnar.page_rows(columnar.Pages(own), kinds)
    assert (time.perf_counter() - began) / (10 * len(tokens)) < 12e-6


def test_runs_as_page_by_page():
    tokens = [("a", 1, None, 595.0, 842.0, i, t, float(x), 700.0, float(w), 8.0, False) for i, (t, x, w) in enumerate([("79,88,10,63", 0, 60), ("I", 62, 6), ("and", 80, 10), ("1,000", 91, 30), ("2,000", 191, 30)])]
    whose, (row, text, x, width) = columnar.run_rows(columnar.Pages(batch(tokens)), [pa.int32()])
    want = layout.stitch([(t[6], t[7], t[9], False) for t in tokens], layout.stitch_gap(595.0))
    assert whose.tolist() == [0, 0, 0] and list(zip(text.to_pylist(), x.to_pylist(), width.to_pylist())) == [t[:3] for t in want]


def test_bundles_as_tokens(spark):
    """Tokens in bundles, of which some tell the size and the baseline for all of theirs, make the pages that single tokens make."""
    lines = [(d, 1, 400.0, [(10 * k + i, t, 60.0 + 170 * i, 8.0 * len(t)) for i, t in enumerate(own)], 700.0 - 24 * k) for d, pages in (("a", ["Cash 1,234 5,678", "Stock 12,34,567 9,876", "x"]), (None, ["", "Equity 4,321"])) for k, own in enumerate(p.split(" ") for p in pages)]
    bundles = spark.createDataFrame(lines[::-1], "doc_id string, page int, page_width double, tokens array<struct<token_seq:int,text:string,x:double,width:double>>, y double").selectExpr("*", "8D AS height", "false AS is_numeric")
    single = bundles.selectExpr("doc_id", "page", "page_width", "y", "height", "is_numeric", "inline(tokens)")
    made = [sorted(layout.pages(t, **k).collect(), key=repr) for t, k in ((single, {}), (bundles, {}), (bundles.repartition("doc_id"), {"dealt": True}))]
    assert len(made[0]) == 2 and made[0] == made[1] == made[2]


@pytest.mark.parametrize("name", ["sheet_cells", "align_monotonic_tight", "align_monotonic", "skew_offset", "row_cluster", "period_ids", "row_labels", "value_columns", "cell_assignment", "cell_choice", "numeric_stitch"])
def test_tokens_are_not_dealt(spark, name):
    """Line items are dealt by part and by order; what is made of them isn't dealt a third time before pages are laid out."""
    below = texts.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
    assert "Repartition" not in below and "explode" not in below


def test_filings_in_lines(spark):
    """A filing's line is dealt as one row, with its caption and both figures."""
    lines = texts.filing_lines(spark, "/root/testdata/sf0.001").selectExpr("size(tokens) AS n").groupBy("n").count().collect()
    assert {r["n"] for r in lines} == {1, 3} and sum(r["n"] * r["count"] for r in lines) == texts.filings(spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("only", [("words",), ("columns",), ("offset",), ("row_seq", "label", "cells"), layout.ALIGNED])
def test_what_is_wanted_of_pages(spark, only):
    """Pages hold what is asked for alone, as whole pages have it; nothing else is worked out."""
    tokens = texts.token_lines(spark, "/root/testdata/sf0.001", skew=7.0, spacing=12.0).filter("doc_id < '2'")
    made, whole = (sorted(layout.pages(tokens, **k).collect(), key=lambda r: r["doc_id"]) for k in ({"only": only}, {}))
    fields = [f for f in only if f not in ("columns", "offset")]
    assert made and len(made) == len(whole) and set(made[0].asDict()) == {"doc_id", "page", "page_name", "page_width", "page_height", *({"lines"} if fields else ()), *(set(only) - set(fields))}
    for a, b in zip(made, whole, strict=True):
        assert all(a[c] == b[c] for c in ("columns", "offset") if c in only)
        assert not fields or [{f: x[f] for f in fields} for x in b["lines"]] == [x.asDict() for x in a["lines"]]


def test_unwanted_parts_are_not_worked_out(spark):
    own = columnar.Pages(batch([("a", 1, None, 595.0, 842.0, 0, "Cash", 60.0, 700.0, 24.0, 8.0, False)]))
    columnar.page_rows(own, layout._arrow(layout._pruned(("words",)), spark.range(1))[5:])
    assert not {"runs", "columns", "labels", "cells", "matches"} & set(vars(own))
    with pytest.raises(ValueError, match="pages have no word$"):
        layout.pages(spark.createDataFrame([], layout.TOKENS), only=("word", "y"))


@pytest.mark.parametrize("name", ["sheet_cells", "align_monotonic_tight", "align_monotonic", "skew_offset", "row_cluster", "period_ids", "row_labels", "value_columns", "cell_assignment", "cell_choice", "numeric_stitch"])
def test_lines_in_order_are_not_sorted_again(spark, name):
    """Line items are sorted as they are numbered; pages take them in that order."""
    below = texts.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
    assert "Window" in below and "Sort" not in below


@pytest.mark.parametrize("n", [0, 7, 999, 1000, 99_999, 100_000, 9_999_999, 10_000_000, 999_999_999, 10**9, 12**15, -1, -1234, -1234567, None])
def test_indian_groups(spark, n):
    from tallyframe.functions import amounts

    got = spark.createDataFrame([(n,)], "n long").select(texts.indian(texts.F.col("n"))).first()[0]
    assert got == (None if n is None else ("-" if n < 0 else "") + amounts.indian_groups(abs(n)))
