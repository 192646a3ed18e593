"""Geometry of pages against plain versions, and of long ones."""

import random
import time
from math import exp, inf
from statistics import fmean

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.operators import layout
from tallyframe.operators.layout import Cell, Row


def align_by_force(rows, offset):
    """The best total score over a whole table of labels and figures."""
    labels, figures = [r for r in rows if r.label.strip()], [r for r in rows if r.cells]
    fit = [[exp(-0.5 * ((a.y - b.y - offset) / 5.0) ** 2) * (0.55 + 0.45 * layout.leaf_score(a.label)) if -6 <= a.y - b.y <= 26 else -inf for b in figures] for a in labels]
    table, came = [[-0.75 * j for j in range(len(figures) + 1)]], []
    for own in fit:
        line, steps = [0.0], [0]
        for j in range(1, len(figures) + 1):
            score, step = table[-1][j], 0
            if line[j - 1] - 0.75 > score + 1e-9:
                score, step = line[j - 1] - 0.75, 1
            if table[-1][j - 1] + own[j - 1] > score + 1e-9:
                score, step = table[-1][j - 1] + own[j - 1], 2
            line.append(score)
            steps.append(step)
        table.append(line)
        came.append(steps)
    i, j, chosen = len(labels), len(figures), {}
    while i and j:
        k = came[i - 1][j]
        if k == 2:
            chosen[i - 1] = j - 1
        i, j = i - (k != 1), j - (k != 0)
    out = [(a, figures[chosen[i]], 0.6 * min(1.0, fit[i][chosen[i]]) + 0.4 * fmean(c.confidence for c in figures[chosen[i]].cells)) if i in chosen else (a, None, 0.0) for i, a in enumerate(labels)]
    return out, table[-1][-1]


def row(y, label, *values, sure=1.0):
    return Row(y, 1, [], label, [Cell(i, v, sure, False, str(v), 400.0, 45.0) for i, v in enumerate(values)])


LINE = st.tuples(st.sampled_from([0.5, 1, 2, 3, 5, 7, 12, 14, 24, 40]), st.sampled_from(["", "Cash", "Equity and liabilities", "Stock:", "x" * 95]), st.sampled_from([(), (1.0,), (1.0, 2.0)]))


@settings(max_examples=400, deadline=None)
@given(st.lists(LINE, max_size=25), st.sampled_from([0.0, 7.0, 8.5]))
def test_align_by_force(lines, offset):
    """Steps of few sizes, so that scores tie."""
    y, rows = 700.0, []
    for step, label, values in lines:
        y -= step
        rows.append(row(y, label, *values))
    got, (want, _) = layout.align(rows, offset), align_by_force(rows, offset)
    assert [(id(a), id(b) if b else None) for a, b, _ in got] == [(id(a), id(b) if b else None) for a, b, _ in want]
    assert [c for *_, c in got] == pytest.approx([c for *_, c in want])


def test_align_of_a_long_sheet():
    """100,000 rows, figures 7 below their labels and some labels without: linear in rows."""
    rng, rows = random.Random(1), []
    for i in range(100_000):
        rows.append(row(-20.0 * i, f"item {i}"))
        if rng.random() < 0.9:
            rows.append(row(-20.0 * i - 7, "", float(i)))
    began = time.perf_counter()
    got = layout.align(rows, 7.0)
    assert time.perf_counter() - began < 20
    assert all(b is None or b.cells[0].value == i for i, (_, b, _) in enumerate(got)) and sum(b is not None for _, b, _ in got) == len(rows) - 100_000


def test_read_page_of_a_long_sheet():
    """Rows, columns and cells of 50,000 lines with two figures, one of them between the columns of others."""
    tokens = []
    for i in range(50_000):
        y = -20.0 * i
        tokens += [(4 * i, f"item{i}", 60.0, y, 40.0, 8.0, False), (4 * i + 1, "1,23,456", 402.0, y, 48.0, 8.0, False), (4 * i + 2, "7,65,432", 492.0 - (i % 1000 == 0) * 20, y, 48.0, 8.0, False)]
    began = time.perf_counter()
    rows, columns = layout.read_page(tokens, 1, 595.0)
    assert time.perf_counter() - began < 60 and len(rows) == 50_000
    assert [(c["right_edge"], c["support"]) for c in columns] == [(450.0, 50_000), (540.0, 50_000)] and [c.value for c in rows[7].cells] == [123456, 765432]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(300, 560)), min_size=1, max_size=30))
def test_columns_and_cells_by_force(places):
    """Value columns by means made anew for each edge, and cells by comparing with each column."""
    tokens = [(i, "1,23,456", float(right - 48), 700.0 - 20 * line, 48.0, 8.0, False) for i, (line, right) in enumerate(sorted(set(places)))]
    rows = layout.build_rows(tokens)
    got = layout.value_columns(rows, 595.0)
    edges = sorted((right, left) for r in rows for left, right, _ in layout.amounts_in(r.tokens, 595.0))
    groups = []
    for edge in edges:
        if groups and edge[0] - sum(r for r, _ in groups[-1]) / len(groups[-1]) <= max(8.0, 0.035 * 595):
            groups[-1].append(edge)
        else:
            groups.append([edge])
    least = 3 if len(edges) >= 8 else 2
    kept = [g for g in groups if len(g) >= least] or groups
    assert [c["support"] for c in got] == ([len(g) for g in kept] if len(edges) >= 2 else [])
    layout.assign_cells(rows, got, 595.0)
    for r in rows:
        for c in r.cells:
            right = c.x + c.width
            assert c.column == min((abs(x["right_edge"] - right), x["column_index"]) for x in got)[1]
