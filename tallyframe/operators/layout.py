"""Page geometry: rows from baselines, value columns from right edges, cells, and labels matched with figures.

These steps depend on order (running means, a dynamic program), so pages are streamed through Arrow batches, a batch's pages at a
time (columnar): `pages` makes one row of each page, with its rows and value columns as arrays. All that doesn't depend on order is left to
built-in operators over those. A page is bounded in size; a document isn't needed in one place. Distances scale with the page's width.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import exp
from operator import itemgetter
from statistics import fmean, median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import SHAPE, is_amount, parse_amount

_SHAPE = re.compile(SHAPE)
#: Tokens. The page's size is told by each of its tokens; a token without text only tells that the page is there.
TOKENS = "doc_id string, page int, token_seq int, text string, x double, y double, width double, height double, is_numeric boolean, page_width double, page_height double, page_name string"
#: The size of a page that isn't told: A4, in points.
PAGE_SIZE = (595.0, 842.0)


def stitch_gap(width: float) -> float:
    return min(10.0, max(4.0, 0.012 * width))


@dataclass
class Cell:
    column: int
    value: float
    confidence: float
    repaired: bool
    raw: str
    x: float
    width: float


@dataclass
class Row:
    y: float
    page: int
    tokens: list[tuple]  # text, x, width, is_numeric
    label: str = ""
    cells: list[Cell] = field(default_factory=list)
    start: float = 0.0  # of the label
    end: float = 0.0


def build_rows(tokens: list[tuple], page: int = 1) -> list[Row]:
    """Rows of a page, of tokens (token_seq, text, x, y, width, height, is_numeric): a token joins the last row if its baseline is near the row's running mean."""
    kept = sorted(((t[0], t[1].strip(), *t[2:]) for t in tokens if t[1] and t[1].strip()), key=lambda t: (-t[3], t[2], t[0]))
    heights = [t[5] for t in kept if t[5] > 0]
    near = max(2.5, 0.6 * (median(heights) if heights else 8.0))
    rows: list[list] = []
    mean = 0.0
    for t in kept:
        if rows and abs(mean - t[3]) <= near:
            rows[-1].append(t)
            mean += (t[3] - mean) / len(rows[-1])
        else:
            rows.append([t])
            mean = t[3]
    out = []
    for own in rows:
        own.sort(key=lambda t: t[2])
        out.append(Row(sum(t[3] for t in own) / len(own), page, [(t[1], t[2], t[4], bool(t[6])) for t in own]))
    return out


def stitch(tokens: list[tuple], gap: float) -> list[tuple[str, float, float, bool]]:
    """Runs of number-like tokens that stand close together, as one text each: text, x, width, whether a part is a declared number."""
    out: list[tuple[str, float, float, bool]] = []
    open_ = False
    for text, x, width, numeric in tokens:
        if not _SHAPE.match(text):
            open_ = False
            continue
        if open_ and x - (out[-1][1] + out[-1][2]) <= gap:
            before = out.pop()
            text, x, width, numeric = before[0] + text, before[1], x + width - before[1], before[3] or numeric
        out.append((text, x, width, numeric))
        open_ = True
    return out


def amounts_in(tokens: list[tuple], width: float) -> Iterator[tuple[float, float, tuple]]:
    """Left edge, right edge and parsed amount of each run that is one: by its shape, or a declared number of 100 or more or with a fraction."""
    for text, x, w, numeric in stitch(tokens, stitch_gap(width)):
        shaped = is_amount(text)
        parsed = parse_amount(text) if shaped or numeric else None
        if parsed and (shaped or abs(parsed[0]) >= 100 or parsed[0] != int(parsed[0])):
            yield x, x + w, parsed


def value_columns(rows: list[Row], width: float) -> list[dict]:
    """Value columns of a page: right_edge (median), left, right, support. Right edges are gathered, from left to right, while they stay near the running mean."""
    edges = sorted((right, left) for r in rows for left, right, _ in amounts_in(r.tokens, width))
    return [{"column_index": i, "right_edge": e, "left": left, "right": right, "support": n} for i, (e, left, right, n) in enumerate(gathered([r for r, _ in edges], [x for _, x in edges], width))]


def gathered(edges: list[float], lefts: list[float], width: float) -> list[tuple[float, float, float, int]]:
    """right_edge, left, right, support of the columns that amounts in order of their right edges make."""
    if len(edges) < 2:
        return []
    near, cuts, total, n = max(8.0, 0.035 * width), [0], edges[0], 1
    for i in range(1, len(edges)):
        if edges[i] - total / n > near:
            cuts.append(i)
            total, n = 0.0, 0
        total += edges[i]
        n += 1
    groups = list(zip(cuts, [*cuts[1:], len(edges)]))
    supported = [(i, j) for i, j in groups if j - i >= (3 if len(edges) >= 8 else 2)] or groups
    middle = lambda i, j: edges[(i + j) // 2] if (j - i) % 2 else (edges[(i + j) // 2 - 1] + edges[(i + j) // 2]) / 2
    return sorted(((middle(i, j), min(lefts[i:j]), edges[j - 1], j - i) for i, j in supported), key=itemgetter(0))


def assign_cells(rows: list[Row], columns: list[dict], width: float) -> None:
    """Splits each row into a label, left of the value columns, and cells; a cell goes to the nearest right edge, the surest one stays."""
    edge = min((c["left"] for c in columns), default=width + 4) - 4
    reach, edges = max(12.0, 0.05 * width), [c["right_edge"] for c in columns]  # from left to right
    for row in rows:
        named = [t for t in row.tokens if t[1] < edge]
        row.label = " ".join(" ".join(t[0] for t in named).split())
        row.start = named[0][1] if named else row.tokens[0][1] if row.tokens else 0.0
        row.end = named[-1][1] + named[-1][2] if named else row.start
        found: dict[int, list[Cell]] = {}
        for left, right, (value, sure, repaired, raw) in amounts_in([t for t in row.tokens if t[1] >= edge], width) if columns else ():
            k = bisect_left(edges, right)
            far, at = min((abs(edges[i] - right), bisect_left(edges, edges[i])) for i in (k - 1, k) if 0 <= i < len(edges))
            if far <= reach:
                found.setdefault(at, []).append(Cell(at, value, sure, repaired, raw, left, right - left))
        row.cells = [max(found[at], key=lambda c: c.confidence) for at in sorted(found)]


# Captions that head a group rather than name a figure.
_HEADINGS = [
    r"^\(?[ivx]+\)?[\s.)-]*$", r"equity\s*and\s*liabilit", r"^\s*assets\s*$", r"^\s*liabilities\s*$", r"shareholder'?s?\s*funds?", r"^\d?\s*[).]?\s*(non[-\s]?current|current)\s+(assets|liabilities)\s*$",
    r"^particulars\b", r"^note\s*no", r"^sr\.?\s*no", r"^total\s+outstanding\s+dues",
]
_HEADING = re.compile("|".join(_HEADINGS), re.I | re.A)
NEAR_Y, SIGMA, DROP = (-6.0, 26.0), 5.0, 0.75
#: Scores this near tie; steps of the table of best scores.
EQUAL = 1e-9
LABEL_ALONE, FIGURES_ALONE, MATCHED = range(3)


def leaf_score(label: str) -> float:
    """How likely a row is to name a figure."""
    text = label.strip()
    if not text:
        return 0.1
    if _HEADING.search(text):
        return 0.25
    return 0.3 if len(text) > 90 else 0.5 if text.endswith(":") else 1.0


def vertical_offset(rows: list[Row]) -> float:
    """By how much figures stand below their labels: the median over rows with figures alone."""
    last, seen = None, []
    for r in rows:
        if r.label:
            last = r.y
        elif r.cells and last is not None and NEAR_Y[0] <= last - r.y <= NEAR_Y[1]:
            seen.append(last - r.y)
    return median(seen) if seen else 0.0


def align(rows: list[Row], offset: float | None = None) -> list[tuple[Row, Row | None, float]]:
    """Each labelled row with at most one row of figures, in reading order, by the best total score; and how sure that is.

    rows: from the top down. A label can only match the figures of a band of NEAR_Y, so only the band's part of the table of
    best scores is made: `best` is its last line, which later labels overwrite, and the steps of each band are kept for the way
    back. That takes a page's rows times the rows of a band. Scores count DROP for each row of figures that is matched, which is
    the same as taking it from each that isn't. Scores within EQUAL tie; then a label is rather left alone than a row of figures,
    and either rather than matched.
    """
    offset = vertical_offset(rows) if offset is None else offset
    labels, figures = [r for r in rows if r.label.strip()], [r for r in rows if r.cells]
    depth = [-b.y for b in figures]
    best = [0.0] * (len(figures) + 1)  # by the number of figures that are left: the best score of the labels so far
    far = 0  # figures beyond it are in no band yet, so best[far] holds for them
    bands: list[tuple[int, int, bytearray, bool]] = []
    fits: list[list[float]] = []
    for a in labels:
        low, high = bisect_left(depth, NEAR_Y[0] - a.y), bisect_right(depth, NEAR_Y[1] - a.y)
        weight = 0.55 + 0.45 * leaf_score(a.label)
        fit = [exp(-0.5 * ((a.y - b.y - offset) / SIGMA) ** 2) * weight for b in figures[low:high]]
        if high > far:
            best[far + 1 : high + 1] = [best[far]] * (high - far)
            far = high
        before, steps, top = best[low], bytearray(), best[far]
        for j, own in enumerate(fit, low + 1):
            above = best[j]
            score, step = above, LABEL_ALONE
            if best[j - 1] > score + EQUAL:
                score, step = best[j - 1], FIGURES_ALONE
            if before + own + DROP > score + EQUAL:
                score, step = before + own + DROP, MATCHED
            before, best[j] = above, score
            steps.append(step)
        fits.append(fit)
        bands.append((low, far, steps, best[far] > top + EQUAL))
    chosen: dict[int, int] = {}
    j = len(figures)
    for i in range(len(labels) - 1, -1, -1):
        low, high, steps, gained = bands[i]
        if j > high:
            if not gained:
                continue
            j = high
        while j > low and steps[j - low - 1] == FIGURES_ALONE:
            j -= 1
        if j > low and steps[j - low - 1] == MATCHED:
            chosen[i] = j - 1
            j -= 1
    out = []
    for i, a in enumerate(labels):
        if i not in chosen:
            out.append((a, None, 0.0))
            continue
        b = figures[chosen[i]]
        out.append((a, b, 0.6 * max(0.0, min(1.0, fits[i][chosen[i] - bands[i][0]])) + 0.4 * fmean(c.confidence for c in b.cells)))
    return out


def read_page(tokens: list[tuple], page: int, width: float) -> tuple[list[Row], list[dict]]:
    rows = build_rows(tokens, page)
    columns = value_columns(rows, width)
    assign_cells(rows, columns, width)
    return rows, columns


FIELDS = ("token_seq", "text", "x", "y", "width", "height", "is_numeric")
CELL = "struct<column_index:int,value:double,confidence:double,repaired:boolean,raw:string,x:double,width:double>"
PAGE = f"""doc_id string, page int, page_name string, page_width double, page_height double,
lines array<struct<row_seq:int,y:double,label:string,label_start:double,label_end:double,text:string,words:array<struct<text:string,x:double,width:double>>,cells:array<{CELL}>,value_seq:int,sure:double>>,
columns array<struct<column_index:int,right_edge:double,left:double,right:double,support:int>>, offset double"""


def sized(tokens: DataFrame) -> DataFrame:
    """tokens with the page's size and name, the usual size where none is told."""
    usual = {"page_width": F.lit(PAGE_SIZE[0]), "page_height": F.lit(PAGE_SIZE[1]), "page_name": F.lit(None).cast("string")}
    return tokens.withColumns({k: F.coalesce(k, v) if k in tokens.columns else v for k, v in usual.items()})


def by_page(tokens: DataFrame, schema: str, rows_of: Callable, dealt: bool = False, ordered: bool = False) -> DataFrame:
    """Runs a function over whole pages in columns. Pages are sorted within partitions and streamed: a task holds an Arrow batch of them at a time, or one long page.

    tokens: a row for each, or for each bundle of a page's tokens that follow each other: an array `tokens`, in order of token_seq. What
    a bundle's tokens have in common may stand beside the array. A bundle is dealt and sorted as one row. dealt: each page's rows are
    in one partition already. ordered: they are, one page after another and in order of token_seq, so they aren't sorted either.
    rows_of: of columnar.Pages and the types of its columns, the page of each row, by place, and the columns. The result has doc_id,
    page, page_name, page_width and page_height before these.
    """
    names = [x.split()[0] for x in _split(schema)]
    kinds = _arrow(schema, tokens)
    key = ("doc_id", "page", "page_name", "page_width", "page_height")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import columnar

        for batch in columnar.whole_pages(columnar.unbundled(batches, FIELDS)):
            own = columnar.Pages(batch)
            whose, made = rows_of(own, kinds[len(key) :])
            at = pa.array(own.first[whose])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in key), *made], names)

    first = F.col("tokens")[0]["token_seq"] if "tokens" in tokens.columns else F.col("token_seq")
    rows = sized(tokens).select(*key, *(c for c in ("tokens", *FIELDS) if c in tokens.columns))
    rows = rows if dealt or ordered else rows.repartition("doc_id", "page")
    return (rows if ordered else rows.sortWithinPartitions("doc_id", "page", first)).mapInArrow(run, schema)


def _split(schema: str) -> list[str]:
    """The fields of a flat or nested schema text."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _arrow(schema: str, some: DataFrame) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in some.sparkSession.createDataFrame([], schema).schema]


def pages(tokens: DataFrame, dealt: bool = False, ordered: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """tokens to a row for each page: its lines (labels, words, cells, and the line whose figures are theirs) in reading order, its value columns, and by how much figures stand below labels. Blank tokens are left out.

    tokens: one by one or in bundles; dealt, ordered: each page's are in one partition already, or in order there as well (by_page).
    only: what is wanted of a page: fields of lines, "columns", "offset"; the rest is neither worked out nor brought back.
    """
    from .columnar import page_rows

    return by_page(tokens, PAGE if only is None else _pruned(only), page_rows, dealt, ordered)


def _pruned(only: tuple[str, ...]) -> str:
    """PAGE with those of its columns and of its lines' fields that are told."""
    key, (lines, *rest) = _split(PAGE)[:5], _split(PAGE)[5:]
    fields = _split(lines[len("lines array<struct<") : -2])
    own = [f for f in fields if f.split(":")[0] in only]
    if unknown := set(only) - {f.split(":")[0] for f in fields} - {c.split()[0] for c in rest}:
        raise ValueError(f"pages have no {', '.join(sorted(unknown))}")
    return ", ".join([*key, *([f"lines array<struct<{','.join(own)}>>"] if own else []), *(c for c in rest if c.split()[0] in only)])


def page_lines(read: DataFrame) -> DataFrame:
    """read: as pages() makes it. A row for each line: doc_id, page, row_seq, y, label, label_start, label_end, text, words, cells."""
    return read.select("doc_id", "page", F.explode("lines").alias("l")).select("doc_id", "page", "l.*")


def page_columns(read: DataFrame) -> DataFrame:
    """read: as pages() makes it. doc_id, page, column_index, right_edge, left, right, support."""
    return read.select("doc_id", "page", F.explode("columns").alias("c")).select("doc_id", "page", "c.*")


def page_offsets(read: DataFrame) -> DataFrame:
    """read: as pages() makes it. doc_id, page, offset, of pages with a labelled line."""
    return read.filter(F.exists("lines", lambda x: x["label"] != "")).select("doc_id", "page", "offset")


def runs(tokens: DataFrame, dealt: bool = False, ordered: bool = False) -> DataFrame:
    """doc_id, page, row_seq, text, x, width: the runs of number-like tokens of each line."""
    from .columnar import run_rows

    key = "doc_id string, page int, page_name string, page_width double, page_height double"
    return by_page(tokens, f"{key}, row_seq int, text string, x double, width double", run_rows, dealt, ordered).drop("page_name", "page_width", "page_height")


#: What aligned() needs of pages.
ALIGNED = ("row_seq", "y", "label", "cells", "value_seq", "sure", "offset")


def aligned(read: DataFrame) -> DataFrame:
    """read: as pages() makes it, or of ALIGNED alone. A row for each labelled line: doc_id, page, row_seq, label, y, value_seq, value_y, cells, confidence, offset."""
    own = lambda x: F.get("lines", x["value_seq"])
    # Figures are fetched within the array, so a line doesn't carry its page through the explosion.
    pairs = F.transform("lines", lambda x: F.struct(x["row_seq"].alias("row_seq"), x["label"].alias("label"), x["y"].alias("y"), x["value_seq"].alias("value_seq"), own(x)["y"].alias("value_y"), own(x)["cells"].alias("cells"), x["sure"].alias("confidence")))
    each = read.select("doc_id", "page", "offset", F.explode_outer(pairs).alias("p")).filter("p.label <> ''")
    return each.select("doc_id", "page", "p.row_seq", "p.label", "p.y", "p.value_seq", "p.value_y", F.coalesce("p.cells", F.array().cast(f"array<{CELL}>")).alias("cells"), "p.confidence", "offset")


__all__ = ["Cell", "Row", "align", "aligned", "build_rows", "page_columns", "page_lines", "page_offsets", "pages", "read_page", "runs", "stitch", "value_columns", "vertical_offset"]
