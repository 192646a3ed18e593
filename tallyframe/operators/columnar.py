"""Geometry of many pages at a time: what layout does for one page's tokens, over the columns of an Arrow batch of whole pages.

Numpy and Arrow's kernels take the frequent case; what isn't that goes through layout's own functions: runs of several tokens,
amounts in need of repair, and pages on which labels compete for figures. Results are the same to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache
from math import exp, fsum

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.amounts import CLEAN, SHAPE, is_amount, parse_amount
from . import layout

# RE2 knows no \u, and takes these as they are.
_SHAPE = SHAPE.replace("\\u00a0", "\u00a0")
_CLEAN = f"^{CLEAN}$"
#: What a joined label holds if white space within its tokens has to be looked at.
_ODD = "  |[\\x09-\\x0d\\x1c-\\x1f]|[^\\x00-\\x7f]"
#: By how much a label's best figure has to be ahead of the next for a page's matches to be plain; cells of a table of distances; figures of a band.
_AHEAD, _TABLE, _BAND = 1e-3, 4_000_000, 64


def starts(batch: pa.RecordBatch, before: tuple | None) -> np.ndarray:
    """Where pages begin. before: the key of the row before the batch."""
    new = np.zeros(batch.num_rows, bool)
    for name in ("doc_id", "page"):
        own = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= own[1:] != own[:-1]
    new[0] = before is None or key_at(batch, 0) != before
    return np.flatnonzero(new)


def key_at(batch: pa.RecordBatch, i: int) -> tuple:
    return batch.column("doc_id")[i].as_py(), batch.column("page")[i].as_py()


def unbundled(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """A row for each token, of batches whose rows hold an array of them. Fields that tokens don't have are their bundle's."""
    for batch in batches:
        if "tokens" in batch.schema.names:
            bundles = batch.column("tokens")
            each, whose = bundles.flatten(), pc.list_parent_indices(bundles)
            own = dict(zip((f.name for f in each.type), each.flatten(), strict=True))
            common = [c for c in batch.schema.names if c != "tokens" and c not in own]
            own |= {c: batch.column(c).take(whose) for c in common}
            batch = pa.RecordBatch.from_pydict({c: own[c] for c in (*(c for c in common if c not in fields), *fields)})
        yield batch


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut where pages begin, so that each has whole pages: a batch's, or one long page."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = starts(batch, before)
        before = key_at(batch, batch.num_rows - 1)
        if len(new) and (held or new[-1]):
            held.append(batch.slice(0, new[-1]))
            yield pa.concat_batches(held)
            held = []
        held.append(batch.slice(new[-1]) if len(new) else batch)
    if held:
        yield pa.concat_batches(held)


def medians(values: np.ndarray, owner: np.ndarray, n: int, none: float) -> np.ndarray:
    """The median of each of n owners' values, or `none`."""
    values, count = values[np.lexsort((values, owner))], np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    out, some = np.full(n, none), count > 0
    out[some] = (values[(first + (count - 1) // 2)[some]] + values[(first + count // 2)[some]]) / 2
    return out


def segments(values: np.ndarray, owner: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an owner's values, in ascending order, are cut by gaps wider than its `near`, and which segments may fall apart further.

    A running mean lies between its first and last value: a wider gap ends it for sure, and a segment that is no wider than `near` is one
    for sure. `tiny` covers rounding; where it isn't finite, all is left to a look at the means.
    """
    tiny = 1e-6 + 1e-9 * np.abs(values).max(initial=0.0)
    new = np.ones(len(values), bool)
    with np.errstate(invalid="ignore"):
        new[1:] = (owner[1:] != owner[:-1]) | (np.diff(values) > near[owner[1:]] + tiny)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(values))[: len(first)] - 1
        return first, ~(values[last] - values[first] <= near[owner[first]] - tiny)


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int32)


def joined(texts: pa.Array, counts: np.ndarray) -> pa.Array:
    """So many texts each, with a space between."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets(counts)), texts), " ")


@lru_cache(100_000)
def _amount(text: str, numeric: bool) -> tuple | None:
    shaped = is_amount(text)
    parsed = parse_amount(text) if shaped or numeric else None
    return parsed if parsed and (shaped or abs(parsed[0]) >= 100 or parsed[0] != int(parsed[0])) else None


class Pages:
    """Whole pages, in order. Tokens, rows, runs and amounts are arrays; `*_row` and `*_page` tell whose each is."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.first = starts(batch, None)
        self.batch, self.n = batch, len(self.first)
        self.page_width = batch.column("page_width").take(pa.array(self.first)).to_numpy(zero_copy_only=False)
        text = pc.utf8_trim_whitespace(batch.column("text"))
        kept = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(text), 0), False).to_numpy(zero_copy_only=False))
        page = np.searchsorted(self.first, kept, "right") - 1
        if any(batch.column(c).null_count and batch.column(c).take(pa.array(kept)).null_count for c in ("x", "y", "width", "height")):
            raise ValueError("a token with text has no place or size")
        x, y, width, height = (batch.column(c).to_numpy(zero_copy_only=False)[kept] for c in ("x", "y", "width", "height"))
        tall = height > 0
        near = np.maximum(2.5, 0.6 * medians(height[tall], page[tall], self.n, 8.0))
        # Tokens come in order of token_seq, which settles ties.
        order = np.lexsort((x, -y, page))
        begins = self._rows(page[order], y[order], near)
        row = np.zeros(len(order), np.int64)
        row[begins] = 1
        row = np.cumsum(row) - 1
        across = np.lexsort((x[order], row))
        order = order[across]
        self.row, self.begins = row, begins
        self.size = np.diff(np.append(self.begins, len(order)))
        self.x, self.width, self.y = x[order], width[order], y[order]
        self.text = text.take(pa.array(kept[order]))
        self.numeric = pc.fill_null(batch.column("is_numeric"), False).to_numpy(zero_copy_only=False)[kept[order]]
        self.row_page = page[order][self.begins]
        self.page_rows = np.bincount(self.row_page, minlength=self.n)
        self.row_seq = np.arange(len(self.begins)) - (np.cumsum(self.page_rows) - self.page_rows)[self.row_page]

    @staticmethod
    def _rows(page: np.ndarray, y: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Where rows begin, as layout.build_rows has them."""
        first, loose = segments(-y, page, near)
        more, ends = [], np.append(first[1:], len(y))
        for i, end, far in zip(first[loose].tolist(), ends[loose].tolist(), near[page[first[loose]]].tolist()):
            mean, n = 0.0, 0
            for at, own in enumerate(y[i:end].tolist(), i):
                if n and abs(mean - own) <= far:
                    n += 1
                    mean += (own - mean) / n
                else:
                    more.append(at)
                    mean, n = own, 1
        return np.sort(np.concatenate((first[~loose], np.array(more, np.int64))))

    @cached_property
    def row_y(self) -> np.ndarray:
        if not len(self.begins):
            return np.zeros(0)
        low, high = np.minimum.reduceat(self.y, self.begins), np.maximum.reduceat(self.y, self.begins)
        out = low * self.size / self.size
        for r in np.flatnonzero(low != high):
            out[r] = sum(self.y[self.begins[r] : self.begins[r] + self.size[r]].tolist()) / int(self.size[r])
        return out

    def tokens(self, r: int) -> list[tuple]:
        own = slice(self.begins[r], self.begins[r] + self.size[r])
        return list(zip(self.text[own].to_pylist(), self.x[own].tolist(), self.width[own].tolist(), self.numeric[own].tolist()))

    @cached_property
    def runs(self) -> dict:
        """Runs of number-like tokens: row, text, x, width, numeric, and last, where their last token starts."""
        own = np.flatnonzero(pc.match_substring_regex(self.text, _SHAPE).to_numpy(zero_copy_only=False))
        gap = np.minimum(10.0, np.maximum(4.0, 0.012 * self.page_width))[self.row_page]
        beside = (np.diff(own) == 1) & (self.row[own[1:]] == self.row[own[:-1]])
        # An end is told as a start and a width, which may be off by rounding: layout.stitch has the last word.
        close = beside & (self.x[own[1:]] - (self.x[own[:-1]] + self.width[own[:-1]]) <= gap[self.row[own[1:]]] + 1e-6)
        several = np.zeros(len(self.begins), bool)
        several[self.row[own[1:][close]]] = True
        own = own[~several[self.row[own]]]
        made = {"row": self.row[own], "text": self.text.take(pa.array(own)), "x": self.x[own], "width": self.width[own], "numeric": self.numeric[own], "last": self.x[own]}
        return self._with(made, [(r, self.tokens(r)) for r in np.flatnonzero(several)], gap)

    def _with(self, made: dict, rows: list[tuple[int, list[tuple]]], gap: np.ndarray) -> dict:
        """Runs, and those of other rows' tokens, in order of rows."""
        if not rows:
            return made
        more = []
        for r, tokens in rows:
            for run in (found := layout.stitch(tokens, float(gap[r]))):
                more.append((r, *run))
            # The next run starts where this one has ended, in order of x.
            begun = [t[1] for t in found] + [np.inf]
            at = len(more) - len(found)
            for k in range(len(found)):
                inside = [t[1] for t in tokens if begun[k] <= t[1] < begun[k + 1]]
                more[at + k] += (max(inside, default=begun[k]),)
        row, text, x, width, numeric, last = zip(*more, strict=True) if more else ((),) * 6
        order = np.argsort(np.concatenate((made["row"], np.array(row, np.int64))), kind="stable")
        both = {k: np.concatenate((made[k], np.array(v, made[k].dtype)))[order] for k, v in (("row", row), ("x", x), ("width", width), ("numeric", numeric), ("last", last))}
        return both | {"text": pa.concat_arrays([made["text"], pa.array(text, pa.string())]).take(pa.array(order))}

    @staticmethod
    def _amounts(runs: dict) -> dict:
        """Of runs, those that are amounts: row, left, right, last, value, sure, repaired, raw."""
        text = runs["text"]
        bare = pc.replace_substring(text, ",", "")
        digits, length = pc.binary_length(bare).to_numpy(), pc.binary_length(text).to_numpy()
        clean = pc.match_substring_regex(text, _CLEAN).to_numpy(zero_copy_only=False) & (digits <= 18)
        value, sure, repaired, found = np.zeros(len(text)), np.where(length > digits, 1.0, 0.85), np.zeros(len(text), bool), np.zeros(len(text), bool)
        at = np.flatnonzero(clean)
        value[at] = bare.take(pa.array(at)).cast(pa.int64()).to_numpy().astype(float)
        found[at] = ((digits >= 2) & ((digits > 4) | (length > digits)) | runs["numeric"] & (value >= 100))[at]
        rest = np.flatnonzero(~clean)
        for i, t, numeric in zip(rest.tolist(), text.take(pa.array(rest)).to_pylist(), runs["numeric"][rest].tolist()):
            if parsed := _amount(t, numeric):
                value[i], sure[i], repaired[i], _ = parsed
                found[i] = True
        at = np.flatnonzero(found)
        left = runs["x"][at]
        return {"row": runs["row"][at], "left": left, "right": left + runs["width"][at], "value": value[at], "sure": sure[at], "repaired": repaired[at], "raw": text.take(pa.array(at))}

    @cached_property
    def amounts(self) -> dict:
        return self._amounts(self.runs)

    @cached_property
    def columns(self) -> dict:
        """Value columns, from left to right on each page: page, right_edge, left, right, support."""
        a = self.amounts
        page = self.row_page[a["row"]]
        order = np.lexsort((a["left"], a["right"], page))
        page, left, right = page[order], a["left"][order], a["right"][order]
        edges = np.bincount(page, minlength=self.n)
        first, loose = segments(right, page, np.maximum(8.0, 0.035 * self.page_width))
        size, own = np.diff(np.append(first, len(right))), page[first]
        enough, some, hard = size >= np.where(edges >= 8, 3, 2)[own], np.zeros(self.n, bool), np.zeros(self.n, bool)
        some[own[enough]] = True
        hard[own[loose]] = True
        hard &= edges > 1
        keep = (enough | ~some[own]) & (edges[own] > 1) & ~hard[own]
        low = np.minimum.reduceat(left, first) if len(first) else left
        middle = (right[first + (size - 1) // 2] + right[first + size // 2]) / 2
        out = {"page": own[keep], "right_edge": middle[keep], "left": low[keep], "right": right[first + size - 1][keep], "support": size[keep]}
        if not hard.any():
            return out
        ends = np.cumsum(edges)
        more = [(p, *c) for p in np.flatnonzero(hard).tolist() for c in layout.gathered(*(v[ends[p] - edges[p] : ends[p]].tolist() for v in (right, left)), float(self.page_width[p]))]
        both = {k: np.concatenate((v, np.array(m, v.dtype))) for (k, v), m in zip(out.items(), zip(*more, strict=True), strict=True)}
        order = np.argsort(both["page"], kind="stable")
        return {k: v[order] for k, v in both.items()}

    @cached_property
    def edge(self) -> np.ndarray:
        """Where labels end, by page."""
        out = np.full(self.n, np.inf)
        np.minimum.at(out, self.columns["page"], self.columns["left"])
        return np.where(self.column_counts > 0, out, self.page_width + 4) - 4

    @cached_property
    def column_counts(self) -> np.ndarray:
        return np.bincount(self.columns["page"], minlength=self.n)

    @cached_property
    def labels(self) -> tuple[np.ndarray, pa.Array]:
        """How many tokens of each row are its label, and the label."""
        named = self.x < self.edge[self.row_page][self.row]
        counts = np.bincount(self.row[named], minlength=len(self.begins))
        label = joined(self.text.filter(pa.array(named)), counts)
        odd = pc.match_substring_regex(label, _ODD).to_numpy(zero_copy_only=False)
        if odd.any():
            plain = [" ".join(s.split()) for s in label.filter(pa.array(odd)).to_pylist()]
            label = pc.replace_with_mask(label, pa.array(odd), pa.array(plain, pa.string()))
        return counts, label

    @cached_property
    def cells(self) -> dict:
        """Cells in order of rows and columns: row, column and what amounts tell."""
        runs, edge = self.runs, self.edge[self.row_page]
        across = (runs["x"] < edge[runs["row"]]) & (runs["last"] >= edge[runs["row"]])
        a = self.amounts
        if across.any():  # runs of which a part is in the label
            redone = np.unique(runs["row"][across])
            gap = np.minimum(10.0, np.maximum(4.0, 0.012 * self.page_width))[self.row_page]
            keep = np.flatnonzero(~np.isin(runs["row"], redone))
            kept = {k: v.take(pa.array(keep)) if k == "text" else v[keep] for k, v in runs.items()}
            a = self._amounts(self._with(kept, [(r, [t for t in self.tokens(r) if t[1] >= edge[r]]) for r in redone], gap))
        count = self.column_counts
        page = self.row_page[a["row"]]
        use = np.flatnonzero((a["left"] >= edge[a["row"]]) & (count[page] > 0))
        page, right = page[use], a["right"][use]
        far, at = self._nearest(page, right, count)
        near = far <= np.maximum(12.0, 0.05 * self.page_width)[page]
        use, at = use[near], at[near]
        row, sure = a["row"][use], a["sure"][use]
        order = np.lexsort((-sure, at, row))  # stable: of equals the first
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(row[order]) != 0) | (np.diff(at[order]) != 0)
        order = order[first]
        use = use[order]
        out = {k: v.take(pa.array(use)) if k == "raw" else v[use] for k, v in a.items()}
        return out | {"column": at[order]}

    def _nearest(self, page: np.ndarray, right: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the nearest right edge is, and its column: the first of equals."""
        most = int(count.max(initial=0))
        far, at = np.zeros(len(page)), np.zeros(len(page), np.int64)
        if not most:
            return far, at
        edges = np.full((self.n, most), np.inf)
        edges[np.arange(most) < count[:, None]] = self.columns["right_edge"]
        step = max(1, _TABLE // most)
        for i in range(0, len(page), step):
            own = slice(i, i + step)
            apart = np.abs(edges[page[own]] - right[own, None])
            at[own] = apart.argmin(axis=1)
            far[own] = apart[np.arange(len(apart)), at[own]]
        return far, at

    @cached_property
    def offset(self) -> np.ndarray:
        """layout.vertical_offset of each page."""
        named = self.labels[0] > 0
        alone = np.flatnonzero(~named & (np.bincount(self.cells["row"], minlength=len(named)) > 0))
        last = np.maximum.accumulate(np.where(named, np.arange(len(named)), -1)) if len(named) else np.zeros(0, np.int64)
        at = last[alone]
        apart = self.row_y[at] - self.row_y[alone]
        fine = (at >= 0) & (self.row_page[at] == self.row_page[alone]) & (layout.NEAR_Y[0] <= apart) & (apart <= layout.NEAR_Y[1])
        return medians(apart[fine], self.row_page[alone][fine], self.n, 0.0)

    @cached_property
    def weights(self) -> np.ndarray:
        """What layout.leaf_score makes of each row's label in a match."""
        label = self.labels[1]
        score = np.where(pc.utf8_length(label).to_numpy() > 90, 0.3, np.where(pc.ends_with(label, ":").to_numpy(zero_copy_only=False), 0.5, 1.0))
        # Arrow's expressions fold more letters than layout's, so they only tell what to look at.
        maybe = np.flatnonzero(pc.match_substring_regex(label, layout._HEADING.pattern, ignore_case=True).to_numpy(zero_copy_only=False))
        score[maybe] = [layout.leaf_score(t) for t in label.take(pa.array(maybe)).to_pylist()]
        return 0.55 + 0.45 * score

    @cached_property
    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """The row whose figures are each row's (-1: none), and how sure that is: layout.align.

        Where each label of a page has a figure that fits clearly better than any other in its band, and those follow each
        other as the labels do, no other choice has as high a total. Pages on which labels compete go through layout.align.
        """
        y, labels = self.row_y, np.flatnonzero(self.labels[0] > 0)
        count = np.bincount(self.cells["row"], minlength=len(y))
        figures = np.flatnonzero(count)
        match, sure = np.full(len(y), -1), np.zeros(len(y))
        if not len(labels) or not len(figures):
            return match, sure
        page, own_page, base, off = self.row_page[labels], self.row_page[figures], np.searchsorted(figures, labels), self.offset[self.row_page[labels]]
        best, second, chosen, hard = np.full(len(labels), -1.0), np.full(len(labels), -1.0), np.full(len(labels), -1), np.zeros(self.n, bool)
        for way in (1, -1):
            live, k = np.arange(len(labels)), 0 if way > 0 else -1
            while len(live):
                j = base[live] + k
                live, j = live[(j >= 0) & (j < len(figures))], j[(j >= 0) & (j < len(figures))]
                depth, a = -y[figures[j]], y[labels[live]]
                inside = (own_page[j] == page[live]) & (depth >= layout.NEAR_Y[0] - a) & (depth <= layout.NEAR_Y[1] - a)
                live, j, a = live[inside], j[inside], a[inside]
                if abs(k) > _BAND:
                    hard[page[live]] = True
                    break
                fit = np.exp(-0.5 * ((a - y[figures[j]] - off[live]) / layout.SIGMA) ** 2) * self.weights[labels[live]]
                better = fit > best[live]
                second[live] = np.maximum(second[live], np.where(better, best[live], fit))
                best[live[better]], chosen[live[better]] = fit[better], j[better]
                k += way
        some = chosen >= 0
        hard[page[some & (best < second + _AHEAD)]] = True
        own = np.flatnonzero(some)
        back = (np.diff(chosen[own]) <= 0) & (np.diff(page[own]) == 0)
        hard[page[own[1:][back]]] = True
        hard |= self.page_rows > 100_000  # steps of layout.EQUAL add up
        own = own[~hard[page[own]]]
        a, b = labels[own], figures[chosen[own]]
        fit = np.array([exp(v) for v in (-0.5 * ((y[a] - y[b] - off[own]) / layout.SIGMA) ** 2).tolist()]) * self.weights[a]
        match[a] = b
        mean = self._mean_sure(count)
        sure[a] = 0.6 * np.maximum(0.0, np.minimum(1.0, fit)) + 0.4 * mean[b]
        for p in np.flatnonzero(hard):
            self._aligned(int(p), match, sure)
        return match, sure

    def _mean_sure(self, count: np.ndarray) -> np.ndarray:
        """The mean confidence of each row's cells."""
        sure, first = self.cells["sure"], np.cumsum(count) - count
        out = np.zeros(len(count))
        one, two = count == 1, count == 2
        out[one] = sure[first[one]]
        out[two] = (sure[first[two]] + sure[first[two] + 1]) / 2
        for r in np.flatnonzero(count > 2):
            out[r] = fsum(sure[first[r] : first[r] + count[r]].tolist()) / int(count[r])
        return out

    def _aligned(self, p: int, match: np.ndarray, sure: np.ndarray) -> None:
        first = int(self.page_rows[:p].sum())
        own = range(first, first + int(self.page_rows[p]))
        labels = self.labels[1][first : own.stop].to_pylist()
        cells, at = self.cells, np.searchsorted(self.cells["row"], np.arange(first, own.stop + 1)).tolist()
        ys, confidence = self.row_y[first : own.stop].tolist(), cells["sure"][at[0] : at[-1]].tolist()
        rows = [layout.Row(ys[i], p, [], labels[i], [layout.Cell(0, 0.0, c, False, "", 0.0, 0.0) for c in confidence[at[i] - at[0] : at[i + 1] - at[0]]]) for i in range(len(own))]
        place = {id(r): first + i for i, r in enumerate(rows)}
        for a, b, s in layout.align(rows, float(self.offset[p])):
            match[place[id(a)]], sure[place[id(a)]] = place[id(b)] if b else -1, s


def struct(kind: pa.StructType, *arrays) -> pa.StructArray:
    return pa.StructArray.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(arrays, kind, strict=True)], fields=list(kind))


def listed(kind: pa.ListType, counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets(counts)), values, type=kind)


def page_rows(own: Pages, kinds: list[pa.DataType]) -> tuple[np.ndarray, list]:
    """A row for each page: lines, columns, offset, as layout.PAGE has them, or those of them that kinds has; of lines, the fields that kinds has. Nothing else is worked out."""
    return np.arange(own.n), [pa.array(own.offset) if not pa.types.is_list(k) else page_lines(own, k) if "support" not in [f.name for f in k.value_type] else page_columns(own, k) for k in kinds]


def page_columns(own: Pages, kind: pa.ListType) -> pa.ListArray:
    made, counts = own.columns, own.column_counts
    index = np.arange(len(made["page"])) - (np.cumsum(counts) - counts)[made["page"]]
    return listed(kind, counts, struct(kind.value_type, index, *(made[k] for k in ("right_edge", "left", "right", "support"))))


def page_lines(own: Pages, kind: pa.ListType) -> pa.ListArray:
    of = {f.name: f.type for f in kind.value_type}

    def end() -> np.ndarray:
        named = own.labels[0]
        at = own.begins + np.maximum(named - 1, 0)
        return np.where(named > 0, own.x[at] + own.width[at], own.x[own.begins])

    def cells() -> pa.ListArray:
        c = own.cells
        figures = struct(of["cells"].value_type, c["column"], c["value"], c["sure"], c["repaired"], c["raw"], c["left"], c["right"] - c["left"])
        return listed(of["cells"], np.bincount(c["row"], minlength=len(own.begins)), figures)

    def value_seq() -> pa.Array:
        match = own.matches[0]
        return pa.array(own.row_seq[match] if len(match) else match, pa.int32(), mask=match < 0)

    makers = {
        "row_seq": lambda: own.row_seq, "y": lambda: own.row_y, "label": lambda: own.labels[1], "label_start": lambda: own.x[own.begins], "label_end": end, "text": lambda: joined(own.text, own.size),
        "words": lambda: listed(of["words"], own.size, struct(of["words"].value_type, own.text, own.x, own.width)), "cells": cells, "value_seq": value_seq, "sure": lambda: own.matches[1],
    }
    return listed(kind, own.page_rows, struct(kind.value_type, *(makers[name]() for name in of)))


def run_rows(own: Pages, kinds: list[pa.DataType]) -> tuple[np.ndarray, list]:
    """A row for each run of number-like tokens: row_seq, text, x, width."""
    runs = own.runs
    return own.row_page[runs["row"]], [pa.array(own.row_seq[runs["row"]], kinds[0]), runs["text"], pa.array(runs["x"]), pa.array(runs["width"])]
