"""Best-fit packing by linear grouping.

Texts are encoded, an end id is appended, and only documents longer than a sequence are cut, so that all their pieces but the
first are full. Full pieces are sequences of their own. The other pieces are dealt by a hash into blocks of about
`block_pieces`; a block is packed in one task:

1. Large pieces (above `small_share` of a sequence), by falling length, form `groups` groups of equal cardinality; each is
   rounded up to the longest of its group, so few sizes are left.
2. The few sizes are packed by configurations (how often each size is in a sequence). A linear program over all configurations
   gives the fewest sequences that meet the demand; its columns are generated as they are needed, each the best of a knapsack
   under the current prices, or one that an earlier knapsack found. Each configuration of the optimum is used as often as its whole part says.
3. Actual documents take the places of the rounded sizes: each place the longest that leaves the later places of its sequence
   their rounded sizes, so that what the rounding lost is used.
4. The rest, small pieces and the few large ones that the whole parts leave, go longest first where they leave the least room
   (best fit). The least filled quarter of the sequences is then packed anew by best fit, which is kept where it takes fewer.

A block's last sequences are the only loss against packing all at once: about half a sequence in some thousands.

Cases: a null or empty text is the end id alone; texts of any length are read whole; repeated rows and ids are packed each; equal
lengths may be in any order, but the same in each run; an empty table gives an empty result. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, task_ids
from .tokens import encoder, release

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, seq long"
IDS = ", ids binary"


#: How near to the optimum the linear program is solved, the most knapsacks on the way (it's a solution after each), and steps between two inversions of the basis.
GAP, ROUNDS, ANEW = 1e-3, 600, 100


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n ids: all full but the first."""
    first = n % size or size
    return [(0, min(first, n)), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int = 0, keep_ids: bool = False, keep_encoder: bool = True) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and part and seq, which tell repeated rows apart; with keep_ids the ids too, as 32-bit little-endian.

    keep_encoder: whether a worker keeps its encoder for the next task, beside whatever else then runs on the executor.
    """
    schema = PIECES + IDS * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        end = np.array([end_id], words.dtype).tobytes()
        part, seq = task_ids()[0], 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(words.encode(text.as_py() or "") + end, words.dtype).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), size)):
                    raw = ids[start : start + n].tobytes()
                    rows.append((doc_id, k, start, n, zlib.crc32(raw), part, seq, *[raw] * keep_ids))
                seq += 1
            for i in range(0, len(rows), 4096):
                columns = zip(*rows[i : i + 4096], strict=True)
                kinds = {"piece": pa.int32(), "part": pa.int32(), "ids": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(x, pa.int64())) for x, c in zip(names, columns, strict=True)], names)
        release(encoders=not keep_encoder)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, schema)


def _best(sizes: list[int], prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The dearest configuration that fits, by an unbounded knapsack over fills, and that of each size which is in it at least once: the best price, and a row for each of those that are worth more than a sequence, how often it has each size."""
    worth, last = np.zeros(room + 1), np.full(room + 1, -1)
    for i in np.flatnonzero(prices > 1e-9):
        s = sizes[i]
        for at in range(s, room + 1, s):
            own = slice(at, min(at + s, room + 1))
            more = worth[at - s : at - s + worth[own].size] + prices[i]
            better = more > worth[own] + 1e-12
            worth[own][better] = more[better]
            last[own][better] = i
    # A fill that no configuration ends at stands for the next lower one.
    fills = np.maximum.accumulate(np.where(last >= 0, np.arange(room + 1), 0))
    holds = worth[room - np.array(sizes)] + prices
    picked = np.flatnonzero(holds > 1 + 1e-9)
    rows = np.zeros((len(picked), len(sizes)))
    for row, i in zip(rows, picked, strict=True):
        row[i], fill = 1, fills[room - sizes[i]]
        while fill > 0:
            row[last[fill]] += 1
            fill = fills[fill - sizes[last[fill]]]
    return float(worth[room]), np.unique(rows, axis=0)


def configurations(sizes: list[int], demand: list[int], room: int) -> list[tuple[list[int], int]]:
    """Configurations and how often each is used: the whole parts of the linear program's optimum, within GAP of it.

    A simplex over generated columns: all that a knapsack has found are kept and entered by their price, and only when none of
    them pays is the next knapsack solved. The inverse of the basis is updated, and made anew from time to time.
    """
    need = np.array(demand, float)
    basis = np.diag([float(room // s) for s in sizes])
    inverse = np.diag(1 / np.diag(basis))
    level = need / np.diag(basis)
    known = np.zeros((0, len(sizes)))
    knapsacks = steps_taken = 0
    while True:
        prices = inverse.sum(0)
        gains = known @ prices
        at = int(gains.argmax()) if len(known) else -1
        if at < 0 or gains[at] <= 1 + GAP / 4:
            worth, found = _best(sizes, prices, room)
            knapsacks += 1
            if worth <= 1 + GAP or knapsacks > ROUNDS:  # the program's optimum is within this share of what the basis needs
                break
            known = np.vstack([known[gains > 0.9], found])
            continue
        along = inverse @ known[at]
        steps = np.where(along > 1e-9, level / np.where(along > 1e-9, along, 1), np.inf)
        out = int(steps.argmin())
        basis[:, out] = known[at]
        level = np.maximum(0.0, level - steps[out] * along)
        level[out] = steps[out]
        steps_taken += 1
        if steps_taken % ANEW:
            row = inverse[out] / along[out]
            inverse -= np.outer(along, row)
            inverse[out] = row
        else:
            inverse = np.linalg.inv(basis)
            level = np.maximum(0.0, inverse @ need)
    left, chosen = need.copy(), []
    for column, times in zip(basis.T, level, strict=True):
        times = int(min(times + 1e-6, (left[column > 0] // column[column > 0]).min()))
        if times:
            chosen.append((column.astype(int).tolist(), times))
            left -= times * column
    return chosen


def _substituted(slots: list[int], left: list[tuple[int, int]], size: int) -> list[int]:
    """Actual pieces for a configuration's places, taken from `left`: for each the longest that leaves the later places their rounded sizes."""
    own, room, later = [], size, sum(slots)
    for s in slots:
        later -= s
        at = bisect_right(left, (room - later, 1 << 62)) - 1
        if at >= 0:
            n, p = left.pop(at)
            own.append(p)
            room -= n
    return own


def pack_lengths(lengths: np.ndarray, size: int, groups: int = 160, small_share: float = 0.2) -> np.ndarray:
    """The sequence of each piece (from 0), by linear grouping, configurations and best fit."""
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] > size * small_share]
    rest = order[len(large) :].tolist()
    held: list[list[int]] = []
    if len(large):
        each = -(-len(large) // groups)
        demand: dict[int, int] = {}
        for g in range(0, len(large), each):
            top = int(lengths[large[g]])
            demand[top] = demand.get(top, 0) + len(large[g : g + each])
        sizes = sorted(demand, reverse=True)
        left = [(int(lengths[p]), p) for p in reversed(large.tolist())]  # by rising length
        for use, times in sorted(configurations(sizes, [demand[s] for s in sizes], size), reverse=True):
            slots = [s for s, u in zip(sizes, use, strict=True) for _ in range(u)]
            for _ in range(times):
                if own := _substituted(slots, left, size):
                    held.append(own)
        rest = [p for _, p in left] + rest
    rooms = sorted((size - int(lengths[x].sum()), k) for k, x in enumerate(held))
    for p in sorted(rest, key=lambda p: -lengths[p]):
        _place(p, int(lengths[p]), rooms, held, size)
    out = np.zeros(len(lengths), np.int64)
    for k, own in enumerate(_last_anew(lengths, held, size)):
        out[own] = k
    return out


def _place(p: int, n: int, rooms: list[tuple[int, int]], held: list[list[int]], size: int) -> None:
    at = bisect_left(rooms, (n, -1))
    if at == len(rooms):
        held.append([p])
        insort(rooms, (size - n, len(held) - 1))
        return
    room, k = rooms.pop(at)
    held[k].append(p)
    insort(rooms, (room - n, k))


def _last_anew(lengths: np.ndarray, held: list[list[int]], size: int, share: float = 0.25) -> list[list[int]]:
    """The least filled `share` of the sequences (two at least) packed anew by best fit, longest first; kept where it takes fewer."""
    order = sorted(range(len(held)), key=lambda k: -int(lengths[held[k]].sum()))
    last = max(2, int(len(held) * share))
    rooms: list[tuple[int, int]] = []
    anew: list[list[int]] = []
    for p in sorted((p for k in order[-last:] for p in held[k]), key=lambda p: -lengths[p]):
        _place(p, int(lengths[p]), rooms, anew, size)
    return [held[k] for k in order[:-last]] + anew if len(anew) < min(last, len(held)) else held


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, block_pieces: int = 6000, keep_ids: bool = False, keep_encoder: bool = True) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids). docs: doc_id, text."""
    with small_batches(docs.sparkSession):
        made = materialize(pieces(docs, vocabulary, size, end_id, keep_ids, keep_encoder), "pieces")
    tails = made.filter(F.col("length") < size)
    blocks = max(1, -(-tails.count() // block_pieces))
    ids = ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + IDS * keep_ids
    columns = [x.split()[0] for x in schema.split(", ")]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "part", "seq", "piece"], ascending=False, kind="stable", ignore_index=True)
        at = pack_lengths(rows["length"].to_numpy(), size)
        rows["sequence_id"] = int(key[0]) * (1 << 24) + at
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows[columns]

    block = F.pmod(F.xxhash64("part", "seq", "piece"), F.lit(blocks))
    packed = tails.withColumn("block", block).groupBy("block").applyInPandas(one, schema)
    full = made.filter(F.col("length") == size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full.select(*columns[:7], *ids))
