"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles, hashed to 64 bits. Two documents link when the Jaccard similarity of
their sets is at least `num`/`den`.

Signatures. Sizes are banded so that linked sets lie in the same band or in neighbouring ones; instance b serves bands b and
b + 1. Two linked sets of an instance differ in at most k elements (their Hamming distance, from the largest sizes). The
feature domain is cut into first-level partitions, each of them into second-level ones. If linked sets differ in k elements,
few enough of them fall into some first-level partition that one of the subsets of its second-level partitions is equal in
both: all subsets are enumerated that leave out `out` of them. A subset's signature hashes its instance, number and elements.
`scheme` picks the numbers for each size band: the fewest signatures whose subsets hold HELD elements on average, of the settings
that leave out one second-level partition or more (or, where disk is scarcer than pairs, of all: whole partitions are the fewest).

A subset that is empty isn't signed, since all sets would meet there. There are `spare` first-level partitions more than needed,
so that linked sets agree in more than `spare` of them; a set that has empty subsets in more partitions than that is signed once
more in another domain (a tier). Linked sets either share a subset with elements, or both go on to the next tier. So no link is missed.

Links are wanted for their groups, so a bucket isn't expanded into pairs. Near sets share most signatures: of the buckets with
equal members only one is kept. First its smallest document is compared with the others. Buckets whose others are still of
different groups are gone through once more, for pairs across groups. Each comparison first takes parity sketches: a bit for
each cell of the domain says whether the cell holds an odd number of elements, so two sketches differ in no more bits than their
sets in elements, and a pair over that bound can't link. The few pairs left are compared exactly, by their sets. Every pair that
shares a signature is thus compared, ruled out, or known to be in one group. Large buckets are cut into chunks, and a task holds
two chunks of sketches. Equal sets are one node throughout, and a task emits the signatures of equal sets once, so large groups
of copies cost a row each.

Cases: null and empty texts, and those of white space, have no set and link with nothing. A null doc_id links with nothing and
has a null component. Repeated rows are copies of each other; rows that repeat an id with different texts each have their row,
and their id stands for all of these texts. Texts of any length are read whole; ties don't occur (a component's id is its
smallest). An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, erfc, exp, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_parts, small_batches
from .components import components

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S31, _S32 = np.uint64(31), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of each element."""
    x = (x ^ (x >> _S31)) * _B
    x = (x ^ (x >> _S31)) * _C
    return x ^ (x >> _S32)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = _Hashes()


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted hashes of a text's distinct k-word shingles; bytes.lower and bytes.split know A-Z and ASCII white space alone."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), np.uint64)
    for j in range(min(k, len(w))):
        h = mix(h * _A + w[j : j + n])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


@lru_cache(maxsize=None)
def band(i: int, num: int, den: int) -> tuple[int, int]:
    """The smallest and largest size of band i."""
    low = 1 if i == 0 else band(i - 1, num, den)[1] + 1
    return low, low * den // num


@lru_cache(maxsize=100_000)
def band_of(n: int, num: int, den: int) -> int:
    i = 0
    while band(i, num, den)[1] < n:
        i += 1
    return i


#: Elements that a signature should hold on average, in the smallest sets of its instance; and the domains that are tried in turn.
HELD, TIERS = 2.4, 8


def _over(mean: float, bound: int) -> float:
    """The chance that a Poisson number of this mean is over a bound."""
    if mean > 30:
        return erfc((bound + 0.5 - mean) / sqrt(2 * mean)) / 2
    term = total = exp(-mean)
    for j in range(1, bound + 1):
        term *= mean / j
        total += term
    return max(0.0, 1 - total)


@lru_cache(maxsize=None)
def scheme(i: int, num: int, den: int, enumerated: bool = True) -> tuple[int, int, int, int]:
    """Of instance i: first-level partitions, second-level ones in each, how many of these a subset leaves out, and spare partitions.

    It's the setting with the fewest signatures among those whose subsets hold HELD elements on average. enumerated: subsets leave
    out one second-level partition at least, and hold two; else a subset may be a whole partition, with none left out.
    """
    low, high = band(i, num, den)
    k = most_apart(high, high * den // num, num, den)
    if k == 0:
        return 1, 1, 0, 0
    tried = []
    for out in range(int(enumerated), 4):
        for second in range(out + 1 + enumerated, 8):
            for spare in (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256):
                first = k // (out + 1) + 1 + spare
                held, ways = low * (second - out) / (first * second), comb(second, out)
                again = min(0.9, _over(first * min(1.0, ways * exp(-held)), spare))
                tried.append((max(0.0, min(HELD, 0.6 * low) - held), first * ways / (1 - again), (first, second, out, spare)))
    return min(tried)[2]


@lru_cache(maxsize=None)
def subsets(second: int, out: int) -> np.ndarray:
    """A column for each subset of second-level partitions that leaves out so many."""
    return np.array([[j not in gone for gone in combinations(range(second), out)] for j in range(second)]).astype(np.uint64)


def signatures(s: np.ndarray, num: int, den: int, enumerated: bool = True) -> np.ndarray:
    """The signatures of a set, given as sorted hashes."""
    own = band_of(len(s), num, den)
    found = []
    for i in (own, own - 1):
        if i < 0 or len(s) * num > band(i, num, den)[1] * den:
            continue
        first, second, out, spare = scheme(i, num, den, enumerated)
        chosen, cells, h = subsets(second, out), first * second, s
        for tier in range(TIERS):
            at = ((h >> _S32) * np.uint64(cells)) >> _S32
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            sums, filled = np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
            where = at[starts].astype(np.int64)
            sums[where], filled[where] = np.add.reduceat(mix(h + _A), starts), 1
            sums, filled = sums.reshape(first, second) @ chosen, (filled.reshape(first, second) @ chosen) > 0
            salt = np.arange(sums.size, dtype=np.uint64).reshape(sums.shape) + np.uint64((tier << 60) + ((i + 1) << 32))
            signed = mix(mix(sums) + mix(salt))
            lacking = int((~filled).any(1).sum())
            found.append(signed[filled] if lacking <= spare or tier + 1 < TIERS else signed.ravel())
            if lacking <= spare:
                break
            h = np.sort(mix(h + _B))
    return np.concatenate(found)


def sketch(s: np.ndarray) -> bytes:
    """A parity sketch of at least two bits for each element: bit h mod m of each hash h is flipped."""
    m = max(256, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A sketch brought to `size` bytes: parities of cells that fall together add up."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, size // 8), axis=0)


def most_apart(na, nb, num: int, den: int):
    """The most elements in which two linked sets of these sizes differ."""
    return (na + nb) * (den - num) // (den + num)


def _profile(k: int, num: int, den: int, enumerated: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id"), part.column("text"), strict=True):
                    s = shingle_set(text.as_py(), k)
                    digest = (int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ _C).sum(dtype=np.uint64).view(np.int64))) if len(s) else (0, 0)
                    sigs = flips = None
                    if len(s) and doc_id.is_valid and digest not in seen:  # a row without an id is no node: it must not stand for its set
                        seen.add(digest)
                        sigs, flips = signatures(s, num, den, enumerated).view(np.int64), sketch(s)
                    rows.append((len(s), *digest, sigs, flips))
                n, h1, h2, sigs, flips = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(flips, pa.binary())], ["doc_id", "n", "h1", "h2", "sigs", "sk"])
        released()

    return run


def released() -> None:
    """At the end of a task: lets go of words and of buffers, since a Python worker lives on and shares its executor's memory."""
    _WORDS.clear()
    pa.default_memory_pool().release_unused()


#: Bits of the filters that pick what is read again: their 8 MB are the most that is broadcast, at any input size.
FILTER_BITS = 1 << 26


def _bits(places: DataFrame) -> dict[int, bytes]:
    """places: h, below FILTER_BITS. A bit for each, for _words(). The driver gets FILTER_BITS bits at most, in deflated pieces of 2^19: those that are empty aren't there, and those of few bits are small."""
    words = places.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))

    def piece(at: tuple, own: pa.Table) -> pa.Table:
        out = np.zeros(1 << 13, np.int64)
        out[own.column("w").to_numpy() & 0x1FFF] = own.column("bits").to_numpy()
        return pa.table({"at": pa.array([at[0].as_py()], pa.int64()), "bits": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    return {r["at"]: bytes(r["bits"]) for r in words.groupBy(F.shiftright("w", 13).alias("at")).applyInArrow(piece, "at long, bits binary").collect()}


def _words(bits: dict[int, bytes]) -> np.ndarray:
    """The bits of _bits(), 64 in a number."""
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    for at, piece in bits.items():
        out[at << 13 : (at + 1) << 13] = np.frombuffer(zlib.decompress(piece), np.int64)
    return out


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id and set of the documents whose ids are among `ids` (and of a few others)."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).alias("h")
    held = docs.sparkSession.sparkContext.broadcast(_bits(ids.select(place("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(held.value)
        for batch in batches:
            h = batch.column("h").to_numpy()
            some = batch.filter(pa.array(((words[h >> 6] >> (h & 63)) & 1) > 0))
            for part in (some.slice(i, 256) for i in range(0, some.num_rows, 256)):
                sets = [shingle_set(x.as_py(), k).view(np.int64) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "s"])
        released()

    return docs.filter("doc_id is not null").select("*", place("doc_id")).mapInArrow(run, "doc_id long, s array<long>").dropDuplicates(["doc_id"])


def _linked(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of pairs a, b (distinct documents): those that link, by their sets."""
    pairs = materialize(pairs, "pairs")
    sets = materialize(_sets(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), k), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    na, nb = F.size("sa"), F.size("sb")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return materialize(both.filter(common * den >= (na + nb - common) * num).select("a", "b"), "linked")


def _possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs a, b: those that sizes and sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = most_apart(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), num, den)
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                size = min(len(x), len(y))
                keep.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= most[i])
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sketches.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sk").alias(f"s{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    return near.mapInArrow(run, "a long, b long")


#: Documents of a bucket that a task holds at a time, twice.
CHUNK = 2000


def _across(left: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """left: sig, doc, g (its group). The pairs a, b of documents that share a signature, in different groups, that sizes and sketches don't rule out."""
    sizes = left.groupBy("sig").agg(F.count("*").alias("m"), F.min("g").alias("x"), F.max("g").alias("y")).filter("x <> y")
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    dealt = left.join(sizes, "sig").withColumn("c", F.pmod(F.xxhash64("doc"), chunks).cast("int"))
    dealt = dealt.join(sketches.select(F.col("rep").alias("doc"), "n", "sk"), "doc")
    # A row for each pair of chunks that the document's chunk is in: one, unless the bucket is large.
    rows = dealt.select("sig", "doc", "g", "c", "n", "sk", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("o"))
    rows = rows.select("sig", "doc", "g", "c", "n", "sk", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"))

    def pairs(own: list[tuple]) -> list[tuple[int, int]]:
        doc, g, c, n = (np.array([r[i] for r in own], np.int64) for i in range(4))
        if len(own) < 2 or g.min() == g.max():
            return []
        size = min(len(r[4]) for r in own)
        sk = np.array([folded(r[4], size) for r in own])
        out = []
        step = max(1, 2_000_000 // (len(own) * size // 8))
        for i in range(0, len(own), step):
            at = slice(i, i + step)
            apart = np.bitwise_count(sk[at, None] ^ sk[None]).sum(2, dtype=np.int64)
            ok = (apart <= most_apart(n[at, None], n[None], num, den)) & (g[at, None] != g[None]) & (doc[at, None] > doc[None])
            ok &= np.minimum(n[at, None], n[None]) * den >= np.maximum(n[at, None], n[None]) * num
            if c.min() != c.max():
                ok &= c[at, None] != c[None]
            x, y = np.nonzero(ok)
            out += zip(doc[x + i].tolist(), doc[y].tolist(), strict=True)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = None, [], set()

        def flush() -> Iterator[pa.RecordBatch]:
            fresh = [p for p in pairs(held) if p not in seen]
            if len(seen) < 200_000:
                seen.update(fresh)
            if fresh:
                a, b = zip(*fresh, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("sig", "lo", "hi", "doc", "g", "c", "n", "sk")]
            for sig, lo, hi, *row in zip(*columns, strict=True):
                if (sig, lo, hi) != key:
                    yield from flush()
                    key, held = (sig, lo, hi), []
                held.append(tuple(row))
        yield from flush()

    spread = rows.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
    return spread.mapInArrow(run, "a long, b long").distinct()


#: Signatures that a partition should hold when they are gathered.
SIGNATURES = 400_000


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents with their signatures: each signature of a batch once, with its smallest and largest document."""
    for batch in batches:
        sigs = batch.column("sigs")
        doc, sig = batch.column("doc_id").to_numpy()[pc.list_parent_indices(sigs).to_numpy()], sigs.flatten().to_numpy()
        order = np.lexsort((doc, sig))
        doc, sig = doc[order], sig[order]
        if len(sig):
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            last = np.append(first[1:], len(sig)) - 1
            yield pa.RecordBatch.from_pydict({"sig": sig[first], "x": doc[first], "y": doc[last]})


def _among(shared: DataFrame, made: DataFrame) -> DataFrame:
    """sig, doc: the signatures of documents that are among `shared`, and a few others that share their bits; it spares the join most rows."""
    held = made.sparkSession.sparkContext.broadcast(_bits(shared.select(F.col("sig").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(held.value)
        for batch in batches:
            sigs = batch.column("sigs")
            doc, sig = batch.column("doc_id").to_numpy()[pc.list_parent_indices(sigs).to_numpy()], sigs.flatten().to_numpy()
            h = sig & (FILTER_BITS - 1)
            keep = ((words[h >> 6] >> (h & 63)) & 1) > 0
            yield pa.RecordBatch.from_pydict({"sig": sig[keep], "doc": doc[keep]})

    return made.mapInArrow(run, "sig long, doc long")


def _buckets(made: DataFrame, nodes: DataFrame) -> DataFrame:
    """sig, doc, top: the buckets of two sets or more, each doc a set's smallest document and top the bucket's smallest; of buckets with the same members one.

    Near sets share most of their signatures, so most buckets repeat another's members. They are told by the number, the
    smallest and two digests (96 bits of hashes) of their members.
    """
    signed = made.filter("sigs is not null").select("doc_id", "sigs")
    parts = max(shuffle_parts(made.sparkSession), -(-(signed.agg(F.sum(F.size("sigs"))).first()[0] or 0) // SIGNATURES))
    # A frequent signature is a row a batch before the shuffle; its smallest and largest document tell whether several share it.
    ends = signed.mapInArrow(_ends, "sig long, x long, y long").repartition(parts, "sig").groupBy("sig").agg(F.min("x").alias("x"), F.max("y").alias("y"))
    shared = materialize(ends.filter("x < y").select("sig"), "shared")
    some = _among(shared, signed).join(shared, "sig").join(nodes.withColumnRenamed("doc_id", "doc"), "doc")
    members = materialize(some.select("sig", F.col("rep").alias("doc")).distinct(), "members")
    h, other = F.xxhash64("doc"), F.xxhash64(F.lit(7), "doc")
    told = members.groupBy("sig").agg(F.count("*").alias("m"), F.min("doc").alias("top"), F.bit_xor(h).alias("d"), F.sum(other.bitwiseAND(F.lit(0xFFFFFFFF))).alias("e"))
    single = told.filter("m > 1").groupBy("m", "top", "d", "e").agg(F.min("sig").alias("sig"))
    return materialize(members.join(single.select("sig", "top"), "sig"), "buckets")


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, enumerated: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    enumerated: signatures are of subsets that leave out a second-level partition or more. Without, there are about two thirds as
    many, each of fewer elements; links are the same.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    with small_batches(spark):
        made = materialize(docs.mapInArrow(_profile(k, num, den, enumerated), "doc_id long, n long, h1 long, h2 long, sigs array<long>, sk binary"), "profiles")
        counts = materialize(made.select("doc_id", F.col("n").alias("n_shingles")), "counts")
        rows = made.filter("n > 0 and doc_id is not null")
        classes = materialize(rows.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.max("sk").alias("sk")), "classes")
        sketches = classes.select("rep", "n", "sk")
        nodes = materialize(rows.select("doc_id", "h1", "h2", "n").join(classes.drop("sk"), ["h1", "h2", "n"]).select("doc_id", "rep").distinct(), "nodes")
        buckets = _buckets(rows, nodes)
        discard(made)  # all that comes from it is written: it holds the signatures, the largest table here

        # Each bucket's smallest document is compared with the others.
        stars = buckets.filter("doc <> top").select(F.col("doc").alias("a"), F.col("top").alias("b")).distinct()
        links = _linked(_possible(stars, sketches, num, den), docs, k, num, den)
        groups = materialize(components(links), "groups")
        # Then the others among each other, where they aren't in one group.
        named = groups.select(F.col("node").alias("doc"), "component")
        left = buckets.filter("doc <> top").join(named, "doc", "left").select("sig", "doc", F.coalesce("component", "doc").alias("g"))
        found = _linked(_across(materialize(left, "left"), sketches, num, den), docs, k, num, den)
        if not found.isEmpty():
            # Links of the first step are held by its groups, which are stars already.
            groups = materialize(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)), "groups")
    placed = nodes.join(groups, nodes.rep == groups.node, "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    return counts.join(placed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
