"""Language identification in two steps: the family, then one-versus-one linear support vector machines within it.

Features: counts of hashed letter n-grams (one to three characters, words apart by one space, lower case), square roots taken,
of unit length. Learned from a bounded sample of whole, distinct labelled texts: at most `per_language` of each language
(PER_LANGUAGE), and of all languages together about FIT_ROWS, dealt evenly. There is no bound on languages but that each needs a
row. Each text is a vector of 4096 numbers, so the sample is FIT_ROWS times 16 KB at most; it is sent to the tasks, and each task
fits machines. Scoring reads every text once.

Cases: a null text, an empty one and one without a letter is `und` with score 0. Texts of any length are read whole. Without any
labelled row every text is `und` with score 0; with one language, that is the answer. Of equal votes and margins the language
first in the alphabet wins. Repeated rows and ids are scored each, and learned from once. An empty table gives no rows. Other
columns are kept as they are; those named as the two that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import materialize, shuffle_parts

DIMS = 4096
#: The most distinct labelled texts that are learned from: of a language, and of all.
PER_LANGUAGE, FIT_ROWS = 400, 8000
#: Rows of a language that are drawn besides twice those that are wanted.
SPARE = 30
#: Places of a text's hash; a text is sampled if its place is low.
_PLACES = 1 << 40
#: Families of languages; a language that isn't listed is a family of its own.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "pl": "slavic", "cs": "slavic", "ru": "slavic", "uk": "slavic", "bg": "slavic",
}
UNDETERMINED = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """By code point: whether it's a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def vector(text: str | None) -> np.ndarray | None:
    """The features of a text; None if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    c = np.where(letter, points, 32).astype(np.uint32)
    keep = np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))
    c = np.concatenate(([32], c[keep], [32])).astype(np.uint32)
    out = np.zeros(DIMS)
    h = np.zeros(len(c), np.uint32)
    for n in range(3):
        h = h[: len(c) - n] * np.uint32(0x01000193) + c[n:] + np.uint32(n + 1)
        x = h * np.uint32(0x9E3779B1)
        out += np.bincount(x >> np.uint32(20), minlength=DIMS)
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def packed(x: np.ndarray) -> bytes:
    """A vector's numbers that aren't 0, and before them a bit for each place: most of a text's are 0, and the driver passes the sample on."""
    at = x != 0
    return np.packbits(at).tobytes() + x[at].tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    """The vectors of packed(), a row each."""
    out = np.zeros((len(rows), DIMS), np.float32)
    for own, b in zip(out, rows, strict=True):
        own[np.unpackbits(np.frombuffer(b, np.uint8, DIMS // 8)).astype(bool)] = np.frombuffer(b, np.float32, offset=DIMS // 8)
    return out


def svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, steps: int = 300, least: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by accelerated gradient descent, until a step changes less than `least` of them. y: -1 or 1; classes weigh alike."""
    # The bias stands apart, so the sample isn't copied to put ones beside it.
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    rate = np.float32(1 / (4 + strength))  # rows have squared length 2, and the loss a second derivative of 2 at most
    for t in range(steps):
        gap = np.maximum(np.float32(0), 1 - y * (x @ v[:-1] + v[-1]))
        pull = share * y * gap
        nxt = v - rate * (np.float32(strength) * v - 2 * np.append(pull @ x, pull.sum()))
        moved, size = np.abs(nxt - w).max(), np.abs(nxt).max()
        v = nxt + np.float32(t / (t + 3)) * (nxt - w)
        w = nxt
        if t > 20 and moved <= least * size:
            break
    return w


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    family_weights: np.ndarray
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = vector(text)
        if x is None or not self.families:
            return UNDETERMINED, 0.0
        x = np.append(x, 1)
        score, family = 1.0, self.families[0]
        if len(self.families) > 1:
            at = self.family_weights @ x
            top = int(at.argmax())
            family, score = self.families[top], _sure(at[top])
        own = self.members[family]
        if len(own) == 1:
            return own[0], score
        votes, margins = np.zeros(len(own)), np.zeros(len(own))
        for i, j, w in self.pairs[family]:
            m = float(w @ x)
            votes[i if m >= 0 else j] += 1
            margins[i] += m
            margins[j] -= m
        top = int(np.lexsort((-np.arange(len(own)), margins, votes))[-1])
        return own[top], score * _sure(margins[top] / (len(own) - 1))


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-4 * margin)))


def sample(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, most: int = FIT_ROWS) -> DataFrame:
    """lang and text of the rows to learn from: distinct, at most `per_language` of a language, fewer where there would be more than `most` of all."""
    rows = docs.filter(usable).filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # Copies count once, in the share and in the sample: a group of copies neither swamps its language nor crowds out the rest.
    placed = rows.withColumn("place", F.pmod(F.xxhash64("text"), F.lit(_PLACES)))
    texts = placed.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").agg(F.count("*").alias("n"))
    # A row for each language at least: beyond `most` languages, those with most texts.
    counts = materialize(texts.orderBy(F.desc("n"), "lang").limit(most), "languages")
    each = max(1, min(per_language, most // max(1, counts.count())))
    # Twice the limit and SPARE more are drawn, so that it's met; the lowest places are taken.
    shares = F.broadcast(counts.select("lang", (F.least(F.lit(1.0), F.lit(2.0 * each + SPARE) / F.col("n")) * _PLACES).cast("long").alias("share")))
    drawn = placed.join(shares, "lang").filter(F.col("place") < F.col("share")).select("lang", "text", "place").distinct()
    by = Window.partitionBy("lang").orderBy("place", "text")
    return drawn.withColumn("i", F.row_number().over(by)).filter(F.col("i") <= each).select("lang", "text")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            own = batch.slice(at, 128)
            found = [(k, vector(t.as_py())) for k, t in zip(own.column("lang").to_pylist(), own.column("text"), strict=True)]
            found = [(k, packed(x)) for k, x in found if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([x for _, x in found], pa.binary())], ["lang", "x"])


def fit(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from text and non-null lang of the rows for which `usable` holds. The driver gets a packed vector for each sampled row, and the weights."""
    spark = docs.sparkSession
    got = sorted((r["lang"], bytes(r["x"])) for r in sample(docs, usable, per_language).mapInArrow(_vectors, "lang string, x binary").collect())
    if not got:
        return Model([], {}, np.zeros(0), {})
    names = np.array([k for k, _ in got])
    members: dict[str, list[str]] = {}
    for k in sorted(set(names.tolist())):
        members.setdefault(FAMILY.get(k, k), []).append(k)
    families = sorted(members)
    # A family's machine tells it from all others, a pair's one language from another; of two families one machine tells both.
    first = [(f, -1, -1) for f in (families if len(families) > 2 else families[: len(families) - 1])]
    plan = first + [(f, i, j) for f in families for i in range(len(members[f])) for j in range(i + 1, len(members[f]))]
    held = spark.sparkContext.broadcast((names, [v for _, v in got], members))
    del got

    def machines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, members = held.value
        x = unpacked(rows)
        for batch in batches:
            for at, f, i, j in zip(*(batch.column(c).to_pylist() for c in ("at", "f", "i", "j")), strict=True):
                if i < 0:
                    w = svm(x, np.where([FAMILY.get(k, k) == f for k in names], 1.0, -1.0))
                else:
                    own = (names == members[f][i]) | (names == members[f][j])
                    w = svm(x[own], np.where(names[own] == members[f][i], 1.0, -1.0))
                yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    weights: dict[int, np.ndarray] = {}
    if plan:
        todo = spark.createDataFrame([(n, *x) for n, x in enumerate(plan)], "at long, f string, i int, j int")
        todo = todo.repartitionByRange(min(len(plan), shuffle_parts(spark)), "at")
        weights = {r["at"]: np.frombuffer(bytes(r["w"]), np.float32) for r in todo.mapInArrow(machines, "at long, w binary").collect()}
    held.destroy()  # executors and their workers would keep the sample while later stages run
    own = [weights[n] for n in range(len(first))]
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = {f: [] for f in families}
    for n, (f, i, j) in enumerate(plan[len(first) :], len(first)):
        pairs[f].append((i, j, weights[n]))
    return Model(families, members, np.array([*own, *(-w for w in own)] if len(families) == 2 else own), pairs)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score added, under these names (a clashing column is replaced)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    kept = docs.drop(*names)
    schema = StructType([*kept.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            got = [own.predict(x.as_py()) for x in batch.column("text")]
            new = [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])
        pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, schema)
