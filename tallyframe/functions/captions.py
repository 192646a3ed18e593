"""Captions: normal form, approximate matching against synonyms, section headings, noise."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import frequent, told
from ..store import settled
from .chart import CONCEPTS, SECTION_MARKERS

# Fixed value: an enumeration mark at the start of a caption; marks may be stacked.
MARKER = r"^(?:[\s(\[]*(?:[0-9]{1,2}|[a-zA-Z]|[ivxIVX]{1,4})[).\]:\-]+\s*)+"
# Fixed values of the score: the least that counts, what an edit costs, lengths and shares that weigh in, agreement with the section, and the gap within which other things decide.
LEAST, EDIT, LONG, SYNONYM, COVER, SAME, OTHER, GAP = 0.42, 1.6, 18, (0.6, 0.4), (0.55, 0.45), 1.12, 0.62, 0.08


def normalize(label: Column) -> Column:
    """The normal form of a caption."""
    s = F.lower(label)
    s = F.regexp_replace(s, r"\brn\b", "m")
    s = F.regexp_replace(F.regexp_replace(s, "æ", "ae"), "[‘’“”]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\*+", " "), r"\bnote\s*no\.?\s*\d*", " ")
    s = F.trim(F.regexp_replace(s, r"^\((.*)\)$", "$1"))
    return F.trim(F.regexp_replace(F.regexp_replace(s, MARKER, ""), r"\s+", " "))


def despace(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, "[^A-Za-z0-9]", ""))


def tolerance(n: int) -> int:
    """Edits that a synonym of n letters may be off."""
    return 1 if n <= 6 else 2 if n <= 12 else max(2, int(0.15 * n))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as rows of equal length (0 beyond a text's end), and lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), max(1, lengths.max(initial=0))), np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    return out, lengths


def substring_distances(texts: list[str], patterns: list[str]) -> np.ndarray:
    """For each text and pattern the fewest edits between the pattern and any part of the text; all pairs at a time, a step for each letter of the texts.

    A column of the edit table follows from the one before: the best of a change and a drop, then runs of insertions, which are a running minimum.
    """
    (t, nt), (p, np_) = _codes(texts), _codes(patterns)
    out = np.empty((len(texts), len(patterns)), np.int16)
    along = np.arange(p.shape[1] + 1, dtype=np.int16)
    ends = np.broadcast_to(np_, out.shape)[..., None]
    for at in range(0, len(texts), 32):
        own, n = t[at : at + 32], nt[at : at + 32]
        row = np.broadcast_to(along, (len(own), *p.shape[:1], len(along))).copy()
        best = np.take_along_axis(row, ends[at : at + 32], 2)[..., 0]
        for j in range(own.shape[1]):
            changed = row[..., :-1] + (own[:, j, None, None] != p)
            row[..., 1:] = np.minimum(changed, row[..., 1:] + 1)
            row[..., 0] = 0
            row = np.minimum.accumulate(row - along, axis=2) + along
            found = np.take_along_axis(row, ends[at : at + 32], 2)[..., 0]
            best = np.where((j < n)[:, None], np.minimum(best, found), best)
        out[at : at + 32] = best
    return out


def substring_distance(text: str, pattern: str) -> int:
    """The same for one pair."""
    return int(substring_distances([text], [pattern])[0, 0])


_SYNONYMS = [s for c in CONCEPTS for s in c["synonyms"]]
_OWNER = np.array([i for i, c in enumerate(CONCEPTS) for _ in c["synonyms"]])
_LENGTH = np.array([len(s) for s in _SYNONYMS])


def scores(bare: list[str], sections: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Score (-1: none) and distance of each text (letters and digits alone) against each synonym."""
    far = substring_distances(bare, _SYNONYMS)
    length = np.maximum([len(b) for b in bare], 1)[:, None]
    score = np.maximum(0, 1 - far * EDIT / _LENGTH) * (SYNONYM[0] + SYNONYM[1] * np.minimum(1, _LENGTH / LONG)) * (COVER[0] + COVER[1] * np.minimum(1, _LENGTH / length))
    own = np.array([c["section"] for c in CONCEPTS])[_OWNER]
    told = np.array([s or "" for s in sections])[:, None]
    score = np.clip(score * np.where(told == "", 1.0, np.where(told == own, SAME, OTHER)), 0, 1)
    barred = np.array([[any(x in b for x in c["exclude"]) for c in CONCEPTS] for b in bare]).reshape(len(bare), len(CONCEPTS))
    return np.where((far <= [tolerance(n) for n in _LENGTH]) & ~barred[:, _OWNER], score, -1.0), far


def _first(a: tuple, b: tuple) -> int:
    """Order of candidates (score, specificity, distance, length): by score where it differs clearly; else more specific, then nearer, then longer first. Not transitive."""
    if abs(a[0] - b[0]) > GAP:
        return 1 if a[0] < b[0] else -1
    return b[1] - a[1] or a[2] - b[2] or b[3] - a[3]


def classified(bare: list[str], sections: list[str | None], least: float = LEAST) -> list[tuple[str, float] | tuple[None, None]]:
    """The concept that each text names, and its score; nothing for prose and for texts of fewer than three letters."""
    out: list = []
    for at in range(0, len(bare), 256):
        score, far = scores(bare[at : at + 256], sections[at : at + 256])
        for text, own, d in zip(bare[at : at + 256], score, far, strict=True):
            found = []
            for i in dict.fromkeys(_OWNER[own >= least]) if len(text) >= 3 else ():
                k = int(np.where(_OWNER == i, own, -2.0).argmax())  # the concept's best synonym, the first on ties
                found.append((float(own[k]), CONCEPTS[i]["specificity"], int(d[k]), int(_LENGTH[k]), CONCEPTS[i]["concept"]))
            best = sorted(found, key=functools.cmp_to_key(_first))[0] if found else None
            out.append((best[4], best[0]) if best else (None, None))
    return out


def pieces(synonym: str) -> list[str]:
    """A synonym cut into one piece more than the edits that it may be off. An edit spoils one piece at most, so a text that holds the synonym with no more edits holds one of its pieces as it is."""
    parts = tolerance(len(synonym)) + 1
    cuts = [len(synonym) * i // parts for i in range(parts + 1)]
    return [synonym[i:j] for i, j in zip(cuts, cuts[1:])]


def pair_distances(texts: list[str], patterns: list[str]) -> np.ndarray:
    """For each pair the fewest edits between the pattern and any part of the text: substring_distances, of pairs instead of all with all."""
    (t, nt), (p, np_) = _codes(texts), _codes(patterns)
    along = np.arange(p.shape[1] + 1, dtype=np.int16)
    row, every = np.broadcast_to(along, (len(texts), len(along))).copy(), np.arange(len(texts))
    best = np_.astype(np.int16)
    for j in range(t.shape[1]):
        changed = row[:, :-1] + (t[:, j, None] != p)
        row[:, 1:] = np.minimum(changed, row[:, 1:] + 1)
        row[:, 0] = 0
        row = np.minimum.accumulate(row - along, axis=1) + along
        best = np.where(j < nt, np.minimum(best, row[every, np_]), best)
    return best


def near_synonyms(bare: DataFrame, text: str = "_b") -> DataFrame:
    """bare: distinct texts of letters and digits. text, synonym (its number) and distance, for the synonyms that are within their tolerance of a part of the text.

    The pieces of synonyms are a table of some hundred rows, whatever the input; it meets the parts of equal length of each text
    in an equi-join, and only synonyms that share a piece with a text are compared with it.
    """
    spark = bare.sparkSession
    index = sorted({(x, i) for i, s in enumerate(_SYNONYMS) for x in pieces(s)})
    known = F.broadcast(spark.createDataFrame(index, "part string, synonym int"))
    sizes = F.array(*map(F.lit, sorted({len(x) for x, _ in index})))
    starts = lambda n: F.sequence(F.lit(1), F.length(text) - n + 1)
    parts = F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(text)), lambda n: F.transform(starts(n), lambda i: F.substring(F.col(text), i, n))))
    found = bare.select(text, F.explode(F.array_distinct(parts)).alias("part")).join(known, "part").select(text, "synonym").distinct()

    @F.pandas_udf("int")
    def apart(texts: pd.Series, synonyms: pd.Series) -> pd.Series:
        return pd.Series(pair_distances(texts.tolist(), [_SYNONYMS[i] for i in synonyms]).astype("int32"))

    within = F.broadcast(spark.createDataFrame([(i, tolerance(len(s))) for i, s in enumerate(_SYNONYMS)], "synonym int, tolerance int"))
    # Not told to be deterministic, so that it runs after distinct(), and once.
    return found.withColumn("distance", apart.asNondeterministic()(text, "synonym")).join(within, "synonym").filter("distance <= tolerance").select(text, "synonym", "distance")


def candidates(keys: DataFrame, near: DataFrame, least: float = LEAST) -> DataFrame:
    """keys: distinct _b (text) and _s (section, or empty). Per key and concept the best synonym's score, specificity, distance and length, the first synonym on ties; only scores of `least` and more."""
    spark = keys.sparkSession
    rows = [(i, len(s), int(o), CONCEPTS[o]["concept"], CONCEPTS[o]["section"], CONCEPTS[o]["specificity"], list(CONCEPTS[o]["exclude"])) for i, (s, o) in enumerate(zip(_SYNONYMS, _OWNER, strict=True))]
    about = F.broadcast(spark.createDataFrame(rows, "synonym int, n int, at int, concept string, section string, specificity int, exclude array<string>"))
    each = keys.join(near, "_b").join(about, "synonym").filter(~F.exists("exclude", lambda x: F.contains("_b", x)))
    n, size = F.col("n"), F.greatest(F.length("_b"), F.lit(1))
    score = F.greatest(F.lit(0.0), 1 - F.col("distance") * EDIT / n) * (SYNONYM[0] + SYNONYM[1] * F.least(F.lit(1.0), n / LONG)) * (COVER[0] + COVER[1] * F.least(F.lit(1.0), n / size))
    score = score * F.when(F.col("_s") == "", 1.0).when(F.col("_s") == F.col("section"), SAME).otherwise(OTHER)
    scored = each.withColumn("score", F.least(F.lit(1.0), score)).filter(F.col("score") >= least)
    best = scored.groupBy("_b", "_s", "at").agg(F.max_by(F.struct("score", "specificity", "distance", "n", "concept"), F.struct("score", -F.col("synonym"))).alias("c"))
    return best.select("_b", "_s", "at", "c.*")


def classify(captions: DataFrame, label: str = "label", section: str = "section", bare: str | None = None) -> DataFrame:
    """captions with concept and label_score. bare: the column that has normal forms without spaces already, null for short ones.

    Distinct texts, as they stand, are brought into their normal form once for each section. Distinct normal forms are classified
    against those synonyms that share a piece with them. What was found is looked up by all captions; those that are too short
    name nothing and meet nothing.
    """

    @F.pandas_udf("int")
    def first(found: pd.Series) -> pd.Series:
        order = functools.cmp_to_key(lambda i, j: _first(i[0], j[0]))
        return pd.Series([sorted((((c["score"], c["specificity"], c["distance"], c["n"]), i) for i, c in enumerate(own)), key=order)[0][1] for own in found], dtype="int32")

    keyed = captions.withColumn("_t", F.col(bare or label)).withColumn("_s", F.coalesce(section, F.lit("")))
    # Normal forms are a chain of replacements, which a filter above them would repeat: they are made of distinct texts, and written.
    forms = keyed.filter("_t is not null").groupBy("_t", "_s").agg(F.count("*").alias("count"))
    forms = settled(forms.withColumn("_n", F.col("_t") if bare else normalize(F.col("_t"))).withColumn("_b", F.col("_n") if bare else despaced(F.col("_n"))).drop("_n"), "forms")
    keys = forms.filter(F.length("_b") >= 3).select("_b", "_s").distinct()
    found = candidates(keys, near_synonyms(keys.select("_b").distinct()))
    # A caption has as many candidates as there are concepts, at most.
    known = found.groupBy("_b", "_s").agg(F.array_sort(F.collect_list(F.struct("at", "score", "specificity", "distance", "n", "concept"))).alias("found"))
    known = known.withColumn("top", F.get("found", first("found"))).select("_b", "_s", F.col("top.concept").alias("concept"), F.col("top.score").alias("label_score"))
    texts = settled(forms.join(known, ["_b", "_s"]).select("_t", "_s", "concept", "label_score"), "known")
    return told(keyed, texts, ["_t", "_s"], frequent(forms, ["_t", "_s"])).drop("_t", "_s")


def despaced(normal: Column) -> Column:
    """The letters and digits of a normal form; null for short ones, which name nothing."""
    return F.when(F.length(normal) >= 3, despace(normal))


def heading(normal: Column, bare: Column) -> Column:
    """The section that a heading opens, by its normal form and the letters and digits of that; null for other captions.

    Both should be columns: a normal form is a chain of replacements, which would be run for each marker.
    """
    budget = lambda m: min(2, tolerance(len(m)))
    hits = [F.when(F.levenshtein(bare, F.lit(m), budget(m)) >= 0, s) for m, s in SECTION_MARKERS]
    return F.when((F.length(normal) <= 34) & (F.length(bare) >= 5) & ~F.startswith(bare, F.lit("total")), F.coalesce(*hits))


def section_of(label: Column) -> Column:
    """heading() of a caption."""
    return heading(normalize(label), despace(normalize(label)))


# What a row that is no line item starts with, or holds.
NOISE = (
    r"^(for|place|dated?|din|udin|membership|firm|partner|director|chartered)\b",
    r"accounting polic",
    r"^see accompanying",
    r"integral part of the financial statement",
)


def noise(normal: Column) -> Column:
    """Whether a row with this normal form is no line item."""
    return (F.length(normal) < 3) | (F.length(normal) > 110) | normal.rlike("|".join(NOISE))


def is_noise(label: Column) -> Column:
    return noise(normalize(label))
