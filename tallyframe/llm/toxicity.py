"""Toxicity by a weighted finite-state pattern grammar.

A text is read as a string of symbols: each word's classes (insult, harm, agent, target, object, negator, speech), quotation marks
and clause marks. Weighted transducers rewrite the string; each is an object with its own states and arcs, and they are composed:

* negation: an insult or harm within two words after a negator, or after a word that names words ("the word idiot"), weighs less;
* target: marks an insult with a second or third person within four words before or after it in its clause, and weighs it more.
  It is two machines, one for each direction of reading: what follows is read from right to left first;
* aim: marks a verb of harm with a person as its object within three words after it, or four before ("will dich umbringen", "you
  will be killed"); also two machines;
* threat: a verb of harm that is aimed at someone, within four words after an agent, a modal verb or one of intent, is a threat,
  which emits 1. Without an object it is none ("we burned dinner");
* insult: an insult emits its word's weight, and its pattern's: less without a target. Labelled toxic texts of the corpus hold bare
  insults among other words, so a bare one isn't nothing;
* reported speech: what is in quotation marks, up to the closing one or the line's end, over all of its clauses, and what
  follows a verb of saying in its clause or after its colon, is reported and weighs less.

The machines that read from left to right are composed into one, whose states are the combinations that texts reach. An emission's weight is
the product of the weights along the path. A clause's score is the sum of what it emits, so clauses that no pattern matches have none. A
document's score is a logistic function, fitted with the lexicon, of its clause scores: their sum, the highest, their number,
and their sum relative to the text's length.

Learned, from a bounded sample of labelled rows (labelled_sample, FIT_ROWS): the lexicon, as log-odds of words and stems in toxic
against other documents, of all whose rows are toxic too often for chance, however few they are (a handful do, of any number of
rows); and five coefficients.

Cases: null and empty texts have no clause and get the score of none. Texts of any length are read whole. Without any row of
either label, only the fixed word classes are left and nothing is insulting. Of equal stems and words the heaviest counts, and keys of
equal counts have equal weights, so ties in learning don't matter. Repeated rows are scored each, equal texts alike.
An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled rows that are learned from.
FIT_ROWS = 20_000
#: How much surer than chance a key must be, in logarithms.
MARGIN = 3.0
#: Lengths of the stems that are tried beside whole words.
STEMS = (4, 5, 6, 7)

# Word classes of the grammar.
TARGETS = frozenset("you your yours yourself u he she they them him her these those tu te vous toi du dich ihr euch sie usted ustedes ti vosotros".split())
OBJECTS = frozenset("you yourself him himself her herself them themselves dich dir euch ihn ihm ihnen te toi vous usted ustedes ti".split())
NEGATORS = frozenset("word words term wort mot palabra not never no isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais nunca".split())
SPEECH_VERBS = frozenset("said says wrote claims claimed quoted called reported sagte dit dijo".split())
AGENTS = frozenset(
    """i we i'll we'll i'm we're i'd we'd he she they he'll she'll they'll he's she's they're he'd she'd they'd ich wir er sie
    je nous il elle ils elles yo nosotros nosotras él ella ellos ellas
    will shall must should would gonna going want wants werde werden wird wirst soll sollst muss musst vais va vont veux voy vamos van quiero""".split()
)
HARMS = frozenset(
    """kill kills killed killing hurt hurts hurting destroy destroys destroyed destroying beat beats beaten beating shoot shoots shot
    shooting stab stabs stabbed stabbing burn burns burned burnt burning crush crushes crushed crushing hunt hunts hunted hunting
    umbringen umbringe umgebracht töten töte tötest tötet tötete töteten getötet tuer tue tues tuent tuons tuez tuerai tuera tuerons tueront tué tués tuée tuées
    matar mato matas mata matamos matan mataré matará mataremos matarán mató mataron matado matando""".split()
)

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]|[.!?;:\n]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

# Symbols: classes of a word, marks, and what the machines mark.
INSULT, HARM, AGENT, TARGET, NEGATOR, SPEECH, OBJECT, QUOTE, COLON, STOP, LINE, TARGETED, THREAT = (1 << i for i in range(13))
_CLASSES = ((AGENTS, AGENT), (HARMS, HARM), (TARGETS, TARGET), (OBJECTS, OBJECT), (NEGATORS, NEGATOR), (SPEECH_VERBS, SPEECH), ("\"“”«»", QUOTE), (":", COLON), (".!?;", STOP), ("\n", LINE))
_ENDS = COLON | STOP | LINE


@dataclass(frozen=True)
class Transducer:
    """Deterministic, from state 0: for each state, arcs by symbol to the next state, the symbol put out, and a weight."""

    arcs: list[dict[int, tuple[int, int, float]]]

    def run(self, symbols: Iterable[int]) -> list[tuple[int, float]]:
        """The symbols put out, and their weights."""
        out, own = [], self.arcs[0]
        for x in symbols:
            state, y, weight = own[x]
            out.append((y, weight))
            own = self.arcs[state]
        return out

    def then(self, other: Transducer) -> Transducer:
        """The composition: `other` reads what this one puts out. States are numbered, and arcs made, as a text reaches them."""
        number: dict[tuple[int, int], int] = {(0, 0): 0}
        arcs: list[dict[int, tuple[int, int, float]]] = []

        class Arcs(dict):
            def __init__(self, s: int, t: int):
                self.at = s, t

            def __missing__(held, x: int) -> tuple[int, int, float]:
                s, t = held.at
                s, y, v = self.arcs[s][x]
                t, z, w = other.arcs[t][y]
                if (s, t) not in number:
                    number[s, t] = len(number)
                    arcs.append(Arcs(s, t))
                held[x] = number[s, t], z, v * w
                return held[x]

        arcs.append(Arcs(0, 0))
        return Transducer(arcs)


def _alphabet() -> list[int]:
    """Words of any combination of classes, with and without the marks; and the marks of punctuation."""
    words = range(1 << 7)
    return [w | m for w in words for m in (0, TARGETED, THREAT, TARGETED | THREAT)] + [QUOTE, COLON, STOP, LINE]


def machine(states: int, step: Callable[[int, int], tuple[int, int, float]]) -> Transducer:
    """The transducer whose arcs `step` tells by state and symbol."""
    return Transducer([{x: step(s, x) for x in _alphabet()} for s in range(states)])


def window(opens: int, within: int, mark: Callable[[int], tuple[int, float]], before: bool = False) -> Transducer:
    """Marks what comes within so many words after a symbol of class `opens`, in its clause; with `before` the symbol itself opens first."""

    def step(state: int, x: int) -> tuple[int, int, float]:
        if x & (_ENDS | QUOTE):
            return (state if x & QUOTE else 0), x, 1.0
        left = within + 1 if before and x & opens else state
        out, weight = mark(x) if left else (x, 1.0)
        return (within if x & opens else max(0, state - 1)), out, weight

    return machine(within + 1, step)


#: Weights of the grammar's arcs.
NEGATED, BARE, REPORTED = 0.3, 0.8, 0.6


def _reported() -> Transducer:
    """States: 0 none, 1 after a verb of saying, 2 after its colon, 3 within quotation marks."""

    def step(state: int, x: int) -> tuple[int, int, float]:
        weight = REPORTED if state and x & (INSULT | HARM) else 1.0
        if x & LINE:
            return 0, x, 1.0
        if x & QUOTE:
            return (0 if state == 3 else 3), x, 1.0
        if state == 3:
            return 3, x, weight
        if x & COLON:
            return (2 if state == 1 else 0), x, 1.0
        if x & STOP:
            return 0, x, 1.0
        return (1 if x & SPEECH and state == 0 else state), x, weight

    return machine(4, step)


def grammar() -> tuple[Transducer, Transducer]:
    """The machine that reads from right to left, and the composed one that then reads from left to right."""
    targeted = lambda x: (x | TARGETED if x & INSULT else x, 1.0)
    aimed = lambda x: (x | TARGETED if x & HARM else x, 1.0)
    negation = window(NEGATOR, 2, lambda x: (x, NEGATED if x & (INSULT | HARM) else 1.0))
    threat = window(AGENT, 4, lambda x: (x | THREAT if x & HARM and x & TARGETED else x, 1.0))
    insult = machine(1, lambda _, x: (0, x, BARE if x & INSULT and not x & TARGETED and not x & THREAT else 1.0))
    after = window(TARGET, 4, targeted).then(window(OBJECT, 3, aimed))
    onward = negation.then(window(TARGET, 4, targeted, before=True)).then(window(OBJECT, 4, aimed)).then(threat).then(insult).then(_reported())
    return after, onward


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text, in lower case."""
    return set(_WORD.findall((text or "").lower()))


def keys_of(words: set[str]) -> set[str]:
    """Words and stems, as the lexicon names them: a stem ends with a hyphen."""
    return words | {f"{w[:n]}-" for w in words for n in STEMS if len(w) > n}


@dataclass
class Grammar:
    lexicon: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0, 0.0)
    machines: tuple[Transducer, Transducer] = field(default_factory=grammar)
    seen: dict[str, tuple[int, float]] = field(default_factory=dict)

    def symbol(self, token: str) -> tuple[int, float]:
        """A token's classes, and its weight as an insult: the word's own or its heaviest stem's."""
        if token not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            weight = max([self.lexicon.get(token, 0.0), *(self.lexicon.get(f"{token[:n]}-", 0.0) for n in STEMS if len(token) > n)])
            self.seen[token] = sum(mark for own, mark in _CLASSES if token in own) | (INSULT if weight else 0), weight
        return self.seen[token]

    def clauses(self, text: str | None) -> list[float]:
        """The scores of the clauses that a pattern matches."""
        read = [self.symbol(x) for x in _TOKEN.findall((text or "").lower())]
        if not any(x & (INSULT | HARM) for x, _ in read):
            return []
        after, onward = self.machines
        marked = [x for x, _ in after.run(x for x, _ in reversed(read))][::-1]
        scores, score = [], 0.0
        for (x, weight), (_, own) in zip(onward.run(marked), read, strict=True):
            if x & _ENDS:
                scores.append(score)
                score = 0.0
            elif x & (INSULT | THREAT):
                score += weight * (own + (1.0 if x & THREAT else 0.0))
        return [s for s in (*scores, score) if s > 0]

    def features(self, text: str | None) -> tuple[float, ...]:
        """Sum, highest and number of the scores of the clauses that match, and their sum for each 1000 words."""
        scores = self.clauses(text)
        dense = 1000 * sum(scores) / ((text or "").count(" ") + (text or "").count("\n") + 20)
        return tuple(float(np.log1p(x)) for x in (sum(scores), max(scores, default=0.0), len(scores), dense))

    def score(self, text: str | None) -> float:
        b, *w = self.coefficients
        z = b + sum(x * y for x, y in zip(w, self.features(text), strict=True))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}, "machines": None}  # the machines have no learned part: a task makes its own

    def __setstate__(self, held: dict) -> None:
        self.__dict__ = held | {"machines": grammar()}


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Weights (1 at most) of the words and stems that tell toxic rows (text, toxic) from others."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                own = list(keys_of(words_of(text.as_py())))
                yield pa.RecordBatch.from_pydict({"key": pa.array(own, pa.string()), "toxic": pa.array([toxic] * len(own), pa.int32())})

    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return {}
    counts = rows.select("text", "toxic").mapInArrow(keys, "key string, toxic int").groupBy("key").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    rate = (F.col("bad") + 0.1) / totals[1] / ((F.col("good") + 0.1) / totals[0])
    # A key tells something if its rows are toxic more often than chance among all keys would have it: so many times the divergence
    # of its share from the sample's is more than the logarithm of the number of keys, and MARGIN. One in many other rows isn't an insult.
    counts = materialize(counts, "keys")
    n, base = F.col("bad") + F.col("good"), totals[1] / (totals[0] + totals[1])
    share = F.col("bad") / n
    sure = n * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))
    best = counts.filter((F.col("bad") >= 3) & (rate >= 8) & (sure >= float(np.log(max(1, counts.count())) + MARGIN))).select("key", "bad", F.log(rate).alias("w"))
    heavy = {r["key"]: r["w"] for r in best.select("key", "w").collect()}
    top = max(heavy.values(), default=1.0)
    return {k: w / top for k, w in heavy.items()}


def fit(labelled: DataFrame) -> Grammar:
    """Learns from labelled: doc_id, text, toxic (0 or 1; other rows are left out), a bounded sample as labelled_sample takes it.

    The coefficients come from a half of the rows, with the lexicon of the other half; then the lexicon is learned from all.
    """
    rows = labelled.filter("toxic in (0, 1) and text is not null").select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic"))
    sample = materialize(rows.withColumn("half", F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(2))), "labelled")
    half = Grammar(lexicon(sample.filter("half = 0")))
    whole = Grammar(lexicon(sample))
    held = labelled.sparkSession.sparkContext.broadcast(half)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [held.value.features(t.as_py()) for t in batch.column("text")]
            if x:
                a, b, c, d = zip(*x, strict=True)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b, "c": c, "d": d, "toxic": batch.column("toxic")})

    got = np.array([tuple(r) for r in sample.filter("half = 1").select("text", "toxic").mapInArrow(features, "a double, b double, c double, d double, toxic int").collect()])
    if whole.lexicon and len(got) and 0 < got[:, 4].mean() < 1:
        whole.coefficients = logistic(got[:, :4], got[:, 4])
    return whole


def logistic(x: np.ndarray, y: np.ndarray, strength: float = 1e-3, steps: int = 50) -> tuple[float, ...]:
    """Intercept and weights by Newton's method, with a small penalty."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + strength * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + strength * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w)


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs's doc_id and held_out with score, of the whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = held.value
            scores = pa.array([own.score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], ["doc_id", "held_out", "score"])

    return docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double")
