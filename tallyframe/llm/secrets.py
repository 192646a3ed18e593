"""Secret scans over a trigram inverted index, in DataFrame functions alone.

1. Each rule's regular expression is parsed on the driver into a Boolean trigram query: every run of literals that a match must
   hold is a segment; a segment is an OR of its alternatives, an alternative an AND of its trigrams (in lower case).
2. The index holds postings (trigram, document) of all whole texts, for the trigrams that some rule asks for.
3. Postings are intersected relationally: joined with the query table (a few rows for each rule), counted by document, rule,
   segment and alternative, which needs no posting list in one place, however common its trigram.
4. A rule's expression runs over its candidates only. Rules without mandatory trigrams run over every text.

Texts of candidates are picked through a bit table of at most FILTER_BITS bits (its size is the proven bound of what is
broadcast) before the exact join, so texts without candidates aren't shuffled.

Cases: a null text counts as empty and has no span; a null doc_id, repeated ids and repeated rows are scanned each; an empty
table gives no rows. Texts of any length are scanned whole, and matches folded in parts. Spans that start at one place come in the
order of the rules. Other columns are ignored, whatever their names (redact keeps them).
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FILTER_BITS = 1 << 24


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: the fewest characters that `group` must have; shorter matches are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


def _cased(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_cased, ("password", "passwd", "secret", "token")), f"{_cased('api')}_?{_cased('key')}"])

RULES = (
    Rule("assign", f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    # Runs of 24 on are the same as all runs, the shorter dropped: a run's match begins where the run does.
    Rule("hex", "[0-9a-f]{24,}", 0, 24, True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def segments(pattern: str) -> list[list[frozenset[str]]]:
    """The Boolean trigram query of a pattern: an AND of segments, each an OR of sets of trigrams."""
    out = []
    for options in _runs(rp.parse(pattern)):
        if options and min(map(len, options)) >= 3:
            out.append([frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in sorted(options)])
    return out


def _runs(parsed, most: int = 16) -> list[set[str]]:
    """Runs of text that every match holds, each as the set of its variants in lower case; a run ends where variants are too many."""
    runs, now = [], {""}

    def end() -> None:
        nonlocal now
        runs.append(now)
        now = {""}

    for kind, value in parsed:
        exact = _exact(kind, value, most)
        if exact is None:
            end()
            if kind is rc.SUBPATTERN:
                runs += _runs(value[3], most)
            continue
        if len(now) * len(exact) > most:
            end()
        now = {a + b for a in now for b in exact}
    end()
    return runs


def _exact(kind, value, most: int) -> set[str] | None:
    """The strings that a part matches, if they are few."""
    if kind is rc.LITERAL:
        return {chr(value).lower()}
    if kind is rc.IN:
        if any(k is not rc.LITERAL for k, _ in value):
            return None
        found = {chr(v).lower() for _, v in value}
    elif kind is rc.BRANCH:
        found = set()
        for option in value[1]:
            if (own := _joined(option, most)) is None:
                return None
            found |= own
    elif kind is rc.SUBPATTERN:
        found = _joined(value[3], most)
    elif kind is rc.MAX_REPEAT:
        low, high, inner = value
        one = _joined(inner, most)
        if one is None or high is rc.MAXREPEAT or high > 4:
            return None
        found = set()
        for n in range(low, high + 1):
            found |= reduce(lambda a, b: {x + y for x in a for y in b}, [one] * n, {""})
    else:
        return None
    return found if found is not None and len(found) <= most else None


def _joined(parts, most: int) -> set[str] | None:
    out = {""}
    for kind, value in parts:
        if (own := _exact(kind, value, most)) is None:
            return None
        out = {a + b for a in out for b in own}
    return out if len(out) <= most else None


def _postings_pattern(trigrams: list[str]) -> str:
    """An expression that finds each of the trigrams wherever it begins, overlapping ones too."""
    by_first: dict[str, list[str]] = {}
    for t in trigrams:
        by_first.setdefault(t[0], []).append(t[1:])
    quote = lambda x: "".join(f"\\x{ord(c):02x}" if not c.isalnum() else c for c in x)
    return "(?=(" + "|".join(f"{quote(a)}(?:{'|'.join(map(quote, b))})" for a, b in sorted(by_first.items())) + "))"


#: Matches that are folded at a time: a fold copies what it has gathered at each step, so long ones go in parts.
PART = 256
_SPANS = "array<struct<start:long,ord:int,stop:long,kind:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_parts(rows: Column, after: Callable[[Column, Column], Column], fold: Callable[[Column, Column], Column]) -> Column:
    """The arrays that `fold` makes of parts of an array, joined. A part gets what the parts before it carry: `after` tells it, from 0."""
    n = F.greatest(F.ceil(F.size(rows) / PART).cast("int") - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(rows, i * PART + 1, PART))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    step = lambda s, p: F.struct(after(p, s["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    carried = lambda ps: F.aggregate(ps, start, step, lambda s: s["out"])
    return _let(parts, lambda ps: _let(carried(ps), lambda at: F.flatten(F.transform(ps, lambda p, i: fold(p, F.get(at, i))))))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in a text: array of (start, order, stop, kind), in code points. The pieces between matches give their places."""
    found, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    lengths = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    long_ = lambda x: (F.length(x["between"]) + F.length(x["found"])).cast("long")

    def step(state: Column, x: Column) -> Column:
        start, stop = state["at"] + F.length(x["between"]), state["at"] + long_(x)
        span = F.struct(start.cast("long").alias("start"), F.lit(order).alias("ord"), stop.cast("long").alias("stop"), F.lit(rule.kind).alias("kind"))
        kept = F.when(F.length(x["sized"]) >= rule.least, F.concat(state["out"], F.array(span).cast(_SPANS))).otherwise(state["out"])
        return F.struct(stop.cast("long").alias("at"), kept.alias("out"))

    fold = lambda p, at: F.aggregate(p, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out")), step, lambda s: s["out"])
    after = lambda p, at: F.aggregate(p, at, lambda n, x: n + long_(x))
    rows = _let(found, lambda f: F.arrays_zip(F.slice(between, F.lit(1), F.size(f)).alias("between"), f.alias("found"), lengths.alias("sized")))
    return F.when(text.rlike(rule.pattern), _let(rows, lambda r: _in_parts(r, after, fold))).otherwise(F.array().cast(_SPANS))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and the row's key: hash, and doc_id with null as 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("kh"), F.coalesce("doc_id", F.lit(0)).alias("kd"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """kh, kd and rules (the kinds whose Boolean query the row's trigrams meet). rows: from keyed()."""
    spark = rows.sparkSession
    query = [(r.kind, s, a, t, len(alt), len(segs)) for r in rules for segs in [segments(r.pattern)] for s, seg in enumerate(segs) for a, alt in enumerate(seg) for t in sorted(alt)]
    asked = F.broadcast(spark.createDataFrame(query, "kind string, seg int, alt int, tri string, need int, segs int"))
    pattern = _postings_pattern(sorted({q[3] for q in query}))
    tris = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1)))
    postings = rows.select("kh", "kd", F.explode(tris).alias("tri"))
    met = postings.join(asked, "tri").groupBy("kh", "kd", "kind", "seg", "alt").agg(F.count_distinct("tri").alias("n"), F.first("need").alias("need"), F.first("segs").alias("segs")).filter("n = need")
    return met.groupBy("kh", "kd", "kind").agg(F.count_distinct("seg").alias("n"), F.first("segs").alias("segs")).filter("n = segs").groupBy("kh", "kd").agg(F.collect_set("kind").alias("rules"))


def maybe_among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose key's bit is set by a key of `wanted`: all of those, and few others."""
    bit, word = F.pmod("kh", F.lit(FILTER_BITS)), lambda b: F.shiftright(b, 6)
    words = wanted.select(bit.alias("b")).groupBy(word(F.col("b")).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    set_bit = F.expr("(shiftrightunsigned(bits, cast(b & 63 as int)) & 1) = 1")
    return rows.withColumn("b", bit).withColumn("w", word(F.col("b"))).join(F.broadcast(words), "w").filter(set_bit).drop("b", "w", "bits")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, kh, kd and spans, an array of (start, ord, stop, kind), by start, then by the order of the rules."""
    rows = keyed(docs)
    order = {r.kind: i for i, r in enumerate(rules)}
    full = [r for r in rules if not segments(r.pattern)]
    indexed = [r for r in rules if segments(r.pattern)]
    asked = materialize(candidates(rows, rules), "candidates")
    checked = maybe_among(rows, asked).join(asked, ["kh", "kd"])
    empty = F.array().cast(_SPANS)
    hit = F.concat(*[F.when(F.array_contains("rules", r.kind), spans_of(F.col("text"), r, order[r.kind])).otherwise(empty) for r in indexed])
    verified = checked.select("kh", "kd", hit.alias("more")).filter(F.size("more") > 0).dropDuplicates(["kh", "kd"])
    always = F.concat(empty, *[spans_of(F.col("text"), r, order[r.kind]) for r in full])
    both = rows.select("doc_id", "kh", "kd", always.alias("always")).join(verified, ["kh", "kd"], "left")
    return both.select("doc_id", "kh", "kd", F.array_sort(F.concat("always", F.coalesce("more", empty))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count for each base rule, base_sha256 and spans."""
    base = [r.kind for r in rules if r.base]
    counted = [F.expr(f"size(filter(spans, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in base]
    return scan(docs, rules).select("doc_id", *counted, F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by a mark, and overlapping spans by one; rows without spans stay as they are, null texts too.

    A column n_chars, if there is one, is set to the new length where a text changes.
    """
    found = scan(docs, rules).filter(F.size("spans") > 0).select("kh", "kd", "spans").dropDuplicates(["kh", "kd"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*docs.columns).alias("row")  # so that no column of docs clashes with those used here
    rows = docs.select(row, text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("kh"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("kd"))

    def step(state: Column, x: Column) -> Column:
        fresh = x["start"] >= state["at"]
        gap = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int"))
        return F.struct(F.greatest(state["at"], x["stop"]).alias("at"), F.when(fresh, F.concat(state["out"], F.array(gap, F.lit(mark)))).otherwise(state["out"]).alias("out"))

    fold = lambda p, at: F.aggregate(p, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda s: s["out"])
    after = lambda p, at: F.greatest(at, F.array_max(F.transform(p, lambda x: x["stop"])))
    last = F.array_max(F.transform("spans", lambda x: x["stop"]))
    anew = F.concat(F.array_join(_in_parts(F.col("spans"), after, fold), ""), F.substring(F.col("text"), (last + 1).cast("int"), F.lit(2**31 - 1)))
    both = rows.join(found, ["kh", "kd"], "left").withColumn("anew", F.when(F.col("spans").isNotNull(), anew))
    kept = F.col("anew").isNull()
    changed = {"text": F.when(kept, F.col("row.text")).otherwise(F.col("anew"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(kept, F.col("row.n_chars")).otherwise(F.length("anew").cast(docs.schema["n_chars"].dataType))
    return both.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of digest()."""
    quote = lambda x: x.replace("'", "''")
    parts = []
    for i, r in enumerate(rules):
        parts.append(
            f"SELECT rid, {i} AS ord, '{r.kind}' AS kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a, length(m[i]) AS n, length(g[i]) AS g, {r.least} AS least "
            f"FROM (SELECT rid, p, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, string_split_regex(t, '{quote(r.pattern)}') AS p, regexp_extract_all(t, '{quote(r.pattern)}') AS m, regexp_extract_all(t, '{quote(r.pattern)}', {r.group}) AS g FROM d WHERE regexp_matches(t, '{quote(r.pattern)}')))"
        )
    base = [r.kind for r in rules if r.base]
    names = ", ".join(f"'{k}'" for k in base)
    counts = ", ".join(f"CAST(coalesce(count(*) FILTER (kind = '{k}'), 0) AS BIGINT) AS n_{k}" for k in base)
    one = "string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, ord)"
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), s AS ("
        + " UNION ALL ".join(parts)
        + f"), k AS (SELECT * FROM s WHERE g >= least), r AS (SELECT rid, {counts}, sha256(coalesce({one} FILTER (kind IN ({names})), '')) AS base_sha256, coalesce({one}, '') AS spans FROM k GROUP BY rid) "
        + "SELECT d.doc_id, "
        + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)
        + ", coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (rid)"
    )
