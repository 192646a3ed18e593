"""License scan, ball k-means and conversation trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import balls, licences, turntrie
from tallyframe.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def base_by_force(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


LICENSE_TEXTS = [
    None, "", "...", "cc by", "CC-BY", "cc by", "Ccc by cc by cc by", "GNU General Public License v3. All rights reserved! all RIGHTS reserved", "general public general public license",
    "Released under the MIT License.", "K CC by écc by", "rights reserved", "all all rights reserved cc", "x " * 5000 + "All  Rights\nReserved" + " cc by" * 3000,
]


def test_license_base_by_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(LICENSE_TEXTS)] + [(3, "cc by", "x", 1.0), (None, "cc by", "x", 1.0)], "doc_id long, text string, labels string, score double")
    got = licences.scan(docs).collect()
    assert len(got) == len(LICENSE_TEXTS) + 2
    for r in got:
        text = "cc by" if r["doc_id"] is None else LICENSE_TEXTS[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_by_force(text)
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert licences.scan(docs.limit(0)).count() == 0


def test_license_query_by_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_license_scan"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_by_force(docs[r["doc_id"]])
        lines = {"mit": "released under the mit license", "apache-2.0": "licensed under the apache license", "cc-by-nc": "licensed under cc by-nc"}
        text = (docs[r["doc_id"]] or "").lower()
        assert {x for x, line in lines.items() if line in text} == set(r["labels"].split(",")) & set(lines)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=30))
def test_matching_statistics_by_force(templates, text):
    """The state after each word: the longest run that ends there and is in a template, and all places where it ends."""
    own = licences.Automaton(tuple(licences.Template("x", " ".join(t)) for t in templates))
    v = run = 0
    for i, w in enumerate(text):
        c = own.vocabulary.get(w.encode(), -1)
        while v and c not in own.next[v]:
            v, run = own.link[v], own.length[own.link[v]]
        v, run = (own.next[v][c], run + 1) if c in own.next[v] else (0, 0)
        runs = [n for n in range(i + 1, 0, -1) if any(t[j : j + n] == text[i + 1 - n : i + 1] for t in templates for j in range(len(t)))]
        assert run == (runs[0] if runs else 0)
        if run:
            want = [(k, j + run) for k, t in enumerate(templates) for j in range(len(t) - run + 1) if t[j : j + run] == text[i + 1 - run : i + 1]]
            assert sorted(own.ends[v]) == want


def test_spans_of_edited_licenses():
    own = licences.Automaton()
    mit = next(t.text for t in licences.TEMPLATES if t.text.startswith("permission is hereby")).split()
    edited = "lorem ipsum " * 50 + " ".join(mit[:12]).upper() + ",\n" + " ".join(["widgets", *mit[14:40]]) + " " + " ".join(mit[41:]) + " dolor sit" * 50
    found = own.scan(edited.encode())
    assert found.labels == {"mit"} and len(found.spans) == 1 and 0.85 < found.score < 1
    label, start, end, _ = found.spans[0]
    assert start == 100 and end == 100 + len(mit) - 2
    assert own.scan(" ".join(mit[:15]).encode()).labels == set() == own.scan(b"the software is the best of any kind and the license is free").labels
    halves = " ".join(mit[:15]) + " filler" * 40 + " " + " ".join(mit[15:])
    assert own.scan(halves.encode()).labels == {"mit"} and 0.6 < own.scan(halves.encode()).score < 0.8
    assert own.scan(("zzz " * 500_000 + "all rights reserved ").encode()).first == 500_000


def k_means_by_force(vectors, k, rounds):
    kept = [(i, [int(np.floor(float(x) * 64)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((apart(v, c), j) for j, c in enumerate(cents))[::-1]
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[0]].append(v)
        cents = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(cents)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = defaultdict(int)
    for _, j, d in last:
        total[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((i, j, d, total[j], sum(total.values()), sha[j]) for i, j, d in last)


@pytest.mark.parametrize("n, spread", [(0, 1.0), (5, 1.0), (300, 1.0), (300, 0.03)])
def test_ball_k_means_by_force(spark, n, spread):
    """Few levels make ties; repeated rows make centroids that coincide."""
    rng = np.random.default_rng(n)
    rows = [(i, (np.round(rng.normal(size=64) * spread * 8) / 8 + rng.integers(3) * spread).tolist()) for i in range(n)]
    if n:
        rows += rows[:4] + [(1000, None), (1001, [0.5] * 63), (1002, [0.5] * 65), (1003, [None] + [0.5] * 63), (1004, [float("nan")] + [0.5] * 63), (1005, [float("inf")] + [0.5] * 63), (1006, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int").repartition(5)
    got = sorted(tuple(r) for r in balls.clusters(df).collect())
    assert got == k_means_by_force(rows, 16, 3)


def test_ball_k_means_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(ORACLE_SQL["op12_ball_k_means"]).df()
    got = QUERIES["op12_ball_k_means"](spark, SF).toPandas()
    assert sorted(map(tuple, got[want.columns.tolist()].to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))


def test_balls_leave_out_most_distances():
    """Stable cores aren't compared, and what is left out changes nothing."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-300, 300, (16, 8))
    x = np.repeat(centres, 50, 0) + rng.integers(-40, 40, (800, 8))
    cluster = np.repeat(np.arange(16), 50).astype(np.int32)
    cluster[::7] = 0
    radii = np.array([((x[cluster == i] - centres[i]) ** 2).sum(1).max() for i in range(16)])
    out, least, read = balls.Balls(centres, radii).assign(x, cluster)
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (out == d.argmin(1)).all() and (least == d.min(1)).all() and read < 0.5 * d.size


def trie_by_force(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for seq, own in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        leaf = lambda s: not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in members)
        ends = sorted(c for c in own if len(built[c]) == len(seq))
        saved = sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in below if s)
        parent = min(members[seq[:-1]]) if seq else None
        out.append((min(own), len(seq), parent, len(own), sum(len(s) == len(seq) + 1 for s in below), sum(map(leaf, below)), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    return sorted((tuple(r) for r in df.select(*NODE).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_trie_by_force(spark, seed):
    """Few texts, so conversations share prefixes, are copies or prefixes of others, and trees of chains are high."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), 60):
        n = rng.choice([1, 2, 4, 9, 12, 14])
        rows += [(c, rng.choice([None, t, t]), rng.choice(["user", "user", None]), rng.choice(["a", "a", "a", "éè", None])) for t in range(n)]
    rows += rows[:7] + [(None, 1, "user", "a"), (500, 0, "", ""), (505, 0, "x", "y")]
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, owner int, part string").repartition(4)
    assert nodes(turntrie.trie(df)) == trie_by_force(rows)


def test_trie_of_long_and_equal_conversations(spark, monkeypatch):
    """A conversation over many ranges, many copies, a high tree of chains, keys that are looked up by broadcast, strings of few ids."""
    monkeypatch.setattr(turntrie, "SHARE", 8)
    monkeypatch.setattr(turntrie, "CHUNK", 3)
    rows = [(5 * i, t, "user", f"t{t}") for i in range(12) for t in range(3 * i + 1)] + [(1000 + 5 * i, t, "user", "same") for i in range(40) for t in range(2)] + [(2000, t, "user", f"t{t % 7}") for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert nodes(turntrie.trie(df)) == trie_by_force(rows)


def test_trie_of_few(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert nodes(turntrie.trie(spark.createDataFrame([], schema))) == []
    one = [(7, 1, None, None)]
    assert nodes(turntrie.trie(spark.createDataFrame(one, schema))) == trie_by_force(one)


def test_trie_query_by_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(QUERIES["op13_conversation_trie"](spark, SF)) == trie_by_force(rows)
