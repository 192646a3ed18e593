"""The registered queries on the driver's smallest tables: against their SQL, or against a plain version; and the pipeline's stages likewise."""

import os
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import langid, mixing, packing, quality, secrets, token_files, topk, toxicity
from tallyframe.llm.common import crc_mod, labelled_sample
from tallyframe.llm.queries import ORACLE_SQL, QUERIES, vocabulary
from tests.llm.test_ops import clauses_by_force, crc, groups_by_force, reference, spans_by_force, tokenizer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def plain(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).toPandas().itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    own = lambda df: sorted((tuple(None if v is None or v is pd.NA or v != v else round(v, 9) if isinstance(v, float) else v for v in r) for r in df[sorted(want.columns)].itertuples(index=False, name=None)), key=lambda r: [(v is not None, v if isinstance(v, (int, float)) else str(v)) for v in r])
    assert sorted(got.columns) == sorted(want.columns) and own(got) == own(want)


def test_token_files(spark, docs):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op2_token_files"](spark, SF).collect()}
    t, start = tokenizer("word_bpe_49k.json"), 0
    for r in docs.orderBy("doc_id").collect():
        ids = reference(t, r["text"], 1)
        assert got[r["doc_id"]] == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_rows_and_masks(spark, docs, tmp_path):
    """Any span of a file is found by arithmetic in equal rows; the mask is false on the padding alone."""
    manifest, root = token_files.encode_to_files(docs.limit(20), vocabulary("word_bpe_49k.json"))
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(root)
    for m in manifest.collect():
        rows = token_files.RowReader(store, m["ids_path"])
        ids = np.concatenate(list(rows.spans(0, m["n_ids"])))
        masks = np.concatenate([b[1].to_numpy(zero_copy_only=False) for b in rows.batches])
        assert len(ids) == m["n_ids"] and masks[: len(ids)].all() and not masks[len(ids) :].any() and len(masks) % rows.length == 0
        for a, n in ((0, 1), (5, 700), (m["n_ids"] - 3, 3)):
            assert np.concatenate(list(rows.spans(a, n))).tolist() == ids[a : a + n].tolist()


def test_packing(spark, docs):
    got, t = QUERIES["op5_best_fit_packing"](spark, SF).collect(), tokenizer("byte_bpe_50k.json")
    want = {(r["doc_id"], k, a, n, crc(ids[a : a + n])) for r in docs.collect() for ids in [reference(t, r["text"], 0)] for k, (a, n) in enumerate(packing.cut(len(ids), 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) * 1.01 + 1


def test_jaccard_join(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op6_jaccard_join"](spark, SF).collect()}
    assert got == groups_by_force([(r["doc_id"], r["text"]) for r in docs.collect()], 4, 85, 100)


def test_near_graph(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])}
    ids = sorted(x)
    u = np.array([x[i] / np.linalg.norm(x[i]) for i in ids])
    link = (u @ u.T >= 0.95) & ~np.eye(len(ids), dtype=bool)
    top = list(range(len(ids)))
    for _ in ids:
        for i, j in zip(*np.nonzero(link), strict=True):
            top[i] = top[j] = min(top[i], top[j])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op4_near_graph"](spark, SF).collect()}
    assert len(got) == len(rows) and all(got[i] == (int(link[k].sum()), ids[top[k]]) for k, i in enumerate(ids))


def held_out(doc_id, m, r):
    return zlib.crc32(str(doc_id).encode()) % m == r


def features_by_hand(text):
    """Hashed letters, pairs and triples of letters, one by one."""
    if not any(c.isalpha() for c in text or ""):
        return None
    s = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())) + " "
    counts = np.zeros(4096)
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            h = 0
            for j in range(n):
                h = (h * 0x01000193 + ord(s[i + j]) + j + 1) % 2**32
            counts[h * 0x9E3779B1 % 2**32 >> 20] += 1
    x = np.sqrt(counts)
    return np.append(x / np.sqrt((x**2).sum()), 1.0)


def language_by_hand(model, text):
    """The family with the highest machine, then votes of its pairs, then margins, then the alphabet."""
    x = features_by_hand(text)
    if x is None:
        return "und", 0.0
    sure = lambda m: 1 / (1 + np.exp(-4 * m))
    heights = [float(w @ x) for w in model.family_weights] or [0.0]
    top = max(range(len(heights)), key=lambda i: heights[i])
    own = model.members[model.families[top]]
    score = sure(heights[top]) if len(model.families) > 1 else 1.0
    if len(own) == 1:
        return own[0], score
    won = {k: [0, 0.0] for k in own}
    for i, j, w in model.pairs[model.families[top]]:
        m = float(w @ x)
        won[own[i] if m >= 0 else own[j]][0] += 1
        won[own[i]][1] += m
        won[own[j]][1] -= m
    best = min(own, key=lambda k: (-won[k][0], -won[k][1], k))
    return best, score * sure(won[best][1] / (len(own) - 1))


def test_language_id(spark, docs):
    """Every row by hand, with the model's weights; held-out accuracy."""
    got = QUERIES["op9_language_id"](spark, SF).collect()
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 4) != 2)
    truth = {r["doc_id"]: r for r in docs.collect()}
    assert len(got) == len(truth)
    for r in got:
        lang, score = language_by_hand(model, truth[r["doc_id"]]["text"])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-5) and r["held_out"] == held_out(r["doc_id"], 4, 2)
    known = [r for r in got if r["held_out"] and truth[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert np.mean([truth[r["doc_id"]]["lang"] == r["lang_pred"] for r in known]) >= 0.95


def statistics_by_hand(text):
    n, w = len(text), [x for x in re.split("[ \n\t]+", text) if x]
    share = lambda p: len(re.findall(p, text)) / (n + 1)
    return {
        "length": np.log1p(n), "words": np.log1p(len(w)), "distinct": len(set(w)) / (len(w) + 1), "word_length": n / (len(w) + 1), "upper": share("[A-Z]"), "digits": share("[0-9]"), "stops": share("[.,;:]"), "marks": share("[!?]"),
        "symbols": share(r"[#$%&*@^~_=+<>|\\/{}\[\]]"), "lines": share("\n"), "repeats": share(r"(?<![^ \n])([^ \n]+) \1(?![^ \n])"),
    }


def test_quality_rules(spark, docs):
    """Every row by the rules, evaluated by hand; held-out accuracy."""
    got = QUERIES["op7_quality_rules"](spark, SF).collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality.fit(labelled_sample(docs.filter(crc_mod(F.col("doc_id"), 5) != 0), labels, "quality", quality.FIT_ROWS))
    texts, truth = {r["doc_id"]: r["text"] or "" for r in docs.collect()}, {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(got) == len(texts)
    for r in got:
        s = statistics_by_hand(texts[r["doc_id"]])
        z = rules.intercept + sum(w for terms, w in rules.rules if all((s[t.name] > t.bound) == t.above for t in terms))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9) and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held_out(r["doc_id"], 5, 0)
    known = [r for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in known]) >= 0.9


def toxicity_by_hand(grammar, text):
    """The clauses of the plain version, and the logistic function of their sum, highest, number and density."""
    found = clauses_by_force(grammar.lexicon, text or "")
    dense = 1000 * sum(found) / ((text or "").count(" ") + (text or "").count("\n") + 20)
    b, *w = grammar.coefficients
    z = b + sum(x * np.log1p(v) for x, v in zip(w, (sum(found), max(found, default=0.0), len(found), dense), strict=True))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_toxicity(spark, docs):
    """Every row by the plain version of the grammar, with what was learned."""
    got = QUERIES["op10_toxicity"](spark, SF).collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    grammar = toxicity.fit(labelled_sample(docs.filter(crc_mod(F.col("doc_id"), 3) != 1), labels, "toxic", toxicity.FIT_ROWS))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        assert r["score"] == pytest.approx(toxicity_by_hand(grammar, texts[r["doc_id"]])) and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held_out(r["doc_id"], 3, 1)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_toxicity_held_out(spark):
    """Of the labelled rows that weren't learned from."""
    got = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("toxic is not null"), "doc_id").collect()
    assert np.mean([r["predicted"] for r in got if r["toxic"] == 1]) >= 0.6 and np.mean([r["predicted"] for r in got if r["toxic"] == 0]) <= 0.02


def test_empty_tables_and_clashing_vectors(spark, docs):
    assert toxicity.score(docs.limit(0).withColumn("held_out", F.lit(True)), toxicity.Grammar()).count() == 0 and toxicity.fit(docs.limit(0).withColumn("toxic", F.lit(1))).lexicon == {}
    rows = [(i, [float(i % 7), 1.0], "x") for i in range(30)]
    plain_rows = spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<double>")
    clash = plain_rows.withColumns({c: F.lit("x") for c in ("id", "v", "q", "g", "block", "score", "rank", "query_id", "ids", "m")})
    found = lambda df: sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect()))
    assert found(clash) == found(plain_rows) and len(found(clash)) == 10


def test_stages_by_force(spark, docs, tmp_path):
    """Each stage on what the one before it left, against a plain version."""
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = left.collect()
        left = stage(spark, left, SF)
        left.write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        rows = left.collect()
        if name != "best_fit_packing":
            assert left.columns == columns
        if name == "language_id":
            model = langid.fit(docs, crc_mod(F.col("doc_id"), 4) != 2)
            want = {r["doc_id"]: lang for r in before for lang in [model.predict(r["text"])[0]] if lang != "und"}
            assert {r["doc_id"]: r["lang"] for r in rows} == want and len(rows) == len(want)
        elif name == "near_duplicates":
            top = groups_by_force([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, (_, c) in top.items() if i == c)
        elif name == "secret_scan":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before}
            clean = {r["doc_id"]: r["text"] for r in rows}
            for r in before:
                at, out = 0, ""
                for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans_by_force(r["text"]).split(",") if x):
                    if a >= at:
                        out += r["text"][at:a] + "[secret]"
                    at = max(at, b)
                assert clean[r["doc_id"]] == out + (r["text"] or "")[at:]
        elif name == "source_mixing":
            held, taken = defaultdict(int), defaultdict(int)
            for r in before:
                held[r["source"]] += len((r["text"] or "").split())
            for r in rows:
                taken[r["source"]] += len((r["text"] or "").split())
            longest = max(len((r["text"] or "").split()) for r in before)
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before} and all(held[s] <= taken[s] <= 2 * held[s] + longest for s in held)
        else:
            t = tokenizer("byte_bpe_50k.json")
            n = sum(len(reference(t, r["text"], 0)) for r in before)
            assert sum(r["length"] for r in rows) == n and len({r["sequence_id"] for r in rows}) <= -(-n // 2048) * 1.01 + 1


def test_clashing_columns_and_odd_rows(spark, docs):
    """Columns that are named like those that operators make, null ids, repeated rows: no operator fails, none loses a row."""
    names = "score held_out sig doc rep n h1 h2 sk tokens pass block kh kd spans rules ids start cell quality toxic lang_pred".split()
    odd = docs.limit(30).withColumns({c: F.lit("x") for c in names})
    odd = odd.unionByName(odd.limit(3)).unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).cache()
    n = odd.count()
    model = langid.fit(odd, F.lit(True))
    assert langid.predict(odd, model).count() == n and secrets.digest(odd).count() == n and secrets.redact(odd).columns == odd.columns
    assert mixing.mix(odd, repeats=1.0).count() == n and quality.score(odd, quality.Rules(0.0, []), "doc_id", "quality").count() == n
    assert toxicity.score(odd.withColumn("held_out", F.lit(True)), toxicity.Grammar()).count() == n
    manifest, root = token_files.encode_to_files(odd, vocabulary("word_bpe_49k.json"))
    assert token_files.read_documents(spark, manifest, root).count() == n and packing.pack(odd, vocabulary("byte_bpe_50k.json")).filter("piece = 0").count() == n
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
