import corpus_pipeline
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_their_contract(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{base} tail{i // 20}", "en", "a", 1) for i in range(40)] + [(100 + i, f"die schöne neue welt number{i} ist groß und weit {i}", "de", "b", 1) for i in range(20)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, "12345 !!", "en", "a", 8), (203, "password = abcdefgh in the plain english text here", "en", "b", 1), (203, "password = abcdefgh in the plain english text here", "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert ids("language_id") == {r[0] for r in rows} - {200, 201, 202}
    assert ids("near_duplicates") == {0, 203, *range(100, 120)}
    assert {r["text"] for r in seen["secret_scan"] if r["doc_id"] == 203} == {"[secret] in the plain english text here"}
    assert ids("source_mixing") == ids("secret_scan") and ids("best_fit_packing") == ids("source_mixing")


def test_one_document_of_each_group(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base), (1, base), (2, f"{base} tail"), (None, base), (None, f"{base} end"), (None, "a text of its own"), (None, "a text of its own"), (None, None), (None, None), (7, "seven words are here and no more"), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, base), (None, "a text of its own"), (None, None), (None, None), (7, "seven words are here and no more"), (9, "")]
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in got.collect()) == sorted((repr(i), repr(t)) for i, t in want)
    ided = corpus_pipeline.near_duplicates(spark, docs.filter("doc_id is not null"), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in ided) == [(1, base), (7, "seven words are here and no more"), (9, "")]


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_registers_everything():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert pytest.approx(len(corpus_pipeline.STAGES)) == 5


def test_batches_are_small():
    """Three tasks of an executor hold whole texts in the JVM and in Python at once: 2 MB each at most, beside 3,000 MB for all."""
    import corpus_pipeline

    assert int(corpus_pipeline.BATCHES["spark.sql.execution.arrow.maxRecordsPerBatch"]) <= 500
    assert corpus_pipeline.BATCHES["spark.sql.execution.arrow.maxBytesPerBatch"] == "2m"


def test_workers_keep_nothing_large(spark):
    """Python workers live on beside the next stage: they hold no encoder after packing, and the sample of a fit goes with it."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from tallyframe.llm import langid

    docs = spark.createDataFrame([(i, ("the cat sat on a mat" if i % 2 else "der hund lag auf dem dach") + f" {'abcdefgh'[i % 8]}", "en" if i % 2 else "de", "a", 1) for i in range(90)], DOCS).repartition(3)

    def held(batches):
        from tallyframe.llm import tokens

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(tokens._ENCODERS)], pa.int64())})

    assert len(corpus_pipeline.best_fit_packing(spark, docs, "").collect()) == 90
    assert spark.range(0, 300, 1, 3).mapInArrow(held, "n long").groupBy().sum("n").first()[0] == 0

    gone, made = [], spark.sparkContext.broadcast
    spark.sparkContext.broadcast = lambda value: gone.append(made(value)) or gone[-1]
    try:
        langid.fit(docs, F.lit(True))
    finally:
        del spark.sparkContext.broadcast
    assert len(gone) == 1 and not gone[0]._jbroadcast.isValid()


def test_driver_gets_small_samples_and_filters(spark):
    """What passes through the driver is as large as what it tells: no zeros of vectors, and no empty part of a filter. Nothing is lost by it."""
    import pickle

    import numpy as np
    from tallyframe.llm import jaccard, langid

    texts = ["the cat sat on a mat", "der hund lag auf dem dach", "x"]
    rows = np.array([langid.vector(t) for t in texts])
    packed = [langid.packed(x) for x in rows]
    assert np.array_equal(langid.unpacked(packed), rows) and max(map(len, packed)) < rows.nbytes / len(rows) / 10
    assert langid.unpacked([]).shape == (0, langid.DIMS)

    places = [0, 5, 63, 64, (1 << 19) - 1, 1 << 19, jaccard.FILTER_BITS - 1]
    bits = jaccard._bits(spark.createDataFrame([(p,) for p in places * 2], "h long").repartition(3))
    assert len(pickle.dumps(bits)) < 10_000
    words = jaccard._words(bits)
    assert len(words) == jaccard.FILTER_BITS // 64 and np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")).tolist() == places
    assert not jaccard._words({}).any()

    made, broadcast = [], spark.sparkContext.broadcast
    spark.sparkContext.broadcast = lambda value: made.append(len(pickle.dumps(value))) or broadcast(value)
    try:
        docs = spark.createDataFrame([(i, f"{texts[i % 2]} {'abcdefgh'[i % 8]}", "en" if i % 2 else "de", "a", 1) for i in range(90)], DOCS)
        langid.fit(docs, F.lit(True))
        assert len(made) == 1 and made[0] < 90 * langid.DIMS * 4 / 8
    finally:
        del spark.sparkContext.broadcast
