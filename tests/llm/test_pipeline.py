"""The pipeline's stages on planted documents, and its run over the smallest tables."""

import random
import threading

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from funnelforge.llm import near_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def english(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'")
    return [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], COLUMNS)


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_language_stage_keeps_clean_documents(spark, sf_dir, english):
    docs = frame(spark, [*enumerate(english), (900, None), (901, ""), (902, "12 34 !!")])
    out = P.identify_language(spark, docs, sf_dir)
    assert out.columns == docs.columns and ids(out) == list(range(len(english)))


def test_line_stage_deletes_later_copies_only(spark, sf_dir):
    rows = [(1, "one\ntwo\nthree"), (2, "zero\none\ntwo\nlast"), (3, "one\ntwo\nthree"), (4, "clean"), (5, None)]
    out = {r["doc_id"]: r for r in P.drop_repeated_lines(spark, frame(spark, rows), sf_dir).collect()}
    assert {i: r["text"] for i, r in out.items()} == {1: rows[0][1], 2: "zero\nlast", 4: "clean", 5: None}
    assert out[2]["n_chars"] == 9


def test_line_stage_deletes_long_lines_that_repeat_alone(spark, sf_dir):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (2, long), (3, f"before\n{long}\nafter")]
    out = {r["doc_id"]: r["text"] for r in P.drop_repeated_lines(spark, frame(spark, rows), sf_dir).collect()}
    assert out == {1: long, 3: "before\nafter"}


def test_near_stage_keeps_one_of_each_group(spark, sf_dir):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(5, " ".join(words)), (6, " ".join([*words[:199], "other"])), (7, " ".join(words)), (8, "something else here"), (9, ""), (10, None)]
    out = P.drop_near_duplicates(spark, frame(spark, rows), sf_dir)
    assert ids(out) == [5, 8, 9, 10]


def test_near_stage_drops_pairs_from_80_percent(spark, sf_dir):
    """Pairs of 200 words of which the second lacks so many at its end, 80 to 85 % alike;
    the last one is below."""
    rng = random.Random(2)
    rows, cuts = [], [*range(30, 40)] * 4 + [42]
    for k, cut in enumerate(cuts):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 200 - cut]))]
    assert all(0.8 <= (196 - cut) / 196 < 0.85 for cut in cuts[:-1]) and (196 - cuts[-1]) / 196 < 0.8
    assert ids(P.drop_near_duplicates(spark, frame(spark, rows), sf_dir)) == [*range(0, 2 * len(cuts), 2), 2 * len(cuts) - 1]


def test_contamination_stage_drops_passages(spark, sf_dir, english):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rows = [(1, item), (2, "before " + item + " after"), (3, "nothing of the kind"), (4, None)]
    assert ids(P.drop_contaminated(spark, frame(spark, rows), sf_dir)) == [3, 4]


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_take_empty_tables_nulls_repeats_and_clashing_names(spark, sf_dir, name, stage, english):
    """Repeated rows, nulls in any column, and extra columns named as those used inside."""
    names = "_kept, _hits, _n_words, runs, kept, row, id, h, key, met, found, lang_pred, digest, rep, size, bucket".split(", ")
    rows = [(1, english[0]), (1, english[0]), (1, english[1]), (None, english[2]), (2, None), (3, ""), (4, english[3] + "\n" + "word " * 50_000)]
    docs = frame(spark, rows).union(spark.createDataFrame([(None, None, None, None, None)], COLUMNS))
    wide = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    for df in (docs, wide):
        out = stage(spark, df, sf_dir)
        n = out.count()
        if name == "mixing":
            assert n == 8
        else:
            assert out.columns == df.columns and n <= 8 and {r["text"] for r in out.where("doc_id = 1").collect()} == {english[0], english[1]}
        empty = stage(spark, df.limit(0), sf_dir)
        assert empty.count() == 0 and (name == "mixing" or empty.columns == df.columns)


def test_run_applies_all_stages(spark, sf_dir):
    """Each stage on what the one before kept, by hand; ``run`` gives the same rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, columns = docs, docs.columns
    for _, stage in P.STAGES[:-1]:
        before = set(ids(kept))
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).collect(), docs.schema)
        assert kept.columns == columns and set(ids(kept)) <= before
    out = P.run(spark, sf_dir)
    assert ids(out) == ids(kept)
    mixed = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("top"))
    assert all(abs(r["taken"] - r["target"]) <= max(0.1 * r["target"], 60) for r in mixed.collect())
    assert out.where("taken > 3 * size").isEmpty()


def test_two_jobs_at_once_share_a_session(spark):
    """The pipeline's scopes delete no table of a query that runs beside it."""
    sf, key = "/root/testdata/sf0.001", "spark.sql.execution.arrow.maxBytesPerBatch"
    before, out = spark.conf.get(key), {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    alone = sorted(map(str, near_dedup.near_duplicates(docs).collect()))

    def beside():
        out["rows"] = sorted(map(str, near_dedup.near_duplicates(docs).collect()))

    worker = threading.Thread(target=beside)
    worker.start()
    n = P.run(spark, sf).count()
    worker.join()
    assert out["rows"] == alone and n > 0 and spark.conf.get(key) == before
