"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from funnelforge.llm import spelling

DOCS = "doc_id long, text string, word string, n int, root string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)


def brute_counts(rows):
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode()) & 0xFFFFFFFF
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts):
    forms, n_near = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if abs(len(x) - len(w)) < 2 and is_near(w, x)]
        n_near[w] = len(near)
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n, n_near[w], counts.get(forms[w])))
    return out


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_equal_brute_force_over_many_texts(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"], strict=True))[:110]
    found = rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute(brute_counts(rows))
    assert found == want and sum(r[1] is not None for r in want) > 20 and sum(r[4] > 3 for r in want) > 20


def test_word_counts_of_the_whole_table(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    found = {r["word"]: r["n"] for r in spelling.word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert found == brute_counts(zip(t["doc_id"], t["text"], strict=True))


def test_variants_edges(spark):
    long = "ab" * 3000
    rows = [
        (1, None), (2, ""), (3, "123 ..."), (None, "Straße straßE STRASSE strasse"), (5, "straße Strase strase strase étéété ÉTÉÉTÉ étéétés"),
        (5, "straße Strase strase strase étéété ÉTÉÉTÉ étéétés"), (6, "étéétés étéétés " * 4), (7, f"{long} {long}x {long} {long[1:]} " * 3), (8, "aaaaa aaaaaa aaaaaaa baaaa " * 5),
    ]
    found = rows_of(spelling.variants(frame(spark, rows)))
    assert found == brute(brute_counts(rows)) and any(len(r[0]) > 5000 for r in found)
    assert rows_of(spelling.variants(frame(spark, []))) == set() == rows_of(spelling.variants(frame(spark, [(1, "a bc"), (2, None)])))


def test_chains_of_forms_end_at_one_root(spark):
    words = ["houses", "housess", "housesss", "housessss", "hoouses"]
    text = " ".join(" ".join([w] * (160 >> (2 * k))) for k, w in enumerate(words[:4])) + " hoouses" * 3
    rows = [(k, text) for k in range(12)]
    found = rows_of(spelling.variants(frame(spark, rows)))
    assert found == brute(brute_counts(rows))
    assert {r[0]: r[2] for r in found}["housessss"] == "houses"


@pytest.mark.parametrize("limit", [2, 5, 1000])
def test_each_near_pair_is_in_one_group(spark, limit):
    rng = random.Random(limit)
    words = {"pre" + "".join(rng.choice("abé") for _ in range(rng.randrange(2, 8))) + rng.choice(["", "end"]) for _ in range(300)}
    words |= {"".join(rng.choice("xy") for _ in range(rng.randrange(5, 8))) for _ in range(80)}
    counts = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    found = [
        tuple(sorted((texts[a], texts[b])))
        for part in spelling.groups(counts, limit)
        for r in part.collect()
        for texts in [[w["word"] for w in r["words"]]]
        for a, b in spelling.near_in(texts, r["size"], r["lo"], r["hi"])
    ]
    want = {(a, b) for a in words for b in words if a < b and is_near(a, b)}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 500


def test_groups_stay_small_whatever_the_words_share(spark):
    words = spark.range(3000).select(F.concat(F.lit("prefixofall"), F.translate(F.conv("id", 10, 26), "0123456789", "qrstuvwxyz"), F.lit("suffixofall")).alias("word"), F.lit(3).cast("long").alias("n"))
    sizes = [r["k"] for part in spelling.groups(words) for r in part.select(F.size("words").alias("k")).collect()]
    assert 0 < max(sizes) <= 26 + 26 * 26  # one free letter in the shorter words, two in the longer
