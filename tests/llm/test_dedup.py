"""Exact, line, substring and near duplicates against brute force."""

import hashlib
import random
import re
import tracemalloc

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from funnelforge.llm import exact_dedup, line_dedup, near_dedup, sieve, substring_dedup
from funnelforge.llm.graph import components

DOCS = "doc_id long, text string, extra string"


@pytest.fixture(scope="module")
def documents(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)


# exact -------------------------------------------------------------------------------


def test_exact_edges(spark):
    long = "word " * 200_000
    rows = [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, "a b "), (6, long), (7, long + " "), (8, long[:-1] + "x"), (5, "a b "), (None, "a b")]
    out = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()}
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    assert len(out) == 9
    assert out[1, sha("a b")]["group_size"] == 3 and out[2, sha("a b")]["keep_id"] == 1 and not out[2, sha("a b")]["kept"]
    assert out[None, sha("a b")]["keep_id"] == 1 and not out[None, sha("a b")]["kept"]
    assert out[3, sha("")]["kept"] and out[4, sha("")]["keep_id"] == 3
    assert out[5, sha("a b ")]["group_size"] == 2 and out[5, sha("a b ")]["kept"]
    assert out[6, sha(long)]["group_size"] == 2 and not out[7, sha(long)]["kept"] and out[8, sha(long[:-1] + "x")]["group_size"] == 1


def test_exact_empty_table_and_clashing_names(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "a", 5, "z"), (2, "a", 6, "y")], "doc_id long, text string, bytes int, id string")
    assert [r["doc_id"] for r in exact_dedup.drop_exact_duplicates(df).collect()] == [1]


def test_exact_is_native(spark):
    plan = exact_dedup.exact_duplicates(frame(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# lines -------------------------------------------------------------------------------


def brute_lines(docs, least):
    """The rows of each text that are left: the first copy of each window of lines stays."""
    lines = {i: [(k, x) for k, x in enumerate(t.split("\n")) if x.strip(" ")] for i, t in sorted(docs.items()) if t is not None}
    seen, gone = set(), {i: set() for i in docs}
    for i, own in lines.items():
        for k in range(len(own) - least + 1):
            w = tuple(x for _, x in own[k : k + least])
            if w in seen:
                gone[i] |= set(range(k, k + least))
            seen.add(w)
    out = {}
    for i, t in docs.items():
        if t is None:
            out[i] = None
            continue
        own, cut = lines[i], set()
        for k in sorted(gone[i]):
            cut |= set(range(own[k][0], own[k + 1][0] + 1)) if k + 1 in gone[i] else {own[k][0]}
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
def test_lines_against_brute_force(spark, documents, least):
    rng = random.Random(least)
    docs = {i: t for i, t in documents.items() if i < 60}
    docs |= {1000 + i: "\n".join(rng.choice("aabbc d".split() + [""]) for _ in range(rng.randint(0, 12))) for i in range(40)} | {2000: None, 2001: ""}
    found = line_dedup.dedup_lines(frame(spark, docs.items()), least=least)
    assert {r["row"]["doc_id"]: r["kept"] for r in found.collect()} == brute_lines(docs, least)


def test_lines_runs_and_edges(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\n\nc\ny"), (3, "a\nb\nc\nd"), (4, "q\nr"), (None, "a\nb"), (5, None)]
    out = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert out[1]["runs"] is None and out[4]["kept"] == "q\nr" and out[None]["kept"] == "a\nb" and out[5]["kept"] is None
    assert out[2]["kept"] == "x\ny" and [tuple(r) for r in out[2]["runs"]] == [(1, 4, 3, 1)]
    assert out[3]["kept"] == ""
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_lines_that_are_long_repeat_alone(spark):
    rng = random.Random(4)
    long, short, exact = words(rng, 51), words(rng, 50), words(rng, 168)
    dense = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(101))
    rows = [(1, f"a\n{long}\nb\n{short}"), (2, f"c\n{long}\n\n{long}\nd\n{short}\ne"), (3, exact), (4, exact), (5, dense), (6, f"f\n{dense}\ng")]
    out = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, rows), alone=line_dedup.LONG).collect()}
    assert [out[i]["kept"] for i in (1, 3, 5)] == [rows[0][1], exact, dense]
    assert out[2]["kept"] == f"c\nd\n{short}\ne" and [tuple(r) for r in out[2]["runs"]] == [(1, 3, 2, 1)]
    assert out[4]["kept"] == "" and out[6]["kept"] == "f\ng"


def test_lines_of_rows_that_repeat_an_id_are_their_own(spark):
    rows = [(1, "a\nb\nc"), (2, "z\na\nb\nc"), (2, "k\nl\nm\nn"), (2, "z\na\nb\nc"), (3, "a\nb\nc"), (3, "k\nl\nx")]
    out = sorted((r["row"]["doc_id"], r["row"]["text"], r["kept"]) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert out == sorted([(1, "a\nb\nc", "a\nb\nc"), (2, "z\na\nb\nc", "z"), (2, "z\na\nb\nc", "z"), (2, "k\nl\nm\nn", "k\nl\nm\nn"), (3, "a\nb\nc", ""), (3, "k\nl\nx", "x")])


def test_lines_clashing_names_and_long_texts(spark):
    long = "\n".join(f"line {k}" for k in range(30_000))
    rows = [(1, long, 1, 2, "a"), (2, f"first\n{long}\nlast", 3, 4, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h long, line long, row string").withColumn("id", F.lit("i")).withColumn("runs", F.lit(0))
    out = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert out[1]["kept"] == long and out[2]["kept"] == "first\nlast" and out[2]["row"]["h"] == 3 and out[2]["row"]["row"] == "b"


def test_lines_are_native(spark):
    found = line_dedup.dedup_lines(frame(spark, [(1, "a\nb"), (2, "a\nb")]))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_line_ranks_are_places_in_the_order_of_suffixes(spark):
    """Suffixes of equal rank share as many lines as the depth; ranks grow with the lines' ranks."""
    docs = {1: "a b c a b d".split(), 2: "a b c".split(), 3: "c a b".split()}
    df = spark.createDataFrame([(i, 0, "\n".join(x)) for i, x in docs.items()], "id long, h long, text string")
    one = line_dedup._intervals(line_dedup.line_ids(df).select("id", "h", "line", "name"), "name")
    rank = {(r["id"], r["line"]): r["rank"] for r in one.collect()}
    two = line_dedup._intervals(line_dedup._doubled(one, 1), "rank", "after")
    pairs = {}
    for r in two.collect():
        pairs.setdefault(r["rank"], set()).add(tuple(docs[r["id"]][r["line"] : r["line"] + 2]))
        assert r["first"]["id"] <= r["id"]
    assert all(len(x) == 1 for x in pairs.values()) and {next(iter(x)) for x in pairs.values()} == {("a", "b"), ("b", "c"), ("c", "a")}
    keys = {docs[i][n]: k for (i, n), k in rank.items()}
    in_order = [tuple(keys[x] for x in next(iter(pairs[k]))) for k in sorted(pairs)]
    assert in_order == sorted(in_order)


# substrings --------------------------------------------------------------------------


def test_substring_spans_of_documents_are_held_by_earlier_ones(spark, documents):
    """Over real texts: each span's bytes stand in keep_id's text, or before in its own."""
    texts = {i: t.encode() for i, t in documents.items() if t is not None}
    found = substring_dedup.repeated_spans(frame(spark, documents.items())).collect()
    assert found
    for r in found:
        span = texts[r["doc_id"]][r["start"] : r["end"]]
        assert r["keep_id"] <= r["doc_id"] and r["bytes"] == len(span) >= 80
        assert texts[r["keep_id"]].find(span) < (r["start"] if r["keep_id"] == r["doc_id"] else 1 << 40) and span in texts[r["keep_id"]]


def test_substring_of_rows_that_repeat_an_id(spark):
    rng = random.Random(9)
    a, b, c = words(rng, 80), words(rng, 80), words(rng, 80)
    rows = [(1, a), (2, a), (2, b), (2, b), (3, f"{c} {b}")]
    df = frame(spark, rows).withColumn("h", F.lit("clash")).withColumn("end", F.lit(0)).withColumn("id", F.lit("x"))
    found = substring_dedup.repeated_spans(df)
    assert {(r["doc_id"], r["keep_id"]) for r in found.collect()} == {(2, 1), (3, 2)}
    out = substring_dedup.without_spans(df, found)
    left = sorted((r["doc_id"], r["text"]) for r in out.collect())
    assert out.columns == df.columns and len(left) == 5
    assert [t for i, t in left if i == 1] == [a] and [t for i, t in left if i == 2].count(b) == 2
    assert len(min(t for i, t in left if i == 2)) < 80 and left[-1][1].startswith(c) and len(left[-1][1]) < len(c) + 150


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_substring_finds_planted_passages_and_nothing_else(spark):
    rng = random.Random(1)
    passages = [words(rng, 55) for _ in range(100)]
    rows = [(i, words(rng, 200)) for i in range(400)]
    for k, p in enumerate(passages):
        for i in (k, 100 + k):
            t = rows[i][1]
            cut = rng.randint(0, len(t))
            rows[i] = (i, f"{t[:cut]} {p} {t[cut:]}")
    found = substring_dedup.repeated_spans(frame(spark, rows)).collect()
    caught = {(r["keep_id"], r["doc_id"]) for r in found}
    assert caught <= {(k, 100 + k) for k in range(100)}
    assert len(caught) >= 97
    texts = dict(rows)
    for r in found:
        assert texts[r["doc_id"]].encode()[r["start"] : r["end"]] in texts[r["keep_id"]].encode()


def test_substring_resists_shifts_and_handles_edges(spark):
    rng = random.Random(2)
    base = words(rng, 300) + " é中文" * 20
    rows = [(1, base), (2, "zz " + base), (3, None), (4, ""), (5, "a"), (None, base), (6, "x" * 500_000)]
    found = substring_dedup.repeated_spans(frame(spark, rows))
    got = {r["doc_id"]: r for r in found.collect()}
    assert set(got) == {2} and got[2]["bytes"] > 0.85 * len(base.encode())
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_spans(frame(spark, rows), found).collect()}
    assert left[1] == base and left[3] is None and len(left[2]) < len(base) // 2
    assert substring_dedup.repeated_spans(frame(spark, [])).count() == 0


@pytest.mark.parametrize("script", ["cyrillic", "cjk"])
def test_substring_finds_passages_of_other_scripts(spark, script):
    """Passages of 51 Cyrillic words, and of 150 Chinese characters, in lines that differ else."""
    rng = random.Random(5)
    if script == "cyrillic":
        turn = str.maketrans("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ")
        make = lambda n: words(rng, n).translate(turn)
    else:
        make = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n * 150 // 51))
    rows = {i: (make(60), make(60)) for i in range(200)}
    passages = [make(51) for _ in range(100)]
    docs = [(i, f"{a}{passages[i % 100]}{b}") for i, (a, b) in rows.items()]
    found = substring_dedup.repeated_spans(frame(spark, docs)).collect()
    texts = dict(docs)
    assert all(texts[r["doc_id"]].encode()[r["start"] : r["end"]] in texts[r["keep_id"]].encode() for r in found)
    caught = {(r["keep_id"], r["doc_id"]) for r in found}
    assert caught <= {(k, 100 + k) for k in range(100)} and len(caught) >= 97


def test_substring_spans_are_held_by_one_document(spark):
    """Three lines of 40 bytes, each in another document, make no span of 80 bytes together."""
    rng = random.Random(6)
    a, b, c = ("".join(rng.choice("abcdefghij") for _ in range(39)) + "\n" for _ in range(3))
    rows = [(k, f"{words(rng, 40)}\n{x}{words(rng, 40)}") for k, x in enumerate((a, b, c))]
    rows += [(5, f"{words(rng, 40)}\n{a}{b}{c}{words(rng, 40)}"), (6, f"{words(rng, 40)}\n{a}{b}{c}{words(rng, 40)}")]
    found = substring_dedup.repeated_spans(frame(spark, rows)).collect()
    assert [(r["doc_id"], r["bytes"], r["keep_id"]) for r in found] == [(6, 120, 5)]


@pytest.mark.parametrize(("low", "high", "n", "share"), [(6, 6, 51, 0.98), (2, 5, 51, 0.95), (2, 2, 60, 0.85), (1, 9, 51, 0.97)])
def test_substring_finds_passages_by_words(spark, low, high, n, share):
    """Planted passages of words of some length; sentences of forty words are no passages."""
    rng = random.Random(low * 100 + n)
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    fill = lambda k: " ".join(word(2, 9) for _ in range(k))
    rows, passages, shorter = [], {}, {}
    for k in range(120):
        p, q = " ".join(word(low, high) for _ in range(n)), " ".join(word(low, high) for _ in range(40))
        rows += [(4 * k, f"{fill(40)} {p} {fill(30)}"), (4 * k + 1, f"{fill(25)} {p} {fill(50)}"), (4 * k + 2, f"{fill(30)} {q} {fill(9)}"), (4 * k + 3, f"{fill(30)} {q} {fill(20)}")]
        passages[4 * k + 1], shorter[4 * k + 3] = p, q
    found = substring_dedup.repeated_spans(frame(spark, rows), least=substring_dedup.FOUND_BY, words=substring_dedup.PASSAGE).collect()
    ids = {r["doc_id"] for r in found}
    assert ids <= set(passages) and len(ids) >= share * len(passages)
    texts = dict(rows)
    for r in found:
        span = texts[r["doc_id"]][r["start"] : r["end"]]
        assert span in texts[r["keep_id"]] and r["keep_id"] == r["doc_id"] - 1
        assert len(span.strip()) <= len(passages[r["doc_id"]]) + 8


def test_substring_misses_few_passages_of_real_texts(spark, documents):
    """Documents with 51 words of an earlier one, and those without, by brute force."""
    docs = {i: t for i, t in documents.items() if t}
    found = substring_dedup.repeated_spans(frame(spark, docs.items()), least=substring_dedup.FOUND_BY, words=substring_dedup.PASSAGE).collect()
    seen, want = set(), set()
    for i in sorted(docs):
        words = docs[i].split()
        grams = {" ".join(words[k : k + 51]) for k in range(len(words) - 50)}
        if grams & seen:
            want.add(i)
        seen |= grams
    across = {r["doc_id"] for r in found if r["keep_id"] != r["doc_id"]}
    assert len(want) > 5 and len(across & want) >= 0.95 * len(want) and len(across - want) <= 0.02 * len(docs)


def test_few_spans_are_extended_at_once():
    side = lambda k: {"l": b"%04d " % k * 800, "m": b"two words", "r": b" %04d" % k * 800}
    sides = pa.array([side(k) for k in range(2000)])
    batch = pa.record_batch([pa.array(range(2000)), sides, sides], ["id", "own", "other"])
    tracemalloc.start()
    found = [r for b in substring_dedup._extending(iter([batch]), ["id"]) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [{"id": k, "before": 4000, "behind": 4000, "n": 1602} for k in range(2000)]
    assert peak < 6_000_000  # the texts are 32 MB


def test_substring_extension():
    make = lambda l, m, r: {"l": l.encode(), "m": m.encode(), "r": r.encode()}
    assert substring_dedup.extension(make("xx one ", "two", " three y"), make("one ", "two", " three z")) == (4, 7, 3)
    assert substring_dedup.extension(make("aone ", "two", " three"), make("bone ", "two", " three")) == (4, 6, 2)
    assert substring_dedup.extension(make("", "two", ""), make("q", "two", "r")) == (0, 0, 1)
    assert substring_dedup.extension(make("\u00e9 ", "two", " \u00e9"), make("\u00e8 ", "two", " \u00e8")) == (1, 1, 1)
    assert substring_dedup.extension(make("a", "two", "b"), make("a", "twO", "b")) == (0, 0, 0)


def test_substring_overlapping_spans_and_repeats_inside_a_document(spark):
    """A passage that begins in one earlier document and ends in another; one that repeats in its own."""
    rng = random.Random(7)
    lines = [words(rng, 10) + "\n" for _ in range(12)]
    tail = [words(rng, 30) + "\n" for _ in range(6)]
    own = words(rng, 60) + "\n"
    rows = [(1, tail[0] + "".join(lines[:8]) + tail[1]), (2, tail[2] + "".join(lines[4:]) + tail[3]), (3, tail[4] + "".join(lines) + tail[5])]
    rows += [(4, own + tail[0][:40] + "\n" + own)]
    found = substring_dedup.repeated_spans(frame(spark, rows))
    texts = {i: t.encode() for i, t in rows}
    got = found.collect()
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] in texts[r["keep_id"]] and r["bytes"] >= 80 for r in got)
    assert {(r["doc_id"], r["keep_id"]) for r in got} == {(2, 1), (3, 1), (3, 2), (4, 4)}
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_spans(frame(spark, rows), found).collect()}
    assert left[1] == rows[0][1] and left[3].startswith(tail[4]) and left[3].endswith(tail[5])
    assert len(left[3]) < len(tail[4] + tail[5]) + 100
    assert left[4].startswith(own + tail[0][:40]) and len(left[4]) < len(own) + 100


def test_chunks_end_with_characters():
    texts = [t * 40 for t in ("中文字符", "слово ", "é中 🙂", "ไทยคำ")]
    at, start, end, _ = substring_dedup.chunked([t.encode() for t in texts])
    for i, a, b in zip(at, start, end, strict=True):
        texts[i].encode()[a:b].decode()


def test_chunks_cover_texts():
    texts = ["", "a", "hello world " * 50, "é" * 1000, "x" * 100_000]
    at, start, end, _ = substring_dedup.chunked([t.encode() for t in texts])
    for k, t in enumerate(texts):
        own = [(int(a), int(b)) for i, a, b in zip(at, start, end, strict=True) if i == k]
        assert b"".join(t.encode()[a:b] for a, b in own) == t.encode()


# near --------------------------------------------------------------------------------


def brute_near(docs, percent=85):
    sets = {}
    for i, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in docs}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def near(spark, rows, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows), **kw).collect()}


def test_near_against_brute_force(spark, documents):
    assert near(spark, documents.items()) == brute_near(documents)


def test_near_matches_follow_the_limit():
    assert [near_dedup.matches(p) for p in (70, 80, 85, 100)] == [29, 37, 42, 64] and near_dedup.matches(1) == 1


@pytest.mark.parametrize("block", [4, 1024])
def test_near_chains_and_large_groups(spark, block):
    """A family that drifts word by word, so that most members are not alike the first one."""
    rng = random.Random(3)
    base = words(rng, 150).split()
    docs, now = {}, list(base)
    for i in range(60):
        docs[i] = " ".join(now)
        now[rng.randrange(len(now))] = words(rng, 1)
    docs |= {100 + i: docs[0] for i in range(30)} | {200: "", 201: None, 202: "a b c", 203: "A  b C", 204: "é É"}
    assert near(spark, docs.items(), block=block) == brute_near(docs)


def test_near_repeated_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words are here in this one"), (None, "a b c d e f g"), (2, "other words are here in this one")]
    out = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in out) == [("1", "1")] * 3 + [("2", "1"), ("None", "None")]
    assert near(spark, []) == {}


def test_near_lists_with_few_outsiders_stay_in_proportion(spark):
    """A list of 20,000 members of which three are outside its largest component."""
    n, name = 20_000, lambda k: k.to_bytes(16, "big")
    posted = spark.createDataFrame([(7, name(k)) for k in range(n)], "token long, rep binary")
    comps = spark.createDataFrame([(name(k), name(0)) for k in range(n - 3)], "node binary, comp binary")
    classes = spark.createDataFrame([(name(k), 100) for k in range(n)], "rep binary, n long")
    units = near_dedup._units(posted, comps, classes, 256)
    assert n <= units.count() <= n + 3 * (n // 512 + 2)
    met = units.where("outside").count()
    assert met == 3 * -(-n // 512) and units.groupBy("pack").count().agg(F.max("count")).first()[0] < 1000


def test_near_long_texts_and_clashing_names(spark):
    rng = random.Random(8)
    long = words(rng, 60_000)
    rows = [(1, long), (2, long + " more words at the very end"), (3, "x" * 1_000_000), (4, "short text")]
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, n int, digest string").withColumn("rep", F.lit(1))
    out = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    assert out == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True)}


def test_sieve_lacks_no_key_and_tells_repeated_ids_apart(spark):
    keys = spark.range(0, 200_000, 7).selectExpr("id", "concat('k', id) as k")
    rows = spark.range(0, 200_000).selectExpr("id as a", "concat('k', id) as b")
    met = sieve.sieved(rows, sieve.sieve(keys), F.col("a"), F.col("b"))
    assert met.columns == ["a", "b", "met"] and met.where("a % 7 = 0 and not met").isEmpty()
    assert met.where("a % 7 <> 0 and met").count() < 2000
    assert sieve.sieved(rows, sieve.sieve(keys.limit(0)), F.col("a"), F.col("b")).where("met").isEmpty()
    apart = sieve.told_apart(frame(spark, [(1, "a"), (2, "b"), (2, "c"), (2, "b"), (None, "d")]), "doc_id", "text")
    h = {(r["doc_id"], r["text"]): r["h"] for r in apart.collect()}
    assert h[1, "a"] == 0 and h[2, "b"] != h[2, "c"] and 0 not in (h[2, "b"], h[2, "c"])


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7), *((10, k) for k in range(11, 40)), *((k, k + 1) for k in range(50, 90))]
    found = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found[3] == 1 and found[5] == 4 and all(found[k] == 10 for k in range(11, 40)) and found[90] == 50
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
