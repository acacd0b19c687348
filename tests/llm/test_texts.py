"""Mixing, languages, archives, token counts, quality and contamination."""

import base64
import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from funnelforge.llm import decontamination, language_id, mixing, quality, queries, token_counts, warc
from funnelforge.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, size string"


def frame(spark, rows):
    """rows: (doc_id, text, lang, source); the last column's name clashes with an output's."""
    return spark.createDataFrame([(*r, "clash") for r in rows], DOCS)


def read(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pandas()


# mixing ------------------------------------------------------------------------------


def shares(sizes, cap=3.0):
    """Targets by water filling, one source at a time."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1.0 + k % 3 for k, s in enumerate(order)}
    left, total, out = set(order), float(sum(sizes.values())), {}
    while left:
        level = total / sum(weight[s] for s in left)
        full = [s for s in left if weight[s] * level >= cap * sizes[s]]
        if not full:
            return out | {s: weight[s] * level for s in left}
        for s in full:
            out[s] = cap * sizes[s]
            total -= out[s]
            left.remove(s)
    return out


def check_mix(rows, docs, near=0.05):
    sizes, taken = {}, {}
    for i, t, _, s in docs:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = shares(sizes)
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    smallest = {s: min((r["size"] for r in rows if r["source"] == s and r["size"]), default=0) for s in sizes}
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(near * want[s], smallest[s]), s


def test_mix_meets_targets_and_reruns_agree(spark, sf_dir):
    d = read(sf_dir, "documents")
    docs = list(zip(d.doc_id.tolist(), d.text, d.lang, d.source, strict=True))
    first = mixing.mix_sources(frame(spark, docs)).collect()
    again = mixing.mix_sources(frame(spark, docs).repartition(5)).collect()
    assert len(first) == len(docs) and sorted(first) == sorted(again)
    check_mix(first, docs)


def test_mix_hot_small_and_null_sources(spark):
    rng = random.Random(1)
    docs = [(i, "w " * rng.randint(1, 50), "en", "hot") for i in range(2000)]
    docs += [(5000 + i, "w " * 3, "en", f"s{i % 4}") for i in range(200)]
    docs += [(6000 + i, "w w", "en", None) for i in range(20)] + [(7000, None, None, "hot"), (7001, " \n", "en", "void"), (7002, "w " * 30_000, "en", "one"), (1, "a b", "en", "hot"), (1, "a b", "en", "hot")]
    rows = mixing.mix_sources(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    check_mix(rows, docs)
    assert {r["taken"] for r in rows if r["doc_id"] in (7000, 7001)} == {0}
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    """Header names in lower case, ids of UUIDs, records of other types, and version 1.1."""

    def record(version, kind, block, **more):
        names = {"warc-type": kind, "warc-record-id": "<urn:uuid:1-2-" + kind + ">", "content-length": str(len(block)), **{k.replace("_", "-"): v for k, v in more.items()}}
        return b"WARC/" + version.encode() + b"\r\n" + "".join(f"{k}:{' ' * (k > 'd')}{v}\r\n" for k, v in names.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    for version in ("1.0", "1.1"):
        http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello WARC/" + version.encode() + b"\r\nwarc-type: none\r\n\r\nbye"
        body = [
            record(version, "warcinfo", b"software: x\r\n", content_type="application/warc-fields"),
            record(version, "request", b"GET / HTTP/1.1\r\n\r\n", content_type="application/http; msgtype=request"),
            record(version, "response", http, content_type="application/http;msgtype=response", warc_target_uri="http://a.example/", warc_payload_digest="sha1:ABC234", warc_refers_to="<urn:uuid:7>"),
            record(version, "metadata", b"", content_type="text/plain"),
        ]
        folder = tmp_path / version
        folder.mkdir()
        (folder / "x.warc").write_bytes(b"".join(body))
        found = {r["type"]: r for r in warc.read_warc(spark, f"file://{folder}", version=version).collect()}
        assert set(found) == {"warcinfo", "request", "response", "metadata"}
        r = found["response"]
        assert (r["record_id"], r["url"], r["digest"], r["refers_to"], r["payload_size"]) == ("urn:uuid:1-2-response", "http://a.example/", "ABC234", "urn:uuid:7", None)
        assert r["payload"] == http.decode().split("\r\n\r\n", 1)[1] and found["warcinfo"]["payload"] == "software: x\r\n" and found["metadata"]["payload"] == ""


# languages ---------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, sf_dir):
    got = {r["doc_id"]: r for r in language_id.language(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    d = read(sf_dir, "documents")
    assert all(got[i]["held_out"] == (crc32(str(i).encode()) % 4 == 2) for i in d.doc_id)
    held = d[[got[i]["held_out"] for i in d.doc_id]]
    assert sum(got[i]["lang_pred"] == x for i, x in zip(held.doc_id, held.lang, strict=True)) >= 0.95 * len(held)


def test_language_edges_and_spans(spark, sf_dir):
    d = read(sf_dir, "documents")
    known = [(int(i), t, x, "s") for i, t, x in zip(d.doc_id, d.text, d.lang, strict=True)]
    ru = "это русский текст который написан для проверки письменности"
    known += [(10_000 + i, ru, "ru", "s") for i in range(40)]
    en = next(t for t, x in zip(d.text, d.lang, strict=True) if x == "en" and len(t) > 400)[:300]
    odd = [(20_000, None, "en", "s"), (20_001, "", None, "s"), (20_002, "123 !!", "en", "s"), (20_003, "проверка письменности", None, "s"), (None, "слово", None, None), (20_004, f"{en} {ru}", None, "s"), (20_005, "x" * 1_000_000, None, "s")]
    df = frame(spark, known + odd)
    got = {r["doc_id"]: r for r in language_id.language(df).collect()}
    assert [got[i]["lang_pred"] for i in (20_000, 20_001, 20_002)] == ["und"] * 3 and got[20_000]["score"] == 0
    assert got[20_003]["lang_pred"] == "ru" and got[None]["lang_pred"] == "ru" and 0 < got[20_005]["score"] <= 1
    model = language_id.fit(df.where("text is not null and lang is not null").select("text", "lang"))
    cut = language_id.spans(df.where("doc_id = 20004"), model).orderBy("first_word").collect()
    assert [r["lang"] for r in cut] == ["en", "ru"]
    assert got[20_004]["lang_pred"] in ("en", "ru") and got[20_004]["score"] < 1
    none = language_id.language(frame(spark, [(1, "a word", None, "s")])).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
    assert language_id.language(frame(spark, [])).count() == 0


def test_language_counts_letters_and_no_bytes(spark, sf_dir):
    """384 English letters and 284 Russian ones, which take more bytes; signs weigh nothing."""
    d = read(sf_dir, "documents")
    ru = "этот текст написан для проверки письменности и букв"
    known = [(int(i), t, x, "s") for i, t, x in zip(d.doc_id, d.text, d.lang, strict=True)] + [(10_000 + i, ru, "ru", "s") for i in range(40)]
    words = [w for t, x in zip(d.text, d.lang, strict=True) if x == "en" and t for w in t.split() if w.isascii() and w.isalpha()]
    english, n = [], 0
    for w in words:
        if n + len(w) <= 384:
            english.append(w)
            n += len(w)
    russian = (ru + " ") * 7
    russian = russian[: next(k for k in range(len(russian)) if sum(map(str.isalpha, russian[:k])) == 284)]
    mixed = " ".join(english) + " \u2014 \u201e\u00bb " + russian
    model = language_id.fit(spark.createDataFrame([(t, x) for _, t, x, _ in known if t and x], "text string, lang string"))
    (r,) = language_id.identify(spark.createDataFrame([(1, mixed)], "id long, text string"), model).collect()
    assert n == 384 and r["lang_pred"] == "en" and abs(r["lang_score"] - 384 / 668) < 0.02
    texts = ["\u5b57\u6bcd\uff0c\u6587\u3002", "na\u00efve \u00ab\u20ac\u00bb", "\u0431\u0443\u043a\u0432\u044b!", "\u00aa", "\uff21\uff22 \U0001f600"]
    assert [int(x) for t in texts for x in [language_id._letter_counts(language_id.Words(language_id._prepared([t]), language_id._letters)).sum()]] == [3, 5, 5, 0, 2]
    (r,) = language_id.identify(spark.createDataFrame([(1, "\u00aa")], "id long, text string"), model).collect()
    assert r["lang_pred"] != "und"


def test_language_paths_equal_a_plain_viterbi(spark, sf_dir):
    """Word by word over the same scores, one text at a time."""
    d = read(sf_dir, "documents")
    model = language_id.fit(spark.createDataFrame(d[["text", "lang"]].dropna()))
    texts = [t for t in d.text if t][:40] + ["a", "één двa 日本 ok", " ".join(str(t)[:60] for t in d.text[:30])]
    for text, (path, sizes) in zip(texts, model.label(texts), strict=True):
        words = language_id.Words(language_id._prepared([text]), language_id._letters)
        scores = model._scores(words).astype(float)
        best, came = scores[0].copy(), []
        for row in scores[1:]:
            top = max(range(len(best)), key=lambda k: (best[k], -k))
            came.append([k if best[k] >= best[top] - model.switch else top for k in range(len(best))])
            best = [max(best[k], best[top] - model.switch) + row[k] for k in range(len(best))]
        at = max(range(len(best)), key=lambda k: (best[k], -k))
        want = [at]
        for step in reversed(came):
            at = step[at]
            want.append(at)
        assert path.tolist() == want[::-1] and sizes.tolist() == [sum(map(str.isalpha, words.joined[a:b].decode())) for a, b in zip(words.start, words.end, strict=True)]


def test_language_in_the_place_of_clashing_names(spark):
    df = frame(spark, [(1, "ein Wort", "de", "s"), (2, None, "de", "s")]).withColumn("lang_pred", F.lit("x")).withColumn("row", F.lit(1)).withColumn("found", F.lit(2))
    out = language_id.identify(df, language_id.fit(df.where("text is not null").select("text", "lang")))
    assert out.columns == ["doc_id", "text", "lang", "source", "size", "row", "found", "lang_pred", "lang_score"]
    assert {r["doc_id"]: r["lang_pred"] for r in out.collect()} == {1: "de", 2: "und"}


# archives ----------------------------------------------------------------------------


def test_warc_round_trip_with_magic_in_payloads(spark):
    trap = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n\r\n"
    pages = [(1, "http://a", trap), (2, None, None), (3, "http://b\r\nX: y", trap * 3), (4, "c", trap), (5, "d", ""), (6, "e", "é" * 1000 + "\r\n\r\n"), (7, "f", "y" * 300_000), (None, "g", "n"), (4, "c", trap)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    out = warc.round_trip(df).collect()
    assert len(out) == len(pages)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    by = {r["page_id"]: r for r in out}
    for i, _, html in pages:
        assert by[i]["payload_digest"] == sha(html) and by[i]["payload_bytes"] == len((html or "").encode())
    assert (by[4]["record_type"], by[4]["refers_to"]) == ("revisit", 1) and (by[5]["record_type"], by[5]["refers_to"]) == ("revisit", 2)
    assert by[1]["record_type"] == by[3]["record_type"] == by[None]["record_type"] == "response"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_ids_of_any_text_come_back(spark):
    ids = ["a>b", "x\r\nWARC-Type: response", "é ?&=%41", "a b", "+", "c"]
    df = spark.createDataFrame([(i, "u", "same", 5, "y") for i in ids], "page_id string, url string, html string, at int, body string")
    out = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    first = min(ids)
    assert set(out) == set(ids) and all(r["refers_to"] == (None if i == first else first) for i, r in out.items())


def test_warc_moves_only_payloads_that_may_repeat(spark):
    """Unique payloads go from the scan to the archive; of repeated ones, one a task is moved."""
    rows = spark.range(3000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, 'hot payload', concat('p', id)) as html")
    out = warc.round_trip(rows)
    kinds = {(r["record_type"], r["refers_to"]): r["n"] for r in out.groupBy("record_type", "refers_to").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("response", None): 2001, ("revisit", 0): 999}


def test_warc_payloads_in_small_splits_and_broken_chains(spark):
    pages = spark.range(200).selectExpr("id as page_id", "concat('u', id) as url", "repeat(concat('WARC/1.0\r\n', id), 40) as html")
    path = scratch_path(spark, "warc-test")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    warc.write_warc(pages, path)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
        read_back = {int(r["record_id"]): r["payload"] for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert read_back == {k: f"WARC/1.0\r\n{k}" * 40 for k in range(200)}
    broken = scratch_path(spark, "warc-broken")
    spark.createDataFrame([("WARC/1.0\r\nContent-Length: 5\r\n\r\nab",)], "value string").write.text(broken)
    with pytest.raises(ValueError, match="end at"):
        warc.read_warc(spark, broken)


# tokens ------------------------------------------------------------------------------


def test_tokens_equal_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    texts = read(sf_dir, "documents").text.tolist()
    odd = ["", None, "Hello WORLD's don't I'LL 123 4%5", "<|endoftext|> x <|startoftext|>", "<|END", "é É ß İ ǅ", "ΑΣ σς Σ", "日本語 テスト", "á è", "\x00\x1c\x85\xa0 x", "🙂🙃 'S 'ſ", "x" * 3000, "!!!???...###", "naïve—“quotes”", "ŉ ſ K Å", "'", "''s", "_a_b", "½ ² Ⅷ ٣"]
    rng = random.Random(4)
    odd += ["".join(chr(rng.choice((rng.randrange(0x80), rng.randrange(0x250), rng.randrange(0x3000)))) for _ in range(60)) for _ in range(200)]
    texts += odd
    out = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), queries.vocabulary_path()).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048), (i, t)
    assert token_counts.token_counts(frame(spark, []), queries.vocabulary_path()).count() == 0


# quality -----------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    known = read(sf, "labels")
    held = known[[got[i]["held_out"] for i in known.doc_id]]
    assert all(got[i]["held_out"] == (crc32(str(i).encode()) % 3 == 1) for i in known.doc_id)
    right = sum(got[i]["predicted"] == q for i, q in zip(held.doc_id, held.quality, strict=True))
    assert right >= 0.95 * len(held)


def test_quality_edges(spark):
    rng = random.Random(5)
    docs = [(i, " ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(30)) if i % 2 else "BAD!! " * 20, None, None) for i in range(200)]
    docs += [(900, None, None, None), (901, "", None, None), (None, "x", None, None), (902, "y" * 500_000, None, None), (1, "again", None, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(3, None), (None, 1), (5, 7), (1, 1)], "doc_id long, quality int")
    out = quality.quality(frame(spark, docs), labels).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in out if r["doc_id"] is not None and 150 <= r["doc_id"] < 200)
    even = quality.quality(frame(spark, docs), labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in even] == [0.5]
    assert quality.quality(frame(spark, []), labels).count() == 0


def test_quality_learns_from_0_and_1_alone(spark):
    rng = random.Random(6)
    docs = [(i, " ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(30)) if i % 2 else "BAD!! " * 20, None, None) for i in range(160)]
    good = [(i, float(i % 2)) for i in range(120)]
    whole = quality.quality(frame(spark, docs), spark.createDataFrame(good, "doc_id long, quality double")).collect()
    odd = [(i, x) for i in range(120, 150) for x in (0.5, 1.9, -1.0, float("nan"))]
    mixed = quality.quality(frame(spark, docs), spark.createDataFrame(good + odd, "doc_id long, quality double")).collect()
    named = [(i, str(int(x))) for i, x in good] + [(i, "good") for i in range(120, 150)] + [(121, ""), (122, None), (123, "0.5")]
    text = quality.quality(frame(spark, docs), spark.createDataFrame(named, "doc_id long, quality string")).collect()
    assert sorted(whole) == sorted(mixed) == sorted(text)


def test_quality_scores_equal_a_plain_discriminant(spark):
    """Density by density with numpy's own inverse and determinant."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality.NAMES))) * np.arange(1, len(quality.NAMES) + 1)
    y = (x[:, 0] + x[:, 3] > 0).astype(int)
    model = quality.fit(spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, y, strict=True)], "stats array<double>, label int"))
    d, logs, shrink, ridge = x.shape[1], [], 0.1, 0.1
    own = [x[y == c] for c in (0, 1)]
    pooled = sum(((o - o.mean(0)).T @ (o - o.mean(0))) for o in own) / (len(x) - 2)
    scale = np.sqrt(np.diag(pooled))
    pooled = pooled / np.outer(scale, scale)
    for o in own:
        cov = np.cov(o.T) / np.outer(scale, scale)
        lean = min(1.0, shrink + d / (d + len(o)))
        mixed = (1 - lean) * cov + lean * pooled
        mixed = (1 - ridge) * mixed + ridge * np.diag(np.diag(mixed)) + 1e-3 * np.eye(d)
        away = (x - o.mean(0)) / scale
        logs.append(-0.5 * (np.einsum("ni,ij,nj->n", away, np.linalg.inv(mixed), away) + np.log(np.linalg.det(mixed))))
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + np.log((len(own[1]) + 1) / (len(own[0]) + 1)), -30, 30)))
    assert np.abs(model.scores(x) - want).max() < 1e-9


# contamination -----------------------------------------------------------------------


def brute_hits(text, items, size=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit, found = split(text), set(), set()
    for i, t in items:
        own = split(t)
        n = min(size, len(own))
        grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [1, 100_000])
def test_contamination_against_brute_force(spark, block, monkeypatch):
    long = " ".join(f"w{k}" for k in range(40))
    items = [(1, long), (2, "Short Item, here"), (10, "short item here"), (3, None), (4, "!!"), (5, "é É x")] + ([(6, " ".join(f"v{k}" for k in range(14)))] if block > 1 else [])
    docs = ["", None, "...", long, "a b " + long[:200] + " c", "SHORT-item;here again " + "pad " * 100, "short item", "x é É X y", "é é x", " ".join(f"w{k}" for k in range(12)), long + " short item here " + long, "pad " * 50_000 + long]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, gram string")
    df = frame(spark, [(i, t, None, None) for i, t in enumerate(docs)] + [(0, "short item here", None, None)])
    if block == 1:
        whole = decontamination.find_contamination
        monkeypatch.setattr(decontamination, "find_contamination", lambda *a, **k: whole(*a, **k | {"block": 12}))
    out = decontamination.contamination(df, bench).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out)
    assert got == sorted((r["doc_id"], *brute_hits(r["text"], items)) for r in df.collect())


def test_contamination_in_many_blocks_is_one_scan_each(spark):
    """Windows of different blocks overlap in one passage; no plan holds more than one scan."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(30))) for k in range(20)]
    docs = [(k, f"before {t} after", None, None) for k, t in items] + [(100, "nothing here", None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    _, found = decontamination.find_contamination(frame(spark, docs), bench, block=24)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r["items"]): (r["n_words"], r["n_hit"], [(s["start"], s["end"]) for s in r["spans"]]) for r in found.collect()}
    assert len(got) == 20 and all(n == 32 and hit == 30 for n, hit, _ in got.values())
    left = decontamination.decontaminated(frame(spark, docs), bench, "spans").collect()
    assert sorted({r["text"] for r in left}) == ["before  after", "nothing here"]


def test_contamination_removal(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    df = frame(spark, [(1, "say One, two three!", "en", "s"), (2, "clean", "en", "s"), (3, None, None, None)]).withColumn("_hits", F.lit(1)).withColumn("_n_words", F.lit(2))
    kept = decontamination.decontaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminated(df, bench, "spans").collect()}
    assert cut == {1: "say !", 2: "clean", 3: None}
    assert decontamination.contamination(df.limit(0), bench).count() == 0
    assert decontamination.contamination(df, bench.limit(0)).where("contaminated").count() == 0
