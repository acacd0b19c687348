"""Personal data: known forms against plain regular expressions, contexts against a plain
bootstrap over dictionaries."""

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from funnelforge.llm import pii

DOCS = "doc_id long, text string, kind int, value string, spans int"
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "v", 2) for i, t in rows], DOCS)


def plain_base(text):
    def holds(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            double = [int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))]
            return 12 <= len(d) <= 19 and sum(double) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    out = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(FORMS.items()) for m in re.finditer(p, text or "") if holds(kind, m.group())]
    return sorted(out)


def listed(spans):
    return ",".join(f"{list(FORMS)[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_of_the_whole_table(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    texts = dict(zip(t["doc_id"], t["text"], strict=True))
    found = {r["doc_id"]: r for r in pii.personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert set(found) == set(texts)
    for i, text in texts.items():
        base = plain_base(text)
        r = found[i]
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert set(filter(None, listed(base).split(","))) <= set(r["spans"].split(","))


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_of_odd_strings(seed):
    rng = random.Random(seed)
    bits = ["a", "b.c", "@", "x@y", ".", "-", "+", "1", "12", "255", "256", "4111111111111111", " ", "(", ")", "é", "\n", "0001", "%", "+1 ", "@@", "..", "１", "٣"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_runs_cost_one_pass():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "+1" + "(" * 1_000_000, "a@" * 300_000, "1-" * 500_000, "(at)" * 200_000):
        pii.candidates(text, pii.base_spans(text))


def plain_bootstrap(texts, how):
    """(value, kind) found by context: the same rules over dictionaries."""
    words_of = lambda t: [(m.start(), m.end(), m.group()) for m in re.finditer(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))]
    total, edges, seeds = {}, {}, {}
    for text in texts:
        words = words_of(text)
        for k in range(1, how.words + 1):
            for i in range(len(words) - k + 1):
                key = tuple(w[2] for w in words[i : i + k])
                total[key] = total.get(key, 0) + 1
        known = pii.base_spans(text)
        for a, kind, shape, e in [(a, k, -1, e) for a, k, e in known] + [(a, -1, s, e) for a, s, e in pii.candidates(text, known)]:
            value = text[a:e].lower()
            if kind >= 0:
                seeds[value] = min(kind, seeds.get(value, 9))
            left, right = [w for w in words if w[1] <= a], [w for w in words if w[0] >= e]
            for k in range(1, how.words + 1):
                for side, part in ((0, left[-k:]), (1, right[:k])):
                    if len(part) == k:
                        key = (side, tuple(w[2] for w in part), value, kind, shape)
                        edges[key] = edges.get(key, 0) + 1
    by = {}
    for (side, words, value, kind, shape), n in edges.items():
        by.setdefault((side, words), []).append((value, kind, shape, n))
    by = {p: e for p, e in by.items() if len({v for v, *_ in e}) >= how.support}
    found = {}
    for _ in range(how.rounds):
        held = {v: (k, 1.0) for v, k in seeds.items()} | {v: x for v, x in found.items() if v not in seeds}
        good = {}
        for p, e in by.items():
            for kind, name in enumerate(pii.KINDS):
                sure = [(v, n * held[v][1]) for v, _, _, n in e if v in held and held[v][0] == kind]
                undecided = sum(n for v, k, s, n in e if k < 0 and v not in held and pii.SHAPES[s] in pii.FITS[name])
                if len({v for v, _ in sure}) >= how.support:
                    score = min(1.0, sum(n for _, n in sure) / (total[p[1]] + 1 - (1 - how.undecided) * undecided))
                    if score >= how.pattern:
                        good[p, kind] = score
        latest = {}
        for (p, kind), score in good.items():
            for v, k, s, _ in by[p]:
                if k < 0 and pii.SHAPES[s] in pii.FITS[pii.KINDS[kind]]:
                    latest.setdefault((v, kind), {})[p] = score
        scores = {}
        for (v, kind), parts in latest.items():
            doubt = 1.0
            for s in parts.values():
                doubt *= 1 - min(s, 0.999999)
            if 1 - doubt >= how.value:
                scores.setdefault(v, []).append((1 - doubt, -kind))
        before, found = len(found), {v: (-max(x)[1], max(x)[0]) for v, x in scores.items()}
        if len(found) == before:
            break
    return {v: k for v, (k, _) in found.items()}


def planted(rng):
    phone = lambda: f"+{rng.randrange(10, 99)} {rng.randrange(100, 999)} {rng.randrange(1000000, 9999999)}"
    bare = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(1000000, 9999999)}"
    fill = lambda: " ".join(rng.choice(["corn", "harbour", "lake", "often", "stone", "under", "with"]) for _ in range(rng.randrange(3, 9)))
    rows = [f"{fill()} ring them on {phone()} before noon {fill()}" for _ in range(8)]
    rows += [f"{fill()} ring them on {bare()} before noon {fill()}" for _ in range(3)]
    rows += [f"{fill()} ring them on {n}. Reach the desk under {n} or {bare()} always" for n in (bare(), bare(), bare(), bare())]
    rows += [f"{fill()} write to {rng.choice('abcdef')}{k}@post{k}.example.org for help {fill()}" for k in range(6)]
    rows += [f"{fill()} write to anna (at) post (dot) example for help", f"{fill()} write to root@localhost for help"]
    rows += [f"{fill()} lot {rng.randrange(10**8, 10**9)} of stone {fill()}" for _ in range(9)]
    rows += [f"{fill()} version 3.0 {fill()} token4567 {fill()}" for _ in range(5)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_contexts_find_what_a_plain_bootstrap_finds(spark, seed):
    rng = random.Random(seed)
    texts = planted(rng)
    rng.shuffle(texts)
    docs = frame(spark, list(enumerate(texts)))
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    values = plain_bootstrap(texts, pii.Bootstrap())
    for i, text in enumerate(texts):
        known = pii.base_spans(text)
        more = [(a, values[text[a:e].lower()], e) for a, _, e in pii.candidates(text, known) if text[a:e].lower() in values]
        assert out[i] == listed(sorted(known + more))
    found = [i for i, t in enumerate(texts) if not pii.base_spans(t) and out[i]]
    assert len([i for i in found if "ring them" in texts[i]]) == 7 and sum("write to" in texts[i] for i in found) == 2
    assert not any(" lot " in texts[i] or "version" in texts[i] for i in found)


def test_contexts_need_different_values(spark):
    """Copies of one document make no pattern."""
    rows = [(i, "please ring +49 170 1234567 soon") for i in range(20)] + [(99, "please ring 0170-7654321 soon")]
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, rows)).collect()}
    assert out[99] == "" and out[0] == "phone:12:27"


def test_personal_data_edges(spark):
    long = "harbour " * 200_000 + "mail x.y@a.example.org " + "z" * 500_000
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, "a@b.co"), (3, "a@b.co"), (4, "é" * 5 + "q@b.co 10.0.0.256 10.0.0.1"), (5, long), (6, "4111 1111 1111 1111 +1 (2)")]
    out = pii.personal_data(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    spans = sorted((r["doc_id"] or 0, r["spans"]) for r in out)
    at = long.index("x.y@")
    assert spans == [(0, "email:0:6"), (1, ""), (2, ""), (3, "email:0:6"), (3, "email:0:6"), (4, "email:5:11,ip:23:31"), (5, f"email:{at}:{at + 17}"), (6, "card:0:19")]
    assert pii.personal_data(frame(spark, [])).count() == 0
    assert all(r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest() for r in out)
