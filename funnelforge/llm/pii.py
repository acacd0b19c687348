"""Personal data: identifiers of known form, and others that stand in the same contexts.

Known forms (e-mail, IP address, card, phone) are the seeds. The words beside them are
patterns; a pattern is as good as the share of its occurrences in the whole corpus that
stand beside an identifier. Good patterns name candidates of a fitting shape, these make
other patterns good, and so on over a graph of patterns and values that Spark scores round
by round.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelforge.llm.words import ALNUM, Words, ranges, rolled, sliced, small_batches
from funnelforge.session import stored

#: Fixed values of the contract: the kinds in order, and their forms.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")

#: Shapes of candidates, and the kinds that each may turn out to be.
SHAPES = ("at", "colons", "number", "token")
FITS = {"email": ("at", "token"), "ip": ("colons", "number"), "card": ("number",), "phone": ("number",)}
_AT = re.compile(r"@|\x20?[\[(]\x20?at\x20?[\])]\x20?", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]++)*", re.I)
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9])++(?![A-Za-z])")
_TOKEN = re.compile(r"(?<![0-9A-Za-z_])[A-Za-z_]*+[0-9][0-9A-Za-z_]*+")
#: Digits of a number, and characters and digits of a token, that make a candidate.
NUMBER_DIGITS, TOKEN_LENGTH, TOKEN_DIGITS = 7, 6, 3

BITS = 1 << 25
#: Counts that a task keeps before it hands them on.
HELD = 1 << 20


@dataclass(frozen=True)
class Bootstrap:
    """When a pattern is good and a value is taken: the words of a pattern, the different
    values that it must stand beside, its least score, a value's, what an undecided
    neighbour of fitting shape counts, and the most rounds."""

    words: int = 2
    support: int = 3
    pattern: float = 0.5
    value: float = 0.5
    undecided: float = 0.5
    rounds: int = 5


Span = tuple[int, int]


def _before(text: str, at: int, least: int) -> int:
    """Where the run of local-part characters that ends at ``at`` begins, not before ``least``."""
    while at > least and _LOCAL.match(text, at - 1):
        at -= 1
    return at


def _around(text: str, mark: re.Pattern, behind: re.Pattern) -> Iterator[Span]:
    """Matches of local part, ``mark`` and ``behind``, from left to right. Each run of letters
    is read once, so a long text without marks costs one search."""
    end = at = 0
    while found := mark.search(text, at):
        at = found.end()
        start = _before(text, found.start(), end)
        host = behind.match(text, found.end()) if start < found.start() else None
        if host:
            end = at = host.end()
            yield start, end


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the identifiers of known form, sorted."""
    out = [(a, 0, b) for a, b in _around(text, re.compile("@"), _DOMAIN)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def candidates(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, shape, end) of what may be an identifier, apart from ``known`` and each other;
    of overlapping ones the first shape stays."""
    taken = sorted((a, b) for a, _, b in known)
    out: list[tuple[int, int, int]] = []
    forms: list[tuple[int, Callable[[], Iterator[Span]]]] = [(0, lambda: _around(text, _AT, _HOST))]
    if _DIGITS.search(text):
        forms += [(k, lambda p=p: (m.span() for m in p.finditer(text))) for k, p in ((1, _COLONS), (2, _NUMBER), (3, _TOKEN))]
    for shape, spans in forms:
        own = []
        at = 0
        for a, b in spans():
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if (at == len(taken) or taken[at][0] >= b) and _solid(text[a:b], shape):
                own.append((a, b))
        out += [(a, shape, b) for a, b in own]
        taken = sorted(taken + own)
    return sorted(out)


def _solid(text: str, shape: int) -> bool:
    if shape == 0:
        return True
    n = len(_DIGITS.findall(text))
    if shape == 1:
        return n >= 2
    return n >= NUMBER_DIGITS if shape == 2 else n >= TOKEN_DIGITS and len(text) >= TOKEN_LENGTH and n < len(text)


class Contexts:
    """The hashed words around places of one text."""

    def __init__(self, text: str):
        raw = text.encode(errors="replace")
        starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        self.byte = np.append(starts, len(raw))
        self.low = raw.lower()
        self.words = Words([self.low], ALNUM)
        self.prefix = rolled(self.words.hashes())

    def beside(self, start: int, end: int, most: int) -> list[dict]:
        """(side, key, words) of up to ``most`` words before ``start`` and from ``end`` on."""
        w, out = self.words, []
        left = int(np.searchsorted(w.end, self.byte[start], "right"))
        right = int(np.searchsorted(w.start, self.byte[end], "left"))
        for k in range(1, most + 1):
            for side, a in ((0, left - k), (1, right)):
                if a >= 0 and a + k <= len(w.start):
                    key = ranges(self.prefix, np.array([a]), np.array([a + k]))[0]
                    out.append({"side": side, "key": int(key.astype(np.int64)), "words": self.low[w.start[a] : w.end[a + k - 1]].decode(errors="replace")})
        return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.list_(
    pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("shape", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("beside", pa.list_(pa.struct([("side", pa.int32()), ("key", pa.int64()), ("words", pa.string())])))])
)
_SCHEMA = "base array<struct<start: int, kind: int, end: int>>, found array<struct<start: int, kind: int, shape: int, end: int, value: string, beside: array<struct<side: int, key: long, words: string>>>>"


def scanned(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(rid, id, base, found) per row: the spans of known form, and these and all candidates
    with their values and what is beside them. ``kind`` or ``shape`` is -1 where it is the other."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(rows, 2):
            base, found = [], []
            for raw in b.column(2).cast(pa.binary()).to_pylist():
                text = (raw or b"").decode(errors="replace")
                known = base_spans(text)
                other = candidates(text, known)
                base.append([{"start": a, "kind": k, "end": e} for a, k, e in known])
                if known or other:
                    around = Contexts(text)
                    every = [(a, k, -1, e) for a, k, e in known] + [(a, -1, s, e) for a, s, e in other]
                    found.append([{"start": a, "kind": k, "shape": s, "end": e, "value": text[a:e].lower(), "beside": around.beside(a, e, most)} for a, k, s, e in every])
                else:
                    found.append([])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(base, _SPANS), pa.array(found, _FOUND)], ["rid", "id", "base", "found"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(scan, f"rid long, id {kind}, {_SCHEMA}")


def occurrences(docs: DataFrame, text_col: str, keys: DataFrame, most: int) -> DataFrame:
    """(key, total): how often each window of words of ``keys`` (key) occurs in all texts.

    A set of 2**25 bits, whatever the number of keys, tells tasks what to count; windows that
    only share a bit are counted too, and meet no key.
    """
    slot = F.pmod("key", F.lit(BITS)) + 1
    bits = keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    held = np.zeros(BITS >> 3, np.uint8)
    for r in bits.toLocalIterator():  # 1024 rows of 4 KB at most
        held[(r["at"] - 1) << 12 : r["at"] << 12] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = shared.value, []
        for b in sliced(rows, 0):
            w = Words([(t or b"").lower() for t in b.column(0).cast(pa.binary()).to_pylist()], ALNUM)
            prefix, n, owner = rolled(w.hashes()), len(w.start), w.owner()
            for k in range(1, most + 1):
                at = np.arange(max(0, n - k + 1))
                at = at[owner[at] == owner[at + k - 1]]
                key = ranges(prefix, at, at + k)
                place = key & np.uint64(BITS - 1)
                hit = key[(known[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                held.append(np.unique(hit, return_counts=True))
            if sum(len(k) for k, _ in held) > HELD:
                held = [_merged(held)]
                if len(held[0][0]) > HELD // 2:
                    yield _totals(held.pop())
        if held:
            yield _totals(_merged(held))

    return docs.select(F.col(text_col)).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("total"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of several counts, and their sums."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, np.concatenate([n for _, n in parts]))
    return keys, sums


def _totals(counts: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(counts[0].astype(np.int64)), pa.array(counts[1])], ["key", "n"])


def _fits(kind: Column, shape: Column) -> Column:
    """Whether a candidate of the shape may be of the kind."""
    pairs = [F.struct(F.lit(KINDS.index(k)).alias("k"), F.lit(SHAPES.index(s)).alias("s")) for k, shapes in FITS.items() for s in shapes]
    return F.exists(F.array(*pairs), lambda p: (p["k"] == kind) & (p["s"] == shape))


def graph(docs: DataFrame, rows: DataFrame, text_col: str, how: Bootstrap) -> DataFrame:
    """(side, key, words, value, kind, shape, n, total): the patterns that stand beside enough
    different values, the values, and how often each pair and each pattern occurs."""
    beside = rows.select(F.explode("found").alias("f")).select("f.value", "f.kind", "f.shape", F.explode("f.beside").alias("b"))
    edges = stored(beside.groupBy("b.side", "b.key", "value", "kind", "shape").agg(F.count(F.lit(1)).alias("n"), F.min("b.words").alias("words")), "pii-edges")
    wide = stored(edges.groupBy("side", "key").agg(F.count_distinct("value").alias("k")).where(F.col("k") >= how.support).select("side", "key"), "pii-patterns")
    totals = stored(occurrences(docs, text_col, wide.select("key").distinct(), how.words), "pii-totals")
    return stored(edges.join(wide, ["side", "key"]).join(totals, "key"), "pii-graph")


def pattern_scores(edges: DataFrame, values: DataFrame, how: Bootstrap) -> DataFrame:
    """(side, key, kind, words, score) of good patterns, given values (value, kind, score).

    The score is the share of a pattern's occurrences that stand beside a value of the kind;
    undecided candidates of fitting shape count in part, all else against it.
    """
    sure = edges.join(values.select("value", F.col("kind").alias("of"), "score"), "value")
    good = sure.groupBy("side", "key", F.col("of").alias("kind")).agg(F.sum(F.col("n") * F.col("score")).alias("pos"), F.count_distinct("value").alias("k"), F.max("total").alias("total"), F.min("words").alias("words"))
    good = good.where(F.col("k") >= how.support)
    open_ = edges.where("kind = -1").join(values.select("value"), "value", "left_anti")
    open_ = open_.select("side", "key", "n", F.explode(F.array(*map(F.lit, range(len(KINDS))))).alias("kind"), "shape").where(_fits(F.col("kind"), F.col("shape")))
    undecided = open_.groupBy("side", "key", "kind").agg(F.sum("n").alias("open"))
    met = good.join(undecided, ["side", "key", "kind"], "left")
    score = F.col("pos") / (F.col("total") + 1 - (1 - how.undecided) * F.coalesce("open", F.lit(0)))
    return met.select("side", "key", "kind", "words", F.least(score, F.lit(1.0)).alias("score")).where(F.col("score") >= how.pattern)


def value_scores(edges: DataFrame, patterns: DataFrame, how: Bootstrap) -> DataFrame:
    """(value, kind, score) of candidates that good patterns stand beside: one less the chance
    that all of them err; of several kinds the likeliest, then the first."""
    met = edges.where("kind = -1").select("side", "key", "value", "shape").join(patterns.select("side", "key", F.col("kind").alias("of"), "score"), ["side", "key"])
    met = met.where(_fits(F.col("of"), F.col("shape"))).select("value", "of", "side", "key", "score").distinct()
    doubt = F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999999)))))
    found = met.groupBy("value", "of").agg((1 - doubt).alias("score")).where(F.col("score") >= how.value)
    best = found.groupBy("value").agg(F.max(F.struct("score", (-F.col("of")).alias("of"))).alias("b"))
    return best.select("value", (-F.col("b.of")).alias("kind"), F.col("b.score").alias("score"))


def bootstrapped(edges: DataFrame, how: Bootstrap) -> tuple[DataFrame, DataFrame]:
    """(patterns, values) after rounds in which no further value is found, ``how.rounds`` at most."""
    seeds = edges.where("kind >= 0").groupBy("value").agg(F.min("kind").alias("kind")).select("value", "kind", F.lit(1.0).alias("score"))
    seeds = stored(seeds, "pii-seeds")
    found, n = None, 0
    for _ in range(how.rounds):
        values = seeds if found is None else seeds.union(found.join(seeds, "value", "left_anti"))
        patterns = stored(pattern_scores(edges, values, how), "pii-good")
        found, before = stored(value_scores(edges, patterns, how), "pii-values"), n
        n = found.count()
        if n == before:
            break
    return patterns, found


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Bootstrap = Bootstrap()) -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of identifiers of known form; ``spans`` has these and the ones
    found by context, as kind:start:end in code points by start, then kind. Spans of one
    kind do not overlap, those found by context overlap nothing. Null and empty texts have
    none; rows that repeat have the same each; ids may be null or repeat; texts of any
    length are read whole, each run of characters once; an empty table gives no rows; other
    columns are not read. Two scans read the texts; all else is of the size of what they find.
    """
    with small_batches(docs.sparkSession):
        rows = stored(scanned(docs, id_col, text_col, how.words), "pii-found")
        edges = graph(docs, rows, text_col, how)
    _, found = bootstrapped(edges, how)
    other = rows.select("rid", F.explode("found").alias("f")).where("f.kind = -1").select("rid", "f.start", "f.end", "f.value")
    more = other.join(found.select("value", "kind"), "value").groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    met = rows.select("rid", "id", "base").join(more, "rid", "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.expr("array()"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return met.select(F.col("id").alias(id_col), *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
