"""Substring duplicates by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 16 bytes has five bits below the bytes of the
character that ends there, and with a line, so an insertion moves only the boundaries near
it and chunks are about as long in every script. From each chunk on, the fewest chunks
that make 80 bytes are a window; windows are grouped by digest, and windows that one
place before them holds at one distance make a repeated span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelforge.llm.sieve import sieve, sieved, told_apart
from funnelforge.llm.words import SPACED, as_bytes, batches, mix, ranges, rolled, sliced, small_batches
from funnelforge.session import stored

#: Bytes that decide a boundary.
REACH = 16

#: Words of a passage: over 50. Sentences and boilerplate lines are shorter.
PASSAGE = 51

#: Bytes of a window that passages are found by.
FOUND_BY = 40

#: Bytes beside a span that are looked at when it is extended; a chunk has some 32.
AROUND = 4096

#: Spans that a task extends at once.
AT_ONCE = 64

_words = re.compile(rb"[^\x20\x09-\x0D]+").finditer

_gear = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_gap = b"\0" * REACH


def _bounds(texts: list[bytes], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of consecutive texts: the first's index, their joined bytes, where each begins in
    these, and each chunk's owner, start and end in these."""
    for at, part in batches(texts):
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        begin = np.concatenate([[0], np.cumsum(sizes + REACH)])[:-1] + REACH
        flat = np.frombuffer(_gap + _gap.join(part), np.uint8)
        h = _gear[flat]
        for step in (1, 2, 4, 8):
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        # Bytes of the character that ends here, 0 inside one: each byte counts for the rate.
        more = (flat & 0xC0) == 0x80
        width = np.ones(len(flat), np.uint32)
        tail = more.copy()
        for back in (1, 2, 3):
            width += tail
            tail[back:] &= more[:-back]
            tail[:back] = False
        width[:-1][more[1:]] = 0
        inner = ((h >> np.uint32(REACH - bits)) & np.uint32((1 << bits) - 1)) < width
        inner |= flat == 0x0A
        # Boundaries are ends: inside texts where the hash says so, and at each text's end.
        mark = np.zeros(len(flat) + 1, bool)
        mark[1:] = inner
        inside = np.zeros(len(flat) + 2, np.int32)
        np.add.at(inside, begin + 1, 1)
        np.add.at(inside, begin + sizes + 1, -1)
        mark &= np.cumsum(inside[:-1]) > 0
        full = sizes > 0
        mark[(begin + sizes)[full]] = True
        ends = np.flatnonzero(mark)
        owner = np.searchsorted(begin, ends, "left") - 1
        starts = np.empty_like(ends)
        starts[1:] = ends[:-1]
        fresh = np.ones(len(ends), bool)
        fresh[1:] = owner[1:] != owner[:-1]
        starts[fresh] = begin[owner[fresh]]
        yield at, flat, begin, owner, starts, ends


def chunked(texts: list[bytes], bits: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, end, digest) of all chunks, in order."""
    out: list[tuple] = []
    for at, flat, begin, owner, starts, ends in _bounds(texts, bits):
        digest = ranges(rolled(flat.astype(np.uint64)), starts, ends)
        out.append((owner + at, starts - begin[owner], ends - begin[owner], digest.view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def windowed(texts: list[bytes], least: int = 80, bits: int = 5) -> tuple[np.ndarray, ...]:
    """(text index, start, end, first chunk, chunks, apart, words, name) of all windows: from
    each chunk on, the fewest chunks that make ``least`` bytes; none where the text ends before
    that. ``words`` packs the words that begin before the window (28 bits), those that lie
    inside it, those that begin in the chunks before it that a match may begin in, and those that end in the chunks behind
    it that ``least`` bytes reach (12 bits each, at most 4095).

    The n-th window of a text with the same bytes is named by these and n, so that it meets
    the n-th one of another text. From the second on, each comes once more, named by the
    bytes alone; ``apart`` says whether it lies ``least`` bytes from one before, or an
    equal one between it and the first does.
    """
    out: list[tuple] = []
    for at, flat, begin, owner, starts, ends in _bounds(texts, bits):
        last = np.searchsorted(ends, starts + least, "left")
        k = np.flatnonzero(last < len(ends))
        k = k[owner[last[k]] == owner[k]]
        name = ranges(rolled(flat.astype(np.uint64)), starts[k], ends[last[k]])
        order = np.lexsort((k, name, owner[k]))
        k, name = k[order], name[order]
        own, start, end = owner[k], starts[k], ends[last[k]]
        same = np.zeros(len(k), bool)
        same[1:] = (own[1:] == own[:-1]) & (name[1:] == name[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
        nth = np.arange(len(k)) - head
        far = np.zeros(len(k), np.int64)
        far[1:] = same[1:] & (start[1:] - start[:-1] >= least)
        far = np.cumsum(far)
        apart = far > far[head]
        begun, ended = _word_counts(flat, begin, np.fromiter(map(len, texts[at : at + len(begin)]), np.int64, len(begin)))
        # A match may begin in the chunk before, or before boundaries that what precedes it made.
        low = np.where((k > 0) & (owner[k - 1] == own), starts[k - 1], start) - REACH
        low = np.maximum(starts[np.searchsorted(ends, low, "right")], begin[own])
        # Chunks that match behind the last window have less than ``least`` bytes together.
        high = ends[np.minimum(np.searchsorted(ends, end + least, "left"), np.searchsorted(owner, own, "right") - 1)]
        packed = begun[start] - begun[begin[own]]
        for more in (ended[end] - begun[start], begun[start] - begun[low], ended[high] - ended[end]):
            packed = (packed << 12) | np.clip(more, 0, 4095)
        again = np.flatnonzero(nth)
        named = name.copy()
        named[again] = mix(name[again] + mix(nth[again].astype(np.uint64)))
        rows = (own + at, start - begin[own], end - begin[own], k - np.searchsorted(owner, own), last[k] - k + 1, apart, packed)
        rows = [np.concatenate([x, x[again]]) for x in rows]
        rows[5][: len(k)] = False
        out.append((*rows, np.concatenate([named, name[again]]).view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(8))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _word_counts(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in joined texts, the words that begin before it, and that end by it."""
    inside = np.zeros(len(flat) + 1, np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + sizes, -1)
    solid = np.zeros(len(flat) + 2, bool)
    solid[1:-1] = SPACED[flat] & (np.cumsum(inside[:-1]) > 0)
    count = lambda marks: np.concatenate([[0], np.cumsum(marks)])
    return count(solid[1:-1] & ~solid[:-2]), count(solid[1:-1] & ~solid[2:])


def windows(docs: DataFrame, least: int = 80, bits: int = 5) -> DataFrame:
    """(id, h, place, words, name) of each window of ``docs`` (id, text, h); ``place`` packs its
    start (31 bits), size (31) in bytes of UTF-8, and ``apart`` (1), as rows are many."""
    kind = docs.schema["id"].dataType.simpleString()

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(rows, 1):
            at, start, end, _, _, apart, words, name = windowed(as_bytes(part.column(1)), least, bits)
            place = (start << 32) | ((end - start) << 1) | apart
            docs_of = pa.array(at, pa.int64())
            yield pa.record_batch([part.column(0).take(docs_of), part.column(2).take(docs_of), *(pa.array(x, pa.int64()) for x in (place, words, name))], ["id", "h", "place", "words", "name"])

    rows = docs.select("id", "text", "h").where("id is not null and text is not null")
    return rows.mapInArrow(cut, f"id {kind}, h long, place long, words long, name long")


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with start, end and apart in place of ``place``."""
    start = F.shiftright("place", 32).cast("int")
    size = F.shiftright(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int")
    return rows.withColumns({"start": start, "end": start + size, "apart": F.col("place").bitwiseAND(F.lit(1)) == 1}).drop("place")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 80, bits: int = 5, words: int | None = None) -> DataFrame:
    """(id, start, end, bytes, keep_id, h): spans of ``least`` bytes or more of whole
    chunks that one place before them holds as a whole, in document ``keep_id``.

    That is a smaller id, or the same document further ahead: what recurs in steps of less
    than ``least`` bytes is one stretch, whose repeats begin where it comes anew. Each window
    is held against its first place, by (id, start); windows that have their first places
    in one document at one distance make one span. Spans that another one holds have no
    row; others may overlap. Windows are compared by 64-bit digests of their bytes. The first
    copy has no row. Rows with null ids or texts have no windows. Rows that repeat an id with
    another text are documents of their own, in the order of ``h``, a hash of the text that
    is 0 for ids that surely do not repeat; equal rows are one document. Texts are read whole,
    up to the 2 GB that offsets reach. An empty table gives no rows; other columns are not
    read. Counts per name are combined before the shuffle, so a window in a third of all
    documents is one row per task.

    With ``words``, a span counts if it has as many whole words. Chunks end before a match
    does, so a span that falls short, but would not if the chunks beside it matched, is
    settled by its bytes: texts of such spans are fetched, the match is extended byte by byte on
    both sides, and its words are counted. Those spans are the matches themselves.
    """
    texts = told_apart(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    # Cut twice, which costs less than to write all windows.
    rows = windows(texts, least, bits)
    first = F.min(F.struct("id", "h", F.shiftright("place", 32).cast("int").alias("start"))).alias("first")
    shared = rows.groupBy("name").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    doc, keep = F.struct("id", "h"), F.struct(F.col("keep_id").alias("id"), F.col("keep_h").alias("h"))
    own = F.col("apart") & (keep == doc) & (F.col("keep_start") < F.col("start"))
    with small_batches(docs.sparkSession):
        # Written before it is joined back, so that the join of a hot name can be split.
        shared = stored(shared.select("name", F.col("first.id").alias("keep_id"), F.col("first.h").alias("keep_h"), F.col("first.start").alias("keep_start")), "windows-shared")
        met = _placed(rows.join(shared, "name")).where((keep < doc) | own)
        later = met.select("id", "h", "start", "end", "words", "keep_id", "keep_h", (F.col("start") - F.col("keep_start")).alias("shift"))
        later = stored(later, "windows-later").repartition("id", "h").distinct()
    w = Window.partitionBy("id", "h", "keep_id", "keep_h", "shift").orderBy("start")
    new = F.coalesce((F.lag("end").over(w) < F.col("start")).cast("int"), F.lit(1))
    runs = later.withColumn("run", F.sum(new).over(w)).groupBy("id", "h", "keep_id", "keep_h", "shift", "run")
    part = lambda right: F.shiftrightunsigned("words", right).bitwiseAND(F.lit(4095))
    begun, inside = F.shiftrightunsigned("words", 36), part(24)
    spans = runs.agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.max(begun + inside) - F.min(begun)).alias("n_words"),
        (F.max(begun + inside + part(0)) - F.min(begun - part(12))).alias("most_words"),
    )
    if words is not None:
        judged = stored(spans.drop("run").where(F.col("most_words") >= words), "spans")
        near = judged.where(F.col("n_words") < words)
        spans = judged.where(F.col("n_words") >= words).unionByName(_extended(texts, near, words).select(*judged.columns))
    before = Window.partitionBy("id", "h").orderBy("start", F.desc("end"), "keep_id", "keep_h", "shift").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("held", F.max("end").over(before)).where("held is null or held < end")
    size = (F.col("end") - F.col("start")).cast("long")
    return spans.select(F.col("id").alias(id_col), "start", "end", size.alias("bytes"), "keep_id", "h")


def _extended(texts: DataFrame, spans: DataFrame, words: int) -> DataFrame:
    """``spans`` extended to all bytes that match beside them, of those that then have
    ``words`` words. Only texts of these spans are moved, and of these only what is around them."""
    wanted = stored(spans.select("id", "h").union(spans.select("keep_id", "keep_h")).distinct(), "span-docs")
    marked = sieved(texts, sieve(wanted.select("id")), F.col("id"))
    bodies = stored(marked.where("met").select("id", "h", "text").join(wanted, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]), "span-texts")

    def around(requests: DataFrame, at: str, name: str) -> DataFrame:
        body = F.encode("text", "UTF-8")
        first = F.greatest(F.col(at) - AROUND, F.lit(0))
        size = F.col("end") - F.col("start")
        cut = F.struct(F.substring(body, first + 1, F.col(at) - first).alias("l"), F.substring(body, F.col(at) + 1, size).alias("m"), F.substring(body, F.col(at) + size + 1, F.lit(AROUND)).alias("r"))
        return requests.withColumn(name, cut).drop("text")

    own = around(spans.withColumn("keep_start", F.col("start") - F.col("shift")).join(bodies, ["id", "h"]), "start", "own")
    held = bodies.select(F.col("id").alias("keep_id"), F.col("h").alias("keep_h"), "text")
    both = around(stored(own, "span-own").join(held, ["keep_id", "keep_h"]), "keep_start", "other").drop("keep_start")
    rest = [c for c in both.columns if c not in ("own", "other")]
    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in rest)
    found = both.mapInArrow(lambda batches: _extending(batches, rest), f"{kinds}, before int, behind int, n int").where(F.col("n") >= words)
    found = found.withColumns({"start": F.col("start") - F.col("before"), "end": F.col("end") + F.col("behind"), "n_words": F.col("n").cast("long")}).drop("before", "behind", "n")
    # Written here, as only what is run here is sent in small batches.
    with small_batches(texts.sparkSession):
        return stored(found, "spans-extended")


def _extending(batches: Iterator[pa.RecordBatch], rest: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows (``rest``, own, other): ``rest`` and what ``extension`` finds. Few rows are
    Python's at once: each brings twice ``AROUND`` bytes and more on both sides."""
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            b = whole.slice(at, AT_ONCE)
            own, other = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("own", "other"))
            found = [extension(x, y) for x, y in zip(own, other, strict=True)]
            yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in rest), *(pa.array([f[k] for f in found], pa.int32()) for k in range(3))], [*rest, "before", "behind", "n"])


def extension(own: dict[str, bytes], other: dict[str, bytes]) -> tuple[int, int, int]:
    """By how many bytes two equal parts (l, m, r: what is before, the part, what is behind)
    match on either side, in whole characters, and how many whole words that makes. Parts
    that differ have none."""
    if own["m"] != other["m"]:
        return 0, 0, 0

    def common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        apart = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
        return int(apart[0]) if len(apart) else n

    text = own["l"] + own["m"] + own["r"]
    start = len(own["l"]) - common(own["l"][::-1], other["l"][::-1])
    end = len(own["l"]) + len(own["m"]) + common(own["r"], other["r"])
    while text[start] & 0xC0 == 0x80:
        start += 1
    while end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    n = sum(start <= m.start() and m.end() <= end for m in _words(text))
    return len(own["l"]) - start, end - len(own["l"]) - len(own["m"]), n


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``repeated_spans`` of these ``docs`` cut out of their texts.
    Columns stay as they are, whatever their names."""
    mine = spans.select(F.col(id_col).alias("id"), "h", "start", "end")
    w = Window.partitionBy("id", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    # What is left before a span begins where those before it end at last.
    ordered = mine.withColumn("left", F.coalesce(F.max("end").over(w), F.lit(0)))
    cuts = ordered.groupBy("id", "h").agg(
        F.array_sort(F.collect_list(F.when(F.col("left") < F.col("start"), F.struct(F.col("left").alias("a"), F.col("start").alias("b"))))).alias("before"),
        F.max("end").alias("end"),
    )
    body = F.encode(F.col("text"), "UTF-8")
    whole = F.concat("before", F.array(F.struct(F.col("end").alias("a"), F.octet_length("text").alias("b"))))
    parts = F.transform(whole, lambda p: F.decode(F.substring(body, p["a"] + 1, p["b"] - p["a"]), "UTF-8"))
    rows = told_apart(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    found = rows.join(cuts, ["id", "h"], "left")
    text = F.when(F.col("end").isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    return found.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
