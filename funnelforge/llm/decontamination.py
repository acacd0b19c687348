"""Benchmark decontamination with a broadcast hash set of test n-grams.

The windows of the benchmark are cut on the executors. Blocks of a bounded number of
windows and bytes are broadcast one after another, each scanned for in a pass of its own
whose hits are written before the next, so that what driver and tasks hold is bounded
whatever the benchmark's size. Each hit is verified word by word. Which items have a
window is joined to the hits afterwards and never broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelforge.llm.sieve import sieve, sieved
from funnelforge.llm.words import ALNUM, Words, as_bytes, batches, rolled, sliced, small_batches, windows
from funnelforge.session import stored

#: Distinct window texts in one broadcast, and their bytes.
BLOCK, BLOCK_BYTES = 100_000, 24 << 20

_slots = 1 << 22


def benchmark_windows(benchmark: DataFrame, size: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, gram, n_words): the distinct window texts of each item.

    A window is ``size`` consecutive words; an item of fewer, but not none, is one.
    Null texts have none. ``item`` is the id as a string.
    """

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids, grams, sizes = [], [], []
            for i, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                words = plain(text).split()
                n = min(size, len(words))
                for k in range(len(words) - n + 1) if n else ():
                    ids.append(i)
                    grams.append(b" ".join(words[k : k + n]))
                    sizes.append(n)
            yield pa.record_batch(
                [pa.array(ids, pa.string()), pa.array(grams, pa.binary()), pa.array(sizes, pa.int32())], ["item", "gram", "n_words"]
            )

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("t"))
    return rows.mapInArrow(cut, "item string, gram binary, n_words int").distinct()


_lower = bytes(x if ALNUM[x] else 0x20 for x in range(256))


def plain(text: bytes) -> bytes:
    """Lower case A-Z, and a space for each byte outside words; as long as ``text``."""
    return text.lower().translate(_lower)


class Finder:
    """Occurrences of window texts in documents."""

    def __init__(self, grams: list[tuple[bytes, int, int]]):
        self.numbers = {gram: number for gram, _, number in grams}
        self.slots = {}
        for n in sorted({n for _, n, _ in grams}):
            own = [gram for gram, m, _ in grams if m == n]
            hashes = np.concatenate([self._of(own[i : i + 4096], n) for i in range(0, len(own), 4096)])
            slots = np.zeros(_slots, bool)
            slots[hashes & np.uint64(_slots - 1)] = True
            self.slots[n] = slots

    @staticmethod
    def _of(grams: list[bytes], n: int) -> np.ndarray:
        words = Words(grams, ALNUM)
        return windows(rolled(words.hashes()), len(words.start), n)[words.first[:-1]]

    def __call__(self, texts: list[bytes], everything: bool = False) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]], list[int]]]:
        """(text, its words, ranges, window numbers) of each text with hits, or of every text.
        Ranges are what overlapping occurrences cover: first word, end word, first byte, end byte."""
        for at, part in batches(texts):
            words = Words([plain(t) for t in part], ALNUM)
            n = len(words.start)
            prefix = rolled(words.hashes())
            found: dict[int, list[tuple[int, int, int]]] = {}
            for size, slots in self.slots.items():
                hashes = windows(prefix, n, size)
                for k in np.flatnonzero(slots[hashes & np.uint64(_slots - 1)]).tolist():
                    owner = int(np.searchsorted(words.first, k, "right")) - 1
                    if k + size <= words.first[owner + 1]:
                        gram = b" ".join(words.joined[words.start[j] : words.end[j]] for j in range(k, k + size))
                        if (number := self.numbers.get(gram)) is not None:
                            found.setdefault(owner, []).append((k, k + size, number))
            for owner in range(len(part)) if everything else sorted(found):
                hits = found.get(owner, [])
                covered: list[list[int]] = []
                for a, z, _ in sorted(hits):
                    if covered and a < covered[-1][1]:
                        covered[-1][1] = max(covered[-1][1], z)
                    else:
                        covered.append([a, z])
                first, begin = int(words.first[owner]), int(words.text_start[owner])
                spans = [(a - first, z - first, int(words.start[a]) - begin, int(words.end[z - 1]) - begin) for a, z in covered]
                yield at + owner, int(words.first[owner + 1]) - first, spans, sorted({k for _, _, k in hits})


_SPAN = "struct<start:int,end:int,a:int,b:int>"


def _scan(rows: DataFrame, grams, everything: bool) -> DataFrame:
    """``rows`` (text as the last column) with n_words, spans and grams in the text's place;
    without ``everything`` only rows with hits."""
    span = pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "end", "a", "b")]))
    kept = rows.columns[:-1]
    last = len(kept)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(grams.value)
        for b in sliced(batches, last):
            at, n, spans, numbers = zip(*found, strict=True) if (found := list(finder(as_bytes(b.column(last)), everything))) else ((), (), (), ())
            named = [[dict(zip(("start", "end", "a", "b"), x, strict=True)) for x in own] for own in spans]
            own = pa.array(at, pa.int64())
            columns = [*(b.column(k).take(own) for k in range(last)), pa.array(n, pa.int64()), pa.array(named, span), pa.array(numbers, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, [*kept, "n_words", "spans", "grams"])

    kinds = "".join(f"{c} {t}, " for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(scan, f"{kinds}n_words long, spans array<{_SPAN}>, grams array<long>")


def _key(text: str) -> Column:
    return F.md5(F.col(text).cast("binary"))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, text_col: str = "text", item_col: str = "item_id", block: int = BLOCK, everything: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The first pass over ``docs``, and (key, n_words, n_hit, items, spans) of each distinct
    text with hits: the md5 digest of the text, its words, how many of them are hit, the items
    whose windows occur as sorted ids, and the hit stretches in order as ranges of words and bytes.

    The first pass has key, n_words and the other columns of ``docs`` for each row with hits,
    or with ``everything`` for each row. Null texts are empty; empty texts and tables
    have no hits. A benchmark of more than ``block`` window texts, or of more than
    BLOCK_BYTES, takes a pass over the texts for each block.
    """
    rows = docs.select(_key(text_col).alias("key"), *(c for c in docs.columns if c != text_col), F.col(text_col).alias("text"))
    spark = rows.sparkSession
    cuts = stored(benchmark_windows(benchmark, size, item_col), "benchmark-windows")
    grams = stored(cuts.select("gram", "n_words").distinct().withColumn("number", F.monotonically_increasing_id()), "benchmark-grams")
    total = grams.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-total["n"] // block), -(-total["bytes"] // BLOCK_BYTES))
    passes = []
    for k in range(n_blocks):
        own = grams.where(F.pmod(F.xxhash64("gram"), F.lit(n_blocks)) == k)
        held = spark.sparkContext.broadcast([(bytes(r["gram"]), r["n_words"], r["number"]) for r in own.toLocalIterator()])
        with small_batches(spark):
            passes.append(stored(_scan(rows, held, everything and not k), "benchmark-hits"))
        held.destroy()
    # Equal texts have equal hits: each counts once before they meet.
    hits = reduce(DataFrame.unionByName, (p.where(F.size("grams") > 0).select("key", "n_words", "spans", "grams").dropDuplicates(["key"]) for p in passes))
    items = hits.select("key", F.explode("grams").alias("number")).join(grams, "number").join(cuts.where("item is not null"), ["gram", "n_words"])
    items = items.select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    # Windows of different blocks may overlap: a word counts once.
    spans = hits.groupBy("key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    more = lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(s["end"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n"))
    n_hit = F.aggregate("spans", begin, more, lambda acc: acc["n"])
    met = spans.join(items, "key", "left")
    found = stored(met.select("key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans"), "benchmark-found")
    return passes[0], found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a benchmark window is hit; a document is contaminated
    if it has hits and ``share`` * n_hit >= n_words. Null and empty texts have no words. Ids
    may be null or repeat; equal texts get equal results; items without an id hit, but are
    not counted. Empty tables give no rows, or no hits. Texts of any length count whole;
    other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first, found = find_contamination(narrow, benchmark, block=block, everything=True)
    found = found.select("key", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    rows = first.select("id", "n_words", "key").join(found, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def _without(text: str, spans: str) -> Column:
    """The text without the stretches."""
    body = F.encode(F.col(text), "UTF-8")
    piece = lambda a, b: F.decode(F.substring(body, a + 1, b - a), "UTF-8")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = lambda acc, s: F.struct(F.greatest(acc["at"], s["b"]).alias("at"), F.concat(acc["out"], piece(acc["at"], F.greatest(s["a"], acc["at"]))).alias("out"))
    return F.aggregate(spans, begin, cut, lambda acc: F.concat(acc["out"], piece(acc["at"], F.greatest(F.octet_length(body), acc["at"]))))


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", share: int = 20) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit words.

    Columns stay as they are, whatever their names; the cases are those of ``contamination``.
    Rows without hits stay where they are: only what may have some meets the hits.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), _key(text_col).alias("key"))
    _, found = find_contamination(rows.select("text"), benchmark, text_col="text")
    if remove == "documents":
        found = found.where(F.col("n_hit") * share >= F.col("n_words")).select("key")
    marked = sieved(rows, sieve(found.select("key")), F.col("key"))
    maybe = marked.where("met")
    if remove == "documents":
        kept = maybe.join(found, "key", "left_anti").select("row")
    else:
        met = maybe.join(found.select("key", "spans"), "key", "left")
        text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(_without("text", "spans"))
        kept = met.select(F.col("row").withField(text_col, text).alias("row"))
    return marked.where("not met").select("row").unionByName(kept).select("row.*")
