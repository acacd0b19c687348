"""Spelling variants: words of a corpus that are one edit apart, and the form each leads to.

Words are counted in one scan. Two words within one edit keep the first or the last half
of the shorter one, so words meet in groups of an equal half; a group that is large is
halved again inside the part that may differ, until groups are small. A group's sorted
words are scanned with banded rows of the edit matrix: a row is kept for each letter, the
next word goes on from the row of the prefix that it shares with the one before, and a
prefix that has left the band skips all words that share it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelforge.llm.words import sliced, small_batches
from funnelforge.session import discard, stored

#: Fixed values of the contract.
RUN = re.compile("[a-zÀ-ÿ]+")
ONE_IN, SHORTEST, LEAST, TIMES = 97, 5, 3, 2
#: Words of a group that are compared by one scan; larger groups are halved.
GROUP = 48
#: Different words that a task counts before it hands them on.
REMEMBERED = 1 << 18


def runs(text: str) -> list[str]:
    """The maximal runs of Latin letters, A-Z lower-cased."""
    return RUN.findall(text.encode(errors="replace").lower().decode())


def misspelt(word: str, start: int) -> str | None:
    """The word with a letter dropped, if its checksum after ``start`` asks for that."""
    h = zlib.crc32(word.encode(), start)
    if h % ONE_IN:
        return None
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least SHORTEST letters and LEAST occurrences."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for b in sliced(rows, 1):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                found = RUN.findall(text.lower().decode(errors="replace"))
                total.update(found)
                start = zlib.crc32(f"{key or ''}:".encode())
                own = Counter(found)
                for word in [w for w in own if not zlib.crc32(w.encode(), start) % ONE_IN]:
                    total[word] -= own[word]
                    total[misspelt(word, start)] += own[word]
            if len(total) > REMEMBERED:
                yield _counted(total)
                total.clear()
        yield _counted(total)

    texts = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t"))
    parts = texts.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _counted(total: Counter[str]) -> pa.RecordBatch:
    rows = [(w, n) for w, n in total.items() if n and len(w) >= SHORTEST]
    return pa.record_batch([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])


def halved(rows: DataFrame) -> DataFrame:
    """Each row (size, lo, hi, word, n) twice: with the letters kept before the middle of
    [lo, hi), and with those kept behind it.

    ``size`` is the length of the shorter word of the pairs that are looked for; letters
    before ``lo`` and the last ``size - hi`` are equal in a group.
    """
    middle = F.expr("(lo + hi) div 2").cast("int")
    ends = F.explode(F.array(F.struct(middle.alias("lo"), F.col("hi")), F.struct(F.col("lo"), middle.alias("hi")))).alias("e")
    cut = rows.select("size", ends, "word", "n").select("size", "e.lo", "e.hi", "word", "n")
    return cut.select("size", "lo", "hi", F.expr("left(word, lo)").alias("head"), F.expr("right(word, size - hi)").alias("tail"), "word", "n")


def groups(words: DataFrame, limit: int = GROUP) -> Iterator[DataFrame]:
    """(size, lo, hi, words array<struct<word, n>>): each pair of words within one edit is in
    groups of its size, and in exactly one by the rule of ``near_in``. A group has ``limit``
    words at most, or one free letter in its shorter words and two in its longer ones."""
    key = ["size", "lo", "hi", "head", "tail"]
    length = F.length("word")
    sizes = F.explode(F.array_compact(F.array(length, F.when(length > SHORTEST, length - 1)))).alias("size")
    rows = words.select("word", "n", sizes).select("size", F.lit(0).alias("lo"), F.col("size").alias("hi"), "word", "n")
    previous: DataFrame | None = None
    while True:
        parts = stored(halved(rows), "spelling-parts")
        sums = stored(parts.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "spelling-sums")
        if previous is not None:
            discard(previous)
        met = stored(parts.join(sums, key), "spelling-met")
        discard(parts)
        discard(sums)
        small = (F.col("k") <= limit) | (F.col("hi") - F.col("lo") <= 1)
        yield met.where(small).groupBy(*key).agg(F.collect_list(F.struct("word", "n")).alias("words")).select("size", "lo", "hi", "words")
        rows, previous = met.where(~small).select("size", "lo", "hi", "word", "n"), met
        if rows.isEmpty():
            discard(met)
            return


def near_in(words: list[str], size: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The pairs (indices into ``words``) within one edit whose shorter word has ``size``
    letters and that belong to this group: their letters before ``hi`` differ, unless
    ``hi`` is the end, so that a pair that two halves hold is found once.

    Words are sorted, from behind where the kept letters are there. A row of the edit
    matrix is (left, middle, right): the distances of the letters read so far to one letter
    less, as many, and one more of the sought word.
    """
    turned = hi < size and lo == 0
    texts = [w[::-1] for w in words] if turned else words
    order = sorted(range(len(texts)), key=texts.__getitem__)
    listed = [texts[i] for i in order]
    shared = [0] * len(listed)
    for t in range(1, len(listed)):
        a, b = listed[t - 1], listed[t]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        shared[t] = k
    for q, sought in enumerate(listed):
        m = len(sought)
        common = m  # letters that the sought word shares with all words passed
        rows: list[tuple[int, int, int]] = []  # of the letters beyond ``common``
        dead = m + 2  # letters after which the last word read had left the band
        for t in range(q + 1, len(listed)):
            k = shared[t]
            if k >= dead:
                continue
            if k < common:
                common = k
                rows.clear()
            del rows[max(0, k - common) :]
            word = listed[t]
            left, middle, right = rows[-1] if rows else (1, 0, 1)
            dead = m + 2
            n = len(word)
            for i in range(common + len(rows), n):
                if i > m + 1:
                    dead = i
                    break
                c = word[i]
                # Letters beyond the sought word's end lie outside the matrix.
                low = min(middle + 1, left + (sought[i - 1] != c)) if 0 < i <= m else (middle + 1 if i <= m else 2)
                mid = min(right + 1, low + 1, middle + (sought[i] != c)) if i < m else 2
                right = min(mid + 1, right + (sought[i + 1] != c)) if i + 1 < m else 2
                left, middle = low, mid
                if left > 1 and middle > 1 and right > 1:
                    dead = i + 1
                    break
                rows.append((left, middle, right))
            else:
                far = left if n == m + 1 else middle if n == m else right if n == m - 1 else 2
                if far <= 1 and min(n, m) == size:
                    a, b = order[q], order[t]
                    if hi == size or words[a][:hi] != words[b][:hi]:
                        yield a, b


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best struct<n, word>) of the words that have a near word: how many, and
    the one of largest n, of smallest word where tied (n is negative there)."""

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found: dict[str, tuple[int, int, str]] = {}
            out = [[], [], [], []]
            for size, lo, hi, listed in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                found.clear()
                texts = [w["word"] for w in listed]
                for x, y in near_in(texts, size, lo, hi):
                    for one, other in ((x, y), (y, x)):
                        k, n, best = found.get(texts[one], (0, 1, ""))
                        own = (-listed[other]["n"], texts[other])
                        found[texts[one]] = (k + 1, *min((n, best), own))
                for word, (k, n, best) in found.items():
                    for column, value in zip(out, (word, k, n, best), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "k", "n", "best"])

    parts = [stored(g.mapInArrow(scan, "word string, k long, n long, best string"), "spelling-near") for g in groups(words)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct("n", F.col("best").alias("word"))).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links: where a chain of forms ends.

    A form occurs at least twice as often as its word, so chains are short; each round
    doubles how far a row sees.
    """
    seen = stored(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = seen.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = stored(seen.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        discard(seen)
        seen = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return seen
        seen = stored(seen, "spelling-roots")
        discard(moved)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of the corpus: word, form, root, n, n_near, form_n.

    Runs of letters are taken from whole texts; by a checksum of id and run, one in 97 has
    lost a letter, in every place of that document. Null and empty texts have no runs; a
    null id counts as an empty one; rows that repeat are counted again, with the same
    letters lost. A word's form is the near word that occurs most, the first in code-point
    order where several do, if it occurs at least twice as often; ``root`` follows forms to
    the end and is the word itself where there is none. An empty table, or one without
    words, gives no rows; other columns are not read. Words of any length are compared.
    """
    with small_batches(docs.sparkSession):
        words = stored(word_counts(docs, id_col, text_col), "spelling-words")
        near = near_words(words)
        best = F.when(-F.col("best.n") >= TIMES * F.col("n"), F.col("best"))
        found = stored(
            words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best["word"].alias("form"), (-best["n"]).alias("form_n")), "spelling-forms"
        )
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
