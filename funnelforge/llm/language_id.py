"""Language identification of mixed-language text.

Byte trigrams of words are counted per language over labelled texts. In a text, script
ranges first narrow the languages that a word may be in; the word's score in each is
the sum of its trigrams' log-probabilities; and the Viterbi path over the words, with a
penalty for each switch of language, labels spans. A text's language is the one with
most letters on the path, its score their share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelforge.llm.words import Words, batches, sliced, slices, small_batches

#: Trigram slots of the model; with 256 languages the model holds 32 MB.
SLOTS = 1 << 15

#: Languages that a model can hold.
MAX_LANGUAGES = 256

#: Labelled texts that a model is fitted on; a hash of the text chooses among more.
MAX_FIT = 20_000

#: Scripts by the first bytes of their letters in UTF-8 (script, lead
#: bytes from, to). Latin also has the ASCII letters.
SCRIPTS = (
    ("latin", 0xC3, 0xCA),
    ("greek", 0xCD, 0xCF),
    ("cyrillic", 0xD0, 0xD4),
    ("hebrew", 0xD6, 0xD7),
    ("arabic", 0xD8, 0xDB),
    ("indic", 0xE0, 0xE0),
    ("other", 0xE1, 0xE2),
    ("kana", 0xE3, 0xE3),
    ("han", 0xE4, 0xE9),
    ("hangul", 0xEA, 0xED),
    ("rare", 0xF0, 0xF4),
)

_script = np.zeros(256, np.int8)
for _k, (_, _from, _to) in enumerate(SCRIPTS, 1):
    _script[_from : _to + 1] = _k
_script[0x61:0x7B] = 1

_letters = np.zeros(256, bool)
_letters[0x61:0x7B] = _letters[0x80:] = True


def _prepared(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in texts]


def _slots(words: Words) -> np.ndarray:
    """The trigram slot that ends at each byte; delimiters count as word ends. What stands
    before a delimiter is no part of the trigram after it, so a word counts alike anywhere."""
    b = np.full(len(words.bytes) + 2, 0x20, np.uint32)
    b[2:] = np.where(_letters[words.bytes], words.bytes, 0x20)
    first = np.where(b[1:-1] == 0x20, np.uint32(0x20), b[:-2])
    code = (b[2:] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | first
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS.bit_length() + 1)).astype(np.int32)


def _letter_counts(words: Words) -> np.ndarray:
    """The letters of each word, whatever their bytes in UTF-8: characters but those
    of blocks of signs (from U+0080, U+2000, U+3000, U+FF00 and U+1F000 on)."""
    b = words.bytes
    after, third = np.append(b[1:], np.uint8(0)), np.append(b[2:], np.zeros(min(2, len(b)), np.uint8))
    sign = (b == 0xC2) | ((b == 0xE2) & (after <= 0xBA)) | ((b == 0xE3) & (after == 0x80)) | ((b == 0xEF) & (after == 0xBC) & (third < 0xA1)) | ((b == 0xF0) & (after == 0x9F))
    letter = _letters[b] & ((b & 0xC0) != 0x80) & ~sign
    total = np.concatenate([[0], np.cumsum(letter)])
    return total[words.end] - total[words.start]


def _word_scripts(words: Words) -> np.ndarray:
    """The highest script of each word's bytes; 0 has no letter of a known script."""
    if not len(words.start):
        return np.zeros(0, np.int8)
    bounds = np.stack([words.start, words.end], 1).ravel()
    return np.maximum.reduceat(_script[words.bytes], bounds)[::2]


class Model:
    """Log-probabilities of trigram slots, and the languages of each script."""

    def __init__(self, languages: list[str], logs: np.ndarray, allowed: np.ndarray, switch: float):
        self.languages, self.logs, self.allowed, self.switch = languages, logs, allowed, switch

    def label(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """For each text, (language, letters) of each word on its best path."""
        out: list = []
        for _, part in batches(_prepared(texts)):
            words = Words(part, _letters)
            if not len(words.start) or not self.languages:
                out += [(np.zeros(0, np.int8), np.zeros(0, np.int64))] * len(part)
                continue
            scores = self._scores(words)
            path = self._paths(scores, words.first)
            sizes = _letter_counts(words)
            out += [(path[a:b], sizes[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        return out

    def _scores(self, words: Words) -> np.ndarray:
        slots = _slots(words)
        out = np.empty((len(words.start), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            sums = np.cumsum(self.logs[k][slots], dtype=np.float64)
            # The delimiter after a word ends its last trigram; its first begins at its first byte.
            before = np.where(words.start > 0, sums[words.start - 1], 0.0)
            out[:, k] = sums[np.minimum(words.end, len(sums) - 1)] - before
        out[~self.allowed[_word_scripts(words)]] -= 1e4
        return out

    def _paths(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi over all texts at once, longest first, so that each step is one array."""
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = first[:-1][order], sizes[order]
        path = np.zeros(len(scores), np.int8 if len(self.languages) < 128 else np.int16)
        came = np.zeros(scores.shape, path.dtype)
        steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(steps), "left")
        n = active[0] if steps else 0
        best = scores[begin[:n]].astype(np.float64)
        here = np.arange(len(self.languages))
        for t in range(1, steps):
            n = active[t]
            top = best[:n].argmax(1)
            moved = best[np.arange(n), top] - self.switch
            stay = best[:n] >= moved[:, None]
            at = begin[:n] + t
            came[at] = np.where(stay, here, top[:, None])
            best[:n] = np.where(stay, best[:n], moved[:, None]) + scores[at]
        state = best.argmax(1) if steps else None
        for t in range(steps - 1, -1, -1):
            n = active[t]
            at = begin[:n] + t
            path[at] = state[:n]
            if t:
                state[:n] = came[at, state[:n]]
        return path


def fit(labelled: DataFrame, switch: float = 20.0, max_fit: int = MAX_FIT) -> Model:
    """A model of ``labelled`` (text, lang), both not null.

    If there are more than ``max_fit`` texts, those with the smallest hashes are taken,
    about ``max_fit`` of them. Only counts per slot and language reach the driver.
    """
    n = labelled.count()
    rows = labelled
    if n > max_fit:
        span = int((1 << 31) * max_fit / n)
        rows = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 31)) < span)
    parts = max(1, min(16, -(-n // 500)))

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in sliced(frames, 0):
            texts = pd.DataFrame({"t": b.column(0).to_pylist(), "lang": b.column(1).to_pylist()})
            for lang, own in texts.groupby("lang")["t"]:
                for _, part in batches(_prepared(own.tolist())):
                    words = Words(part, _letters)
                    slots = _slots(words)
                    inside = np.zeros(len(slots), bool)
                    inside[np.flatnonzero(_letters[words.bytes])] = True
                    inside[1:] |= inside[:-1]
                    counts[lang] = counts.get(lang, 0) + np.bincount(slots[inside], minlength=SLOTS)
                    scripts[lang] = scripts.get(lang, 0) + np.bincount(_word_scripts(words), minlength=len(SCRIPTS) + 1)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            s = np.flatnonzero(scripts[lang])
            slots = np.concatenate([at, SLOTS + s])
            yield pa.record_batch(
                [pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(np.concatenate([c[at], scripts[lang][s]]), pa.int64())],
                ["lang", "slot", "n"],
            )

    counted = (
        rows.select("text", "lang").repartition(parts).mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    )
    with small_batches(labelled.sparkSession):
        found = counted.toPandas()
    languages = sorted(found["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a model holds {MAX_LANGUAGES}")
    counts = np.zeros((len(languages), SLOTS + len(SCRIPTS) + 1))
    counts[found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), found["slot"].to_numpy(int)] = found["n"]
    grams, scripts = counts[:, :SLOTS] + 0.1, counts[:, SLOTS:]
    logs = np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32)
    # A language is a candidate in a script that holds a thousandth of its words.
    allowed = (scripts > 1e-3 * np.maximum(scripts.sum(1, keepdims=True), 1)).T
    allowed[~allowed.any(1)] = True
    allowed[0] = True
    return Model(languages, logs, allowed, switch)


def _label(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, shares = [], []
    for text, (path, sizes) in zip(texts, model.label(texts), strict=True):
        if len(path) and not sizes.any():  # letters among signs, as the ordinal ones: a word each
            sizes = np.ones(len(path), np.int64)
        total = int(sizes.sum())
        if not model.languages or not total or not any(map(str.isalpha, text)):
            names.append("und")
            shares.append(0.0)
            continue
        letters = np.bincount(path, sizes, len(model.languages))
        names.append(model.languages[int(letters.argmax())])
        shares.append(float(letters.max() / total))
    return names, shares


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score, in the place of columns of these names; see
    ``language`` for the cases. Only texts go to Python, some bytes at a time."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def label(texts: pa.Array) -> pa.Array:
        names: list[str] = []
        shares: list[float] = []
        for part in slices(texts):
            own_names, own_shares = _label(held.value, texts[part].to_pylist())
            names += own_names
            shares += own_shares
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["lang_pred", "lang_score"])

    # Once a row, wherever its two results are used.
    labelled = F.arrow_udf(label, "struct<lang_pred string, lang_score double>").asNondeterministic()
    out = docs.select(F.struct("*").alias("row"), labelled(F.col(text_col)).alias("found"))
    clash = {"lang_pred", "lang_score"}
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in clash), "found.lang_pred", "found.lang_score")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, words, letters, lang): the spans of one language in each text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(frames, 1):
            rows: list[tuple] = []
            for i, (path, sizes) in enumerate(held.value.label(b.column(1).to_pylist())):
                if not len(path):
                    continue
                edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                rows += [(i, a, z - a, int(sizes[a:z].sum()), held.value.languages[int(path[a])]) for a, z in zip(edges[:-1], edges[1:], strict=True)]
            at, first, n, letters, lang = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.record_batch(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(letters, pa.int64()), pa.array(lang, pa.string())],
                ["id", "first_word", "words", "letters", "lang"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(cut, f"id {kind}, first_word int, words int, letters long, lang string").withColumnRenamed("id", id_col)


def held_out(id_col: str | Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id's text, modulo ``folds``, is ``fold``; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    The model is learned from texts and labels of rows that are not held out. ``und``
    with score 0 is for null texts, texts without a letter, and all texts if there is
    nothing to learn from. Equal rows get equal results; of languages with equally many
    letters the first by code point counts. A text of any length is labelled whole. Ids
    may be null or repeat; an empty table gives no rows; other columns are not read.
    """
    fitted = fit(
        docs.where(~held_out(id_col)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    )
    narrow = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    found = identify(narrow, fitted)
    return found.select(F.col("id").alias(id_col), "held_out", "lang_pred", F.col("lang_score").alias("score"))
