"""Token counts with a whole-token shortcut.

Before any text is read, the driver has each vocabulary string encoded by the library: those
that come back as one token are proven to cost one token as a pre-token, and the tasks get
the list. Texts are cut at white space. Pieces made only of characters that are proven to
normalise and split alike here and in the library are split by one pattern; a proven
pre-token counts 1, others are merged by the library once per worker and remembered. Other
pieces go to the library whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelforge.llm.words import sliced

#: Fixed value: how the vocabulary file splits a normalised text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Code points that are tried for the shortcut; beyond them the library takes the piece.
TRIED = 0x250

#: Merged pre-tokens that a worker remembers.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Proof:
    """What is proven of a vocabulary: strings that are one pre-token and one token, and
    characters that the library normalises and splits as ``Counter`` does."""

    proven: tuple[str, ...]
    alike: str


def prove(path: str) -> Proof:
    """The proof of a vocabulary file, as large as its strings at most."""
    if path.endswith(".model"):
        return Proof((), "")
    library, split = _library(path), regex.compile(PATTERN)
    ends = [t.removesuffix("</w>") for t in library.get_vocab(with_added_tokens=False) if t.endswith("</w>") and t.isascii()]
    ends = [t for t in ends if split.fullmatch(t)]
    one = [t for t, e in zip(ends, library.encode_batch(ends, add_special_tokens=False), strict=True) if len(e.ids) == 1]
    return Proof(tuple(one), "".join(_alike(library, split)) if library.normalizer and library.pre_tokenizer else "")


def _library(path: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def _alike(library, split) -> Iterator[str]:
    """A character is tried alone, and beside a letter, a digit, a sign and a space, because
    its class decides where a text splits."""
    normal, cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
    for c in map(chr, range(TRIED)):
        around = [f"a{c}a", f"0{c}0", f"%{c}%", f"'{c}", c]
        ours = [[len(x.encode()) for x in split.findall(t.lower())] for t in around]
        theirs = [[len(x) for x, _ in cut(normal(t))] for t in around]
        if ours == theirs and (c.isspace() or normal(c) == c.lower()) and len(c.lower()) == 1:
            yield c


class Counter:
    """Counts the tokens of texts as the library's ``encode`` without added tokens."""

    def __init__(self, path: str, proof: Proof):
        self.pieces = None
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self.merged = lambda text, encode=SentencePieceProcessor(model_file=path).encode: len(encode(text))
            return
        library = _library(path)
        self.merged = lambda text: len(library.encode(text, add_special_tokens=False).ids)
        if proof.alike:
            self.pieces = regex.compile(r"[^ \t\n\r]+")
            self.split = regex.compile(PATTERN)
            self.lengths = _Lengths(self.merged, proof.proven)
            odd = "[^%s]" % "".join(map(regex.escape, proof.alike))
            special = [regex.escape(t.content) for t in library.get_added_tokens_decoder().values()]
            self.odd = regex.compile("|".join([odd, *special]))

    def __call__(self, text: str) -> int:
        if self.pieces is None:
            return self.merged(text)
        if not self.odd.search(text):
            return self._short(text)
        # Nothing joins over white space, neither in the library nor here.
        return sum(self.merged(p) if self.odd.search(p) else self._short(p) for p in self.pieces.findall(text))

    def _short(self, text: str) -> int:
        return sum(map(self.lengths.__getitem__, self.split.findall(text.lower())))


class _Lengths(dict):
    def __init__(self, merged, proven: tuple[str, ...]):
        super().__init__(dict.fromkeys(proven, 1))
        self.merged, self.most = merged, len(proven) + REMEMBERED

    def __missing__(self, word: str) -> int:
        n = self.merged(word)
        if len(self) < self.most and len(word) <= 64:
            self[word] = n
        return n


#: One counter per vocabulary and worker process.
_counters: dict[str, Counter] = {}


def counter(path: str, proof: Proof) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path, proof)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    ``path`` names the vocabulary file, at the same place on the driver and every executor: a
    ``.json`` of tokenizers or a ``.model`` of sentencepiece, which has no shortcut. Special
    strings inside a text count as the library's default has it; begin and end tokens
    are not added; nothing is cut. Null texts are empty, and those have 0 tokens. The
    whole text counts, however long. Ids may be null or repeat; equal texts count alike; an
    empty table gives no rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(prove(path))
    kind = docs.schema[id_col].dataType

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = counter(path, held.value)
        for b in sliced(rows, 1):
            tokens = [n(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    found = rows.mapInArrow(count, f"id {kind.simpleString()}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
