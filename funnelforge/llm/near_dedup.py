"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's 64 MinHash coordinates are tokens (coordinate, value). A pair of documents
whose shingle sets are 85 % alike agrees in 54 of 64 on average; pairs that agree in
fewer than 42 are not looked at (three in 100,000 pairs at the limit); other limits have
other numbers (``matches``). Tokens that only one document has agree with nothing and
leave first; a document with m shared tokens is posted under its m - 41 rarest ones only
(the prefix), which any partner must meet.

Documents with equal sets are one class. Of each posting list, every member is joined
with the smallest; what is confirmed on full sets merges into components. In lists that
then still hold several components, the members outside the largest one are compared with
all others in bounded units: first by size and signature, then, for the members that are
left, on full sets. Pairs already connected are skipped and only spanning links leave a
unit, so a large group of copies never becomes all its pairs, and no link is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelforge.llm.graph import components
from funnelforge.llm.sieve import sieve, sieved
from funnelforge.llm.words import SPACED, Words, as_bytes, batches, mix, ranges, rolled, sliced, small_batches
from funnelforge.session import stored

#: Coordinates of a signature, and the share of pairs at the limit that may be missed.
COORDINATES, MISSED = 64, 3e-5

#: Members outside a posting list's largest component that one unit compares with twice as
#: many members of the list; bytes of sets on either side; rows of a group of small units.
BLOCK, BLOCK_BYTES, PACK = 256, 32 << 20, 2048

#: Pairs whose signatures are compared at once.
AT_ONCE = 1 << 15

_a = (mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1))[:, None]


def matches(percent: int) -> int:
    """Coordinates that a pair must agree in: as many as fewer than MISSED of the pairs
    that are just ``percent`` % alike fall short of (42 at 85 %, 37 at 80 %); 1 at least."""
    p, short = percent / 100, 0.0
    for least in range(COORDINATES):
        short += math.comb(COORDINATES, least) * p**least * (1 - p) ** (COORDINATES - least)
        if short > MISSED:
            return max(1, least)
    return COORDINATES


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def shingle_sets(texts: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; texts without words have none.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A text
    of fewer than ``size`` words has one shingle of all of them.
    """
    for _, part in batches(texts):
        words = Words([t.lower() for t in part], SPACED)
        prefix = rolled(words.hashes())
        first, n = words.first[:-1], np.diff(words.first)
        at = np.arange(max(0, len(words.start) - size + 1))
        whole = ranges(prefix, at, at + size)
        for a, k in zip(first.tolist(), n.tolist(), strict=True):
            if k >= size:
                yield np.unique(whole[a : a + k - size + 1])
            elif k:
                yield ranges(prefix, np.array([a]), np.array([a + k]))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of COORDINATES hash functions, 32 bits each."""
    out = np.full((COORDINATES, 1), 0xFFFFFFFF, np.uint64)
    for k in range(0, len(shingles), 4096):
        x = shingles[k : k + 4096]
        y = (_a * x) >> np.uint64(32)
        np.minimum(out, y.min(1, keepdims=True), out=out)
    return out[:, 0].astype(np.uint32)


def summaries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, sig): set size, digest of the set and signature of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(rows, 1):
            n, digests, sigs = [], [], []
            for s in shingle_sets(as_bytes(b.column(1))):
                n.append(len(s))
                digests.append(_digest(s))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch(
                [b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["id", "n", "digest", "sig"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(measure, f"id {kind}, n long, digest binary, sig binary")


def postings(classes: DataFrame, least: int) -> DataFrame:
    """(token, rep): the prefix of each class's shared tokens, rarest first, for partners
    that share ``least`` or more."""

    def spread(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
        for b in rows:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                if part.num_rows:
                    sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
                    tokens = (sigs.astype(np.uint64) | high).ravel().view(np.int64)
                    reps = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), COORDINATES)))
                    yield pa.record_batch([pa.array(tokens), reps], ["token", "rep"])

    tokens = classes.select("rep", "sig").mapInArrow(spread, "token long, rep binary")
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = tokens.join(counted, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("own"))
    ranked = shared.where(F.size("own") >= least)
    prefix = F.slice("own", F.lit(1), F.size("own") - (least - 1))
    return ranked.select("rep", F.explode(prefix).alias("x")).select("x.token", "rep")


def agreements(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left == right).sum(-1)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection size >= percent * union size."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes allow the likeness and whose signatures agree enough."""
    least = matches(percent)
    one = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    met = pairs.join(one, "a").join(two, "b")
    met = met.where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)).select("a", "b", "sig_a", "sig_b")

    def check(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            if b.num_rows:
                left, right = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, COORDINATES) for k in (2, 3))
                keep = pa.array(agreements(left, right) >= least)
                yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return met.mapInArrow(check, "a binary, b binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("s_b"))

    def check(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            keep = [
                alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(b.column(2), b.column(3), strict=True)
            ]
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "s_a", "s_b").mapInArrow(check, "a binary, b binary")


def _sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, shingles) of ``classes`` (rep, doc), cut anew from the texts that stand for them."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    # Only texts that may be wanted meet the list of those that are.
    maybe = sieved(rows, sieve(classes.select("doc")), F.col("id")).where("met").select("id", "t")
    wanted = maybe.join(classes.select(F.col("doc").alias("id")), "id", "left_semi")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(rows, 1):
            found = list(shingle_sets(as_bytes(part.column(1))))
            digests = pa.array([_digest(s) for s in found], pa.binary())
            yield pa.record_batch([part.column(0), digests, pa.array([s.tobytes() for s in found], pa.binary())], ["doc", "rep", "shingles"])

    found = wanted.mapInArrow(cut, f"doc {kind}, rep binary, shingles binary")
    # Rows that repeat an id may have other texts, and equal rows come once.
    return found.join(classes.select("doc", "rep"), ["doc", "rep"], "left_semi").drop("doc").dropDuplicates(["rep"])


def _units(posted: DataFrame, comps: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Members of the posting lists that hold several components, dealt to units (token, o, i).

    ``outside`` members of unit (token, o, i), which are not in the list's largest
    component, meet its ``inside`` members. A list of m members of which k are outside the
    largest component has m * (k / block) + k * (m / block) rows or so: with few outsiders
    as many as it has members. ``pack`` puts the units of small lists together.
    """
    sizes = classes.select("rep", "n")
    labelled = posted.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).join(sizes, "rep")
    labelled = stored(labelled, "near-labelled")
    per = labelled.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"), (F.sum("n") * 8).alias("bytes"))
    whole = per.groupBy("token").agg(F.max(F.struct("k", "comp", "bytes")).alias("top"), F.sum("k").alias("m"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("comps"))
    parts = lambda k, rows, size: F.greatest(F.ceil(k / rows), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    lists = whole.where("comps > 1").select(
        "token", F.col("top.comp").alias("main"), "m", "bytes",
        parts(F.col("m") - F.col("top.k"), block, F.col("bytes") - F.col("top.bytes")).alias("n_out"), parts(F.col("m"), 2 * block, F.col("bytes")).alias("n_in"),
    )
    lists = stored(lists, "near-lists")
    total = lists.agg(F.sum("m").alias("m"), F.sum("bytes").alias("b")).first()
    packs = max(1, (total["m"] or 0) // PACK, (total["b"] or 0) // BLOCK_BYTES)
    h, outer = F.xxhash64("rep"), F.col("comp") != F.col("main")
    own_out, own_in = F.pmod(h, F.col("n_out")).cast("int"), F.pmod(h, F.col("n_in")).cast("int")
    unit = lambda o, i, outside, inside: F.struct(o.alias("o"), i.alias("i"), outside.alias("outside"), inside.alias("inside"))
    till = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_outer = F.when(outer, F.transform(till("n_in"), lambda i: unit(own_out, i, F.lit(True), i == own_in)))
    as_inner = F.transform(F.filter(till("n_out"), lambda o: ~outer | (o != own_out)), lambda o: unit(o, own_in, F.lit(False), F.lit(True)))
    none = F.array().cast("array<struct<o:int,i:int,outside:boolean,inside:boolean>>")
    placed = labelled.join(lists.drop("m", "bytes"), "token").withColumn("u", F.explode(F.concat(F.coalesce(as_outer, none), as_inner)))
    small = (F.col("n_out") == 1) & (F.col("n_in") == 1)
    pack = F.when(small, F.pmod(F.xxhash64("token"), F.lit(packs))).otherwise(F.xxhash64("token", "u.o", "u.i"))
    return placed.select(pack.alias("pack"), "token", "u.o", "u.i", "u.outside", "u.inside", outer.alias("outer"), "rep", "comp", "n")


def _met(t: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (outside row, inside row, agreements) of the units in ``t``, whose columns are
    those of ``_units`` with sig and prefix: of other components, whose sizes and signatures
    allow the likeness, and whose first common list is the unit's. Some pairs at a time."""
    least = matches(percent)
    number = lambda c: t.column(c).to_numpy()
    token, o, i = number("token"), number("o"), number("i")
    order = np.lexsort((i, o, token))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(token[order]) != 0) | (np.diff(o[order]) != 0) | (np.diff(i[order]) != 0)
    unit = np.cumsum(new) - 1
    outside, inside = number("outside")[order], number("inside")[order]
    left, left_unit = order[outside], unit[outside]
    right = order[inside]
    n_right = np.bincount(unit[inside], minlength=unit[-1] + 1)
    begin = np.cumsum(n_right) - n_right
    sizes, outer = number("n"), number("outer")
    names = np.array(t.column("rep").to_pylist(), object)
    comp = t.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
    sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
    prefix = number("prefix").view(np.uint64)
    counts = n_right[left_unit]
    edges = np.cumsum(counts)
    at = 0
    while at < len(left):
        done = edges[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(edges, done + AT_ONCE, "right")))
        k = counts[at:end]
        a = np.repeat(left[at:end], k)
        step = np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
        b = right[np.repeat(begin[left_unit[at:end]], k) + step]
        fit = (comp[a] != comp[b]) & (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b]))
        a, b = a[fit], b[fit]
        # Of two outsiders, the one with the smaller name is the outside member.
        fit = ~outer[b] | (names[a] < names[b]).astype(bool)
        a, b = a[fit], b[fit]
        same = sigs[a] == sigs[b]
        agree = same.sum(1)
        shared = np.packbits(same, 1, "little").view(np.uint64)[:, 0] if len(a) else np.zeros(0, np.uint64)
        # Tokens begin with their coordinate: the lowest that both have posted is theirs.
        shared &= prefix[a] & prefix[b]
        first = (shared & (~shared + np.uint64(1))) == np.uint64(1) << (token[a] >> 32).astype(np.uint64)
        fit = (agree >= least) & first
        if fit.any():
            yield a[fit], b[fit], agree[fit]
        at = end


def _left_over(percent: int):
    """The members of units that have a pair to confirm."""

    def keep(t: pa.Table) -> pa.Table:
        wanted = np.zeros(t.num_rows, bool)
        for a, b, _ in _met(t, percent):
            wanted[a] = wanted[b] = True
        return t.filter(pa.array(wanted))

    return keep


def _spanning(percent: int):
    """Links between the components of units, confirmed on full sets."""

    def link(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        comps = t.column("comp").to_pylist()
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        links = []
        for a, b, agree in _met(t, percent):
            for k in np.argsort(-agree, kind="stable").tolist():
                x, y = root(comps[a[k]]), root(comps[b[k]])
                if x != y and alike(sets[a[k]], sets[b[k]], percent):
                    parent[y] = x
                    links.append((comps[a[k]], comps[b[k]]))
        return pa.table([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], ["a", "b"])

    return link


_UNIT = "pack long, token long, o int, i int, outside boolean, inside boolean, outer boolean, rep binary, comp binary, n long, sig binary, prefix long"


def _rest_links(docs: DataFrame, posted: DataFrame, comps: DataFrame, classes: DataFrame, percent: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links between components inside posting lists that hold several."""
    coordinate = F.shiftright("token", 32).cast("int")
    prefixes = posted.groupBy("rep").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), coordinate)).alias("prefix"))
    units = _units(posted, comps, classes, block).join(classes.select("rep", "sig"), "rep").join(prefixes, "rep")
    names = [x.split()[0] for x in _UNIT.split(", ")]
    units = stored(units.select(*names).groupBy("pack").applyInArrow(_left_over(percent), _UNIT), "near-units")
    wanted = units.select("rep").distinct()
    sets = stored(_sets(docs, classes.select("rep", "doc").join(wanted, "rep", "left_semi"), id_col, text_col), "near-sets")
    return units.join(sets, "rep").groupBy("pack").applyInArrow(_spanning(percent), "a binary, b binary")


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows' summaries, the classes of equal sets, their components by the links to the
    smallest members of lists, and the components that further links make of these."""
    rows = stored(summaries(docs, id_col, text_col), "near-rows")
    classes = stored(
        rows.where("digest is not null and id is not null")
        .groupBy(F.col("digest").alias("rep"))
        .agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig")),
        "near-classes",
    )
    posted = stored(postings(classes, matches(percent)), "near-postings")
    smallest = posted.groupBy("token").agg(F.min("rep").alias("a"))
    pairs = posted.join(smallest, "token").where(F.col("a") < F.col("rep")).select("a", F.col("rep").alias("b")).distinct()
    pairs = stored(_agreeing(pairs, classes, percent), "near-pairs")
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    sets = stored(_sets(docs, classes.select("rep", "doc").join(wanted, "rep", "left_semi"), id_col, text_col), "near-sets")
    comps = components(stored(_confirmed(pairs, sets, percent), "near-links"))
    rest = components(stored(_rest_links(docs, posted, comps, classes, percent, block, id_col, text_col), "near-rest"))
    return rows, classes, comps, rest


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    5-word shingles; a component is what links connect, named by its smallest id. Null and
    blank texts have no shingles and are linked with nothing. Rows that repeat an id are
    documents of their own with the same name: all are kept or none. Rows without an id
    are components of their own, kept. An empty table gives no rows. Texts of any length
    count whole; other columns are not read, so their names do not matter.
    """
    with small_batches(docs.sparkSession):
        rows, classes, comps, rest = _linked(docs, id_col, text_col, percent, block)
    placed = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("doc", "rep", F.coalesce("comp", "rep").alias("near"))
    placed = placed.join(rest.withColumnRenamed("node", "near"), "near", "left").select("rep", "doc", F.coalesce("comp", "near").alias("comp"))
    names = placed.groupBy("comp").agg(F.min("doc").alias("name"))
    named = placed.join(names, "comp").select(F.col("rep").alias("digest"), "name")
    found = rows.join(named, "digest", "left")
    comp = F.coalesce(F.when(F.col("id").isNotNull(), F.col("name")), F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), comp.eqNullSafe(F.col("id")).alias("kept"))
