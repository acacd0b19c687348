"""Repeated runs of lines: a suffix array over line ids by distributed prefix doubling.

Every text is a sequence of lines. Suffixes are ranked by their first 1, 2, 4, ... lines: a
rank at one depth is the place of its first lines among all that occur, and the rank at
twice the depth is the place of the pair (rank here, rank as many lines further). Places
grow along range partitions of the distinct pairs, so no task holds all of them. Suffixes
of one rank are neighbours in the suffix array whose longest common prefix is that depth
or more: an interval. What is alone in its interval shares no more lines with anything and
leaves, so each round works on what still repeats. The first suffix of an interval is the
first copy, others begin later copies; the union of later copies is deleted.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelforge.llm.sieve import sieve, sieved, told_apart
from funnelforge.session import discard, stored

#: What tells documents apart: rows that repeat an id have a number for each text.
DOC = ["id", "h"]


def _intervals(suffixes: DataFrame, *keys: str) -> DataFrame:
    """(id, h, line, rank, first): the suffixes that share ``keys`` with others, the place of
    the keys among all, and the interval's smallest (id, h, line).

    Keys are counted before the shuffle and written; the join back has one row per interval,
    so Spark can split one that a third of all suffixes are in.
    """
    groups = suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*DOC, "line")).alias("first")).where("n > 1").drop("n")
    groups = stored(groups, "line-groups")
    # Numbers that grow along ranges of keys: the range, then the place in it.
    placed = groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    ranks = stored(placed, "line-ranks")
    found = stored(suffixes.join(ranks, list(keys)).select(*DOC, "line", F.col("place").alias("rank"), "first"), "line-intervals")
    discard(groups)
    discard(ranks)
    return found


def _doubled(ranked: DataFrame, ahead: int) -> DataFrame:
    """(id, h, line, rank, after): each suffix's rank and that of the suffix ``ahead`` lines
    further; suffixes without one end or share no more lines there."""
    w = Window.partitionBy(*DOC).orderBy("line").rangeBetween(ahead, ahead)
    return ranked.withColumn("after", F.max("rank").over(w)).where(F.col("after").isNotNull()).select(*DOC, "line", "rank", "after")


#: A line is long that has more than so many words.
LONG = 50

_unspaced = r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def is_long(line: Column, words: int = LONG) -> Column:
    """Whether a line has more than ``words`` words: runs of what is not white space, or
    two letters each of scripts that put no spaces between words."""
    spaced = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != "")) > words
    dense = F.length(F.regexp_replace(line, _unspaced, "")) > 2 * words
    return (F.length(line) > 2 * words) & (spaced | dense)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_ids(docs: DataFrame, alone: int | None = None) -> DataFrame:
    """(id, h, line, row, name): the non-blank lines of ``docs`` (id, h, text), named by a
    128-bit digest; ``line`` counts non-blank lines from 0, ``row`` all lines. With ``alone``
    also ``long``: whether the line has more words than that. Equal rows have their lines once."""
    numbered = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("row"), x.alias("content")))
    solid = F.filter(numbered, lambda x: F.length(F.trim(x["content"])) > 0)
    rows = docs.where("id is not null and text is not null").select(*DOC, F.posexplode(solid).alias("line", "x"))
    long = [] if alone is None else [is_long(F.col("x.content"), alone).alias("long")]
    return rows.select(*DOC, "line", "x.row", F.unhex(F.md5(F.col("x.content").cast("binary"))).alias("name"), *long).distinct()


def later_copies(lines: DataFrame, least: int = 2) -> DataFrame:
    """(id, h, line, lines, first): for each line with which a later copy of a run of
    ``least`` lines or more begins, the deepest interval it is in that has an earlier
    suffix, of depth ``least`` * 2**k, and where that one begins. Where ``lines`` say which
    are ``long``, a later copy of one of these is a run by itself."""
    found = []
    later = lambda t, size: t.where(F.col("first") < F.struct(*DOC, "line")).select(*DOC, "line", F.lit(size).alias("lines"), "first")
    if "long" in lines.columns and least > 1:
        found.append(later(_intervals(lines.where("long").select(*DOC, "line", "name"), "name"), 1))
    depth, ranked = 1, _intervals(lines.select(*DOC, "line", "name"), "name")
    while True:
        if depth >= least:
            found.append(later(ranked, depth))
        if ranked.isEmpty():
            break
        ahead = depth if depth >= least else min(depth, least - depth)
        before, ranked = ranked, _intervals(_doubled(ranked, ahead), "rank", "after")
        depth += ahead
        if depth - ahead < least:
            discard(before)
    if not found:
        found.append(later(ranked, least))
    each = reduce(DataFrame.unionByName, found)
    longest = each.groupBy(*DOC, "line").agg(F.max(F.struct("lines", "first")).alias("m"))
    return longest.select(*DOC, "line", "m.lines", "m.first")


def repeated_runs(copies: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, h, row, last_row, lines, first_id): the maximal runs that later copies cover,
    as rows of the text from the run's first line to its last."""
    w = Window.partitionBy(*DOC).orderBy("line")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.max(F.col("line") + F.col("lines")).over(before) < F.col("line")).cast("int"), F.lit(1))
    runs = copies.withColumn("run", F.sum(new).over(w)).groupBy(*DOC, "run")
    runs = runs.agg(
        F.min("line").alias("line"),
        (F.max(F.col("line") + F.col("lines")) - F.min("line")).alias("lines"),
        F.min("first.id").alias("first_id"),
    )
    ends = runs.withColumn("line", F.explode(F.array("line", F.col("line") + F.col("lines") - 1)))
    return (
        ends.join(lines.select(*DOC, "line", "row"), [*DOC, "line"])
        .groupBy(*DOC, "run", "lines", "first_id")
        .agg(F.min("row").alias("row"), F.max("row").alias("last_row"))
        .drop("run")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, alone: int | None = None) -> DataFrame:
    """(row, runs, kept): each row of ``docs`` as a struct, the runs that are deleted from
    its text (array of row, last_row, lines, first_id; null if none) and the text left.

    Lines are compared by 128-bit digests of all their bytes. Blank lines are no part of a
    run's lines; those inside a deleted run go with it, others stay. A text without later
    copies stays as it is; one that only consists of them becomes empty. Null texts and null
    ids are left alone. Rows that repeat an id with another text are documents of their own,
    in the order of a hash; equal rows are one document, and all stay or are cut alike. With
    ``alone``, a line of more words than that is a run by itself, whatever ``least`` is. An
    empty table gives no rows; names of other columns do not matter; texts of any length count whole.
    """
    rows = told_apart(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    lines = stored(line_ids(rows.drop("row"), alone), "lines")
    runs = repeated_runs(later_copies(lines, least), lines)
    by_doc = stored(runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("row", "last_row", "lines", "first_id"))).alias("runs")), "line-cuts")
    # Texts that surely hold no later copy stay where they are.
    marked = sieved(rows, sieve(by_doc.select(*DOC)), F.col("id"), F.col("h"))
    found = marked.where("met").join(by_doc, DOC, "left")
    left = F.filter(
        lines_of(F.col("text")),
        lambda x, i: ~F.exists("runs", lambda r: (i >= r["row"]) & (i <= r["last_row"])),
    )
    kept = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    untouched = marked.where("not met").select("row", F.lit(None).cast(by_doc.schema["runs"].dataType).alias("runs"), F.col("text").alias("kept"))
    return found.select("row", "runs", kept.alias("kept")).unionByName(untouched)
