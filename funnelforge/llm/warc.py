"""WARC archives: writing them, and reading them back in splits.

A file may be cut anywhere between tasks. Each occurrence of the record magic is a
candidate record; its headers name the offset of its successor. Pointer jumping from
offset 0 of each file keeps the candidates on the chain, so that magic inside a payload
is never taken for a record. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelforge.llm.sieve import sieve, sieved
from funnelforge.session import discard, scratch_path, stored

MAGIC = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + BLANK


def base32_sha1(data: Column) -> Column:
    """The SHA-1 digest in upper-case base32: five hex digits are four characters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _clean(text: Column) -> Column:
    """A header's value on one line."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1F\x7F]", " ")


def _named(id: Column) -> Column:
    """An id as a URN's last part: escaped, so that any text can be read back."""
    return F.url_encode(id.cast("string"))


def _response(id: Column, url: Column, digest: Column, body: Column) -> Column:
    block = F.concat(F.lit(_HTTP), body)
    return F.concat(_head("response", id, url, digest, F.lit("")), _sizes(F.octet_length(body), F.octet_length(block)), block)


def _revisit(id: Column, url: Column, digest: Column, size: Column, refers_to: Column) -> Column:
    profile = F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), _named(refers_to), F.lit(">"))
    return F.concat(_head("revisit", id, url, digest, profile), _sizes(size, F.lit(len(_HTTP))), F.lit(_HTTP))


def _head(kind: str, id: Column, url: Column, digest: Column, more: Column) -> Column:
    return F.concat(
        F.lit(f"{MAGIC}WARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(_named(id), F.lit("")),
        F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest, more,
    )


def _sizes(payload: Column, block: Column) -> Column:
    return F.concat(F.lit("\r\nPayload-Length: "), payload.cast("string"), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(BLANK))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, per_file: int = 2000) -> None:
    """Writes one record per row of ``pages`` to WARC files of at most ``per_file`` records.

    Of equal payloads of at least ``least`` bytes the one with the smallest id is the
    response and others revisit it; smaller ones, and pages without id, are responses of
    their own. Null payloads are empty. Rows that repeat an id and payload are equal
    records. The page's id and the payload's length are extension headers. Only pages
    whose payload may occur twice are shuffled, one of each payload and task; all others go
    from the scan to the archive, however long. Other columns are not read.
    """
    body = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), _clean(F.col(url_col)).alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("body").cast("binary")), "size": F.octet_length("body")})
    narrow = stored(rows.drop("body"), "warc-digests")
    named = F.col("id").isNotNull() & (F.col("size") >= least)
    same = narrow.where(named).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = stored(same, "warc-repeated")
    held = sieve(same.select("digest", "size"))
    key = (F.col("digest"), F.col("size"))
    whole = sieved(rows, held, *key)
    alone = whole.where(~(F.col("met") & named)).select(_response(F.col("id"), F.col("url"), *(F.col(c) for c in ("digest", "body"))).alias("value"))
    bodies = whole.where(F.col("met") & named).groupBy("digest", "size").agg(F.any_value("body").alias("body"))
    kinds = sieved(narrow.where(named), held, *key).where("met").drop("met").join(same, ["digest", "size"], "left")
    kinds = stored(kinds.withColumn("refers_to", F.when(F.col("first") < F.col("id"), F.col("first"))).drop("first"), "warc-kinds")
    first = kinds.where("refers_to is null").join(bodies, ["digest", "size"])
    first = first.select(_response(F.col("id"), F.col("url"), F.col("digest"), F.col("body")).alias("value"))
    again = kinds.where("refers_to is not null").select(_revisit(*(F.col(c) for c in ("id", "url", "digest", "size", "refers_to"))).alias("value"))
    # The text writer ends each row with the two line ends that end a WARC record.
    records = alone.unionByName(first).unionByName(again)
    records.write.option("lineSep", BLANK).option("maxRecordsPerFile", per_file).text(path)


def _magic(version: str) -> str:
    return MAGIC.replace("1.0", version)


def _scan(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(file, file_size, block, text, mark): what follows each magic up to the next, and a
    digest of it."""
    return spark.read.option("lineSep", _magic(version)).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value").alias("text"),
        F.unhex(F.md5(F.col("value").cast("binary"))).alias("mark"),
    )


def candidates(spark: SparkSession, path: str, fields: dict[str, Callable[[Column], Column]], version: str = "1.0") -> DataFrame:
    """(file, file_size, block, row, step, mark, head, length, whole) and ``fields`` of each
    candidate. head and length are null without readable headers; ``whole`` tells
    whether the text holds as many bytes as its headers name; else fields are of null.
    """
    text = F.col("text")
    end = F.instr(text, BLANK)
    rows = _scan(spark, path, version).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("head", F.when(end > 0, F.substring(text, F.lit(1), end - 1)))
    rows = rows.withColumn("length", _header(F.col("head"), "Content-Length").try_cast("bigint"))
    size = F.octet_length(text).cast("long")
    whole = F.coalesce(F.octet_length("head") + len(BLANK) + F.col("length") <= size, F.lit(False))
    # All but the last row of a file are followed by the magic.
    rows = rows.withColumns({"step": size + len(MAGIC), "whole": whole})
    # A column of its own: what fields share is computed once only outside of a condition.
    rows = rows.withColumn("payload", F.when(F.col("whole"), _payload(text, F.col("head"), F.col("length"))))
    own = [f(F.col("payload")).alias(f"_f_{k}") for k, f in fields.items()]
    return rows.select("file", "file_size", "block", "row", "step", "mark", "head", "length", "whole", *own)


def placed(found: DataFrame) -> DataFrame:
    """(file, file_size, block, row, at, next, whole): each candidate's offset and its
    successor's.

    Rows of one split come in file order; a split's first row begins where the splits
    before it end, so a window inside each split and one over the splits of a file give
    every row its offset.
    """
    next_by = len(MAGIC) + F.octet_length("head") + 2 * len(BLANK) + F.col("length")
    narrow = found.select("file", "file_size", "block", "row", "step", "whole", next_by.alias("next_by"))
    w = Window.partitionBy("file", "block").orderBy("row")
    within = narrow.withColumn("before", F.sum("step").over(w) - F.col("step"))
    blocks = narrow.groupBy("file", "block").agg(F.sum("step").alias("bytes"))
    b = Window.partitionBy("file").orderBy("block")
    begins = blocks.withColumn("begin", F.sum("bytes").over(b) - F.col("bytes")).drop("bytes")
    at = F.col("begin") + F.col("before") - len(MAGIC)
    met = within.join(begins, ["file", "block"]).where(at >= 0)  # what precedes a file's first magic is no record
    return met.select("file", "file_size", "block", "row", at.alias("at"), (at + F.col("next_by")).alias("next"), "whole")


def in_segments(links: DataFrame) -> DataFrame:
    """``links`` with ``segment``: the offset at which a run of candidates of one split
    begins, each followed by its successor, and which no link enters but at its begin. If a
    segment's begin is on the chain, all of it is."""
    w = Window.partitionBy("file", "block").orderBy("at")
    near = links.withColumns({"_before": F.lag("next").over(w), "_after": F.lead("at").over(w)})
    far = near.where("next is not null and (_after is null or next <> _after)").select("file", F.col("next").alias("at"), F.lit(True).alias("_entered")).distinct()
    begins = F.col("_before").isNull() | (F.col("_before") != F.col("at")) | F.col("_entered").isNotNull()
    met = near.join(far, ["file", "at"], "left")
    return met.withColumn("segment", F.last(F.when(begins, F.col("at")), True).over(w)).drop("_before", "_after", "_entered")


def _header(text: Column, name: str) -> Column:
    """A header's value by its name in any case; null without it."""
    return F.nullif(F.regexp_extract(text, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _record_of(text: Column, name: str) -> Column:
    """The record that a header names: the id of a page, or any other URI as it stands."""
    uri = F.regexp_replace(_header(text, name), r"^<|>\s*$", "")
    return F.nullif(F.when(uri.startswith("urn:page:"), F.url_decode(F.substring(uri, len("urn:page:") + 1, F.octet_length(uri)))).otherwise(uri), F.lit(""))


def _payload(text: Column, head: Column, length: Column) -> Column:
    """What follows the HTTP headers in the record's block; other records' whole block."""
    block = F.substring(text.cast("binary"), F.octet_length(head) + len(BLANK) + 1, length.cast("int")).cast("string")
    http = F.lower(_header(head, "Content-Type")).startswith("application/http")
    return F.when(F.coalesce(http, F.lit(False)), F.substring(block, F.instr(block, BLANK) + len(BLANK), F.length(block))).otherwise(block)


def read_warc(spark: SparkSession, path: str, fields: dict[str, Callable[[Column], Column]] | None = None, version: str = "1.0") -> DataFrame:
    """One row per record: file, at, type, record_id, url, digest, refers_to, payload_size,
    and ``fields`` of its payload (by default ``payload`` itself).

    Any archive of WARC records of one ``version`` is read, if it is not compressed: header
    names are of any case, records of any type. record_id and refers_to are page ids where
    ``write_warc`` has written them, else URIs; payload_size is null where no header has it.

    Fields are computed where the text is read, so that no text is stored or shuffled that no
    field returns; only the pieces of records that the magic cuts are read once more and put
    together. Raises if a file's chain ends before the file does.
    """
    fields = fields or {"payload": lambda p: p}
    own = [f"_f_{k}" for k in fields]
    found = stored(candidates(spark, path, fields, version), "warc-candidates", "zstd")
    links = stored(in_segments(placed(found)), "warc-links")
    segments = links.groupBy("file", "file_size", "segment").agg(F.max_by("next", "at").alias("next"))
    reached = on_chain(stored(segments.withColumnRenamed("segment", "at"), "warc-segments")).select("file", F.col("at").alias("segment"), F.lit(True).alias("starts"))
    # A payload that holds the magic was cut there: its pieces belong to the record before.
    w = Window.partitionBy("file").orderBy("at")
    owned = links.join(reached, ["file", "segment"], "left").withColumn("owner", F.max(F.when(F.col("starts"), F.col("at"))).over(w))
    owned = stored(owned.select("file", "at", "row", "whole", "owner"), "warc-owned")
    whole = owned.where("at = owner and whole").select("at", "row").join(found.select("row", "file", "head", *own).hint("merge"), "row")
    cut = owned.where("at <> owner or not whole").select("at", "owner", "row").join(found.select("row", "file", "mark", "head", "length"), "row").drop("row")
    cut = stored(cut, "warc-cut")
    records = whole.select("file", "at", "head", *own)
    if not cut.isEmpty():
        records = records.unionByName(_put_together(spark, path, cut, fields, version))
    records = records.withColumnsRenamed({f"_f_{k}": k for k in fields})
    return records.select(
        "file",
        "at",
        _header(F.col("head"), "WARC-Type").alias("type"),
        _record_of(F.col("head"), "WARC-Record-ID").alias("record_id"),
        _header(F.col("head"), "WARC-Target-URI").alias("url"),
        F.regexp_replace(F.coalesce(_header(F.col("head"), "WARC-Payload-Digest"), F.lit("")), "^sha1:", "").alias("digest"),
        _record_of(F.col("head"), "WARC-Refers-To").alias("refers_to"),
        _header(F.col("head"), "Payload-Length").try_cast("long").alias("payload_size"),
        *fields,
    )


def _put_together(spark: SparkSession, path: str, cut: DataFrame, fields: dict[str, Callable[[Column], Column]], version: str) -> DataFrame:
    """(file, at, head, fields) of records of several pieces. Their texts are found again by
    digest: pieces of one digest are alike, so it doesn't matter where they stand."""
    wanted = cut.select("file", "mark").distinct()
    again = sieved(_scan(spark, path, version).select("file", "mark", "text"), sieve(wanted), F.col("file"), F.col("mark")).where("met").drop("met")
    texts = again.join(wanted, ["file", "mark"], "left_semi").groupBy("file", "mark").agg(F.any_value("text").alias("text"))
    pieces = cut.join(texts, ["file", "mark"]).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "text", "head", "length"))).alias("p"))
    joined = pieces.select(
        "file", F.col("owner").alias("at"), F.col("p")[0]["head"].alias("head"), F.col("p")[0]["length"].alias("length"),
        F.array_join(F.transform("p", lambda p: p["text"]), _magic(version)).alias("text"),
    )
    return joined.select("file", "at", "head", *(f(_payload(F.col("text"), F.col("head"), F.col("length"))).alias(f"_f_{k}") for k, f in fields.items()))


def on_chain(links: DataFrame) -> DataFrame:
    """(file, at) of the records that the chain from offset 0 of each file reaches.

    ``links``: (file, at, file_size, next), a stored table. With jumps of 1, 2, 4, ... records, each round
    doubles both the reach and the jump, so a file of n records takes log2(n) rounds.
    """
    jump = links.select("file", "at", F.col("next").alias("to"))
    known = links.select("file", "at")
    reached = stored(links.where("at = 0").select("file", "at"), "warc-reached")
    n = reached.count()
    while True:
        # Sorted and merged at every size, so that the plan of a small table is that of a large one.
        onward = reached.join(jump.hint("merge"), ["file", "at"]).select("file", F.col("to").alias("at"))
        onward = onward.join(known.hint("merge"), ["file", "at"], "left_semi")
        before, reached = reached, stored(reached.union(onward).distinct(), "warc-reached")
        discard(before)
        now = reached.count()
        if now == n:
            break
        n = now
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        before, jump = jump, stored(jump.join(far.hint("merge"), ["file", "to"]).select("file", "at", F.col("far").alias("to")), "warc-jump")
        discard(before)
    broken = (
        reached.join(links, ["file", "at"]).groupBy("file").agg(F.max(F.struct("at", "next", "file_size")).alias("last")).where("last.next is null or last.next <> last.file_size")
    )
    bad = broken.take(1)
    if bad:
        raise ValueError(f"the records of {bad[0]['file']} end at {bad[0]['last']['next']} of {bad[0]['last']['file_size']} bytes")
    return reached


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes the pages as WARC records and reads them back: one row per page with
    id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are computed anew from the payload that was read; a
    revisit's are its headers'. Null payloads are empty; a null id stays null; rows that
    repeat an id have a record each; ids of any text, and payloads of any length, come back
    as they are. An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, payload_col, least)
    kind = pages.schema[id_col].dataType
    read = read_warc(spark, path, {"size": lambda p: F.octet_length(p).cast("long"), "sha": lambda p: base32_sha1(p.cast("binary"))})
    response = F.col("type") == "response"
    return read.select(
        F.col("record_id").cast(kind).alias(id_col),
        F.when(response, F.col("size")).otherwise(F.col("payload_size")).alias("payload_bytes"),
        F.when(response, F.col("sha")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
