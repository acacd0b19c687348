"""Reading messy delimited files as tables of text."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelforge.functions.scalars import trimmed
from funnelforge.session import stored

#: Delimiters in order of preference, and words that mean a missing value.
DELIMITERS = (",", "|", "\t", ";")
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
SAMPLE_LINES, EXAMPLES = 500, 10


def n_fields(line: Column, delimiter: Column | str) -> Column:
    """Fields of a line, counting delimiters outside double quotes."""
    d = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    bare = F.regexp_replace(line, r'"([^"]|"")*"', "")
    return (F.length(bare) - F.length(F.replace(bare, d, F.lit("")))) / F.length(d) + 1


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, encoding, hash) of each file: utf-8-sig, utf-8 or latin-1."""
    rows = spark.read.format("binaryFile").load(path)
    encoding = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", "utf-8-sig").when(F.is_valid_utf8(F.col("content").cast("string")), "utf-8").otherwise("latin-1")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"), encoding.alias("encoding"), F.sha2("content", 256).alias("hash"))


def same_content(found: DataFrame) -> DataFrame:
    """(hash, n) of contents that several files have."""
    return found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(file, block, row, line, raw): ``row`` grows along the file; blank lines are left out."""
    text = _decoded(F.col("value"), encoding)
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.regexp_replace(text, "^\ufeff|\r$", "").alias("line"), F.col("value").cast("binary").alias("raw")
    )
    return rows.where(F.length(trimmed(F.col("line"))) > 0)


def detect_delimiter(found: DataFrame) -> DataFrame:
    """S3: (file, delimiter, n_fields, share): by the first 500 lines of each file, the
    delimiter that splits them, then the one that does so most evenly, then into most fields."""
    first = found.where("block = 0").withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("row"))).where(F.col("k") <= SAMPLE_LINES)
    d = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("d")) for i, x in enumerate(DELIMITERS)))).alias("x")
    tried = first.select("file", "line", d).select("file", "x.i", F.col("x.d").alias("delimiter"), n_fields(F.col("line"), F.col("x.d")).cast("long").alias("n_fields"))
    modes = tried.groupBy("file", "i", "delimiter", "n_fields").agg(F.count(F.lit(1)).alias("c"))
    best = Window.partitionBy("file", "i").orderBy(F.desc("c"), F.desc("n_fields"))
    total = Window.partitionBy("file", "i")
    mode = modes.withColumns({"share": F.col("c") / F.sum("c").over(total), "k": F.row_number().over(best)}).where("k = 1")
    rank = Window.partitionBy("file").orderBy((F.col("n_fields") > 1).desc(), F.desc("share"), F.desc("n_fields"), "i")
    return mode.withColumn("k", F.row_number().over(rank)).where("k = 1").select("file", "delimiter", "n_fields", "share")


def _decoded(c: Column, encoding: str) -> Column:
    return c if encoding.startswith("utf-8") else F.decode(c.cast("binary"), "ISO-8859-1")


def _names(line: str, delimiter: str) -> list[str]:
    """The column names of a header line, quoted or not."""
    return [c.strip() for c in next(csv.reader([line.lstrip("\ufeff").rstrip("\r")], delimiter=delimiter))]


def header_of(spark: SparkSession, path: str | list[str], delimiter: str, encoding: str = "utf-8") -> list[str]:
    """The column names: one line is read."""
    first = spark.read.text(path).select(_decoded(F.col("value"), encoding).alias("value")).first()
    return _names(first["value"], delimiter) if first else []


def read_delimited(
    spark: SparkSession, path: str | list[str], delimiter: str = ",", encoding: str = "utf-8", na_words: tuple[str, ...] | None = NA_WORDS, multiline: bool = False, names: list[str] | None = None
) -> DataFrame:
    """All columns as text. Rows with too many fields are left out, short ones padded
    with null; each file begins with the header. ``na_words`` become null. Quoted fields may
    hold line ends if ``multiline``; a file is then read in one task."""
    names = names or header_of(spark, path, delimiter, encoding)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_raw"]])
    rows = (
        spark.read.schema(schema).option("sep", delimiter).option("header", True).option("encoding", "ISO-8859-1" if encoding == "latin-1" else "UTF-8")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").option("enforceSchema", True).option("multiLine", multiline).option("escape", '"').csv(path)
    )
    fit = rows.where(F.col("_raw").isNull() | (n_fields(F.col("_raw"), delimiter) <= len(names))).drop("_raw")
    if na_words:
        fit = fit.select(*(F.when(~F.col(c).isin(*na_words), F.col(c)).alias(c) for c in names))
    return fit


def read_files(spark: SparkSession, path: str, na_words: tuple[str, ...] | None = NA_WORDS, multiline: bool = False) -> DataFrame:
    """S1 over files that differ in header, encoding and delimiter: each is read by its own,
    and columns meet by name; what a file lacks is null. Files of one layout are read together."""
    kinds = files(spark, path).select(F.col("path").alias("file"), "encoding")
    found = lines(spark, path)
    first = found.where("block = 0").groupBy("file").agg(F.min_by("raw", "row").alias("head"))
    layouts = detect_delimiter(found).join(kinds, "file").join(first, "file")
    parts: list[DataFrame] = []
    for r in layouts.groupBy("encoding", "delimiter", "head").agg(F.collect_list("file").alias("files")).orderBy("head", "encoding", "delimiter").collect():
        head = bytes(r["head"]).decode("latin-1" if r["encoding"] == "latin-1" else "utf-8")
        parts.append(read_delimited(spark, r["files"], r["delimiter"], r["encoding"], na_words, multiline, _names(head, r["delimiter"])))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, delimiter, header array) of each file, as a table."""
    kinds = files(spark, path).select(F.col("path").alias("file"), "encoding")
    found = lines(spark, path)
    first = found.where("block = 0").groupBy("file").agg(F.min_by("raw", "row").alias("head"))
    met = detect_delimiter(found).join(kinds, "file").join(first, "file")
    head = F.regexp_replace(decoded(F.col("head"), F.col("encoding")), "^\ufeff|\r$", "")
    names = F.transform(fields(head, F.col("delimiter")), trimmed)
    return stored(met.select("file", "encoding", "delimiter", names.alias("header")), "layouts")


def decoded(raw: Column, encoding: Column) -> Column:
    """Bytes as text by each row's encoding; what is no UTF-8 is replaced."""
    return F.when(encoding == "latin-1", F.decode(raw, "ISO-8859-1")).otherwise(raw.cast("string"))


def fields(line: Column, delimiter: Column) -> Column:
    """The fields of a line, each row by its own delimiter; quoted ones may hold it, and two
    quotes for one. What follows a closing quote up to the next delimiter is dropped."""
    d = F.concat(F.lit("["), F.when(delimiter == "\t", "\\t").otherwise(delimiter), F.lit("]"))
    other = F.concat(F.lit("[^"), F.when(delimiter == "\t", "\\t").otherwise(delimiter), F.lit("]*"))
    # Each field is found behind a delimiter, so the line is given one in front.
    cells = F.regexp_extract_all(F.concat(delimiter, line), F.concat(d, F.lit(r'("(?:[^"]|"")*"|'), other, F.lit(")")), F.lit(1))
    bare = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda c: F.when(F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) >= 2), bare(c)).otherwise(c))


def read_layouts(spark: SparkSession, path: str, na_words: tuple[str, ...] | None = NA_WORDS, columns: list[str] | None = None) -> DataFrame:
    """S1 over files of any number of layouts, which are rows of a table and no plans: each
    line is split by its own file's delimiter and named by its header, in one scan.

    Gives (file, row, cells map), or, with ``columns``, these as text columns, null where a
    file lacks them. Rows with too many fields are left out, missing ones are null, and so
    are ``na_words``; of names that repeat in a header the last counts. Line ends inside
    quotes are not read so; ``read_files`` does.
    """
    known = layouts(spark, path)
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("raw")
    )
    met = raw.join(known, "file")
    text = F.regexp_replace(decoded(F.col("raw"), F.col("encoding")), "^\ufeff|\r$", "")
    rows = met.select("file", "block", "row", "header", "delimiter", text.alias("line")).where(F.length(trimmed(F.col("line"))) > 0)
    cut = rows.select("file", "block", "row", "header", fields(F.col("line"), F.col("delimiter")).alias("f")).where(F.size("f") <= F.size("header"))
    value = (lambda x: F.when(~x.isin(*na_words), x)) if na_words else (lambda x: x)
    pairs = F.arrays_zip(F.col("header").alias("name"), F.transform("f", value).alias("value"))
    cells = F.reduce(pairs, F.expr("cast(map() as map<string, string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["name"]), F.create_map(p["name"], p["value"])))
    # The header is the first line of a file, told by what it says.
    named = cut.where(~((F.col("block") == 0) & (F.transform("f", trimmed) == F.col("header"))))
    if columns is None:
        return named.select("file", "row", cells.alias("cells"))
    return named.select("file", "row", cells.alias("cells")).select("file", "row", *(F.col("cells")[c].alias(c) for c in columns))


def malformed_rows(found: DataFrame, delimiter: str, width: int) -> DataFrame:
    """(row, line, n_fields) of lines of another width than the header."""
    counted = found.withColumn("n_fields", n_fields(F.col("line"), delimiter).cast("long"))
    return counted.where(F.col("n_fields") != width).select("row", "line", "n_fields")


def malformed_report(bad: DataFrame) -> DataFrame:
    """(n, examples): how many, and the first ten by row."""
    few = bad.orderBy("row").limit(EXAMPLES).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("examples"))
    return bad.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(few))  # one row
