"""Delimited files: CSV tables, CSV lines with byte offsets, points, directory scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import extract
from . import records


#: Header lines are looked for in stretches of so many bytes.
HEAD_BYTES = 1 << 26


def read_csv(spark: SparkSession, paths: str | list[str], sep: str = ",", header: bool = False, recursive: bool = False, suffixes: tuple[str, ...] = (), block_bytes: int | None = None) -> DataFrame:
    """All files as one table of strings; quotes doubled inside quotes, line ends inside quotes, blanks trimmed outside them, blank lines dropped, empty cells null.

    Names (of the first row's cells, else _c0, _c1, ...) and the number of columns come from one file's first record; a file is read in blocks (see ``records``).
    """
    r = spark.read.option("sep", sep).option("header", header).option("escape", '"').option("multiLine", True)
    r = r.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("recursiveFileLookup", recursive)
    if suffixes:
        r = r.option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
    names = r.csv(paths).columns
    rows = records.read_records(spark, paths, sep, recursive, suffixes, block_bytes).where(F.trim("value") != "")
    if header:
        rows = rows.where("off > 0")
    c = rows.select(cells(F.col("value"), sep).alias("c"))
    return c.select(*[F.nullif(F.get("c", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def cells(line: Column, sep: str = ",") -> Column:
    """The cells of one line as an array: quoted ones unquoted, others trimmed."""
    d = "\\" + sep if sep in ".|*+?^$()[]{}\\" else sep
    body = F.regexp_replace(line, "\r$", "")
    parts = F.regexp_extract_all(F.concat(body, F.lit(sep)), F.lit(rf'\s*("[^"]*+(?:""[^"]*+)*+"[^{d}]*+|[^{d}]*+){d}'), F.lit(1))
    clean = lambda c: F.when(F.ltrim(c).startswith('"'), F.regexp_replace(F.regexp_replace(F.trim(c), '(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$', "$1$2"), '""', '"')).otherwise(F.trim(c))
    return F.transform(parts, clean)


def with_defaults(row: Column, defaults: list[str]) -> Column:
    """A row's cells, missing and empty ones replaced; as many cells as defaults at least, further ones as they are."""
    at = F.sequence(F.lit(0), F.greatest(F.size(row), F.lit(len(defaults))) - 1)
    known = F.array(*map(F.lit, defaults))
    return F.transform(at, lambda i: F.coalesce(F.nullif(F.get(row, i), F.lit("")), F.get(known, i), F.lit("")))


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".csv",)) -> list[str]:
    """All files below a folder with such a suffix, hidden ones left out, sorted by name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, walk = [], hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop, True)
    while walk.hasNext():
        p = walk.next().getPath()
        if p.getName().endswith(suffixes) and not p.getName().startswith((".", "_")):
            found.append((p.getName(), p.toString()))
    return [p for _, p in sorted(found)]


def lines_at(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines by file and byte offset, as a join. ``wanted``: file, off."""
    at = wanted.select(F.col("file").alias("_file"), F.col("off").alias("_off")).distinct()
    return lines.join(at, (F.col("file") == F.col("_file")) & (F.col("off") == F.col("_off")), "left_semi")


def class_counts(spark: SparkSession, path: str, rows: DataFrame, label: str) -> DataFrame:
    """label, n from a file of label,count lines, which is made from ``rows`` if it is not there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        rows.groupBy(F.col(label).cast("long").alias("label")).agg(F.count("*").alias("n")).write.csv(path)
    return spark.read.schema("label long, n long").csv(path)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, off (byte offset in it, a line's identity), len (bytes without the line end), value.

    Lines are summed up within each file block; only the blocks' totals are added up across them. Line ends inside quotes end a
    line here; ``records.read_records`` keeps them.
    """
    t = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.octet_length("value").cast("long").alias("len"))
    t = t.withColumn("_i", F.monotonically_increasing_id())
    totals = t.groupBy("file", "block").agg(F.sum(F.col("len") + 1).alias("n"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    run = Window.partitionBy("file", "block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    j = t.join(before, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return j.select("file", (F.col("before") + F.sum(F.col("len") + 1).over(run) - F.col("len") - 1).alias("off"), "len", "value")


def file_index(lines: DataFrame) -> DataFrame:
    """file, start, stop of each file in one global offset space, in order of their names."""
    size = lines.groupBy("file").agg(F.sum(F.col("len") + 1).alias("n"))
    end = F.sum("n").over(Window.orderBy("file"))  # a row a file
    return size.select("file", (end - F.col("n")).alias("start"), end.alias("stop"))


def read_points(spark: SparkSession, paths: str | list[str], fields: list[int], label: int | None = None, skip: int = 0, sep: str = ",", generators: dict[int, Callable[[Column], Column]] | None = None) -> DataFrame:
    """id (file and offset), x (array<double>), label: the first ``skip`` records of a file and empty lines dropped; text fields are hashed.

    ``generators`` make a field's number, or the label, from its text in another way, by field.
    """
    made = generators or {}
    lines = records.read_records(spark, paths, sep)
    if skip:
        w = Window.partitionBy("file", "_h").orderBy("off")
        early = lines.select("file", "off", F.floor(F.col("off") / HEAD_BYTES).alias("_h")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= skip)  # per stretch of a file, so no file is one task
        last = early.groupBy(F.col("file").alias("f")).agg(F.sort_array(F.collect_list("off")).alias("o")).select("f", F.coalesce(F.get("o", F.lit(skip - 1)), F.array_max("o")).alias("last"))
        lines = lines.join(last, F.col("file") == F.col("f"), "left").where(F.col("last").isNull() | (F.col("off") > F.col("last"))).drop("f", "last")
    c = lines.withColumn("c", cells(F.col("value"), sep)).where(F.trim("value") != "")
    at = lambda i: F.coalesce(F.get(F.col("c"), F.lit(i)), F.lit(""))
    cols = [F.struct("file", "off").alias("id"), F.array(*[made.get(i, extract)(at(i)).cast("double") for i in fields]).alias("x")]
    if label is not None:
        cols.append(made.get(label, extract)(at(label)).cast("int").alias("label"))
    return c.select(*cols)


def read_saved_tree(spark: SparkSession, path: str) -> DataFrame:
    """path (array<int>), member (long) of a saved cluster file: lines i1,...,in,L<count>,members."""
    t = spark.read.text(path).select(F.split("value", ",").alias("c")).withColumn("k", F.expr("array_position(transform(c, x -> x like 'L%'), true)"))
    t = t.where("k > 0").select(F.expr("transform(slice(c, 1, int(k) - 1), x -> int(x))").alias("path"), F.expr("transform(slice(c, int(k) + 1, size(c)), x -> bigint(x))").alias("m"))
    return t.select("path", F.explode("m").alias("member"))
