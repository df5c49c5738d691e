"""Writers: CSV, raw lines, split files, reports as JSON and GraphViz."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = False) -> None:
    """Cells with blanks at an end, a separator, a quote or a line end are quoted, quotes doubled."""
    df.write.option("sep", sep).option("header", header).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_raw(df: DataFrame, path: str) -> None:
    """Cells joined by commas without any quoting."""
    df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.text(path)


def write_split(df: DataFrame, path: str) -> None:
    """A folder per file_no."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c != "file_no"])
    df.select("file_no", line.alias("value")).repartition("file_no").write.partitionBy("file_no").text(path)


def write_split_files(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None) -> list[str]:
    """A single file per file_no: ``dir/name.suf`` gives ``dir/name-0000.suf``, ``dir/name-0001.suf`` and so on; their names are returned.
    Lines have ``columns``, else all but file_no.

    A file's lines are in ``order`` and one task's work, so files should be of a size that a task can sort. Files are written aside and
    renamed when all are there (one call a file, by the driver); files of these names are replaced, and a failed write leaves them as they were.
    """
    spark, (folder, _, name) = df.sparkSession, path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    if not stem:  # no suffix, or a name that begins with its only dot
        stem, dot, suffix = name, "", ""
    hadoop, aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, f"{folder or '.'}/.{stem}-{uuid.uuid4().hex}"
    fs = hadoop(aside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns if c != "file_no"])
    sorts = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    rows = df.select("file_no", line.alias("value"), *sorts).repartition("file_no").sortWithinPartitions("file_no", *[f"_o{i}" for i in range(len(order))])
    try:
        rows.select("file_no", "value").write.option("maxRecordsPerFile", 0).partitionBy("file_no").text(aside)
        out = []
        for d in sorted(fs.listStatus(hadoop(aside)), key=lambda d: d.getPath().getName()):
            if d.isDirectory():
                number = int(d.getPath().getName().partition("=")[2])
                target = hadoop(f"{folder}/{stem}-{number:04d}{dot}{suffix}" if folder else f"{stem}-{number:04d}{dot}{suffix}")
                (part,) = [f.getPath() for f in fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-")]
                if fs.exists(target):
                    fs.delete(target, False)
                if not fs.rename(part, target):
                    raise OSError(f"cannot name {target}")
                out.append((number, target.toString()))
        return [p for _, p in sorted(out)]
    finally:
        fs.delete(hadoop(aside), True)


def answer_lines(confusion: DataFrame) -> DataFrame:
    """test statistics: answerClassValue, count, successCount, successRate (%.3f), then class:failCount of each wrong answer."""
    ok = F.sum(F.when(F.col("cls") == F.col("pred"), F.col("n")).otherwise(0))
    wrong = F.sort_array(F.collect_list(F.when(F.col("cls") != F.col("pred"), F.concat_ws(":", "pred", "n"))))  # classes squared at most
    return confusion.groupBy("cls").agg(F.sum("n").alias("count"), ok.alias("success"), wrong.alias("wrong")).select(
        F.concat_ws(",", "cls", "count", "success", F.format_string("%.3f", F.col("success") / F.col("count")), F.concat_ws(",", "wrong")).alias("value")
    )


def tree_json(nodes: DataFrame, **more: float | int) -> str:
    """depthToNodes, maxDepth, nodes and the given times, counts and rates as indented JSON."""
    hist = {r["depth"]: r["n"] for r in nodes.groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth").collect()}
    return json.dumps({"depthToNodes": hist, "maxDepth": max(hist, default=0), "nodes": sum(hist.values()), **more}, indent=2)


def with_fields(text: str, **more: object) -> str:
    """A JSON object with more fields, such as a purity that was measured later."""
    return json.dumps(json.loads(text) | more, indent=2)


def dump_nodes(df: DataFrame, nodes: DataFrame, leaf: str, attributes: list[str], cls: str, names: list[str], path: str) -> None:
    """Reports of a tree's nodes, a folder a node: info (the node table), totals (class, name, n), counts (attr, value, class, name, n).

    ``df`` has the rows with their leaf; ``names`` decodes classes, and other classes keep their number.
    """
    named = F.coalesce(F.get(F.array(*map(F.lit, names)), F.col("cls")), F.col("cls").cast("string")).alias("name")
    nodes.withColumn("of", F.col("node")).write.partitionBy("of").json(f"{path}/info")
    rows = df.select(F.col(leaf).alias("node"), F.col(cls).alias("cls"), *attributes)
    rows.groupBy("node", "cls").agg(F.count("*").alias("n")).select("node", "cls", named, "n").write.partitionBy("node").csv(f"{path}/totals")
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attributes])).alias("p")
    rows.select("node", "cls", pairs).groupBy("node", "p.attr", "p.value", "cls").agg(F.count("*").alias("n")).select("node", "attr", "value", "cls", named, "n").write.partitionBy("node").csv(f"{path}/counts")


def save_tree(members: DataFrame, path: str, nodes: DataFrame | None = None) -> None:
    """A cluster tree as folders: info (node, depth, n) and members (node, id); ``members`` has path (array) and id, a node's name is its path.

    With ``nodes`` (path, kind, cf) also features (node, depth, kind, n, ss, ls) of each of them.
    """
    if nodes is not None:
        nodes.select(F.concat_ws("/", "path").alias("node"), F.size("path").alias("depth"), "kind", "cf.n", "cf.ss", "cf.ls").write.json(f"{path}/features")
    up = members.select(F.explode(F.sequence(F.lit(0), F.size("path"))).alias("depth"), "path").withColumn("node", F.concat_ws("/", F.slice("path", F.lit(1), F.col("depth"))))
    up.groupBy("node", "depth").agg(F.count("*").alias("n")).write.json(f"{path}/info")
    members.select(F.concat_ws("/", "path").alias("node"), "id").write.partitionBy("node").csv(f"{path}/members")


def dot_lines(nodes: DataFrame, node: str, parent: str, label: F.Column) -> DataFrame:
    """Lines of a directed graph: every node with its label, every edge from its parent."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), '(["\\\\])', "\\\\$1"), F.lit('"'))
    n = nodes.select(F.lit(1).alias("o"), F.concat(q(F.col(node)), F.lit(" [label="), q(label), F.lit("];")).alias("value"))
    e = nodes.where(F.col(parent).isNotNull()).select(F.lit(2).alias("o"), F.concat(q(F.col(parent)), F.lit(" -> "), q(F.col(node)), F.lit(";")).alias("value"))
    ends = nodes.sparkSession.createDataFrame([(0, "digraph tree {"), (3, "}")], "o int, value string")
    return ends.unionByName(n).unionByName(e).orderBy("o", "value").select("value")
