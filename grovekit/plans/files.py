"""Queries on files: each writes a table's rows in a format, reads them back and returns what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..lineage import new_folder
from ..operators import evaluation, preprocess, profile, rows
from ..sources import arff, delimited, records, sinks
from .catalogue import query, r6, read


#: Rows of a file, about, where a query may choose how many files it has: each is sorted and written by one task.
FILE_ROWS = 1_000_000


def _text(df: DataFrame, value: F.Column, order: str, label: str, head: tuple[str, ...] = (), files: int = 4) -> str:
    """Files of lines in this order, a row in the file of its key's rest by ``files``, each file after its own head; their folder."""
    path, s = new_folder(df.sparkSession, label), df.sparkSession
    rows = df.select(value.alias("value"), F.lit(1).alias("_k"), F.col(order).cast("long").alias("_o"), (F.col(order) % files).cast("int").alias("file_no"))
    heads = s.createDataFrame([(h, 0, i, k) for k in range(files) for i, h in enumerate(head)], "value string, _k int, _o long, file_no int")
    rows.unionByName(heads).repartition(max(files, int(s.conf.get("spark.sql.shuffle.partitions"))), "file_no").sortWithinPartitions("file_no", "_k", "_o").select("value", "file_no").write.partitionBy("file_no").text(path)
    return path


@query("csv_scan", """SELECT c_custkey::VARCHAR AS c0, 'say "' || c_name || '", twice' AS c1, c_mktsegment || chr(10) || 'second line' AS c2, c_acctbal < 0 AS negative FROM customer""")
def _csv_scan(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "csv")
    out = read(s, d, "customer").select("c_custkey", F.concat(F.lit('say "'), "c_name", F.lit('", twice')), F.concat("c_mktsegment", F.lit("\nsecond line")), "c_acctbal")
    sinks.write_csv(out, path)
    got = delimited.read_csv(s, path)
    return got.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(got.columns[:3])], (F.col(got.columns[3]).cast("double") < 0).alias("negative"))


_QUOTED = """o_orderkey || ',"' || o_orderpriority || chr(10) || '""' || o_orderstatus || '"",' || chr(10) || chr(10) || '",' || o_custkey"""
_PLACED = f"SELECT *, (o_orderkey % 4)::BIGINT AS file_no, sum(strlen(v) + 1) OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey)::BIGINT - strlen(v) - 1 AS off FROM (SELECT *, {_QUOTED} AS v FROM orders)"


@query("csv_blocks", f"""SELECT file_no, off, strlen(v)::BIGINT AS len, o_orderkey::VARCHAR AS a, o_orderpriority || chr(10) || '"' || o_orderstatus || '",' || chr(10) || chr(10) AS b, o_custkey::VARCHAR AS c FROM ({_PLACED})""")
def _csv_blocks(s: SparkSession, d: str) -> DataFrame:
    """Records with quotes, delimiters and line ends inside quotes, in blocks of 16 kB: many tasks a file."""
    line = F.concat(F.col("o_orderkey"), F.lit(',"'), "o_orderpriority", F.lit('\n""'), "o_orderstatus", F.lit('"",\n\n",'), "o_custkey")
    r = records.read_records(s, _text(read(s, d, "orders"), line, "o_orderkey", "blocks"), block_bytes=1 << 14)
    c = r.withColumn("c", delimited.cells(F.col("value"))).withColumn("file_no", F.regexp_extract("file", r"file_no=(\d+)", 1).cast("long"))
    return c.select("file_no", "off", "len", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate("abc")])


@query("csv_trim_blank_lines", "SELECT c_custkey::VARCHAR AS key, '  ' || c_mktsegment || ' ' AS segment, c_nationkey::VARCHAR AS nation FROM customer")
def _csv_trim(s: SparkSession, d: str) -> DataFrame:
    c = read(s, d, "customer")
    line = F.concat(F.lit("  "), "c_custkey", F.lit(' ,"  '), "c_mktsegment", F.lit(' ", '), "c_nationkey", F.lit(" "), F.when(F.col("c_custkey") % 5 == 0, F.lit("\n\n")).otherwise(F.lit("")))
    got = delimited.read_csv(s, _text(c, line, "c_custkey", "csv"), recursive=True)
    return got.toDF("key", "segment", "nation")


@query("csv_cells", """SELECT c_custkey::VARCHAR AS a, c_name || ' "x"y' AS b, c_mktsegment AS c FROM customer""")
def _csv_cells(s: SparkSession, d: str) -> DataFrame:
    """The tokenizer: text after a closing quote belongs to the cell, line ends of either kind."""
    line = F.concat(F.col("c_custkey"), F.lit('|"'), "c_name", F.lit(' ""x"""y| '), "c_mktsegment", F.lit(" \r"))
    c = s.read.option("lineSep", "\n").text(_text(read(s, d, "customer"), line, "c_custkey", "csv")).select(delimited.cells(F.col("value"), "|").alias("c"))
    return c.select(F.col("c")[0].alias("a"), F.col("c")[1].alias("b"), F.col("c")[2].alias("c"))


@query("csv_defaults", "SELECT c_custkey::VARCHAR AS a, CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE c_name END AS b, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE '-1' END AS c FROM customer")
def _csv_defaults(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    line = F.concat(F.col("c_custkey").cast("string"), F.when(k == 0, F.lit(",")).when(k == 1, F.concat(F.lit(","), "c_name")).otherwise(F.concat(F.lit(","), "c_name", F.lit(","), "c_mktsegment")))
    t = s.read.text(_text(read(s, d, "customer"), line, "c_custkey", "csv")).select(delimited.with_defaults(delimited.cells(F.col("value")), ["", "none", "-1"]).alias("c"))
    return t.select(F.col("c")[0].alias("a"), F.col("c")[1].alias("b"), F.col("c")[2].alias("c"))


@query("csv_delimiter", "SELECT n_nationkey::VARCHAR AS a, n_name AS b, n_regionkey::VARCHAR AS c FROM nation")
def _csv_delimiter(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "csv")
    sinks.write_csv(read(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, sep="\t")
    return delimited.read_csv(s, path, sep="\t").toDF("a", "b", "c")


_LINE = "c_custkey || ',' || c_name || ',' || c_acctbal::DECIMAL(18, 2)"
_LINES = f"SELECT c_custkey, v, sum(strlen(v) + 1) OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey)::BIGINT - strlen(v) - 1 AS off FROM (SELECT c_custkey, {_LINE} AS v FROM customer)"


def _lines(s: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    return delimited.read_lines(s, _text(read(s, d, "customer"), line, "c_custkey", "lines"))


query("line_offsets", f"SELECT off, strlen(v)::BIGINT AS len, v AS value FROM ({_LINES})")(lambda s, d: _lines(s, d).select("off", "len", "value"))
query("line_range_scan", f"SELECT off, strlen(v)::BIGINT AS len FROM ({_LINES}) WHERE off BETWEEN 1000 AND 5000")(lambda s, d: _lines(s, d).where("off BETWEEN 1000 AND 5000").select("off", "len"))


@query("line_random_access", f"SELECT off, v AS value FROM ({_LINES}) WHERE off % 7 = 0")
def _random_access(s: SparkSession, d: str) -> DataFrame:
    lines = _lines(s, d)
    return delimited.lines_at(lines, lines.where("off % 7 = 0").select("file", "off")).select("off", "value")


@query("points_header_skip", "SELECT l_orderkey::DOUBLE AS a, l_quantity AS b, l_linenumber AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def _points(s: SparkSession, d: str) -> DataFrame:
    """Two header lines, points of two fields, the last column as label."""
    line = F.concat_ws(",", "l_orderkey", "l_quantity", "l_linenumber")
    x = read(s, d, "lineitem")
    path = _text(x, line, "l_orderkey", "points", ("# made for a test", "key,quantity,line"), files=max(4, -(-x.count() // FILE_ROWS)))
    p = delimited.read_points(s, path, rows.parse_ranges("0-1", True), 2, skip=2)
    return p.groupBy(F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), "label").agg(F.count("*").alias("n"))


def _folders(s: SparkSession, d: str, suffix: str = "") -> str:
    """Nations in one file a region, in nested folders."""
    root = new_folder(s, "folders")
    for k in range(5):
        n = read(s, d, "nation").where(F.col("n_regionkey") == k)
        n.select(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("value"), "n_nationkey").coalesce(1).sortWithinPartitions("n_nationkey").select("value").write.text(f"{root}/r{k % 2}/region{k}{suffix}")
    return root


@query("directory_scan", "SELECT n_nationkey::VARCHAR AS a, n_name AS b, n_regionkey::VARCHAR AS c FROM nation")
def _directory(s: SparkSession, d: str) -> DataFrame:
    return delimited.read_csv(s, _folders(s, d), recursive=True, suffixes=("txt",)).toDF("a", "b", "c")


@query("sorted_directory_scan", "SELECT n_regionkey::BIGINT AS region, count(*) AS n, (row_number() OVER (ORDER BY n_regionkey) - 1)::BIGINT AS place FROM nation GROUP BY n_regionkey")
def _sorted_directory(s: SparkSession, d: str) -> DataFrame:
    import re

    names = sorted(delimited.list_files(s, _folders(s, d), (".txt",)), key=lambda p: re.search(r"region(\d)", p)[1])
    index = s.createDataFrame([(p, i) for i, p in enumerate(names)], "path string, place long")
    t = s.read.text(names).select(F.regexp_extract(F.col("_metadata.file_path"), r"region(\d)", 1).cast("long").alias("region"))
    place = index.select(F.regexp_extract("path", r"region(\d)", 1).cast("long").alias("r"), "place")
    return t.groupBy("region").agg(F.count("*").alias("n")).join(F.broadcast(place), F.col("region") == F.col("r")).select("region", "n", "place")


_ALL = "SELECT n_regionkey, v, sum(strlen(v) + 1) OVER (ORDER BY n_regionkey % 2, n_regionkey, n_nationkey)::BIGINT - strlen(v) - 1 AS place, sum(strlen(v) + 1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT - strlen(v) - 1 AS off FROM (SELECT *, n_nationkey || ',' || n_name || ',' || n_regionkey AS v FROM nation)"


@query("global_offsets", f"SELECT place, off, v AS value FROM ({_ALL})")
def _global_offsets(s: SparkSession, d: str) -> DataFrame:
    """Lines of several files by one offset: the files' sizes are summed in the order of their names."""
    root = _folders(s, d)
    lines = delimited.read_lines(s, [f"{root}/r{k % 2}/region{k}" for k in range(5)])
    index = delimited.file_index(lines).select(F.col("file").alias("f"), "start")
    return lines.join(F.broadcast(index), F.col("file") == F.col("f")).select((F.col("start") + F.col("off")).alias("place"), "off", "value")


@query("file_index_lookup", f"SELECT place, off AS local FROM ({_ALL})")
def _lookup(s: SparkSession, d: str) -> DataFrame:
    root = _folders(s, d)
    lines = delimited.read_lines(s, [f"{root}/r{k % 2}/region{k}" for k in range(5)])
    index = delimited.file_index(lines)
    return evaluation.ranges_join(_global_offsets(s, d).select("place"), "place", index).select("place", "local")


@query("input_limit_files", "SELECT n_nationkey::VARCHAR || ',' || n_name || ',' || n_regionkey AS value FROM nation WHERE n_regionkey IN (0, 2)")
def _limit_files(s: SparkSession, d: str) -> DataFrame:
    root = _folders(s, d)
    return rows.limit_files(delimited.read_lines(s, [f"{root}/r{k % 2}/region{k}" for k in range(5)]), 2).select("value")


@query("format_dispatch", "SELECT unnest(['arff', 'csv', 'parquet']) AS kind, count(*) AS n, sum(n_nationkey)::BIGINT AS keys FROM nation")
def _dispatch(s: SparkSession, d: str) -> DataFrame:
    from ..cli import load

    n, out = read(s, d, "nation").select("n_nationkey", "n_name"), None
    root = new_folder(s, "formats")
    sinks.write_csv(n, f"{root}/n.csv", header=True)
    head = arff.Header("nation", [arff.Attribute("n_nationkey", "integer"), arff.Attribute("n_name", "string")])
    s.createDataFrame([(x,) for x in arff.render_header(head).splitlines()], "value string").unionByName(n.select(F.concat_ws(",", F.col("n_nationkey").cast("string"), F.concat(F.lit("'"), "n_name", F.lit("'"))).alias("value"))).coalesce(1).write.text(f"{root}/n.arff")
    for kind, path in (("parquet", f"{d}/nation.parquet"), ("csv", f"{root}/n.csv"), ("arff", f"{root}/n.arff")):
        one = load(s, [path]).select(F.lit(kind).alias("kind"), F.col("n_nationkey").cast("long").alias("k"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


def _arff(s: SparkSession, d: str, extra: F.Column | None = None, sparse: bool = False) -> tuple[arff.Header, DataFrame]:
    p = read(s, d, "part")
    brands = [r[0] for r in p.select("p_brand").distinct().orderBy("p_brand").collect()]  # an enum's values
    head = arff.Header("the parts", [arff.Attribute("key", "integer"), arff.Attribute("a name", "string"), arff.Attribute("brand", "enum", brands), arff.Attribute("price", "real"), arff.Attribute("made", "date", format="yyyy-MM-dd")])
    made = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int")), "yyyy-MM-dd")
    row = [F.col("p_partkey").cast("string"), F.concat(F.lit("'it is "), "p_name", F.lit(", so'")), F.concat(F.lit("'"), "p_brand", F.lit("'")), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.concat(F.lit('"'), made, F.lit('"'))]
    line = F.concat(F.lit("{0 "), row[0], F.lit(", 2 "), row[2], F.lit("}")) if sparse else F.concat_ws(",", *row)
    line = line if extra is None else F.concat(line, extra)
    return arff.read_arff(s, _text(p, line, "p_partkey", "arff", ("% a comment", *arff.render_header(head).splitlines())))


_BRAND = "(dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT"
query("arff_scan", f"SELECT p_partkey AS key, 'it is ' || p_name || ', so' AS name, {_BRAND} AS brand, p_retailprice::DECIMAL(18, 2)::DOUBLE AS price, epoch(DATE '2020-01-01' + (p_partkey % 365)::INT)::DOUBLE AS made, 1.0::DOUBLE AS weight FROM part")(lambda s, d: _arff(s, d)[1].toDF("key", "name", "brand", "price", "made", "weight"))
query("arff_weights", "SELECT p_partkey AS key, p_size / 2.0 AS weight FROM part")(lambda s, d: _arff(s, d, F.concat(F.lit(", {"), F.col("p_size") / 2, F.lit("}")))[1].select("key", "weight"))
query("arff_sparse", f"SELECT p_partkey AS key, '' AS name, {_BRAND} AS brand, 0.0::DOUBLE AS price FROM part")(lambda s, d: _arff(s, d, sparse=True)[1].toDF("key", "name", "brand", "price", "made", "weight").select("key", "name", "brand", "price"))


@query("arff_header", """SELECT 'the parts' AS relation, 'brand' AS name, 'enum' AS kind, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS "values", '' AS format FROM part
UNION ALL SELECT 'the parts', n, k, '', f FROM (VALUES ('key', 'integer', ''), ('a name', 'string', ''), ('price', 'real', ''), ('made', 'date', 'yyyy-MM-dd')) t(n, k, f)""")
def _arff_header(s: SparkSession, d: str) -> DataFrame:
    """A header written and parsed again."""
    h = _arff(s, d)[0]
    return s.createDataFrame([(h.relation, a.name, a.kind, "|".join(a.values), a.format) for a in h.attributes], "relation string, name string, kind string, values string, format string")


query("date_epoch", "SELECT o_orderkey, epoch(date_trunc('day', o_orderdate))::DOUBLE AS seconds, -1.0::DOUBLE AS bad FROM orders")(lambda s, d: read(s, d, "orders").select("o_orderkey", S.epoch_seconds(F.date_format("o_orderdate", "dd/MM/yyyy"), "dd/MM/yyyy").alias("seconds"), S.epoch_seconds(F.lit("no date"), "dd/MM/yyyy").alias("bad")))


@query("class_count_file", "SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY 1")
def _class_counts(s: SparkSession, d: str) -> DataFrame:
    """Made at the first call, read at the second."""
    path = new_folder(s, "class-counts")
    delimited.class_counts(s, path, read(s, d, "embeddings"), "label")
    return delimited.class_counts(s, path, read(s, d, "embeddings").limit(0), "label")


_TREE = "SELECT vec_id AS id, [(vec_id % 3)::INT, (vec_id % 9)::INT] AS path FROM embeddings"
_members = lambda s, d: read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.array((F.col("vec_id") % 3).cast("int"), (F.col("vec_id") % 9).cast("int")).alias("path"))


@query("saved_tree_load", f"SELECT array_to_string(path, '/') AS path, id AS member FROM ({_TREE})")
def _saved(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "saved")
    kept = _members(s, d).groupBy("path").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    kept.select(F.concat_ws(",", F.col("path").cast("array<string>")).alias("p"), "ids").select(F.concat_ws(",", "p", F.concat(F.lit("L"), F.size("ids")), F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("value")).write.text(path)
    return delimited.read_saved_tree(s, path).select(F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"), "member")


@query("save_tree_folders", f"SELECT 'info' AS kind, array_to_string(path[1:k], '/') AS node, k::BIGINT AS depth, count(*) AS n FROM ({_TREE}), range(0, 3) t(k) GROUP BY ALL UNION ALL SELECT 'members', array_to_string(path, '/'), NULL, count(*) FROM ({_TREE}) GROUP BY 2")
def _save_folders(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "tree")
    sinks.save_tree(_members(s, d), path)
    info = s.read.schema("node string, depth long, n long").json(f"{path}/info").select(F.lit("info").alias("kind"), "node", "depth", "n")
    back = s.read.schema("id long, node string").csv(f"{path}/members").groupBy("node").agg(F.count("*").alias("n"))
    return info.unionByName(back.select(F.lit("members").alias("kind"), "node", F.lit(None).cast("long").alias("depth"), "n"))


@query("purity_into_json", "WITH t AS (SELECT vec_id % 9 AS c, label, count(*) AS n FROM embeddings GROUP BY ALL), u AS (SELECT max(n) AS top, sum(n) AS size FROM t GROUP BY c) SELECT 10::BIGINT AS branching, 13::BIGINT AS nodes, round(sum(top) / sum(size), 6) AS purity FROM u")
def _purity(s: SparkSession, d: str) -> DataFrame:
    """Tree statistics as JSON, a purity put in later, both read back."""
    nodes = evaluation.prefixes(_members(s, d), "path").select("node", "depth").distinct()
    text = sinks.tree_json(nodes, branching=10)
    purity = evaluation.flat_purity(read(s, d, "embeddings").withColumn("c", F.col("vec_id") % 9), "c", "label").first()["weighted_purity"]
    path = new_folder(s, "json")
    s.createDataFrame([(sinks.with_fields(text, purity=purity),)], "value string").write.text(path)
    got = s.read.option("multiLine", True).schema("branching long, nodes long, purity double").json(path)
    return got.select("branching", "nodes", r6("purity").alias("purity"))


@query("raw_lines", "SELECT c_custkey || ',' || c_name || ',' || coalesce(c_mktsegment, '') AS value FROM customer")
def _raw(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "raw")
    sinks.write_raw(read(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return s.read.text(path)


@query("split_files", "SELECT ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000)::BIGINT AS file_no, o_orderkey::VARCHAR AS value FROM orders")
def _split(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "split")
    sinks.write_split(rows.split_rows(read(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 1000), path)
    return s.read.schema("value string, file_no long").text(path).select("file_no", "value")


@query("dot_tree", """WITH n AS (SELECT p_partkey AS k, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS up, 'a "' || p_partkey || '"' AS l FROM part) SELECT '"' || k || '" [label="' || replace(l, '"', chr(92) || '"') || '"];' AS value FROM n
UNION ALL SELECT '"' || up || '" -> "' || k || '";' FROM n WHERE up IS NOT NULL UNION ALL SELECT unnest(['digraph tree {', '}'])""")
def _dot(s: SparkSession, d: str) -> DataFrame:
    n = read(s, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"), F.concat(F.lit('a "'), "p_partkey", F.lit('"')).alias("l"))
    return sinks.dot_lines(n, "node", "parent", F.col("l"))


query("drop_empty_rows", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0")(
    lambda s, d: preprocess.Pipeline().drop_empty("c_mktsegment").apply(read(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment")))
)
query("row_shuffle", "SELECT o_orderkey, (row_number() OVER (ORDER BY md5('3526257:' || o_orderkey)) - 1)::BIGINT AS place FROM orders")(lambda s, d: _placed(rows.shuffle(read(s, d, "orders").select("o_orderkey"), ["o_orderkey"], rows.parse_seed("seed"))))


def _placed(df: DataFrame) -> DataFrame:
    """Numbers rows in the order that they come out in."""
    path = new_folder(df.sparkSession, "shuffled")
    df.write.parquet(path)
    t = df.sparkSession.read.parquet(path).select("o_orderkey", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("file"), F.monotonically_increasing_id().alias("i"))
    # rows of a file keep their order; files are in the order of the sort's ranges
    return rows.with_running(t.withColumn("key", F.col("file")), ["key", "i"]).select("o_orderkey", F.col("_ord").alias("place"))


@query("field_precedence", "SELECT p_partkey, round((p_size - 10) / 4.0, 6)::DOUBLE AS size, round((least(greatest(p_retailprice, 900), 2000) - 900) / 1100.0, 6)::DOUBLE AS price FROM part")
def _precedence(s: SparkSession, d: str) -> DataFrame:
    f = preprocess.by_field([0, 1], lambda c: S.min_max(c, 900, 2000), {0: lambda c: S.z_score(c, 10, 4)})
    return read(s, d, "part").select("p_partkey", r6(f[0](F.col("p_size"))).alias("size"), r6(f[1](F.col("p_retailprice"))).alias("price"))


query("consecutive_by_time", """WITH p AS (SELECT event_id, user_id, value, lag(value) OVER w AS prev, floor(epoch_us(ts) / 86400000000.0) AS day, lag(floor(epoch_us(ts) / 86400000000.0)) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, round(abs(value - prev), 6) AS distance FROM p WHERE prev IS NOT NULL AND day <> before""")(
    lambda s, d: profile.consecutive(read(s, d, "events"), ["user_id"], ["ts", "event_id"], r6(F.abs(F.col("value") - F.col("_previous"))), "value", seconds=86_400).select("event_id", "user_id", "distance")
)


@query("split_single_files", "SELECT ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000)::BIGINT AS file_no, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 1000)::BIGINT AS line, o_orderkey || ',' || o_orderstatus AS value FROM orders")
def _single(s: SparkSession, d: str) -> DataFrame:
    """Files orders-0000.csv, orders-0001.csv and so on, read back with each line's place in its file."""
    path = new_folder(s, "single")
    dealt = rows.split_rows(read(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 1000)
    sinks.write_split_files(dealt, f"{path}/orders.csv", ["o_orderkey"])
    lines = delimited.read_lines(s, f"{path}/orders-*.csv").select(F.regexp_extract("file", r"-(\d+)\.csv$", 1).cast("long").alias("file_no"), "off", "value")
    w = Window.partitionBy("file_no").orderBy("off")  # 1,000 lines at most
    return lines.select("file_no", (F.row_number().over(w) - 1).cast("long").alias("line"), "value")


@query("points_generators", "SELECT o_orderkey::DOUBLE AS a, length(o_clerk)::DOUBLE AS b, (o_orderpriority < '3')::INT AS label FROM (SELECT o_orderkey, o_orderpriority, 'clerk ' || o_custkey AS o_clerk FROM orders)")
def _generators(s: SparkSession, d: str) -> DataFrame:
    """A field and the label by functions of their text."""
    line = F.concat_ws(",", "o_orderkey", F.concat(F.lit("clerk "), "o_custkey"), "o_orderpriority")
    path = _text(read(s, d, "orders"), line, "o_orderkey", "generated")
    p = delimited.read_points(s, path, [0, 1], 2, generators={1: F.length, 2: lambda c: c < "3"})
    return p.select(F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), "label")
