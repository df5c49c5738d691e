"""Queries on whole trees: growth, reports, classes; SQL repeats the growth level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, new_folder, written
from ..operators import birch, cflog, cftree, clustering, evaluation, hierarchy, hoeffding, impurity, rows, upkeep
from ..sources import sinks
from ..streaming import ingest
from .catalogue import _CLS, _FIXED, _PRED, ATTRS, _nodes, _ordered, _pred, _tree, learnable, query, r6, read

#: The attribute with many values is cut where 1,000 equal shares of its rows begin, the others at their distinct values.
_SHARES = """e AS (SELECT v, min(v) OVER (PARTITION BY share) AS lower FROM (SELECT v, CASE WHEN count(*) OVER () <= 1000 THEN v ELSE floor((sum(n) OVER (ORDER BY v) - n) * 1000.0 / sum(n) OVER ()) END AS share FROM (SELECT l_extendedprice AS v, count(*) AS n FROM lineitem GROUP BY 1)))"""


def _level(k: int, attrs: list[str] = ATTRS) -> str:
    """From r<k> (one row a lineitem with its leaf) the decision of each leaf, d<k>, and r<k+1>."""
    long = " UNION ALL ".join(f"SELECT leaf, '{a}' AS attr, {'lower' if a == 'l_extendedprice' else a}::DOUBLE AS value, cls FROM r{k}" for a in attrs)
    c = range(3)
    own = lambda p: " + ".join(f"CASE WHEN {p}{i} > 0 THEN -({p}{i} / {p}n) * log2({p}{i} / {p}n) ELSE 0 END" for i in c)
    return f"""l{k} AS (SELECT leaf, attr, value, {", ".join(f"count(*) FILTER (WHERE cls = {i})::DOUBLE AS c{i}" for i in c)} FROM ({long}) GROUP BY ALL),
b{k} AS (SELECT leaf, attr, lead(value) OVER w AS value, count(*) OVER (PARTITION BY leaf, attr) AS vals, {", ".join(f"sum(c{i}) OVER (PARTITION BY leaf, attr ORDER BY value ROWS UNBOUNDED PRECEDING) AS b{i}, sum(c{i}) OVER (PARTITION BY leaf, attr) AS t{i}" for i in c)} FROM l{k} WINDOW w AS (PARTITION BY leaf, attr ORDER BY value)),
a{k} AS (SELECT *, {", ".join(f"t{i} - b{i} AS a{i}" for i in c)}, {" + ".join(f"b{i}" for i in c)} AS bn, {" + ".join(f"t{i} - b{i}" for i in c)} AS an, {" + ".join(f"t{i}" for i in c)} AS tn FROM b{k}),
x{k} AS (SELECT leaf, attr, value, tn, {own("t")} AS whole, (bn * ({own("b")}) + an * ({own("a")})) / tn + CASE WHEN vals > 2 THEN log2(vals - 1) / tn ELSE 0 END AS index FROM a{k} WHERE value IS NOT NULL),
o{k} AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY index, attr, value) AS place, lead(index) OVER (PARTITION BY leaf ORDER BY index, attr, value) AS second FROM x{k}),
d{k} AS (SELECT leaf, attr, value AS threshold FROM o{k} WHERE place = 1 AND whole > 0 AND whole > index AND (second - index > sqrt(log2(3) ** 2 * ln({len(attrs)} / 1e-7) / (2 * tn)) OR sqrt(log2(3) ** 2 * ln({len(attrs)} / 1e-7) / (2 * tn)) < 0.05)),
n{k} AS (SELECT r.leaf AS node, any_value(d.attr) AS attr, any_value(d.threshold) AS threshold, count(*) AS n, mode(r.cls) AS cls FROM r{k} r LEFT JOIN d{k} d ON r.leaf = d.leaf GROUP BY r.leaf),
r{k + 1} AS (SELECT r.* EXCLUDE (leaf), r.leaf || CASE WHEN CASE d.attr {" ".join(f"WHEN '{a}' THEN r.{a}" for a in attrs)} END < d.threshold THEN 'L' ELSE 'R' END AS leaf FROM r{k} r JOIN d{k} d ON r.leaf = d.leaf)"""


_GROWN = f"""{_SHARES}, r0 AS (SELECT {", ".join(ATTRS)}, {_CLS} AS cls, '' AS leaf, lower FROM lineitem JOIN e ON l_extendedprice = e.v), {_level(0)}, {_level(1)}, {_level(2)},
grown AS (SELECT node, CASE WHEN node <> '' THEN left(node, -1) END AS parent, length(node)::INT AS depth, CASE WHEN attr IS NULL THEN 'growing' ELSE 'split' END AS kind, attr, round(threshold, 6) AS threshold, cls::INT AS cls, n FROM (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2))"""


def _grown(s: SparkSession, d: str) -> tuple[DataFrame, dict[str, hoeffding.Node]]:
    x = learnable(s, d)
    return x, hoeffding.grow(x, ATTRS, "cls", 3)


def _table(s: SparkSession, nodes: dict[str, hoeffding.Node]) -> DataFrame:
    return hoeffding.table(s.range(1), nodes).withColumn("threshold", r6("threshold"))


query("vfdt_grow", f"WITH {_GROWN} SELECT * FROM grown")(lambda s, d: _table(s, _grown(s, d)[1]))
query("vfdt_depth_hist", f"WITH {_GROWN} SELECT depth, count(*) AS nodes FROM grown GROUP BY depth")(lambda s, d: _table(s, _grown(s, d)[1]).groupBy("depth").agg(F.count("*").alias("nodes")))
query("vfdt_tree_stats", f"WITH {_GROWN} SELECT max(depth) AS max_depth, count(*) AS nodes, count(*) FILTER (WHERE kind <> 'split') AS leaves FROM grown")(
    lambda s, d: _table(s, _grown(s, d)[1]).agg(F.max("depth").alias("max_depth"), F.count("*").alias("nodes"), F.count_if(F.col("kind") != "split").alias("leaves"))
)
query("vfdt_grow_accuracy", f"WITH {_GROWN}, last AS (SELECT leaf, cls FROM r1 WHERE leaf IN (SELECT node FROM grown WHERE kind = 'growing') UNION ALL SELECT leaf, cls FROM r2 WHERE leaf IN (SELECT node FROM grown WHERE kind = 'growing')) SELECT round(1 - sum(top) / sum(n), 6)::DOUBLE AS error_rate FROM (SELECT leaf, max(k) AS top, sum(k) AS n FROM (SELECT leaf, cls, count(*) AS k FROM last GROUP BY ALL) GROUP BY leaf)")(
    lambda s, d: (lambda x: evaluation.error_rate(evaluation.confusion(hoeffding.classify(*x), "cls", "pred")).select(r6("error_rate").alias("error_rate")))(_grown(s, d))
)


@query("vfdt_tree_json", f"WITH {_GROWN} SELECT 'depth ' || depth AS field, count(*)::DOUBLE AS value FROM grown GROUP BY depth UNION ALL SELECT 'maxDepth', max(depth) FROM grown UNION ALL SELECT 'nodes', count(*) FROM grown UNION ALL SELECT 'learnInstanceCount', count(*) FROM lineitem")
def _json(s: SparkSession, d: str) -> DataFrame:
    x, nodes = _grown(s, d)
    path = new_folder(s, "json")
    s.createDataFrame([(sinks.tree_json(_table(s, nodes), learnInstanceCount=nodes[""].n),)], "value string").write.text(path)
    got = s.read.option("multiLine", True).schema("depthToNodes map<string,double>, maxDepth double, nodes double, learnInstanceCount double").json(path)
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("maxDepth", "nodes", "learnInstanceCount")])
    depths = F.transform(F.map_entries("depthToNodes"), lambda e: F.struct(F.concat(F.lit("depth "), e["key"]).alias("field"), e["value"].alias("value")))
    return got.select(F.explode(F.concat(pairs, depths)).alias("p")).select("p.*")


@query("stream_tree", f"WITH {_GROWN} SELECT node, attr, threshold, n FROM grown")
def _stream_tree(s: SparkSession, d: str) -> DataFrame:
    """The same growth by micro-batches, here of one file."""
    tree = ingest.StreamingTree(ATTRS, "cls", 3)
    tree.edges = hoeffding.bin_edges(learnable(s, d), ATTRS, 1000)
    tree.edges = {a: tree.edges[a] for a in ATTRS}
    q = ingest.source(s, f"{d}/lineitem.parquet").withColumn("cls", F.expr(_CLS)).writeStream.foreachBatch(tree.update).trigger(availableNow=True).start()
    q.awaitTermination()
    return _table(s, tree.nodes).select("node", "attr", "threshold", "n")


_FEW = ["l_quantity", "l_discount", "l_tax"]


@query("vfdt_replicas", f"""WITH r0 AS (SELECT {", ".join(_FEW)}, {_CLS} AS cls, '' AS leaf FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k <= 20000), {_level(0, _FEW)}
SELECT node, attr, round(threshold, 6) AS threshold, n FROM n0 UNION ALL SELECT 'rows of both children', NULL, NULL, greatest(count(*) - 20000, 0) FROM lineitem""")
def _replicas(s: SparkSession, d: str) -> DataFrame:
    """Three replicas that exchange their statistics every 20,000 rows: the first split, made for all of them, and what came after it."""
    x = cut(_ordered(s, d))
    nodes = hoeffding.learn_replicas(x, _FEW, "cls", "_ord", 3, 3, hoeffding.Config(max_depth=1, prune=False, tie=0.05), window=20_000)
    after = hoeffding.routed(x.where(F.col("_ord") > nodes[""].at), nodes)
    return _table(s, nodes).where("node = ''").select("node", "attr", "threshold", "n").unionByName(after.agg(F.lit("rows of both children").alias("node"), F.lit(None).cast("string").alias("attr"), F.lit(None).cast("double").alias("threshold"), F.count("*").alias("n")))


_BYWORD = "SELECT o_orderpriority AS v, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS cls FROM orders"


def _words(s: SparkSession, d: str) -> tuple[DataFrame, dict[str, hoeffding.Node]]:
    x = read(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END").alias("cls"))
    return x, hoeffding.grow(x, ["o_orderpriority", "o_orderstatus", "o_totalprice"], "cls", 3)


query("vfdt_discrete_split", f"WITH w AS ({_BYWORD}) SELECT '' AS node, NULL AS parent, 'o_orderpriority' AS attr, count(*) AS n, mode(cls)::INT AS cls FROM w UNION ALL SELECT '<' || (row_number() OVER (ORDER BY v) - 1) || '>', '', NULL, count(*), max(cls)::INT FROM w GROUP BY v")(
    lambda s, d: _table(s, _words(s, d)[1]).select("node", "parent", "attr", "n", "cls")
)


@query("vfdt_unseen_value", f"WITH w AS ({_BYWORD}), k AS (SELECT v, (row_number() OVER (ORDER BY v) - 1) AS i, max(cls) AS cls FROM w GROUP BY v) SELECT o.o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '<?>' ELSE '<' || k.i || '>' END AS leaf, CASE WHEN o_orderkey % 2 = 0 THEN (SELECT mode(cls) FROM w) ELSE k.cls END::INT AS pred FROM orders o JOIN k ON k.v = o.o_orderpriority")
def _unseen(s: SparkSession, d: str) -> DataFrame:
    x, nodes = _words(s, d)
    return hoeffding.classify(x.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.lit("new")).otherwise(F.col("o_orderpriority"))), nodes).select("o_orderkey", "leaf", "pred")


_LATE = """SELECT ord, CASE WHEN ord < total / 2 AND o_orderpriority = '5-LOW' THEN '1-URGENT' ELSE o_orderpriority END AS v FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, count(*) OVER () AS total FROM orders)"""


@query("vfdt_learn_words", f"""WITH w AS ({_LATE}), r AS (SELECT v, count(*) FILTER (WHERE ord >= 300) AS n FROM w GROUP BY v)
SELECT '' AS node, NULL AS parent, 'v' AS attr, 300::BIGINT AS n, 0::BIGINT AS before UNION ALL
SELECT '<' || (row_number() OVER (ORDER BY v) - 1) || '>', '', NULL, n, (SELECT floor(300 * (count(*) FILTER (WHERE w.v = r.v) / 300.0))::BIGINT FROM w WHERE ord < 300) FROM r""")
def _learn_words(s: SparkSession, d: str) -> DataFrame:
    """Row by row with a text attribute; one of its values only comes in the second half, and gets a child that begins to grow then."""
    o = rows.with_running(read(s, d, "orders"), ["o_orderkey"])
    total = o.count()
    v = F.when((F.col("_ord") < total / 2) & (F.col("o_orderpriority") == "5-LOW"), "1-URGENT").otherwise(F.col("o_orderpriority"))
    x = cut(o.select("_ord", v.alias("v"), "o_orderstatus", "o_totalprice", F.when(v == "1-URGENT", 0).when(v == "2-HIGH", 1).otherwise(2).alias("cls")))
    nodes = hoeffding.learn(x, ["v", "o_orderstatus", "o_totalprice"], "cls", "_ord", 3)
    before = s.createDataFrame([(p, int(n.before)) for p, n in nodes.items()], "_p string, before long")
    return _table(s, nodes).join(F.broadcast(before), F.col("node") == F.col("_p")).select("node", "parent", "attr", "n", "before")


@query("vfdt_node_dump", f"SELECT leaf AS node, cls::BIGINT AS cls, ['A', 'N', 'R'][cls + 1] AS name, count(*) AS n, 'totals' AS kind, NULL AS attr, NULL AS value FROM {_PRED} GROUP BY ALL UNION ALL SELECT leaf, p.cls::BIGINT, ['A', 'N', 'R'][p.cls + 1], count(*), 'counts', 'l_linenumber', l_linenumber::VARCHAR FROM {_PRED} p GROUP BY ALL")
def _dump(s: SparkSession, d: str) -> DataFrame:
    """Per-node reports of the fixed tree, written and read back; classes by their names."""
    path = new_folder(s, "nodes")
    sinks.dump_nodes(_pred(s, d), hoeffding.table(s.range(1), _FIXED), "leaf", ["l_linenumber"], "cls", ["A", "N", "R"], path)
    totals = s.read.schema("cls long, name string, n long, node string").csv(f"{path}/totals").select("node", "cls", "name", "n", F.lit("totals").alias("kind"), F.lit(None).cast("string").alias("attr"), F.lit(None).cast("string").alias("value"))
    return totals.unionByName(s.read.schema("attr string, value string, cls long, name string, n long, node string").csv(f"{path}/counts").withColumn("kind", F.lit("counts")))


query("vfdt_test_stats_csv", f"WITH c AS (SELECT cls, pred, count(*) AS n FROM {_PRED} GROUP BY ALL) SELECT cls || ',' || sum(n)::BIGINT || ',' || coalesce(sum(n) FILTER (WHERE cls = pred), 0)::BIGINT || ',' || printf('%.3f', coalesce(sum(n) FILTER (WHERE cls = pred), 0) / sum(n)) || ',' || string_agg(pred || ':' || n, ',' ORDER BY pred || ':' || n) FILTER (WHERE cls <> pred) AS value FROM c GROUP BY cls")(
    lambda s, d: sinks.answer_lines(evaluation.confusion(_pred(s, d), "cls", "pred"))
)
_BINS = "SELECT floor(l_quantity / 10)::INT AS bin, 10.0 * floor(l_quantity / 10) AS lower, 10.0 * floor(l_quantity / 10) + 10 AS upper, count(*) AS n FROM lineitem GROUP BY ALL"
_bins = lambda s, d: read(s, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).cast("int").alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.col("bin") * 10.0).alias("lower"), (F.col("bin") * 10.0 + 10).alias("upper"), "n")
query("percent_below", f"SELECT round(sum(n * least(1.0, greatest(0.0, (17 - lower) / 10))) / sum(n), 6)::DOUBLE AS percent FROM ({_BINS})")(lambda s, d: impurity.percent_below(_bins(s, d), 17).select(r6("percent").alias("percent")))
_CUTS = f"""b AS (SELECT floor(l_quantity / 5)::INT AS bin, count(*) FILTER (WHERE cls = 0)::DOUBLE AS c0, count(*) FILTER (WHERE cls = 1)::DOUBLE AS c1, count(*) FILTER (WHERE cls = 2)::DOUBLE AS c2 FROM (SELECT l_quantity, {_CLS} AS cls FROM lineitem) GROUP BY 1),
r AS (SELECT bin, c0, c1, c2, sum(c0) OVER w AS b0, sum(c1) OVER w AS b1, sum(c2) OVER w AS b2, sum(c0) OVER () AS t0, sum(c1) OVER () AS t1, sum(c2) OVER () AS t2 FROM b WINDOW w AS (ORDER BY bin)),
g AS (SELECT bin, c0 + c1 + c2 AS n, bin < (SELECT max(bin) FROM b) AS inner_cut, (b0 + b1 + b2) * (1 - (b0 ** 2 + b1 ** 2 + b2 ** 2) / (b0 + b1 + b2) ** 2) AS low, (t0 + t1 + t2 - b0 - b1 - b2) AS an, (t0 - b0) ** 2 + (t1 - b1) ** 2 + (t2 - b2) ** 2 AS sq, t0 + t1 + t2 AS tn FROM r),
x AS (SELECT bin, n, CASE WHEN inner_cut THEN (low + an * (1 - sq / an ** 2)) / tn END AS index FROM g),
k AS (SELECT bin, n, CASE WHEN index IS NULL OR index <= (SELECT min(index) FROM x) + 0.00002 THEN bin END AS own FROM x)"""


@query("prune_bins", f"WITH {_CUTS} SELECT name AS bin, sum(n)::BIGINT AS n FROM (SELECT n, min(own) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS name FROM k) GROUP BY name")
def _prune(s: SparkSession, d: str) -> DataFrame:
    """Bins whose cut is worse than the best one by more than a bound join their right neighbour; each cut's index is measured."""
    x = read(s, d, "lineitem").select(F.floor(F.col("l_quantity") / 5).cast("int").alias("bin"), F.expr(_CLS).alias("cls"))
    b = x.groupBy("bin").agg(F.count("*").alias("n"), *[F.count_if(F.col("cls") == k).alias(f"c{k}") for k in range(3)])
    cuts = impurity.bin_cuts(b.select(F.lit("").alias("leaf"), F.lit("l_quantity").alias("attr"), "bin", "c0", "c1", "c2"), 3, gini=True).select(F.col("bin").alias("_next"), "index")
    limit = cuts.agg(F.min("index")).first()[0] + 0.00002
    above = b.select("bin").join(b.select(F.col("bin").alias("_b")), F.col("_b") > F.col("bin")).groupBy("bin").agg(F.min("_b").alias("_next"))  # eleven bins
    named = b.join(above, "bin", "left").join(cuts, "_next", "left").select("bin", "n", "index")
    return impurity.prune_bins(named, "index", limit).select("bin", "n")


query("class_sample", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n FROM c ORDER BY n >= (SELECT avg(n) FROM c) DESC, md5('7:' || label) LIMIT 4")(lambda s, d: evaluation.class_sample(read(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")), 4, 7))
query("class_summary", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT count(*) AS classes, sum(n)::BIGINT AS total, median(n)::DOUBLE AS median, avg(n) AS average, (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS largest FROM c")(
    lambda s, d: evaluation.class_summary(read(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")))
)
query("fix_child_index", """WITH n AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, CASE WHEN p_partkey > 1 THEN p_partkey % 2 END AS ci FROM part)
SELECT node, parent, (row_number() OVER (PARTITION BY parent ORDER BY ci NULLS FIRST, node) - 1)::BIGINT AS child_index FROM n WHERE parent IS NULL OR parent IN (SELECT node FROM n)""")(lambda s, d: evaluation.fixed_child_index(_nodes(s, d)))
query("path_index", "SELECT vec_id, (row_number() OVER (ORDER BY [vec_id % 3, vec_id % 9, vec_id]) - 1)::BIGINT AS pre_order FROM embeddings")(
    lambda s, d: evaluation.path_index(read(s, d, "embeddings").select("vec_id", F.array(F.col("vec_id") % 3, F.col("vec_id") % 9, F.col("vec_id")).alias("path")), "path").select("vec_id", "pre_order")
)
_X = "SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS q FROM embeddings"
query("birch_totals", f"SELECT count(*) AS n, round(sum(s), 4) AS ls, round(sum(q), 4) AS ss FROM ({_X})")(
    lambda s, d: (lambda e: e.agg(F.sum("cf.n").cast("long").alias("n"), F.round(F.sum(F.aggregate("cf.ls", F.lit(0.0), lambda t, v: t + v)), 4).alias("ls"), F.round(F.sum("cf.ss"), 4).alias("ss")))(birch.entry_table(*_tree(s, d)))
)


@query("birch_distinct_points", f"SELECT vec_id AS id, 0.0::DOUBLE AS distance, round(s, 6) AS ls FROM ({_X})")
def _distinct(s: SparkSession, d: str) -> DataFrame:
    """With a threshold that nothing is below, every point is its own entry: the nearest entry of each point is that point."""
    e = read(s, d, "embeddings")
    entries = cftree.tree(cftree.entries(e, "embedding", threshold=0.0)).where("kind = 'entry'").select("cluster", "cf")
    got = birch.assign(e, "vec_id", "embedding", entries, equal=True)
    sums = entries.select(F.col("cluster").alias("c"), F.round(F.aggregate("cf.ls", F.lit(0.0), lambda t, v: t + v), 6).alias("ls"))
    return got.join(sums, F.col("cluster") == F.col("c")).select("id", r6("distance").alias("distance"), "ls")


_GRID = "SELECT l_quantity::DOUBLE AS q, l_linenumber::DOUBLE AS k, count(*) AS n FROM lineitem GROUP BY 1, 2"


def _grid(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Points on whole numbers, a threshold under their distance: an entry for each distinct point, far fewer than points."""
    x = read(s, d, "lineitem").select(F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")).alias("x"))
    return x, cftree.entries(x, "x", threshold=0.5)


query("birch_entries_rounds", f"SELECT q, k, n::DOUBLE AS n, round(n * (q * q + k * k), 3)::DOUBLE AS ss FROM ({_GRID})")(
    lambda s, d: _grid(s, d)[1].select(F.round(F.col("ls")[0] / F.col("n"), 6).alias("q"), F.round(F.col("ls")[1] / F.col("n"), 6).alias("k"), "n", F.round("ss", 3).alias("ss"))
)


@query("birch_tree_adds_up", f"SELECT count(*) AS entries, sum(n)::DOUBLE AS points, round(sum(n * q), 2)::DOUBLE AS ls, true AS narrow, true AS sums FROM ({_GRID})")
def _adds_up(s: SparkSession, d: str) -> DataFrame:
    """A tree over those entries: no node has more than ten children, and every node is the sum of its children."""
    t = cftree.tree(_grid(s, d)[1], each=50)
    name = lambda p: F.concat_ws("/", p)
    kids = t.where(F.size("path") > 0).groupBy(name(F.slice("path", F.lit(1), F.size("path") - 1)).alias("up")).agg(F.count("*").alias("kids"), F.sum("cf.n").alias("kn"), F.sum(F.col("cf.ls")[0]).alias("kl"))
    both = t.withColumn("node", name("path")).join(kids, F.col("node") == F.col("up"), "left")
    ok = (F.col("kind") == "entry") | ((F.abs(F.col("kn") - F.col("cf.n")) < 1e-6) & (F.abs(F.col("kl") - F.col("cf.ls")[0]) < 1e-3))
    return both.agg(F.count_if(F.col("kind") == "entry").alias("entries"), F.max("cf.n").alias("points"), F.round(F.max(F.when(F.size("path") == 0, F.col("cf.ls")[0])), 2).alias("ls"), (F.max(F.coalesce("kids", F.lit(0))) <= 10).alias("narrow"), F.coalesce(F.bool_and(ok), F.lit(False)).alias("sums"))


@query("birch_descent", f"SELECT s_suppkey, min(d)::DOUBLE AS distance FROM (SELECT s_suppkey, round((s_suppkey % 60 - 0.3 - q) ** 2 + (s_suppkey % 9 + 0.2 - k) ** 2, 6) AS d FROM supplier, ({_GRID})) GROUP BY 1")
def _descent(s: SparkSession, d: str) -> DataFrame:
    """Each supplier's nearest entry, down the tree level by level."""
    t = cftree.tree(_grid(s, d)[1], each=50)
    x = F.array((F.col("s_suppkey") % 60 - 0.3).cast("double"), (F.col("s_suppkey") % 9 + 0.2).cast("double"))
    got = cftree.descend(cftree.as_points(read(s, d, "supplier").withColumn("x", x), "s_suppkey", "x"), t)
    return got.select(F.col("id").alias("s_suppkey"), r6("distance").alias("distance"))


@query("birch_event_log", "SELECT count(*)::DOUBLE AS points, count(*) AS insertions, round(sum(l_quantity), 2)::DOUBLE AS ls, 0::BIGINT AS odd FROM lineitem")
def _event_log(s: SparkSession, d: str) -> DataFrame:
    """Trees of four ranges of lineitem, or of more where these would be large, logged event by event, then rebuilt from their logs: all points are in, and every entry was added once."""
    x = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")).alias("x"))
    log = written(cflog.logged(x, "x", ["l_orderkey", "l_linenumber"], 4, threshold=0.5))
    tree = written(cflog.replay(log))
    tops = tree.where(F.size("path") == 0).agg(F.sum("n").alias("points"), F.round(F.sum(F.col("ls")[0]), 2).alias("ls"))
    inserted = log.agg(F.count_if(F.col("kind").isin("add", "absorb")).alias("insertions"), F.count_if(F.col("kind") == "add").alias("_added"))
    entries = tree.agg(F.count_if(F.col("kind") == "entry").alias("_entries"))
    return tops.crossJoin(inserted).crossJoin(entries).select("points", "insertions", "ls", (F.col("_added") - F.col("_entries")).alias("odd"))  # one row each


_PARENTS = "SELECT p_partkey AS node, CASE WHEN p_partkey = 1 THEN NULL WHEN p_partkey % 97 = 0 THEN -p_partkey WHEN p_partkey = 5 THEN 10 ELSE p_partkey // 2 END AS parent, p_size AS w FROM part"
_WALKED = f"""RECURSIVE n AS ({_PARENTS}), t AS (SELECT node, parent, w, CASE WHEN parent IS NULL THEN 'ok' ELSE 'orphan' END AS status, 0 AS depth, node AS top, [node] AS path FROM n WHERE parent IS NULL OR parent NOT IN (SELECT node FROM n)
UNION ALL SELECT n.node, n.parent, n.w, t.status, t.depth + 1, t.top, list_append(t.path, n.node) FROM n JOIN t ON n.parent = t.node)"""


def _parents(s: SparkSession, d: str) -> DataFrame:
    """A binary tree of parts, with missing parents and a cycle in it."""
    k = F.col("p_partkey")
    up = F.when(k == 1, F.lit(None)).when(k % 97 == 0, -k).when(k == 5, F.lit(10)).otherwise(F.floor(k / 2))
    return hierarchy.hierarchy(read(s, d, "part").select(k.alias("node"), up.cast("long").alias("parent"), F.col("p_size").alias("w")), weight="w")


query("tree_paths", f"""WITH {_WALKED} SELECT n.node, n.parent, coalesce(status, 'cycle') AS status, depth::BIGINT AS depth, top, array_to_string(path, '/') AS path FROM n LEFT JOIN t ON n.node = t.node""")(
    lambda s, d: _parents(s, d).select("node", "parent", "status", "depth", "top", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))
)
query("tree_pre_order", f"WITH {_WALKED} SELECT node, (row_number() OVER (ORDER BY path) - 1)::BIGINT AS pre_order FROM t")(lambda s, d: _parents(s, d).where("pre_order IS NOT NULL").select("node", "pre_order"))
query("tree_subtree_sums", f"WITH {_WALKED} SELECT up AS node, count(*) AS size, sum(w)::DOUBLE AS total FROM (SELECT unnest(path) AS up, w FROM t) GROUP BY up")(
    lambda s, d: _parents(s, d).where("size IS NOT NULL").select("node", "size", "total")
)


_PART = "SELECT vec_id % 3 AS i, vec_id % 9 AS j, count(*)::DOUBLE AS n, sum(embedding[1]::DOUBLE) AS ls, sum(embedding[1]::DOUBLE ** 2) AS ss FROM embeddings GROUP BY ALL"


def _damaged(s: SparkSession, d: str) -> DataFrame:
    """Nine entries under three nodes in the places 0, 2 and 4; the second says a point too many, the third is lost."""
    x = F.array(F.col("embedding")[0].cast("double"))
    e = clustering.features(read(s, d, "embeddings").select(F.array((F.col("vec_id") % 3 * 2).cast("int"), (F.col("vec_id") % 9).cast("int")).alias("path"), x.alias("x")), ["path"], "x")
    e = e.select("path", F.struct(F.col("n").cast("double").alias("n"), "ls", "ss").alias("cf"), F.col("path")[1].cast("long").alias("cluster"))
    nodes = upkeep.with_inner(e).where(F.col("path") != F.array(F.lit(4)))
    return nodes.withColumn("cf", F.when(F.col("path") == F.array(F.lit(2)), F.col("cf").withField("n", F.col("cf.n") + 1)).otherwise(F.col("cf")))


_place = lambda: F.concat_ws("/", "path").alias("path")
query("birch_inconsistencies", f"""WITH e AS ({_PART}) SELECT (2 * i) || '/' || j AS path, 'entry' AS kind, i = 2 AS orphan, 0::BIGINT AS children, false AS gaps, NULL::DOUBLE AS n_off FROM e
UNION ALL SELECT DISTINCT (2 * i)::VARCHAR, 'node', false, count(*) OVER (PARTITION BY i), true, CASE WHEN i = 1 THEN 1.0 ELSE 0.0 END FROM e WHERE i < 2 UNION ALL SELECT '', 'node', false, 2, true, sum(CASE WHEN i = 2 THEN n ELSE 0 END) - 1 FROM e""")(
    lambda s, d: upkeep.inconsistencies(_damaged(s, d)).select(_place(), "kind", "orphan", "children", "gaps", "n_off")
)
query("birch_repaired", f"""WITH e AS (SELECT * FROM ({_PART}) WHERE i < 2) SELECT i || '/' || (j // 3) AS path, 'entry' AS kind, n, round(ls, 4) AS ls, round(ss, 4) AS ss FROM e
UNION ALL SELECT i::VARCHAR, 'node', sum(n), round(sum(ls), 4), round(sum(ss), 4) FROM e GROUP BY i UNION ALL SELECT '', 'node', sum(n), round(sum(ls), 4), round(sum(ss), 4) FROM e""")(
    lambda s, d: upkeep.repaired(_damaged(s, d)).select(_place(), "kind", F.col("cf.n").alias("n"), F.round(F.col("cf.ls")[0], 4).alias("ls"), F.round("cf.ss", 4).alias("ss"))
)


@query("save_tree_features", f"SELECT i || '/' || j AS node, 2::BIGINT AS depth, 'entry' AS kind, n, round(ls, 4) AS ls, round(ss, 4) AS ss FROM ({_PART}) WHERE i < 2 UNION ALL SELECT i::VARCHAR, 1, 'node', sum(n), round(sum(ls), 4), round(sum(ss), 4) FROM ({_PART}) WHERE i < 2 GROUP BY i UNION ALL SELECT '', 0, 'node', sum(n), round(sum(ls), 4), round(sum(ss), 4) FROM ({_PART}) WHERE i < 2")
def _saved_features(s: SparkSession, d: str) -> DataFrame:
    """The features of all nodes of a tree of six entries, saved beside its members and read back."""
    x = read(s, d, "embeddings").where("vec_id % 3 < 2").select(F.col("vec_id").alias("id"), F.array((F.col("vec_id") % 3).cast("int"), (F.col("vec_id") % 9).cast("int")).alias("path"), F.array(F.col("embedding")[0].cast("double")).alias("x"))
    e = clustering.features(x, ["path"], "x").select("path", F.struct(F.col("n").cast("double").alias("n"), "ls", "ss").alias("cf"), F.col("path")[1].cast("long").alias("cluster"))
    path = new_folder(s, "featured")
    sinks.save_tree(x.select("id", "path"), path, upkeep.with_inner(e))
    back = s.read.schema("node string, depth long, kind string, n double, ss double, ls array<double>").json(f"{path}/features")
    return back.select("node", "depth", "kind", "n", F.round(F.col("ls")[0], 4).alias("ls"), F.round("ss", 4).alias("ss"))


@query("nearest_by_function", """WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: avg_i[i]) AS m FROM (SELECT label, list(a ORDER BY i) AS avg_i FROM (SELECT label, i, avg(x::DOUBLE) AS a FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL) GROUP BY label)),
x AS (SELECT vec_id AS id, c.label AS cluster, list_max(list_transform(range(1, 65), lambda i: abs(embedding[i]::DOUBLE - m[i]))) AS d FROM embeddings e CROSS JOIN c)
SELECT id, round(min(d), 6) AS distance FROM x GROUP BY id""")
def _by_function(s: SparkSession, d: str) -> DataFrame:
    """Each vector's least Chebyshev distance to a label's centre: a distance given as a function."""
    v = read(s, d, "embeddings")
    points = v.select(F.col("vec_id").alias("id"), F.struct(F.lit(1.0).alias("n"), F.transform("embedding", lambda t: t.cast("double")).alias("ls"), F.lit(0.0).alias("ss")).alias("cf"))
    centres = clustering.features(v, ["label"], "embedding").select(F.col("label").cast("long").alias("cluster"), F.struct(F.col("n").cast("double").alias("n"), "ls", "ss").alias("cf"))
    chebyshev = lambda a, b: F.array_max(F.zip_with(a["ls"], b["ls"], lambda p, q: F.abs(p / a["n"] - q / b["n"])))
    return clustering.nearest(points, centres, chebyshev).select("id", r6("distance").alias("distance"))


@query("birch_tree_json", f"SELECT count(*) AS entries, sum(n)::BIGINT AS points, 10::BIGINT AS branching, 0.5::DOUBLE AS threshold, 'd0' AS distance, true AS deep FROM ({_GRID})")
def _birch_json(s: SparkSession, d: str) -> DataFrame:
    """Counts and parameters of a tree as JSON, written and read back; its depths add up to its nodes."""
    x, e = _grid(s, d)
    t = cftree.tree(e, each=50)
    text = sinks.tree_json(t.select(F.size("path").alias("depth")), branching=10, threshold=0.5, distance="d0", points=x.count(), entries=t.where("kind = 'entry'").count())
    path = new_folder(s, "birch-json")
    s.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    got = s.read.option("multiLine", True).schema("depthToNodes map<string,long>, maxDepth long, nodes long, branching long, threshold double, distance string, points long, entries long").json(path)
    total = F.aggregate(F.map_values("depthToNodes"), F.lit(0).cast("long"), lambda a, b: a + b)
    return got.select("entries", "points", "branching", "threshold", "distance", ((total == F.col("nodes")) & (F.col("maxDepth") >= 1) & (F.col("nodes") > F.col("entries"))).alias("deep"))
