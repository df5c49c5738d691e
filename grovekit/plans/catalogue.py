"""Every query of the library outside ``llm``, with its DuckDB SQL. Doubles are rounded to 6 places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..lineage import cut
from ..operators import birch, clustering, evaluation, hoeffding, impurity, preprocess, profile, rows
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(s: SparkSession, d: str, t: str) -> DataFrame:
    return s.read.parquet(f"{d}/{t}.parquet")


def r6(c: F.Column | str) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# Preprocessing

query("pre_select", "SELECT c_custkey, c_mktsegment, c_custkey AS c_custkey_2, '' AS missing FROM customer")(lambda s, d: preprocess.Pipeline().select("c_custkey", "c_mktsegment", "c_custkey", "missing").apply(read(s, d, "customer")))
query("pre_clip", "SELECT c_custkey, greatest(least(c_acctbal, 5000.0), 0.0)::DOUBLE AS c_acctbal FROM customer")(lambda s, d: preprocess.Pipeline().clip(5000.0, 0.0, "c_acctbal").select("c_custkey", "c_acctbal").apply(read(s, d, "customer")))
query("pre_log10", "SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN '-inf'::DOUBLE WHEN c_acctbal < 0 THEN 'nan'::DOUBLE ELSE round(log10(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 6) END AS v FROM customer")(
    lambda s, d: read(s, d, "customer").select("c_custkey", r6(S.log10(F.col("c_acctbal"))).alias("v"))
)
query("pre_signed_log", "SELECT c_custkey, round((greatest(least(CASE WHEN c_acctbal = 0 THEN -3.0 WHEN c_acctbal < 0 THEN -log10(CASE WHEN c_acctbal < 0 THEN -c_acctbal END) ELSE log10(CASE WHEN c_acctbal > 0 THEN c_acctbal END) END, 3.0), -3.0) + 3.0) / 6.0, 6)::DOUBLE AS v FROM customer")(
    lambda s, d: read(s, d, "customer").select("c_custkey", r6(S.signed_log(F.col("c_acctbal"), -3, 3)).alias("v"))
)
query("pre_normalize", "SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS o_totalprice FROM orders")(
    lambda s, d: rounded(preprocess.normalize(read(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), "o_totalprice")
)
query("pre_pipeline", """WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN greatest(least(l_extendedprice, 50000.0), 100.0) > 0 THEN log10(greatest(least(l_extendedprice, 50000.0), 100.0)) END AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS l_quantity, round((p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()), 6) AS l_extendedprice FROM c""")(
    lambda s, d: rounded(preprocess.Pipeline().clip(100.0, 50000.0, "l_extendedprice").log("l_extendedprice").normalize("l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").apply(read(s, d, "lineitem")), "l_quantity", "l_extendedprice")
)
query("pre_hash_java", """SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(p_type) + 1), lambda i: ascii(substr(p_type, i::INT, 1))::BIGINT)),
 lambda h, x: (31 * h + x + 2147483648) % 4294967296 - 2147483648)::INT AS h FROM part""".replace("(31 * h + x + 2147483648) % 4294967296 - 2147483648", "((31 * h + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"))(lambda s, d: read(s, d, "part").select("p_partkey", S.string_hash(F.col("p_type")).alias("h")))
query("pre_hash_md5", """SELECT p_partkey, list_reduce(list_prepend(1::BIGINT, list_transform(range(0, 16), lambda i: (instr('0123456789abcdef', substr(md5(p_type), (2 * i + 1)::INT, 1)) - 1) * 16 + instr('0123456789abcdef', substr(md5(p_type), (2 * i + 2)::INT, 1)) - 1)),
 lambda h, x: ((31 * h + (CASE WHEN x > 127 THEN x - 256 ELSE x END) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::INT AS h FROM part""")(lambda s, d: read(s, d, "part").select("p_partkey", S.md5_fold(F.col("p_type")).alias("h")))
query("pre_extract", "SELECT o_orderkey, o_totalprice AS v FROM orders")(lambda s, d: read(s, d, "orders").select("o_orderkey", S.extract(F.col("o_totalprice").cast("string")).alias("v")))
query("pre_extract_minmax", "SELECT p_partkey, round((greatest(least(p_retailprice, 1500), 1000) - 1000) / 500.0, 6)::DOUBLE AS v FROM part")(lambda s, d: read(s, d, "part").select("p_partkey", r6(S.min_max(F.col("p_retailprice"), 1000, 1500)).alias("v")))
query("pre_extract_z", "SELECT p_partkey, round((p_retailprice - 1200) / 300.0, 6)::DOUBLE AS v FROM part")(lambda s, d: read(s, d, "part").select("p_partkey", r6(S.z_score(F.col("p_retailprice"), 1200, 300)).alias("v")))
query("pre_enum_ordinal", "SELECT o_orderkey, coalesce(list_position(['F', 'O'], o_orderstatus) - 1, -1)::BIGINT AS v FROM orders")(lambda s, d: read(s, d, "orders").select("o_orderkey", S.ordinal(F.col("o_orderstatus"), ["F", "O"]).alias("v")))
query("pre_default_cast", "SELECT event_id, coalesce(try_cast(event_type AS BIGINT), -1) AS v FROM events")(lambda s, d: read(s, d, "events").select("event_id", S.or_default(F.col("event_type"), "long", -1).alias("v")))
query("pre_sniff", "SELECT p_partkey, CASE WHEN p_retailprice::VARCHAR LIKE '%.%' THEN 'double' ELSE 'long' END AS kind, 'string' AS name_kind FROM part")(lambda s, d: read(s, d, "part").select("p_partkey", S.sniff(F.col("p_retailprice").cast("string")).alias("kind"), S.sniff(F.col("p_name")).alias("name_kind")))
query("pre_minmax_points", """WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, min(x) AS lo, max(x) AS hi FROM l GROUP BY i)
SELECT vec_id, i - 1 AS dim, round((x - lo) / (hi - lo), 6) AS v FROM l JOIN m USING (i)""")(
    lambda s, d: preprocess.normalize_points(read(s, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("dim", "v")).select("vec_id", F.col("dim").cast("long").alias("dim"), r6("v").alias("v"))
)

# Rows

_ORD = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS o FROM orders)"
_DOC = "(SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS o, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS t FROM documents)"
_docs = lambda s, d: read(s, d, "documents").select("doc_id", "n_chars")
_keys = lambda s, d: read(s, d, "orders").select("o_orderkey", "o_totalprice")
query("row_skip", f"SELECT o_orderkey, o_totalprice FROM {_ORD} WHERE o >= 100")(lambda s, d: rows.skip(_keys(s, d), ["o_orderkey"], 100))
query("row_select", f"SELECT o_orderkey, o_totalprice FROM {_ORD} WHERE o IN (0, 3, 10, 11, 12)")(lambda s, d: rows.pick(_keys(s, d), ["o_orderkey"], rows.parse_ranges("0,3,10-13")))
query("row_max", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")(lambda s, d: rows.limit_rows(_keys(s, d), ["o_orderkey"], 500))
query("row_max_bytes", f"SELECT doc_id, n_chars FROM {_DOC} WHERE t < 200000")(lambda s, d: rows.limit_bytes(_docs(s, d), ["doc_id"], F.col("n_chars"), rows.parse_size("200k")))
query("row_split_rows", f"SELECT o_orderkey, o_totalprice, (o // 1000)::BIGINT AS file_no FROM {_ORD}")(lambda s, d: rows.split_rows(_keys(s, d), ["o_orderkey"], 1000))
query("row_split_bytes", f"""WITH RECURSIVE d AS (SELECT doc_id, n_chars, o FROM {_DOC}), f(o, doc_id, n_chars, held, file_no) AS (SELECT o, doc_id, n_chars, n_chars, 0::BIGINT FROM d WHERE o = 0
UNION ALL SELECT d.o, d.doc_id, d.n_chars, CASE WHEN f.held + d.n_chars >= 50000 THEN d.n_chars ELSE f.held + d.n_chars END, f.file_no + CASE WHEN f.held + d.n_chars >= 50000 THEN 1 ELSE 0 END FROM f JOIN d ON d.o = f.o + 1)
SELECT doc_id, n_chars, file_no FROM f""")(lambda s, d: rows.split_bytes(_docs(s, d), ["doc_id"], "n_chars", 50_000))
query("input_limit", f"SELECT doc_id, n_chars FROM {_DOC} WHERE o < 300 AND t <= 400000")(lambda s, d: rows.limit_input(_docs(s, d), ["doc_id"], F.col("n_chars"), 300, 400_000))
query("target_class_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")(lambda s, d: read(s, d, "events").where(F.col("event_type").isin("click", "view")).select("event_id", "event_type"))
query("unlabelled_filter", "SELECT vec_id, label FROM embeddings WHERE label <> 0")(lambda s, d: read(s, d, "embeddings").where("label <> 0").select("vec_id", "label"))

# Profiles

_EV = ["event_type", "value", "user_id", "event_id"]
_STACK = "(SELECT 'event_type' AS \"column\", event_type AS value FROM events UNION ALL SELECT 'value', round(value, 2)::DECIMAL(18,2)::VARCHAR FROM events UNION ALL SELECT 'user_id', user_id::VARCHAR FROM events UNION ALL SELECT 'event_id', event_id::VARCHAR FROM events)"
_events = lambda s, d: read(s, d, "events").select("event_type", F.round("value", 2).cast("decimal(18,2)").alias("value"), "user_id", "event_id")
_TYPES = f"""SELECT "column", count(*) AS cells, count(*) FILTER (WHERE value IS NULL OR value = '') AS n_empty, count(*) FILTER (WHERE value = '?') AS n_unknown,
 count(*) FILTER (WHERE regexp_full_match(value, '[+-]?[0-9]+')) AS n_integer, count(*) FILTER (WHERE NOT regexp_full_match(value, '[+-]?[0-9]+') AND try_cast(value AS DOUBLE) IS NOT NULL) AS n_double,
 count(*) FILTER (WHERE value <> '' AND value <> '?' AND try_cast(value AS DOUBLE) IS NULL) AS n_string, max(length(value))::BIGINT AS max_length FROM {_STACK} GROUP BY 1"""
query("profile_types", _TYPES)(lambda s, d: profile.types(_events(s, d), _EV))
query("profile_minmax", f'SELECT "column", min(try_cast(value AS DOUBLE)) AS min_number, max(try_cast(value AS DOUBLE)) AS max_number FROM {_STACK} GROUP BY 1')(lambda s, d: profile.number_range(_events(s, d), _EV))
query("profile_topk", f'SELECT * FROM (SELECT "column", value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS rank FROM {_STACK} GROUP BY 1, 2) WHERE rank <= 30')(lambda s, d: profile.top_values(_events(s, d), _EV))
query("profile_schema", f"""WITH t AS ({_TYPES}), u AS (SELECT "column", count(DISTINCT value) AS n_distinct FROM {_STACK} WHERE value NOT IN ('', '?') GROUP BY 1)
SELECT "column", n_distinct, CASE WHEN n_distinct < 100 AND n_double = 0 THEN 'enum' WHEN n_double > 0 AND n_string = 0 THEN 'real' WHEN n_integer > 0 AND n_string = 0 THEN 'integer' ELSE 'string' END AS kind FROM t JOIN u USING ("column")""")(lambda s, d: profile.inferred_schema(_events(s, d), _EV))
query("input_range_stats", f'SELECT "column", min(try_cast(value AS DOUBLE)) AS lowest, max(try_cast(value AS DOUBLE)) AS highest, count(*) FILTER (WHERE try_cast(value AS DOUBLE) < 10) AS below, count(*) FILTER (WHERE try_cast(value AS DOUBLE) > 50) AS above FROM {_STACK} GROUP BY 1')(lambda s, d: profile.range_stats(_events(s, d), _EV, 10, 50))
query("line_stats", "SELECT count(*) AS lines, count(*) FILTER (WHERE text = '') AS empty_lines, max(strlen(text) + 1)::BIGINT AS longest FROM documents")(lambda s, d: profile.line_stats(read(s, d, "documents"), "text"))
query("class_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")(lambda s, d: read(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")))
query("distinct_classes", "SELECT count(DISTINCT label) AS classes FROM embeddings")(lambda s, d: read(s, d, "embeddings").agg(F.countDistinct("label").alias("classes")))
query("consecutive_distance", """WITH p AS (SELECT vec_id, label, embedding, lag(embedding) OVER w AS prev, row_number() OVER w AS n FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, label, round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - prev[i]::DOUBLE) ** 2)), 6) AS distance FROM p WHERE prev IS NOT NULL AND n % 2 = 0""")(
    lambda s, d: rounded(profile.consecutive(read(s, d, "embeddings"), ["label"], ["vec_id"], F.aggregate(F.zip_with("embedding", "_previous", lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)), F.lit(0.0), lambda t, x: t + x), "embedding", 2), "distance").select("vec_id", "label", "distance")
)

# Split statistics

ATTRS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CLS = "CASE WHEN l_quantity < 17 THEN 0 WHEN l_discount < 0.05 THEN 1 ELSE 2 END"


def learnable(s: SparkSession, d: str) -> DataFrame:
    """lineitem with a class that its attributes decide."""
    return read(s, d, "lineitem").select(*ATTRS, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.expr(_CLS).alias("cls"))


_MELT = "(" + " UNION ALL ".join(f"SELECT '{a}' AS attr, {a}::DOUBLE AS value, {_CLS} AS cls FROM lineitem" for a in ATTRS) + ")"
_CUTS = f"""c AS (SELECT attr, value, cls, count(*) AS n FROM {_MELT} GROUP BY ALL),
g AS (SELECT a.attr, a.value, k.cls, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT attr, value FROM c) a CROSS JOIN (SELECT DISTINCT cls FROM c) k LEFT JOIN c ON c.attr = a.attr AND c.value = a.value AND c.cls = k.cls),
r AS (SELECT *, sum(n) OVER (PARTITION BY attr, cls ORDER BY value ROWS UNBOUNDED PRECEDING) AS b, sum(n) OVER (PARTITION BY attr, cls) AS t FROM g),
p AS (SELECT attr, value, b::DOUBLE AS b, (t - b)::DOUBLE AS a, sum(b) OVER w AS bn, sum(t - b) OVER w AS an FROM r WINDOW w AS (PARTITION BY attr, value)),
q AS (SELECT attr, value, bn, an, 1 - sum(CASE WHEN bn > 0 THEN (b / bn) ** 2 ELSE 0 END) AS bg, 1 - sum(CASE WHEN an > 0 THEN (a / nullif(an, 0)) ** 2 ELSE 0 END) AS ag,
 sum(CASE WHEN b > 0 THEN -(b / bn) * log2(CASE WHEN b > 0 THEN b / bn END) ELSE 0 END) AS be, sum(CASE WHEN a > 0 THEN -(a / nullif(an, 0)) * log2(CASE WHEN a > 0 THEN a / nullif(an, 0) END) ELSE 0 END) AS ae FROM p GROUP BY attr, value, bn, an),
k AS (SELECT attr, value, bn::BIGINT AS below_n, an::BIGINT AS above_n, bn / (bn + an) * bg + an / (bn + an) * ag AS gini, bn / (bn + an) * be + an / (bn + an) * ae AS entropy FROM q WHERE an > 0),
m AS (SELECT *, entropy + CASE WHEN count(*) OVER (PARTITION BY attr) > 1 THEN log2(count(*) OVER (PARTITION BY attr)) / (below_n + above_n) ELSE 0 END AS index FROM k)"""
_NODE = f"nd AS (SELECT sum(n) AS n, 1 - sum(p * p) AS gini, -sum(p * log2(p)) AS entropy FROM (SELECT n, n / sum(n) OVER () AS p FROM (SELECT {_CLS} AS cls, count(*) AS n FROM lineitem GROUP BY 1)))"
query("class_totals", "SELECT l_returnflag AS cls, count(*) AS n FROM lineitem GROUP BY 1")(lambda s, d: impurity.class_totals(read(s, d, "lineitem"), "l_returnflag"))
query("attr_class_counts", "SELECT 'o_orderpriority' AS attr, o_orderpriority AS value, o_orderstatus AS cls, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, o_orderstatus, count(*) FROM orders GROUP BY ALL")(
    lambda s, d: impurity.discrete_counts(read(s, d, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"), "o_orderstatus"), ["o_orderpriority", "year"], "o_orderstatus")
)
_node = lambda s, d: impurity.node_impurity(learnable(s, d), "cls")
query("node_gini", f"WITH {_NODE} SELECT n::BIGINT AS n, round(gini, 6) AS gini FROM nd")(lambda s, d: _node(s, d).select("n", r6("gini").alias("gini")))
query("node_entropy", f"WITH {_NODE} SELECT n::BIGINT AS n, round(entropy, 6) AS entropy FROM nd")(lambda s, d: _node(s, d).select("n", r6("entropy").alias("entropy")))
_DISC = """WITH c AS (SELECT 'o_orderpriority' AS attr, o_orderpriority AS value, o_orderstatus AS cls, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, o_orderstatus, count(*) FROM orders GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY attr, value) AS p FROM c), v AS (SELECT attr, value, sum(n) AS nv, 1 - sum(p * p) AS g, -sum(p * log2(p)) AS e FROM p GROUP BY 1, 2)
SELECT attr, round(sum(nv * g) / sum(nv), 6) AS gini, round(sum(nv * e) / sum(nv), 6) AS entropy FROM v GROUP BY attr"""
_disc = lambda s, d: rounded(impurity.discrete_index(QUERIES["attr_class_counts"](s, d)), "gini", "entropy")
query("gini_discrete", f"SELECT attr, gini FROM ({_DISC})")(lambda s, d: _disc(s, d).select("attr", "gini"))
query("entropy_discrete", f"SELECT attr, entropy FROM ({_DISC})")(lambda s, d: _disc(s, d).select("attr", "entropy"))
_cuts = lambda s, d: impurity.cuts(learnable(s, d).select("l_quantity", "l_discount", "l_tax", "l_extendedprice", "cls"), ATTRS, "cls")
query("gini_string", """WITH p AS (SELECT event_type, props, n / sum(n) OVER (PARTITION BY props) AS p, n FROM (SELECT event_type, props, count(*) AS n FROM events GROUP BY ALL)), v AS (SELECT props, sum(n) AS nv, 1 - sum(p * p) AS g FROM p GROUP BY 1)
SELECT 'props' AS attr, round(sum(nv * g) / sum(nv), 6) AS gini FROM v""")(lambda s, d: rounded(impurity.discrete_index(impurity.discrete_counts(read(s, d, "events"), ["props"], "event_type")), "gini").select("attr", "gini"))
query("gini_continuous", f"WITH {_CUTS} SELECT attr, value, below_n, above_n, round(gini, 6) AS gini FROM k")(lambda s, d: rounded(_cuts(s, d), "gini").drop("entropy", "cuts"))
query("entropy_continuous_mdl", f"WITH {_CUTS} SELECT attr, value, below_n, above_n, round(index, 6) AS index FROM m")(lambda s, d: rounded(impurity.with_mdl(_cuts(s, d)), "index").drop("gini", "entropy"))
query("split_top2", f"WITH {_CUTS} SELECT attr, value, below_n, above_n, round(gini, 6) AS gini, round(entropy, 6) AS entropy, round(index, 6) AS index, row_number() OVER (ORDER BY index, attr, value) AS rank FROM m ORDER BY index, attr, value LIMIT 2")(
    lambda s, d: rounded(impurity.best_cuts(impurity.with_mdl(_cuts(s, d))), "gini", "entropy", "index")
)
query("hoeffding_bound", "SELECT l_linenumber AS k, count(*) AS n, round(sqrt(log2(3) ** 2 * ln(4 / 1e-7) / (2 * count(*))), 6) AS bound FROM lineitem GROUP BY 1")(
    lambda s, d: read(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.count("*").alias("n")).withColumn("bound", r6(impurity.hoeffding_bound(F.col("n"), 1e-7, 4, 1.584962500721156)))
)
query("check_split", f"""WITH {_CUTS}, {_NODE}, f AS (SELECT *, row_number() OVER (ORDER BY index, attr, value) AS rank FROM m),
x AS (SELECT a.attr, a.value AS threshold, a.index AS first, b.index AS second, nd.entropy AS null_index, sqrt(log2(3) ** 2 * ln(4 / 1e-7) / (2 * nd.n)) AS bound FROM f a, f b, nd WHERE a.rank = 1 AND b.rank = 2)
SELECT attr, threshold, round(first, 6) AS first, round(second, 6) AS second, round(null_index, 6) AS null_index, round(bound, 6) AS bound, CASE WHEN first - null_index > bound THEN 'leaf' WHEN second - first > bound THEN 'split' WHEN bound < 0.05 AND null_index > first THEN 'tie' ELSE 'wait' END AS decision FROM x""")(
    lambda s, d: rounded(impurity.decision(impurity.best_cuts(impurity.with_mdl(_cuts(s, d))), _node(s, d), 4, 3), "first", "second", "null_index", "bound")
)
_LAP = "WITH c AS (SELECT floor(l_quantity / 10)::BIGINT AS leaf, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls, count(*) AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY n + CASE WHEN cls = 1 THEN 5 ELSE 0 END DESC, cls) AS k, sum(n) OVER (PARTITION BY leaf) AS t FROM c)"
_leafy = lambda s, d: read(s, d, "lineitem").select(F.floor(F.col("l_quantity") / 10).cast("long").alias("leaf"), F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END").alias("cls"))
query("majority_laplace", f"{_LAP} SELECT leaf, cls AS majority FROM w WHERE k = 1")(lambda s, d: impurity.laplace_majority(_leafy(s, d), "leaf", "cls", 1, 5.0).select("leaf", "majority"))
query("leaf_error", f"{_LAP} SELECT leaf, t::BIGINT AS n, round(1 - n / t, 6) AS error_rate FROM w WHERE k = 1")(lambda s, d: rounded(impurity.laplace_majority(_leafy(s, d), "leaf", "cls", 1, 5.0).select("leaf", "n", "error_rate"), "error_rate"))
query("leafify_rank", f"{_LAP}, e AS (SELECT leaf, round((1 - n / t) * t / (SELECT sum(n) FROM c), 6) AS promise FROM w WHERE k = 1) SELECT leaf, promise, row_number() OVER (ORDER BY promise DESC, leaf) AS rank FROM e")(
    lambda s, d: clustering.ranked_leaves((lambda m: m.crossJoin(F.broadcast(m.agg(F.sum("n").alias("all")))).select("leaf", r6(F.col("error_rate") * F.col("n") / F.col("all")).alias("promise")))(impurity.laplace_majority(_leafy(s, d), "leaf", "cls", 1, 5.0)), "n", "promise")
)

# Trees

_FIXED = {p: hoeffding.Node(p, *x) for p, x in {"": ("l_quantity", 17.0), "L": (None, None, 0), "R": ("l_discount", 0.05), "RL": (None, None, 1), "RR": (None, None, 2)}.items()}
_PRED = "(SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls, CASE WHEN l_quantity < 17 THEN 'L' WHEN l_discount < 0.05 THEN 'RL' ELSE 'RR' END AS leaf, " + _CLS + " AS pred FROM lineitem)"
_pred = lambda s, d: hoeffding.classify(read(s, d, "lineitem").withColumn("cls", F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END")), _FIXED)
query("vfdt_classify_fixed", f"SELECT l_orderkey, l_linenumber, l_partkey, leaf, pred FROM {_PRED}")(lambda s, d: _pred(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "leaf", "pred"))
query("vfdt_confusion", f"SELECT cls, pred, count(*) AS n FROM {_PRED} GROUP BY ALL")(lambda s, d: evaluation.confusion(_pred(s, d), "cls", "pred"))
query("vfdt_answer_stats", f"SELECT cls, count(*) AS count, count(*) FILTER (WHERE cls = pred) AS success_count, round(count(*) FILTER (WHERE cls = pred) / count(*), 6) AS success_rate FROM {_PRED} GROUP BY cls")(lambda s, d: rounded(evaluation.answers(evaluation.confusion(_pred(s, d), "cls", "pred")), "success_rate"))
query("vfdt_error_rate", f"SELECT round(1 - count(*) FILTER (WHERE cls = pred) / count(*), 6) AS error_rate FROM {_PRED}")(lambda s, d: rounded(evaluation.error_rate(evaluation.confusion(_pred(s, d), "cls", "pred")), "error_rate"))

query("vfdt_replica_merge", f"SELECT attr, value, cls, count(*) AS n FROM {_MELT} GROUP BY ALL")(
    lambda s, d: (lambda x: hoeffding.merged_counts([x.where("l_orderkey % 2 = 0"), x.where("l_orderkey % 2 <> 0")], ATTRS, "cls"))(learnable(s, d))
)


def _ordered(s: SparkSession, d: str) -> DataFrame:
    return rows.with_running(learnable(s, d), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


query("vfdt_learn")(lambda s, d: (lambda x: hoeffding.table(x, hoeffding.learn(x, ATTRS, "cls", "_ord", 3)))(cut(_ordered(s, d))))

# Clustering features

_CF = """p AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), sm AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM p GROUP BY ALL),
cf AS (SELECT label, max(n) AS n, list(s ORDER BY i) AS ls, sum(q) AS ss FROM sm GROUP BY label)"""


def _cf(s: SparkSession, d: str) -> DataFrame:
    return clustering.features(read(s, d, "embeddings"), ["label"], "embedding")


def _out(df: DataFrame, cf: str) -> DataFrame:
    return df.select("label", F.col(f"{cf}.n").cast("long").alias("n"), F.transform(f"{cf}.ls", lambda x: F.round(x, 6)).alias("ls"), r6(F.col(f"{cf}.ss")).alias("ss"))


_LS = "list_transform({0}, lambda x: round(x, 6))"
query("cf_build", f"WITH {_CF} SELECT label, n, {_LS.format('ls')} AS ls, round(ss, 6) AS ss FROM cf")(lambda s, d: _out(_cf(s, d).select("label", F.struct("n", "ls", "ss").alias("cf")), "cf"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    c = _cf(s, d).select("label", F.struct("n", "ls", "ss").alias("a"))
    return c.join(c.select(F.col("label").alias("other"), F.col("a").alias("b")), F.col("other") == F.col("label") + 1)


_PAIR = f"WITH {_CF}, pr AS (SELECT a.label, a.n AS n1, a.ls AS l1, a.ss AS s1, b.n AS n2, b.ls AS l2, b.ss AS s2 FROM cf a JOIN cf b ON b.label = a.label + 1)"
query("cf_merge", f"{_PAIR} SELECT label, n1 + n2 AS n, list_transform(range(1, 65), lambda i: round(l1[i] + l2[i], 6)) AS ls, round(s1 + s2, 6) AS ss FROM pr")(lambda s, d: _out(_pairs(s, d).withColumn("c", clustering.plus("a", "b")), "c"))
query("cf_remove", f"{_PAIR} SELECT label, n1 - n2 AS n, list_transform(range(1, 65), lambda i: round(l1[i] - l2[i], 6)) AS ls, round(s1 - s2, 6) AS ss FROM pr")(lambda s, d: _out(_pairs(s, d).withColumn("c", clustering.plus("a", "b", -1)), "c"))
query("cf_centroid", f"WITH {_CF} SELECT label, list_transform(ls, lambda x: round(x / n, 6)) AS centroid FROM cf")(lambda s, d: _cf(s, d).select("label", F.struct("n", "ls", "ss").alias("c")).select("label", F.transform(clustering.centroid("c"), lambda x: F.round(x, 6)).alias("centroid")))
_R = "list_sum(list_transform(range(1, 65), lambda i: {0}))"
_DIST = {
    "d0": _R.format("(l1[i] / n1 - l2[i] / n2) ** 2"),
    "d1": _R.format("abs(l1[i] / n1 - l2[i] / n2)"),
    "d2": f"sqrt(greatest((n2 * s1 + n1 * s2 - 2 * {_R.format('l1[i] * l2[i]')}) / (n1 * n2), 0))",
    "d3": f"sqrt(greatest((2 * (n1 + n2) * (s1 + s2) - 2 * {_R.format('(l1[i] + l2[i]) ** 2')}) / ((n1 + n2) * (n1 + n2 - 1)), 0))",
    "d4": f"n1 * n2 / (n1 + n2) * {_R.format('(l1[i] / n1 - l2[i] / n2) ** 2')}",
}
for _k, _e in _DIST.items():
    query(f"dist_{_k}", f"{_PAIR} SELECT label, round({_e}, 6) AS distance FROM pr")(lambda s, d, k=_k: _pairs(s, d).select("label", r6(clustering.distance(k, "a", "b")).alias("distance")))
query("can_merge", f"{_PAIR} SELECT label, round({_DIST['d0']}, 6) AS distance, {_DIST['d0']} < 1.0 AS merge FROM pr")(lambda s, d: rounded(clustering.can_merge(_pairs(s, d), "a", "b", 1.0).select("label", "distance", "merge"), "distance"))


def _points(s: SparkSession, d: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.struct(F.lit(1.0).alias("n"), x.alias("ls"), F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v).alias("ss")).alias("cf"))


def _clusters(s: SparkSession, d: str) -> DataFrame:
    return _cf(s, d).select(F.col("label").cast("long").alias("cluster"), F.struct(F.col("n").cast("double").alias("n"), "ls", "ss").alias("cf"))


query("nearest_cluster", f"""WITH {_CF}, x AS (SELECT vec_id AS id, label AS cluster, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - ls[i] / n) ** 2)) AS d FROM (SELECT e.vec_id, e.embedding, cf.* FROM embeddings e CROSS JOIN cf))
SELECT id, cluster::BIGINT AS cluster, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS k FROM x) WHERE k = 1""")(lambda s, d: rounded(clustering.nearest(_points(s, d), _clusters(s, d)), "distance"))
_FAR = f"WITH {_CF}, al AS (SELECT a.label AS l, b.label AS r, list_sum(list_transform(range(1, 65), lambda i: (a.ls[i] / a.n - b.ls[i] / b.n) ** 2)) AS d FROM cf a CROSS JOIN cf b), fp AS (SELECT l, r, d FROM al WHERE l < r ORDER BY d DESC, l, r LIMIT 1)"
query("farthest_pair", f'{_FAR} SELECT l::BIGINT AS "left", r::BIGINT AS "right", round(d, 6) AS distance FROM fp')(lambda s, d: rounded(clustering.farthest_pair(_clusters(s, d)), "distance"))
query("split_assign", f"{_FAR} SELECT cf.label::BIGINT AS cluster, CASE WHEN cf.label = fp.l OR (cf.label <> fp.r AND a.d < b.d) THEN 'left' ELSE 'right' END AS side FROM cf, fp, al a, al b WHERE a.l = cf.label AND a.r = fp.l AND b.l = cf.label AND b.r = fp.r")(lambda s, d: clustering.split_assignment(_clusters(s, d)))


def _tree(s: SparkSession, d: str) -> tuple[DataFrame, birch.CFTree]:
    e = read(s, d, "embeddings")
    return e, birch.build(e, "embedding", ["vec_id"], threshold=1.0, branching=10, partitions=4)


query("birch_entries")(lambda s, d: (lambda x: birch.entry_table(*x))(_tree(s, d)))
query("birch_assign")(lambda s, d: (lambda x: birch.assign(x[0], "vec_id", "embedding", birch.entry_table(*x)))(_tree(s, d)))
query("birch_tree_stats")(lambda s, d: (lambda x: birch.node_table(*x).agg(F.max("depth").alias("max_depth"), F.count_if(F.col("kind") == "entry").alias("entries"), F.count("*").alias("nodes"), F.max("n").alias("entry_points")))(_tree(s, d)))
query("birch_depth_hist")(lambda s, d: (lambda x: birch.node_table(*x).groupBy("depth").agg(F.count("*").alias("nodes")))(_tree(s, d)))


@query("birch_save_single")
def _save(s: SparkSession, d: str) -> DataFrame:
    e, tree = _tree(s, d)
    entries = birch.entry_table(e, tree)
    members, cfs = birch.saved_lines(e, entries, birch.assign(e, "vec_id", "embedding", entries))
    return members.withColumn("file", F.lit("members")).unionByName(cfs.withColumn("file", F.lit("cf")))


# Evaluation

_PATH = "[vec_id % 3, vec_id % 9, vec_id % 27]"
_paths = lambda s, d: read(s, d, "embeddings").select("vec_id", (F.col("label") + 1).alias("label"), F.array(F.col("vec_id") % 3, F.col("vec_id") % 9, F.col("vec_id") % 27).alias("path"))
query("flat_purity", "WITH t AS (SELECT vec_id % 9 AS c, label, count(*) AS n FROM embeddings GROUP BY ALL), u AS (SELECT c, max(n) AS top, sum(n) AS size FROM t GROUP BY c) SELECT count(*) AS clusters, round(sum(top / size), 6) AS sum_purity, round(avg(top / size), 6) AS mean_purity, round(sum(top) / sum(size), 6) AS weighted_purity FROM u")(
    lambda s, d: rounded(evaluation.flat_purity(read(s, d, "embeddings").withColumn("c", F.col("vec_id") % 9), "c", "label"), "sum_purity", "mean_purity", "weighted_purity")
)
_ROLL = "rl AS (SELECT array_to_string(p[1:k], '/') AS node, k AS depth, label, count(*) AS n FROM (SELECT [vec_id % 3, vec_id % 9, vec_id % 27] AS p, label + 1 AS label FROM embeddings), range(0, 4) t(k) GROUP BY ALL)"
query("subtree_rollup", f"WITH {_ROLL} SELECT node, depth::INT AS depth, label, n FROM rl")(lambda s, d: evaluation.subtree_rollup(_paths(s, d), "path", "label"))
query("dendrogram_purity", f"""WITH {_ROLL}, o AS (SELECT *, sum(n) OVER (PARTITION BY node) AS size, n * (n - 1) / 2 AS pairs FROM rl),
b AS (SELECT CASE WHEN contains(node, '/') THEN regexp_replace(node, '/[^/]*$', '') ELSE '' END AS node, label, sum(pairs) AS below FROM o WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT o.*, pairs - coalesce(below, 0) AS met FROM o LEFT JOIN b USING (node, label)) SELECT sum(met)::BIGINT AS n_pairs, round(sum(met * n / size) / sum(met), 6) AS purity FROM m""")(lambda s, d: rounded(evaluation.dendrogram_purity(_paths(s, d), "path", "label"), "purity"))
query("selected_class_filter", "SELECT e.vec_id, e.label FROM embeddings e WHERE e.label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 50)")(lambda s, d: (lambda e: e.select("vec_id", "label").join(e.groupBy("label").agg(F.count("*").alias("n")).where("n >= 50"), "label", "left_semi"))(read(s, d, "embeddings")))
query("member_label_join", "SELECT e.vec_id % 9 AS cluster, l.label, count(*) AS n FROM embeddings e JOIN embeddings l USING (vec_id) GROUP BY ALL")(lambda s, d: read(s, d, "embeddings").select("vec_id", (F.col("vec_id") % 9).alias("cluster")).join(read(s, d, "embeddings").select("vec_id", "label"), "vec_id").groupBy("cluster", "label").agg(F.count("*").alias("n")))


def _files(s: SparkSession, d: str) -> DataFrame:
    """file, start and stop of the files that orders of 4000 keys each would be in."""
    file = F.floor(F.col("o_orderkey") / 4000).alias("file")
    return read(s, d, "orders").select(file).distinct().select("file", (F.col("file") * 4000).alias("start"), (F.col("file") * 4000 + 4000).alias("stop"))


query("file_index_range_join", "SELECT o_orderkey, (o_orderkey // 4000)::BIGINT AS file, o_orderkey % 4000 AS local FROM orders")(
    lambda s, d: evaluation.ranges_join(read(s, d, "orders").select("o_orderkey"), "o_orderkey", _files(s, d)).select("o_orderkey", "file", "local")
)
_nodes = lambda s, d: read(s, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"), F.when(F.col("p_partkey") > 1, F.col("p_partkey") % 2).alias("child_index"))
query("integrity_check", """WITH n AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, CASE WHEN p_partkey > 1 THEN p_partkey % 2 END AS ci FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ci) - 1 AS k FROM n)
SELECT count(*) FILTER (WHERE p.node IS NULL AND r.parent IS NOT NULL) AS orphans, count(*) FILTER (WHERE k <> r.ci) AS misplaced, count(*) AS nodes FROM r LEFT JOIN n p ON r.parent = p.node""")(lambda s, d: evaluation.integrity(_nodes(s, d)))

# Streams: all files there are, then the end

query("stream_class_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")(lambda s, d: ingest.run_once(s, f"{d}/events.parquet", lambda x: x.groupBy("event_type").agg(F.count("*").alias("n"))))
query("stream_vfdt_counts", "SELECT 'value' AS attr, floor(value / 10) * 10 AS value, event_type AS cls, count(*) AS n FROM events GROUP BY ALL")(
    lambda s, d: ingest.run_once(s, f"{d}/events.parquet", lambda x: x.select(F.lit("value").alias("attr"), (F.floor(F.col("value") / 10) * 10).cast("double").alias("value"), F.col("event_type").alias("cls")).groupBy("attr", "value", "cls").agg(F.count("*").alias("n")))
)
query("stream_cf_sum", "SELECT label, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS ss FROM embeddings GROUP BY 1")(
    lambda s, d: ingest.run_once(s, f"{d}/embeddings.parquet", lambda x: x.select("label", F.aggregate("embedding", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")).alias("q")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("q"), 4).alias("ss")))
)
query("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")(
    lambda s, d: ingest.run_once(s, f"{d}/events.parquet", lambda x: x.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))).select(F.col("w.start").alias("day"), "event_type", "n")
)

from . import files, models  # noqa: E402, F401  they add their queries
