"""Operator 6, line dedup by a log-template tree; DataFrame functions only.

A line goes down a tree of fixed depth: its number of tokens, then its first tokens, where a token with a digit is the
wildcard ``<*>``. Its template is first the line with all such tokens as wildcards. In leaves where many templates
meet, a token stays constant at its place if at least ``share`` of the leaf's lines have it there, so a leaf can hold several
templates at once; rarer tokens are variable fields. Lines with enough constants get what is left of them as their template.
A template in ``min_docs`` documents or more recurs: all its lines but the first (by doc_id, then place) are dropped.
The limit of seven is the published rule of dropping lines that appear more than six times; lines in fewer
documents are mostly those of near copies, which other operators find as a whole.

Null text stays null, empty text stays empty, blank lines stay, repeated rows of a document lose the same lines, and a null
doc_id is the lowest. Groups are only ever counted, so a line in a third of all documents is no larger a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Table, by_shuffle, unused

#: What makes a line need more than a split at spaces: digits, and white space other than the space.
ODD = "[0-9\\x09\\x0B-\\x0D]"
#: Lists of up to so many rows of a few numbers are sent to all executors; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Tree:
    depth: int = 3
    min_docs: int = 7
    least_tokens: int = 6
    similarity: float = 0.75
    least_constant: int = 3
    share: float = 0.2


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _id(docs: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _lines(keyed: DataFrame, tree: Tree) -> DataFrame:
    """doc_id, h, pos, n, leaf, template, masked (the tokens, parted by spaces; null for short lines) of each line that has a token.

    Most lines have neither digits nor tabs; a split at spaces is all they need.
    """
    line = keyed.where("text IS NOT NULL").select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("*", F.col("line").rlike(ODD).alias("odd"))
    raw = line.select("doc_id", "h", "pos", "odd", "line", _tokens(F.when(F.col("odd"), F.regexp_replace("line", "[\\x09\\x0B-\\x0D]", " ")).otherwise(F.col("line"))).alias("raw"))
    masked = F.when(F.col("odd"), F.transform("raw", lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t)))
    both = raw.select("doc_id", "h", "pos", "odd", "line", "raw", masked.alias("masked"))
    n, constant = F.size("raw"), F.size(F.array_remove("masked", "<*>"))
    use = (constant == n) | ((constant >= tree.least_constant) & (2 * constant >= n))
    return both.select(
        "doc_id", "h", "pos", n.alias("n"), F.xxhash64(n, F.slice(F.coalesce("masked", "raw"), 1, tree.depth)).alias("leaf"),
        F.when(F.col("odd") & use, F.xxhash64("masked")).otherwise(F.xxhash64("raw")).alias("template"),
        F.when(n >= tree.least_tokens, F.when(F.col("odd"), F.array_join("masked", " ")).otherwise(F.col("line"))).alias("masked"),
    ).where("n > 0")


def _templates(lines: DataFrame, tree: Tree, scratch: Scratch) -> DataFrame:
    """doc_id, h, pos, template of all lines: in leaves where templates meet, the common one where the line has enough constants."""
    wide = lines.where(F.col("n") >= tree.least_tokens)
    meet = wide.groupBy("leaf", "template").agg(F.count("*").alias("k")).groupBy("leaf").agg(F.count("*").alias("templates"), F.sum("k").alias("total"))
    hot = scratch.table(meet.where((F.col("templates") >= 2) & (F.col("total") >= tree.min_docs)).select(F.col("leaf").alias("l"), "total"), "hot-leaves")
    leaves = _small(hot, hot.count())
    met = scratch.table(wide.join(leaves, F.col("leaf") == F.col("l")).select("doc_id", "h", "pos", "leaf", "n", "total", "template", _tokens(F.col("masked")).alias("tokens")), "hot-lines")
    each = met.select("leaf", "n", "total", F.posexplode("tokens").alias("p", "t"))
    often = each.groupBy("leaf", "n", "total", "p", "t").agg(F.count("*").alias("k")).where((F.col("k") >= tree.min_docs) & (F.col("k") >= tree.share * F.col("total")))
    # at most 1 / share tokens a place
    places = often.groupBy("leaf", "n", "p").agg(F.collect_list("t").alias("ts"))
    solid = places.groupBy("leaf", "n").agg(F.count("*").alias("c"), F.map_from_entries(F.collect_list(F.struct("p", "ts"))).alias("constant")).where(F.col("c") >= tree.similarity * F.col("n"))
    solid = scratch.table(solid.select(F.col("leaf").alias("l"), "constant"), "leaf-constants")
    kept = F.transform("tokens", lambda t, i: F.when(F.array_contains(F.element_at("constant", i), t), t))
    fits = met.join(solid, F.col("leaf") == F.col("l"), "left").select("doc_id", "h", "pos", "leaf", "n", "template", F.when(F.col("constant").isNotNull(), kept).alias("kept"))
    agree = F.size(F.filter("kept", lambda t: t.isNotNull()))
    fixed = F.size(F.filter("kept", lambda t: t.isNotNull() & (t != "<*>")))
    general = (agree >= tree.similarity * F.col("n")) & (2 * fixed >= F.col("n"))
    whole = F.xxhash64(F.lit("leaf"), "leaf", F.transform("kept", lambda t: F.coalesce(t, F.lit("<*>"))))
    own = fits.select("doc_id", "h", "pos", F.when(F.col("kept").isNotNull() & general, whole).otherwise(F.col("template")).alias("template"))
    rest = lines.join(leaves.select("l"), (F.col("n") >= tree.least_tokens) & (F.col("leaf") == F.col("l")), "left_anti").select("doc_id", "h", "pos", "template")
    return rest.unionByName(own)


def dropped_lines(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """doc_id, h (hash of the text) and the places of the lines to drop, a row for each document that loses any."""
    keyed = docs.select(_id(docs).alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    place: Column = F.struct("doc_id", "h", "pos")
    with Scratch() as scratch:
        last = _templates(scratch.table(_lines(keyed, tree), "lines"), tree, scratch)
        per_doc = last.groupBy("template", "doc_id", "h").agg(F.min("pos").alias("pos"))
        recurring = per_doc.groupBy("template").agg(F.count("*").alias("docs"), F.min(place).alias("first")).where(F.col("docs") >= tree.min_docs).select(F.col("template").alias("t"), "first")
        recurring = scratch.table(recurring, "recurring-templates")  # a side of its own, so that a template in a third of all lines can be split
        gone = last.join(_small(recurring, recurring.count()), F.col("template") == F.col("t")).where(~place.eqNullSafe(F.col("first")))
        return Table(gone.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("places")), "dropped-lines").read()


def drop_recurring(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """All rows and columns of ``docs`` with recurring lines out of ``text`` (and n_chars, where there is one, counted anew)."""
    d, h, at, lines = unused(docs, "d", "h", "places", "lines")
    gone = dropped_lines(docs, tree).select(F.col("doc_id").alias(d), F.col("h").alias(h), F.col("places").alias(at))
    both = docs.join(by_shuffle(gone), (_id(docs) == F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h)), "left")
    both = both.withColumn(lines, F.when(F.col(at).isNotNull(), F.split("text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(at))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    out = both.withColumn("text", F.when(F.col(at).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def line_report(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the remaining text) for each row; null text counts as no lines and empty text."""
    before = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    return drop_recurring(docs.select("doc_id", "text", before.cast("long").alias("n_lines"), (F.col("text") != "").alias("had_text")), tree).select(
        "doc_id", "n_lines",
        F.when(F.col("text").isNull(), F.lit(0)).when((F.col("text") == "") & F.col("had_text"), F.col("n_lines")).otherwise(F.col("n_lines") - F.size(F.split("text", "\n"))).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


SQL = """
WITH line AS (
  SELECT doc_id, pos - 1 AS pos, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS raw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)),
tok AS (SELECT *, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens, len(raw) AS n FROM line WHERE len(raw) > 0),
cnt AS (SELECT *, len(list_filter(tokens, lambda t: t <> '<*>')) AS c, (n, tokens[1:3])::VARCHAR AS leaf FROM tok),
base AS (SELECT *, CASE WHEN NOT regexp_matches(line, '[0-9]') OR c = n OR (c >= 3 AND 2 * c >= n) THEN tokens ELSE raw END AS template FROM cnt),
hot AS (SELECT leaf, sum(k) AS total FROM (SELECT leaf, template, count(*) AS k FROM base WHERE n >= 6 GROUP BY ALL) GROUP BY leaf HAVING count(*) >= 2 AND sum(k) >= 7),
ex AS (SELECT b.doc_id, b.pos, b.leaf, b.n, h.total, generate_subscripts(tokens, 1) AS p, unnest(tokens) AS t FROM base b JOIN hot h USING (leaf) WHERE b.n >= 6),
often AS (SELECT leaf, p, t FROM ex GROUP BY leaf, total, p, t HAVING count(*) >= 7 AND count(*) >= 0.2 * total),
general AS (SELECT x.doc_id, x.pos, list(coalesce(o.t, '<*>') ORDER BY x.p) AS template FROM ex x LEFT JOIN often o ON x.leaf = o.leaf AND x.p = o.p AND x.t = o.t
  GROUP BY x.doc_id, x.pos, x.n HAVING count(o.t) >= 0.75 * x.n AND 2 * count_if(o.t <> '<*>') >= x.n),
final AS (SELECT b.doc_id, b.pos, coalesce(a.template, b.template) AS template, a.template IS NOT NULL AS g FROM base b LEFT JOIN general a ON a.doc_id = b.doc_id AND a.pos = b.pos),
rec AS (SELECT template, g, min({'d': doc_id, 'p': pos}) AS first FROM final GROUP BY template, g HAVING count(DISTINCT doc_id) >= 7),
gone AS (SELECT f.doc_id, list(f.pos) AS places FROM final f JOIN rec r ON f.template = r.template AND f.g = r.g WHERE {'d': f.doc_id, 'p': f.pos} <> r.first GROUP BY f.doc_id)
SELECT d.doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, coalesce(len(places), 0)::BIGINT AS n_dropped,
  sha256(array_to_string(CASE WHEN places IS NULL THEN string_split(text, chr(10)) ELSE list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(places, i - 1)) END, chr(10))) AS kept_sha256
FROM documents d LEFT JOIN gone g USING (doc_id)
"""
