"""ARFF files: the header is parsed on the driver, rows by column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

_NAME = r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^\s{]+)"""


@dataclass
class Attribute:
    """kind: integer, real, string, enum, date or relational."""

    name: str
    kind: str
    values: list[str] = field(default_factory=list)
    format: str = ""
    children: list[Attribute] = field(default_factory=list)


@dataclass
class Header:
    relation: str
    attributes: list[Attribute]


def unquote(s: str) -> str:
    s = s.strip()
    if len(s) >= 2 and s[0] == s[-1] and s[0] in "'\"":
        s = s[1:-1]
    return re.sub(r"\\(.)", r"\1", s)


def quote(s: str) -> str:
    return s if re.fullmatch("[a-zA-Z0-9]+", s) else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parse_header(lines: list[str]) -> Header:
    """Up to @data; keywords in any case, comments skipped, relational attributes nested."""
    relation, stack = "", [[]]
    for line in lines:
        line = line.strip()
        word = line.split(None, 1)[0].lower() if line else ""
        if word == "@relation":
            relation = unquote(line[9:])
        elif word == "@attribute":
            m = re.match(_NAME + r"\s*(.*)$", line[10:].strip())
            name, kind = unquote(m[1]), m[2].strip()
            low = kind.lower()
            if kind.startswith("{"):
                values = re.findall(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,{}\s][^,{}]*""", kind)
                a = Attribute(name, "enum", [unquote(v) for v in values])
            elif low.startswith("date"):
                a = Attribute(name, "date", format=unquote(kind[4:]) or "yyyy-MM-dd'T'HH:mm:ss")
            elif low.startswith("relational"):
                a = Attribute(name, "relational")
            else:
                a = Attribute(name, {"numeric": "real", "real": "real", "integer": "integer"}.get(low, "string"))
            stack[-1].append(a)
            if a.kind == "relational":
                stack.append(a.children)
        elif word == "@end" and len(stack) > 1:
            stack.pop()
        elif word == "@data":
            break
    return Header(relation, stack[0])


def render_header(h: Header) -> str:
    def one(a: Attribute) -> list[str]:
        kind = {"enum": "{" + ",".join(map(quote, a.values)) + "}", "date": f'date "{a.format}"'}.get(a.kind, a.kind)
        out = [f"@attribute {quote(a.name)} {kind}"]
        return [*out, *(x for c in a.children for x in one(c)), f"@end {quote(a.name)}"] if a.kind == "relational" else out

    return "\n".join([f"@relation {quote(h.relation)}", *(x for a in h.attributes for x in one(a)), "@data"]) + "\n"


def _typed(c: Column, a: Attribute) -> Column:
    if a.kind == "integer":
        return S.or_default(c, "long", -1)
    if a.kind == "real":
        return S.or_default(c, "double", -1.0)
    if a.kind == "enum":
        return S.ordinal(c, a.values)
    if a.kind == "date":
        return S.epoch_seconds(c, a.format)
    return F.coalesce(c, F.lit(""))


def read_arff(spark: SparkSession, path: str, typed: bool = True) -> tuple[Header, DataFrame]:
    """Header, and a column per attribute plus weight (1 if a row has none). Dense and sparse rows; enums as ordinals; bad cells -1.

    A file's rows are what follows its first @data, which must be in its first block; several files have a header each. Rows stay distributed.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = raw.withColumn("_i", F.monotonically_increasing_id()).where("value IS NOT NULL AND trim(value) <> '' AND ltrim(value) NOT LIKE '\\%%'")
    head = []
    for r in lines.toLocalIterator():
        head.append(r[0])
        if r[0].strip().lower().startswith("@data"):
            break
    h = parse_header(head)
    data = lines.where((F.col("block") == 0) & F.lower(F.trim("value")).startswith("@data")).groupBy(F.col("file").alias("_f")).agg(F.min("_i").alias("_d"))
    body = lines.join(F.broadcast(data), F.col("file") == F.col("_f")).where((F.col("block") > 0) | (F.col("_i") > F.col("_d")))  # a row a file
    weight = F.regexp_extract("value", r",\s*\{\s*([0-9.eE+-]+)\s*\}\s*$", 1)
    b = body.select(F.when(weight == "", F.lit(1.0)).otherwise(weight.try_cast("double")).alias("weight"), F.trim(F.regexp_replace("value", r",\s*\{\s*[0-9.eE+-]+\s*\}\s*$", "")).alias("row"))
    token = r"""\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,]*),"""
    clean = lambda c: F.regexp_replace(F.when(F.trim(c).rlike("""^(['"]).*\\1$"""), F.regexp_replace(F.trim(c), """^['"]|['"]$""", "")).otherwise(F.trim(c)), r"\\(.)", "$1")
    split = lambda c: F.regexp_extract_all(F.concat(c, F.lit(",")), F.lit(token), F.lit(1))
    sparse = F.col("row").startswith("{")
    inner = F.regexp_replace("row", r"^\{|\}$", "")
    items = F.filter(split(inner), lambda x: F.trim(x) != "")
    pairs = F.map_from_entries(F.transform(items, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d+)", 1).cast("int").alias("k"), clean(F.regexp_replace(x, r"^\s*\d+\s+", "")).alias("v"))))
    c = b.select("weight", F.when(~sparse, F.transform(split(F.col("row")), clean)).alias("dense"), F.when(sparse, pairs).alias("sparse"))
    cell = lambda i: F.coalesce(F.get(F.col("dense"), F.lit(i)), F.col("sparse")[F.lit(i)])
    default = lambda i, a: F.when(F.col("sparse").isNotNull() & cell(i).isNull() & F.lit(a.kind in ("real", "integer")), F.lit("0")).otherwise(cell(i))
    return h, c.select(*[(_typed(default(i, a), a) if typed else cell(i)).alias(a.name) for i, a in enumerate(h.attributes)], "weight")
