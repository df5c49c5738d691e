"""Command line: learn and test a tree, cluster points, profile, preprocess. Options follow the dataclasses' fields."""

from __future__ import annotations

import argparse
import dataclasses
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut
from .operators import birch, cftree, clustering, evaluation, hoeffding, preprocess, profile, rows
from .sources import arff, delimited, sinks


def _session() -> SparkSession:
    return SparkSession.builder.appName("grovekit").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All inputs as one table; the kind of each by its suffix."""
    kinds = {".parquet": lambda p: spark.read.parquet(p), ".arff": lambda p: arff.read_arff(spark, p)[1]}
    parts = [next((f for k, f in kinds.items() if p.rstrip("/").endswith(k)), lambda p: delimited.read_csv(spark, p, header=True))(p) for p in paths]
    return reduce(DataFrame.unionByName, parts)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("grovekit")
    sub = p.add_subparsers(dest="what", required=True)
    t = sub.add_parser("tree", help="learn from --learn, test on --test")
    t.add_argument("--learn", nargs="+", required=True)
    t.add_argument("--test", nargs="+")
    t.add_argument("--order", help="learn row by row in the order of this integer column; else level by level over the whole table")
    t.add_argument("--dump", help="folder for reports of every node")
    t.add_argument("--attributes", required=True)
    t.add_argument("--cls", required=True)
    t.add_argument("--classes", type=int, required=True)
    for f in dataclasses.fields(hoeffding.Config):
        if f.type == "bool":
            t.add_argument(f"--{f.name}", action="store_true")
        else:
            t.add_argument(f"--{f.name}", type=float if f.type == "float" else int, default=f.default)
    c = sub.add_parser("cluster", help="cluster the points of delimited files")
    c.add_argument("--input", nargs="+", required=True)
    c.add_argument("--fields", required=True, help="1-3,5: ranges with their last number")
    c.add_argument("--label", type=int, help="column of a class: adds purities to the statistics")
    c.add_argument("--skip", type=int, default=0)
    c.add_argument("--threshold", type=float, default=1.0)
    c.add_argument("--branching", type=int, default=10)
    c.add_argument("--distance", default="d0", choices=clustering.D)
    c.add_argument("--beam", type=int, default=8, help="nodes that a point keeps on its way down; d0 and d1 are searched exactly")
    c.add_argument("--output", required=True)
    u = sub.add_parser("purity", help="purities of a saved tree against labels")
    u.add_argument("--tree", nargs="+", required=True, help="lines of path, L<count>, members")
    u.add_argument("--labels", required=True, help="member,label lines")
    u.add_argument("--classes", type=int, help="only so many classes, sampled by --seed")
    u.add_argument("--seed", default="0")
    s = sub.add_parser("profile")
    s.add_argument("--input", nargs="+", required=True)
    x = sub.add_parser("preprocess")
    x.add_argument("--input", nargs="+", required=True)
    x.add_argument("--order", help="column that numbers the rows, for the options on rows")
    x.add_argument("--skip", type=int, default=0)
    x.add_argument("--rows", help="0,3,5-8: only these rows")
    x.add_argument("--max", type=int, help="the first so many rows")
    x.add_argument("--max-bytes", help="the first rows whose lines stay under so many bytes, such as 5m")
    x.add_argument("--split", help="so many rows a file, such as 10k; an --output with a suffix, such as out/rows.csv, gives single files rows-0000.csv and so on, another one a folder a file")
    x.add_argument("--split-bytes", help="so many bytes of lines a file, such as 64m; as --split")
    x.add_argument("--output", required=True)
    x.add_argument("--clip", nargs=3, action="append", default=[], metavar=("LOW", "HIGH", "COLUMN"))
    x.add_argument("--log", action="append", default=[])
    x.add_argument("--hash", action="append", default=[])
    x.add_argument("--normalize", action="append", default=[])
    x.add_argument("--select", action="append", default=[])
    x.add_argument("--seed", help="shuffle rows by this seed")
    a = p.parse_args(argv)
    spark = _session()
    if a.what == "tree":
        config = hoeffding.Config(**{f.name: getattr(a, f.name) for f in dataclasses.fields(hoeffding.Config)})
        names = a.attributes.split(",")
        data = load(spark, a.learn).withColumn(a.cls, F.col(a.cls).cast("int"))
        began = time.time()
        nodes = hoeffding.learn(data, names, a.cls, a.order, a.classes, config) if a.order else hoeffding.grow(data, names, a.cls, a.classes, config)
        learned = time.time() - began
        table = hoeffding.table(spark.range(1), nodes)
        table.show(1000, truncate=False)
        if a.dump:
            sinks.dump_nodes(hoeffding.classify(data, nodes), table, "leaf", names, a.cls, [], a.dump)
        if a.test:
            confusion = evaluation.confusion(hoeffding.classify(load(spark, a.test).withColumn(a.cls, F.col(a.cls).cast("int")), nodes), a.cls, "pred")
            sinks.answer_lines(confusion).show(1000, truncate=False)
            tested = confusion.agg(F.sum("n")).first()[0]
            print(sinks.tree_json(table, learnTime=learned, totalTime=time.time() - began, learnInstanceCount=data.count(), testInstanceCount=tested, errorRate=evaluation.error_rate(confusion).first()[0]))
    elif a.what == "cluster":
        points = delimited.read_points(spark, a.input, rows.parse_ranges(a.fields, inclusive=True), a.label, a.skip)
        points = cut(points.withColumn("n", F.monotonically_increasing_id()))
        began = time.time()
        nodes = cftree.tree(cftree.entries(points, "x", a.threshold, a.branching, a.distance), a.branching, a.distance)
        made = time.time() - began
        found = cut(cftree.descend(cftree.as_points(points, "n", "x"), nodes, a.distance, None if a.distance in ("d0", "d1") else a.beam))
        entries = nodes.where("kind = 'entry'").select("cluster", "path", "cf")
        members, features = birch.saved_lines(points, entries, found)
        members.write.text(f"{a.output}/members")
        features.write.text(f"{a.output}/cf")
        stats = {"branching": a.branching, "threshold": a.threshold, "distance": a.distance, "constructSeconds": round(made, 3), "points": points.count(), "entries": entries.count()}
        if a.label is not None:
            labelled = found.join(points.select(F.col("n").alias("id"), "label"), "id").join(entries.select("cluster", "path"), "cluster")
            stats["purity"] = evaluation.flat_purity(labelled, "cluster", "label").first()["weighted_purity"]
            stats["dendrogramPurity"] = evaluation.dendrogram_purity(labelled, "path", "label").first()["purity"]
        text = sinks.tree_json(nodes.select(F.size("path").alias("depth")), **stats)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{a.output}/tree-stats")
        print(text)
    elif a.what == "purity":
        members = reduce(DataFrame.unionByName, [delimited.read_saved_tree(spark, p) for p in a.tree])
        labels = spark.read.schema("member long, label long").csv(a.labels)
        if a.classes:
            chosen = evaluation.class_sample(labels.groupBy("label").agg(F.count("*").alias("n")), a.classes, rows.parse_seed(a.seed))
            labels = labels.join(F.broadcast(chosen.select("label")), "label", "left_semi")  # as many rows as --classes
        both = members.join(labels, "member")
        evaluation.flat_purity(both, "path", "label").show(truncate=False)
        evaluation.dendrogram_purity(both, "path", "label").show(truncate=False)
    elif a.what == "profile":
        df = load(spark, a.input)
        for f in (profile.types, profile.number_range, profile.inferred_schema, profile.top_values):
            f(df, df.columns).show(1000, truncate=False)
    else:
        pipe = preprocess.Pipeline()
        for low, high, col in a.clip:
            pipe.clip(float(low), float(high), col)
        pipe.log(*a.log).hash(*a.hash).normalize(*a.normalize)
        df = load(spark, a.input)
        if a.skip:
            df = rows.skip(df, [a.order], a.skip)
        if a.rows:
            df = rows.pick(df, [a.order], rows.parse_ranges(a.rows))
        if a.max is not None:
            df = rows.limit_rows(df, [a.order], a.max)
        line = F.octet_length(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])) + 1
        if a.max_bytes:
            df = rows.limit_bytes(df, [a.order], line, rows.parse_size(a.max_bytes))
        if a.split or a.split_bytes:
            kept = a.select or df.columns
            dealt = rows.split_rows(df, [a.order], rows.parse_size(a.split)) if a.split else rows.split_bytes(df.withColumn("_line_bytes", line), [a.order], "_line_bytes", rows.parse_size(a.split_bytes))
            if "." in a.output.rpartition("/")[2]:
                df = pipe.select("file_no", "_place", *kept).apply(dealt.withColumn("_place", F.col(a.order)))
                sinks.write_split_files(df, a.output, ["_place"], [c for c in df.columns if c not in ("file_no", "_place")])
            else:
                sinks.write_split(pipe.select("file_no", *kept).apply(dealt), a.output)
            return
        df = pipe.select(*(a.select or df.columns)).apply(df)
        sinks.write_raw(rows.shuffle(df, df.columns, rows.parse_seed(a.seed)) if a.seed else df, a.output)


if __name__ == "__main__":
    main()
