import json

from pyspark.sql import functions as F

from grovekit.operators import evaluation, hoeffding
from grovekit.sources import arff, delimited, sinks
from grovekit.streaming import ingest


def test_lines_and_offsets(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"id,x\n1,2.5\n\n 2 , \"a \"\"q\"\" b\" \r\n3,\xc3\xa9\n")
    (tmp_path / "b.csv").write_bytes(b"id,x\n4,7\n")
    lines = delimited.read_lines(spark, str(tmp_path / "*.csv"))
    got = {(r.file[-5:], r.off): r.value for r in lines.collect()}
    raw = (tmp_path / "a.csv").read_bytes()
    for (f, off), v in got.items():
        if f == "a.csv":
            assert raw[off:].split(b"\n", 1)[0].decode() == v
    assert len(got) == 7
    cells = {r.off: r.c for r in lines.where(F.col("file").endswith("a.csv")).select("off", delimited.cells(F.col("value")).alias("c")).collect()}
    assert cells[12] == ["2", 'a "q" b']
    index = {r.file[-5:]: (r.start, r.stop) for r in delimited.file_index(lines).collect()}
    assert index == {"a.csv": (0, len(raw)), "b.csv": (len(raw), len(raw) + 9)}
    points = delimited.read_points(spark, str(tmp_path / "*.csv"), [1], label=0, skip=1).collect()
    assert sorted((p.label, p.x[0]) for p in points if p.label != 2 and p.label != 3) == [(1, 2.5), (4, 7.0)]
    assert len(points) == 4


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', " lead"), ("line\nend", "", "z")], "a string, b string, c string")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = delimited.read_csv(spark, str(tmp_path / "out"), suffixes=("csv",)).collect()
    assert {(r[0], r[1]) for r in back} == {("a,b", 'say "x"'), ("line\nend", None)}


ARFF = """% comment
@relation 'my rel'
@attribute n integer
@ATTRIBUTE r numeric
@attribute s string
@attribute 'the e' {a,'b c'}
@attribute d date "yyyy-MM-dd"
@attribute bag relational
  @attribute q real
@end bag
@data
1,2.5,'x, y','b c',1970-01-02,?
?,bad,plain,zz,nope,?, {3}
{0 7, 3 a}, {2}
"""


def test_arff(spark, tmp_path):
    (tmp_path / "x.arff").write_text(ARFF)
    h, df = arff.read_arff(spark, str(tmp_path / "x.arff"))
    assert h.relation == "my rel" and [a.kind for a in h.attributes] == ["integer", "real", "string", "enum", "date", "relational"]
    assert h.attributes[5].children[0].name == "q"
    got = sorted(tuple(r)[:5] + (r.weight,) for r in df.collect())
    assert got == sorted([(1, 2.5, "x, y", 1, 86400.0, 1.0), (-1, -1.0, "plain", -1, -1.0, 3.0), (7, 0.0, "", 0, -1.0, 2.0)])
    assert arff.parse_header(arff.render_header(h).split("\n")) == h


def test_arff_rows_that_begin_with_at(spark, tmp_path):
    head = "@relation r\n@attribute s string\n@attribute n integer\n@data\n"
    (tmp_path / "a.arff").write_text(head + "@home,1\nplain,2\n@data,3\n")
    (tmp_path / "b.arff").write_text(head + "@attribute,4\n")
    _, df = arff.read_arff(spark, str(tmp_path))
    assert sorted((r.s, r.n) for r in df.collect()) == [("@attribute", 4), ("@data", 3), ("@home", 1), ("plain", 2)]


def test_reports(spark):
    c = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 1, 2)], "cls int, pred int, n long")
    assert sorted(r[0] for r in sinks.answer_lines(c).collect()) == ["0,4,3,0.750,1:1", "1,2,2,1.000,"]
    nodes = hoeffding.table(spark.range(1), {"": hoeffding.Node("", "a", 1.0), "L": hoeffding.Node("L"), "R": hoeffding.Node("R")})
    assert json.loads(sinks.tree_json(nodes, errorRate=0.5)) == {"depthToNodes": {"0": 1, "1": 2}, "maxDepth": 1, "nodes": 3, "errorRate": 0.5}
    dot = [r[0] for r in sinks.dot_lines(nodes, "node", "parent", F.col("kind")).collect()]
    assert dot[0] == "digraph tree {" and dot[-1] == "}" and '"" -> "L";' in dot
    assert evaluation.error_rate(c).first()[0] == 1 - 5 / 6


def test_saved_tree(spark, tmp_path):
    (tmp_path / "t.csv").write_text("0,1,L2,10,20\n0,2,L0\n1,0,L1,30\n")
    got = sorted((tuple(r.path), r.member) for r in delimited.read_saved_tree(spark, str(tmp_path / "t.csv")).collect())
    assert got == [((0, 1), 10), ((0, 1), 20), ((1, 0), 30)]


def test_streaming_models(spark):
    sf = "/root/testdata/sf0.001"
    c = ingest.StreamingClusters("embedding", 1.0)
    q = ingest.source(spark, f"{sf}/embeddings.parquet").writeStream.foreachBatch(c.update).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(n for _, n, *_ in c.tree.leaves()) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    t = ingest.StreamingTree(["x"], "y", 2)
    df = spark.range(4000).select(F.col("id").cast("double").alias("x"), (F.col("id") > 2000).cast("int").alias("y"))
    t.update(df, 0)
    t.update(df, 1)
    assert t.status()["rows"] == 8000 and abs(t.nodes[""].threshold - 2001) < 5  # cut at one of a thousand quantiles
    assert hoeffding.classify(df, t.nodes).where("pred <> y").count() < 5


def test_cli(spark, tmp_path, capsys):
    from grovekit import cli

    spark.range(3000).select(F.floor(F.col("id") / 300).cast("double").alias("x"), (F.col("id") * 7 % 11).cast("double").alias("z"), (F.col("id") >= 1500).cast("int").alias("y")).write.parquet(str(tmp_path / "t.parquet"))
    cli.main(["tree", "--learn", str(tmp_path / "t.parquet"), "--test", str(tmp_path / "t.parquet"), "--attributes", "x,z", "--cls", "y", "--classes", "2"])
    assert '"errorRate": 0.0' in capsys.readouterr().out
    (tmp_path / "p.csv").write_text("".join(f"{i % 3 * 100},{i % 2},{i % 3}\n" for i in range(60)))
    cli.main(["cluster", "--input", str(tmp_path / "p.csv"), "--fields", "0-1", "--threshold", "50", "--output", str(tmp_path / "o")])
    assert spark.read.text(str(tmp_path / "o/cf")).count() == 3
    cli.main(["preprocess", "--input", str(tmp_path / "t.parquet"), "--output", str(tmp_path / "q"), "--clip", "0", "10", "x", "--normalize", "x", "--select", "x", "--seed", "s"])
    assert spark.read.text(str(tmp_path / "q")).count() == 3000
    cli.main(["profile", "--input", str(tmp_path / "t.parquet")])


def test_streams_resume_where_they_ended(spark, tmp_path):
    """Four batches; the driver ends after the second's counts were kept and before its commit, and another one goes on."""
    import pytest

    from grovekit.operators import hoeffding

    rows = spark.range(8000).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 4).cast("double").alias("z"), ((F.col("id") % 10 > 5) & (F.col("id") % 4 > 0)).cast("int").alias("k"))
    for i in range(4):
        rows.where(F.col("id").between(2000 * i, 2000 * i + 1999)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema, cfg = rows.schema, hoeffding.Config(delta=1e-3)

    def run(tree, where, fail_at=None):
        def update(batch, number):
            tree.update(batch, number)
            if number == fail_at:
                raise RuntimeError("the driver is gone")

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(update).option("checkpointLocation", str(tmp_path / where)).trigger(availableNow=True).start()
        q.awaitTermination()

    whole = ingest.StreamingTree(["x", "z"], "k", 2, cfg)
    run(whole, "c1")
    kept = f"file://{tmp_path}/model"
    with pytest.raises(Exception, match="the driver is gone"):
        run(ingest.StreamingTree(["x", "z"], "k", 2, cfg, kept, spark), "c2", fail_at=1)
    again = ingest.StreamingTree(["x", "z"], "k", 2, cfg, kept, spark)
    assert again.batch == 1 and again.rows == 4000
    run(again, "c2")
    assert again.status() == whole.status() and again.status()["rows"] == 8000 and again.status()["nodes"] > 3
    assert again.nodes == whole.nodes
    assert again.snapshots.versions() == [2, 3]
    again.update(rows, 3)  # a batch that comes once more
    assert again.rows == 8000


def test_stream_clusters_resume(spark, tmp_path):
    df = spark.createDataFrame([([float(i % 3), 0.0],) for i in range(60)], "v array<double>")
    kept = f"file://{tmp_path}/clusters"
    one = ingest.StreamingClusters("v", 0.5, path=kept, spark=spark)
    one.update(df, 0)
    two = ingest.StreamingClusters("v", 0.5, path=kept, spark=spark)
    two.update(df, 0)
    two.update(df, 1)
    assert sorted(e[1] for e in two.tree.leaves()) == [40.0, 40.0, 40.0]


def test_cli_cluster_with_labels(spark, tmp_path):
    from grovekit import cli

    lines = [f"{10 * (i % 4) + (i // 4 % 3) * 0.1},{i % 4},{1 + i % 4}" for i in range(120)]
    (tmp_path / "p.csv").write_text("a,b,label\n" + "\n".join(lines) + "\n")
    cli.main(["cluster", "--input", str(tmp_path / "p.csv"), "--fields", "0-1", "--skip", "1", "--label", "2", "--threshold", "4", "--branching", "3", "--output", str(tmp_path / "o")])
    got = json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "o" / "tree-stats")).collect()))
    assert (got["points"], got["entries"], got["branching"], got["threshold"], got["purity"], got["dendrogramPurity"]) == (120, 4, 3, 4.0, 1.0, 1.0)
    assert got["nodes"] == sum(got["depthToNodes"].values()) and got["depthToNodes"]["0"] == 1
    members = delimited.read_saved_tree(spark, str(tmp_path / "o" / "members"))
    assert members.count() == 120 and members.select("path").distinct().count() == 4
