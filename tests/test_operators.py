import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grovekit.functions import scalars as S
from grovekit.operators import birch, clustering, evaluation, hoeffding, impurity, preprocess, rows


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("hello", 99162322), ("AUTOMOBILE", 841685777), ("", 0)])
def test_string_hash(spark, text, want):
    assert one(spark, S.string_hash(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("abc", 1154031035), ("", -914035544)])
def test_md5_fold(spark, text, want):
    assert one(spark, S.md5_fold(F.lit(text))) == want


@pytest.mark.parametrize("x,want", [(0, 0), (100, 0.8333333333333334), (-100, 0.16666666666666666), (1e9, 1)])
def test_signed_log(spark, x, want):
    assert one(spark, S.signed_log(F.lit(float(x)), -3, 3)) == pytest.approx(want)


def test_log10_edges(spark):
    assert one(spark, S.log10(F.lit(0.0))) == -math.inf
    assert math.isnan(one(spark, S.log10(F.lit(-1.0))))


def test_extract(spark):
    assert one(spark, S.extract(F.lit(""))) == 0
    assert one(spark, S.extract(F.lit("-2.5"))) == -2.5
    assert one(spark, S.extract(F.lit("abc"))) == 1154031035


def test_hoeffding_bound(spark):
    assert one(spark, impurity.hoeffding_bound(F.lit(300), 1e-7, 5, math.log2(3))) == pytest.approx(0.27243790029777387)
    assert one(spark, impurity.hoeffding_bound(F.lit(300), 1e-7, 5, 1.0)) == pytest.approx(0.17188917729839973)


def test_discrete_index(spark):
    df = spark.createDataFrame([("x", 0)] * 3 + [("x", 1)] + [("y", 0)] + [("y", 1)] * 3, "a string, c int")
    r = impurity.discrete_index(impurity.discrete_counts(df, ["a"], "c")).first()
    assert (r.gini, r.entropy) == (pytest.approx(0.375), pytest.approx(0.8112781244591328))
    n = impurity.node_impurity(df, "c").first()
    assert (n.gini, n.entropy) == (pytest.approx(0.5), pytest.approx(1.0))


CF = "struct<n:double,ls:array<double>,ss:double>"


def feature(points):
    p = np.array(points, float)
    return (float(len(p)), p.sum(0).tolist(), float((p * p).sum()))


def test_distances(spark):
    df = spark.createDataFrame([(feature([(1, 2)]), feature([(4, 6)]))], f"a {CF}, b {CF}")
    got = df.select(*[clustering.distance(k, "a", "b", literal=True).alias(k) for k in clustering.D]).first()
    assert list(got) == pytest.approx([25, 7, 5, 3.5355339059327378, 12.5])
    df = spark.createDataFrame([(feature([(1, 2), (3, 4)]), feature([(4, 6)]))], f"a {CF}, b {CF}")
    got = df.select(*[clustering.distance(k, "a", "b", literal=True).alias(k) for k in clustering.D]).first()
    assert got.d0 == 13 and got.d1 == 5 and math.isnan(got.d2) and math.isnan(got.d3) and got.d4 == pytest.approx(-1.4444444444444438)


def test_dendrogram_purity_equals_pairs(spark):
    rng = random.Random(3)
    rows_ = [([rng.randrange(2), rng.randrange(3)], rng.randrange(0, 4)) for _ in range(40)]
    got = evaluation.dendrogram_purity(spark.createDataFrame(rows_, "path array<int>, label int"), "path", "label").first()
    live = [(tuple(p), k) for p, k in rows_ if k]
    total, pairs = 0.0, 0
    for i, (p, k) in enumerate(live):
        for q, m in live[:i]:
            if k == m:
                d = 0
                while d < 2 and p[d] == q[d]:
                    d += 1
                under = [x for r, x in live if r[:d] == p[:d]]
                total, pairs = total + under.count(k) / len(under), pairs + 1
    assert got.n_pairs == pairs and got.purity == pytest.approx(total / pairs)


def test_normalize_constant_and_empty(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "i int, x double")
    assert all(math.isnan(r.x) for r in preprocess.normalize(df, ["x"]).collect())
    assert preprocess.normalize(df.where("false"), ["x"]).count() == 0


def test_parsers():
    assert rows.parse_size("1_0k") == 10_000 and rows.parse_size("2g") == 2 * 10**9
    assert rows.parse_ranges("1,3-5") == [1, 3, 4] and rows.parse_ranges("3-5", True) == [3, 4, 5]
    assert rows.parse_seed("hello") == 99162322 and rows.parse_seed("-4") == -4


def test_running_with_ties_and_empty(spark):
    df = spark.createDataFrame([(1, i, i + 1) for i in range(50)] + [(7, 0, 5)], "k int, j int, w int")
    got = rows.with_running(df, ["k", "j"], F.col("w"), ranges=4).orderBy("_ord").collect()
    assert [r._ord for r in got] == list(range(51)) and got[-1]._sum == sum(range(1, 51)) + 5
    assert rows.with_running(df.where("false"), ["k", "j"]).count() == 0


def sequential(x, y, names, classes, c):
    """The same learner, a row at a time."""
    nodes, store = {"": None}, {"": []}
    for i in range(len(y)):
        p = ""
        while nodes[p] not in (None, "leaf"):
            a, t = nodes[p]
            p += "L" if x[i, a] < t else "R"
        if nodes[p] == "leaf":
            continue
        store[p].append(i)
        s = store[p]
        if len(s) % c.chunk == 0 and len(set(y[s].tolist())) > 1:
            what, a, t = hoeffding.decide(x[s], y[s], classes, c)
            if what == "split":
                nodes[p] = (a, t)
                for q in "LR":
                    nodes[p + q], store[p + q] = None, []
            elif what == "leaf":
                nodes[p] = "leaf"
    return {p: None if v in (None, "leaf") else (names[v[0]], v[1]) for p, v in nodes.items()}


def test_learn_equals_sequential(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, (6000, 2)).astype(float)
    y = np.where(x[:, 0] < 7, 0, np.where(x[:, 1] < 11, 1, 2))
    c = hoeffding.Config(chunk=100, first_span=512, prune=False)
    df = spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "o long, a double, b double, k int")
    nodes = hoeffding.learn(df, ["a", "b"], "k", "o", 3, c)
    assert {p: (n.attr, n.threshold) if n.attr else None for p, n in nodes.items()} == sequential(x, y, ["a", "b"], 3, c)
    assert len(nodes) >= 5
    grown = hoeffding.grow(df, ["a", "b"], "k", 3, c)
    assert evaluation.error_rate(evaluation.confusion(hoeffding.classify(df, grown), "k", "pred")).first()[0] == 0


def test_learn_goes_on_to_the_last_row(spark):
    """Many spans, the largest fold far smaller than the table: a leaf that is mixed late, one that waits on noise, one that stays pure."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 30, (9000, 2)).astype(float)
    y = np.where(x[:, 0] < 10, 0, np.where(x[:, 0] < 20, rng.integers(0, 2, 9000), 1))
    y[6000:] = np.where((x[6000:, 0] < 10) & (x[6000:, 1] < 15), 2, y[6000:])
    c = hoeffding.Config(chunk=50, first_span=256, max_rows=700, tie=0.2, laplace=0, prune=False)
    df = spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "o long, a double, b double, k int")
    nodes = hoeffding.learn(df, ["a", "b"], "k", "o", 3, c)
    assert {p: (n.attr, n.threshold) if n.attr else None for p, n in nodes.items()} == sequential(x, y, ["a", "b"], 3, c)
    late = [n for n in nodes.values() if n.attr and n.at > 6000]
    assert late
    leaf = {r["leaf"]: r for r in df.withColumn("leaf", hoeffding.route(nodes)).groupBy("leaf").agg(F.collect_list(F.struct("o", "k")).alias("rows")).collect()}
    for p, n in nodes.items():
        if n.attr is None and not n.gone:
            after = [r["k"] for r in leaf[p]["rows"] if r["o"] > n.at]
            assert n.n == len(after) and n.cls == int(np.bincount(after, minlength=3).argmax())


def test_learn_has_no_depth_limit(spark):
    c = hoeffding.Config(chunk=200, first_span=4096, gini=True, tie=1.0)
    x = np.tile(np.arange(20.0), 1500)[:, None]
    y = (x[:, 0] % 2).astype(int)
    df = spark.createDataFrame([(i, float(v), int(k)) for i, (v, k) in enumerate(zip(x[:, 0], y, strict=True))], "o long, a double, k int")
    nodes = hoeffding.learn(df, ["a"], "k", "o", 2, c)
    assert {p: (n.attr, n.threshold) if n.attr else None for p, n in nodes.items()} == sequential(x, y, ["a"], 2, c)
    assert max(map(len, nodes)) > 12


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=120), st.sampled_from(clustering.D))
def test_cf_tree_invariants(points, kind):
    t = birch.CFTree(2, threshold=4.0, branching=4, kind=kind)
    for p in points:
        t.insert(1.0, np.array(p, float), float(np.dot(p, p)))
    leaves = t.leaves()
    assert sum(n for _, n, *_ in leaves) == len(points)
    assert np.allclose(sum(ls for _, _, ls, _, _ in leaves), np.sum(points, 0))
    assert len({len(path) for *_, path in leaves}) == 1

    def check(node):
        assert len(node.kids) <= 4
        if not node.leaf:
            for i, k in enumerate(node.kids):
                assert np.allclose(node.ls[i], k.ls.sum(0)) and node.n[i] == k.n.sum()
                check(k)

    check(t.root)


def test_birch_partitions_keep_points(spark):
    df = spark.createDataFrame([(i, [float(i % 5) * 10, float(i % 3)]) for i in range(300)], "i int, x array<double>")
    for parts in (None, 3):
        e = birch.entry_table(df, birch.build(df, "x", ["i"], 2.0, partitions=parts)).collect()
        assert sum(r.cf.n for r in e) == 300
    a = birch.assign(df, "i", "x", birch.entry_table(df, birch.build(df, "x", ["i"], 2.0, partitions=3)))
    assert a.count() == 300


def test_fixed_child_index(spark):
    n = spark.createDataFrame([(1, None, None), (2, 1, 3), (3, 1, 1), (9, 7, 0)], "node long, parent long, child_index long")
    assert {r.node: r.child_index for r in evaluation.fixed_child_index(n).collect()} == {1: 0, 3: 0, 2: 1}
    assert tuple(evaluation.integrity(n).first())[:1] == (1,)


def test_split_bytes_across_ranges(spark):
    """Ranges of a few rows, files longer and shorter than a range, sizes of 0 and over the limit."""
    rng = random.Random(4)
    for most in (7, 40, 1000):
        sizes = [rng.choice([0, 1, 2, 3, 5, 9, 60]) for _ in range(300)]
        want, no, held = [], 0, 0
        for x in sizes:
            if held and held + x >= most:
                no, held = no + 1, 0
            held += x
            want.append(no)
        df = spark.createDataFrame(list(enumerate(sizes)), "i long, n long")
        got = rows.split_bytes(df, ["i"], "n", most, range_rows=16).orderBy("i").collect()
        assert [r.file_no for r in got] == want


def test_text_splits(spark):
    data = [(v, float(i % 7), {"red": 0, "blue": 1}.get(v, int(i % 7 > 3))) for i in range(4000) for v in ("red", "blue", "green", None)]
    df = spark.createDataFrame(data, "v string, x double, k int")
    c = hoeffding.Config()
    nodes = hoeffding.grow(df, ["v", "x"], "k", 2, c)
    assert nodes[""].attr == "v" and nodes[""].values == ("blue", "green", "red") and nodes["<1>"].attr == "x" and nodes["<1>"].threshold == 4.0
    out = hoeffding.classify(spark.createDataFrame([("red", 0.0), ("blue", 9.0), ("green", 3.0), ("green", 4.0), ("pink", 1.0), (None, 1.0)], "v string, x double"), nodes).collect()
    assert [r.leaf for r in out] == ["<2>", "<0>", "<1>L", "<1>R", "<?>", "<?>"] and [r.pred for r in out][:4] == [0, 1, 0, 1] and {r.pred for r in out[4:]} == {nodes[""].cls}
    assert hoeffding.table(df, nodes).where("node = '<1>L'").first()["parent"] == "<1>"


def test_stream_tree_grows_with_later_batches(spark):
    from grovekit.streaming import ingest

    tree = ingest.StreamingTree(["x", "y"], "k", 2)
    first = spark.createDataFrame([(float(i % 10), float(i % 3), 0) for i in range(2000)], "x double, y double, k int")
    tree.update(first, 0)
    assert tree.status() == {"rows": 2000, "nodes": 1, "depth": 0, "growing": 1} and tree.nodes[""].cls == 0
    later = spark.createDataFrame([(float(i % 10), float(i % 3), int(i % 10 > 4)) for i in range(30_000)], "x double, y double, k int")
    tree.update(later, 1)
    assert tree.nodes[""].attr == "x" and tree.nodes[""].threshold == 5.0 and tree.status()["nodes"] == 3
    assert (tree.nodes["L"].cls, tree.nodes["R"].cls) == (0, 1)


def test_nearest_in_blocks(spark, monkeypatch):
    points = spark.createDataFrame([(i, feature([(i % 17, i % 5)])) for i in range(60)], f"id long, cf {CF}")
    clusters = spark.createDataFrame([(i, feature([(i % 13, i % 4)])) for i in range(40)], f"cluster long, cf {CF}")
    whole = sorted(map(tuple, clustering.nearest(points, clusters).collect()))
    monkeypatch.setattr(clustering, "BLOCK_BYTES", 56 * 7)
    assert sorted(map(tuple, clustering.nearest(points, clusters).collect())) == whole


def test_frozen_leaf_counts_on(spark):
    c = hoeffding.Config(chunk=100, first_span=256, pre_prune=0.9, delta=0.5)
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 3000)
    df = spark.createDataFrame([(i, float(i % 3), int(k)) for i, k in enumerate(y)], "o long, a double, k int")
    n = hoeffding.learn(df, ["a"], "k", "o", 2, c)[""]
    assert n.gone and n.n_after == 3000 - n.at - 1 and n.errors == int((y[n.at + 1 :] != n.cls).sum())


def test_nearest_keeps_every_row_and_all_ties(spark):
    f = "struct<n:double,ls:array<double>,ss:double>"
    points = spark.createDataFrame([(1, (1.0, [0.0], 0.0)), (1, (1.0, [9.0], 81.0)), (1, (1.0, [9.0], 81.0)), (2, (1.0, [5.0], 25.0))], f"id long, cf {f}")
    clusters = spark.createDataFrame([(7, (1.0, [0.0], 0.0)), (3, (2.0, [20.0], 200.0)), (4, (1.0, [10.0], 100.0))], f"cluster long, cf {f}")
    got = sorted(tuple(r) for r in clustering.nearest(points, clusters).collect())
    assert got == [(1, 3, 1.0), (1, 3, 1.0), (1, 7, 0.0), (2, 3, 25.0)]
    assert [r.cluster for r in clustering.nearest(points, clusters.limit(0)).collect()] == [None] * 4
