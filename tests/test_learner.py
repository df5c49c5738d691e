"""Histograms, and ordered learning with pruning, text attributes, later values and parents' votes, against a plain learner."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.operators import hoeffding, leaves
from grovekit.operators.histograms import ClassHistogram


def exact_below(v, y, t, classes=3):
    return np.bincount(y[v < t], minlength=classes)


@pytest.mark.parametrize("order", ["random", "sorted", "drift"])
def test_cuts_stay_exact_while_rows_are_added(order):
    rng = np.random.default_rng(1)
    v = rng.normal(size=20_000).round(4)
    v = np.sort(v) if order == "sorted" else v + np.linspace(0, 9, len(v)).round(4) if order == "drift" else v
    y = rng.integers(0, 3, len(v))
    h = ClassHistogram(3, 100)
    for a in range(0, len(v), 300):
        h.add(v[a : a + 300], y[a : a + 300])
        assert len(h.lo) <= 100 and (h.lo <= h.hi).all() and (h.hi[:-1] < h.lo[1:]).all()
    assert h.rows == len(v) and h.error == 0
    below = np.cumsum(h.n, 0)
    for k in range(1, len(h.lo)):
        assert (below[k - 1] == exact_below(v, y, h.lo[k])).all()


@pytest.mark.parametrize("parts", [2, 7, 40])
def test_merged_cuts_are_within_the_stated_error(parts):
    rng = np.random.default_rng(parts)
    v = np.concatenate([rng.normal(size=30_000), np.full(4_000, 0.5)])
    y = rng.integers(0, 3, len(v))
    deal = rng.integers(0, parts, len(v))
    hs = []
    for k in range(parts):
        h = ClassHistogram(3, 200)
        h.add(v[deal == k], y[deal == k])
        hs.append(h)
    one = hs[0]
    one.merge(*hs[1:])
    assert one.rows == len(v) and len(one.lo) <= 200
    off = max(abs(one.n[:k].sum() - (v < one.lo[k]).sum()) for k in range(1, len(one.lo)))
    assert off <= one.error and one.error < 0.03 * len(v)


def test_few_values_merge_exactly_in_any_order():
    rng = np.random.default_rng(0)
    v, y = rng.integers(0, 50, 900).astype(float), rng.integers(0, 2, 900)
    made = lambda m: [(h := ClassHistogram(2, 64)).add(v[i::3], y[i::3]) or h for i in m]
    a, b, c = made([0, 1, 2])
    b.merge(c)
    a.merge(b)
    z, w, x = made([2, 1, 0])
    z.merge(w)
    z.merge(x)
    whole = ClassHistogram(2, 64)
    whole.add(v, y)
    for h in (a, z):
        assert h.error == 0 and (h.lo == whole.lo).all() and (h.n == whole.n).all()


def lg_impurity(counts):
    n = sum(counts)
    return -sum(k / n * math.log2(k / n) for k in counts if k) if n else 0.0


class Plain:
    """A leaf with plain lists: bins [lo, hi, counts] and values' counts."""

    def __init__(self, numeric, words, classes):
        self.y, self.rows = [0] * classes, 0
        self.bins, self.values, self.active = {a: [] for a in numeric}, {a: {} for a in words}, len(numeric) + len(words)

    def add(self, row, y, buffered):
        for a, bins in self.bins.items():
            v = row[a]
            hit = next((b for b in bins if b[0] <= v <= b[1]), None)
            if hit is None:
                hit = [v, v, [0] * len(self.y)]
                bins.append(hit)
                bins.sort(key=lambda b: b[0])
            hit[2][y] += 1
        for a, t in self.values.items():
            if row[a] is not None:
                t.setdefault(row[a], [0] * len(self.y))[y] += 1

    def decide(self, c):
        k = len(self.y)
        found, index, cuts = [], {}, {}
        for a, bins in self.bins.items():
            if len(bins) > 1:
                total, n = [sum(b[2][i] for b in bins) for i in range(k)], sum(sum(b[2]) for b in bins)
                low, cuts[a] = [0] * k, []
                for b in bins[:-1]:
                    low = [x + z for x, z in zip(low, b[2])]
                    high = [x - z for x, z in zip(total, low)]
                    cuts[a].append((sum(low) * lg_impurity(low) + sum(high) * lg_impurity(high)) / n + (math.log2(len(bins) - 1) / n if len(bins) > 2 else 0))
                found += [(i, a, bins[j + 1][0]) for j, i in enumerate(cuts[a])]
                index[a] = min(cuts[a])
        for a, t in self.values.items():
            if len(t) > 1:
                n = sum(map(sum, t.values()))
                index[a] = sum(sum(x) * lg_impurity(x) for x in t.values()) / n
                found.append((index[a], a, None))
        if not found:
            return "wait", None, None
        (first, attr, at), *rest = sorted(found, key=lambda f: (round(f[0], 12), f[1], f[2] or 0))
        whole = lg_impurity(self.y)
        second = rest[0][0] if rest else whole
        bound = math.sqrt(math.log2(max(2, k)) ** 2 * math.log(self.active / c.delta) / (2 * sum(self.y)))
        if first - whole > bound:
            return "leaf", None, None
        if second - first > bound or (bound < c.tie and whole > first):
            return "split", attr, at
        if c.prune:
            ahead = {attr, rest[0][1]} if rest else {attr}
            for a, i in index.items():
                if i > first + bound and a not in ahead:
                    self.bins.pop(a, None)
                    self.values.pop(a, None)
                elif a in cuts:
                    kept = [self.bins[a][0]]
                    for i, b in zip(cuts[a], self.bins[a][1:]):
                        if i > first + bound:
                            kept[-1] = [kept[-1][0], b[1], [x + z for x, z in zip(kept[-1][2], b[2])]]
                        else:
                            kept.append(b)
                    self.bins[a] = kept
        return "wait", None, None


def plain_learn(rows, numeric, words, classes, c):
    """{path: (attr, threshold, class, n)}; children of text attributes by value."""
    tree, leaf, meta = {"": None}, {"": Plain(numeric, words, classes)}, {"": (-1, ())}

    def sprout(p, up, off):
        tree[p], leaf[p], meta[p] = None, Plain(numeric, [w for w in words if w not in off], classes), (up, off)

    for row, y in rows:
        p = ""
        while tree[p]:
            attr, at, up, off = tree[p]
            if at is not None:
                p += "L" if row[attr] < at else "R"
            elif row[attr] is None:
                p = None
                break
            else:
                q = f"{p}<{row[attr]}>"
                if q not in tree:
                    sprout(q, up, off)
                p = q
        if p is None:
            continue
        f = leaf[p]
        if f.rows is None:
            continue
        f.add(row, y, None)
        f.y[y] += 1
        f.rows += 1
        if f.rows % c.chunk == 0 and sum(k > 0 for k in f.y) > 1:
            what, attr, at = f.decide(c)
            if what == "leaf":
                f.rows = None
            elif what == "split":
                top = f.y.index(max(f.y))
                off = meta[p][1] + ((attr,) if at is None else ())
                tree[p] = (attr, at, top, off)
                for k in ("L", "R") if at is not None else [f"<{v}>" for v in sorted(f.values[attr])]:
                    sprout(p + k, top, off)
    out = {}
    for p, t in tree.items():
        y, up = leaf[p].y, meta[p][0]
        votes = [n + (c.laplace if k == up else 0) for k, n in enumerate(y)]
        out[p] = (*(t[:2] if t else (None, None)), votes.index(max(votes)) if sum(y) else up, sum(y))
    return out


def by_value(nodes):
    names = {"": ""}
    for p, n in sorted(nodes.items(), key=lambda x: x[1].depth):
        for i, v in enumerate(n.values or ()):
            names[f"{p}<{i}>"] = f"{names[p]}<{v}>"
        if n.threshold is not None:
            names[p + "L"], names[p + "R"] = names[p] + "L", names[p] + "R"
    return {names[p]: (n.attr, n.threshold, n.cls, n.n) for p, n in nodes.items()}


@pytest.mark.parametrize("prune", [True, False])
@pytest.mark.parametrize("laplace", [0.0, 5.0])
def test_learn_equals_a_plain_learner(spark, prune, laplace):
    """Numeric and text attributes, values held back to the second half, nulls, two attributes that only make noise."""
    rng = np.random.default_rng(11)
    n = 9000
    a, b, noise = rng.integers(0, 12, n).astype(float), rng.integers(0, 8, n).astype(float), rng.integers(0, 6, n).astype(float)
    w = np.array(["red", "green", "blue", "late", "later"], object)[np.where(np.arange(n) < n // 2, rng.integers(0, 3, n), rng.integers(0, 5, n))]
    hum = np.array(["x", "y", "z"], object)[rng.integers(0, 3, n)]
    y = np.where(w == "red", 0, np.where(w == "green", a > 5, np.where(w == "late", 2 * (b > 3), 1))).astype(int)
    y = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), y)
    w[rng.random(n) < 0.01] = None
    data = [({"a": a[i], "b": b[i], "noise": noise[i], "w": w[i], "hum": hum[i]}, int(y[i])) for i in range(n)]
    df = spark.createDataFrame([(i, *map(float, (r["a"], r["b"], r["noise"])), r["w"], r["hum"], k) for i, (r, k) in enumerate(data)], "o long, a double, b double, noise double, w string, hum string, k int")
    c = hoeffding.Config(chunk=100, first_span=700, tie=0.1, prune=prune, laplace=laplace, max_rows=900)
    nodes = hoeffding.learn(df, ["a", "b", "noise", "w", "hum"], "k", "o", 3, c)
    want = plain_learn(data, ["a", "b", "noise"], ["w", "hum"], 3, c)
    assert by_value(nodes) == want
    assert {"<late>", "<later>"} <= set(by_value(nodes)) or nodes[""].attr != "w"
    assert len(nodes) > 6
    # the tree as an expression and as steps
    small = {(r.o, r.leaf, r.pred) for r in hoeffding.classify(df, nodes).collect()}
    old, hoeffding.SMALL = hoeffding.SMALL, 0
    try:
        assert {(r.o, r.leaf, r.pred) for r in hoeffding.classify(df, nodes).collect()} == small
    finally:
        hoeffding.SMALL = old


def test_pruning_switches_off_what_lost():
    rng = np.random.default_rng(4)
    x, hum = rng.integers(0, 10, 3000).astype(float), rng.integers(0, 5, 3000).astype(float)
    y = np.where(rng.random(3000) < 0.3, rng.integers(0, 2, 3000), (x > 4).astype(int))
    f = leaves.Leaf(["hum", "x", "x2"], [], 2, 1000)
    f.learn({"x": x, "x2": x, "hum": hum}, y, hoeffding.Config(tie=0.0))  # x and x2 never part
    assert set(f.numeric) == {"x", "x2"} and len(f.numeric["x"].lo) < 10 and f.active == 3


def test_few_rows_follow_their_parent():
    y = np.array([3.0, 5.0, 0.0])
    assert leaves.vote(y, 0, 5.0) == 0 and leaves.vote(y, 0, 0.0) == 1 and leaves.vote(y * 0, 2, 5.0) == 2 and leaves.vote(y * 0, -1, 5.0) == -1


def test_children_know_how_many_rows_would_have_come(spark):
    df = spark.range(2000).select(F.col("id").alias("o"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 10 >= 4).cast("int").alias("k"))
    nodes = hoeffding.learn(df, ["a"], "k", "o", 2, hoeffding.Config(chunk=100))
    assert (nodes[""].n, nodes["L"].before, nodes["R"].before) == (100, 40, 60)
    assert nodes["L"].up == 1 and nodes["L"].cls == 0


def test_many_values_in_text_attributes(spark):
    """A child for each of 3,000 values: routed by steps, none of them in a plan."""
    df = spark.range(24_000).select(F.concat(F.lit("v"), F.col("id") % 3000).alias("v"), (F.col("id") % 7).cast("double").alias("x"), ((F.col("id") % 3000) % 2).cast("int").alias("k"))
    nodes = hoeffding.grow(df, ["v", "x"], "k", 2)
    assert nodes[""].attr == "v" and len(nodes) == 3001
    assert hoeffding.classify(df, nodes).where("pred <> k").count() == 0


def test_edges_are_exact_shares(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("x"), (F.col("id") % 4).cast("double").alias("few"), F.lit(None).cast("double").alias("none"))
    e = hoeffding.bin_edges(df, ["x", "few", "none"], 50)
    assert e == {"x": [100.0 * i for i in range(1, 50)], "few": [1.0, 2.0, 3.0], "none": []}


def steps(spark, n=6000):
    return spark.range(n).select(F.col("id").alias("o"), (F.col("id") * 13 % 16).cast("double").alias("a"), (F.col("id") * 7 % 5).cast("double").alias("b"), F.concat(F.lit("w"), F.col("id") % 3).alias("w")).withColumn(
        "k", F.when(F.col("a") < 4, 0).when(F.col("b") < 2, F.when(F.col("w") == "w0", 1).otherwise(2)).otherwise((F.col("a") > 9).cast("int"))
    )


def test_grow_with_a_budget_counts_the_rest_later(spark, monkeypatch):
    df, names = steps(spark), ["a", "b", "w"]
    whole = hoeffding.grow(df, names, "k", 3, hoeffding.Config(delta=1e-3))
    most, counts = [], hoeffding.level_counts
    monkeypatch.setattr(hoeffding, "level_counts", lambda r, *x: most.append(r.select("_leaf").distinct().count()) or counts(r, *x))
    small = hoeffding.grow(df, names, "k", 3, hoeffding.Config(delta=1e-3, budget=2))
    assert small == whole and len(whole) > 8 and max(most) <= 2


def test_streams_with_a_budget_sleep_and_wake(spark):
    from grovekit.streaming import ingest

    df = cut_into(steps(spark, 12_000), 6)
    c = hoeffding.Config(delta=1e-3, budget=2)
    tree = ingest.StreamingTree(["a", "b", "w"], "k", 3, c)
    slept, woke = set(), set()
    for i, batch in enumerate(df):
        before = set(tree.asleep)
        tree.update(batch, i)
        assert len(tree.counts) <= 2
        slept |= set(tree.asleep)
        woke |= before - set(tree.asleep)
    assert tree.rows == 12_000 and slept and woke
    best = sorted(tree._classes(p).sum() for p in tree.counts)
    assert tree.status()["asleep"] == len(tree.asleep) and best[0] > 0
    open_ = {**{p: tree._classes(p) for p in tree.counts}, **tree.asleep}
    got = {r.leaf: r.n for r in hoeffding.classify(df[-1], tree.nodes).groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    assert all(open_[p].sum() >= n for p, n in got.items())


def cut_into(df, parts):
    return [df.where(F.col("o") % parts == i).cache() for i in range(parts)]


@pytest.mark.parametrize("replicas", [2, 5])
def test_replicas_learn_the_tree_of_one(spark, replicas):
    df, names, c = steps(spark), ["a", "b", "w"], hoeffding.Config(delta=1e-3, chunk=200)
    one = hoeffding.learn_replicas(df, names, "k", "o", 3, 1, c, window=500)
    many = hoeffding.learn_replicas(df, names, "k", "o", 3, replicas, c, window=500)
    assert many == one and len(one) > 6
    assert one[""].at % 500 == 499 and one[""].n == one[""].at + 1  # at a merge point
    plain = evaluation_error(df, one)
    assert plain < 0.05


def evaluation_error(df, nodes):
    return hoeffding.classify(df, nodes).agg(F.avg((F.col("pred") != F.col("k")).cast("int"))).first()[0]


def test_replicas_of_many_values_stay_within_the_error(spark):
    df = spark.range(20_000).select(F.col("id").alias("o"), (F.col("id") * 7919 % 20_011).cast("double").alias("a")).withColumn("k", (F.col("a") > 9000).cast("int"))
    nodes = hoeffding.learn_replicas(df, ["a"], "k", "o", 2, 4, hoeffding.Config(bins=200), window=4000)
    assert nodes[""].attr == "a" and abs(nodes[""].threshold - 9000) < 20_011 / 50
    assert hoeffding.learn_replicas(df.limit(0), ["a"], "k", "o", 2, 4)[""].n == 0


def test_leaves_of_one_class_are_only_counted(spark, monkeypatch):
    """They took a job for each window, or for each ``max_rows``, up to the last row."""
    df = spark.range(20_000).select(F.col("id").alias("o"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 10 > 4).cast("int").alias("k"))
    jobs, cut = [], hoeffding.cut
    monkeypatch.setattr(hoeffding, "cut", lambda x: jobs.append(1) or cut(x))
    for nodes in (hoeffding.learn(df, ["a"], "k", "o", 2, hoeffding.Config(max_rows=500, first_span=500)), hoeffding.learn_replicas(df, ["a"], "k", "o", 2, 3, window=500)):
        at = nodes[""].at
        assert at < 2000 and [(nodes[p].n, nodes[p].cls) for p in "LR"] == [(df.where(f"o > {at} AND k = {k}").count(), k) for k in (0, 1)]
    assert len(jobs) < 12


def test_replicas_are_counted_by_one_aggregate(spark):
    """A task of the sum holds its groups once, not once for each replica and once more for the sum."""
    rows = [(float(i % 7), i % 2) for i in range(40)] + [(None, 1)]
    df = spark.createDataFrame(rows, "a double, cls int")
    got = hoeffding.merged_counts([df.where("cls = 0"), df.where("cls = 1"), df.where("a = 3")], ["a"], "cls")
    want = Counter(r for r in rows + [r for r in rows if r[0] == 3])
    assert {(r.value, r.cls): r.n for r in got.collect()} == want
    assert got._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 0 and got._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2
