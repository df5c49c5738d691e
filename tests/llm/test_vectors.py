"""op11, op12 and op13 against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grovekit.llm import codes, queries, topk, trie

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    ok = [(i, [math.floor(scale * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max([len(v) for _, v, _ in ok], default=0)
    w = max(1, -(-dim // parts))
    ok = [(i, v + [0] * (parts * w - len(v)), l) for i, v, l in ok]
    first = sorted(ok)[:entries]
    books = [[v[p * w : p * w + w] for _, v, _ in first] for p in range(parts)]

    def nearest(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], c)) for c in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        got = [[nearest(v, p)[0] for p in range(parts)] for _, v, _ in ok]
        for p in range(parts):
            for e in range(len(first)):
                mine = [v[p * w : p * w + w] for g, (_, v, _) in zip(got, ok) if g[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by = [], {}
    for i, v, l in ok:
        near = [nearest(v, p) for p in range(parts)]
        err = sum(d for _, d in near)
        by[l] = by.get(l, 0) + err
        out.append([i, "".join(f"{e:02x}" for e, _ in near), err, l])
    return sorted((i, c, e, by[l], sha) for i, c, e, l in out)


def got_codes(df):
    cols = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_codes_whole_table(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in t.collect()]
    assert got_codes(queries.op11_vector_codes(spark, SF)) == plain_codes(rows)


def test_codes_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 3.0]) for _ in range(10)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += [(70, None, 1), (71, [1.0, None], 1), (72, [float("nan")] * 10, 1), (73, [float("inf")] * 10, None), (74, [1.0], 2), (75, [], 2), (5, rows[5][1], 1), (5, rows[5][1], 1)]
    df = spark.createDataFrame(rows, VEC)
    assert got_codes(codes.compress(spark, df)) == plain_codes(rows)
    monkeypatch.setattr(codes, "FEW_LABELS", 0)  # labels by a shuffle
    assert got_codes(codes.compress(spark, df.withColumn("code", F.lit(1)).withColumn("_label", F.lit(2)))) == plain_codes(rows)


def test_codes_few_and_none(spark):
    assert got_codes(codes.compress(spark, spark.createDataFrame([], VEC))) == []
    rows = [(3, [1.0] * 8, None), (1, [2.0] * 8, 4)]
    assert got_codes(codes.compress(spark, spark.createDataFrame(rows, VEC))) == plain_codes(rows)
    far = [(i, [1e30 * (-1) ** i] * 8, 1) for i in range(3)]  # held at the ends
    got = got_codes(codes.compress(spark, spark.createDataFrame(far, VEC)))
    assert [g[2] for g in got] == [0, 0, 0] and got[0][1] == got[2][1] != got[1][1]


@pytest.mark.parametrize("scale", [30, 3000, 1 << 22])
def test_screen_finds_ties_and_near_ties(scale):
    rng = np.random.default_rng(scale)
    c = rng.integers(-scale, scale, (16, 8))
    c[9] = c[3]  # a tie of entries
    v = np.concatenate([rng.integers(-scale, scale, (500, 8)), c + rng.integers(-1, 2, c.shape), (c[:8] + c[8:]) // 2])
    best, d, again = codes.nearest_entries(v, c)
    true = ((v[:, None] - c) ** 2).sum(2)
    assert (best == true.argmin(1)).all() and (d == true.min(1)).all()
    assert 0 < again < true.size // 4


def plain_top(rows, k=10, every=100, scale=1024):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(ok) if m != n)[:k]
            out += [(i, r + 1, j, max(-(1 << 63), min((1 << 63) - 1, -x))) for r, (x, j) in enumerate(s)]
    return sorted(out)


def got_top(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_topk_whole_table(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert got_top(queries.op13_exact_topk(spark, SF)) == plain_top([(r.vec_id, r.embedding) for r in t.collect()])


def test_topk_prunes_and_stays_exact(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 10
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=6) * 0.05]) for i in range(900)]
    rows += [(2000 + i, rows[7][1]) for i in range(40)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r[0], r[1]) for r in df.collect()]
    assert got_top(topk.top_k(spark, df, k=4, every=10, pivots=24, group=8, block=64)) == plain_top(rows, 4, 10)
    # bounds leave most cells out
    dim, kept = 6, np.floor(np.array([r[1] for r in rows]) * 1024)
    top = (kept**2).sum(1).max()
    p = kept[:24]
    space = topk._Space(np.column_stack([p, np.sqrt(np.maximum(top - (p * p).sum(1), 0))]), top)
    d = space.rows(kept)
    near = [np.sort(d[d.argmin(1) == j, j])[:5] for j in range(24)]
    q = spark.createDataFrame([(0, 0, kept[0].tobytes(), 0)], "row long, vec_id long, vec binary, grp int")
    r = topk._ranges(topk._bounded(q, space, dim, near, 4), space, dim, np.zeros(24), np.full(24, np.inf)).collect()
    assert 0 < len(r) < 24


def test_topk_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, None), (200, [float("nan"), 1.0]), (300, []), (400, [1.0]), (5, [3.0, -1.0, 0.5]), (6, [1.0, None]), (None, [9.0, 9.0]), (-100, [-1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit(1)).withColumn("cell", F.lit("x"))
    assert got_top(topk.top_k(spark, df)) == plain_top(rows)
    assert topk.top_k(spark, df.limit(0)).collect() == []
    assert topk.top_k(spark, df.where("vec_id = 5")).collect() == []
    huge = [(i, [1e30 * ((-1) ** i), float(i)]) for i in range(6)]  # beyond doubles' whole numbers and longs
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    assert [(a, b) for a, b, _, _ in got_top(topk.top_k(spark, df, every=2))] == [(a, b) for a, b, _, _ in plain_top(huge, every=2)]
    middle = [(i, [float(1 << 19) + i, float(i)]) for i in range(6)]  # sums beyond 2**53
    df = spark.createDataFrame(middle, "vec_id long, embedding array<double>")
    assert got_top(topk.top_k(spark, df, every=2)) == plain_top(middle, every=2)


CONV = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = {}
    for c, t, r, x in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        own.setdefault(c, []).append((r or "", x or ""))
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids, out = {}, []
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids.get(n, [])) or 1
        saved[n] = sum(saved[k] for k in kids.get(n, [])) + (len(nodes[n]) - 1) * (len(n[-1][1]) if n else 0)
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(full[c]) == len(n)))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids.get(n, [])), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def got_trie(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_trie_whole_table(spark, sf):
    t = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in t.collect()]
    assert got_trie(queries.op12_prefix_trie(spark, f"/root/testdata/{sf}")) == plain_trie(rows)


def test_trie_copies_long_and_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["a", "b"]), rng.choice(["x", "yy"])) for c in range(150) for t in range(rng.randrange(0, 7))]
    rows += [(c, t, "u", f"long {t}") for c in (1003, 1007, 1011) for t in range(60 + c % 3)]  # shared far beyond a round
    rows += [(2001 + i, t, "u", "é" * t) for i in range(30) for t in range(3)]  # copies
    rows += [(3000, None, None, None), (3000, 0, "a", "null first"), (3001, 1, "a", "b"), (3002, 1, "", "ab"), (None, 1, "a", "b"), (-5, 0, "n", "minus"), (-100, 0, "n", "base")]
    df = spark.createDataFrame(rows, CONV).withColumn("depth", F.lit(1)).withColumn("n", F.lit("x"))
    assert got_trie(trie.prefix_trie(spark, df)) == plain_trie(rows)
    monkeypatch.setattr(trie, "PIECE", 7)
    monkeypatch.setattr(trie, "TURNS", 2)
    assert got_trie(trie.prefix_trie(spark, df)) == plain_trie(rows)


def test_trie_small(spark):
    assert trie.prefix_trie(spark, spark.createDataFrame([], CONV)).collect() == []
    one = [(7, 0, "u", "only")]
    assert got_trie(trie.prefix_trie(spark, spark.createDataFrame(one, CONV))) == plain_trie(one)
