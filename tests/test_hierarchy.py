"""Pointer doubling against plain walks."""

import random

from grovekit.operators import evaluation, hierarchy


def plain(rows):
    parent, weight = {}, {}
    for v, p, w in rows:
        if v is not None and (v not in parent or (p is not None, p or 0) < (parent[v] is not None, parent[v] or 0)):
            parent[v], weight[v] = p, w
    out, kids = {}, {}
    for v in parent:
        path = [v]
        while parent[path[-1]] in parent and len(path) <= len(parent):
            path.append(parent[path[-1]])
        if len(path) > len(parent):
            out[v] = (parent[v], "cycle", None, None, None, None, None, None)
            continue
        top = path[-1]
        out[v] = [parent[v], "ok" if parent[top] is None else "orphan", len(path) - 1, top, path[::-1], 0, 0.0]
    live = sorted((o[4], v) for v, o in out.items() if o[1] != "cycle")
    for place, (path, v) in enumerate(live):
        out[v].append(place)
        for u in path:
            out[u][5] += 1
            out[u][6] += weight[v] or 0.0
    return {v: tuple(o) for v, o in out.items()}


def test_trees_cycles_and_orphans(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(max(0, i - 3), i) if i % 40 else None, float(i % 5)) for i in range(1, 400)]
    rows += [(500, 999, 2.0), (501, 500, 1.0), (600, 602, 1.0), (601, 600, 1.0), (602, 601, 1.0), (603, 602, None), (700, 700, 1.0), (None, 1, 1.0), (5, 2, 9.0), (-3, None, 1.0)]
    df = spark.createDataFrame(rows, "node long, parent long, w double")
    got = {r.node: tuple(r)[1:] for r in hierarchy.hierarchy(df, weight="w").collect()}
    assert got == plain(rows)
    assert {v for v, o in got.items() if o[1] == "cycle"} == {600, 601, 602, 603, 700} and got[501][1] == "orphan"


def test_long_chain_and_nothing(spark):
    df = spark.range(1, 301).selectExpr("id AS node", "nullif(id - 1, 0) AS parent")
    got = {r.node: r for r in hierarchy.hierarchy(df).collect()}
    assert got[300].depth == 299 and got[300].pre_order == 299 and got[1].size == 300 and got[150].path == list(range(1, 151))
    assert hierarchy.hierarchy(df.limit(0)).count() == 0


def test_paths_stay_short_below_cycles(spark, monkeypatch):
    """Nodes that never get to a top gather nothing: their paths doubled with each round."""
    longest, write = [0], hierarchy.written

    def watched(df):
        out = write(df)
        if "path" in out.columns:
            longest.append(out.selectExpr("max(size(path))").first()[0] or 0)
        return out

    monkeypatch.setattr(hierarchy, "written", watched)
    df = spark.range(1, 2001).selectExpr("id AS node", "CASE WHEN id = 1 THEN NULL WHEN id = 5 THEN 10 ELSE id DIV 2 END AS parent")
    got = {r.node: tuple(r)[1:] for r in hierarchy.hierarchy(df).collect()}
    assert got == plain([(r.node, r.parent, 1.0) for r in df.collect()])
    assert max(longest) <= 11


def test_path_index_in_ranges(spark):
    rows = [(i, [i % 3, i % 7, i]) for i in range(200)] + [(1000, []), (1001, [0])]
    df = spark.createDataFrame(rows, "id long, path array<int>")
    got = {r.id: r.pre_order for r in evaluation.path_index(df, "path").collect()}
    assert [v for v, _ in sorted(got.items(), key=lambda x: x[1])] == [i for i, _ in sorted(rows, key=lambda r: r[1])]
