"""Records of quoted files in blocks of any size against Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from grovekit.sources import delimited, records


def written(rng, rows):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    cell = lambda: "".join(rng.choice(['a', 'bc', '"', ",", "\n", "é", " x", "\n\n"]) for _ in range(rng.randrange(5)))
    starts, values = [], []
    for i in range(rows):
        starts.append(len(out.getvalue().encode()))
        values.append([str(i), cell(), cell()])
        w.writerow(values[-1])
    return out.getvalue().encode(), starts, values


def plain(raw, sep=b","):
    """Offsets and bytes of records by one pass over the file."""
    out, at, inside = [], 0, False
    i = 0
    while i < len(raw):
        end = raw.find(b"\n", i)
        end = len(raw) if end < 0 else end
        inside = records.leaves_open(raw[i:end], inside, sep)
        if not inside:
            out.append((at, raw[at:end].decode()))
            at = end + 1
        i = end + 1
    if inside:
        out.append((at, raw[at:].rstrip(b"\n").decode() if not raw.endswith(b"\n") else raw[at:-1].decode()))
    return out


@pytest.mark.parametrize("block", [300, 2000, None])
def test_blocks(spark, tmp_path, block):
    rng = random.Random(7)
    truth = {}
    for n in range(3):
        raw, starts, values = written(rng, 120)
        (tmp_path / f"f{n}.csv").write_bytes(raw)
        truth[f"f{n}.csv"] = (raw, starts, values)
    df = records.read_records(spark, str(tmp_path), block_bytes=block)
    got = df.withColumn("c", delimited.cells(F.col("value"))).collect()
    assert len(got) == 360
    for r in got:
        raw, starts, values = truth[r.file.rsplit("/", 1)[1]]
        i = starts.index(r.off)
        assert raw[r.off : r.off + r.len].decode() == r.value and raw[r.off + r.len : r.off + r.len + 1] == b"\n"
        assert r.c == [v if '"' in v or "," in v or "\n" in v else v.strip() for v in values[i]]
    if block == 300:
        assert records._lines(records._session(spark, block), str(tmp_path), False, ()).rdd.getNumPartitions() > 12


@pytest.mark.parametrize("block", [16, 64, None])
def test_odd_files(spark, tmp_path, block, monkeypatch):
    raws = {
        "open": b'a,"never closed\nx,y\n"" still\nlast',
        "crlf": b'1,"two\r\nlines"\r\n\r\n2,x\r\n',
        "late": b'x,say "no\n"q""r" tail,z\n,,\n  "blank before",w',
        "long": b'k,"' + b"0123456789\n" * 40 + b'"\nend,1\n',
        "empty": b"",
        "blank": b"\n\n",
    }
    for n, raw in raws.items():
        (tmp_path / n).write_bytes(raw)
    if block == 64:
        monkeypatch.setattr(records, "MANY_BLOCKS", 0)  # cases joined by a shuffle
    got = {}
    for r in records.read_records(spark, str(tmp_path), block_bytes=block).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.off, r.value))
    assert {n: sorted(v) for n, v in got.items()} == {n: plain(raw) for n, raw in raws.items() if raw}


def test_csv_and_points_in_blocks(spark, tmp_path):
    (tmp_path / "h.csv").write_text('id,"na\nme",x\n' + "".join(f'{i},"n ""{i}""\nsecond",{i / 2}\n\n' for i in range(50)))
    for block in (16, None):
        t = delimited.read_csv(spark, str(tmp_path / "h.csv"), header=True, block_bytes=block)
        assert t.columns == ["id", "na\nme", "x"]
        assert sorted((int(r[0]), r[1], float(r[2])) for r in t.collect()) == [(i, f'n "{i}"\nsecond', i / 2) for i in range(50)]
    p = delimited.read_points(spark, str(tmp_path / "h.csv"), [2], label=0, skip=1)
    assert sorted((r.label, r.x[0]) for r in p.collect()) == [(i, i / 2) for i in range(50)]


def test_long_quoted_cell(spark):
    long = "x" * 200_000 + '""' * 50_000
    df = spark.createDataFrame([(f'1,"{long}",2',)], "v string")
    assert df.select(delimited.cells(F.col("v")).alias("c")).first().c == ["1", long.replace('""', '"'), "2"]


def test_small_blocks_share_tasks(spark, tmp_path):
    path = str(tmp_path / "small.csv")
    with open(path, "w", newline="") as f:
        f.write("".join(f'{i},"x\n{i}"\n' for i in range(3000)))
    r = records.read_records(spark, path, block_bytes=256)
    assert r.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 4  # some 150 blocks
    assert sorted(x.value for x in r.collect()) == sorted(f'{i},"x\n{i}"' for i in range(3000))


def test_points_get_files_by_their_rows(spark, monkeypatch):
    """Each file is one task's to sort and write, so none is larger because the table is."""
    from grovekit.plans import catalogue, files

    made, text = [], files._text
    monkeypatch.setattr(files, "FILE_ROWS", 500)
    monkeypatch.setattr(files, "_text", lambda *a, **k: made.append(text(*a, **k)) or made[-1])
    got = catalogue.QUERIES["points_header_skip"](spark, "/root/testdata/sf0.001").collect()
    x = catalogue.read(spark, "/root/testdata/sf0.001", "lineitem")
    want = x.groupBy("l_orderkey", "l_quantity", "l_linenumber").count().collect()
    assert sorted(map(tuple, got)) == sorted((float(a), b, c, n) for a, b, c, n in want)
    assert spark.read.text(made[0]).select("file_no").distinct().count() == -(-x.count() // 500) > 4
