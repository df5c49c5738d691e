"""run() against a plain Python version of its five stages, on all documents of the smallest table."""

import gc
import re
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_llm import brute_components, brute_quality, key

import corpus_pipeline
from grovekit.llm import common, repetition, templates, tokens

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def good(x):
    r = repetition.Rules()
    n, _, _, _, repeated, covered, longest = brute_quality(x, r.repeat_words)
    return n >= 10 and 100 * repeated <= 20 * n and covered <= r.most_covered * n and longest <= r.longest


def without_templates(docs, t=templates.Tree()):
    lines = []
    for d, x in docs:
        for pos, line in enumerate(x.split("\n")):
            raw = re.findall("[^\x20\x09-\x0d]+", line)
            if raw:
                tok = ["<*>" if re.search("[0-9]", w) else w for w in raw]
                c = sum(w != "<*>" for w in tok)
                use = c == len(tok) or (c >= t.least_constant and 2 * c >= len(tok))
                lines.append([d, pos, tok, (len(tok), *tok[: t.depth]), tuple(tok if use else raw)])
    leaves = defaultdict(list)
    for x in lines:
        if len(x[2]) >= t.least_tokens:
            leaves[x[3]].append(x)
    for leaf, xs in leaves.items():
        if len({x[4] for x in xs}) < 2 or len(xs) < t.min_docs:
            continue
        counts = [Counter(x[2][p] for x in xs) for p in range(leaf[0])]
        often = [{w for w, k in c.items() if k >= t.min_docs and k >= t.share * len(xs)} for c in counts]
        for x in xs:
            kept = [w if w in often[p] else None for p, w in enumerate(x[2])]
            agree, fixed = sum(w is not None for w in kept), sum(w not in (None, "<*>") for w in kept)
            if agree >= t.similarity * leaf[0] and 2 * fixed >= leaf[0]:
                x[4] = ("leaf", *(w or "<*>" for w in kept))
    by = defaultdict(list)
    for x in lines:
        by[x[4]].append((x[0], x[1]))
    gone = {p for v in by.values() if len({d for d, _ in v}) >= t.min_docs for p in v if p != min(v)}
    return [(d, "\n".join(s for i, s in enumerate(x.split("\n")) if (d, i) not in gone)) for d, x in docs]


def without_windows(docs, length=200):
    c = Counter()
    for _, x in docs:
        b = x.encode()
        c.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = []
    for d, x in docs:
        b = x.encode()
        m = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if c[b[j : j + length]] > 1:
                m[j : j + length] = b"\1" * length
        kept = [b[r.start() : r.end()].decode(errors="ignore") for r in re.finditer(b"\0+", bytes(m))]
        out.append((d, "".join(kept)))
    return out


def test_pipeline(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = without_templates([(d, x) for d, x in docs if x and good(x)])
    stay = {d for d, _, c in brute_components(docs, 5, 80) if d == c}
    docs = without_windows([(d, x) for d, x in docs if d in stay])
    lib, want = tokens.encoder(P.path("word_bpe_49k.json"), False).lib, []
    for d, x in docs:
        ids = np.array([*lib.encode(x, add_special_tokens=False).ids, 0], "<u4")
        want += [(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 2048) + 1  # the bound ignores that pieces stay whole


def test_stages_keep_columns(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, SF).columns == docs.columns, name


def test_a_stage_drops_what_another_keeps_in_a_worker():
    path, rows = P.path("word_bpe_49k.json"), pa.record_batch({"doc_id": pa.array([1]), "text": pa.array(["some words"])})
    list(tokens.token_slices(iter([rows]), path, False))
    memo = weakref.ref(tokens.encoder(path, False))
    list(tokens.token_slices(iter([rows]), path, False))
    assert memo() is tokens.encoder(path, False)  # the next task of the same operator uses it
    list(common.slices(iter([rows])))
    gc.collect()
    assert memo() is None
