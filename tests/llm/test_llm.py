"""The ten operators against brute force on hard little tables, and their queries' SQL."""

import hashlib
import io
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grovekit.llm import common, media, ngram_join, packing, paragraphs, pieces, repair, repetition, rollup, sharing, substrings, templates, tokens

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, places long, h long, keep string"
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n)).capitalize() + "."


def hard_rows():
    """Nulls, empty and blank texts, a very long one, exact and near copies, repeated rows, clashing extra columns."""
    base = [" ".join(sentence(12) for _ in range(10)) for _ in range(12)]
    near = base[0].split(" ")
    near[40] = "changed"
    passage = " ".join(sentence(13) for _ in range(6))
    texts = [None, "", " \n\t", "one", "One two", *base, base[0], " ".join(near), base[1] + "\n" + base[2], "x " + passage + " y z", base[3][:300] + " " + passage + "\nü é 日本 \x1c    end", " ".join(sentence(9) for _ in range(3000)), ("ab" * 900), "a" * 1000]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)] + [(3, base[5]), (3, base[5]), (None, base[6]), (None, None)]
    return [(d, t, "en", "s", len(t or ""), "x", 1, 2, "k") for d, t in rows]


ROWS = hard_rows()
TEXTS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is None, str(x)) for x in r)


def rows_of(df, n=None):
    return sorted((tuple(r)[:n] for r in df.collect()), key=key)


# what they share


def thue_morse(n):
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x


def test_hashes_tell_regular_strings_apart():
    """Sums of powers modulo 2**64 are equal for these whatever the base."""
    x = thue_morse(12)
    y = x.translate(str.maketrans("ab", "ba"))
    data, offs = common.text_arrays(pa.array([x, y]))
    s = common.prefix_hash(data)
    assert len(set(common.quick_hash(s, offs[:-1], offs[1:]).tolist())) == 1 and len(set(common.span_hash(s, offs[:-1], offs[1:]).tolist())) == 2
    got = repetition.measures(*common.text_arrays(pa.array([f"{x}\n{y}"])), repetition.Rules())
    assert got["n_dup_lines"].tolist() == [0]
    data, offs = common.text_arrays(pa.array(["." * 3 + x, x]))
    s = common.prefix_hash(data)
    assert common.span_hash(s, offs[:-1] + [3, 0], offs[1:]).tolist()[0] == common.span_hash(s, offs[1:2], offs[2:]).tolist()[0]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch_dir(Session())


def test_extra_columns_of_any_name(spark):
    """Helper columns give way to columns of the input."""
    rows = [(i, sentence(30) + "\nA line that is in all of these texts here", *"abcdefg") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, g string, h string, spans string, places string, lines string, keep string")
    for out in (templates.drop_recurring(df), substrings.without_repeats(spark, df, 30, 8), ngram_join.one_per_group(spark, df)):
        assert out.columns == df.columns and {tuple(r)[2:] for r in out.collect()} == {tuple("abcdefg")}
    image = spark.createDataFrame([(bytearray(b"P5 1 1 255\n\x01"), 5)], "image binary, npy int")
    assert media.media_columns(image, "image").columns == ["image", "npy", "npy_", "tile_npy", "dhash", "height", "width"]


# 1


def brute_components(docs, k, percent):
    sets = []
    for _, x in docs:
        w = (x or "").encode().lower().split()
        m = min(k, len(w))
        sets.append(frozenset(tuple(w[i : i + m]) for i in range(len(w) - m + 1)) if w else frozenset())
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = defaultdict(list)
    for g, (d, _) in zip(group, docs, strict=True):
        low[g].append(d)
    return sorted(((d, len(s), min((x for x in low[g] if x is not None), default=None)) for (d, _), s, g in zip(docs, sets, group, strict=True)), key=key)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, empty, k, percent):
    assert rows_of(ngram_join.similar_texts(spark, docs, k, percent), 3) == brute_components(TEXTS, k, percent)
    assert ngram_join.similar_texts(spark, empty, k, percent).count() == 0


def test_one_per_group(spark, docs):
    kept = ngram_join.one_per_group(spark, docs)
    assert kept.columns == docs.columns
    want = {(d, c) for d, _, c in brute_components(TEXTS, 5, 80) if d == c}
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in want}


def test_chains_of_near_copies(spark):
    words, rows = [f"w{i}" for i in range(100)], []
    for i in range(60):
        words = [*words]
        words[i] = f"n{i}"
        rows.append((1000 - i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ngram_join.similar_texts(spark, df, 3, 90), 3) == brute_components(rows, 3, 90)


@pytest.mark.parametrize("bits", [27, 15])
def test_shared_keys_in_parts(spark, monkeypatch, bits):
    monkeypatch.setattr(sharing, "BITS", bits)
    h = np.random.default_rng(3).integers(0, 1 << 64, 12_000, np.uint64)
    twice, once = h[:2000], h[2000:]
    near = once ^ np.uint64(1 << 30)  # equal in the first 32 bits
    rows = np.concatenate([twice, twice, once, near]).view(np.int64).tolist()

    def keys(batches):
        for b in batches:
            yield sharing.key40(b.column(0).to_numpy().view(np.uint64))

    known = sharing.shared_keys(spark.createDataFrame([(x,) for x in rows], "h long").repartition(3), keys, 1 / 8, width=40, parts=True)
    assert len(known.parts) == max(1, 1 << (20 - bits if bits < 20 else 0)) and all(len(b.value) <= (1 << bits) // 8 for b in known.parts)
    assert known.shared(sharing.key40(twice)).all()
    assert known.shared(sharing.key40(np.concatenate([once, near]))).mean() < 0.01
    known.destroy()


def test_unrelated_texts_list_nothing_however_many_keys_are_shared(spark, monkeypatch):
    rnd, rows, seen, linked_sets = random.Random(5), [], [], ngram_join.linked_sets
    text = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(205)]
    for i in range(400):
        words = text()
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words, "more"])), (3 * i + 2, " ".join(text()))]

    def linked(postings, sets, percent):
        seen.append((postings.select("sig").distinct().count(), sets.count()))
        return linked_sets(postings, sets, percent)

    monkeypatch.setattr(ngram_join, "linked_sets", linked)
    monkeypatch.setattr(sharing, "BITS", 15)  # for 80,000 keys that two texts share
    got = ngram_join.similar_texts(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 80, links=False)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(d, d - (d % 3 == 1)) for d, _ in rows}
    assert seen == [(800, 800)]


def brute_links(rows, k, percent):
    sets = [set(zip(*[w[i:] for i in range(k)])) or ({tuple(w)} if w else set()) for _, t in rows for w in [(t or "").lower().split()]]
    return sorted((d, sum(1 for j, y in enumerate(sets) if i != j and x and y and 100 * len(x & y) >= percent * len(x | y))) for i, ((d, _), x) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("bucket", [4, 512])
def test_all_links(spark, monkeypatch, bucket):
    """Mutually similar texts, chains, two groups and copies: every text gets the number of all similar ones."""
    monkeypatch.setattr(sharing, "BUCKET", bucket)
    rows, base, other = [], [f"w{i}" for i in range(100)], [f"v{i}" for i in range(60)]
    for i in range(12):
        words = [*base]
        words[i * 8] = f"n{i}"
        rows.append((i, " ".join(words)))
        rows.append((100 + i, " ".join([*other, *[f"x{j}" for j in range(i % 4)]])))
    for i in range(20):
        base = [*base]
        base[i] = f"m{i}"
        rows.append((200 + i, " ".join(base)))
    rows += [(300, rows[0][1]), (301, rows[3][1]), (302, None), (303, "one"), (304, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar_texts(spark, df, 3, 90)
    assert sorted((r.doc_id, r.n_links) for r in got.collect()) == brute_links(rows, 3, 90)
    assert rows_of(got, 3) == brute_components(rows, 3, 90)


@pytest.mark.parametrize("links", [True, False])
def test_texts_that_miss_each_other_make_no_pairs(spark, monkeypatch, links):
    """Edits of one text, no two of them similar, meet in its lists: they are told apart under one pivot, not pair by pair."""
    made, across = [], sharing._across
    monkeypatch.setattr(sharing, "_across", lambda *a: made.append(sharing.cut(across(*a))) or made[-1])
    monkeypatch.setattr(sharing, "BUCKET", 16)
    rows, base = [], [f"w{i}" for i in range(100)]
    for i in range(30):
        words = [*base]
        words[3 * i] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(100, rows[4][1] + " more"), (101, "one " + rows[7][1])]
    got = ngram_join.similar_texts(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, links)
    assert rows_of(got, 3) == brute_components(rows, 3, 90)
    if links:
        assert sorted((r.doc_id, r.n_links) for r in got.collect()) == brute_links(rows, 3, 90)
    assert made[0].count() < 30


def test_differences_that_many_sets_share():
    """Elements that few sets have are counted pair by pair, others by products: the answers are those of whole sets."""
    rng = np.random.default_rng(5)
    base = np.arange(200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 195, replace=False), rng.integers(1000, 1000 + 10 ** int(rng.integers(1, 4)), 8).astype(np.uint64)])) for _ in range(60)]
    got = sharing._similar(np.array([len(x) for x in sets]), [np.setxor1d(x, base) for x in sets], 90)
    np.fill_diagonal(got, True)
    assert got.tolist() == [[100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y)) for y in sets] for x in sets]
    ok = np.zeros((7, 7), bool)
    for a, b in ((5, 1), (1, 6), (3, 4)):
        ok[a, b] = ok[b, a] = True
    assert sharing._least(ok).tolist() == [0, 1, 2, 3, 3, 1, 1]


# 2


def test_paragraphs(spark, docs, empty):
    got = paragraphs.paragraph_report(spark, docs).collect()
    assert len(got) == len(TEXTS) and paragraphs.paragraph_report(spark, empty).count() == 0
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    ids = [d for d, _ in TEXTS]
    copy, near, mixed, first, second = ids[17], ids[18], ids[19], ids[20], ids[21]
    for d in (copy, near, mixed, first, second):
        assert by[d][0].n_repeated > 0, d
    assert max(copy, near, ids[5]) in {d for d in (copy, near, ids[5]) if by[d][0].n_removed}
    assert by[max(first, second)][0].n_removed > 0 and by[ids[22]][0].n_removed == 0
    for d in (ids[9], ids[12], ids[13]):  # clean ones
        assert by[d][0].n_removed == by[d][0].n_repeated == 0
    assert {r.n_bytes - len(r.kept_text.encode()) - r.removed_bytes for r in got} == {0}


def test_paragraph_sets_are_written_for_different_sets_only(spark, monkeypatch):
    """Exact copies share band values, but no list with a different set: of these only the ids are needed."""
    lines = [" ".join(sentence(14) for _ in range(3)) for _ in range(40)]
    near = lines[0].rsplit(" ", 1)[0] + " changed."
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*lines, near, *lines])], "doc_id long, text string").repartition(4, "doc_id").withColumn("h", F.xxhash64("text"))
    written, real = [], sharing._listed
    monkeypatch.setattr(sharing, "_listed", lambda rows, sets: written.append(sets.count()) or real(rows, sets))
    with common.Scratch() as scratch:
        roots = {r.doc_id: bytes(r.root) for r in paragraphs.paragraph_clusters(spark, docs, scratch).where("unit = 'line'").collect()}
    assert 2 <= written[0] < 8
    assert len(set(roots.values())) == 40 and roots[0] == roots[40] == roots[41]


def test_paragraph_clusters_against_brute_force(spark):
    """Lines with the same root are linked by similar lines; of all similar pairs at least nine in ten share a root."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, (_, t) in enumerate(TEXTS) if t and len(t) < 20_000], "doc_id long, text string"))
    texts = {r.doc_id: r.text.encode() for r in docs.collect() if r.text}
    with common.Scratch() as scratch:
        got = paragraphs.paragraph_clusters(spark, docs.withColumn("h", F.xxhash64("text")), scratch).where("unit = 'line'").collect()
    roots = defaultdict(set)
    for r in got:
        w = texts[r.doc_id][r.start : r.end].lower().split()
        roots[frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))].add(bytes(r.root))
    assert {len(v) for v in roots.values()} == {1}
    by, near = defaultdict(list), set()
    for s in roots:
        for g in s:
            by[g].append(s)
    for v in by.values():
        near |= {(a, b) for a in v for b in v if a != b and 100 * len(a & b) >= 80 * len(a | b)}
    same = [roots[a] == roots[b] for a, b in near]
    assert len(near) > 10 and sum(same) >= 0.9 * len(near)
    group = {s: s for s in roots}

    def top(s):
        while group[s] != s:
            s = group[s]
        return s

    for a, b in near:
        group[top(a)] = top(b)
    clusters = defaultdict(set)
    for s, r in roots.items():
        clusters[min(r)].add(top(s))
    assert {len(v) for v in clusters.values()} == {1}


def test_sets_of_many_rows_equal_those_of_one():
    rng = np.random.default_rng(8)
    for k in (1, 3, 5):
        n = np.array([0, 1, 2, 5, 0, 40, 4, 300, 0])
        h, at = rng.integers(0, 9, n.sum()).astype(np.uint64), np.concatenate([[0], np.cumsum(n)])
        flat, bounds = common.shingle_sets(h, at, k)
        ids = sharing.set_ids(flat, bounds)
        for i in range(len(n)):
            want = common.shingles_of(h[at[i] : at[i + 1]], k)
            assert np.array_equal(flat[bounds[i] : bounds[i + 1]], want)
            assert ids[i].tobytes() == sharing.set_id(want)
    flat, bounds = common.shingle_sets(np.zeros(0, np.uint64), np.zeros(1, np.int64), 5)
    assert len(flat) == 0 and bounds.tolist() == [0] and sharing.set_ids(flat, bounds).shape == (0, 2)


def test_sets_in_the_order_of_the_text_equal_sorted_ones():
    rng = np.random.default_rng(9)
    for k in (1, 3, 5):
        h, at = rng.integers(0, 4, 400).astype(np.uint64), np.array([0, 0, 3, 4, 60, 61, 90, 400, 400])
        flat, bounds = common.shingle_sets(h, at, k)
        other, same = common.shingle_sets(h, at, k, ordered=False)
        assert bounds.tolist() == same.tolist() and np.array_equal(sharing.set_ids(flat, bounds), sharing.set_ids(other, same))
        assert all(np.array_equal(flat[i:j], np.sort(other[i:j])) for i, j in itertools.pairwise(bounds.tolist()))


def test_many_pivots_are_decided_together(spark, monkeypatch):
    """Groups of few sets share a call, whatever batch they begin and end in; the answers are those of all pairs."""
    rng, calls = np.random.default_rng(10), spark.sparkContext.accumulator(0)
    sets, member = {}, []
    for size in [*[2, 3] * 150, 70, 65]:
        base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        sigs = []
        for _ in range(size):
            x = np.unique(np.concatenate([rng.choice(base, int(rng.integers(48, 60)), replace=False), rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)]))
            sigs.append(sharing.set_id(x))
            sets[sigs[-1]] = x
        member += [(s, sigs[0], False) for s in sigs]
    real = sharing._links

    def counted(t, percent):
        calls.add(1)
        return real(t, percent)

    monkeypatch.setattr(sharing, "_links", counted)
    given = spark.createDataFrame([(s, x.tobytes(), 1) for s, x in sets.items()], "sig binary, blob binary, copies long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {bytes(r.sig): (r.n_links, bytes(r.link)) for r in sharing._within(spark.createDataFrame(member, "sig binary, pivot binary, main boolean"), given, 80).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    similar = defaultdict(set)
    for (s, p, _), (t, q, _) in itertools.permutations(member, 2):
        if p == q and 100 * len(np.intersect1d(sets[s], sets[t])) >= 80 * len(np.union1d(sets[s], sets[t])):
            similar[s].add(t)
    assert {s: n for s, (n, _) in got.items()} == {s: len(similar[s]) for s, _, _ in member}
    assert sum(len(x) > 0 for x in similar.values()) > 100 and all(link == s or similar[s] for s, (_, link) in got.items())
    assert 0 < calls.value < 100  # of 302 groups


def test_band_recall():
    rng, met = np.random.default_rng(2), 0
    for _ in range(300):
        a = rng.integers(0, 1 << 63, 90).astype(np.uint64)
        b = np.concatenate([a[:80], rng.integers(0, 1 << 63, 10).astype(np.uint64)])  # Jaccard 0.8
        x, y = paragraphs.bands_of(np.concatenate([a, b]), np.array([0, 90, 180]))
        met += (x == y).any()
    assert met >= 297


# 3


def brute_quality(x, m):
    w = re.findall("[^\x20\x09-\x0d]+", x or "")
    n = len(w)

    def cover(k):
        at = defaultdict(list)
        for i in range(n - k + 1):
            at[tuple(w[i : i + k])].append(i)
        return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + k)})

    lines = [t for t in (x or "").split("\n") if re.search("[^\x20\x09-\x0d]", t)]
    longest = 0
    while longest < n and max(Counter(tuple(w[i : i + longest + 1]) for i in range(n - longest)).values()) > 1:
        longest += 1
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), cover(5), cover(m), longest


def test_quality(docs, empty):
    m = repetition.Rules().repeat_words
    short = [(d, x) for d, x in TEXTS if len(x or "") < 20_000]
    want = sorted(((d, *brute_quality(x, m)) for d, x in short), key=key)
    assert rows_of(repetition.quality(docs.where("coalesce(length(text), 0) < 20000")), 8) == want
    assert repetition.quality(empty).count() == 0 and repetition.keep_good(docs).columns == docs.columns


def verdict(n, repeated, covered, longest):
    r = repetition.Rules()
    failed = n < 10 or 100 * repeated > 20 * n
    return failed, not failed and covered <= r.most_covered * n and longest <= r.longest


def test_verdicts(spark):
    """Every limit decides some text: few words, repeats of five, covered share, longest repeat."""
    plain, ten, long_ = sentence(93), sentence(11), sentence(51)
    texts = [sentence(9), plain, f"{sentence(8)} {sentence(6)} " * 3, f"{plain} {ten} {sentence(5)} {ten}", f"{sentence(900)} {long_} {sentence(9)} {long_}", f"{sentence(900)} {ten} {sentence(9)} {ten}", None, ""]
    got = {r.doc_id: (r.base_failed, r.kept) for r in repetition.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    figures = [brute_quality(x, repetition.Rules().repeat_words) for x in texts]
    assert got == {i: verdict(f[0], f[4], f[5], f[6]) for i, f in enumerate(figures)}
    assert [got[i] for i in range(6)] == [(True, False), (False, True), (True, False), (False, False), (False, False), (False, True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab #\n", max_size=40), min_size=1, max_size=4))
def test_repeats(texts):
    data, offs = common.text_arrays(pa.array(texts))
    got = repetition.measures(data, offs, repetition.Rules())
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in repetition.FIGURES) == brute_quality(t, repetition.Rules().repeat_words)


# 4 and 5

ODD = ["", " a  b\n\n c<|endoftext|>", "a　b c", "É 'S don't Σας ΟΔΟΣ a", "́a ́ ", "a \n b", "a\nb, c. d…, “x”. ,", "\n", "x\n", "a\tb", "a\x1cb", "é, à. ×, ab÷.", "a,b., c.,"]


@pytest.mark.parametrize("name,space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_library(name, space):
    e = tokens.Encoder(P.path(name), space)
    texts = ODD + [x or "" for _, x in TEXTS]
    for _ in range(2):
        ids, offs = e(*common.text_arrays(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [x.ids for x in e.lib.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=300), min_size=1, max_size=6))
def test_grammar_round_trip(lists):
    flat = np.array([x for v in lists for x in [*v, 0]], np.uint32)
    offs = np.concatenate([[0], np.cumsum([len(v) + 1 for v in lists])])
    s = repair.Shard(repair.compress(flat, offs, 7))
    back, at = s.all()
    assert (back == flat).all() and (at == offs).all()
    for i, v in enumerate(lists):
        assert s.ids(i).tolist() == [*v, 0] and s.ids(i, 1, 5).tolist() == [*v, 0][1:5]


def test_grammar_replaces_pairs_of_rare_symbols():
    """Pairs of any symbols count, also where thousands of others are as frequent."""
    rng = np.random.default_rng(3)
    pair = rng.integers(0, 50_000, (6000, 2)).astype(np.uint32)
    ids = np.concatenate([pair[rng.permutation(6000)].reshape(-1) for _ in range(8)])
    s = repair.Shard(repair.compress(ids, np.array([0, len(ids)]), 50_000))
    assert (s.all()[0] == ids).all() and s.n_seq < 0.6 * len(ids) and len(s.rules) >= 5900
    deep = np.tile(rng.integers(0, 50_000, 700).astype(np.uint32), 40)
    s = repair.Shard(repair.compress(deep, np.array([0, len(deep)]), 50_000))
    assert (s.all()[0] == deep).all() and s.n_seq < 200 and s.length.max() > 64


def library_ids(name):
    lib = tokens.encoder(P.path(name), name.startswith("byte")).lib
    return {x: np.array([*lib.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for _, x in TEXTS}


def test_whole_shards_are_read_without_expanding_round_by_round(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [np.tile(rng.integers(0, 300, 40), 12), np.zeros(0, np.int64), rng.integers(0, 300, 500), np.tile(rng.integers(0, 9, 7), 90)]
    offs = np.cumsum([0, *map(len, texts)])
    shard = repair.Shard(repair.compress(np.concatenate(texts).astype(np.uint32), offs, 300))
    assert len(shard.rounds) > 3
    assert all((shard.ids(i) == t).all() and len(shard.ids(i)) == len(t) for i, t in enumerate(texts))
    monkeypatch.setattr(repair.Shard, "_expand", None)
    ids, at = shard.all()
    assert ids.dtype == np.uint32 and ids.tolist() == np.concatenate(texts).tolist() and at.tolist() == offs.tolist()
    for width in (1, 17, 32, 33, 40):
        x = rng.integers(0, 1 << width, 1000)
        packed = np.frombuffer(repair.pack_bits(x, width), np.uint8)
        assert (repair.unpack_bits(packed, width, 3, 997) == x[3:997]).all() and packed.tobytes() == np.packbits((x[:, None] >> np.arange(width - 1, -1, -1)) & 1).tobytes()


def test_token_output(spark, docs, empty):
    ids = library_ids("byte_bpe_50k.json")
    got = repair.token_output(spark, docs, P.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    order = [(r.doc_id is not None, r.doc_id) for r in got]
    assert order == sorted(order, key=lambda x: (x[0], x[1] or 0))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(((d, len(ids[x]), zlib.crc32(ids[x].tobytes())) for d, x in TEXTS), key=key)
    assert repair.token_output(spark, empty, P.path("byte_bpe_50k.json")).count() == 0


def test_packing(spark, docs, empty):
    ids = library_ids("word_bpe_49k.json")
    got = packing.pack_documents(spark, docs, P.path("word_bpe_49k.json"), with_ids=True).collect()
    want = [(d, k // 2048, k, len(v[k : k + 2048]), zlib.crc32(v[k : k + 2048].tobytes())) for d, x in TEXTS for v in [ids[x]] for k in range(0, len(v), 2048)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) == -(-sum(r.length for r in got) // 2048)
    assert packing.pack_documents(spark, empty, P.path("word_bpe_49k.json")).count() == 0


def best_packing(sizes, cap):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= cap and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominance_keeps_the_optimum(sizes):
    sizes = sorted(sizes, reverse=True)
    count = np.bincount(sizes, minlength=21).astype(np.int64)
    fixed = packing.reduce_dominated(count, 20)
    left = [s for s in range(20, 0, -1) for _ in range(int(count[s]))]
    assert sum(k for _, k in fixed) + (best_packing(left, 20) if left else 0) == best_packing(sizes, 20)
    plan = packing.plan(dict(Counter(sizes)), 20)
    assert plan["sequences"][0] <= best_packing(sizes, 20) + 1


# 6


def test_templates(spark, empty):
    legal = "Licensed under the Free License version 2"
    rows = [(i, f"{sentence(9)}\n{legal}\nRequest {i} served in {i * 7} ms from cache\nLogin to the main portal by {WORDS[i]} was made today") for i in range(30)]
    rows += [(50, None), (51, ""), (52, "\n \n"), (53, f"{legal}\n{legal}"), (None, legal)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", 1, 2, "k") for d, t in rows], SCHEMA)
    out = {r.doc_id: r for r in templates.drop_recurring(df).collect()}
    assert out[None].text == legal and out[53].text == "" and out[50].text is None and out[51].text == "" and out[52].text == "\n \n"
    assert out[0].text.count("\n") == 2 and all(out[i].text.count("\n") == 0 and len(out[i].text) == out[i].n_chars for i in range(1, 30))
    rep = {r.doc_id: (r.n_lines, r.n_dropped) for r in templates.line_report(df).collect()}
    assert rep[1] == (4, 3) and rep[0] == (4, 1) and rep[53] == (2, 2) and rep[50] == (0, 0) and rep[None] == (1, 0)
    assert templates.drop_recurring(empty).count() == 0


def test_templates_native(spark, docs):
    plan = templates.line_report(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 7


def test_images():
    a = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert (media.decode(media.encode_pgm(a)) == a).all()
    assert (media.decode(b"P2 # c\n2 1\n255\n7 9\n") == [[7, 9]]).all()
    assert (media.decode(b"P1\n3 1\n1 0 1\n") == [[0, 255, 0]]).all()
    assert (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    rgb = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert (media.decode(b"P6 2 2 255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P5 1 1 1000\n\x01\x02") == [[258]]).all()
    head = lambda bits, w, h, size: b"BM" + (54 + size).to_bytes(4, "little") + bytes(4) + (54 + (1024 if bits == 8 else 0)).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little", signed=True) + (1).to_bytes(2, "little") + bits.to_bytes(2, "little") + bytes(24)
    row = lambda r: r[:, ::-1].tobytes() + bytes(-r.size % 4)
    assert (media.decode(head(24, 2, 2, 16) + row(rgb[1]) + row(rgb[0])) == rgb).all()
    grey = b"".join(bytes([i, i, i, 0]) for i in range(256))
    assert (media.decode(head(8, 3, -1, 4) + grey + bytes([5, 6, 7, 0])) == [[5, 6, 7]]).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 7), st.integers(1, 7))
def test_area_resize(h, w, th, tw):
    a = np.random.default_rng(h * 9 + w).integers(0, 255, (h, w)).astype(float)
    big = np.kron(a, np.ones((th, tw)))  # every source cell th x tw times: target cells are whole blocks
    want = big.reshape(th, h, tw, w).mean((1, 3))
    assert np.allclose(media.area_resize(a, th, tw), want)


def plain_dhash(a):
    """Cell by cell: every sample counts with the share of it that lies in the cell."""
    h, w = a.shape
    share = lambda n, m: np.array([[max(0.0, min((j + 1) * n / m, i + 1) - max(j * n / m, i)) for i in range(n)] for j in range(m)])
    g = share(h, 8) @ a.astype(float) @ share(w, 9).T / (h * w / 72)
    bits = [bool(g[i, j + 1] > g[i, j] + 1e-9) for i in range(8) for j in range(8)]
    return np.packbits(bits).tobytes().hex()


def test_text_media(spark, docs, empty):
    want = []
    for d, x in TEXTS:
        raw = (x or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        out = io.BytesIO()
        np.save(out, np.frombuffer(p, np.uint8).reshape(-1, 64))
        npy = out.getvalue()
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(npy), hashlib.sha256(npy).hexdigest(), plain_dhash(np.frombuffer(p, np.uint8).reshape(-1, 64))))
    assert rows_of(media.text_media(spark, docs), 8) == sorted(want, key=key)
    assert media.text_media(spark, empty).count() == 0


def test_bad_media(spark):
    df = spark.createDataFrame([(1, bytearray(b"P5 2 2 255\n\x01")), (2, None), (3, bytearray(b"junk"))], "i int, image binary")
    assert [tuple(r)[2:] for r in media.media_columns(df, "image").collect()] == [(None,) * 5] * 3


# 8


def test_rollup(spark):
    s = "op string, doc_id long, source string, lang string, tokenizer_version string, tokens long"
    r = rollup.TokenRollup(spark)
    assert r.totals().count() == 0
    r.apply("a", spark.createDataFrame([("insert", 1, "x", "en", "v1", 10), ("insert", 2, "x", "en", "v1", 5), ("insert", 3, None, None, "v1", None), ("insert", None, "x", "en", "v1", 9), ("odd", 4, "x", "en", "v1", 9), ("insert", 1, "x", "en", "v1", 10)], s))
    assert rows_of(r.totals()) == sorted([("x", "en", "v1", 2, 15), (None, None, "v1", 1, 0)], key=key)
    b = spark.createDataFrame([("revise", 1, "y", "en", "v1", 7), ("delete", 2, None, None, "v1", 0), ("delete", 99, None, None, "v1", 0), ("insert", 1, "x", "en", "v2", 3)], s)
    assert r.apply("b", b) and not r.apply("b", b)
    want = sorted([("y", "en", "v1", 1, 7), ("x", "en", "v2", 1, 3), (None, None, "v1", 1, 0)], key=key)
    assert rows_of(r.totals()) == want
    assert rows_of(rollup.TokenRollup(spark, r.path).totals()) == want
    r.apply("c", spark.createDataFrame([("insert", 2, "x", "en", "v1", 4), ("delete", 1, None, None, "v1", 0)], s))
    assert rows_of(r.totals()) == sorted([("x", "en", "v1", 1, 4), ("x", "en", "v2", 1, 3), (None, None, "v1", 1, 0)], key=key)
    r.apply("d", spark.createDataFrame([], s))


def test_rollup_survives_dead_writers(spark, monkeypatch):
    cols = "op string, doc_id long, source string, lang string, tokenizer_version string, tokens long"
    r = rollup.TokenRollup(spark, buckets=2)
    r.apply("a", spark.createDataFrame([("insert", 1, "s", "en", "t", 5)], cols))
    gone = rollup.TokenRollup(spark, r.path, buckets=2)
    monkeypatch.setattr(gone, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("the writer is gone")))
    with pytest.raises(RuntimeError):
        gone.apply("b", spark.createDataFrame([("insert", 2, "s", "en", "t", 7)], cols))
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 1, 5)]
    r._fs.create(r._hpath(f"{r.path}/commits/{1:010d}"), False).close()  # the empty marker of an older writer
    late = rollup.TokenRollup(spark, r.path, buckets=2)
    assert late.apply("b", spark.createDataFrame([("insert", 2, "s", "en", "t", 7)], cols))
    assert not late.apply("b", spark.createDataFrame([("insert", 2, "s", "en", "t", 7)], cols))
    late.compact()
    assert [tuple(x) for x in rollup.TokenRollup(spark, r.path).totals().collect()] == [("s", "en", "t", 2, 12)]
    assert not r._commit(1, {"batch": "x", "folder": None, "folds": False})


def test_rollup_with_two_writers_and_folds(spark, monkeypatch):
    s = "op string, doc_id long, source string, lang string, tokenizer_version string, tokens long"
    one = rollup.TokenRollup(spark, buckets=4)
    two = rollup.TokenRollup(spark, one.path, buckets=4)
    one.apply("a", spark.createDataFrame([("insert", i, "x", "en", "v1", 10) for i in range(20)], s))
    write, turns = one._write, []

    def slow(new, log):
        folder = write(new, log)
        if not turns:
            turns.append(two.apply("c", spark.createDataFrame([("revise", 3, "x", "en", "v1", 1)], s)))
        return folder

    monkeypatch.setattr(one, "_write", slow)
    assert one.apply("b", spark.createDataFrame([("revise", 3, "y", "en", "v1", 7), ("delete", 4, None, None, "v1", 0)], s)) and turns == [True]
    want = sorted([("x", "en", "v1", 18, 180), ("y", "en", "v1", 1, 7)], key=key)
    assert one.batches() == ["a", "c", "b"] and rows_of(one.totals()) == want
    one.compact()
    assert rows_of(two.totals()) == want and two.ledger().count() == 19 and not two.apply("b", spark.createDataFrame([], s))
    two.apply("d", spark.createDataFrame([("delete", 3, None, None, "v1", 0), ("insert", 4, "y", "en", "v1", 2)], s))
    assert rows_of(one.totals()) == sorted([("x", "en", "v1", 18, 180), ("y", "en", "v1", 1, 2)], key=key)


def test_count_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n",), ("a",), (" a\tb\x0bc  d ",)], "t string")
    assert [x[0] for x in df.select(rollup.count_words(F.col("t"))).collect()] == [0, 0, 0, 1, 4]


# 9


def brute_removed(docs, length):
    c = Counter()
    for _, x in docs:
        b = (x or "").encode()
        c.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = []
    for d, x in docs:
        b = (x or "").encode()
        m = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if c[b[j : j + length]] > 1:
                m[j : j + length] = b"\1" * length
        out.append((d, len(b), sum(m), sum(1 for j in range(len(m)) if m[j] and (not j or not m[j - 1])), hashlib.sha256(bytes(v for v, z in zip(b, m, strict=True) if not z)).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("length,shallow,together", [(400, 100, 48), (50, 12, 48), (50, 12, 2)])
def test_substrings(spark, docs, empty, monkeypatch, length, shallow, together):
    monkeypatch.setattr(substrings, "SORTED_TOGETHER", together)
    small = docs.where("coalesce(length(text), 0) < 20000")
    short = [(d, x) for d, x in TEXTS if len(x or "") < 20_000]
    assert rows_of(substrings.substring_report(spark, small, length, shallow), 5) == brute_removed(short, length)
    assert substrings.substring_report(spark, empty, length, shallow).count() == 0
    out = substrings.without_repeats(spark, small, length, shallow)
    assert out.columns == docs.columns and out.count() == len(short)
    both = substrings.substring_report(spark, small, length, shallow, passage=length // 2)
    assert rows_of(both, 5) == brute_removed(short, length)
    assert rows_of(both.select("doc_id", "n_bytes", "n_passage_bytes")) == sorted((r[:3] for r in brute_removed(short, length // 2)), key=key)
    assert substrings.substring_report(spark, empty, length, shallow, passage=length // 2).count() == 0


def test_many_segments_of_one_anchor(spark):
    """Sixty different contexts of one passage: more than are sorted together."""
    passage = sentence(20)
    rows = [(i, f"{sentence(6)} {passage} {sentence(6)}") for i in range(60)]
    got = substrings.substring_report(spark, spark.createDataFrame(rows, "doc_id long, text string"), 80, 20)
    assert rows_of(got, 5) == brute_removed(rows, 80)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x & 1 for x in b)), min_size=1, max_size=12), st.booleans())
def test_deep_shallow_sort(strings, lead):
    strings = [b"\7" * 20 * lead + s for s in strings]
    order, lcps = substrings.deep_shallow_sort(strings)
    assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
    for a, b, c in zip(order[:-1], order[1:], lcps[1:], strict=True):
        assert c == substrings.common_prefix(strings[a], strings[b])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40))
def test_multikey_quicksort(keys):
    groups = substrings.multikey_quicksort(list(range(len(keys))), keys)
    assert [keys[i] for g in groups for i in g] == sorted(keys) and all(len({keys[i] for i in g}) == 1 for g in groups)


# 10


def test_pieces_equal_library(spark, docs, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    sp, e = sentencepiece.SentencePieceProcessor(model_file=path), pieces.piece_encoder(path)
    texts = [*ODD, "   ", "日本語テキスト" * 300, "".join(RNG.choice("abcdeéü日本thering") for _ in range(3000)), "日本語テキスト 한국어", "😀 a😀b", "a▁b ▁", "</s><s><unk>", " " * 40 + "x", *(x or "" for _, x in TEXTS)]
    ids, at = e(*common.text_arrays(pa.array(texts)))
    want = sp.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    assert [e.decode(w) for w in want] == [sp.decode(w) for w in want]
    got = pieces.round_trip(spark, docs, path).collect()
    assert all(r.same for r in got) and len(got) == len(TEXTS) and pieces.round_trip(spark, empty, path).count() == 0
    back = pieces.decode_pieces(pieces.encode_pieces(docs, path), path)
    assert rows_of(back) == sorted(((d, x or "") for d, x in TEXTS), key=key)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_pieces_any_text(text):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    sp, e = sentencepiece.SentencePieceProcessor(model_file=path), pieces.piece_encoder(path)
    ids, _ = e(*common.text_arrays(pa.array([text])))
    assert ids.tolist() == sp.encode(text.replace("\0", "\0"))
