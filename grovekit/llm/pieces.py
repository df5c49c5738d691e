"""Operator 10, SentencePiece encoding and decoding by suffix-array matching.

Within a slice of texts the distinct space-led chunks not seen before are concatenated. A suffix array of that text,
sorted to the longest piece's length, gives every piece's occurrences as one range, found by binary search. The
ranges' edges are sorted by position and relaxed in that order. In a BPE model the prefix that ends at a position has
just one last piece: an edge from position s is valid if its piece may follow the last piece at s, that is, if no
merge across their border comes before the merges that make the two. So relaxing keeps one piece a position, and the
path back from a chunk's end is the library's encoding. No piece has a space after another character, so chunks are
independent.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import U64, edges_of, importable, mix, pack, prefix_hash, slices, span_hash, text_arrays, two
from .tokens import SLOTS, Encoder

_MODELS: dict[str, PieceEncoder] = {}
_CACHE = 1 << 20
#: Chunks of more bytes are relaxed one by one; shorter ones all at once, position by position.
LONG = 256


class PieceEncoder(Encoder):
    """Ids of whole texts, equal to the library's for BPE models with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.unknown = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[self.bytes_of[i][0]] = i
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: names[i].replace("▁", " ") for i in normal}
        number = {t: i for i, t in text.items()}
        merges = sorted((i for i in normal if len(text[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        self.rank = np.zeros(n + 1, np.int64)
        self.rank[merges] = np.arange(1, len(merges) + 1)
        rank = self.rank.tolist()
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        pairs, whole = {}, {i for i in normal if len(text[i]) == 1}
        for i in merges:
            t = text[i]
            for k in range(1, len(t)):
                if (a := number.get(t[:k])) is not None and (b := number.get(t[k:])) is not None:
                    pairs[a * (n + 1) + b] = i
            parts = [number.get(c, n) for c in t]
            while len(parts) > 2:
                best = min(((rank[m], k) for k in range(len(parts) - 1) if (m := pairs.get(parts[k] * (n + 1) + parts[k + 1])) is not None and m != i), default=None)
                if best is None:
                    break
                k = best[1]
                parts[k : k + 2] = [pairs[parts[k] * (n + 1) + parts[k + 1]]]
            if len(parts) == 2 and pairs.get(parts[0] * (n + 1) + parts[1]) == i:
                self.left[i], self.right[i] = parts
                whole.add(i)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_key, self.pair_rank = keys, self.rank[[pairs[k] for k in keys.tolist()]]
        usable = sorted(whole)
        self.piece = np.array(usable, np.int64)
        self.size = np.array([len(self.bytes_of[i]) for i in usable], np.int64)
        self.width = -(-int(self.size.max()) // 8)
        self.single = {text[i].encode() for i in whole if len(text[i]) == 1}
        padded = b"".join(self.bytes_of[i].ljust(8 * self.width, b"\0") for i in usable)
        self.piece_keys = np.frombuffer(padded, ">u8").astype(U64).reshape(-1, self.width)
        self.seen_key, self.seen_ok = np.full(_CACHE, -1, np.int64), np.zeros(_CACHE, bool)
        self.merge = dict(zip(keys.tolist(), self.pair_rank.tolist(), strict=True))
        self.parts = list(zip(self.rank.tolist(), self.left.tolist(), self.right.tolist(), strict=True))
        self.met: dict[int, bool] = {}
        self._fresh()

    def _fresh(self) -> None:
        self.keys, self.vals = np.zeros(SLOTS, U64), np.full(SLOTS, -1, np.int32)
        self.ids, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.used = self.n = 0

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Is (a, b) what the merges leave of the two pieces' characters? Undoes the later merge of the two, again and again."""
        key = a * (self.unknown + 1) + b
        slot = (mix(key.astype(U64)) & U64(_CACHE - 1)).astype(np.int64)
        out = self.seen_ok[slot]
        todo = np.flatnonzero(self.seen_key[slot] != key)
        if not len(todo):
            return out
        new, where = np.unique(key[todo], return_inverse=True)
        x, y = new // (self.unknown + 1), new % (self.unknown + 1)
        limit, ok, left = np.full(len(new), 1 << 40), np.ones(len(new), bool), np.arange(len(new))
        while len(left):
            k = x * (self.unknown + 1) + y
            at = np.minimum(np.searchsorted(self.pair_key, k), len(self.pair_key) - 1)
            bad = (self.pair_key[at] == k) & (self.pair_rank[at] < limit)
            ok[left[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            first = rx > ry
            cut_x = np.where(first, True, (ry == 0) & (rx > 0))
            over = (rx == 0) & (ry == 0)
            limit = np.where(cut_x, rx, ry + 1)
            x, y = np.where(cut_x, self.right[x], x), np.where(cut_x, y, self.left[y])
            go = ~bad & ~over
            x, y, limit, left = x[go], y[go], limit[go], left[go]
        out[todo] = ok[where]
        self.seen_key[slot[todo]], self.seen_ok[slot[todo]] = key[todo], out[todo]
        return out

    def _may_follow_one(self, x: int, y: int) -> bool:
        """``may_follow`` of one pair."""
        key, limit, wide = x * (self.unknown + 1) + y, 1 << 40, self.unknown + 1
        if (known := self.met.get(key)) is not None:
            return known
        ok = True
        while True:
            if self.merge.get(x * wide + y, limit) < limit:
                ok = False
                break
            (rx, _, right), (ry, left, _) = self.parts[x], self.parts[y]
            if not rx and not ry:
                break
            if rx > ry:
                x, limit = right, rx
            else:
                y, limit = left, ry + 1
        if len(self.met) >= _CACHE:
            self.met.clear()
        self.met[key] = ok
        return ok

    def _relax_long(self, pos: np.ndarray, piece: np.ndarray, length: np.ndarray, begins: set[int], last: np.ndarray, back: np.ndarray) -> None:
        """Relaxes the edges of long chunks in the order of their positions; ``begins``: where chunks start."""
        order = np.argsort(pos, kind="stable")
        best: dict[int, tuple[int, int]] = {}
        for p, q, w in zip(pos[order].tolist(), piece[order].tolist(), length[order].tolist(), strict=True):
            if p in begins or (p in best and self._may_follow_one(best[p][0], q)):
                best[p + w] = (q, w)
        at = np.fromiter(best, np.int64, len(best))
        last[at], back[at] = np.array([v[0] for v in best.values()], np.int64), np.array([v[1] for v in best.values()], np.int64)

    def edges(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, piece ids and byte lengths of every occurrence of every piece in the text t."""
        n = len(t)
        padded = np.concatenate([t, np.zeros(8 * self.width + 8, np.uint8)]).astype(U64)
        k0 = np.zeros(n + 8 * self.width, U64)
        for j in range(8):
            k0 |= padded[j : j + len(k0)] << U64(56 - 8 * j)
        sa = np.argsort(k0[:n], kind="stable")
        first = k0[sa]
        same = np.zeros(n, bool)
        same[1:] = first[1:] == first[:-1]
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        group = np.cumsum(~same)[at]
        part = sa[at]
        sa[at] = part[np.lexsort([*(k0[part + 8 * w] for w in range(self.width - 1, 0, -1)), group])]
        tail = np.where(self.size >= 8, U64(0), U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * np.minimum(self.size, 7).astype(U64)))
        lo = np.searchsorted(first, self.piece_keys[:, 0], "left")
        hi = np.searchsorted(first, self.piece_keys[:, 0] | tail, "right")
        for p in np.flatnonzero((self.size > 8) & (hi > lo)).tolist():
            a, b = int(lo[p]), int(hi[p])
            for w in range(1, -(-int(self.size[p]) // 8)):
                k = k0[sa[a:b] + 8 * w]
                more = max(0, 8 * (w + 1) - int(self.size[p]))
                key = self.piece_keys[p, w]
                a, b = a + int(np.searchsorted(k, key, "left")), a + int(np.searchsorted(k, key | U64((1 << 8 * more) - 1), "right"))
            lo[p], hi[p] = a, b
        count = np.maximum(hi - lo, 0)
        ends = np.cumsum(count)
        pos = sa[np.repeat(lo - (ends - count), count) + np.arange(int(ends[-1]))]
        return pos, np.repeat(self.piece, count), np.repeat(self.size, count)

    def _words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of chunks by matching and relaxing."""
        t = np.frombuffer(b"\xff".join(words) + b"\xff", np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        pos, piece, length = self.edges(t)
        begins = np.flatnonzero(((t & 0xC0) != 0x80) & (t != 255))
        known = np.zeros(len(t), bool)
        one = np.where(t[begins] < 0x80, 1, np.where(t[begins] < 0xE0, 2, np.where(t[begins] < 0xF0, 3, 4)))
        chars = np.zeros(len(t), np.int64)
        chars[begins] = one
        known[pos[length == chars[pos]]] = True
        lost = begins[~known[begins]]
        pos, piece, length = np.concatenate([pos, lost]), np.concatenate([piece, np.full(len(lost), self.unknown)]), np.concatenate([length, chars[lost]])
        chunk = np.searchsorted(start, pos, "right") - 1
        rel, long_ = pos - start[chunk], size[chunk] > LONG
        last, back = np.full(len(t) + 1, -2, np.int64), np.zeros(len(t) + 1, np.int64)
        if long_.any():
            self._relax_long(pos[long_], piece[long_], length[long_], set(start[size > LONG].tolist()), last, back)
            pos, piece, length, rel = pos[~long_], piece[~long_], length[~long_], rel[~long_]
        order = np.lexsort((pos, rel))
        pos, piece, length, rel = pos[order], piece[order], length[order], rel[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(rel)) + 1, [len(rel)]]).tolist() if len(rel) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p, q, w = pos[a:b], piece[a:b], length[a:b]
            if rel[a] == 0:
                ok = np.ones(b - a, bool)
            else:
                ok = last[p] >= 0
                ok[ok] = self.may_follow(last[p[ok]], q[ok])
            to = p[ok] + w[ok]
            last[to], back[to] = q[ok], w[ok]
        at, here, steps = start + size, np.arange(len(words)), []
        while len(here):
            steps.append((here, last[at], at, back[at]))
            at = at - back[at]
            go = at > start[here]
            at, here = at[go], here[go]
        who = np.concatenate([s[0] for s in steps])
        got, end, width = (np.concatenate([s[i] for s in steps]) for i in (1, 2, 3))
        order = np.lexsort((end, who))
        who, got, end, width = who[order], got[order], end[order], width[order]
        each = np.where(got == self.unknown, width, 1)
        to = np.cumsum(each)
        flat = np.repeat(got, each)
        raw = np.flatnonzero(flat == self.unknown)
        flat[raw] = self.byte_id[t[np.repeat(end - width, each)[raw] + (np.arange(len(flat)) - np.repeat(to - each, each))[raw]]]
        bounds = np.concatenate([[0], to])[np.searchsorted(who, np.arange(len(words) + 1), "left")].tolist()
        flat = flat.tolist()
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from .tokens import MEMO

        if self.n > MEMO:
            self._fresh()
        if b"\xe2\x96\x81" in data.tobytes():
            data, offs = text_arrays(pa.array([data[i:j].tobytes().decode().replace("▁", " ") for i, j in zip(offs[:-1], offs[1:], strict=True)]))
        n = len(offs) - 1
        a, b = edges_of(data != 32, offs)
        row = np.searchsorted(offs, a, "right") - 1
        ends = np.full(n, -1, np.int64)
        ends[row] = b
        tail = np.flatnonzero((ends < offs[1:]) & (offs[1:] > offs[:-1]))  # spaces at the end, or nothing else
        a, b, row = np.concatenate([a, offs[tail + 1]]), np.concatenate([b, offs[tail + 1]]), np.concatenate([row, tail])
        order = np.lexsort((a, row))
        a, b, row = a[order], b[order], row[order]
        head = np.ones(len(a), bool)
        head[1:] = row[1:] != row[:-1]
        prev = np.concatenate([[0], b[:-1]])
        spaces = np.where(head, a - offs[row] + 1, a - prev)
        h = mix(span_hash(prefix_hash(data), a, b) + spaces.astype(U64))
        index = self._find(h)
        if len(miss := np.flatnonzero(index < 0)):
            new, where, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[where]
            raw = data.tobytes()
            first = self._add(self._words([b" " * k + raw[i:j] for k, i, j in zip(spaces[at].tolist(), a[at].tolist(), b[at].tolist(), strict=True)]))
            self._insert(new, first)
            index[miss] = first + inverse
        start, lens = self.at[index], self.at[index + 1] - self.at[index]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(start - (ends - lens), lens) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(row, np.arange(n + 1), "left")]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces and bytes joined, the space that encoding puts in front taken off, broken UTF-8 replaced."""
        return b"".join([self.bytes_of[i] for i in ids]).removeprefix(b" ").decode(errors="replace")


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _MODELS:
        _MODELS[path] = PieceEncoder(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of each text; null and empty texts have none; rows stay as they are."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(path)
        for rows, data, offs in slices(batches):
            ids, at = enc(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return two(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each ids array; null ids give a null text."""
    importable(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else enc.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Encodes every whole text and decodes the ids: doc_id, n_pieces, ids_crc32, decoded_sha256, same (decoded equals the text).

    Null counts as empty; an empty table gives no rows; repeated rows repeat their values.
    """
    importable(spark)
    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, same boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(path)
        for rows, data, offs in slices(batches):
            ids, at = enc(data, offs)
            raw, out = pack(ids.astype("<u4")), []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                text = enc.decode(ids[a:b].tolist()).encode()
                out.append((b - a, zlib.crc32(raw[4 * a : 4 * b]), hashlib.sha256(text).hexdigest(), text == data[offs[i] : offs[i + 1]].tobytes()))
            n, crc, sha, same = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "same"])

    return two(docs).mapInArrow(run, schema)
