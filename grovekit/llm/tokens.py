"""Tokenizing whole texts with a word memo: each distinct word goes through the tokenizers library once per memo.

White space ends a pre-token in both tokenizers here, and so does a comma or full stop after a letter at a word's end;
so ids of a text are its words' ids in a row. Texts where white space is anything but single spaces and line ends
between words are encoded whole. Words are looked up by 64-bit hashes in a numpy table of bounded size.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import KEPT, SPACE, U64, mix, prefix_hash, slices, span_hash, words_of

#: Words after which a worker's memo starts afresh: at most 2**22 slots of 12 bytes, and the ids.
MEMO, SLOTS = 2_500_000, 1 << 22
#: Words of plain letters are one pre-token, and NFC keeps them.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _odd_bytes(data: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII's [\\t-\\r ] begins."""
    out = (data >= 0x1C) & (data <= 0x1F)
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(at):
        a, b, c = (np.append(data, [0, 0, 0])[at + i] for i in range(3))
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        dots = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        out[at[two | dots | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]] = True
    return out


class Encoder:
    """Ids of whole texts, equal to the library's. ``keep_space``: words keep the space before them (byte-level BPE)."""

    def __init__(self, path: str, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lead = " " if keep_space else ""
        self.model, self.lower = self.lib.model, not keep_space
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.glyph = {**{b: chr(b) for b in visible}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}  # the byte-level alphabet
        self.space = self.glyph[32] if keep_space else ""
        self._fresh()

    def _fresh(self) -> None:
        self.keys, self.vals = np.zeros(SLOTS, U64), np.full(SLOTS, -1, np.int32)
        self.ids, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.used = self.n = 0
        self._add([self.lib.encode(c, add_special_tokens=False).ids for c in "\n,."])

    def _add(self, encoded: list[list[int]]) -> int:
        """Appends id lists; the number of the first."""
        first, lens = self.n, np.fromiter(map(len, encoded), np.int64, len(encoded))
        total = int(lens.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(encoded) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.used : self.used + total] = np.array([i for e in encoded for i in e], np.uint32)
        self.at[self.n + 1 : self.n + 1 + len(encoded)] = self.used + np.cumsum(lens)
        self.used += total
        self.n += len(encoded)
        return first

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), 4096) for e in self.lib.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]

    def _words(self, words: list[str], spaced: list[bool]) -> list[list[int]]:
        """Ids of words: plain letters by the library's model alone, others by its whole pipeline."""
        out: list = [None] * len(words)
        space, tokenize, lower, rest = self.space, self.model.tokenize, self.lower, []
        for i, (w, s) in enumerate(zip(words, spaced, strict=True)):
            if _PLAIN(w):
                w = w.lower() if lower else w
                w = w if w.isascii() else w.encode().decode("latin-1").translate(self.glyph)
                out[i] = [t.id for t in tokenize(space + w if s else w)]
            else:
                rest.append(i)
        for i, ids in zip(rest, self._library([self.lead + words[i] if spaced[i] else words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash's word, or -1."""
        out = np.full(len(h), -1, np.int32)
        left, slot = np.arange(len(h)), (h & U64(SLOTS - 1)).astype(np.int64)
        while len(left):
            v = self.vals[slot]
            hit = (v >= 0) & (self.keys[slot] == h[left])
            out[left[hit]] = v[hit]
            go = (v >= 0) & ~hit
            left, slot = left[go], (slot[go] + 1) & (SLOTS - 1)
        return out

    def _insert(self, h: np.ndarray, first: int) -> None:
        """Distinct new hashes get the numbers from ``first`` on."""
        left, slot, val = h, (h & U64(SLOTS - 1)).astype(np.int64), np.arange(first, first + len(h), dtype=np.int32)
        while len(left):
            free = self.vals[slot] < 0
            self.vals[slot[free]] = val[free]
            mine = free & (self.vals[slot] == val)  # of several for one slot the last stays
            self.keys[slot[mine]] = left[mine]
            left, slot, val = left[~mine], (slot[~mine] + 1) & (SLOTS - 1), val[~mine]

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each row's begin (one more at the end)."""
        if self.n > MEMO:
            self._fresh()
        n = len(offs) - 1
        a, b = words_of(data, offs)
        row = np.searchsorted(offs, a, "right") - 1
        head = a == offs[row]
        before = np.where(head, 0, data[a - 1]) if len(a) else np.zeros(0, np.uint8)
        cum = np.concatenate([[0], np.cumsum(SPACE[data])])
        odd_at = np.concatenate([[0], np.cumsum(_odd_bytes(data))])
        words = np.bincount(row, minlength=n)
        whole = (cum[offs[1:]] - cum[offs[:-1]] != np.maximum(words - 1, 0)) | (odd_at[offs[1:]] > odd_at[offs[:-1]])
        whole |= np.bincount(row[~head & (before != 32) & (before != 10)], minlength=n) > 0
        keep = ~whole[row]
        a, b, row, before = a[keep], b[keep], row[keep], before[keep]
        last, prev, lead = data[b - 1], data[np.maximum(b - 2, 0)], data[np.maximum(b - 3, 0)]
        latin = (lead == 0xC3) & (prev >= 0x80) & (prev != 0x97) & (prev != 0xB7) & (b - a >= 3)
        mark = ((last == 44) | (last == 46)) & (b - a >= 2) & (_LETTER[prev] | latin)
        b = b - mark
        spaced = before == 32
        h = mix(span_hash(prefix_hash(data), a, b) + spaced.astype(U64))
        index = self._find(h)
        if len(miss := np.flatnonzero(index < 0)):
            new, where, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[where]
            raw = data.tobytes()
            texts = [raw[i:j].decode() for i, j in zip(a[at].tolist(), b[at].tolist(), strict=True)]
            first = self._add(self._words(texts, spaced[at].tolist()))
            self._insert(new, first)
            index[miss] = first + inverse
        line = before == 10
        each = 1 + line + mark
        ends = np.cumsum(each)
        units = int(ends[-1]) if len(ends) else 0
        unit, urow = np.zeros(units, np.int64), np.repeat(row, each)
        unit[ends - 1 - mark] = index
        unit[(ends - each)[line]] = 0
        unit[(ends - 1)[mark]] = np.where(last[mark] == 44, 1, 2)
        if whole.any():
            rows = np.flatnonzero(whole)
            first = self._add(self._library([data[offs[i] : offs[i + 1]].tobytes().decode() for i in rows.tolist()]))
            unit, urow = np.concatenate([unit, first + np.arange(len(rows))]), np.concatenate([urow, rows])
            order = np.argsort(urow, kind="stable")
            unit, urow = unit[order], urow[order]
        start, lens = self.at[unit], self.at[unit + 1] - self.at[unit]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(start - (ends - lens), lens) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(urow, np.arange(n + 1), "left")]


def encoder(path: str, keep_space: bool) -> Encoder:
    if (path, keep_space) not in KEPT:
        KEPT[path, keep_space] = Encoder(path, keep_space)
    return KEPT[path, keep_space]


def vocabulary_size(path: str) -> int:
    """One more than the largest id, added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def token_slices(batches: Iterator[pa.RecordBatch], path: str, keep_space: bool, end_id: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, offsets) with ``end_id`` after each text's ids; null text counts as empty."""
    enc = encoder(path, keep_space)
    for rows, data, text_offs in slices(batches, kept=(path, keep_space)):
        ids, offs = enc(data, text_offs)
        n = rows.num_rows
        out = np.full(len(ids) + n, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offs))] = ids
        yield rows, out, offs + np.arange(n + 1)
