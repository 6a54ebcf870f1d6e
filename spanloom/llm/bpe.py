"""Byte-level BPE encoding and decoding on padded matrices.

A text is cut by the tokenizer's pattern; the distinct pieces of a batch are
put into buckets by length, each bucket a matrix of symbol ids padded with -1.
In every round each row looks all its adjacent pairs up in a hashed pair table,
merges the leftmost pair of minimum rank, and closes the gap; rows without a
mergeable pair leave. Pieces above ``LONG_PIECE`` bytes, for which that would
be quadratic, take the same merges from a heap over a linked list.

Defined cases: null and empty texts give no ids and the bytes of the empty
text. Bytes that aren't UTF-8 pass through the round trip unchanged. Rows are
independent, so ties, repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts

LONG_PIECE = 1024
#: Pieces remembered in a worker at most, and the longest that is; beyond, the memory starts anew.
CACHE_PIECES, CACHE_BYTES = 300_000, 64
_EMPTY_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Open addressing from (left id, right id) to the merged id, which is also its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (2 * len(keys)).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, _EMPTY_KEY, np.uint64), np.full(1 << self.bits, _NONE, np.int32)
        todo, vals = np.array(keys, np.uint64), np.array(values, np.int32)
        at = self._slot(todo)
        while len(todo):
            free = self.keys[at] == _EMPTY_KEY
            self.keys[at[free]], self.values[at[free]] = todo[free], vals[free]
            # of several that took one slot the last stays; the others go on
            rest = self.keys[at] != todo
            todo, vals, at = todo[rest], vals[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, or the largest int32 where a pair doesn't merge (padding included)."""
        keys = left.astype(np.int64).view(np.uint64) << np.uint64(32) | right.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)
        found = np.full(keys.shape, _NONE, np.int32).ravel()
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = keys.ravel()[todo]
        at = self._slot(keys)
        while len(todo):
            there = self.keys[at]
            hit = there == keys
            found[todo[hit]] = self.values[at[hit]]
            on = ~hit & (there != _EMPTY_KEY)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return found.reshape(left.shape)


class Tokenizer:
    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(self.ranks)
        self.token_bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = token
        self.cache: dict[str, bytes] = {}

    def encode_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; all pieces at once, by length."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        width = 2
        while len(pieces) and width < 2 * max(2, int(lengths.max())):
            rows = np.flatnonzero((lengths <= width) & (lengths > (width // 2 if width > 2 else -1)))
            for low in range(0, len(rows), step := max(1, 2_000_000 // width)):
                self._merge_bucket(rows[low : low + step], pieces, width, out)
            width *= 2
        return out

    def _merge_bucket(self, rows: np.ndarray, pieces: list[bytes], width: int, out: list) -> None:
        raw = np.frombuffer(b"".join(pieces[r].ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
        lengths = np.array([len(pieces[r]) for r in rows], np.int64)
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], self.single[raw], np.int32(-1))
        while len(rows):
            merged = self.pairs(ids[:, :-1], ids[:, 1:])
            best = merged.argmin(axis=1)  # the first of equal ones
            value = merged[np.arange(len(rows)), best]
            done = value == _NONE
            for k in np.flatnonzero(done):
                out[rows[k]] = ids[k, : lengths[k]].copy()
            go = ~done
            rows, ids, lengths, best, value = rows[go], ids[go], lengths[go] - 1, best[go], value[go]
            if not len(rows):
                break
            kept = columns[:-1] + (columns[:-1] > best[:, None])
            ids = np.concatenate([np.take_along_axis(ids, kept, 1), np.full((len(rows), 1), -1, np.int32)], axis=1)
            ids[np.arange(len(rows)), best] = value
            if (most := int(lengths.max())) < ids.shape[1]:
                ids, columns = ids[:, : max(2, most)], columns[: max(2, most)]

    def encode_long(self, piece: bytes) -> np.ndarray:
        """The same merges in the same order, from a heap of (rank, place)."""
        ids = [int(self.single[b]) for b in piece]
        after, before, alive = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], [True] * len(ids)

        def rank(a: int) -> int | None:
            b = after[a]
            return None if b < 0 else self.ranks.get(self.token_bytes[ids[a]] + self.token_bytes[ids[b]])

        heap = [(r, a) for a in range(len(ids) - 1) if (r := rank(a)) is not None]
        heapq.heapify(heap)
        while heap:
            r, a = heapq.heappop(heap)
            if not alive[a] or rank(a) != r:
                continue
            gone = after[a]
            ids[a], alive[gone], after[a] = r, False, after[gone]
            if after[a] >= 0:
                before[after[a]] = a
            for x in (a, before[a]):
                if x >= 0 and (found := rank(x)) is not None:
                    heapq.heappush(heap, (found, x))
        return np.array([i for i, x in zip(ids, alive) if x], np.int32)

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of new pieces as little-endian unsigned 32-bit integers."""
        words = list(pieces)
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        short = [k for k, r in enumerate(raw) if len(r) <= LONG_PIECE]
        found = {words[k]: i.astype("<u4").tobytes() for k, i in zip(short, self.encode_matrix([raw[k] for k in short]))}
        found.update({words[k]: self.encode_long(r).astype("<u4").tobytes() for k, r in enumerate(raw) if len(r) > LONG_PIECE})
        return found

    def encode_batch(self, texts: list[bytes | None]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[bytes] = []
        for low in range(0, len(texts), 512):
            split = [self.pattern.findall((t or b"").decode("utf-8", "surrogateescape")) for t in texts[low : low + 512]]
            fresh = set().union(*split).difference(self.cache)
            if len(self.cache) + len(fresh) > CACHE_PIECES:
                self.cache = {}
                fresh = set().union(*split)
            table = self.learn(fresh)
            keep = {k: v for k, v in table.items() if len(k) <= CACHE_BYTES}
            self.cache.update(keep)
            look = self.cache if len(keep) == len(table) else self.cache | table
            out += [b"".join([look[p] for p in pieces]) for pieces in split]
        return out

    def decode(self, packed: bytes) -> bytes:
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()])


_LOADED: dict[tuple[str, str], Tokenizer] = {}


def load(rank_file: str, pattern: str) -> Tokenizer:
    """One tokenizer a worker process."""
    if (rank_file, pattern) not in _LOADED:
        _LOADED[rank_file, pattern] = Tokenizer(rank_file, pattern)
    return _LOADED[rank_file, pattern]


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids (binary, little-endian unsigned 32-bit). A narrow map."""

    def setup():
        tokenizer = load(rank_file, pattern)

        def work(texts):
            packed = tokenizer.encode_batch(texts)
            return [[len(p) // 4 for p in packed], packed]

        return work

    return map_texts(docs, id_col, text_col, "n_tokens long, ids binary", setup)


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, decoded (binary: the bytes of the text)."""

    def setup():
        tokenizer = load(rank_file, pattern)
        return lambda packed: [[tokenizer.decode(p or b"") for p in packed]]

    return map_texts(encoded, id_col, ids_col, "decoded binary", setup)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and of decoding the ids again, in one pass so that the ids never leave the worker."""

    def setup():
        tokenizer = load(rank_file, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def work(texts):
            packed = tokenizer.encode_batch(texts)
            return [[len(p) // 4 for p in packed], [sha(p) for p in packed], [sha(tokenizer.decode(p)) for p in packed]]

        return work

    return map_texts(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", setup)


def default_files() -> tuple[str, str]:
    """Rank file and pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op7(spark, sf_dir) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_files())
