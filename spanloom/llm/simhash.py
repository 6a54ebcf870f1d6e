"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64 majority bits over the XXH64 values of two-word shingles.
Equal fingerprints are folded into one row first. The distinct ones are cut
into bands; fingerprints within the radius agree in some choice of bands
(pigeonhole), so each choice is a table of buckets. A bucket is compared in bit
slices: its fingerprints are stored as vertical bit planes, 64 to a machine
word, and the distances of one fingerprint to all of them are counted by
carry-save adders seven planes at a time; a row of the comparison is abandoned
once all its lanes exceed the radius. A pair counts in the first table where it
meets only, so link counts are exact. Each bucket returns a degree and the root
of a local spanning forest per fingerprint, never its pairs; roots are joined
into components afterwards.

The number of bands follows the number of fingerprints, so that buckets stay
small; every choice finds all pairs. Buckets beyond ``TILE`` rows are split into
tiles, and each pair of tiles is a group of its own.

Defined cases: a null or empty text has fingerprint zero and links like any other;
rows with a null id have a fingerprint but no links (null count and component).
Repeated ids count as separate documents with one component id. Only the id and
text columns are read, so further columns may have any names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts
from .components import connected_components

SEED, RADIUS = 42, 6
#: Rows of a bucket that one task compares at most with as many others; fingerprints a bucket should hold.
TILE, WANTED = 8192, 1024

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, counted in eight byte lanes of a word at a time."""
    n = len(hashes)
    if not n:
        return 0
    cuts = np.arange(0, n, 255)
    value = 0
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n).tolist():
            value |= 1 << (8 * byte + k)
    return value


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").translate(_LOWER).split()
    if len(words) > 1:
        words = map(b" ".join, zip(words, words[1:]))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(w, SEED) for w in words], np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fp (the 64 bits as a signed long). A narrow map over whole texts."""

    def setup():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, id_col, text_col, "fp long", setup)


def scheme(n: int, radius: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Bands as (lowest bit, width) and the choices of bands that make a table's key.

    Of radius + c bands c agree for each linked pair. c grows until a bucket of random
    fingerprints holds WANTED rows or fewer, or keys reach half of the bits.
    """
    for c in range(1, 5):
        m = radius + c
        edges = [64 * k // m for k in range(m + 1)]
        bands = [(a, b - a) for a, b in zip(edges, edges[1:])]
        if n / 2.0 ** (c * 64 / m) <= WANTED:
            break
    return bands, list(itertools.combinations(range(m), c))


def _key(fp: Column, bands: list[tuple[int, int]], choice: tuple[int, ...]) -> Column:
    key = F.lit(0).cast("long")
    for band in choice:
        low, width = bands[band]
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)))
    return key


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 x words: bit j of every value, 64 values to a word."""
    n = len(values)
    bits = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _full(a, b, c):
    ab = a ^ b
    return ab ^ c, (a & b) | (ab & c)


def near(left: np.ndarray, planes: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) at a distance of radius or less; radius below 7.

    Three bit slices hold each lane's distance so far and a fourth, sticky, that it passed seven.
    """
    words = planes.shape[1]
    rows = np.arange(len(left))
    flips = np.where(np.unpackbits(left.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    c0 = np.zeros((len(left), words), np.uint64)
    c1, c2, over = c0.copy(), c0.copy(), c0.copy()
    limit = np.full(words, np.uint64(0xFFFFFFFFFFFFFFFF))
    if n % 64:
        limit[-1] = np.uint64((1 << (n % 64)) - 1)
    over |= ~limit
    for low in range(0, 64, 7):
        d = [planes[j] ^ flips[:, j, None] for j in range(low, min(64, low + 7))]
        if len(d) == 7:
            s1, k1 = _full(d[0], d[1], d[2])
            s2, k2 = _full(d[3], d[4], d[5])
            s, k3 = _full(s1, s2, d[6])
            t, u = _full(k1, k2, k3)
            c0, k = c0 ^ s, c0 & s
            c1, k = _full(c1, t, k)
            c2, k = _full(c2, u, k)
            over |= k
        else:
            for x in d:
                c0, k = c0 ^ x, c0 & x
                c1, k = c1 ^ k, c1 & k
                c2, k = c2 ^ k, c2 & k
                over |= k
        far = over.copy()
        if radius == 6:
            far |= c0 & c1 & c2
        alive = (far != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
        if not alive.all():
            rows, flips, c0, c1, c2, over = rows[alive], flips[alive], c0[alive], c1[alive], c2[alive], over[alive]
            if not len(rows):
                return rows, rows
    if radius < 6:  # keep lanes whose count, c2 c1 c0, is at most the radius
        bigger, equal = np.zeros_like(c0), np.full_like(c0, np.uint64(0xFFFFFFFFFFFFFFFF))
        for bit, c in ((2, c2), (1, c1), (0, c0)):
            if radius >> bit & 1:
                equal &= c
            else:
                bigger |= equal & c
                equal &= ~c
        over |= bigger
    else:
        over |= c0 & c1 & c2
    at, lane = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
    return rows[at], lane


class _Group:
    """One bucket, or one pair of tiles of a bucket: degrees and local forest."""

    def __init__(self, fps: np.ndarray, counts: np.ndarray, tiles: np.ndarray, bands, choice, radius: int):
        self.fps, self.counts, self.tiles = fps, counts, tiles
        self.bands, self.choice, self.radius = bands, choice, radius
        self.degree, self.root = np.zeros(len(fps), np.int64), np.arange(len(fps))

    def first_here(self, x: np.ndarray) -> np.ndarray:
        """Whether the first agreeing bands of pairs with differing bits x are this table's."""
        seen, c = np.zeros(len(x), np.int64), len(self.choice)
        ok = np.ones(len(x), bool)
        for band, (low, width) in enumerate(self.bands):
            same = ((x >> np.uint64(low)) & np.uint64((1 << width) - 1)) == 0
            if band in self.choice:
                ok &= same
            else:
                ok &= ~same | (seen >= c)
            seen += same
        return ok

    def run(self) -> None:
        split = np.unique(self.tiles)
        if len(split) == 1:
            self._compare(np.arange(len(self.fps)), None)
        else:
            self._compare(np.flatnonzero(self.tiles == split[0]), np.flatnonzero(self.tiles == split[1]))

    def _compare(self, left: np.ndarray, right: np.ndarray | None) -> None:
        own = right is None
        right = left if own else right
        planes = planes_of(self.fps[right])
        step = max(16, 200_000 // max(1, planes.shape[1]) // 8)
        for low in range(0, len(left), step):
            i, j = near(self.fps[left[low : low + step]], planes, len(right), self.radius)
            i, j = left[i + low], right[j]
            if own:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            here = self.first_here(self.fps[i] ^ self.fps[j])
            i, j = i[here], j[here]
            np.add.at(self.degree, i, self.counts[j])
            np.add.at(self.degree, j, self.counts[i])
            bounds = np.flatnonzero(np.diff(i)) + 1
            for a, b in zip([0, *bounds], [*bounds, len(i)]):
                if a < b:
                    found = np.unique(np.append(self.root[j[a:b]], self.root[i[a]]))
                    if len(found) > 1:
                        self.root[np.isin(self.root, found[1:])] = found[0]


def _links(rows: DataFrame, bands, choices, radius: int) -> DataFrame:
    """rows sorted by group -> (node, degree, root) of those that have a link in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "degree", "root"]
        out: list[np.ndarray] = []

        def group(parts: list[np.ndarray]) -> None:
            rows = np.concatenate(parts)
            if len(rows) > 1:
                g = _Group(np.ascontiguousarray(rows[:, 4]).view(np.uint64), rows[:, 5], rows[:, 7], bands, choices[int(rows[0, 0])], radius)
                g.run()
                hit = np.flatnonzero(g.degree)
                if len(hit):
                    out.append(np.stack([rows[hit, 6], g.degree[hit], rows[g.root[hit], 6]], axis=1))

        def flush() -> pa.RecordBatch:
            both = np.concatenate(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in range(3)], names=names)

        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)], axis=1)
            bounds = np.flatnonzero((table[1:, :4] != table[:-1, :4]).any(axis=1)) + 1
            for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(table)]):
                part = table[a:b]
                if held and (held[0][0, :4] != part[0, :4]).any():
                    group(held)
                    held = []
                held.append(part)
            if sum(map(len, out)) > 50_000:
                yield flush()
        if held:
            group(held)
        if out:
            yield flush()

    return rows.mapInArrow(run, "node long, degree long, root long")


def link(fingerprinted: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", radius: int = RADIUS) -> DataFrame:
    """(fp, n, n_near, component_id) for each distinct fingerprint of rows with an id.

    n: rows that have it; n_near: other rows linked with each of them.
    """
    if not 0 <= radius <= 6:
        raise ValueError("the radius must be 0 to 6")
    known = fingerprinted.where(F.col(id_col).isNotNull())
    distinct = cut(known.groupBy(F.col(fp_col).alias("fp")).agg(F.count("*").alias("n"), F.min(F.col(id_col).cast("long")).alias("node")))
    bands, choices = scheme(distinct.count(), radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), _key(F.col("fp"), bands, c).alias("key")) for t, c in enumerate(choices)])
    spread = distinct.select(F.inline(tables), "fp", "n", "node")
    hot = spread.groupBy("t", "key").count().where(F.col("count") > TILE)
    hot = hot.select("t", "key", F.ceil(F.col("count") / TILE).cast("long").alias("tiles"))
    placed = spread.join(hot, ["t", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    sides = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda o: F.struct(F.least("tile", o).alias("i"), F.greatest("tile", o).alias("j")))
    groups = placed.select("t", "key", F.inline(sides), "fp", "n", "node", "tile")
    keys = ["t", "key", "i", "j"]
    rows = groups.repartition(*keys).sortWithinPartitions(*keys)
    rows = rows.select(*[F.col(c).cast("long") for c in (*keys, "fp", "n", "node", "tile")])
    links = cut(_links(rows, bands, choices, radius))
    degrees = links.groupBy("node").agg(F.sum("degree").alias("degree"))
    found = connected_components(links, "node", "root")
    return (
        distinct.join(degrees, "node", "left")
        .join(found, "node", "left")
        .select("fp", "n", (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("n_near"), F.coalesce("component", "node").alias("component_id"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), n_near, component_id."""
    prints = cut(fingerprints(docs, id_col, text_col))
    linked = link(prints, id_col, "fp", radius)
    known = F.col(id_col).isNotNull()
    return prints.join(linked, "fp", "left").select(
        id_col,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(known, F.col("n_near")).alias("n_near"),
        F.when(known, F.col("component_id")).alias("component_id"),
    )


def op8(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
