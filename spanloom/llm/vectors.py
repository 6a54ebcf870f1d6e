"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are turned by an orthogonal matrix (principal axes of a bounded sample;
any orthogonal matrix gives the same links) and split into blocks of low
dimension. Cosine c means squared distance 2 - 2c, so a linked pair is
within some block's budget, the share of 2 - 2c in proportion to the block's
dimensions. Each block is range-joined under its budget: where the block's leading axes
spread well beyond the budget, on a grid over them (a vector is at home in one cell
and visits those its ball reaches), otherwise within the label. Candidates are
verified by the exact cosine in double precision at once. A pair counts in
the first block that admits it, and there in the home cell of its smaller id, so
link counts are exact without gathering pairs.

Equal vectors of a label are folded first. Cells and labels beyond ``TILE`` rows are
split into tiles, and each pair of tiles is a task of its own. A task returns a
degree and a local spanning forest, never pairs; components join the forests.

At cosine 0.93 at least one block has no axis that spreads so far (all blocks together would
need a variance of 1.26 of the 1 that unit vectors have), so work grows with the square of a
label's rows, in tiles of bounded size. From about 0.945 on, structured vectors use the grids alone.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component, and rows with a null label or id, have no links and are their own
component (a null id has a null component and is kept). Vectors of different
lengths don't compare. Repeated ids count as separate vectors of one component.
Only the three columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

COSINE, BLOCKS = 0.93, 4
#: Rows of a tile; vectors of a length from which axes are taken; grid axes of a block; spread in radii for a grid.
TILE, SAMPLE, GRID_AXES, SPREAD = 4096, 4096, 3, 3.0
#: Lengths of vectors that a table may mix.
MAX_LENGTHS = 64
_SLACK = 1e-9


class Plan:
    """Rotation, blocks, budgets and grids for vectors of one length."""

    def __init__(self, sample: np.ndarray, cosine: float, blocks: int):
        d = sample.shape[1]
        _, axes = np.linalg.eigh(sample.T @ sample)
        self.rotation = np.ascontiguousarray(axes[:, ::-1])
        m = min(blocks, d)
        edges = [d * k // m for k in range(m + 1)]
        self.cosine, self.blocks = cosine, list(zip(edges, edges[1:]))
        self.budgets = [(2 - 2 * cosine + _SLACK) * (b - a) / d for a, b in self.blocks]
        spread = (sample @ self.rotation).std(axis=0)
        self.grids: dict[int, list[int]] = {}
        for k, ((a, b), t) in enumerate(zip(self.blocks, self.budgets)):
            if axes_used := [i for i in range(a, b) if spread[i] > SPREAD * t**0.5][:GRID_AXES]:
                self.grids[k] = axes_used
        self.open = [k for k in range(m) if k not in self.grids]

    def admitted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """First block within its budget for each row pair, or the number of blocks."""
        square = (x - y) ** 2
        out = np.full(len(x), len(self.blocks))
        for k in reversed(range(len(self.blocks))):
            a, b = self.blocks[k]
            out[np.ascontiguousarray(square[:, a:b]).sum(axis=1) <= self.budgets[k]] = k
        return out

    def cells(self, k: int, rotated: np.ndarray) -> list[tuple[int, int, bool]]:
        """(row, cell number, at home) of block k's grid; cells are twice as wide as the block's radius."""
        r = self.budgets[k] ** 0.5 * (1 + 1e-9)
        axes = self.grids[k]
        x = rotated[:, axes]
        home, low, high = (np.floor(v / (2 * r)).astype(np.int64) for v in (x, x - r, x + r))
        out = []
        for i in range(len(x)):
            spots = [0]
            for j in range(len(axes)):
                spots = [s << 21 | c + (1 << 20) for s in spots for c in range(int(low[i, j]), int(high[i, j]) + 1)]
            own = 0
            for c in home[i].tolist():
                own = own << 21 | c + (1 << 20)
            out += [(i, s, s == own) for s in spots]
        return out


def _plans(distinct: DataFrame, cosine: float, blocks: int) -> dict[int, Plan]:
    sizes = {r["d"]: r["n"] for r in distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).limit(MAX_LENGTHS + 1).collect()}
    if len(sizes) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    plans = {}
    for d, n in sizes.items():
        some = distinct.where((F.size("v") == d) & (F.pmod(F.xxhash64("node"), F.lit(max(1, n // SAMPLE))) == 0)).select("v").limit(SAMPLE).collect()
        sample = np.array([r["v"] for r in some] or np.eye(d), np.float64)
        plans[d] = Plan(sample / np.linalg.norm(sample, axis=1, keepdims=True), cosine, blocks)
    return plans


_PLACED = "label long, d int, block int, cell long, home boolean, node long, n long, v binary, u binary"


def _place(distinct: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """A row for each cell of each gridded block, and one for all blocks without a grid (block -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, nodes, counts, vectors = (batch.column(k).to_pylist() for k in range(4))
            out = []
            for d, plan in plans.items():
                rows = [i for i, v in enumerate(vectors) if len(v) == d]
                if not rows:
                    continue
                v = np.array([vectors[i] for i in rows], np.float64)
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                turned = v @ plan.rotation
                packed = [(v[k].tobytes(), turned[k].tobytes()) for k in range(len(rows))]
                places = [(k, -1, 0, True) for k in range(len(rows))] if plan.open else []
                for block in plan.grids:
                    places += [(k, block, cell, home) for k, cell, home in plan.cells(block, turned)]
                out += [(labels[rows[k]], d, block, cell, home, nodes[rows[k]], counts[rows[k]], *packed[k]) for k, block, cell, home in places]
            for low in range(0, len(out), 5000):
                part = list(zip(*out[low : low + 5000]))
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(part, types)], names=[x.split()[0] for x in _PLACED.split(", ")])

    return distinct.select("label", "node", "n", "v").mapInArrow(run, _PLACED)


def _compare(plan: Plan, block: int, table: pa.Table) -> pa.Table:
    """One pair of tiles: homes of one against all rows of the other, or an open group's triangle."""
    column = lambda n: table.column(n).to_numpy(zero_copy_only=False)
    node, count, home, tile = column("node"), column("n"), column("home"), column("tile")
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    unpack = lambda n: np.frombuffer(b"".join(table.column(n).to_pylist()), np.float64).reshape(len(node), -1)
    exact, turned = unpack("v"), unpack("u")
    left, right = np.flatnonzero((tile == i) & home), np.flatnonzero(tile == j)
    degree, root = np.zeros(len(node), np.int64), np.arange(len(node))
    blocks = plan.open if block < 0 else [block]
    squares = {k: (turned[:, a:b] ** 2).sum(axis=1) for k, (a, b) in enumerate(plan.blocks) if k in blocks}
    for low in range(0, len(left), 1024):
        part = left[low : low + 1024]
        near = np.zeros((len(part), len(right)), bool)
        for k in blocks:
            a, b = plan.blocks[k]
            near |= squares[k][part, None] + squares[k][right] - 2 * (turned[part, a:b] @ turned[right, a:b].T) <= plan.budgets[k] + 1e-9
        x, y = np.nonzero(near)
        x, y = part[x], right[y]
        # Grids: the smaller id is at home here. Open groups: a triangle within a tile, all of two tiles.
        once = node[x] < node[y] if block >= 0 or i == j else np.ones(len(x), bool)
        x, y = x[once], y[once]
        for start in range(0, len(x), 20_000):
            p, q = x[start : start + 20_000], y[start : start + 20_000]
            good = np.isin(plan.admitted(turned[p], turned[q]), blocks)
            p, q = p[good], q[good]
            good = (exact[p] * exact[q]).sum(axis=1) >= plan.cosine
            p, q = p[good], q[good]
            np.add.at(degree, p, count[q])
            np.add.at(degree, q, count[p])
            bounds = np.flatnonzero(np.diff(p)) + 1
            for s, e in zip([0, *bounds], [*bounds, len(p)]):
                if s < e:
                    found = np.unique(np.append(root[q[s:e]], root[p[s]]))
                    if len(found) > 1:
                        root[np.isin(root, found[1:])] = found[0]
    hit = np.flatnonzero(degree)
    return pa.table({"node": pa.array(node[hit], pa.int64()), "degree": pa.array(degree[hit], pa.int64()), "root": pa.array(node[root[hit]], pa.int64())})


def near_duplicates(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    blocks: int = BLOCKS,
    tile: int | None = None,
) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    tile = tile or TILE
    rows = table.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = (
        F.col("_id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    # -0.0 counts as 0.0, so that equal vectors have equal keys.
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("key", F.when(F.col("ok"), F.sha2(F.to_json(F.struct("label", F.transform("v", lambda x: x + 0.0))), 256)))
    distinct = cut(rows.where("ok").groupBy("key").agg(F.min("label").alias("label"), F.min("_id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v")))
    plans = _plans(distinct, cosine, blocks)
    placed = _place(distinct, plans)
    keys = ["label", "d", "block", "cell"]
    hot = placed.groupBy(*keys).count().where(F.col("count") > tile).select(*keys, F.ceil(F.col("count") / tile).cast("long").alias("tiles"))
    spread = placed.join(hot, keys, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long"))).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    # Open groups are symmetric: pairs of tiles i <= j. Grids: homes of tile i meet all rows of tile j.
    others = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    triangle = F.transform(others, lambda o: F.struct(F.least("tile", o).alias("i"), F.greatest("tile", o).alias("j")))
    square = F.array_union(
        F.when(F.col("home"), F.transform(others, lambda o: F.struct(F.col("tile").alias("i"), o.alias("j")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>")),
        F.transform(others, lambda o: F.struct(o.alias("i"), F.col("tile").alias("j"))),
    )
    sides = spread.select(*keys, "home", "node", "n", "v", "u", "tile", F.inline(F.when(F.col("block") < 0, triangle).otherwise(square)))

    def meet(table: pa.Table) -> pa.Table:
        return _compare(plans[table.column("d")[0].as_py()], table.column("block")[0].as_py(), table)

    links = cut(sides.groupBy(*keys, "i", "j").applyInArrow(meet, "node long, degree long, root long"))
    degrees = links.groupBy("node").agg(F.sum("degree").alias("degree"))
    members = connected_components(links, "node", "root")
    classes = distinct.select("key", "n", "node").join(degrees, "node", "left").join(members, "node", "left")
    classes = classes.select("key", (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.select("_id", "key").join(classes, "key", "left")
    component = F.coalesce("component_id", "_id")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )


def op2(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS norm FROM usable),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= {COSINE}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, coalesce(r.low, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(r.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = e.vec_id
"""
