"""Near-duplicate vectors: pairs with equal labels and a cosine of 0.98 or more, by an epsilon grid order join.

Method: vectors are scaled to length 1, so that a cosine of c is a distance of
sqrt(2 - 2 c), the grid's epsilon.  The principal directions of all vectors come from their
second moments, a matrix as wide as a vector.  Vectors are sorted by label and by
their grid cells on the leading directions, lexicographically: the epsilon grid
order.  The sorted sequence is written in blocks of ``BLOCK`` vectors.  Two
blocks are joined if the ranges of their projections come within epsilon on every leading
direction; others are provably too far apart.  In a task the two intervals
are halved again and again, pairs of halves that are too far apart are skipped,
and what is left is compared by exact cosines in double precision.

Equal vectors count as one with a multiplicity.  A task returns numbers of
links, and of the links themselves only what keeps its components
together, so the result grows with the vectors and not with the pairs.

Vectors of different lengths are never near; each length has a grid of its own.
Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor do those without a label.  Finite vectors of any magnitude are
compared.  Rows that repeat an id are vectors of their own, equal rows count one by one.
An empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import connected_components, small_batches, stage

COSINE = 0.98
LEADING = 4
BLOCK = 1024
#: Intervals of so many vectors are compared directly.
LEAF = 64
#: Slack of the grid against rounding of projections.
SLACK = 1e-6


def _usable(rows: DataFrame) -> DataFrame:
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("label is not null and v is not null and size(v) > 0").where(~bad).where(F.array_max(F.transform("v", F.abs)) > 0)


def _scaled(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("v")
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    # by the largest component first, so that no square under- or overflows
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            unit = _scaled(batch)
            own = np.concatenate([unit.sum(axis=0)[None], unit.T @ unit])
            total = own if total is None else total + own
    if total is not None:
        yield pa.record_batch({"m": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})


def leading_directions(vectors: DataFrame, dim: int, n: int, count: int = LEADING) -> np.ndarray:
    """Principal directions of all vectors, from one row of sums for each task."""
    sums = vectors.select("v").mapInArrow(_moments, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    m = np.zeros((dim + 1) * dim)
    for row in sums.collect():  # dim * (dim + 1) numbers
        m[row["i"]] = row["x"]
    m = m.reshape(dim + 1, dim) / n
    _, directions = np.linalg.eigh(m[1:] - np.outer(m[0], m[0]))
    return directions[:, ::-1][:, :count]


def _projected(directions: np.ndarray, epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.floor(_scaled(batch) @ directions / epsilon).astype(np.int32) if batch.num_rows else np.zeros((0, directions.shape[1]), np.int32)
            columns = {n: batch.column(n) for n in ("label", "vid", "copies", "v")}
            yield pa.record_batch(columns | {f"c{i}": cells[:, i] for i in range(cells.shape[1])})

    return run


def _blocked(directions: np.ndarray):
    """One row for each block of the sorted sequence, of one label each."""

    def packed(rows: list[tuple], label) -> tuple:
        unit = np.stack([r[2] for r in rows])
        at = unit @ directions
        ids, copies = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        return label, len(rows), ids.tobytes(), copies.tobytes(), unit.tobytes(), at.min(axis=0).tolist(), at.max(axis=0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, label = [], None
        names = ["label", "n", "ids", "copies", "unit", "low", "high"]
        types = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]

        def out(row):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            for own, vid, copies, unit in zip(*(batch.column(c).to_pylist() for c in ("label", "vid", "copies")), _scaled(batch)):
                if held and (own != label or len(held) == BLOCK):
                    yield out(packed(held, label))
                    held = []
                label = own
                held.append((vid, copies, unit))
        if held:
            yield out(packed(held, label))

    return run


class _Links:
    """Links between two blocks: numbers for each vector, and a spanning forest."""

    def __init__(self, directions: np.ndarray, epsilon: float, cosine: float):
        self.directions, self.epsilon, self.cosine = directions, epsilon, cosine

    def join(self, a: np.ndarray, b: np.ndarray, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (i, j) that link; for one block with itself, each pair once."""
        pa_, pb = a @ self.directions, b @ self.directions
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(0, len(a), 0, len(b))]
        while stack:
            i, j, k, m = stack.pop()
            if same and m <= i:  # below the diagonal
                continue
            gap = np.maximum(pa_[i:j].min(axis=0) - pb[k:m].max(axis=0), pb[k:m].min(axis=0) - pa_[i:j].max(axis=0))
            if np.maximum(gap, 0).max() > self.epsilon + SLACK:
                continue
            if max(j - i, m - k) > LEAF:
                if j - i >= m - k:
                    half = (i + j) // 2
                    stack += [(i, half, k, m), (half, j, k, m)]
                else:
                    half = (k + m) // 2
                    stack += [(i, j, k, half), (i, j, half, m)]
                continue
            x, y = np.nonzero(a[i:j] @ b[k:m].T >= self.cosine)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                found.append((x, y))
        return found


def _joined(directions: np.ndarray, epsilon: float, cosine: float):
    """(kind, a, b): kind 0 tells that vector a has b links more, kind 1 that a and b are in one component."""
    links = _Links(directions, epsilon, cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["a_id"] == row["b_id"]
                a, b = (np.frombuffer(row[f"{s}_unit"]).reshape(row[f"{s}_n"], -1) for s in "ab")
                ids = np.concatenate([np.frombuffer(row["a_ids"], np.int64), np.frombuffer(row["b_ids"], np.int64)])
                copies = [np.frombuffer(row[f"{s}_copies"], np.int64) for s in "ab"]
                counts = np.zeros(len(ids), np.int64)
                parent = np.arange(len(ids))
                for x, y in links.join(a, b, same):
                    y_at = y if same else y + len(a)
                    np.add.at(counts, x, copies[1][y])
                    np.add.at(counts, y_at, copies[0][x])
                    _unite(parent, x, y_at)
                root = _roots(parent)
                has = np.flatnonzero(counts)
                other = np.flatnonzero(root != np.arange(len(ids)))
                kind = np.repeat(np.array([0, 1], np.int32), [len(has), len(other)])
                yield pa.record_batch({"kind": kind, "a": np.append(ids[has], ids[other]), "b": np.append(counts[has], ids[root[other]])})

    return run


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if (above == parent).all():
            return parent
        parent = above


def _unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the trees of x[i] and y[i] for all i."""
    while True:
        parent[:] = _roots(parent)
        a, b = parent[x], parent[y]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def _grid_links(groups: DataFrame, dim: int, n: int, cosine: float) -> DataFrame:
    """(kind, a, b) of the ``n`` groups of vectors of length ``dim``, staged."""
    spark, at = groups.sparkSession, F.monotonically_increasing_id()
    epsilon = float(np.sqrt(2 - 2 * cosine))
    directions = leading_directions(groups, dim, max(n, 1), min(LEADING, dim))
    cells = [f"c{i}" for i in range(directions.shape[1])]
    projected = groups.select("label", "vid", "copies", "v").mapInArrow(
        _projected(directions, epsilon), "label string, vid bigint, copies bigint, v array<double>, " + ", ".join(f"{c} int" for c in cells)
    )
    ordered = projected.repartitionByRange("label", *cells, "vid").sortWithinPartitions("label", *cells, "vid")
    blocks = ordered.mapInArrow(
        _blocked(directions), "label string, n int, ids binary, copies binary, unit binary, low array<double>, high array<double>"
    )
    blocks = stage(blocks.select("*", at.alias("id")), "blocks")
    outline = blocks.select("label", "id", "low", "high")
    one, two = outline.alias("one"), outline.alias("two")
    reach = F.lit(epsilon + SLACK)
    near = F.lit(True)
    for i in range(len(cells)):
        near = near & (F.col("one.low")[i] - F.col("two.high")[i] <= reach) & (F.col("two.low")[i] - F.col("one.high")[i] <= reach)
    pairs = one.join(two, (F.col("one.label") == F.col("two.label")) & (F.col("one.id") <= F.col("two.id")) & near).select(
        F.col("one.id").alias("a_id"), F.col("two.id").alias("b_id")
    )
    sides = [blocks.select(*(F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "ids", "copies", "unit"))) for s in "ab"]
    work = pairs.join(sides[0], "a_id").join(sides[1], "b_id")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return stage(work.repartition(tasks).mapInArrow(_joined(directions, epsilon, cosine), "kind int, a bigint, b bigint"), "found")


def epsilon_grid_join(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label")
    )
    # vid names a group of equal vectors with equal labels
    groups = _usable(rows).groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    groups = stage(groups.select("*", F.monotonically_increasing_id().alias("vid")), "groups")
    # lengths are those of the models that made the vectors
    widths = groups.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()
    if not widths:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = None
    for width in widths:
        part = _grid_links(groups.where(F.size("v") == width["dim"]), width["dim"], width["n"], cosine)
        found = part if found is None else found.unionByName(part)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("vid")).agg(F.sum("b").alias("links"))
    component = connected_components(found.where("kind = 1").select("a", "b"))
    known = groups.join(counts, "vid", "left").join(component.withColumnRenamed("v", "vid"), "vid", "left")
    known = stage(known.select("vid", "label", "v", "copies", "first", "links", F.coalesce("component", "vid").alias("component")), "known")
    smallest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    told = known.join(smallest, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(told, ["label", "v"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )
