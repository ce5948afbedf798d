"""K-means of many runs at once.

An elbow tries every number of clusters from several starts.  Run by run that is
a Spark job for each step of each run.  Here a step is one scan for all runs that
still move: tasks add up their vectors for each (run, cluster), Spark sums over the tasks,
and the driver sees one row for each cluster.

Vectors lie in cells of near ones, whose sums are kept.  A cell that lies wholly on one
centre's side counts by its sums; only vectors of cells that a border runs through are
compared one by one, so that a step's cost goes with the borders and not with the rows.

Starts are found as by k-means|| (two rounds of about 2k draws by squared distance, then
weighted k-means++ among the drawn), steps end as in MLlib: once no centre moves
by more than the tolerance, or after the given number of steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that are compared at a time, so that what a task works on stays in the processor's cache.
CHUNK = 2048
#: Vectors of a block, and of a cell in it.
BLOCK = 32_768
CELL = 64
#: How far rounding may shift a comparison of squared distances, as a share of the squares compared.
ROUNDING = 1e-9
TASKS_PER_CORE = 2
TASK_VECTORS = 500_000
ROUNDS = 2
LOCAL_STEPS = 30


@dataclass
class Run:
    k: int
    seed: int
    centres: np.ndarray
    cost: float = float("inf")
    steps: int = 0


def _by_cell(rows: np.ndarray) -> np.ndarray:
    """The rows in an order where each CELL of them lie close together: halved along their widest side until small."""
    order, todo = np.arange(len(rows)), [(0, len(rows))]
    while todo:
        start, end = todo.pop()
        if end - start <= CELL:
            continue
        part = rows[order[start:end]]
        sides = part.max(axis=0) - part.min(axis=0)
        half = -(-(end - start) // CELL) // 2 * CELL
        order[start:end] = order[start:end][np.argpartition(part[:, sides.argmax()], half)]
        todo += [(start, start + half), (start + half, end)]
    return rows[order]


def _cells(rows: np.ndarray) -> np.ndarray:
    """For each CELL of the rows: their number, reach and sum of squares about their mean, and their sum."""
    at = np.arange(0, len(rows), CELL)
    counts = np.diff(np.append(at, len(rows)))
    sums = np.add.reduceat(rows, at, axis=0)
    apart = np.square(rows - np.repeat(sums / counts[:, None], counts, axis=0)).sum(axis=1)
    return np.column_stack([counts, np.sqrt(np.maximum.reduceat(apart, at)), np.add.reduceat(apart, at), sums])


def packed(vectors: DataFrame, column: str = "features") -> DataFrame:
    """(block, data, cells): vectors as the bytes of matrices, by cell, dealt over all cores, a bounded number to a task."""

    def block(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = _by_cell(np.vstack(held))
        return pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in (rows, _cells(rows))], ["data", "cells"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
            if sum(map(len, held)) >= BLOCK:
                yield block(held)
                held = []
        if held:
            yield block(held)

    blocks = vectors.select(vector_to_array(column).alias("x")).mapInArrow(pack, "data binary, cells binary")
    numbered = blocks.select(F.monotonically_increasing_id().alias("block"), "data", "cells")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return numbered.repartition(max(TASKS_PER_CORE * cores, vectors.count() // TASK_VECTORS))


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(-1, width)


def _chunks(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some vectors at a time, and their squared lengths."""
    for at in range(0, len(rows), CHUNK):
        x = rows[at : at + CHUNK]
        yield x, np.einsum("ij,ij->i", x, x)


def _nearest(x: np.ndarray, squares: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of each vector's nearest centre, the first of equals."""
    apart = centres @ x.T
    apart *= -2.0
    apart += np.einsum("ij,ij->i", centres, centres)[:, None]
    best, own = apart[0].copy(), np.zeros(len(x), dtype=np.int64)
    for j in range(1, len(centres)):
        own[apart[j] < best] = j
        np.minimum(best, apart[j], out=best)
    return own, np.maximum(best + squares, 0.0)


def _clear(means: np.ndarray, reach: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place and squared distance of each cell's nearest centre, and whether all of the cell is surely nearest to it.

    The border between two centres is a plane; a cell is clear of it if its mean is further off than it reaches.
    """
    squares, lengths = np.einsum("ij,ij->i", means, means), np.einsum("ij,ij->i", centres, centres)
    apart = lengths[:, None] - 2.0 * (centres @ means.T)
    own, best = apart.argmin(axis=0), apart.min(axis=0)
    gaps = np.sqrt(np.square(centres[:, None] - centres).sum(axis=2))[:, own]
    slack = ROUNDING * (squares + reach * reach + lengths.max())
    # of equal centres the first has all
    clear = ((gaps == 0) | (apart - best > 2.0 * reach * gaps + slack)).all(axis=0)
    return own, np.maximum(best + squares, 0.0), clear


def _block_sums(rows: np.ndarray, cells: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each centre the number, sum of squared distances and sum of its vectors; and how many had to be compared."""
    counts, reach, spread, sums = cells[:, 0], cells[:, 1], cells[:, 2], cells[:, 3:]
    own, apart, clear = _clear(sums / counts[:, None], reach, centres)
    places = np.arange(len(centres))[:, None]
    mine = ((own == places) & clear).astype(np.float64)
    n, cost, total = mine @ counts, mine @ (spread + counts * apart), mine @ sums
    rest = np.repeat(~clear, counts.astype(np.int64))
    for x, squares in _chunks(rows[rest] if not rest.all() else rows):
        own, apart = _nearest(x, squares, centres)
        mine = (own == places).astype(np.float64)
        n, cost, total = n + mine.sum(axis=1), cost + mine @ apart, total + mine @ x
    return n, cost, total, int(rest.sum())


def _scan(blocks: DataFrame, schema: str, of_block: Callable[[int, bytes], Iterator[tuple]] | None = None, of_task: Callable | None = None) -> DataFrame:
    """Rows of ``schema`` that tasks make of their blocks: of each one's vectors, or of all vectors and cells of the task."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    kinds = [types[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for b in batches for part in zip(*(c.to_pylist() for c in b.columns)))
        rows = of_task((d, c) for _, d, c in parts) if of_task else (row for i, d, _ in parts for row in of_block(i, d))
        found = list(rows)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), kinds)], names)

    return blocks.mapInArrow(run, schema)


def _sums(blocks: DataFrame, width: int, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each run: vectors and their sums by nearest centre, and the sum of squared distances, from one scan."""

    def of_task(parts: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple]:
        sums = {r: np.zeros((len(c), width)) for r, c in centres.items()}
        counts = {r: np.zeros(len(c)) for r, c in centres.items()}
        costs = {r: np.zeros(len(c)) for r, c in centres.items()}
        for data, cells in parts:
            rows, near = _matrix(data, width), _matrix(cells, width + 3)
            for r, c in centres.items():
                n, cost, total, _ = _block_sums(rows, near, c)
                counts[r] += n
                costs[r] += cost
                sums[r] += total
        for r in centres:
            for j in np.flatnonzero(counts[r]):
                yield r, int(j), float(counts[r][j]), float(costs[r][j]), sums[r][j].tolist()

    parts = _scan(blocks, "run int, cluster int, n double, cost double, x array<double>", of_task=of_task)
    rows = parts.groupBy("run", "cluster").agg(F.sum("n"), F.sum("cost"), *[F.sum(F.col("x")[i]) for i in range(width)]).collect()
    found = {r: (np.zeros(len(c)), np.zeros((len(c), width)), 0.0) for r, c in centres.items()}
    for r, j, n, cost, *x in rows:
        counts, sums, whole = found[r]
        counts[j], sums[j] = n, x
        found[r] = counts, sums, whole + cost
    return found


def _drawn(blocks: DataFrame, width: int, centres: dict[int, np.ndarray], shares: dict[int, float], seeds: dict[int, int], number: int) -> list[tuple[int, np.ndarray]]:
    """(run, vector) of vectors drawn with a chance of their squared distance times the run's share."""

    def of_block(block: int, data: bytes) -> Iterator[tuple]:
        luck = {r: np.random.default_rng([seeds[r], number, block]) for r in centres}
        for x, squares in _chunks(_matrix(data, width)):
            for r, c in centres.items():
                _, apart = _nearest(x, squares, c)
                for i in np.flatnonzero(luck[r].random(len(x)) < apart * shares[r]):
                    yield r, x[i].tolist()

    rows = _scan(blocks, "run int, x array<double>", of_block=of_block).collect()
    return sorted(((r, np.array(x)) for r, x in rows), key=lambda p: (p[0], p[1].tolist()))


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ and some steps among a few vectors."""
    rng = np.random.default_rng(seed)
    squares = np.einsum("ij,ij->i", points, points)
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    while len(chosen) < k:
        _, apart = _nearest(points, squares, points[chosen])
        apart[chosen] = 0.0
        chance = apart * weights
        if not chance.sum() > 0:
            break
        chosen.append(int(rng.choice(len(points), p=chance / chance.sum())))
    centres = points[chosen].copy()
    for _ in range(LOCAL_STEPS):
        own, _ = _nearest(points, squares, centres)
        moved = centres.copy()
        for j in range(len(centres)):
            mine = own == j
            if weights[mine].sum() > 0:
                moved[j] = np.average(points[mine], axis=0, weights=weights[mine])
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def _starts(blocks: DataFrame, firsts: list[np.ndarray], width: int, tried: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """First centres of each (k, seed)."""
    known = {r: firsts[r % len(firsts)][None, :] for r in range(len(tried))}
    seeds = {r: seed for r, (_, seed) in enumerate(tried)}
    for number in range(ROUNDS):
        costs = {r: found[2] for r, found in _sums(blocks, width, known).items()}
        shares = {r: 2.0 * tried[r][0] / costs[r] if costs[r] > 0 else 0.0 for r in known}
        for r, x in _drawn(blocks, width, known, shares, seeds, number):
            known[r] = np.vstack([known[r], x])
    known = {r: np.unique(c, axis=0) for r, c in known.items()}
    weights = {r: found[0] for r, found in _sums(blocks, width, known).items()}
    return [
        known[r] if len(known[r]) <= k else _plus_plus(known[r], weights[r], k, seed) for r, (k, seed) in enumerate(tried)
    ]


def fit_all(vectors: DataFrame, tried: Sequence[tuple[int, int]], steps: int, tolerance: float = 1e-4) -> list[Run]:
    """One finished run for each (number of clusters, seed), in their order."""
    # any few vectors will do to begin with: those of the smallest hashes
    seed = tried[0][1]
    order = F.xxhash64("_x", F.lit(seed))
    firsts = [np.array(x) for (x,) in vectors.select(vector_to_array("features").alias("_x")).orderBy(order, "_x").limit(len(tried)).collect()]
    if not firsts:
        raise ValueError("no vectors to cluster")
    width = len(firsts[0])
    blocks = packed(vectors).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        runs = [Run(k, s, c) for (k, s), c in zip(tried, _starts(blocks, firsts, width, tried))]
        moving = set(range(len(runs)))
        for _ in range(steps):
            for r, (counts, sums, _) in _sums(blocks, width, {r: runs[r].centres for r in moving}).items():
                run, full = runs[r], counts > 0
                moved = run.centres.copy()  # a centre without vectors stays
                moved[full] = sums[full] / counts[full][:, None]
                if (np.square(moved - run.centres).sum(axis=1) <= tolerance * tolerance).all():
                    moving.discard(r)
                run.centres, run.steps = moved, run.steps + 1
            if not moving:
                break
        for r, found in _sums(blocks, width, {r: run.centres for r, run in enumerate(runs)}).items():
            runs[r].cost = found[2]
    finally:
        blocks.unpersist()
    return runs


def nearest(point: Column, centres: np.ndarray) -> Column:
    """Number of the centre that an array of features is nearest to."""
    apart = [sum(((point[i] - F.lit(float(v))) * (point[i] - F.lit(float(v))) for i, v in enumerate(c)), F.lit(0.0)) for c in centres]
    every = F.array(*apart)
    return (F.array_position(every, F.array_min(every)) - 1).cast("int")
