"""Exact removal of repeated byte strings of ``LENGTH`` bytes across documents.

A byte goes if some string of LENGTH bytes that covers it also starts in a
document with a smaller id.  Matches are found on the input texts.

Method: column-wise construction of the suffix order of a collection (its
Burrows-Wheeler transform) with its common prefixes: each round inserts
one symbol of every string of the collection, the new suffix order follows from
the last one by a stable sort on that symbol, and common prefixes grow by one
where neighbours have the same symbol.  Runs of suffixes with a common
prefix of LENGTH are equal windows; the smallest id of a run is known at once.

A collection of whole documents would take as many rounds as the longest
document has bytes, each rewriting all that was built.  So the construction
is run on short strings of bounded length, cut around repeated anchors:

1. Each window of LENGTH bytes names the grams of ``GRAM`` bytes with the
   smallest hash in it; equal windows name equal grams.  The 48-bit hashes
   of named grams, about 6 in 100 bytes, are counted, in tasks first; those of one
   document only are dropped.  Other windows can't repeat.
2. Around each remaining anchor lies a segment that holds all windows with
   it, cut at the ends of the document.  Equal segments are aggregated to
   their smallest and largest id before they move.  An anchor in more than ``HOT``
   documents, or that comes back in more than ``AGAIN_FOR_EACH * HOT`` surroundings
   in documents that have it, has its windows cut out one by one, each a segment by itself that
   goes by its content, so that a line which a third of all documents hold
   is no group in one task, and the segments of a group are bounded.
3. The segments of an anchor meet in one task, which runs the rounds above over
   blocks of segments.
4. Each segment finds out from which windows a smaller id is known; the bytes
   of those windows are removed.

The scans are told which anchors are shared, and which segments have such
windows, by bitmaps of bounded size; a shared bit lets through too much, never too
little.  So texts move only once, to meet what they lose.

A document with the text of a smaller id is removed whole without all this.
Null texts are empty; texts under LENGTH bytes keep everything; a null doc_id
neither loses nor removes anything.  Rows with the same id are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import is_small, small_batches, stage, text_rows
from llm.hashing import mix, running, slice_hashes
from llm.sieve import as_array, key_counts, marked, passes, sieve

LENGTH = 50
#: Stands for a null doc_id.
NO_ID = -(2**63)
GRAM = 20
#: Documents with an anchor from which its windows go by their content.
HOT = 20_000
#: In as many more surroundings may an anchor come back in documents that have it, until the same happens.
AGAIN_FOR_EACH = 10
#: Segments in one construction, up to the end of the last anchor's.
BLOCK = 60_000
_REACH = LENGTH - GRAM
_SEGMENT = LENGTH + _REACH
_PIECE = 1 << 20
_BITS = np.uint64((1 << 48) - 1)
#: Marks surroundings in which a document has an anchor again.
_AGAIN = 1 << 48
#: Bits of a bitmap: 32 for each key, at most 64 MB in all.
_MOST_BITS = 29
#: Bits of the bitmap of documents that go whole (2 MB).
_WHOLE_BITS = 24


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _named(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that some window names; windows across ``ends`` of texts don't count."""
    if len(codes) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums, inverse = running(codes)
    n = len(codes) - GRAM + 1
    hashes = mix((sums[GRAM:] - sums[:n]) * inverse[:n]) & _BITS
    least = _sliding(hashes, _REACH + 1, np.minimum)
    crossing = np.zeros(len(least) + 1, np.int32)
    for e in ends:  # windows that start in the last LENGTH - 1 bytes of a text
        crossing[max(0, e - LENGTH + 1) : e] = 1
    least[crossing[: len(least)] > 0] = 0
    padded = np.concatenate([np.zeros(_REACH, np.uint64), least, np.zeros(_REACH, np.uint64)])
    named = np.flatnonzero((_sliding(padded, _REACH + 1, np.maximum) == hashes) & (hashes > 0))
    return named, hashes[named]


def anchors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the positions and 48-bit hashes of its anchors, in order."""
    out: list = [None] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            lengths = np.array([len(texts[i]) for i in group])
            ends = np.cumsum(lengths)
            at, hashes = _named(np.frombuffer(b"".join(texts[i] for i in group), np.uint8), ends)
            cut = np.searchsorted(at, ends)
            for i, first, last, begin in zip(group, np.append(0, cut), cut, ends - lengths):
                out[i] = (at[first:last] - begin, hashes[first:last])
        group.clear()
        size = 0

    for i, text in enumerate(texts):
        if len(text) > _PIECE:  # in overlapping pieces: what a window names depends on the window alone
            parts = []
            for a in range(0, len(text), _PIECE):
                piece = np.frombuffer(text[a : a + _PIECE + LENGTH - 1], np.uint8)
                at, hashes = _named(piece, np.array([len(piece)]))
                parts.append((at + a, hashes))
            at, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
            out[i] = (at, np.concatenate([p[1] for p in parts])[first])
            continue
        if size + len(text) > _PIECE:
            flush()
        group.append(i)
        size += len(text)
    flush()
    return out


def _anchor_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The anchors of each document once, and marked ones for the different surroundings in which documents of a slice have them again."""
    pad = b"\xff" * _REACH
    for _, texts in text_rows(batches):
        once, again, around = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for text, (pos, hashes) in zip(texts, anchors(texts)):
            order = np.argsort(hashes, kind="stable")
            same = np.append(False, hashes[order[1:]] == hashes[order[:-1]])[: len(order)]
            once.append(hashes[order[~same]])
            if same.any():
                own = order[same]
                codes = np.frombuffer(pad + text + pad, np.uint8)
                again.append(hashes[own])
                around.append(_digests(codes[pos[own][:, None] + np.arange(_SEGMENT)]).view(np.uint64))
        yield np.concatenate(once)
        again, around = np.concatenate(again), np.concatenate(around)
        yield again[np.unique(again ^ around, return_index=True)[1]] | np.uint64(_AGAIN)


def _told(keys: DataFrame):
    """The keys as a bitmap for all tasks."""
    bits = min(max(keys.count(), 1).bit_length() + 5, _MOST_BITS)
    bits = max(bits, 20)
    return keys.sparkSession.sparkContext.broadcast(as_array(sieve(keys, bits), bits))


def _segments(shared, hot, losing):
    """(h, sid, ids, rks, at): the segments of a slice of documents that have a window to lose, and where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, hashes, at, data in _around(batches, 8 << 20, shared.value, hot.value):
            sids = _digests(data)
            own = np.flatnonzero(passes(losing.value, (hashes ^ sids).view(np.uint64)))
            own = own[np.argsort(sids[own])]
            h, sid = hashes[own], sids[own]
            first = np.flatnonzero(np.append(True, (sid[1:] != sid[:-1]) | (h[1:] != h[:-1]))) if len(own) else own
            offsets = pa.array(np.append(first, len(own)), pa.int32())
            places = {"ids": part.column("id").to_numpy()[row[own]], "rks": part.column("rk").to_numpy()[row[own]], "at": at[own]}
            lists = {n: pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for n, v in places.items()}
            yield pa.record_batch({"h": h[first], "sid": sid[first]} | lists)

    return run


def _distinct_segments(shared, hot):
    """(h, sid, seg, low, high): the segments of a slice of documents once each, with the smallest and largest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, hashes, _, data in _around(batches, 8 << 20, shared.value, hot.value):
            ids, sids = part.column("id").to_numpy()[row], _digests(data)
            order = np.argsort(sids)
            # neighbours with other bytes are other segments, whatever their digests
            other = (hashes[order[1:]] != hashes[order[:-1]]) | (sids[order[1:]] != sids[order[:-1]])
            alike = np.flatnonzero(~other)
            other[alike] = (data[order[alike + 1]] != data[order[alike]]).any(axis=1)
            first = np.flatnonzero(np.append(True, other)) if len(order) else order
            least, most = (f.reduceat(ids[order], first) if len(order) else ids for f in (np.minimum, np.maximum))
            at = order[first]
            yield pa.record_batch({"h": hashes[at], "sid": sids[at], "seg": _binary(data[at]), "low": least, "high": most})

    return run


def _digests(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of segments; with the anchor's hash they tell segments apart."""
    flat = np.ascontiguousarray(data).ravel()
    out = [np.zeros(0, np.uint64)]
    step = _SEGMENT * 8192
    for a in range(0, len(flat), step):
        piece = flat[a : a + step]
        begin = np.arange(0, len(piece), _SEGMENT)
        out.append(slice_hashes(piece, begin, begin + _SEGMENT))
    return np.concatenate(out).view(np.int64)


def _binary(data: np.ndarray) -> pa.Array:
    offsets = np.arange(len(data) + 1, dtype=np.int32) * _SEGMENT
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _around(batches: Iterator[pa.RecordBatch], size: int, shared: np.ndarray, hot: np.ndarray):
    """Each slice of documents with the row, hash, place and bytes of its segments."""
    pad = b"\xff" * _REACH
    window = np.arange(_SEGMENT)
    for part, texts in text_rows(batches, size):
        rows, hs, at, segs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, _SEGMENT), np.uint8)]
        for i, (pos, hashes) in enumerate(anchors(texts)):
            keep = np.flatnonzero(passes(shared, hashes))
            if not len(keep):
                continue
            pos, hashes = pos[keep], hashes[keep]
            codes = np.frombuffer(pad + texts[i] + pad, np.uint8)
            own = codes[pos[:, None] + window]
            very = passes(hot, hashes)
            found = [(hashes, pos, own)]
            if very.any():
                found = [(hashes[~very], pos[~very], own[~very]), _single_windows(hashes[very], pos[very], own[very])]
            for h, p, seg in found:
                rows.append(np.full(len(p), i))
                hs.append(h)
                at.append(p - _REACH)
                segs.append(seg)
        yield part, np.concatenate(rows), np.concatenate(hs).astype(np.int64), np.concatenate(at).astype(np.int64), np.concatenate(segs)


def _single_windows(hashes: np.ndarray, pos: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window of the segments as a segment with nothing else in it, and a hash of its content in the anchor's place."""
    hs, at, out = [hashes[:0]], [pos[:0]], [segments[:0]]
    if len(pos):
        for j in range(_REACH + 1):
            windows = segments[:, j : j + LENGTH]
            inside = (windows != 0xFF).all(axis=1)
            alone = np.full((int(inside.sum()), _SEGMENT), 0xFF, np.uint8)
            alone[:, j : j + LENGTH] = windows[inside]
            begin = np.arange(len(alone)) * LENGTH
            hs.append(slice_hashes(windows[inside].ravel(), begin, begin + LENGTH) & _BITS)
            at.append(pos[inside])
            out.append(alone)
    return np.concatenate(hs), np.concatenate(at), np.concatenate(out)


def _range_minimum(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of values[left..right], by a table of spans of powers of two."""
    width = right - left + 1
    level = np.frexp(width)[1] - 1
    out = np.zeros(len(left), values.dtype)
    table, span = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        own = level == k
        out[own] = np.minimum(table[left[own]], table[right[own] - span + 1])
        table = np.minimum(table[:-span], table[span:]) if len(table) > span else table
        span *= 2
    return out


def smallest_by_window(segments: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string and each start of a window in it, the smallest id of a string with the same window there.

    Column by column from the right: ``order`` is the suffix order of the
    strings from that column on, ``common[i]`` the common prefix of the i-th
    suffix with the one before it.
    """
    n, width = segments.shape
    smallest = np.empty((n, width - length + 1), np.int64)
    order, common = np.arange(n), np.zeros(n, np.uint8)
    for column in range(width - 1, -1, -1):
        symbols = segments[order, column]
        at = np.argsort(symbols, kind="stable")
        same = symbols[at[1:]] == symbols[at[:-1]]
        grown = np.zeros(n, np.uint8)
        inner = np.flatnonzero(same) + 1
        if column == width - 1:
            grown[inner] = 1
        else:
            grown[inner] = 1 + _range_minimum(common, at[inner - 1] + 1, at[inner])
        order, common = order[at], grown
        if column <= width - length:
            first = np.flatnonzero(common < length)
            least = np.minimum.reduceat(ids[order], first)
            smallest[order, column] = np.repeat(least, np.diff(np.append(first, n)))
    return smallest


def _runs(smallest: np.ndarray, valid: np.ndarray, most: np.ndarray) -> pa.Array:
    """Flat (first start, last start, smallest id) runs of windows that some document must lose."""
    n, width = smallest.shape
    useful = valid & (smallest < most[:, None])
    edge = np.ones(smallest.shape, bool)
    edge[:, 1:] = (smallest[:, 1:] != smallest[:, :-1]) | (useful[:, 1:] != useful[:, :-1])
    start = np.flatnonzero(edge)
    stop = np.append(start[1:], n * width) - 1
    keep = useful.ravel()[start]
    start, stop = start[keep], stop[keep]
    flat = np.stack([start % width, stop % width, smallest.ravel()[start]], axis=1).ravel()
    offsets = np.append(0, 3 * np.cumsum(np.bincount(start // width, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def _construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, sid, runs) of segments that come sorted by anchor, block by block of whole anchors."""

    def solved(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        data = pa.Table.from_batches(tables)
        segments = np.frombuffer(b"".join(data.column("seg").to_pylist()), np.uint8).reshape(-1, _SEGMENT)
        low, h = data.column("low").to_numpy(), data.column("h").to_numpy()
        # a segment that is the only one with its anchor has no order to construct
        other = h[1:] != h[:-1]
        beside = np.flatnonzero(~(np.append(True, other) & np.append(other, True)))
        smallest = np.repeat(low[:, None], _SEGMENT - LENGTH + 1, axis=1)
        if len(beside):
            smallest[beside] = smallest_by_window(segments[beside], low[beside])
        beyond = np.concatenate([np.zeros((len(segments), 1), np.int32), np.cumsum(segments == 0xFF, axis=1, dtype=np.int32)], axis=1)
        valid = beyond[:, LENGTH:] == beyond[:, : _SEGMENT - LENGTH + 1]
        runs = _runs(smallest, valid, data.column("high").to_numpy())
        out = pa.table({"h": data.column("h"), "sid": data.column("sid"), "runs": runs})
        return out.filter(pc.greater(pc.list_value_length(out.column("runs")), 0)).combine_chunks()

    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            hs = batch.column("h").to_numpy()
            if rows + len(hs) < BLOCK:
                held.append(batch)
                rows += len(hs)
                break
            # close the block where an anchor ends
            room = max(BLOCK - rows, 1)
            changes = np.flatnonzero(hs[1:] != hs[:-1]) + 1
            if held and hs[0] != held[-1].column("h")[-1].as_py():
                changes = np.append(0, changes)
            later = changes[changes >= min(room, len(hs) - 1)] if rows < BLOCK else changes
            if not len(later):
                held.append(batch)
                rows += len(hs)
                break
            cut = int(later[0])
            yield from solved([*held, batch.slice(0, cut)]).to_batches()
            held, rows, batch = [], 0, batch.slice(cut)
    if held:
        yield from solved(held).to_batches()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its covered intervals."""
    for part, texts in text_rows(batches):
        removed, spans, digests, kept_texts = [], [], [], []
        for text, covered in zip(texts, part.column("covered").to_pylist()):
            kept, at, gone, runs = [], 0, 0, 0
            for start, end in _merged(covered or []):
                kept.append(text[at:start])
                gone += end - start
                runs += 1
                at = end
            kept.append(text[at:])
            left = b"".join(kept)
            removed.append(gone)
            spans.append(runs)
            digests.append(hashlib.sha256(left).hexdigest())
            kept_texts.append(left)
        ids = part.column("id")
        out = {"doc_id": pc.if_else(pc.equal(ids, NO_ID), pa.scalar(None, pa.int64()), ids), "n_bytes": pa.array([len(t) for t in texts], pa.int64())}
        out |= {"n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": digests}
        if "kept" in part.schema.names:
            out["kept"] = pa.array(kept_texts, pa.binary())
        yield pa.record_batch(out)


def _merged(flat: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the union of flat (start, end) pairs."""
    if not flat:
        return []
    pairs = np.array(flat, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    return list(zip(pairs[first, 0].tolist(), reach[np.append(first[1:], len(pairs)) - 1].tolist()))


def covered_bytes(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(id, rk, covered): flat (start, end) pairs of bytes to remove from ``rows`` (id, rk, text)."""
    key = ["id", "rk"]
    long = rows.where(f"id <> {NO_ID} and octet_length(text) >= {LENGTH}")
    narrow = long.select(*key, F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("bigint").alias("n"))
    first = narrow.groupBy("digest").agg(F.min("id").alias("first_id"))
    copies = stage(narrow.join(first, "digest").where("id > first_id").select(*key, "n").distinct(), "copies")
    texts = _others(long, copies.select(key))
    counts = stage(key_counts(texts.select("text"), _anchor_keys).where("n > 1"), "anchors")
    shared = _told(counts.where(F.col("key") < _AGAIN).select("key"))
    most = F.when(F.col("key") < _AGAIN, F.lit(hot)).otherwise(F.lit(AGAIN_FOR_EACH * hot))
    very = _told(counts.where(F.col("n") > most).select(F.pmod("key", F.lit(_AGAIN)).alias("key")).distinct())
    segments = texts.mapInArrow(_distinct_segments(shared, very), "h bigint, sid bigint, seg binary, low bigint, high bigint")
    classes = segments.repartition("h").groupBy("h", "sid", "seg").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    known = stage(classes.sortWithinPartitions("h").mapInArrow(_construct, "h bigint, sid bigint, runs array<bigint>"), "known")
    losing = _told(known.select(F.col("h").bitwiseXOR(F.col("sid")).alias("key")))
    found = texts.mapInArrow(_segments(shared, very, losing), "h bigint, sid bigint, ids array<bigint>, rks array<bigint>, at array<bigint>")
    at = F.sequence(F.lit(0), F.size("runs") - 1, F.lit(3))
    lost = F.filter(at, lambda i: F.get("runs", i + 2) < F.col("id"))
    pairs = F.flatten(F.transform(lost, lambda i: F.array(F.col("pos") + F.get("runs", i), F.col("pos") + F.get("runs", i + 1) + LENGTH)))
    met = found.join(known, ["h", "sid"]).select("runs", F.explode(F.arrays_zip("ids", "rks", "at")).alias("p"))
    met = met.select(F.col("p.ids").alias("id"), F.col("p.rks").alias("rk"), F.col("p.at").alias("pos"), "runs")
    parts = met.select(*key, pairs.alias("pairs")).where("size(pairs) > 0")
    whole = copies.select(*key, F.array(F.lit(0).cast("bigint"), F.col("n")).alias("pairs"))
    return parts.unionByName(whole).groupBy(key).agg(F.flatten(F.collect_list("pairs")).alias("covered"))


def _others(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """``rows`` without those in ``dropped``, of which only those that a bitmap finds move if they are many."""
    key = ["id", "rk"]
    if is_small(dropped):
        return rows.join(F.broadcast(dropped), key, "left_anti")
    told = marked(rows, F.col("rk"), sieve(dropped.select(F.col("rk").alias("key")), _WHOLE_BITS), _WHOLE_BITS, "maybe")
    maybe = told.where("maybe").select(rows.columns).join(dropped, key, "left_anti")
    return told.where("not maybe").select(rows.columns).unionByName(maybe)


def substring_dedup(docs: DataFrame, hot: int = HOT, kept: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``kept`` also the bytes left."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.select("id", F.xxhash64("id", F.md5(F.col("text").cast("binary"))).alias("rk"), "text")
    out = rows.join(covered_bytes(rows, hot), ["id", "rk"], "left")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if kept:
        out, schema = out.withColumn("kept", F.lit(True)), schema + ", kept binary"
    return out.mapInArrow(_cut, schema)
