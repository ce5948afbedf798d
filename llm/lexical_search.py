"""Ranked lexical search without an index of the documents.

Method: the terms of all items form one Aho-Corasick automaton, each guarded by a
blank before and after it, and the automaton reads the texts, in which
everything between words is made blanks.  So it counts each term's occurrences
straight from the text; its outputs are term numbers, and a table maps a
term to the items that hold it and how often.

Two scans: the first counts documents, lengths and the documents each term is in, the
second scores every document for every item and keeps in each task the best
``TOP`` of an item.  Only those go to the shuffle, where the best of all tasks are ranked.
Nothing is kept of a document but that.

Size: items go through in slices of ``SLICE_BYTES`` of text at most (one item
if it alone is longer), so automaton and term table are bounded whatever the number of
items; each slice costs two scans.  The scores of a block of documents take ``CELLS`` numbers at most.

Defined results: a null text has no terms.  Rows of the item table with one
item_id, null included, are one item with the terms of all of them.  An
item without terms, or whose terms occur nowhere, has no rows.  Rows of the document
table are ranked one by one, equal ids too; a null doc_id comes after all others of its
score.  Empty tables give no rows.  Whole texts are read, whatever their length.
Other columns of either table are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from llm.common import small_batches, text_rows

TOP = 20
SLICE_BYTES = 32 << 20
CELLS = 1 << 21

#: Every byte of a term stays, A-Z made small; what stands between terms becomes a blank.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def guarded(text: bytes) -> bytes:
    return b" " + text.translate(_PLAIN) + b" "


def term_count(text: bytes) -> int:
    """Number of terms in a guarded text: blanks that a term follows."""
    codes = np.frombuffer(text, np.uint8) == 32
    return int(np.count_nonzero(codes[:-1] & ~codes[1:]))


class Items:
    """Terms of a slice of items: the automaton, and for each term its items with multiplicities."""

    def __init__(self, texts: list[list[bytes]]):
        numbers: dict[bytes, int] = {}
        owners, terms = [], []
        for item, parts in enumerate(texts):
            for text in parts:
                for term in guarded(text).split():
                    owners.append(item)
                    terms.append(numbers.setdefault(term, len(numbers)))
        self.size, self.terms = len(texts), len(numbers)
        pairs, self.times = np.unique(np.array(terms, np.int64) * max(1, self.size) + np.array(owners, np.int64), return_counts=True)
        self.items = pairs % max(1, self.size)
        self.first = np.searchsorted(pairs // max(1, self.size), np.arange(self.terms + 1))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for term, number in numbers.items():
            self.automaton.add_word(f" {term.decode()} ", number)
        if numbers:
            self.automaton.make_automaton()
        self.weights = np.zeros(self.terms, np.int64)
        self.documents, self.length = 0, 0

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """(document, term, tf) of every term in every text, and the texts' lengths in terms."""
        found, lengths = [], []
        for text in texts:
            text = guarded(text)
            lengths.append(term_count(text))
            found.append(np.fromiter((number for _, number in self.automaton.iter(text.decode())), np.int64))
        owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        keys, tf = np.unique(owner * self.terms + np.concatenate([*found, np.empty(0, np.int64)]), return_counts=True)
        return keys // self.terms, keys % self.terms, tf, lengths

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Whole scores (text, item), in 64-bit integers."""
        document, term, tf, lengths = self.counts(texts)
        m = np.array([75 + 25 * n * self.documents // self.length for n in lengths], np.int64)
        value = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[document]))
        out = np.zeros(len(texts) * self.size, np.int64)
        spread = self.first[term + 1] - self.first[term]
        ends = np.cumsum(spread)
        at = 0
        while at < len(term):  # so many additions at once
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
            part = slice(at, stop)
            inside = np.arange(ends[stop - 1] - (ends[at - 1] if at else 0)) - np.repeat(ends[part] - spread[part] - (ends[at - 1] if at else 0), spread[part])
            where = np.repeat(self.first[term[part]], spread[part]) + inside
            np.add.at(out, np.repeat(document[part], spread[part]) * self.size + self.items[where], np.repeat(value[part], spread[part]) * self.times[where])
            at = stop
        return out.reshape(len(texts), self.size)


class Best:
    """The ``top`` best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        document, item = np.nonzero(scores >= self.least)
        self.rows.append((item, scores[document, item], missing[document], ids[document]))
        self.size += len(item)
        if self.size > max(1 << 18, 4 * self.top * len(self.least)):
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        item, score, missing, ids = (np.concatenate(x) for x in zip(*self.rows)) if self.rows else (np.empty(0, np.int64),) * 4
        order = np.lexsort((ids, missing, -score, item))
        item, score, missing, ids = item[order], score[order], missing[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == self.top - 1
        self.least[item[full]] = score[full]
        keep = place < self.top
        kept = item[keep], score[keep], missing[keep], ids[keep]
        self.rows, self.size = [kept], int(keep.sum())
        return kept


def _statistics(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        held, documents, length = np.zeros(items.terms, np.int64), 0, 0
        for _, texts in text_rows(batches):
            _, term, _, lengths = items.counts(texts)
            held += np.bincount(term, minlength=items.terms)
            documents += sum(n > 0 for n in lengths)
            length += sum(lengths)
        seen = np.flatnonzero(held)
        # terms below 0: the number of documents, their length
        yield pa.record_batch({"term": np.concatenate([[-2, -1], seen]), "n": np.concatenate([[documents, length], held[seen]]).astype(np.int64)})

    return run


def _ranked(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = Best(items.size, top)
        block = max(1, CELLS // items.size)
        for part, texts in text_rows(batches):
            ids = part.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for at in range(0, len(texts), block):
                best.add(items.scores(texts[at : at + block]), ids[at : at + block], missing[at : at + block])
        item, score, missing, ids = best.prune()
        yield pa.record_batch({"item": item.astype(np.int32), "doc_id": pa.array(ids, pa.int64(), mask=missing.astype(bool)), "score": score})

    return run


def _slice(docs: DataFrame, slice_rows: list, item_type, top: int) -> DataFrame | None:
    spark = docs.sparkSession
    texts: dict[object, list[bytes]] = {}
    for row in slice_rows:
        texts.setdefault(row["item_id"], []).append((row["text"] or "").encode())
    items = Items(list(texts.values()))
    if not items.terms:
        return None
    context = spark.sparkContext
    counted = docs.select("text").mapInArrow(_statistics(context.broadcast(items)), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}  # a row for each term of the slice
    items.documents, items.length = found.get(-2, 0), found.get(-1, 0)
    if not items.length:
        return None
    ratio = [(2 * items.documents + 2) / (2 * found.get(t, 0) + 1) for t in range(items.terms)]
    items.weights = np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)
    ranked = docs.mapInArrow(_ranked(context.broadcast(items), top), "item int, doc_id bigint, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    names = StructType([StructField("item", IntegerType()), StructField("item_id", item_type)])
    ids = spark.createDataFrame(list(enumerate(texts)), names)
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    slices = 1 + size // slice_bytes
    number = F.pmod(F.xxhash64("item_id"), F.lit(slices))
    parts = [_slice(rows, items.where(number == i).collect(), items.schema["item_id"].dataType, top) for i in range(slices)]
    out = None
    for part in parts:
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = items.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
    return out
