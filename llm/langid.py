"""Language identification by prediction by partial matching over bytes.

Every language has a tree of byte contexts of up to ``ORDER`` bytes with the
counts of the bytes that followed.  A text's code length under a language is
the sum over its bytes: the longest context that was seen predicts the byte or
escapes to the next shorter one (escape method C: as many escapes as distinct
successors), bytes that a longer context could have predicted are excluded
there, and below the empty context the bytes that are left are equally likely.
The counts are frozen, so a code length depends on the text and the trees
alone.  The language with the shortest code wins; the score is its share of
the probabilities of all languages.

Before coding, A-Z become a-z and every other ASCII byte becomes a space.

The trees are fitted on a bounded sample: per language up to ``SAMPLE_DOCS``
labelled documents, chosen by a hash of their id from those whose
crc32(doc_id) mod 4 is not 2, and of each the text or, where it is longer than ``SAMPLE_SPAN``
characters, that many in a row from a place the hash names, until
``SAMPLE_BYTES`` are reached.  So no single text fills the sample.  Every text of the
table is scored as a whole.  A text that is null or has no letter is ``und``
with score 0, and so is everything if there is nothing to learn from.  A null
doc_id is never learned from and counts as not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from llm.common import small_batches, text_rows

ORDER = 3
SAMPLE_DOCS = 400
SAMPLE_BYTES = 1_000_000
SAMPLE_SPAN = 8_192
#: Codes scored at once, over all languages.
AT_ONCE = 4 << 20

_PLAIN = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_START = b" " * ORDER


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each byte with the ORDER bytes before it, and where each text begins among them."""
    data = np.frombuffer(b"".join(_START + t.translate(_PLAIN) for t in texts), np.uint8).astype(np.uint32)
    codes = np.zeros(max(len(data) - ORDER, 0), np.uint32)
    for i in range(ORDER + 1):
        codes = (codes << np.uint32(8)) | data[i : len(data) - ORDER + i]
    lengths = np.array([len(t) for t in texts])
    begin = np.cumsum(lengths + ORDER) - lengths - ORDER
    keep = np.ones(len(codes), bool)
    for i in range(ORDER):  # bytes of the padding are not coded
        at = begin[1:] - ORDER + i
        keep[at[at >= 0]] = False
    return codes[keep], np.cumsum(lengths) - lengths


class Tree:
    """Frozen counts of one language: for every context length the known grams and contexts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.grams, self.contexts = [], []
        for k in range(ORDER + 1):  # k bytes of context
            keys, inverse = np.unique(codes & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            sums = np.bincount(inverse, counts)
            self.grams.append((keys, sums))
            owners, first = np.unique(keys >> np.uint32(8), return_index=True)
            self.contexts.append([owners, np.add.reduceat(sums, first), np.diff(np.append(first, len(keys))), None, None])
        for k in range(ORDER):  # what a longer context excludes below it
            keys, _ = self.grams[k + 1]
            shorter, sums = self.grams[k]
            seen_below = sums[np.searchsorted(shorter, keys & np.uint32((1 << 8 * (k + 1)) - 1))]
            first = np.unique(keys >> np.uint32(8), return_index=True)[1]
            self.contexts[k + 1][3] = np.add.reduceat(seen_below, first)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Exact code length of each gram's last byte."""
        bits = np.zeros(len(codes))
        left = np.arange(len(codes))
        excluded_sum, excluded = np.zeros(len(codes)), np.zeros(len(codes))
        for k in range(ORDER, -1, -1):
            gram = codes[left] & np.uint32((1 << 8 * (k + 1)) - 1)
            owners, total, distinct, below, _ = self.contexts[k]
            context = gram >> np.uint32(8)
            at = np.minimum(np.searchsorted(owners, context), len(owners) - 1)
            known = owners[at] == context
            n, d = np.where(known, total[at] - excluded_sum, 0.0), np.where(known, distinct[at] - excluded, 0.0)
            keys, sums = self.grams[k]
            where = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            hit = keys[where] == gram
            alive = known & (n + d > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                bits[left[hit]] += np.log2(n + d)[hit] - np.log2(sums[where[hit]])
                escape = alive & ~hit
                bits[left[escape]] += np.log2((n + d)[escape]) - np.log2(d[escape])
            miss = ~hit
            excluded = np.where(known, distinct[at], 0.0)[miss]
            excluded_sum = np.where(known, below[at] if below is not None else 0.0, 0.0)[miss]
            left = left[miss]
        bits[left] += np.log2(np.maximum(256 - len(self.grams[0][0]), 1))
        return bits


class Slots:
    """Open-addressing table from codes to rows."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint32(max(8, 30 - max(1, int(len(keys)) * 4).bit_length()))
        self.mask = (1 << (32 - int(self.shift))) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        step = 0
        while len(left):
            at = self._at(keys[left], step)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            step += 1

    def _at(self, codes: np.ndarray, step: int) -> np.ndarray:
        return ((codes * np.uint32(2654435769) >> self.shift) + np.uint32(step)) & np.uint32(self.mask)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The row of each code, -1 where unknown."""
        out = self.slots[self._at(codes, 0)]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != codes))
        step = 1
        while len(left):
            got = self.slots[self._at(codes[left], step)]
            out[left] = got
            left = left[(got >= 0) & (self.keys[got] != codes[left])]
            step += 1
        return out


class Model:
    """The trees of all languages, with the code lengths of all known grams worked out."""

    def __init__(self, languages: list[str], language: np.ndarray, codes: np.ndarray, counts: np.ndarray):
        self.languages = languages
        self.trees = [Tree(codes[language == i], counts[language == i]) for i in range(len(languages))]
        known = np.unique(codes)
        self.slots, self.costs = Slots(known), self._bits(known)

    def _bits(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(codes) for t in self.trees], axis=1).astype(np.float32)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language; texts of any length, added up piece by piece."""
        total = np.zeros((len(texts), len(self.languages)))
        codes, begin = grams(texts)
        owner_ends = np.append(begin[1:], len(codes))
        size = max(1, AT_ONCE // len(self.languages))
        for at in range(0, len(codes), size):
            part = codes[at : at + size]
            rows = self.slots.rows(part)
            costs = self.costs[rows]
            unknown = np.flatnonzero(rows < 0)
            if len(unknown):
                new, inverse = np.unique(part[unknown], return_inverse=True)
                costs[unknown] = self._bits(new)[inverse]
            first, last = np.searchsorted(owner_ends, at, "right"), np.searchsorted(begin, at + len(part))
            inside = np.arange(first, last)
            inside = inside[owner_ends[inside] > begin[inside]]
            total[inside] += np.add.reduceat(costs, np.maximum(begin[inside] - at, 0), axis=0, dtype=np.float64)
        return total


def _sampled_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_rows(batches):
        for lang, text in zip(part.column("lang").to_pylist(), texts):
            codes, counts = np.unique(grams([text])[0], return_counts=True)
            yield pa.record_batch({"lang": pa.array([lang] * len(codes), pa.string()), "code": codes.astype(np.int64), "n": counts.astype(np.int64)})


def remainder(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return docs.where("lang is not null and doc_id is not null").where(remainder() != 2)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, sample_span: int = SAMPLE_SPAN) -> Model | None:
    rows = learnable(docs)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, 4 * sample_docs / n)) for k, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text"))
    drawn = rows.join(F.broadcast(shares), "lang").withColumn("draw", draw).where("draw < share")
    spare = F.greatest(F.length("text") - sample_span, F.lit(0))
    begin = F.pmod(F.xxhash64(F.lit(1), "doc_id"), (spare + 1).cast("bigint")).cast("int")
    drawn = drawn.withColumn("text", F.substring(F.col("text"), begin + 1, F.lit(sample_span)))
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumn("rank", F.row_number().over(order)).withColumn("before", before)
    sample = drawn.where((F.col("rank") <= sample_docs) & (F.col("before") < sample_bytes)).select("lang", "text")
    counted = sample.mapInArrow(_sampled_grams, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # bounded by the bytes of the sample
    if found.empty:
        return None
    languages = sorted(found["lang"].unique())
    return Model(
        languages,
        found["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(),
        found["code"].to_numpy().astype(np.uint32),
        found["n"].to_numpy().astype(np.float64),
    )


def _scored(shared, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, texts in text_rows(batches, AT_ONCE // 2):
            bits = model.code_lengths(texts)
            best = bits.argmin(axis=1)
            odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            letters = [any(map(str.isalpha, t.decode(errors="replace"))) for t in texts]
            names = [model.languages[b] if ok else "und" for b, ok in zip(best, letters)]
            columns = {n: part.column(n) for n in part.schema.names if keep or n != "text"}
            yield pa.record_batch(columns | {"lang_pred": names, "score": np.where(letters, 1 / odds, 0.0)})

    return run


def predict_languages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, keep: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    With ``keep`` all columns of ``docs`` stay and lang_pred and score are added.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    model = fit(rows, sample_docs, sample_bytes)
    if keep:
        rows = docs.select(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ("lang_pred", "score")))
    else:
        rows = rows.select("doc_id", "text", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"))
    if model is None:
        return rows.select(*(c for c in rows.columns if keep or c != "text"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kept = [f for f in rows.schema.fields if keep or f.name != "text"]
    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(_scored(spark.sparkContext.broadcast(model), keep), schema)
