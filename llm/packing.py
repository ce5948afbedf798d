"""Best-fit decreasing packing of tokenised documents into sequences of fixed length.

Method: pieces are placed from the longest to the shortest, each into the open
sequence with the least room that still holds it; a segment tree over the
remaining capacities finds that room.  Pieces of one length are
interchangeable and so are sequences with the same room, so the packing is
worked out on the histogram of piece lengths: the driver holds one count per
length, at most ``capacity`` of them whatever the size of the corpus, and
places whole runs of equal pieces at a time.  The outcome, a table of runs, says which
ranks of which length go where; every piece finds its sequence and offset by
its rank among the pieces of its length.  It is the packing that best-fit
decreasing makes piece by piece over the whole corpus, not one per shard.

A null or empty text has only its end token.  Repeated rows are packed as
often as they occur.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import small_batches, stage, text_rows

CAPACITY = 2048
END = b"\0\0\0\0"
#: Words whose ids a Python worker remembers.
REMEMBERED = 1_000_000


class Rooms:
    """Segment tree over remaining capacities 0..capacity that tells the least one of at least x with open sequences."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, room: int, count: int) -> None:
        i = room + self.leaves
        while i:
            self.open[i] += count
            i //= 2

    def tightest(self, x: int) -> int | None:
        i = x + self.leaves
        if self.open[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces in each, offset) of best-fit decreasing.

    Pieces ``first rank`` onwards of that length fill sequences ``first
    sequence`` onwards, so many in each one after the other from the offset.
    """
    rooms, ranges, runs, made = Rooms(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = rooms.tightest(length)
            if room is None:  # no open sequence holds it: open new ones, which then are the tightest
                each = capacity // length
                new = -(-left // each)
                ranges.setdefault(capacity, []).append((made, new))
                rooms.add(capacity, new)
                made += new
                continue
            each = room // length
            first, count = ranges[room].pop()
            used = min(count, -(-left // each))
            whole = min(left // each, used)
            for sequences, pieces in ((whole, each), (used - whole, left - whole * each)):
                if not sequences:
                    continue
                runs.append((length, rank, sequences * pieces, first, pieces, capacity - room))
                after = room - pieces * length
                ranges.setdefault(after, []).append((first, sequences))
                rooms.add(after, sequences)
                rooms.add(room, -sequences)
                rank += sequences * pieces
                left -= sequences * pieces
                first += sequences
                count -= sequences
            if count:
                ranges[room].append((first, count))
    return runs


#: The tokenizer's own split into words, on text in lower case; bytes from 0x80 count as letters until looked at.
_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")


class WordIds:
    """Token ids of texts as little-endian bytes.

    The tokenizer splits a text into words first and encodes each for itself,
    so a word is encoded once and remembered.  A text with a character beyond
    ASCII that is no plain letter, or with an added token such as
    ``<|endoftext|>`` in it, goes through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # whether it stands in a text is asked in small letters, since some tokens are looked for in normalised text
        added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True
        self.known: dict[bytes, bytes | None] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        plain = []
        for w in words:
            if w.isascii():
                plain.append((w, w.decode()))
            else:
                text = w.decode(errors="replace")
                if text.isalpha() and text.lower().isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text):
                    plain.append((w, text))
                else:
                    self.known[w] = None
        letters = [(w, t) for w, t in plain if t.isalpha()]
        for i in range(0, len(letters), 500):  # many words in one text: the ids that end words part them
            part = letters[i : i + 500]
            ids = self._encode([" ".join(t for _, t in part)])[0]
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                data, at = ids.tobytes(), 0
                for (w, _), end in zip(part, cut.tolist()):
                    self.known[w] = data[at : 4 * end]
                    at = 4 * end
            else:
                plain.extend(part)
        others = [(w, t) for w, t in plain if w not in self.known]
        self.known.update((w, e.tobytes()) for (w, _), e in zip(others, self._encode([t for _, t in others])))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        lowered = [t.lower() for t in texts]
        # None: the whole text goes through the tokenizer, which cuts added tokens out first
        split = [None if self.added and self.added.search(t) else _WORDS.findall(t) for t in lowered]
        if len(self.known) > REMEMBERED:
            self.known = {}
        self._learn([w for w in {w for words in split if words is not None for w in words} if w not in self.known])
        out = []
        for text, words in zip(texts, split):
            ids = [None] if words is None else list(map(self.known.__getitem__, words))
            out.append(self._encode([text.decode()])[0].tobytes() if None in ids else b"".join(ids))
        return out


_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each Python worker, so that tasks that follow find words already known."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        for part, texts in text_rows(batches, 4 << 20):
            doc, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(ids_of(texts)):
                ids += END
                n = len(ids) // 4
                for j, at in enumerate(range(0, n, capacity)):
                    doc.append(k)
                    piece.append(j)
                    start.append(at)
                    length.append(min(capacity, n - at))
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + capacity)]))
            yield pa.record_batch(
                {
                    "doc_id": pc.take(part.column("doc_id"), pa.array(doc, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )

    return run


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(_pieces(tokenizer_path, capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    # written once: a piece's place among its part's pieces of one length must not change between reads
    at = F.monotonically_increasing_id()
    pieces = stage(pieces.select("*", F.shiftright(at, 33).alias("part"), at.alias("at")), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = stage(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(
        best_fit_runs(histogram, capacity), "length bigint, rank bigint, pieces bigint, first bigint, each bigint, from bigint"
    )
    before = F.sum("n").over(_by("length", "part")) - F.col("n")
    starts = counts.select("length", "part", before.alias("before"))
    ranked = pieces.select("*", (F.row_number().over(_by(["length", "part"], "at")) - 1).alias("own")).join(starts, ["length", "part"])
    ranked = ranked.withColumn("r", F.col("before") + F.col("own")).drop("part", "at", "own", "before")
    # at most a few runs for each length, and no more lengths than the capacity
    placed = ranked.join(F.broadcast(runs), "length").where("r >= rank AND r < rank + pieces")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("first + (r - rank) div each").alias("sequence_id"),
        F.expr("`from` + (r - rank) % each * length").alias("offset"),
    )


def _by(keys, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)
