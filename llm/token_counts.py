"""Token counts that follow edits without encoding the whole text again.

Method: a text is parted where the tokenizer's own split always parts it, before
a space with a character after it that is no white space.  A segment tree over the parts holds, for
every subtree, its characters and its tokens.  An edit finds its parts by
their places; the touched parts and one on either side, whose
borders an edit can't move, are encoded again, and the sums above them are
updated.  All edits of a document that share parts are applied at once.

The tokenizer is byte-level BPE from a rank file.  A null text has no tokens
and takes no edits.  Edits are (start, end, put) in code points of the original
text; they must not overlap, and one that starts before the end of another is
left out.  Rows with equal ids and texts share their edits.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import small_batches, text_rows
from llm.sanitisation import base_matches

#: Parts whose counts a Python worker remembers.
REMEMBERED = 1_000_000


def parts(text: str) -> list[str]:
    """The text cut before every space that a character other than white space follows."""
    pieces = text.split(" ")
    out = [pieces[0]]
    for p in pieces[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


class Counter:
    """Tokens of parts, remembered."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def __call__(self, pieces: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, encode = self.known, self.encoding.encode_ordinary
        for p in pieces:
            if p not in known:
                known[p] = len(encode(p))
        return [known[p] for p in pieces]


class TokenTree:
    """Segment tree over the parts of one text."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        pieces = parts(text)
        self.n = len(pieces)
        size = 1 << max(self.n - 1, 0).bit_length()
        self.size = size
        self.chars, self.tokens = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64)
        self.chars[size : size + self.n] = [len(p) for p in pieces]
        self.tokens[size : size + self.n] = counter(pieces)
        level = size
        while level > 1:
            half = level // 2
            for sums in (self.chars, self.tokens):
                sums[half:level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level = half
        self.begin = np.concatenate([[0], np.cumsum(self.chars[size : size + self.n])])
        self.encoded = 0

    def total(self) -> int:
        return int(self.tokens[1])

    def _leaf(self, place: int) -> int:
        """The part of the original text that holds a character."""
        return min(int(np.searchsorted(self.begin, place, "right")) - 1, self.n - 1)

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.size
        d_chars, d_tokens = chars - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += d_chars
            self.tokens[i] += d_tokens
            i //= 2

    def apply(self, edits: list[tuple[int, int, str]]) -> str:
        """Applies edits of the original text, updates the sums, and returns the text after them."""
        regions: list[tuple[int, int, list]] = []
        end_before = 0
        for start, end, put in sorted(edits):
            start, end = min(start, len(self.text)), min(end, len(self.text))
            if start < end_before or end < start:
                continue
            end_before = end
            first, last = max(self._leaf(start) - 1, 0), min(self._leaf(max(end - 1, start)) + 1, self.n - 1)
            if regions and first <= regions[-1][1]:
                regions[-1] = (regions[-1][0], max(last, regions[-1][1]), [*regions[-1][2], (start, end, put)])
            else:
                regions.append((first, last, [(start, end, put)]))
        out, done = [], 0
        for first, last, own in regions:
            at, stop, fresh = int(self.begin[first]), int(self.begin[last + 1]), []
            out.append(self.text[done:at])
            for start, end, put in own:
                fresh += [self.text[at:start], put]
                at = end
            text = "".join([*fresh, self.text[at:stop]])
            out.append(text)
            done = stop
            pieces = parts(text)
            self.encoded += len(pieces)
            self._set(first, len(text), sum(self.counter(pieces)))
            for leaf in range(first + 1, last + 1):
                self._set(leaf, 0, 0)
        return "".join([*out, self.text[done:]])


_WORKER: dict[str, Counter] = {}


def _counter(path: str, pattern: str) -> Counter:
    if path not in _WORKER:
        _WORKER[path] = Counter(path, pattern)
    return _WORKER[path]


def _listed(edits: list[dict] | None) -> list[tuple[int, int, str]]:
    return [(e["start"], e["end"], e["put"] or "") for e in edits or [] if e["start"] is not None and e["end"] is not None]


def _placed(put: dict[str, str]):
    """Edits that put a text by its kind in the place of each valid match."""

    def run(found: list[dict] | None) -> list[tuple[int, int, str]]:
        out = []
        for f in found or []:
            lengths = np.array([m["length"] for m in f["matches"]], np.int64)
            ends = np.cumsum(np.array(f["gaps"][: len(lengths)], np.int64) + lengths)
            spans = zip((ends - lengths).tolist(), ends.tolist(), f["matches"])
            out += [(start, end, put[f["kind"]]) for start, end, m in spans if m["valid"]]
        return out

    return run


def _counted(path: str, pattern: str, edits_of):
    """Rows (doc_id, text, edits) before and after the edits, which ``edits_of`` reads from the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern)
        for batch, texts in text_rows(batches, 4 << 20):
            before, edits_n, after, again = [], [], [], []
            for text, listed in zip(texts, batch.column("edits").to_pylist()):
                edits = edits_of(listed)
                if not edits:  # no tree is needed to know the sum
                    before.append(sum(counter(parts(text.decode()))))
                    after.append(before[-1])
                    again.append(0)
                else:
                    tree = TokenTree(text.decode(), counter)
                    before.append(tree.total())
                    tree.apply(edits)
                    after.append(tree.total())
                    again.append(tree.encoded)
                edits_n.append(len(edits))
            columns = {"n_tokens": before, "n_edits": edits_n, "n_tokens_after": after, "n_parts_encoded": again}
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.int64()) for k, v in columns.items()})

    return run


_COUNTS = "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_after bigint, n_parts_encoded bigint"


def edited_token_counts(docs: DataFrame, edits: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, n_edits, n_tokens_after, n_parts_encoded.

    ``edits`` are (doc_id, key, start, end, put), the key being xxhash64 of the text.
    They may come from anywhere, so texts meet them by a join.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    listed = edits.groupBy(F.col("doc_id").alias("e_id"), F.col("key").alias("e_key")).agg(F.collect_list(F.struct("start", "end", "put")).alias("edits"))
    joined = rows.join(listed, (F.col("key") == F.col("e_key")) & F.col("doc_id").eqNullSafe(F.col("e_id")), "left")
    return joined.select("doc_id", "text", "edits").mapInArrow(_counted(rank_file, pattern, _listed), _COUNTS)


def replaced_token_counts(docs: DataFrame, put: dict[str, str], rank_file: str, pattern: str) -> DataFrame:
    """Like ``edited_token_counts``, the edits putting ``put[kind]`` in the place of each piece of personal data.

    Edits are found in the row they belong to: nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("t"))
    rows = rows.select("doc_id", F.col("t").alias("text"), base_matches().alias("edits"))
    return rows.mapInArrow(_counted(rank_file, pattern, _placed(put)), _COUNTS)
