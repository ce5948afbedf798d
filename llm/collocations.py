"""Frequent phrases of two to four words, and how firmly their words belong together.

Method: Apriori, level by level.  A phrase of k words can only be frequent if
both phrases of k - 1 words in it are, so words are counted first, then pairs of frequent
words, then triples of frequent pairs, then runs of four words.  What is left are
the candidates.  They go into a double-array trie that is broadcast.  Numpy moves
the states of all word starts of a shard of text forward together, level by
level; the accepting states are counted with bincount, and the counts of all
shards are added up.  Only these counts are used for the result, and the trie
compares bytes, so they are exact.

The search for candidates works on 64-bit hashes.  What was frequent on a level is
told to the next by a bitmap, two bits a key: shared bits let too much
pass, never too little, and the exact count sorts it out.  Only where a task spells out
the candidates it has seen, two phrases with one hash would be taken for one
(some 1 in 10^8 for a million phrases).  Each task adds up what
it has counted before it hands it on.

Size: a broadcast trie takes ``TRIE_BYTES`` of phrases at most.  More candidates make
more tries, and the texts are still read once: the scan deals each word start to the trie of
the phrases with its first two words, as the longest run from there that may be
frequent, and adds up equal ones; each trie is built and walked in a task where its starts come
together.  The work follows the texts and the candidates, not their product.
A long text is cut between words; the three words after a cut are read on both
sides and counted on one.

Defined results: a null text is empty, a null lang is ``und``.  Texts without
words add nothing; repeated rows count each time; ids are not looked at.
An empty table gives no rows.  Equal scores go by frequency, then by the
phrase's bytes.  Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.functions.ordering import global_rank
from llm.common import is_small, small_batches, stage, text_rows
from llm.double_array import DoubleArray
from llm.hashing import mix, slice_hashes
from llm.sieve import HELD, as_array, key_counts, passes, sieve

LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
BITS = 26
#: Bytes of text from which a bitmap has twice, and at most four times, the bits.
MORE_BITS = 8 << 30
TRIE_BYTES = 24 << 20
#: Bytes of phrases in a trie that a task builds for itself.
DEALT_BYTES = 4 << 20
#: Different runs that a task holds before it hands them on.
HELD_RUNS = 1_000_000
#: Bytes of text worked on at once.
SHARD = 1 << 20
#: A task reads a good deal of text, so that most of what recurs is added up before it is handed on: all of
#: it in this many tasks a core, or more tasks where one would get more than TASK_BYTES.
TASKS_PER_CORE, TASK_BYTES = 3, 2 << 30

_SPACE, _BREAK = 0x20, 0x0A
#: A-Z made small, tabs made blanks, and everything that ends a piece a line feed.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9] = _SPACE
_PLAIN[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_BOUNDARY = np.zeros(256, bool)
_BOUNDARY[[_SPACE, _BREAK]] = True
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def plain(text: bytes) -> np.ndarray:
    """The text as bytes with one blank between words of a piece and no blank at a piece's start."""
    codes = _PLAIN[np.frombuffer(text, np.uint8)]
    blank = codes == _SPACE
    drop = np.zeros(len(codes), bool)
    drop[1:] = blank[1:] & _BOUNDARY[codes[:-1]]
    drop[:1] = blank[:1]
    return codes[~drop]


def _passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a sieve made by :func:`_frequent`: both of a key's bits are set."""
    found = passes(table, hashes)
    found[found] = passes(table, hashes[found] >> np.uint64(32))
    return found


class Shard:
    """Some texts, or a part of a long one: bytes, word starts and ends, and what each word belongs to."""

    def __init__(self, parts: list[tuple[np.ndarray, int, int]]):
        """``parts``: codes, how many of them are owned, and the number of the language."""
        glue = np.array([_BREAK], np.uint8)
        self.codes = np.concatenate([x for codes, _, _ in parts for x in (codes, glue)])
        edge = np.diff(np.concatenate([[True], _BOUNDARY[self.codes]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        begin = np.cumsum([0] + [len(codes) + 1 for codes, _, _ in parts])
        part = np.searchsorted(begin, self.starts, "right") - 1
        self.owned = self.starts - begin[part] < np.array([owned for _, owned, _ in parts])[part]
        self.language = np.array([language for _, _, language in parts])[part]
        # word i and the next are in one piece if nothing but a blank is between them
        self.follows = np.zeros(len(self.starts), bool)
        self.follows[:-1] = (self.codes[self.ends[:-1]] == _SPACE) & (self.starts[1:] == self.ends[:-1] + 1)

    def levels(self, most: int, sieves: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``most`` words: hashes of the runs of which both shorter ones pass, and the word each begins with."""
        words = mix(slice_hashes(self.codes, self.starts, self.ends) + mix(self.language.astype(np.uint64) + np.uint64(1)))
        hashes, at = words, np.arange(len(words))
        yield hashes, at
        for n in range(1, most):
            good = np.zeros(len(words) + 1, bool)
            good[at] = _passes(sieves[n - 1], hashes)
            last = at + n - 1
            keep = good[at] & good[at + 1] & self.follows[last]
            hashes, at = mix(hashes[keep] * _FACTORS[n] + words[last[keep] + 1]), at[keep]
            yield hashes, at


def _cuts(codes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in parts that end before a word, each with the next three words for what begins before its end."""
    at = 0
    while len(codes) - at > SHARD:
        gaps = np.flatnonzero(_BOUNDARY[codes[at + SHARD // 2 : at + SHARD]])
        stop = at + SHARD // 2 + int(gaps[-1]) + 1 if len(gaps) else at + SHARD
        while stop < len(codes) and not _BOUNDARY[codes[stop - 1]]:  # a word longer than that
            more = np.flatnonzero(_BOUNDARY[codes[stop : stop + SHARD]])
            stop = min(len(codes), stop + (int(more[0]) + 1 if len(more) else SHARD))
        reach, words = stop, 0
        while reach < len(codes) and words < LONGEST - 1:
            more = np.flatnonzero(_BOUNDARY[codes[reach : reach + SHARD]])[: LONGEST - 1 - words]
            words += len(more)
            reach += int(more[-1]) + 1 if len(more) else SHARD
        yield codes[at : min(reach, len(codes))], stop - at
        at = stop
    yield codes[at:], len(codes) - at


def shards(batches: Iterator[pa.RecordBatch], languages: dict[str, int]) -> Iterator[Shard]:
    parts, size = [], 0
    for batch, texts in text_rows(batches, SHARD):
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            for codes, owned in _cuts(plain(text)):
                if size + len(codes) > SHARD and parts:
                    yield Shard(parts)
                    parts, size = [], 0
                parts.append((codes, owned, languages.setdefault(lang, len(languages))))
                size += len(codes)
    if parts:
        yield Shard(parts)


def _runs(k: int, shared: list, names: list[str]):
    """Hashes of the runs of ``k`` words that may be frequent."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        sieves = [s.value for s in shared]
        for shard in shards(batches, {name: i for i, name in enumerate(names)}):
            *_, (hashes, at) = shard.levels(k, sieves)
            yield hashes[shard.owned[at]]

    return keys


def _spelled(shared: list, names: list[str]):
    """Distinct words and runs of words that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = [s.value for s in shared]
        languages = {name: i for i, name in enumerate(names)}
        seen = np.empty(0, np.uint64)
        for shard in shards(batches, languages):
            data = shard.codes.tobytes()
            langs, phrases, new = [], [], []
            for k, (hashes, at) in enumerate(shard.levels(LONGEST, sieves), 1):
                passing = _passes(sieves[k - 1], hashes)
                hashes, at = hashes[passing], at[passing]
                hashes, first = np.unique(hashes, return_index=True)
                fresh = seen[np.minimum(np.searchsorted(seen, hashes), max(0, len(seen) - 1))] != hashes if len(seen) else np.ones(len(hashes), bool)
                at = at[first[fresh]]
                new.append(hashes[fresh])
                langs += [names[i] for i in shard.language[at]]
                phrases += [data[s:e] for s, e in zip(shard.starts[at].tolist(), shard.ends[at + k - 1].tolist())]
            seen = np.concatenate([seen, *new]) if len(seen) < HELD else np.concatenate(new)
            seen.sort()
            yield pa.record_batch({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string())})

    return run


def _found(shared, names: list[str], roots: list[int]):
    """How often each phrase of the trie occurs, and the words of each language, below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (trie, number), root = shared.value, np.array(roots, np.int32)
        languages = {name: i for i, name in enumerate(names)}
        counts, words = np.zeros(len(number), np.int64), np.zeros(len(names), np.int64)
        for shard in shards(batches, languages):
            starts, language = shard.starts[shard.owned], shard.language[shard.owned]
            words += np.bincount(language, minlength=len(names))
            known = root[language] >= 0
            counts += np.bincount(trie.matches(shard.codes, starts[known], root[language[known]], _BOUNDARY), minlength=len(counts))
        numbers = np.flatnonzero(counts)
        below = np.flatnonzero(words)
        yield pa.record_batch({"number": np.concatenate([-1 - below, number[numbers]]), "n": np.concatenate([words[below], counts[numbers]])})

    return run


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after another, and the length of each."""
    values = pa.concat_arrays([*column.cast(pa.binary()).chunks, pa.array([], pa.binary())])  # one array that starts at its first byte
    lengths = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[: int(lengths.sum())], lengths


def _trie(part: pa.Table) -> DoubleArray:
    """The trie of the sorted ``key`` column, straight from its buffers."""
    return DoubleArray(*_bytes(part["key"]))


def _slices(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes from each ``begin`` to its ``end``."""
    lengths = end - begin
    offsets = np.append(0, np.cumsum(lengths))
    places = np.repeat(begin - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(codes[places])])


def _added(tables: list[pa.Table]) -> pa.Table:
    """(language, run, n) with equal runs added up."""
    out = pa.concat_tables(tables).group_by(["language", "run"], use_threads=False).aggregate([("n", "sum")])
    return out.rename_columns([{"n_sum": "n"}.get(c, c) for c in out.column_names]).select(["language", "run", "n"])


def _dealt(shared: list, names: list[str]):
    """How often each run of words is the longest that may be frequent from where it begins, and each word begins one; the words of each language under null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves, words = [s.value for s in shared], np.zeros(len(names), np.int64)
        held: list[pa.Table] = []
        called = pa.array(names, pa.string())

        def handed_on(table: pa.Table) -> Iterator[pa.RecordBatch]:
            whole = pa.table({"lang": called.take(table["language"]), "phrase": table["run"].cast(pa.string()), "n": table["n"]})
            yield from whole.to_batches(max_chunksize=100_000)

        for shard in shards(batches, {name: i for i, name in enumerate(names)}):
            longest = np.zeros(len(shard.starts), np.int64)
            for k, (hashes, at) in enumerate(shard.levels(LONGEST, sieves), 1):
                longest[at[_passes(sieves[k - 1], hashes)]] = k
            words += np.bincount(shard.language[shard.owned], minlength=len(names))
            longest[~shard.owned] = 0
            one, more = np.flatnonzero(longest), np.flatnonzero(longest > 1)
            first, last = np.concatenate([one, more]), np.concatenate([one, more + longest[more] - 1])
            begun = pa.table({"language": shard.language[first].astype(np.int32), "run": _slices(shard.codes, shard.starts[first], shard.ends[last]), "n": np.ones(len(first), np.int64)})
            held.append(_added([begun]))
            if sum(map(len, held)) > 2 * HELD_RUNS:
                held = [_added(held)]
                if len(held[0]) > HELD_RUNS:
                    yield from handed_on(held.pop())
        if held:
            yield from handed_on(_added(held))
        spoken = np.flatnonzero(words)
        yield pa.record_batch({"lang": called.take(pa.array(spoken)), "phrase": pa.nulls(len(spoken), pa.string()), "n": words[spoken]})

    return run


def _walked(names: list[str], least: int):
    """The frequent ones of some candidates, counted by their trie over the runs that were dealt to it."""
    place = {name: i for i, name in enumerate(names)}

    def numbers(table: pa.Table) -> np.ndarray:
        return np.array([place[x] for x in table["lang"].to_pylist()], np.int64)

    def alone(table: pa.Table) -> np.ndarray:
        return pc.invert(pc.match_substring(table["phrase"], " ")).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(candidates: pa.Table, runs: pa.Table) -> pa.Table:
        # a word counts where it is dealt by itself, a longer phrase where runs of several words are: the two have roots of their own
        kinds = [f"{i} {single}\n" for i in range(len(names)) for single in (0, 1)]
        kind = pa.array(kinds, pa.string()).take(pa.array(2 * numbers(candidates) + alone(candidates)))
        keyed = candidates.append_column("key", pc.binary_join_element_wise(kind, candidates["phrase"].cast(pa.string()), "").cast(pa.binary())).sort_by("key")
        trie = _trie(keyed)
        roots = np.array([trie.find(x.encode()) for x in kinds], np.int32)
        root = roots[2 * numbers(runs) + alone(runs)]
        data, lengths = _bytes(runs["phrase"])
        codes = np.full(len(data) + len(lengths), _BREAK, np.uint8)
        codes[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = data
        starts = np.cumsum(lengths + 1) - lengths - 1
        known = root >= 0
        found, often = trie.matches(codes, starts[known], root[known], _BOUNDARY, runs["n"].to_numpy()[known])
        counts = np.bincount(found, often, minlength=len(keyed)).astype(np.int64)  # exact up to 2^53
        frequent = np.flatnonzero(counts >= least)
        return keyed.select(["lang", "phrase"]).take(pa.array(frequent)).append_column("f", pa.array(counts[frequent]))

    return run


def _frequent(rows: DataFrame, k: int, sieves: list, names: list[str], least: int, bits: int = BITS) -> np.ndarray:
    keys = key_counts(rows, _runs(k, sieves, names)).where(F.col("n") >= least)
    return as_array(sieve(keys.select(F.explode(F.array("key", F.shiftrightunsigned("key", 32))).alias("key")), bits), bits)


def phrase_counts(docs: DataFrame, least: int = LEAST, trie_bytes: int = TRIE_BYTES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of up to four words with f >= ``least``, (lang, words) of each language).

    Words of a phrase are joined by blanks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    context = spark.sparkContext
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["bytes"] or 0 for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    names, whole = sorted(sizes), sum(sizes.values())  # languages, bytes of text
    rows = rows.coalesce(int(max(TASKS_PER_CORE * context.defaultParallelism, whole // TASK_BYTES)))
    sieves: list = []
    for k in range(1, LONGEST + 1):
        sieves.append(context.broadcast(_frequent(rows, k, sieves, names, least, BITS + min(2, (whole // MORE_BITS).bit_length()))))
    candidates = stage(rows.mapInArrow(_spelled(sieves, names), "lang string, phrase string").distinct(), "candidates")
    size = candidates.agg(F.sum(F.octet_length("phrase") + F.octet_length("lang") + 1)).first()[0] or 0
    if size < trie_bytes:
        return _in_one_trie(rows, candidates, names, least)
    return _in_many_tries(rows, candidates, sieves, names, least, 1 + size // min(trie_bytes, DEALT_BYTES))


def _in_one_trie(rows: DataFrame, candidates: DataFrame, names: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """The result of :func:`phrase_counts` with a trie that every task gets."""
    spark = rows.sparkSession
    position = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(str(i)))]) if names else F.lit(None).cast("map<string,string>")
    keyed = candidates.withColumn("key", F.concat(position[F.col("lang")], F.lit("\n"), F.col("phrase")).cast("binary"))
    numbered = stage(global_rank(keyed, [F.col("key")], "number"), "numbered")
    part = numbered.select("number", "key").toArrow().sort_by("number")
    trie, number = _trie(part), part["number"].to_numpy()
    del part
    roots = [trie.find(f"{x}\n".encode()) for x in range(len(names))]
    shared = spark.sparkContext.broadcast((trie, number))
    del trie, number
    found = rows.mapInArrow(_found(shared, names, roots), "number bigint, n bigint")
    found = stage(found.groupBy("number").agg(F.sum("n").alias("f")), "counts")
    shared.unpersist()
    lengths = found.where("number < 0").select((-1 - F.col("number")).alias("number"), F.col("f").alias("words"))
    languages = spark.createDataFrame(list(enumerate(names)), "number bigint, lang string")
    words = languages.join(F.broadcast(lengths), "number").select("lang", "words")
    counted = numbered.join(found.where(F.col("f") >= least), "number").select("lang", "phrase", "f")
    return stage(counted, "phrases"), words


def _in_many_tries(rows: DataFrame, candidates: DataFrame, sieves: list, names: list[str], least: int, tries: int) -> tuple[DataFrame, DataFrame]:
    """The result of :func:`phrase_counts` with tries that hold the phrases of the same first two words each."""
    runs = rows.mapInArrow(_dealt(sieves, names), "lang string, phrase string, n bigint")
    runs = stage(runs.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "runs")
    own = F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 2)), F.lit(tries)).alias("trie")
    theirs = candidates.select("lang", "phrase", own).groupBy("trie")
    dealt = runs.where(F.col("phrase").isNotNull()).select("lang", "phrase", "n", own).groupBy("trie")
    counted = theirs.cogroup(dealt).applyInArrow(_walked(names, least), "lang string, phrase string, f bigint")
    return stage(counted, "phrases"), runs.where(F.col("phrase").isNull()).select("lang", F.col("n").alias("words"))


def _run(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("w", first, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to four words.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts where it is cut with the
    lowest score, floor(2000000 * a / (l + r)); a phrase that lies in a longer
    one which makes up ``covered`` percent of it or more is left out.
    """
    counts, words = phrase_counts(docs, least, trie_bytes)
    phrases = counts.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w"))
    longer = phrases.where("k >= 2")

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if is_small(df) else df

    parts = counts.select("lang", "phrase", "f")
    cut = longer.select("lang", "phrase", "f", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "w", "k")
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "cut", _run(F.lit(1), F.col("cut")).alias("left"), _run(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cut = cut.join(sized(left), ["lang", "left"]).join(sized(right), ["lang", "right"])
    cut = cut.withColumn("score", F.expr("(2000000 * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("best")).select("lang", "phrase", "best.*")
    inside = longer.where("k >= 3").select("lang", "f", "w", "k", F.explode(F.expr("sequence(2, k - 1)")).alias("n"))
    inside = inside.select("lang", "f", "w", "n", F.explode(F.expr("sequence(1, k - n + 1)")).alias("at"))
    inside = inside.select("lang", "f", _run(F.col("at"), F.col("n")).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    mostly = F.lit(100).cast("decimal(19,0)") * F.col("most").cast("decimal(19,0)") >= F.lit(covered).cast("decimal(19,0)") * F.col("a").cast("decimal(19,0)")
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.isnull("most") | ~mostly)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(words), "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), F.col("score").cast("bigint").alias("score")
    )
