"""Collocations, lexical search and exact duplicates against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import collocations, exact_dedup, lexical_search, queries, sieve
from llm.double_array import DoubleArray

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(n, seed, size=12):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñlmnoprstu") for _ in range(rng.randint(1, 6))) for _ in range(size)]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(n))


def rows():
    texts = [prose(40 + 9 * i, i % 3) for i in range(24)] + ["", None, " \t ", "...", "One", "one two", prose(9000, 1), "x" * 5000, "a b c d " * 60, "A\x00b\x1f c d İ ß " * 9]
    out = [(i, t, ["en", "fr", None, "und"][i % 4], "s", None) for i, t in enumerate(texts)]
    return [*out, out[3], (3, texts[3].upper(), "en", "t", 1), (None, texts[4], "fr", None, None), (None, texts[4], "fr", "u", None), (None, None, None, None, None), (90, texts[5], "en", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    clash = {name: F.lit(name) for name in ("key", "size", "prefix", "survives", "digest", "part", "mask", "row", "again", "copies", "rank", "score", "n", "phrase", "item", "w", "k", "keep_id", "group_size")}
    return spark.createDataFrame(rows(), SCHEMA).withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def in_order(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- exact duplicates ------------------------------------------------------------------------
def plain_duplicates(table):
    groups = defaultdict(list)
    for doc_id, text in table:
        groups[small(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), at == 0, digest) for at, i in enumerate(ids)]
    return sorted(out, key=repr)


def test_exact_duplicates(docs, nothing):
    want = plain_duplicates([(r[0], r[1]) for r in rows()])
    assert in_order(exact_dedup.exact_duplicates(docs, all_digests=True)) == want
    found = in_order(exact_dedup.exact_duplicates(docs))
    assert [r[:4] for r in found] == [r[:4] for r in sorted(want, key=repr)]
    assert {r[4] for r in found if r[2] > 1} == {r[4] for r in want if r[2] > 1}
    empty = exact_dedup.exact_duplicates(nothing)
    assert empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and empty.count() == 0


def test_only_texts_that_survive_are_read_to_the_end(spark):
    texts = ["aa", "bbb", "x" * 80 + "1", "x" * 80 + "2", "y" * 81, "same text", "Same text"]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert {r["doc_id"] for r in found.collect() if r["text_sha256"]} == {2, 3, 5, 6}


def test_rows_without_duplicates(docs, nothing):
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns
    want = [(i, k) for i, k, _, stays, _ in plain_duplicates([(r[0], r[1]) for r in rows()]) if stays]
    assert Counter((r["doc_id"], small(r["text"])) for r in kept.collect()) == Counter(
        {(i, t): 1 for i, t in {(r[0], small(r[1])) for r in rows()} if any(i == j for j, _ in want) and (i == max((q[0] for q in rows() if small(q[1]) == t and q[0] is not None), default=None))}
    )
    assert exact_dedup.without_duplicates(nothing).count() == 0


def test_a_sieve_lets_all_members_pass(spark):
    keys = [5, -7, 1 << 62, -(1 << 63), 0, 32767, 32768]
    made = sieve.sieve(spark.createDataFrame([(k,) for k in keys], "key bigint"), 20)
    table = sieve.as_array(made, 20)
    assert sieve.passes(table, np.array(keys, np.int64).view(np.uint64)).all() and np.unpackbits(table).sum() == len({k % (1 << 20) for k in keys})
    asked = spark.createDataFrame([(k,) for k in [*keys, 17, -9]], "key bigint")
    assert [r["hit"] for r in sieve.marked(asked, F.col("key"), made, 20, "hit").orderBy("key").collect()] == [k not in (17, -9) for k in sorted([*keys, 17, -9])]


# -- lexical search --------------------------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(table, items, top):
    documents = [(i, Counter(WORD.findall(small(t)))) for i, t in table]
    documents = [(i, c, sum(c.values())) for i, c in documents if c]
    number, length = len(documents), sum(n for *_, n in documents)
    held = Counter(t for _, c, _ in documents for t in c)
    terms = defaultdict(Counter)
    for item, text in items:
        terms[item].update(WORD.findall(small(text)))
    out = []
    for item, wanted in terms.items():
        scored = []
        for i, c, n in documents:
            m = 100 - 25 + (25 * n * number) // length
            s = sum(k * math.floor(1000 * math.log((2 * number + 2) / (2 * held[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, k in wanted.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if gone else i, -s) for rank, (s, gone, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("slice_bytes", [32 << 20, 60])
def test_ranked_search(spark, docs, nothing, slice_bytes):
    items = [(1, prose(12, 0)), (2, prose(12, 1) + " b b b"), (3, None), (4, "..."), (5, "unheard"), (6, "one"), (6, "Two d"), (None, "c d"), (8, "İ ß x\x00b")]
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit(1)).withColumn("score", F.lit("s"))
    want = plain_search([(r[0], r[1]) for r in rows()], items, 5)
    assert in_order(lexical_search.ranked_search(docs, table, 5, slice_bytes)) == want
    assert lexical_search.ranked_search(nothing, table).count() == 0
    assert lexical_search.ranked_search(docs, table.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_best_of_a_task_keeps_ties(monkeypatch):
    best = lexical_search.Best(1, 3)
    for ids in ([9, 8, 7], [6, 1], [5, 4], [2, 3]):
        best.add(np.full((len(ids), 1), 40), np.array(ids), np.zeros(len(ids), bool))
        assert best.prune()[3].tolist() == sorted(set(range(1, 10)) & {9, 8, 7, 6, 1, 5, 4, 2, 3} & set([*ids, *best.rows[0][3].tolist()]))[:3]
    assert best.prune()[3].tolist() == [1, 2, 3]


def test_additions_in_parts_make_the_same_scores(monkeypatch):
    texts = [prose(50, s).encode() for s in range(6)]
    items = lexical_search.Items([[prose(20, s).encode()] for s in range(4)])
    items.documents, items.length, items.weights = 6, 300, np.arange(1, items.terms + 1)
    whole = items.scores(texts)
    monkeypatch.setattr(lexical_search, "CELLS", 3)
    assert (items.scores(texts) == whole).all() and whole.any()


# -- collocations -----------------------------------------------------------------------------
def plain_collocations(table, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in table:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", small(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        phrases = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        gone = {p[i : i + m] for p, a in phrases.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * counts[p[i : i + m]]}
        scored = []
        for p, a in phrases.items():
            if p not in gone:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("trie_bytes", [32 << 20, 700])
def test_collocations(docs, nothing, trie_bytes):
    want = plain_collocations([(r[1], r[2]) for r in rows()], 8, 150)
    assert len(want) > 150
    assert in_order(collocations.collocations(docs, 8, 150, trie_bytes=trie_bytes)) == want
    assert collocations.collocations(nothing).count() == 0


def test_more_tries_are_no_more_scans(spark, docs):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    scans, texts = [], docs.select("lang", seen.asNondeterministic()("text").alias("text"))
    for trie_bytes in (32 << 20, 700):
        before = read.value
        phrases, words = collocations.phrase_counts(texts, 8, trie_bytes)
        found = sorted(tuple(r) for r in phrases.collect()), sorted(tuple(r) for r in words.collect())
        scans.append((read.value - before, found))
    assert scans[0] == scans[1] and scans[0][1][0]


def test_what_a_task_holds_bounds_no_counts(docs, monkeypatch):
    want = in_order(collocations.phrase_counts(docs, 8, 700)[0])
    sieves = [np.full(1 << 17, 255, np.uint8)] * collocations.LONGEST  # everything may be frequent
    shared = [type("Shared", (), {"value": s}) for s in sieves]
    batches = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").toArrow().to_batches()
    names = ["en", "fr", "und"]
    for held in (1, 1 << 30):
        monkeypatch.setattr(collocations, "HELD_RUNS", held)
        monkeypatch.setattr(collocations, "SHARD", 2048)
        counts = Counter()
        for batch in collocations._dealt(shared, names)(iter(batches)):
            for lang, run, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "n"))):
                if run is None:
                    continue
                words = run.split(" ")
                for k in range(1, len(words) + 1) if len(words) == 1 else range(2, len(words) + 1):
                    counts[lang, " ".join(words[:k])] += n
        assert sorted(((lang, p, n) for (lang, p), n in counts.items() if n >= 8), key=repr) == want


def test_two_bits_a_key_let_less_pass(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 62), 1 << 62, 60_000)
    texts = spark.createDataFrame([(k,) for k in keys[:20_000].tolist()], "key bigint").withColumn("n", F.lit(30))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(collocations, "key_counts", lambda rows, runs: rows)
        table = collocations._frequent(texts, 1, [], [], 30, 20)
    found = collocations._passes(table, keys.view(np.uint64))
    assert found[:20_000].all() and found[20_000:].mean() < 0.004  # one bit a key: 0.019


def test_long_texts_are_counted_across_their_cuts(spark, monkeypatch):
    text = prose(3000, 5) + " " + "y" * 700 + " " + prose(200, 5) + "a b " * 300
    monkeypatch.setattr(collocations, "SHARD", 256)
    shards = [collocations.Shard([(codes, owned, 0)]) for codes, owned in collocations._cuts(collocations.plain(text.encode()))]
    assert len(shards) > 20
    every = np.full(1 << 10, 255, np.uint8)
    for k in range(1, 5):
        got = Counter()
        for shard in shards:
            *_, (_, at) = shard.levels(k, [every] * 3)
            at = at[shard.owned[at]]
            got.update(shard.codes[s:e].tobytes() for s, e in zip(shard.starts[at], shard.ends[at + k - 1]))
        want = Counter()
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", small(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            want.update(" ".join(w[i : i + k]).encode() for i in range(len(w) - k + 1))
        assert got == want


def test_double_array_finds_every_key_and_no_other():
    rng = random.Random(3)
    keys = sorted({bytes(rng.choice(b"abcdefgh \xc3\xa9") for _ in range(rng.randint(1, 9))) for _ in range(3000)} | {bytes([b]) for b in range(256)})
    trie = DoubleArray.of_bytes(keys)
    assert [int(trie.accept[trie.find(k)]) for k in keys] == list(range(len(keys)))
    for _ in range(2000):
        key = bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(1, 9)))
        node = trie.find(key)
        assert (node >= 0 and trie.accept[node] >= 0) == (key in set(keys))
    assert DoubleArray.of_bytes([]).find(b"a") == -1


def test_registered_queries_state_their_columns(spark, sf_dir):
    assert queries.op11_phrase_collocations(spark, sf_dir).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert queries.op12_ranked_lexical_search(spark, sf_dir).columns == ["item_id", "rank", "doc_id", "score"]
    assert queries.op13_exact_dedup(spark, sf_dir).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
