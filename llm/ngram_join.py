"""Self-join of documents whose word shingle sets have a Jaccard similarity of 0.8 or more.

Method: a prefix-tree join over globally ordered n-gram sets.

1. Every document becomes the sorted set of the 64-bit hashes of its shingles.
   Equal sets are one class (128 bits and the size decide), compared once.
2. Two linked sets share at least ``k`` of their first ``n - 0.8 n + k`` grams
   in any global order.  Counting only these leading grams (in hash order)
   finds every set that can have a partner; the others leave.
3. For the rest all grams are counted.  Grams of one set only can't be part of
   an overlap, so a set keeps its shared grams, rarest first (by ranks of counts, then by
   hash): the global order of the tree.  A set with less than 0.8 of its grams left leaves.
   Only sums of grams are shuffled; which are shared, and their ranks, are told
   to the scans by bitmaps of a fixed size, in which a shared bit keeps too much, never too little.
4. The first gram that two linked sets share stands so early in both that the grams from
   there on can still hold the needed overlap; so a gram's place in a set bounds the size
   of the sets it can meet there (its reach).  A variant whose own and rare grams
   fill the places it may differ in meets nobody below the grams of its template.
   Leading grams with the same sets below them are merged into one node (path
   compression).  The sets below a node are compared with a few hubs of the
   node, tree order by tree order: neighbours in the order share a path, and
   the overlap along it is counted once; a subtree is left as soon as the
   remaining lengths can't reach the needed overlap.  A pair whose bit
   signatures differ in more places than linked sets can is not compared.  Linked sets are
   joined into components, and only pairs in different components are looked
   at again, with 32 times as many hubs a round, until no node has two
   components with unseen pairs.  A node of m near copies costs m comparisons
   for each hub, not m squared.  Near copies share most of their grams and meet below dozens
   of nodes; so the first hubs are those of one gram in eight, and of all grams
   only those make nodes whose sets are not in one component by then.

Texts without words have no shingles and link with nothing.  A document whose
id is null, or whose id another row repeats, is handled like any other row:
classes are made of sets, not of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import connected_components, is_small, small_batches, stage, text_rows
from llm.hashing import mix, shingle_set, word_hashes
from llm.sieve import as_array, key_counts, passes, sieve

WIDTH = 5
#: One gram in so many, of all of a set, must be shared among its leading grams for the set to be a candidate.
LEAD = 8
#: One leading gram in so many makes the nodes that are looked at first.
FIRST = 8
#: How often a gram occurs at least to be in each rank of the global order; what is below the first is in one set only.
RANKS = (2, 5, 17, 65, 513)
#: Bits of the bitmaps that tell shared grams and chosen rows (8 MB each, 16 MB for shared grams).
BITS = 26
#: Words of a set's signature.
WORDS = 8
#: Members compared with a hub in one task.
BLOCK = 2000


def needed(n: np.ndarray) -> np.ndarray:
    """The smallest overlap of two linked sets of which the larger has ``n`` grams: 0.8 n, rounded up."""
    return -(-4 * n // 5)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and two digests of each text's set."""
    for part, texts in text_rows(batches):
        sets = [shingle_set(w, WIDTH) for w in word_hashes(texts)]
        first = [int(mix(s + np.uint64(0x51ED)).sum(dtype=np.uint64)) for s in sets]
        second = [int(mix(s ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64)) for s in sets]
        yield pa.record_batch(
            {
                "doc_id": part.column("doc_id"),
                "key": part.column("key"),
                "n": np.array([len(s) for s in sets], np.int64),
                "h1": np.array(first, np.uint64).view(np.int64),
                "h2": np.array(second, np.uint64).view(np.int64),
            }
        )


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(arrays) if arrays else np.zeros(0, np.int64))


def _chosen(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(keys, sets) of the rows whose key may be in a sieve; only their texts are hashed."""
    for part, texts in text_rows(batches, 2 << 20):
        keys = part.column("key").to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(passes(table, keys.view(np.uint64)))
        if len(keep):
            yield keys[keep], [shingle_set(w, WIDTH) for w in word_hashes([texts[i] for i in keep])]


def _least(n: int) -> int:
    """How many of its leading grams a candidate shares."""
    return max(1, (-(-4 * n // 5) + LEAD - 1) // LEAD)


def _lead(own: np.ndarray) -> np.ndarray:
    return own[: len(own) - int(needed(len(own))) + max(1, -(-len(own) // LEAD))]


def _lead_grams(chosen):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, sets in _chosen(batches, chosen.value):
            yield np.concatenate([_lead(s) for s in sets])

    return keys


def _all_grams(chosen):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, sets in _chosen(batches, chosen.value):
            yield np.concatenate(sets)

    return keys


def _sharing(chosen, shared):
    """Keys of the sets that share enough leading grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for keys, sets in _chosen(batches, chosen.value):
            enough = [int(passes(table, _lead(s)).sum()) >= _least(len(s)) for s in sets]
            yield pa.record_batch({"x": keys[np.array(enough)]})

    return run


def _ordered(chosen, shared: list):
    """(x, n, grams, s0...): the grams that may be shared, rarest first, and a signature with a bit for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [t.value for t in shared]
        for keys, sets in _chosen(batches, chosen.value):
            out, signs, kept = [], np.zeros((len(sets), WORDS), np.uint64), []
            for i, own in enumerate(sets):
                common = passes(tables[0], own)
                if int(common.sum()) < int(needed(len(own))):
                    continue
                grams = own[common]
                rank = sum(passes(t, grams).astype(np.int8) for t in tables[1:])
                grams = grams[np.argsort(rank, kind="stable")]  # grams of one rank stay in the order of their hashes
                np.bitwise_or.at(signs[i], (grams >> np.uint64(6)) & np.uint64(WORDS - 1), np.uint64(1) << (grams & np.uint64(63)))
                out.append(grams.view(np.int64))
                kept.append(i)
            names = {f"s{j}": signs[kept, j].view(np.int64) for j in range(WORDS)}
            yield pa.record_batch({"x": keys[kept], "n": np.array([len(sets[i]) for i in kept], np.int64), "grams": _lists(out)} | names)

    return run


#: Grams looked up at once on the way down.
STEP = 16


def _hits(known: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which grams the hub has."""
    if not len(known):
        return np.zeros(len(grams), bool)
    return known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth-first walk through the tree of each hub's members, which come in tree order after the hub.

    ``hits[d]`` is the overlap with the hub along the first d grams of the
    path, as far down as it has been followed; a member goes on from where it leaves the path
    before, and is left where the grams that remain can't reach the needed overlap.
    """
    hub = salt = None
    known = path = np.zeros(0, np.int64)
    size, hits = 0, np.zeros(1, np.int64)
    for batch in batches:
        grams = batch.column("grams")
        values, ends = grams.values.to_numpy(), grams.offsets.to_numpy()
        hs, ss, xs, ns, heads = (batch.column(c).to_pylist() for c in ("h", "salt", "x", "n", "member"))
        out_a, out_b = [], []
        for i in range(batch.num_rows):
            own = values[ends[i] : ends[i + 1]]
            if not heads[i]:
                hub, salt, size = hs[i], ss[i], ns[i]
                known, path, hits = np.sort(own), own[:0], np.zeros(1, np.int64)
                continue
            assert (hub, salt) == (hs[i], ss[i])
            n = ns[i]
            need = -(-4 * (n + size) // 9)  # 0.8 of the union, by the overlap
            both = min(len(own), len(path), len(hits) - 1)
            differ = np.flatnonzero(own[:both] != path[:both])
            depth = int(differ[0]) if len(differ) else both
            hits, path = hits[: depth + 1], own
            while depth < len(own) and hits[depth] + len(own) - depth >= need:
                rest = own[depth : depth + STEP]
                hits = np.concatenate([hits, hits[depth] + np.cumsum(_hits(known, rest))])
                depth += len(rest)
            if depth == len(own) and hits[depth] >= need:
                out_a.append(hub)
                out_b.append(xs[i])
        yield pa.record_batch({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _sieved(keys: DataFrame, bits: int = BITS):
    return keys.sparkSession.sparkContext.broadcast(as_array(sieve(keys, bits), bits))


def _reduced(rows: DataFrame, classes: DataFrame, profiles: DataFrame) -> DataFrame:
    """(x, n, grams, s0...) of the sets that can have a partner; no gram moves with its set, only sums of grams do."""
    row = _sieved(classes.select(F.col("x").alias("key")))
    lead = _sieved(key_counts(rows, _lead_grams(row)).where("n > 1"), BITS + 1)
    found = rows.mapInArrow(_sharing(row, lead), "x bigint").distinct()
    candidates = stage(found.join(classes.select("x"), "x", "left_semi"), "candidates")
    row = _sieved(candidates.select(F.col("x").alias("key")))
    counts = stage(key_counts(rows, _all_grams(row)).where("n > 1"), "gram_counts")
    shared = [_sieved(counts.where(F.col("n") >= least), BITS + 1 if least == 2 else BITS) for least in RANKS]
    schema = "x bigint, n bigint, grams array<bigint>, " + ", ".join(f"{s} bigint" for s in _SIGNATURE)
    sets = rows.mapInArrow(_ordered(row, shared), schema)
    # a row that a sieve let through wrongly is none of the candidates
    small = is_small(candidates)
    sets = sets.join(F.broadcast(candidates) if small else candidates, "x", "left_semi")
    # rows with one id and text are one set; sets only move if there are such rows
    repeated = profiles.groupBy(F.col("key").alias("x")).agg(F.count("*").alias("rows_of_key")).where("rows_of_key > 1")
    return sets if repeated.join(candidates, "x", "left_semi").isEmpty() else sets.dropDuplicates(["x"])


_SIGNATURE = [f"s{i}" for i in range(WORDS)]


def _below(sets: DataFrame, component: DataFrame | None) -> DataFrame:
    """(gram, x, n, own, c, reach): the leading grams of each set and its component; without components, one gram in FIRST.

    Sets that first meet below the gram are linked only if each has at most ``reach`` grams of the other:
    the overlap is 4/9 of both sizes together at least, and at most the grams from the gram's place on.
    """
    lead = F.expr("n - (n * 4 + 4) div 5 + 1 - own")
    rows = sets.select("x", "n", "own", F.slice("grams", F.lit(1), F.least(lead, F.size("grams")).cast("int")).alias("lead"))
    rows = rows.withColumn("c", F.col("x")) if component is None else _with_component(rows, component)
    rows = rows.select("x", "n", "own", "c", F.posexplode("lead").alias("place", "gram"))
    if component is None:
        rows = rows.where(F.pmod(F.xxhash64("gram"), F.lit(FIRST)) == 0)
    return rows.select("gram", "x", "n", "own", "c", F.expr("(9 * (n - own - place) - 4 * n) div 4").alias("reach"))


def _with_component(rows: DataFrame, component: DataFrame) -> DataFrame:
    """``rows`` with c, the component of x, which is x itself where nothing is linked to it."""
    known = component.select(F.col("v").alias("x"), "component")
    known = F.broadcast(known) if is_small(known) else known
    return rows.join(known, "x", "left").withColumn("c", F.coalesce("component", "x")).drop("component")


def _nodes(below: DataFrame) -> DataFrame:
    """(node, x, n, own, c, reach): the sets below each leading gram that is in more than one component.

    Grams with the same sets make one node, in which a set has the farthest reach of them.
    A set that reaches no other, or that no other reaches, is not below a gram.
    """
    several = F.col("least") != F.col("most")
    parts = [F.min("c").alias("least"), F.max("c").alias("most")]
    open_ = below.groupBy("gram").agg(*parts, F.min("n").alias("least_n"), F.max("reach").alias("most_reach")).where(several)
    open_ = stage(open_.select("gram", "least_n", "most_reach"), "open_grams")
    rows = below.join(F.broadcast(open_) if is_small(open_) else open_, "gram")
    rows = rows.where("reach >= least_n and n <= most_reach").drop("least_n", "most_reach")
    prints = (
        rows.groupBy("gram")
        .agg(
            *parts,
            F.count("*").alias("members"),
            F.sum(F.xxhash64("x").cast("decimal(20,0)")).alias("s"),
            F.bit_xor(F.xxhash64("x", F.lit(1))).alias("b"),
        )
        .where(several)
        # no more grams than a set has leading ones
        .groupBy("members", "s", "b")
        .agg(F.min("gram").alias("node"), F.collect_list("gram").alias("grams"))
        .select("node", F.explode("grams").alias("gram"))
    )
    prints = stage(prints, "prints")
    rows = rows.join(F.broadcast(prints) if is_small(prints) else prints, "gram")
    return rows.groupBy("node", "x", "n", "own", "c").agg(F.max("reach").alias("reach"))


_NODE = ["node", "x", "n", "own", "reach"]


def _hubs(nodes: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
    """The hubs (node, x) of this round, and the nodes (node) that have pairs to look at.

    The first hub of a node is the set with the fewest grams of its own: what variants were
    made of is linked to most of them.  Later the largest component of a node gives no hubs.
    """
    if not round_:
        hubs = nodes.groupBy("node").agg(F.min_by("x", F.struct("own", "n", "x")).alias("x"))
        return hubs, hubs.select("node")
    parts = nodes.groupBy("node", "c").agg(F.count("*").alias("k"))
    largest = parts.groupBy("node").agg(
        F.max_by("c", F.struct("k", "c")).alias("largest"), (F.sum("k") - F.max("k")).alias("others"), F.count("*").alias("cs")
    )
    open_ = largest.where("cs > 1").select("node", "largest", "others")
    # about 32 ** round_ hubs a node; all of them where there are fewer
    hubs = (
        nodes.join(open_, "node")
        .where("c <> largest")
        .where(F.pmod(F.xxhash64("x", F.lit(round_)), F.expr(f"(others + {32**round_ - 1}) div {32**round_}")) == 0)
        .select("node", "x")
    )
    return hubs, open_.select("node")


def _pairs(nodes: DataFrame, hubs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (h, x) of a hub and the other members of its node in other components."""
    heads = nodes.join(hubs, ["node", "x"], "left_semi").select("node", *(F.col(c).alias(f"h{c}" if c != "x" else "h") for c in ("x", "n", "c", "reach")))
    near = (F.col("n") <= F.col("hreach")) & (F.col("hn") <= F.col("reach"))
    # two hubs may meet as (a, b) and (b, a), and two sets below many nodes
    pairs = nodes.join(heads, "node").where(near & (F.col("c") != F.col("hc"))).select("h", "x").distinct()
    # grams in one set only: at most a ninth of both together; every bit that differs and every unshared gram is one
    signs = sets.select("x", "n", "own", *_SIGNATURE)
    hub_signs = signs.select(*(F.col(c).alias(f"h{c}" if c != "x" else "h") for c in signs.columns))
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"h{w}"))) for w in _SIGNATURE), F.col("own") + F.col("hown"))
    return pairs.join(signs, "x").join(hub_signs, "h").where(differ * 9 <= F.col("n") + F.col("hn")).select("h", "x")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of the pairs."""
    pairs = stage(pairs, "pairs")
    blocks = pairs.groupBy("h").agg(F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    members = pairs.join(blocks, "h").select("h", "x", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("salt"))
    heads = blocks.select("h", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("salt"))
    keyed = heads.select("h", "salt", F.lit(0).alias("member"), F.col("h").alias("x")).unionByName(members.withColumn("member", F.lit(1)))
    rows = keyed.join(sets.drop(*_SIGNATURE), "x").select("h", "salt", "member", "x", "n", "grams")
    ordered = rows.repartition("h", "salt").sortWithinPartitions("h", "salt", "member", "grams")
    return ordered.mapInArrow(_walk, "a bigint, b bigint")


def row_key() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.col("text").cast("string"), F.col("doc_id").cast("bigint"))


def row_components(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, key, n, component; null for a text without words.

    ``key`` is ``row_key``, which with doc_id tells the row; rows that links connect have one component.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", row_key())
    profiles = stage(rows.mapInArrow(_profiles, "doc_id bigint, key bigint, n bigint, h1 bigint, h2 bigint"), "profiles")
    digest = ["n", "h1", "h2"]
    # x, a class of equal sets: the smallest key of its rows, which leads to a text
    classes = stage(profiles.where("n > 0").groupBy(*digest).agg(F.min("key").alias("x")), "classes")
    sets = stage(_reduced(rows, classes, profiles).withColumn("own", F.col("n") - F.size("grams")), "sets")
    nodes, component, edges, round_ = stage(_nodes(_below(sets, None)), "nodes"), None, None, 0
    whole = False
    while True:
        hubs, open_ = _hubs(nodes, round_)
        hubs = stage(hubs, "hubs")
        if not hubs.isEmpty():
            found = stage(_links(_pairs(nodes, hubs, sets), sets), "links")
            if not found.isEmpty():
                edges = found if edges is None else edges.unionByName(found)
                component = stage(connected_components(edges), "component")
                edges = component.select(F.col("v").alias("a"), F.col("component").alias("b"))
        if not whole:
            # all grams now; most have their sets in one component and make no node
            known = spark.createDataFrame([], "v bigint, component bigint") if component is None else component
            nodes, whole = stage(_nodes(_below(sets, known)), "nodes"), True
            continue
        if not hubs.isEmpty():
            nodes = nodes.join(open_, "node", "left_semi").join(hubs, ["node", "x"], "left_anti").select(*_NODE, "c")
            if component is not None:
                nodes = _with_component(nodes.drop("c"), component)
            nodes = stage(nodes, "nodes")
        elif open_.isEmpty():
            break
        round_ += 1
    if component is None:
        component = spark.createDataFrame([], "v bigint, component bigint")
    reached = classes.join(component.withColumnRenamed("v", "x"), "x", "left").select(
        *digest, F.coalesce("component", "x").alias("component")
    )
    return stage(profiles.join(reached, digest, "left").drop("h1", "h2"), "reached")


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach; a text without words keeps its own.
    A null doc_id takes part like others and is never the smallest.
    """
    found = row_components(docs)
    smallest = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(smallest, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
