"""Benchmark passages in documents, found with a distributed positional inverted index.

Method: the documents' words are postings (term, document, position).  Terms
of the benchmark are counted over all documents; a window of ``WINDOW``
benchmark words is looked up from its two rarest terms: their posting lists,
shifted by the term's offset in the window, are intersected, and each start that
both name is compared with the whole phrase.  Only lists of such terms are built, for
other lists are never read.

Altered passages are found from the same lists: four words in five of a window
(``near_words``) stand at most ``slack`` words out of line.  So at most a fifth
is missing, and of the rarest terms one more than may be missing, at
least one is there.  Terms that occur nowhere count among the missing.

One scan of the texts builds all lists.  A term is looked up by its place in an item
(``entry``), not for every window around that place; a posting is written
only if enough different words of the item's surroundings stand around it, which is asked by
their hashes while the text is at hand, and carries the words around, so that
phrases are compared, exactly or with slack, without reading texts again.

Benchmark tables are fixed test sets.  Their entries are broadcast in pieces of at
most ``ENTRIES`` rows, with one scan for each piece.

DataFrame functions only.  A null text has no words; a benchmark row with a
null id is not looked for.  Rows with equal ids and texts get equal results.
Long texts on either side are cut into windows and surroundings before they move;
an empty table of documents gives no rows, an empty benchmark no matches; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import LOWER, UPPER, is_small, sha256_of_sorted, stage

WINDOW = 10
#: Words by which the starts of a near window's words may differ.
SLACK = 5
#: Entries in one broadcast: a hash, some twenty hashes of words around it, a number.
ENTRIES = 100_000
#: Bytes between words; capitals are letters here and made small afterwards.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    """The words of a text; an empty string stands before or after them where the text begins or ends otherwise."""
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), _BETWEEN)


def plain(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(w: Column) -> Column:
    edges = (w[0] == "").cast("int") + (F.element_at(w, -1) == "").cast("int")
    return F.when((F.size(w) == 1) & (w[0] == ""), F.lit(0)).otherwise(F.size(w) - edges).cast("bigint")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, w): the words of each item."""
    w = F.filter(F.transform(words(), plain), lambda x: x != "")
    return benchmark.where("item_id is not null").select("item_id", w.alias("w")).where("size(w) > 0")


def _starts(width: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))).alias("at")


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, phrase, len): the distinct windows of each item, their words joined by spaces."""
    return (
        _items(benchmark)
        .select("item_id", "w", _starts(width))
        .select("item_id", F.slice("w", F.col("at"), F.lit(width)).alias("w"))
        .select("item_id", F.array_join("w", " ").alias("phrase"), F.size("w").alias("len"))
        .distinct()
    )


def _hashed(w: Column) -> Column:
    """Terms are looked up in small letters of all alphabets."""
    return F.transform(w, lambda x: F.xxhash64(F.lower(x)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"),
        words().alias("w"),
    )


def near_words(n: str) -> Column:
    """How many of a window's ``n`` words must be near: four in five, rounded up."""
    return F.expr(f"({n} * 4 + 4) div 5").cast("int")


def _lookups(rows: DataFrame, benchmark: DataFrame, width: int, slack: int | None) -> DataFrame:
    """(entry, t, ctx, need, phrase, len, offset, rank, whole): the rarest terms of each window, at their places in an item.

    ``ctx`` are the item's words around the place, of which ``need`` different ones
    stand around every match of the window; ``whole`` if all words of the window occur.
    """
    reach = width - 1
    around = F.slice("w", F.greatest(F.col("at") - reach, F.lit(1)), F.least(F.col("at") - 1, F.lit(reach)) + width + reach)
    found = _items(benchmark).select("w", _starts(width)).select(
        F.array_join(F.slice("w", F.col("at"), F.lit(width)), " ").alias("phrase"),
        F.least(F.col("at") - 1, F.lit(reach)).alias("before"),
        F.array_join(around, " ").alias("around"),
    )
    found = stage(found.distinct().withColumn("len", F.size(F.split("phrase", " "))), "windows")
    terms = found.select("*", F.posexplode(F.split("phrase", " ")).alias("offset", "term")).withColumn("t", F.xxhash64(F.lower("term")))
    vocabulary = stage(terms.select("t").distinct(), "vocabulary")
    # explode_outer: no filter on the size of the array that would split each text twice
    seen = rows.select(F.explode_outer("w").alias("term")).select(F.xxhash64(F.lower("term")).alias("t"))
    counts = stage(seen.join(_sized(vocabulary), "t").groupBy("t").agg(F.count("*").alias("n")), "term_counts")
    every = Window.partitionBy("phrase", "before", "around")
    may_miss = F.lit(0) if slack is None else F.col("len") - near_words("len")
    ranked = (
        terms.join(counts, "t", "left")
        .withColumn("absent", F.count(F.when(F.isnull("n"), 1)).over(every))
        .withColumn("missing", may_miss - F.col("absent"))
        .where("missing >= 0 and n is not null")
        .withColumn("rank", F.row_number().over(every.orderBy("n", "offset")))
        .where("rank <= greatest(missing + 1, 2)")
    )
    place = F.col("before") + F.col("offset")
    first = F.greatest(place - reach, F.lit(0))
    ctx = F.slice(F.split("around", " "), first + 1, place + reach - first + 1)
    different = F.size(F.array_distinct(_hashed(F.split("phrase", " "))))
    return ranked.select(
        F.xxhash64(F.array_join(ctx, " "), place - first).alias("entry"),
        "t",
        F.array_distinct(_hashed(ctx)).alias("ctx"),
        (different - may_miss).alias("need"),
        "phrase",
        "len",
        "offset",
        "rank",
        (F.col("absent") == 0).alias("whole"),
    )


def _postings(rows: DataFrame, lookups: DataFrame, reach: int) -> DataFrame:
    """(entry, doc_id, key, pos, low, around): where the terms stand among words of their surroundings; ``around`` are the words from ``low`` on."""
    entries = stage(lookups.groupBy("entry", "t").agg(F.any_value("ctx").alias("ctx"), F.min("need").alias("need")), "entries")
    pieces = max(-(-entries.count() // ENTRIES), 1)
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    size = F.col("pos") + reach - low + 1
    hashed = rows.withColumn("h", _hashed(F.col("w")))
    out = None
    for i in range(pieces):
        own = entries.where(F.pmod("entry", F.lit(pieces)) == i)
        found = (
            hashed.select("doc_id", "key", "w", "h", F.posexplode_outer("h").alias("pos", "t"))
            .join(F.broadcast(own), "t")
            .where(F.size(F.array_intersect(F.slice("h", low + 1, size), F.col("ctx"))) >= F.col("need"))
            .select("entry", "doc_id", "key", "pos", low.alias("low"), F.slice("w", low + 1, size).alias("around"))
        )
        out = found if out is None else out.unionByName(found)
    return out


class Passages:
    """What the index says about the windows of a benchmark: exact occurrences, and with ``slack`` near ones."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slack: int | None = None):
        self.slack, self.items = slack, windows(benchmark, width)
        rows = _rows(docs)
        lookups = stage(_lookups(rows, benchmark, width, slack), "lookups")
        self.postings = stage(_postings(rows, lookups, width - 1 + (slack or 0)), "postings")
        self.lookups = lookups.select("entry", "phrase", "len", "offset", "rank", "whole").distinct()

    def _placed(self, lookups: DataFrame) -> DataFrame:
        """Each posting with the windows it may belong to, where they would start, and whether the words of the phrase are there."""
        placed = self.postings.join(_sized(lookups), "entry").withColumn("start", F.col("pos") - F.col("offset"))
        here = F.slice("around", F.greatest(F.col("start") - F.col("low"), F.lit(0)) + 1, F.col("len"))
        return placed.withColumn("there", (F.col("start") >= F.col("low")) & (F.array_join(F.transform(here, plain), " ") == F.col("phrase")))

    def phrase_starts(self) -> DataFrame:
        """(doc_id, key, phrase, len, start): exact occurrences."""
        both = self._placed(self.lookups.where("whole and rank <= 2"))
        first = both.where("rank = 1")
        # a phrase of one word has one list only
        second = both.where("rank = 2").select("doc_id", "key", "phrase", F.col("start").alias("other"))
        one, two = first.where("len > 1").alias("one"), second.alias("two")
        on = (F.col("one.key") == F.col("two.key")) & (F.col("one.phrase") == F.col("two.phrase")) & (F.col("start") == F.col("other"))
        crossed = one.join(two, on & F.col("one.doc_id").eqNullSafe(F.col("two.doc_id")), "left_semi")
        return crossed.unionByName(first.where("len = 1")).where("there").select("doc_id", "key", "phrase", "len", "start").distinct()

    def near_items(self) -> DataFrame:
        """(doc_id, key, item_id): documents that a window of the item is near.

        A word of the window at offset o that stands at position p of the document
        starts at p - o.  The window is near if for some s at least ``near_words``
        of its offsets, on as many different positions, start from s to s + slack.
        """
        slack = self.slack
        placed = self._placed(self.lookups)
        same = placed.where("there").select("doc_id", "key", "phrase")
        terms = F.transform(F.split("phrase", " "), F.lower)
        near = placed.where("not there").select("doc_id", "key", "phrase", "len", "start", "low", terms.alias("terms"), F.transform("around", F.lower).alias("around"))
        shared = F.size(F.array_intersect(_hashed(F.col("around")), _hashed(F.col("terms"))))
        may_miss = F.col("len") - near_words("len")
        near = near.where(shared >= F.size(F.array_distinct("terms")) - may_miss)
        near = near.dropDuplicates(["doc_id", "key", "phrase", "start"])
        hits = F.flatten(
            F.transform(
                "around",
                lambda x, i: F.transform(
                    F.filter(F.transform("terms", lambda t, o: F.struct(t.alias("t"), o.alias("o"))), lambda t: t["t"] == x),
                    lambda t: F.struct((F.col("low") + i - t["o"]).alias("s"), t["o"].alias("o"), (F.col("low") + i).alias("at")),
                ),
            )
        )
        near = near.withColumn("hits", hits).where(F.size("hits") >= near_words("len"))

        def enough(s: Column) -> Column:
            here = F.filter("hits", lambda h: (h["s"] >= s) & (h["s"] <= s + slack))
            offsets, places = (F.size(F.array_distinct(x)) for x in (F.transform(here, lambda h: h["o"]), F.transform(here, lambda h: h["at"])))
            return F.least(offsets, places) >= near_words("len")

        near = near.where(F.exists(F.sequence(F.col("start") - slack, F.col("start")), enough)).select("doc_id", "key", "phrase")
        return near.unionByName(same).distinct().join(self.items, "phrase").select("doc_id", "key", "item_id").distinct()


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slack: int = SLACK, width: int = WINDOW) -> DataFrame:
    """(doc_id, item_id): documents that a window of the item is near, exact occurrences included."""
    return Passages(docs, benchmark, width, slack).near_items().select("doc_id", "item_id").distinct()


def _with_proximity(found: DataFrame, passages: Passages, item_type: str) -> DataFrame:
    """``found`` (doc_id, key, ...) with n_near_items and near_items_sha256, exact occurrences included."""
    items = stage(passages.near_items(), "near_items").groupBy(F.col("doc_id").alias("o_id"), F.col("key").alias("o_key"))
    items = items.agg(F.collect_set("item_id").alias("near"))
    joined = found.join(items, (F.col("key") == F.col("o_key")) & F.col("doc_id").eqNullSafe(F.col("o_id")), "left")
    near = F.coalesce("near", F.array().cast(f"array<{item_type}>"))
    return joined.select(found["*"], F.size(near).cast("bigint").alias("n_near_items"), sha256_of_sorted(near).alias("near_items_sha256"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slack: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated.

    ``key`` is xxhash64 of the text, which with doc_id tells the row.  With ``slack``
    also n_near_items and near_items_sha256: items that a window of is near, exact occurrences included.
    """
    passages = Passages(docs, benchmark, width, slack)
    found = stage(passages.phrase_starts(), "occurrences")
    same = ["doc_id", "key"]
    spans = found.groupBy(*same, "start").agg((F.max("len") + F.col("start")).alias("end"))
    before = Window.partitionBy(*same).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    hit = spans.withColumn("fresh", fresh).groupBy(*same).agg(F.sum("fresh").alias("n_hit"))
    items = (
        found.select(*same, "phrase")
        .distinct()
        .join(passages.items, "phrase")
        .groupBy(*same)
        .agg(F.collect_set("item_id").alias("items"))
    )
    h, i = hit.alias("h"), items.alias("i")
    matched = h.join(i, F.col("h.key").eqNullSafe(F.col("i.key")) & F.col("h.doc_id").eqNullSafe(F.col("i.doc_id"))).select(
        F.col("h.doc_id").alias("other_id"), F.col("h.key").alias("other_key"), "n_hit", "items"
    )
    counts = _rows(docs).select("doc_id", "key", n_words(F.col("w")).alias("n_words"))
    joined = counts.join(matched, (F.col("key") == F.col("other_key")) & F.col("doc_id").eqNullSafe(F.col("other_id")), "left")
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    none = F.array().cast(f"array<{item_type}>")
    out = joined.select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        sha256_of_sorted(F.coalesce("items", none)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
    return out if slack is None else _with_proximity(out, passages, item_type)
