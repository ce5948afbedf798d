"""Personal data in texts, and the terms that would give it away.

Base: e-mail addresses, IP addresses, card and telephone numbers, by pattern and
check (octets, Luhn, digit counts).  Their values are the protected entities.

Method: information-theoretic sanitisation.  Terms that stand within ``AROUND``
characters of an entity co-occur with it.  With the documents as
observations, -log2 P(entity | term) is the uncertainty that is left about
the entity for someone who reads the term.  A term that leaves at most
``REMOVE_BITS`` is removed from the documents that hold the entity, one that
leaves at most ``GENERALISE_BITS`` is generalised to its first letter.  P is
estimated over the whole corpus: documents in which term and entity stand
together, over documents with the term and ``UNSEEN`` more that might have it
without the entity, so that few observations leave more uncertainty and no
entity is too rare to have terms.  A word that the edge of the context cuts is
not within it.  Base spans stay as they are; a term that overlaps one is left out.

The patterns are those of the contract, with possessive quantifiers and a look
behind so that long runs of letters or digits cost linear time; they match the
same strings.  Positions are code points.  DataFrame functions only.  A null or
empty text has no spans.  Rows with equal ids and texts get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import is_small, stage

#: Kinds in their order, their replacements and patterns.
KINDS = ["email", "ip", "card", "phone", "term"]
REPLACED = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{13}", "phone": r"\+[0-9]"}
AROUND = 120
#: Documents with the term and without the entity that an estimate adds to those seen.
UNSEEN = 1
REMOVE_BITS = 1.0
GENERALISE_BITS = 3.0
_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[1-9])?"
_WORD = r"\p{L}++"


def text_rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, t): the key is xxhash64 of the text, which is empty where it was null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("t"))


def _positions(found: DataFrame, group: list[str]) -> DataFrame:
    """``start`` and ``end`` of each match (i, gap: characters since the match before)."""
    until = Window.partitionBy(*group).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(until).cast("bigint")).withColumn(
        "start", F.col("end") - F.length("match")
    )


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    value = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2)),
        F.lit(0),
        lambda s, d: s + F.when(d > 9, d - 9).otherwise(d),
    )
    return value % 10 == 0


def valid_match(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern passes its check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return F.when(n.between(14, 19), luhn(digits)).otherwise(False) if kind == "card" else n.between(10, 15)


def _valid() -> Column:
    return F.coalesce(*(F.when(F.col("kind") == kind, valid_match(kind, F.col("match"))) for kind in PATTERNS))


def _hinted(kind: str) -> Column:
    return F.col("t").contains("@") if kind == "email" else F.col("t").rlike(HINTS[kind])


def base_matches() -> Column:
    """For each kind that column ``t`` may hold: the kind, the characters before each match since the last one, each match's length and validity.

    The places stay with their row, so that no text has to move.
    """

    def tried(kind: str) -> Column:
        matches = F.regexp_extract_all("t", F.lit(PATTERNS[kind]), F.lit(0))
        found = F.struct(
            F.lit(kind).alias("kind"),
            F.transform(F.split("t", PATTERNS[kind]), F.length).alias("gaps"),
            F.transform(matches, lambda m: F.struct(F.length(m).alias("length"), valid_match(kind, m).alias("valid"))).alias("matches"),
        )
        return F.when(_hinted(kind), found)

    return F.array_compact(F.array(*map(tried, PATTERNS)))


def _whole_words(context: Column, edge: str) -> Column:
    """A context of a character too many without that character, and without the word that it cuts."""
    return F.when(F.length(context) > AROUND, F.regexp_replace(context, "(?s)" + edge, "")).otherwise(context)


def base_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, key, kind, start, end, match, before, after) of valid personal data in ``rows`` (doc_id, key, t)."""

    def tried(kind: str) -> Column:
        gaps = F.transform(
            F.split("t", PATTERNS[kind]),
            lambda g: F.struct(F.length(g).alias("gap"), _whole_words(F.right(g, F.lit(AROUND + 1)), r"^(?:.(?!\p{L})|\p{L}+)").alias("before"), _whole_words(F.left(g, F.lit(AROUND + 1)), r"(?:(?<!\p{L}).|\p{L}+)$").alias("after")),
        )
        return F.when(
            _hinted(kind), F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), F.regexp_extract_all("t", F.lit(PATTERNS[kind]), F.lit(0)).alias("matches"))
        )

    found = rows.select("doc_id", "key", F.explode(F.array(*map(tried, PATTERNS))).alias("f")).where("size(f.matches) > 0")
    each = found.select("doc_id", "key", "f.kind", F.posexplode(F.arrays_zip(F.col("f.gaps"), F.col("f.matches"), F.slice("f.gaps", 2, F.size("f.matches")).alias("next"))).alias("i", "m"))
    # the last gap has no match after it
    each = each.where("m.matches is not null").select(
        "doc_id", "key", "kind", "i", F.col("m.gaps.gap").alias("gap"), F.col("m.matches").alias("match"), F.col("m.gaps.before").alias("before"), F.col("m.next.after").alias("after")
    )
    # rows with equal ids and texts count once
    once = each.dropDuplicates(["doc_id", "key", "kind", "i"])
    return _positions(once, ["doc_id", "key", "kind"]).where(_valid()).drop("i", "gap")


def document_counts(rows: DataFrame) -> DataFrame:
    """(term, n): in how many documents a term occurs; rows with equal ids and texts count once."""
    terms = F.array_distinct(F.split(F.lower("t"), r"[^\p{L}]+")).alias("terms")
    copies = rows.groupBy(F.col("doc_id").alias("o_id"), F.col("key").alias("o_key")).agg(F.count("*").alias("c")).where("c > 1")
    copies = stage(copies.select("o_id", "o_key"), "repeated_rows")
    if copies.isEmpty():
        return rows.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    small = F.broadcast(copies) if is_small(copies) else copies
    on = (F.col("key") == F.col("o_key")) & F.col("doc_id").eqNullSafe(F.col("o_id"))
    once = rows.join(small, on, "left_anti").select(F.explode(terms).alias("term"))
    again = rows.join(small, on, "left_semi").select("doc_id", "key", F.explode(terms).alias("term")).distinct().select("term")
    return once.unionByName(again).groupBy("term").agg(F.count("*").alias("n"))


def disclosing_terms(rows: DataFrame, spans: DataFrame) -> DataFrame | None:
    """(e, term, bits): uncertainty in bits that a term leaves about entity e; None if no entity has words around it."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "before", "after")), r"[^\p{L}]+"), lambda w: w != ""))
    pairs = spans.select(entity().alias("e"), "doc_id", "key", F.explode(words).alias("term")).distinct()
    together = stage(pairs.groupBy("e", "term").agg(F.count("*").alias("both")), "together")
    if together.isEmpty():
        return None
    # what no entity can have often enough needs no meeting: the commonest terms go here
    most = together.groupBy("term").agg(F.max("both").alias("most"))
    counts = document_counts(rows).join(most, "term").where(F.col("n") + UNSEEN <= F.col("most") * 2**GENERALISE_BITS)
    counts = stage(counts.select("term", "n"), "term_documents")
    left = together.join(F.broadcast(counts) if is_small(counts) else counts, "term")
    left = left.select("e", "term", F.log2((F.greatest(F.col("n"), F.col("both")) + UNSEEN) / F.col("both")).alias("bits"))
    return left.where(F.col("bits") <= GENERALISE_BITS)


def entity() -> Column:
    bare = F.when(F.col("kind").isin("card", "phone"), F.regexp_replace("match", "[^0-9]", "")).otherwise(F.lower("match"))
    return F.xxhash64("kind", bare)


def term_spans(rows: DataFrame, spans: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences of disclosing terms in the documents that hold the entity, outside base spans."""
    inside = spans.select("doc_id", "key", entity().alias("e")).distinct().join(terms, "e")
    inside = stage(inside.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k"), "term").agg(F.min("bits").alias("bits")), "inside")
    where = inside.select("d", "k").distinct()
    where = F.broadcast(where) if is_small(where) else where
    texts = rows.join(where, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).drop("d", "k")
    texts = texts.select("doc_id", "key", F.transform(F.split("t", _WORD), F.length).alias("gap"), F.regexp_extract_all("t", F.lit(_WORD), F.lit(0)).alias("match"))
    words = texts.select("doc_id", "key", F.posexplode(F.arrays_zip("gap", "match")).alias("i", "m")).where("m.match is not null")
    words = words.select("doc_id", "key", "i", "m.gap", "m.match").dropDuplicates(["doc_id", "key", "i"])
    placed = _positions(words, ["doc_id", "key"]).withColumn("term", F.lower("match"))
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (placed["term"] == inside["term"])
    found = placed.join(inside, on).select("doc_id", "key", F.lit("term").alias("kind"), "start", "end", "match", "bits")
    by = Window.partitionBy("doc_id", "key").orderBy("start", "kind")
    base = F.col("kind") != "term"
    both = spans.select("doc_id", "key", "kind", "start", "end", "match", F.lit(0.0).alias("bits")).unionByName(found)
    marked = both.withColumn("last", F.max(F.when(base, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "next", F.min(F.when(base, F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    )
    return marked.where("kind = 'term' AND coalesce(last, 0) <= start AND coalesce(next, end) >= end").select("doc_id", "key", "kind", "start", "end", "match", "bits")


def all_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, key, kind, start, end, match, bits) of base and term spans."""
    base = stage(base_spans(rows), "base_spans")
    terms = disclosing_terms(rows, base)
    spans = base.select("doc_id", "key", "kind", "start", "end", "match", F.lit(0.0).alias("bits"))
    return spans if terms is None else spans.unionByName(term_spans(rows, base, stage(terms, "disclosing")))


def _listed(spans: DataFrame) -> DataFrame:
    """One row for each text with spans: (o_id, o_key, spans), sorted by start and kind."""
    no = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)))
    item = F.struct("start", no.alias("no"), "end", "kind", "match", "bits")
    listed = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(item)).alias("spans"))
    return listed.select(F.col("doc_id").alias("o_id"), F.col("key").alias("o_key"), "spans")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    rows = text_rows_of(docs)
    listed = _listed(all_spans(rows))
    joined = rows.select("doc_id", "key").join(listed, (F.col("key") == F.col("o_key")) & F.col("doc_id").eqNullSafe(F.col("o_id")), "left")

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    return joined.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(F.coalesce(text(base), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(text(F.col("spans")), F.lit("")).alias("spans"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by their kind, and disclosing terms removed or generalised, in ``text``."""
    rows = text_rows_of(docs)
    spans = all_spans(rows)
    # spans that overlap are replaced one after the other, each from where the one before ended
    by = Window.partitionBy("doc_id", "key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    term = F.when(F.col("bits") <= REMOVE_BITS, F.lit("")).otherwise(F.concat(F.left("match", F.lit(1)), F.lit("*")))
    put = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in REPLACED.items()), term)
    cut = spans.withColumn("from", F.coalesce(F.max("end").over(by), F.lit(0))).withColumn("put", put)
    cuts = cut.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "from", "put"))).alias("cuts"), F.max("end").alias("last")
    )
    cuts = cuts.select(F.col("doc_id").alias("o_id"), F.col("key").alias("o_key"), "cuts", "last")
    # the row goes through whole, so that no name of its columns can clash
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key"))
    joined = whole.join(cuts, (F.col("key") == F.col("o_key")) & F.col("doc_id").eqNullSafe(F.col("o_id")), "left")
    pieces = F.transform(
        "cuts",
        lambda c: F.concat(F.substring(F.col("text"), (c["from"] + 1).cast("int"), F.greatest(c["start"] - c["from"], F.lit(0)).cast("int")), c["put"]),
    )
    clean = F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), (F.col("last") + 1).cast("int"), F.lit(2**31 - 1)))
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(clean)
    return joined.select(*(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
