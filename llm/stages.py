"""Stages of a corpus pipeline: what an operator's decisions do to a table of documents.

Each takes documents and returns those it keeps with the columns of the table,
whatever their names: a row goes through an operator whole, as one value.
Null ids and texts, repeated rows, texts of any length and empty tables are handled
as the operators say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import is_small, stage
from llm.decontamination import decontaminate
from llm.langid import learnable, predict_languages
from llm.ngram_join import row_components, row_key
from llm.packing import best_fit_packing
from llm.sanitisation import sanitised


def _whole(docs: DataFrame, **more: Column) -> DataFrame:
    """(row, ...): each row as one value beside what an operator looks at."""
    return docs.select(F.struct(*docs.columns).alias("row"), *(c.alias(n) for n, c in more.items()))


def _back(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    return rows.select(*(changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def known_language(docs: DataFrame) -> DataFrame:
    """Documents of a language that was learned, which becomes their ``lang``.

    Texts that are null or have no letter go.  Where there is nothing to learn from, all
    others stay as they are.
    """
    if learnable(docs).isEmpty():
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    found = predict_languages(_whole(docs, doc_id=F.col("doc_id"), text=F.col("text"), lang=F.col("lang")), keep=True)
    return _back(found.where("lang_pred <> 'und'"), docs, lang=F.col("lang_pred"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, null ids last, and among rows of that id the one with the smallest key.

    Rows without words are in no group and stay, repeated ones too.
    """
    found = row_components(docs).where("component is not null")
    rows = stage(found.groupBy("component", "doc_id", "key").agg(F.count("*").alias("copies")), "group_rows")
    first = rows.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("first"))
    kept = (F.col("key") == F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    # rows that don't stay as they are: they go (0 copies), or one of several equal rows stays
    marks = rows.join(first, "component").select(
        F.col("doc_id").alias("o_id"), F.col("key").alias("o_key"), F.when(kept, F.col("copies")).otherwise(F.lit(0)).alias("o_copies")
    )
    marks = stage(marks.where("o_copies <> 1"), "group_marks")
    on = (F.col("key") == F.col("o_key")) & F.col("doc_id").eqNullSafe(F.col("o_id"))
    marked = _whole(docs, doc_id=F.col("doc_id").cast("bigint"), key=row_key()).join(_sized(marks), on, "left")
    out = marked.where("o_copies is null")
    if marks.where("o_copies > 1").isEmpty():
        return _back(out, docs)
    # they have one id and text; where other columns differ, a hash of them decides
    row = F.min_by("row", F.xxhash64("row")).alias("row")
    return _back(out.select("row").unionByName(marked.where("o_copies > 1").groupBy("o_id", "o_key").agg(row).select("row")), docs)


def not_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a benchmark passage, word for word.

    Altered passages are reported by the operator and stay: what is near may be a
    quotation of the same source, and a filter should not guess.
    """
    found = decontaminate(docs, benchmark)
    bad = found.where("contaminated").select(F.col("doc_id").alias("o_id"), F.col("key").alias("o_key")).distinct()
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = _whole(docs, doc_id=F.col("doc_id").cast("bigint"), key=key)
    return _back(rows.join(bad, (F.col("key") == F.col("o_key")) & F.col("doc_id").eqNullSafe(F.col("o_id")), "left_anti"), docs)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """All documents, personal data and terms that disclose it replaced in the text; n_chars follows."""
    clean = sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return best_fit_packing(docs, tokenizer)
