"""Registered queries of the operators, and their check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.chat_formatting import linked_conversations
from llm.collocations import collocations
from llm.common import table
from llm.decontamination import SLACK, decontaminate
from llm.embedding_join import epsilon_grid_join
from llm.exact_dedup import exact_duplicates
from llm.langid import predict_languages
from llm.lexical_search import ranked_search
from llm.ngram_join import ngram_jaccard_join
from llm.packing import best_fit_packing
from llm.sanitisation import REPLACED, personal_data
from llm.sharding import feistel_shards
from llm.substring_dedup import substring_dedup
from llm.token_counts import replaced_token_counts

#: Files of the installed package of public tokenizers.
PACKING_TOKENIZER = "word_bpe_49k.json"
COUNTING_TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact benchmark passages of all documents, and the items whose passages are near in them."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate(docs, benchmark, slack=SLACK).drop("key")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after their personal data is replaced."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return replaced_token_counts(docs, REPLACED, tokenizer_path(COUNTING_TOKENIZER), public_tokenizers.PATTERN)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path(PACKING_TOKENIZER))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op9_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon_grid_join(table(spark, sf_dir, "embeddings"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_conversations(table(spark, sf_dir, "conversations"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), all_digests=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_benchmark_decontamination,
        op3_substring_dedup,
        op4_token_counts,
        op5_personal_data,
        op6_feistel_sharding,
        op7_best_fit_packing,
        op8_language_id,
        op9_epsilon_grid_join,
        op10_quotation_linking,
        op11_phrase_collocations,
        op12_ranked_lexical_search,
        op13_exact_dedup,
    )
}

_SMALL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_COLLOCATIONS = rf"""WITH pieces AS (
SELECT lang, row_number() OVER () AS piece, p FROM (SELECT coalesce(lang, 'und') AS lang,
 unnest(string_split_regex(translate(coalesce(text, ''), {_SMALL}), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
words AS (SELECT lang, piece, unnest(w) AS w, unnest(range(len(w))) AS place
 FROM (SELECT lang, piece, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces)),
runs AS (SELECT lang, w AS w1, lead(w) OVER v AS w2, lead(w, 2) OVER v AS w3, lead(w, 3) OVER v AS w4 FROM words WINDOW v AS (PARTITION BY piece ORDER BY place)),
f AS (SELECT lang, w, count(*) AS f FROM (
 SELECT lang, [w1] AS w FROM runs UNION ALL SELECT lang, [w1, w2] FROM runs WHERE w2 IS NOT NULL
 UNION ALL SELECT lang, [w1, w2, w3] FROM runs WHERE w3 IS NOT NULL UNION ALL SELECT lang, [w1, w2, w3, w4] FROM runs WHERE w4 IS NOT NULL)
 GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
cuts AS (SELECT lang, w, f AS a, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
scored AS (SELECT c.lang, c.w, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score FROM cuts c
 JOIN f x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k+1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
inside AS (SELECT lang, w[i:i+m-1] AS w, max(f) AS most FROM (SELECT lang, w, f, m, unnest(range(1, len(w) - m + 2)) AS i
 FROM (SELECT lang, w, f, unnest(range(2, len(w))) AS m FROM f WHERE len(w) > 2)) GROUP BY ALL),
kept AS (SELECT lang, array_to_string(b.w, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN inside i USING (lang, w)
 WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000"""

_SEARCH = rf"""WITH found AS (SELECT d, doc_id, t, count(*) AS tf FROM (SELECT d, doc_id,
 unnest(regexp_extract_all(translate(text, {_SMALL}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
 FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)) GROUP BY ALL),
docs AS (SELECT d, doc_id, sum(tf)::BIGINT AS n FROM found GROUP BY ALL),
whole AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS len FROM docs),
m AS (SELECT d, 100 - 25 + ((25 * n * nd) // len) AS m FROM docs, whole),
terms AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id,
 unnest(regexp_extract_all(translate(text, {_SMALL}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * max(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM found, whole GROUP BY t),
scores AS (SELECT item_id, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
 FROM terms JOIN w USING (t) JOIN found USING (t) JOIN m USING (d) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20"""

_DEDUP = f"""SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
 row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), {_SMALL}) AS t FROM documents) WINDOW g AS (PARTITION BY t)"""

#: Operators whose whole result SQL can state.
CHECKS: dict[str, str] = {
    "op11_phrase_collocations": _COLLOCATIONS,
    "op12_ranked_lexical_search": _SEARCH,
    "op13_exact_dedup": _DEDUP,
}
