"""Thin queries of the operators over the standard tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardspark.llm import language_id, toxicity
from cardspark.llm.common import documents, table, tokenizer_path
from cardspark.llm.language_id import remainder
from cardspark.llm.ngram_join import similar_documents
from cardspark.llm.packing import pack
from cardspark.llm.range_join import linked_vectors
from cardspark.llm.substring_dedup import repeated_spans
from cardspark.llm.token_counts import token_counts
from cardspark.llm.top_k import top_k
from cardspark.llm.url_filter import SOFT_TERMS, STRICT_TERMS, filter_urls
from cardspark.llm.word_tokens import encode_decode


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), keep=("doc_id",))


def op2_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    return toxicity.score_toxicity(docs, lexicon, keep=("doc_id",)).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir), percent=75)


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), keep=("doc_id",), ids=False)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2, window=4096)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir)).drop("text_hash")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(remainder("doc_id", 4) != 2), "text", "lang")
    return language_id.identify(docs, model, keep=("doc_id",)).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


#: Host and path rules with their verdicts.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=("page_id",))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_embedding_range_join": op2_embedding_range_join,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_bpe_encode_decode": op5_bpe_encode_decode,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_packing": op7_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "pipeline": pipeline,
}


def _term(term: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])')::INT"


def _rule_sql() -> str:
    rows = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    return f"(VALUES {rows}) AS r(own, start, said)"


ORACLES: dict[str, str] = {
    "op2_embedding_range_join": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
                 AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
        SELECT v.vec_id, (SELECT count(*) FROM link WHERE a = v.vec_id)::BIGINT AS n_links,
               (SELECT min(b) FROM reach WHERE a = v.vec_id) AS component_id,
               v.vec_id = (SELECT min(b) FROM reach WHERE a = v.vec_id) AS kept
        FROM v""",
    "op6_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op10_url_filter": f"""
        WITH u AS (SELECT page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                          CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        t AS (SELECT *, ({" + ".join(map(_term, STRICT_TERMS))})::INT AS strict_hits, ({" + ".join(map(_term, SOFT_TERMS))})::INT AS soft_hits FROM p),
        f AS (SELECT t.*, r.own || r.start AS rule, r.said,
                     row_number() OVER (PARTITION BY page_id ORDER BY r.own IS NULL, length(r.own || r.start) DESC) AS k
              FROM t LEFT JOIN {_rule_sql()} ON (t.host = r.own OR suffix(t.host, '.' || r.own)) AND prefix(t.path, r.start))
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
               strict_hits, soft_hits FROM f WHERE k = 1""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
