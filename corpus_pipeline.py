"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``, whatever other columns there are.  Texts that are null or empty have no language and
go with the first stage.  Rows with a null id are documents of their own: they are never near copies
of others, and rank last where passages repeat.  Rows repeated under one id stay or go together, and
of equal documents the one with the smallest id stays.  An empty table gives an empty result at every stage.
This module is part of ``cardspark.llm`` and can't be imported without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardspark.llm import language_id, toxicity
from cardspark.llm.common import checkpointed, documents, table, tokenizer_path, unused_names
from cardspark.llm.ngram_join import similar_documents
from cardspark.llm.packing import pack
from cardspark.llm.substring_dedup import remove_repeated


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known; the models are learnt from the rows that name theirs."""
    return language_id.accepted(docs, language_id.fit(docs, "text", "lang"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score below one half; the lexicon is learnt from the labelled ones."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; rows repeated under one id are one document."""
    groups = similar_documents(docs, percent=75)
    gone = checkpointed(groups.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand in an earlier document out of the later ones."""
    (spans,) = unused_names(docs, "spans")
    cut = remove_repeated(docs, spans_column=spans)
    size = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return cut.withColumn("n_chars", size).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; workers that ran the other stages have less memory left."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, window=4096, memo_words=150_000, slice_bytes=2 << 20)


STAGES = [
    ("language_id", identify_languages),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Models and tokenizers can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written before the next reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
