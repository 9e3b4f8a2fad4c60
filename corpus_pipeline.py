"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

1. quality classifier: learned on the labels; documents it rejects go.
2. line dedup: later copies of runs of lines are deleted from the texts; a document of
   which nothing but white space is left goes.
3. n-gram Jaccard join: five-word shingles, similarity 0.8; of each group of near
   duplicates the document with the smallest key stays.
4. substring dedup: repeated spans of sentences are deleted; a document of which nothing
   but white space is left goes.
5. packing: what is left becomes sequences of token ids.

All but the last return the columns of ``documents``; ``n_chars`` follows a changed text.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import line_dedup, ngram_join, packing, quality, spans
from foldwise.llm.common import stash, table, text_crc, unused
from foldwise.llm.queries import END_ID, tokenizer

WORDS, NUM, DEN = 5, 80, 100


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; labels of every fifth key are held out."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), text_crc("doc_id") % 5 != 0)
    out = unused("score", docs.columns)
    return quality.score(docs, model, keep=docs.columns, out=out).where(F.col(out) >= quality.THRESHOLD).select(*docs.columns)


def _cleaned(docs: DataFrame, dedup) -> DataFrame:
    """``docs`` with the texts that ``dedup`` leaves; those with nothing left but white space go.
    A text that loses nothing stays as it is, also an empty one."""
    counts = (unused("n_parts", docs.columns), unused("n_removed", docs.columns))
    out = dedup(docs, counts=counts)
    changed = F.col(counts[1]) > 0
    out = out.where(~changed | F.col("text").rlike("\\S"))
    chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def lines_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _cleaned(docs, line_dedup.dedup_lines)


def near_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group; those without a word have no shingle and all stay."""
    return ngram_join.keep_one(docs, words=WORDS, num=NUM, den=DEN)


def spans_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _cleaned(docs, partial(spans.dedup_spans, both_ends=True))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document tokenised and packed into sequences."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), END_ID)


STAGES = [("quality classifier", classified), ("line dedup", lines_deduped), ("n-gram join", near_deduped),
          ("substring dedup", spans_deduped), ("packing", packed)]

#: The classifier stage cannot be written in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, f"stage-{name.replace(' ', '-')}")
    return docs
