"""A corpus pipeline of five operators: quality, repeated lines, near copies, the mix of sources, token ids.

Each stage takes all that the one before it kept and returns the columns of documents; the last one returns ids and digests. Stages share nothing: each deletes the tables it makes on its way
before it returns, but for small ones (keys, spans, sizes; no texts) that its result reads, so results may be read in any order and at any time.

Edge cases, beyond those that each operator states: a null text is empty and is judged like any other, so most are rejected by the first stage; rows with a
null doc_id take part (of equal ones one stays in the third stage); without labels every document scores 0.5 and stays; empty tables pass through
as empty tables; columns besides those of documents, whatever their names, reach the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import bpe, lines, mixing, near, quality
from fieldloom.llm.queries import tokenizer_path
from fieldloom.llm.shared import documents, materialize, release


#: An eighth of what the encoder takes alone: workers stay, and the stages share an executor's memory with it.
CACHE_BYTES = 1 << 25


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of line runs; those of which nothing is left go."""
    return lines.dedup(docs)


def one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles at similarity 0.8 or more, found by SimHash balls."""
    return near.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row for every copy taken, in order of virtual finish time."""
    return mixing.apply(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, and digests of them and of what they decode to."""
    return bpe.round_trip(docs, tokenizer_path(), ids=True, cache_bytes=CACHE_BYTES)


STAGES = [("quality classifier", good), ("line dedup", new_lines), ("SimHash near-dedup", one_copy), ("source mix", mixed), ("BPE", encoded)]

#: SQL has neither the classifier nor the tokenizer; tests hold each stage's operator against brute force, and the third stage also on the pipeline's own rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's table goes once the next one is written."""
    out = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, out = out, materialize(stage(spark, out, sf_dir), f"stage-{k}")
        release(before)
    return STAGES[-1][1](spark, out, sf_dir)
