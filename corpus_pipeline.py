"""Corpus preparation: quality, lines, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of docs, whatever they are. Rows are told apart by their place in the files that docs is read from, so that
null and repeated ids are treated like any other: each row stays or goes by its own text. Null and empty texts are
texts without words: quality scores them, line dedup leaves them as one empty line (null becomes empty), near_dedup
keeps one of them, no benchmark item is found in them, and packing gives them the room of an end. An empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.common import clear, keyed, made, scratch, table
from matchlake.llm.decontaminate import contaminated
from matchlake.llm.lines import drop_frequent_lines
from matchlake.llm.packing import pack, word_lengths
from matchlake.llm.quality import quality_scores
from matchlake.llm.simhash import near_duplicate_groups


KEY = "row_key_of_stage"


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, with KEY, without the rows named in gone(row)."""
    return docs.join(gone.select(F.col("row").alias(KEY)).distinct(), KEY, "left_anti").drop(KEY)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    own = keyed(docs, KEY)
    return _without(own, quality_scores(own, table(spark, sf_dir, "labels"), row_col=KEY).filter("predicted = 0")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go; n_chars, where there is one, follows the text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kept = drop_frequent_lines(docs, min_docs=10, carry=rest)
    kept = kept.toDF("doc_id", "lines_before", "lines_gone", "text", *rest)
    if "n_chars" in rest:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, that of the smallest id."""
    own = keyed(docs, KEY)
    return _without(own, near_duplicate_groups(own, row_col=KEY).filter("NOT stays")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    own = keyed(docs, KEY)
    return _without(own, contaminated(own, table(spark, sf_dir, "benchmark"), row_col=KEY)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces stand in the training sequences."""
    return pack(word_lengths(docs))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]
#: SQL can't express the first stage; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's table is the next one's docs, and what was written besides is deleted once that is there."""
    docs, start = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        found, path = stage(spark, docs, sf_dir), scratch(spark, f"stage-{name}")
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        clear(spark, since=start, keep=(path,))
    return docs
