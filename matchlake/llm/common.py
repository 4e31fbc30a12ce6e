"""Helpers that the operators share: reading tables, scratch space, text words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else; safe on UTF-8 because continuation bytes are above 0x7F.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts may be very long, so Arrow batches are bounded by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="matchlake-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; one without is where Spark itself would look for it."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


#: Scratch folders of this driver, in the order in which they were made.
_made: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def made() -> int:
    """How many scratch folders there are, for clear()."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the scratch folders made since then, once nothing that is still to be read comes from them."""
    for path in [p for p in _made[since:] if p not in keep]:
        _made.remove(path)
        delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table in the shared folder and read it back; for results that are larger than a checkpoint should be."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, name: str = "row_key") -> DataFrame:
    """docs with a column that tells its rows apart however often they are read: the file's hash and the place in it.

    Other tables than those read from Parquet files are written first.
    """
    try:
        own = docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(name))
        own.schema  # noqa: B018  resolves the columns
        return own
    except AnalysisException:
        return keyed(stored(docs, "keyed"), name)


def stretches(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about `most` characters together; a longer text is a run of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def fold(column):
    """Spark column with A-Z lower-cased, other letters kept."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A key with more than this share of the rows is joined apart; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001


def hot_keys(left: DataFrame, key: str) -> list:
    """The keys of over HOT_SHARE of the rows; none of a table of fewer than 1 / HOT_SHARE rows."""
    number = left.groupBy(key).agg(F.count(F.lit(1)).alias("hot_n")).filter(F.col(key).isNotNull())
    total = number.agg(F.coalesce(F.sum("hot_n"), F.lit(0)).alias("n")).first()["n"]
    return [r[0] for r in number.filter(F.col("hot_n") > max(1, int(total * HOT_SHARE))).select(key).collect()] if total >= 1 / HOT_SHARE else []


def join_apart(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """left joined with right on key; rows of the hot keys go to the workers with their row of right, the others are shuffled by key."""
    if not hot:
        return left.join(right, key, how)
    apart = left.sparkSession.createDataFrame([(k,) for k in hot], left.select(key).schema)
    few = right.join(F.broadcast(apart), key, "left_semi")
    rest = left.join(F.broadcast(apart), key, "left_anti").join(right, key, how)
    return left.join(F.broadcast(apart), key, "left_semi").join(F.broadcast(few), key, how).unionByName(rest)


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right on key, where right has one row a key and left may have very many of one key.

    Keys that hold over HOT_SHARE of the rows of left, of which there cannot be more than 1 / HOT_SHARE, go to the
    workers with their row of right; the other rows are shuffled by key.
    """
    return join_apart(left, right, key, hot_keys(left, key), how)


def fold_of_doc(column, buckets: int):
    """crc32 of the id as text, modulo buckets."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)
