"""Line dedup on levelled sorted runs.

A store of runs, each a table of line hashes with the number of documents that hold the line. Runs are bucketed by the
hash and sorted within the buckets, all into the same number of buckets, so that Spark merges them where they lie,
without shuffling or sorting them again. The lines of a new batch of documents are counted into these buckets,
merge-anti-joined with the lines whose fate is settled (found often enough already), and the rest becomes a run of the
lowest level. When a level has FANOUT runs they are merged into one run of the next level, and the lines that reach
the threshold move to the settled run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.common import LOWER, delete, scratch, small_batches, stored

FANOUT = 2
#: Settled lines up to this number (16 bytes each) are given to each worker; more are joined by shuffle.
FEW_SETTLED = 200_000
KEY = ["h", "g"]
SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: Fixed value: the characters stripped at both ends of a line.
SPACE = b" \t\n\r\x0b\x0c"


def line_key(line: bytes) -> bytes:
    return line.translate(LOWER).strip(SPACE)


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int = 1, batches: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, batch, h, g): the 128-bit hashes of the distinct line keys of each row of docs, in two longs.

    Rows are dealt to batches by their id, those without one by the length of their text.
    """
    small_batches(docs.sparkSession)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, lots, found = [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                keys = {line_key(x) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")}
                keys = [_hash(k) for k in keys if _long_enough(k, min_chars)]
                found += keys
                ids += [doc_id] * len(keys)
                lots += [(len(text or "") if doc_id is None else doc_id) % batches] * len(keys)  # documents, not lines, make up a batch
            hashes = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lots, pa.int32()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], names=["doc_id", "batch", "h", "g"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, "doc_id long, batch int, h long, g long")


class LineRuns:
    """The levelled store. Runs are bucketed tables in the shared folder; the driver holds their names and levels only."""

    def __init__(self, spark: SparkSession, min_docs: int):
        self.spark, self.min_docs, self.dir = spark, min_docs, scratch(spark, "line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []
        self.made = 0
        # a bucket of a run is one sorted file; Spark takes files as sorted only if it is told to, until the store is closed
        self.sorted = spark.conf.get(SORTED, None)
        spark.conf.set(SORTED, "true")

    def _write(self, run: DataFrame, kind: str) -> str:
        """Write a run that is dealt out as the buckets are; its name."""
        self.made += 1
        name = f"{kind}_{self.made}_{self.dir.rpartition('-')[2]}"
        run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.dir}/{name}").saveAsTable(name)
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def _merge(self, a: str, b: str) -> DataFrame:
        """Two runs as one, by a merge join of their sorted buckets."""
        more = self._read(b).withColumnRenamed("n", "more").hint("merge")
        return self._read(a).join(more, KEY, "full_outer").select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("n"))

    def _merged(self, names: list[str]) -> str:
        """The name of the one run that all become; they are gone then."""
        while len(names) > 1:
            a, b, *rest = names
            names = [self._write(self._merge(a, b), "merged"), *rest]
            self._drop([a, b])
        return names[0]

    def batch(self, lines: DataFrame) -> DataFrame:
        """(h, g, n) of a batch without the settled lines, counted in part before they are dealt out as the buckets are."""
        counted = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        for name in self.settled:
            # not an anti-join by name: Spark would move that ahead of the counting, and shuffle every line
            known = self._read(name).select(*KEY, F.lit(True).alias("known"))
            counted = counted.join(known.hint("merge"), KEY, "left").filter("known IS NULL").drop("known")
        return counted

    def add(self, lines: DataFrame) -> None:
        """Add the (h, g) of a batch, one row for each document that holds the line."""
        self.levels[0].append(self._write(self.batch(lines), "run"))
        level = 0
        while len(self.levels[level]) >= FANOUT:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge the runs of a level into one of the next, and settle what has reached the threshold, with what is settled so far."""
        names, self.levels[level] = self.levels[level], []
        if len(self.levels) == level + 1:
            self.levels.append([])
        whole = self._merged(names)
        self.levels[level + 1].append(self._write(self._read(whole).filter(F.col("n") < self.min_docs), "run"))
        self._settle(whole)

    def _settle(self, run: str) -> None:
        """Lines of a run that are found often enough join the settled run; the run is gone then."""
        fresh = self._write(self._read(run).filter(F.col("n") >= self.min_docs), "settled")
        self._drop([run])
        self.settled = [self._merged([*self.settled, fresh])]

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, f"{self.dir}/{name}")

    def finish(self) -> DataFrame:
        """Settle everything that all runs together decide; the settled lines (h, g, n)."""
        names = [x for level in self.levels for x in level]
        self.levels = [[]]
        if names:
            self._settle(self._merged(names))
        return self._read(self.settled[0])

    def close(self) -> None:
        """Forget the settled run as well, once it isn't read any more."""
        self._drop(self.settled)
        self.settled = []
        self.spark.conf.set(SORTED, self.sorted) if self.sorted else self.spark.conf.unset(SORTED)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _cut_lines(text: str | None, drop, min_chars: int) -> tuple[int, int, str]:
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    kept = [x for x in lines if not (_long_enough(k := line_key(x), min_chars) and _hash(k) in drop)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8", "surrogatepass")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", few_settled: int = FEW_SETTLED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept for every row of docs: its lines without those found in at least min_docs rows.

    Null texts are one empty line, as empty ones; empty lines (keys under min_chars code points) always stay. Every
    row counts as a document, also a repeated one. An empty table gives no rows. The columns named in carry follow as
    they are, whatever their names; others are not read. Up to few_settled lines to drop are given to each worker,
    beyond that documents are joined with their own.
    """
    spark = docs.sparkSession
    found = stored(line_hashes(docs, min_chars, batches, id_col, text_col), "lines")
    runs = LineRuns(spark, min_docs)
    for b in range(batches):
        runs.add(found.filter(F.col("batch") == b))
    settled = runs.finish()
    names = [f"carried_{i}" for i in range(len(carry))]
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)))
    carried = "".join(f", {n} {read.schema[n].dataType.simpleString()}" for n in names)
    known = None
    if settled.count() <= few_settled:
        rows = settled.select(*KEY).toArrow()
        runs.close()
        known = spark.sparkContext.broadcast(np.stack([rows.column(0).to_numpy(), rows.column(1).to_numpy()], axis=1).astype("<i8").tobytes())
    else:  # rows get a number of their own, as ids may be null or repeat
        read = stored(read.withColumn("line_row", F.monotonically_increasing_id()), "line-docs")
        own = line_hashes(read, min_chars, 1, "line_row", "text").withColumnRenamed("doc_id", "of")
        hits = stored(own.join(settled, KEY, "left_semi").groupBy("of").agg(F.collect_list(F.struct(*KEY)).alias("drop")), "line-hits")
        runs.close()
        read = read.join(hits, F.col("line_row") == F.col("of"), "left").drop("of", "line_row")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = {known.value[i : i + 16] for i in range(0, len(known.value), 16)} if known else set()
        for part in parts:
            drops = [every] * part.num_rows if known else ({np.array([x["h"], x["g"]], "<i8").tobytes() for x in own or ()} for own in part.column(part.num_columns - 1).to_pylist())
            rows = [_cut_lines(t, d, min_chars) for t, d in zip(part.column(1).to_pylist(), drops)]
            n, m, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(kept, pa.string()), *(part.column(2 + i) for i in range(len(names)))], names=["doc_id", "n_lines", "n_dropped", "kept", *names])

    out = read.mapInArrow(work, f"doc_id long, n_lines long, n_dropped long, kept string{carried}")
    return out.toDF("doc_id", "n_lines", "n_dropped", "kept", *carry)
