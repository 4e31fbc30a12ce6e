"""Quality classifier by positive-unlabelled learning.

Positives are texts labelled good, the unlabelled set is text of any kind. A first model tells the two apart; its
highest scores, where hardly any bad text is, give the class prior. The classifier then minimises the non-negative
unbiased risk: prior * loss on positives + max(0, negative loss on unlabelled - prior * negative loss on positives).
Labels of bad texts are not used at all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import fold_of_doc, small_batches, stored

#: Rows of each kind, at most, that the model is fitted on; they are those of the least hash of their id.
FIT_ROWS = 20_000
FOLDS = 5
KNOTS = 7
#: Score from which a text counts as good.
GOOD = 0.3

FEATURES = (
    "log_chars", "log_words", "upper", "digit", "blank", "line_end", "stop", "symbol", "control", "beyond_ascii",
    "word_mean", "word_spread", "word_max", "types", "top_word", "same_again", "pair_types", "triple_types",
    "shout", "symbol_word", "lone_symbol", "line_types", "line_words", "stop_word",
)


def _kinds() -> np.ndarray:
    kind = np.full(256, 5, np.uint8)  # symbols
    for k, chars in enumerate((bytes(range(65, 91)), bytes(range(48, 58)), b" ", b"\n", b".,;:?'\"-()")):
        kind[list(chars)] = k
    kind[list(range(97, 123))] = 6
    kind[[*range(0, 10), *range(11, 32), 127]] = 7
    kind[128:] = 8
    return kind


KIND = _kinds()
SYMBOLS = bytes(b for b in range(256) if KIND[b] == 5)
NO_SYMBOL = bytes.maketrans(SYMBOLS, b" " * len(SYMBOLS))


def describe(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES. An empty text has zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(KIND[np.frombuffer(data, np.uint8)], minlength=9) / n
    words = data.split()
    m = len(words)
    if not m:
        return [float(np.log1p(n)), 0.0, *kinds[[0, 1, 2, 3, 4, 5, 7, 8]].tolist()] + [0.0] * (len(FEATURES) - 10)
    size = np.fromiter(map(len, words), np.float64, m)
    count = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    triples = len(set(zip(words, words[1:], words[2:])))
    again = sum(map(bytes.__eq__, words, words[1:]))
    shout = sum(map(bytes.isupper, words))
    plain = data.translate(NO_SYMBOL).split()
    lines = data.split(b"\n")
    with_symbol = len([w for w in count if w.translate(None, SYMBOLS) != w])
    lone = sum(c for w, c in count.items() if not w.translate(None, SYMBOLS))
    ends = sum(c for w, c in count.items() if w[-1] in b".!?")
    return [
        float(np.log1p(n)), float(np.log1p(m)), *kinds[[0, 1, 2, 3, 4, 5, 7, 8]].tolist(),
        float(size.mean()), float(size.std()), float(np.log(size.max())), float(np.log(len(count)) / np.log(m + 1)), max(count.values()) / m, again / m, pairs / m, triples / m,
        shout / m, with_symbol / len(count), lone / m + abs(len(plain) - m) / m, len(set(lines)) / len(lines), float(np.log1p(m / len(lines))), ends / m,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, f array<float>) for every row of docs, and row, where row_col names it; null texts are empty."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, f array<float>" + (f", row {docs.schema[row_col].dataType.simpleString()}" if row_col else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(describe(x), np.float32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.list_(pa.float32())), *batch.columns[2:]], names=["doc_id", "f", "row"][: batch.num_columns])

    return docs.select(F.col(id_col).cast("long"), text_col, *([row_col] if row_col else [])).mapInArrow(work, schema)


class Model:
    """A linear model of hinges: each feature, and what it exceeds each of its knots by."""

    def __init__(self, sample: np.ndarray):
        steps = np.quantile(sample, np.linspace(0.01, 0.99, KNOTS), axis=0)
        self.low, self.knots = steps[0], steps
        wide = self._hinges(sample)
        self.mean, self.spread = wide.mean(axis=0), wide.std(axis=0) + 1e-6
        self.weight, self.bias = np.zeros(wide.shape[1]), 0.0

    def _hinges(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, *(np.maximum(x - k, 0) for k in self.knots)]).astype(np.float32)

    def wide(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self._hinges(x) - self.mean) / self.spread, -8, 8).astype(np.float32)

    def raw(self, wide: np.ndarray) -> np.ndarray:
        return wide @ self.weight.astype(np.float32) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.wide(x)).astype(np.float64), -40, 40)))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, rounds: int = 400, rate: float = 0.03) -> Model:
        """Adam on the logistic loss, with weights held smaller the fewer rows there are; without a prior positives are told from unlabelled texts."""
        decay = 1e-4 + 5 / len(positive)
        p, u = self.wide(positive), self.wide(unlabelled)
        theta = np.zeros(p.shape[1] + 1)
        m, v = np.zeros_like(theta), np.zeros_like(theta)

        for t in range(1, rounds + 1):
            g = self.gradient(theta, p, u, prior)
            g[:-1] += decay * theta[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weight, self.bias = theta[:-1], float(theta[-1])
        return self

    def gradient(self, theta: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float | None) -> np.ndarray:
        """Of the risk on wide positives and unlabelled rows; where its negative part is under 0, the step that raises that part."""
        self.weight, self.bias = theta[:-1], theta[-1]
        sp, su = (1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40))) for x in (p, u))
        mean = lambda wide, each: np.append(wide.T @ each.astype(np.float32), each.sum()) / len(wide)
        good, bad_p, bad_u = mean(p, sp - 1), mean(p, sp), mean(u, su)
        if prior is None:
            return good + bad_u
        negative = -np.log1p(-np.minimum(su, 1 - 1e-7)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-7)).mean()
        return prior * good + (bad_u - prior * bad_p) if negative >= 0 else prior * bad_p - bad_u


def thresholds(positive: np.ndarray) -> np.ndarray:
    """Scores that all to a fifth of the positives reach."""
    return np.quantile(positive, np.linspace(0, 0.8, 81))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of good texts among the unlabelled ones, from how many of each set reach 0, 1, 2 ... of the thresholds.

    For any t the share of unlabelled scores of at least t is at least prior * that of positives; the least ratio over
    all thresholds, with a margin for chance, is the estimate.
    """
    reach = lambda n: (n.sum() - np.cumsum(n)[:-1]) / n.sum()
    p, u = reach(positive), reach(unlabelled)
    some = p > 0
    margin = np.sqrt(p * (1 - p) / positive.sum()) + np.sqrt(u * (1 - u) / unlabelled.sum())
    return float(np.clip(np.min((u + margin)[some] / p[some], initial=0.99), 0.05, 0.99))


def fit_model(found: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", label_col: str = "quality") -> tuple[Model, float] | None:
    """The model and the prior, from features of rows outside the held-out fold; None if there are no positives.

    Gradients are those of at most fit_rows positives and as many unlabelled rows; the prior comes from the scores of
    all rows, counted between thresholds. A document with labels that disagree, or null, is no positive.
    """
    train = found.filter(F.col("doc_id").isNotNull() & (fold_of_doc(F.col("doc_id"), FOLDS) != 0)).select("doc_id", "f")
    good = labels.select(F.col(id_col).cast("long").alias("of"), F.col(label_col).alias("label")).filter("of IS NOT NULL")
    good = good.groupBy("of").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least = 1 AND most = 1").select("of")
    known = lambda df: df.join(good, df.doc_id == good.of, "left_semi")
    pick = lambda df: df.select(F.xxhash64("doc_id").alias("r"), "doc_id", "f").orderBy("r", "doc_id").limit(fit_rows).toArrow().column("f").combine_chunks()
    matrix = lambda column: column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)
    positive = matrix(pick(known(train)))
    unlabelled = matrix(pick(train))
    if not len(positive):
        return None
    model = Model(np.vstack([positive, unlabelled])).fit(positive, unlabelled, None, rounds=200)
    at = thresholds(model.score(positive))
    first = found.sparkSession.sparkContext.broadcast(model)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(at, first.value.score(matrix(batch.column(1))), "right"))], names=["doc_id", "n"])

    scored = train.mapInArrow(reached, "doc_id long, n long")
    counts = np.zeros((2, len(at) + 1))
    for i, rows in enumerate((known(scored), scored)):
        for r in rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect():
            counts[i, r["n"]] = r["rows"]
    prior = class_prior(*counts)
    return model.fit(positive, unlabelled, prior), prior


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    held_out: crc32 of the id as text is divisible by 5; labels of such rows are not learned from. The model is fitted
    on at most fit_rows positives and as many unlabelled rows; the prior, counts and scores cover all rows. Null texts
    are empty ones. Without any positive label every score is 0.5. Repeated rows give equal results, an empty table
    none; further columns are not read. A column named by row_col, which tells rows apart where ids don't, is returned
    as row.
    """
    spark = docs.sparkSession
    found = stored(features(docs, id_col, text_col, row_col), "quality-features")
    fitted = fit_model(found, labels, fit_rows, id_col)
    model = spark.sparkContext.broadcast(fitted[0] if fitted else None)
    row = ["row"] if row_col else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)
            score = model.value.score(x) if model.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *batch.columns[2:]], names=["doc_id", "score", *row])

    scored = found.mapInArrow(work, "doc_id long, score double" + "".join(f", row {found.schema['row'].dataType.simpleString()}" for _ in row))
    return scored.select("doc_id", (fold_of_doc(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"), *row)
