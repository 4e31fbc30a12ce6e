"""Phrase collocations from suffix subtrees, each of which fits into a task.

The text is the string of all words; its suffixes are cut off after the longest phrase and at the end of their piece.
Which suffixes make up a subtree follows from their first words alone (vertical partitioning): a word that begins no
more suffixes than the memory budget allows is a prefix; one that begins more is split into pairs, a pair into triples,
and so on. Words are counted exactly for that, pairs and triples only where all their words are over the budget, as no
other can be. Prefixes are then dealt into groups, as many as there are budgets. A group's suffixes go to one task,
merged where they are equal within a batch, and its subtree is built there depth by depth: a node's count is the sum of
the leaves below it, and what lies below a node of too few is never built. Nodes above a split prefix are summed over
their groups.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import LOWER, small_batches, stored
from matchlake.llm.shingles import xxh64_spans

#: Suffixes in a group that a task builds its subtree from; more only if there would be over MOST_PREFIXES groups.
BUDGET = 1 << 19
MOST_PREFIXES = 1 << 20
#: Groups for each partition at least, so that they even out.
SHARE = 4
#: Bytes of text taken at a time, up to the end of a piece.
STRETCH = 4 << 20

#: Characters that end a piece, and what stands between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes(10 if b in ENDS else 32 if b in BLANKS else LOWER[b] for b in range(256))


def pieces(texts: list[bytes]) -> Iterator[bytes]:
    """The texts in stretches, with a newline after each piece that has words and one blank between words."""
    own = b"\n".join(texts).translate(_TABLE)
    start = 0
    while start < len(own):
        stop = own.find(b"\n", min(start + STRETCH, len(own)))
        stop = len(own) if stop < 0 else stop
        part = re.sub(rb" *\n[ \n]*", b"\n", re.sub(rb"  +", b" ", own[start:stop])).strip(b" \n")
        if part:
            yield part
        start = stop


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, stretch) of a batch of (lang, text)."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        texts.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
    for lang, own in texts.items():
        for part in pieces(own):
            yield lang, part


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of a stretch: where they begin and end, their hashes, and the last word of the piece of each."""

    def __init__(self, part: bytes, seed: int):
        own = np.frombuffer(part, np.uint8)
        gap = np.flatnonzero((own == 32) | (own == 10))
        self.begin, self.end = np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(own)]])
        closing = np.append(np.flatnonzero(own[gap] == 10), len(gap))
        self.last = np.repeat(closing, np.diff(closing, prepend=-1))
        self.hash = xxh64_spans(part, self.begin, self.end, seed)

    def key(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Hash of so many words from each place."""
        out = np.full(len(at), depth, np.uint64)
        for i in range(depth):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + self.hash[at + i])
        return out


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h, n) of docs(lang, text); h is the word's XXH64."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part in _by_lang(batch):
                number = Counter(part.split())
                h = np.array([xxhash.xxh64_intdigest(w, seed) for w in number], np.uint64).view(np.int64)
                word = pa.array(list(number), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), word, pa.array(h), pa.array(list(number.values()), pa.int64())], names=["lang", "word", "h", "n"])

    return docs.mapInArrow(work, "lang string, word string, h long, n long").groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("n"))


def _arrays(rows) -> dict[str, np.ndarray]:
    """lang -> sorted hashes, of rows (lang, h)."""
    found: dict[str, list[int]] = {}
    for lang, h in rows:
        found.setdefault(lang, []).append(h)
    return {k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in found.items()}


def _among(keys: np.ndarray, some: np.ndarray | None) -> np.ndarray:
    if some is None or not len(some):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(some, keys), len(some) - 1)
    return some[at] == keys


def split_prefixes(docs: DataFrame, heavy: dict[str, np.ndarray], budget: int, depth: int, seed: int) -> dict[int, dict[str, np.ndarray]]:
    """depth -> lang -> keys of the phrases of 1 to depth - 1 words that begin more suffixes than the budget."""
    if not heavy:
        return {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part in _by_lang(batch):
                if lang not in heavy:
                    continue
                words = Words(part, seed)
                at = np.flatnonzero(_among(words.hash, heavy[lang]))
                is_heavy = np.zeros(len(words.hash) + 1, bool)
                is_heavy[at] = True
                for d in range(2, depth):
                    at = at[(at + d - 1 <= words.last[at]) & is_heavy[np.minimum(at + d - 1, len(words.hash))]]
                    key, n = np.unique(words.key(at, d), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array([d] * len(key), pa.int32()), pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "d", "h", "n"])

    found = docs.mapInArrow(work, "lang string, d int, h long, n long").groupBy("lang", "d", "h").agg(F.sum("n").alias("n")).filter(F.col("n") > budget).collect()
    return {d: _arrays((r.lang, r.h) for r in found if r.d == d) for d in range(2, depth)}


def suffixes(docs: DataFrame, heavy: dict[str, np.ndarray], split: dict[int, dict[str, np.ndarray]], groups: dict[str, int], depth: int, seed: int) -> DataFrame:
    """(lang, grp, lines, counts): the distinct suffixes of a batch that go to a group, a line each, and how often they stand there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part in _by_lang(batch):
                words = Words(part, seed)
                at = np.flatnonzero(words.last > np.arange(len(words.last)))  # a single word is counted as a word
                size = np.minimum(words.last[at] - at + 1, depth)
                prefix, deep = words.key(at, 1), _among(words.hash[at], heavy.get(lang))
                for d in range(2, depth + 1):
                    deep = np.flatnonzero(deep)
                    deep = deep[size[deep] >= d]
                    if not len(deep):
                        break
                    prefix[deep] = own = words.key(at[deep], d)
                    more = np.zeros(len(at), bool)
                    more[deep] = _among(own, split.get(d, {}).get(lang))
                    deep = more
                group = (prefix % np.uint64(groups.get(lang, 1))).astype(np.int64)
                whole = np.zeros(len(at), np.uint64)
                for d in range(2, depth + 1):
                    whole[size == d] = words.key(at[size == d], d)
                _, first, which, n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                as_first, same = first[which], size == size[first[which]]
                for i in range(depth):
                    far = np.flatnonzero(same & (size > i))
                    same[far] = words.hash[at[far] + i] == words.hash[at[as_first[far]] + i]
                if not same.all():  # different suffixes of the same hash: none is merged
                    first, n = np.arange(len(at)), np.ones(len(at), np.int64)
                by = np.argsort(group[first], kind="stable")
                first, n = first[by], n[by].astype(np.int32)
                begin, end = words.begin[at[first]].tolist(), words.end[at[first] + size[first] - 1].tolist()
                lines = [part[a:b] for a, b in zip(begin, end)]
                own = group[first]
                edge = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
                bounds = list(zip(edge, [*edge[1:], len(own)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(edge), pa.string()), pa.array(own[edge], pa.int64()), pa.array([b"\n".join(lines[a:b]) for a, b in bounds], pa.binary()), pa.array([n[a:b].tobytes() for a, b in bounds], pa.binary())],
                    names=["lang", "grp", "lines", "counts"],
                )

    return docs.mapInArrow(work, "lang string, grp long, lines binary, counts binary")


def subtree(part: bytes, counts: np.ndarray, least: int, depth: int, seed: int, split: dict[int, np.ndarray]) -> Iterator[tuple[list[bytes], int, np.ndarray]]:
    """(phrases, words, counts) of the nodes at each depth from 2 on with at least so many suffixes, or split over groups."""
    words = Words(part, seed)
    last = np.unique(words.last)
    first = np.concatenate([[0], last[:-1] + 1])
    size = last - first + 1
    node = np.unique(words.hash[first], return_inverse=True)[1]
    keep = (np.bincount(node, counts)[node] >= least) | _among(words.hash[first], split.get(1))
    for d in range(2, depth + 1):
        keep &= size >= d
        first, size, counts, node = (x[keep] for x in (first, size, counts, node))
        if not len(first):
            return
        word = np.unique(words.hash[first + d - 1], return_inverse=True)[1]
        _, at, node = np.unique(node * (int(word.max()) + 1) + word, return_index=True, return_inverse=True)
        total = np.bincount(node, counts).astype(np.int64)
        enough = (total >= least) | _among(words.key(first[at], d), split.get(d))
        rows = first[at[enough]]
        yield [part[a:b] for a, b in zip(words.begin[rows].tolist(), words.end[rows + d - 1].tolist())], d, total[enough]
        keep = enough[node]


def phrase_counts(docs: DataFrame, least: int = 30, depth: int = 4, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of the phrases of up to depth words found at least so often, (lang, total) of all words).

    docs has lang and text, neither of them null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    for seed in range(100):
        vocabulary = stored(word_counts(docs, seed), "vocabulary")
        if vocabulary.groupBy("lang", "h").count().filter("count > 1").isEmpty():  # else words that share a hash would be taken for one
            break
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("total"))
    every = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    budget = max(1, min(budget, every // (SHARE * parts)), every // MOST_PREFIXES)
    heavy = _arrays(vocabulary.filter(F.col("n") > budget).select("lang", "h").collect())
    split = {1: heavy} | split_prefixes(docs, heavy, budget, depth, seed)
    groups = {r.lang: -(-r.total // budget) for r in totals.filter(F.col("total") > budget).collect()}

    def build(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(rows)
        lang = key[0].as_py()
        part = b"\n".join(x for r in rows for x in r.column("lines").to_pylist())
        counts = np.concatenate([np.frombuffer(x, np.int32) for r in rows for x in r.column("counts").to_pylist()])
        for phrases, d, n in subtree(part, counts, least, depth, seed, {d: x[lang] for d, x in split.items() if lang in x}):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array([d] * len(n), pa.int32()), pa.array(n)], names=["lang", "phrase", "words", "n"])

    nodes = suffixes(docs, heavy, split, groups, depth, seed).groupBy("lang", "grp").applyInArrow(build, "lang string, phrase string, words int, n long")
    longer = nodes.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    single = vocabulary.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    return stored(longer.unionByName(single), "phrases"), totals


def _part(first, last):
    """Words first to last of the phrase, counted from 1."""
    return F.array_join(F.slice(F.split("phrase", " "), first, last - first + 1), " ")


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, depth: int = 4, inside: int = 80, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each lang whose words stand together most.

    a, l and r are how often the phrase, its first part and its rest are found, n counts all words of the lang; the
    score is floor(2000000 * a / (l + r)) at the cut where that is least, the first one of ties. A phrase inside a
    longer one that is found at least `inside` of a hundred times as often is dropped. Ties of the score go by a, then
    by the phrase's bytes. A null lang is `und`; null and empty texts have no words. Repeated rows count as often as
    they stand there. Further columns of docs don't matter, whatever their names. An empty table gives an empty table.
    """
    own = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text <> ''")
    phrases, totals = phrase_counts(own, least, depth, budget)
    candidate = phrases.filter("words > 1").withColumnRenamed("n", "a")
    cut = candidate.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cut = cut.withColumns({"left": _part(F.lit(1), F.col("k")), "right": _part(F.col("k") + 1, F.col("words"))})
    count = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cut = cut.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"])
    score = F.expr("CAST(CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (l + r) AS LONG)")
    scored = cut.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    inner = [F.struct(_part(F.lit(i), F.lit(i + d - 1)).alias("phrase"), F.col("words").alias("words")) for d in range(2, depth) for i in range(1, depth - d + 2)]
    within = candidate.filter("words > 2").select("lang", "a", F.explode(F.filter(F.array(*inner), lambda x: F.size(F.split(x["phrase"], " ")) < x["words"])).alias("x"))
    around = within.groupBy("lang", F.col("x.phrase").alias("phrase")).agg(F.max("a").alias("around"))
    left = scored.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(inside) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("total").alias("n"), F.col("best.score").alias("score"))
