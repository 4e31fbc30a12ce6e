"""Brown class-based bigrams: P(word | before) = P(class of word | class of before) * P(word | class of word).

Exchange clustering runs in two steps. The most frequent words, each on its own, and groups of all other words by
their last three bytes are units; in each round units move between classes, on counts of the classes around them that
Spark makes from the bigrams of units. Then every other word that is seen SEEN times or more is moved once: the classes
that stand before and after it are gathered for each word over the whole corpus, and it goes to the class where they
give the most mutual information. So the table of classes grows with the vocabulary. Rarer words, whose surroundings
say little, and words never seen keep the class of their ending; so does every word in the role of the word before,
where only the classes of units count. The probabilities sum to one all the same, as a word's class before and its own
are each a function of the word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.common import fold_of_doc, small_batches, stored, stretches, words

#: Words that are units of their own; groups of other words by their endings; classes besides that of the end.
OWN_UNITS, ENDINGS, CLASSES = 2048, 256, 64
#: Times that a word must be seen to go to a class of its own surroundings.
SEEN = 10
#: Most bits of the table that keeps most rarer words from being gathered.
SIEVE_BITS = 1 << 25
#: Most frequent words whose counts each worker knows; those of the others are joined.
KNOWN = 200_000
ROUNDS = 9
#: Distinct words, or bigrams, that a task counts before it hands them on.
HELD = 200_000
FOLDS = 10
END_CLASS = CLASSES


def ending(word: bytes) -> int:
    """The group of words by their endings."""
    return zlib.crc32(word[-3:]) % ENDINGS


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts(text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda c: pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], names=["word", "n"])
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count.update(words(text))
                if len(count) > HELD:
                    yield pack(count)
                    count = Counter()
        yield pack(count)

    return texts.mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Indices of the KNOWN most frequent words, by falling count, and the unit of every word."""

    def __init__(self, known: list[bytes], counts: list[int], own_units: int = OWN_UNITS):
        self.own, self.end, self.units = own_units, own_units + ENDINGS, own_units + ENDINGS + 1
        self.index = {w: i for i, w in enumerate(known)}
        self.count = np.array(counts, np.int64)
        self.words = pa.array(known, pa.binary())
        #: By index; from the end backwards those of the endings of words that aren't known.
        self.unit = np.array([i if i < self.own else self.own + ending(w) for i, w in enumerate(known)] + [*range(self.own, self.end)][::-1], np.int32)

    def read(self, texts: list) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Codes of the words of all texts (an index, or -1 less the number of the ending), words a text, and the unknown words of each."""
        every, size = [], []
        for text in texts:
            own = words(text)
            every += own
            size.append(len(own))
        code = np.fromiter(map(self.index.get, every, repeat(-1)), np.int32, len(every))
        at = np.flatnonzero(code < 0)
        rest = [every[i] for i in at.tolist()]
        code[at] = [-1 - ending(w) for w in rest]
        stop = np.searchsorted(at, np.cumsum(size)).tolist()
        return code, np.array(size, np.int64), [rest[a:b] for a, b in zip([0, *stop], stop)]


def encoded(read: DataFrame, lexicon) -> DataFrame:
    """read(doc_id, held_out, row, text) with the codes of its words instead of the text, and the words that aren't known."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in stretches(texts):
                code, size, rest = lexicon.value.read(texts[a:b])
                codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(code))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:3]), codes, pa.array(rest, pa.list_(pa.binary()))], names=["doc_id", "held_out", "row", "codes", "rest"])

    return read.select("doc_id", "held_out", "row", "text").mapInArrow(work, "doc_id long, held_out boolean, row long, codes array<int>, rest array<binary>")


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and how many each has."""
    return lists.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def with_ends(unit: np.ndarray, size: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit before, unit, text) of each token, ends included; an end stands before each text."""
    stop = np.cumsum(size)
    after = np.insert(unit, stop, end)
    before = np.insert(after[:-1], 0, end) if len(after) else after
    return before, after, np.repeat(np.arange(len(size)), size + 1)


def unit_bigrams(codes: DataFrame, lexicon) -> DataFrame:
    """(before, after, n) of units over all codes(codes); lexicon is a broadcast."""
    units = lexicon.value.units

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(held):
            code, n = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(n, weights=np.concatenate([x for _, x in held]), minlength=len(code)).astype(np.int64)

        def rows(code, n):
            return pa.RecordBatch.from_arrays([pa.array((code // units).astype(np.int32)), pa.array((code % units).astype(np.int32)), pa.array(n)], names=["before", "after", "n"])

        held: list = []
        for batch in batches:
            code, size = flat(batch.column(0))
            before, after, _ = with_ends(lexicon.value.unit[code], size, units - 1)
            held.append(np.unique(before.astype(np.int64) * units + after, return_counts=True))
            if sum(len(c) for c, _ in held) > 4 * HELD:
                held = [pack(held)]
                if len(held[0][0]) > 2 * HELD:
                    yield rows(*held.pop())
        if held:
            yield rows(*pack(held))

    return codes.mapInArrow(work, "before int, after int, n long").groupBy("before", "after").agg(F.sum("n").alias("n"))


def _around(bigrams: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each class stands before, and after, each unit: two tables of units x (CLASSES + 1)."""
    of = F.broadcast(bigrams.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(classes)], "unit int, class int"))
    left = bigrams.join(of, bigrams.before == of.unit).groupBy(F.lit(0).alias("side"), F.col("after").alias("of"), "class").agg(F.sum("n").alias("n"))
    right = bigrams.join(of, bigrams.after == of.unit).groupBy(F.lit(1).alias("side"), F.col("before").alias("of"), "class").agg(F.sum("n").alias("n"))
    rows = left.unionByName(right).toArrow()
    out = np.zeros((2, len(classes), CLASSES + 1))
    out[tuple(rows.column(i).to_numpy() for i in range(3))] = rows.column(3).to_numpy()
    return out[0], out[1]


def information(pairs: np.ndarray) -> float:
    """Mutual information of neighbouring classes, in log10 a token."""
    n = max(pairs.sum(), 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.nansum(pairs / n * np.log10(pairs * n / (pairs.sum(axis=1, keepdims=True) * pairs.sum(axis=0, keepdims=True)))))


def gains(left: np.ndarray, right: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """What each class gives to the mutual information for rows with so many of each class before and after them.

    own: the class that each row is in, out of whose counts its own are taken.
    """
    total, size = right.sum(axis=1), pairs.sum(axis=1)
    score = np.zeros((len(left), CLASSES))
    for k in range(CLASSES):
        inside = own == k
        into = np.log(np.maximum(pairs[:, k], 0) + 0.5)
        out = np.log(np.maximum(pairs[k], 0) + 0.5)
        score[:, k] = left @ into + right @ out - 2 * total * np.log(size[k] + 0.5 * (CLASSES + 1))
        if inside.any():
            x, y = left[inside], right[inside]
            into, out = np.log(np.maximum(pairs[:, k] - x, 0) + 0.5), np.log(np.maximum(pairs[k] - y, 0) + 0.5)
            rest = np.log(np.maximum(size[k] - total[inside], 0) + 0.5 * (CLASSES + 1))
            score[inside, k] = (x * into).sum(axis=1) + (y * out).sum(axis=1) - 2 * total[inside] * rest
    return score


def exchange(bigrams: DataFrame, units: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and the counts of class bigrams.

    A unit goes to the class where the classes around it give the most mutual information, with its own counts taken
    out of the class that it is in. In each round every other unit may move; the round of the most mutual information
    between neighbouring classes is kept. The end keeps its class.
    """
    classes = np.arange(units) % CLASSES
    classes[-1] = END_CLASS
    one, best = np.eye(CLASSES + 1), (-np.inf, classes, None)
    for turn in range(rounds + 1):
        left, right = _around(bigrams, classes)
        pairs = one[classes].T @ right  # class before x class after
        if (gain := information(pairs)) > best[0]:
            best = gain, classes, pairs
        score = gains(left, right, classes, pairs)
        moved = np.where((np.arange(units) % 2 == turn % 2) & (right.sum(axis=1) > 0), score.argmax(axis=1), classes)
        moved[-1] = END_CLASS
        classes = moved
    return best[1], best[2]


#: A row of a profile is a byte for each neighbour: its class, and for those after the word SIDE more.
SIDE = CLASSES + 1


def surroundings(codes: DataFrame, counts: DataFrame, lexicon, classes: np.ndarray, seen: int) -> DataFrame:
    """(word, around binary) for words that are no units of their own and that are seen often enough: classes beside them.

    Each task hands on a row for each word that it has met in a stretch of text. Words that aren't known to the
    workers are told by a bit table of bounded size, which lets some rarer ones pass.
    """
    spark = codes.sparkSession
    own = lexicon.value
    bits, few = 1 << 16, len(own.count) == 0 or int(own.count[-1]) < seen  # then no word is often enough that isn't known
    sieve = np.zeros(bits // 64, np.int64)
    if not few:
        often = counts.filter(F.col("n").between(seen, int(own.count[-1])))
        while bits < min(8 * often.count(), SIEVE_BITS):
            bits *= 2
        slot = often.select(F.xxhash64("word").bitwiseAND(F.lit(bits - 1).cast("long")).alias("slot"))
        rows = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits")).toArrow()
        sieve = np.zeros(bits // 64, np.int64)
        sieve[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    held = spark.sparkContext.broadcast((sieve, classes.astype(np.uint8)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, of = held.value
        lex = lexicon.value
        wanted = np.concatenate([lex.count >= seen, np.zeros(ENDINGS, bool)])
        wanted[: min(lex.own, len(lex.count))] = False
        parts, rest, n = [], {}, 0

        def pack() -> Iterator[pa.RecordBatch]:
            if parts:
                code, around = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(code, kind="stable")
                word, times = np.unique(code[order], return_counts=True)
                ends = np.concatenate([[0], np.cumsum(2 * times)]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(around[order]))])
                yield pa.RecordBatch.from_arrays([lex.words.take(pa.array(word)), data], names=["word", "around"])
            if rest:
                yield pa.RecordBatch.from_arrays([pa.array(rest.keys(), pa.binary()), pa.array(map(bytes, rest.values()), pa.binary())], names=["word", "around"])

        for batch in batches:
            code, size = flat(batch.column(0))
            before, after, _ = with_ends(lex.unit[code], size, lex.end)
            word = after != lex.end
            beside = np.stack([of[before], of[np.append(after[1:], lex.end)] + SIDE], axis=1).astype(np.uint8)[word]
            pick = wanted[code]
            parts.append((code[pick], beside[pick]))
            n += int(pick.sum())
            if not few:
                for at, w in zip(np.flatnonzero(code < 0).tolist(), batch.column(1).flatten().to_pylist()):
                    slot = xxhash.xxh64_intdigest(w, 42) & (bits - 1)
                    if int(sieve[slot >> 6]) >> (slot & 63) & 1:
                        rest.setdefault(w, bytearray()).extend(beside[at].tobytes())
                        n += 1
            if n > 8 * HELD:
                yield from pack()
                parts, rest, n = [], {}, 0
        yield from pack()

    return codes.mapInArrow(work, "word binary, around binary")


def placed(around: DataFrame, endings: np.ndarray, pairs: np.ndarray, seen: int) -> DataFrame:
    """(word, class, before, n): the class of each word, and without a word, by how much that changes the bigrams of classes.

    Rows are summed up as they come in, so that no more is held than a table of counts for the words of a partition.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[bytes, int] = {}
        sums = np.zeros((1024, 2 * SIDE), np.int64)
        for batch in batches:
            own = batch.column(0).dictionary_encode()
            place = np.array([at.setdefault(w, len(at)) for w in own.dictionary.to_pylist()], np.int64)
            if len(at) > len(sums):
                sums = np.concatenate([sums, np.zeros((max(len(at), 2 * len(sums)) - len(sums), 2 * SIDE), np.int64)])
            length = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            row = np.repeat(place[own.indices.to_numpy()], length)
            byte = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8)
            key, n = np.unique(row * (2 * SIDE) + byte, return_counts=True)
            np.add.at(sums.reshape(-1), key, n)
        change = np.zeros((SIDE, SIDE), np.int64)
        names = list(at)
        for a in range(0, len(names), 4096):
            part = sums[a : min(a + 4096, len(names))]
            left, right = part[:, :SIDE], part[:, SIDE:]
            own = endings[[ending(w) for w in names[a : a + 4096]]]
            new = np.where(left.sum(axis=1) >= seen, gains(left.astype(np.float64), right.astype(np.float64), own, pairs).argmax(axis=1), own)
            np.add.at(change.T, new, left)
            np.subtract.at(change.T, own, left)
            moved = np.flatnonzero(left.sum(axis=1) >= seen)
            yield pa.RecordBatch.from_arrays([pa.array([names[a + i] for i in moved.tolist()], pa.binary()), pa.array(new[moved].astype(np.int32)), pa.nulls(len(moved), pa.int32()), pa.nulls(len(moved), pa.int64())], names=["word", "class", "before", "n"])
        before, after = np.nonzero(change)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(before), pa.binary()), pa.array(after.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(change[before, after])], names=["word", "class", "before", "n"])

    parts = int(around.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return around.repartition(parts, "word").mapInArrow(work, "word binary, class int, before int, n long")


def transitions(pairs: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """log10 P(class | class before), towards the classes' own frequencies where there is little to go by."""
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + len(pairs))
    return np.log10((pairs + weight * share) / (pairs.sum(axis=1, keepdims=True) + weight))


class Classes:
    """What scoring needs: vocabulary(word, n, class) as a table, and small arrays."""

    def __init__(self, spark: SparkSession, counts: DataFrame, codes: DataFrame, lexicon, rounds: int, seen: int):
        bigrams = stored(unit_bigrams(codes.select("codes"), lexicon), "unit-bigrams")
        #: The class of each unit as the word before; bigrams of that and the class of the word itself.
        self.before, pairs = exchange(bigrams, lexicon.value.units, rounds)
        endings = self.before[lexicon.value.own : lexicon.value.end]
        moved = stored(placed(surroundings(codes.select("codes", "rest"), counts, lexicon, self.before, seen), endings, pairs, seen), "word-classes")
        self.pairs = pairs.copy()
        for r in moved.filter("word IS NULL").groupBy("before", "class").agg(F.sum("n").alias("n")).collect():
            self.pairs[r["before"], r["class"]] += r["n"]
        before = self.before

        def as_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lex = lexicon.value
            for batch in batches:
                unit = [i if (i := lex.index.get(w, lex.own)) < lex.own else lex.own + ending(w) for w in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before[np.array(unit, np.int64)].astype(np.int32))], names=["word", "n", "unit_class"])

        own = moved.filter("word IS NOT NULL").select("word", "class")
        whole = counts.mapInArrow(as_units, "word binary, n long, unit_class int").join(own, "word", "left")
        self.vocabulary = stored(whole.select("word", "n", F.coalesce("class", "unit_class").alias("class")), "vocabulary")
        sums = np.zeros((CLASSES, 4), np.int64)
        for r in self.vocabulary.groupBy("class").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect():
            sums[r["class"]] = r["types"], r["tokens"], r["once"], r["twice"]
        types, tokens, once, twice = sums.sum(axis=0).tolist()
        #: Ends, tokens and distinct tokens of the training texts.
        self.n_end = int(pairs[:, END_CLASS].sum())
        self.n_all, self.n_types = tokens + self.n_end, types + (self.n_end > 0)
        self.discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        self.log_size = np.log10(np.maximum(sums[:, 1], 1))
        self.log_unknown = np.where(sums[:, 1] > 0, np.log10(np.maximum(self.discount * sums[:, 0], 1e-9)) - self.log_size, 0.0)
        self.step = transitions(self.pairs)
        top = self.vocabulary.orderBy(F.desc("n"), "word").limit(max(1, len(lexicon.value.count))).select("class").toArrow()
        #: The class of each known word.
        self.known = top.column(0).to_numpy().astype(np.int64) if top.num_rows else np.zeros(0, np.int64)


def class_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, seen: int = SEEN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, known_base, known_score for every row of docs.

    Learned from rows whose crc32 of the id as text is not divisible by 10. Tokens are the words, lower-cased in A-Z,
    and one end. A known word of a class has probability (count - discount) / tokens of the class, and one slot for
    all unknown ones has what the discounts leave, so that the probabilities of all known words and the slot sum to 1.
    As the slot stands for any unknown word, known_base and known_score give both sums over known tokens alone. Null
    and empty texts are an end alone. With nothing to learn from every token is unknown. Repeated rows each give their
    score, an empty table none; further columns are not read.
    """
    return scored(*fitted(docs, id_col, text_col, rounds, seen))


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, seen: int = SEEN, own_units: int = OWN_UNITS, known: int = KNOWN) -> tuple[DataFrame, object, Classes]:
    """The codes of all texts, the lexicon as a broadcast, and the classes."""
    spark = docs.sparkSession
    small_batches(spark)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")).withColumn("held_out", fold_of_doc(F.col("doc_id"), FOLDS) == 0)
    counts = stored(word_counts(read.filter("NOT held_out").select("text")), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(known).toArrow()
    lexicon = spark.sparkContext.broadcast(Lexicon(top.column(0).to_pylist(), top.column(1).to_pylist(), own_units))
    codes = stored(encoded(read, lexicon), "word-codes")
    return codes, lexicon, Classes(spark, counts, codes.filter("NOT held_out"), lexicon, rounds, seen)


def scored(codes: DataFrame, lexicon, model: Classes) -> DataFrame:
    spark = codes.sparkSession
    before_class, known_class, step, log_size, discount, n_end = model.before, model.known, model.step, model.log_size, model.discount, model.n_end
    base_under = math.log10(model.n_all + 0.1 * (model.n_types + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        log_count, log_base = np.log10(np.maximum(lex.count - discount, 1e-9)) - log_size[known_class], np.log10(lex.count + 0.1)
        kinds = pa.list_(pa.struct([("word", pa.binary()), ("before", pa.int32()), ("ending", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            code, size = flat(batch.column(3))
            m = len(size)
            before, after, text = with_ends(lex.unit[code], size, lex.end)
            before, end = before_class[before], after == lex.end
            own, left = text[~end], before[~end]
            score = np.bincount(text[end], weights=step[before[end], END_CLASS], minlength=m)
            known = code >= 0
            i = code[known]
            score += np.bincount(own[known], weights=step[left[known], known_class[i]] + log_count[i], minlength=m)
            base = np.bincount(own[known], weights=log_base[i], minlength=m) + math.log10(n_end + 0.1)
            rest: list[Counter] = [Counter() for _ in range(m)]
            at = np.flatnonzero(~known)
            for k, word, b, e in zip(own[at].tolist(), batch.column(4).flatten().to_pylist(), left[at].tolist(), before_class[lex.unit[code[at]]].tolist()):
                rest[k][word, b, e] += 1
            tail = [[{"word": w, "before": b, "ending": e, "n": n} for (w, b, e), n in x.items()] for x in rest]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(size + 1), pa.array(np.bincount(own[known], minlength=m) + (n_end > 0)), pa.array(base), pa.array(score), pa.array(tail, kinds)],
                names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "tail"],
            )

    local = stored(codes.mapInArrow(work, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, score double, tail array<struct<word: binary, before: int, ending: int, n: int>>"), "class-scores")
    tail = local.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(model.vocabulary.withColumnRenamed("n", "count"), "word", "left")
    steps = spark.createDataFrame([(b, c, float(step[b, c])) for b in range(CLASSES + 1) for c in range(CLASSES)], "before int, own int, step double")
    tail = tail.withColumn("own", F.coalesce("class", "ending")).join(F.broadcast(steps), ["before", "own"])
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("own") + 1)
    seen = F.col("count") > 0
    emitted = F.when(seen, F.log10(F.col("count") - discount) - pick(log_size)).otherwise(pick(model.log_unknown)) + F.col("step")
    base = F.log10(F.coalesce("count", F.lit(0)) + 0.1)
    sums = {"n": F.col("n"), "base": F.col("n") * base, "score": F.col("n") * emitted}
    more = tail.groupBy("row").agg(*(F.sum(v).alias(f"more_{k}") for k, v in sums.items()), *(F.sum(F.when(seen, v).otherwise(0)).alias(f"known_{k}") for k, v in sums.items()))
    plus = lambda c, d: F.col(c) + F.coalesce(d, F.lit(0))
    n_known, under = plus("n_known", "known_n"), F.lit(base_under)
    return local.drop("tail").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(model.n_all).cast("long").alias("train_tokens"), (plus("base", "more_base") - F.col("n_tokens") * under).alias("base_score"),
        plus("score", "more_score").alias("score"), (plus("base", "known_base") - n_known * under).alias("known_base"), plus("score", "known_score").alias("known_score"),
    )
