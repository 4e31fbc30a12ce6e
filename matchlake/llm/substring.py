"""Substring dedup: windows of words that a document of a smaller id holds too are removed.

Three steps, each of which Spark deals out:

* Every document is cut into segments, runs of windows that share the least hashed word triple in them. Equal windows
  have equal least triples, so segments with the same triple meet in one shard, wherever they come from, and no pair
  of documents need ever be compared. A segment that stands in a task's texts again and again leaves it once, for the
  least id; its later holders are told at once. Triples that a sample of the documents shows to be frequent are no keys
  for shards: there each window is a segment of its own, sent by its own hash. The sample decides only where windows
  meet, never what is removed.
* A shard is a run of keys of bounded size. Over its segments stands an FM-index: the Burrows-Wheeler transform in a
  wavelet matrix, bit vectors with counts, a bit for each level and word. The segments stream through it by backward
  search, all of them in step: a window is read from its end until the words read have no second place in the shard,
  which gives the matching statistics there and rules out every window that holds those words, or until the whole
  window is read, whose rows of the index then tell the least id that holds it.
* The intervals found go back to their documents, whose words they cover are cut out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.common import keyed, small_batches
from matchlake.llm.shingles import xxh64_spans

WINDOW, GRAM = 13, 3
#: Bits of a key that tell the place of a triple among the words of a batch.
PLACE = 30
#: Bytes of segments in a shard, unless a single key has more; a shard's arrays take some 40 times as much.
SHARD_BYTES = 3 << 20
#: Bytes of segments that a task holds to merge repeats, and of those among them that it goes on holding.
MERGE_BYTES, HELD_BYTES = 8 << 20, 4 << 20
#: Documents in the sample for frequent triples, and the share of segments from which a triple is frequent.
SAMPLE, FREQUENT = 20_000, 1 / 2000
#: Bytes of text a partition, before segments overlap.
PART_BYTES = 24 << 20

#: Packed segments of a bucket, or words that are known to go.
SENT = "bucket long, file long, at long, start long, stop long, numbers binary, texts binary"
SENT_NAMES = [x.split()[0] for x in SENT.split(", ")]


def split_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hash_of(rows: list[np.ndarray]) -> np.ndarray:
    """One hash from those of consecutive words."""
    out = np.zeros(len(rows[0]), np.uint64)
    for row in rows:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + row)
    return out


class Segments:
    """The segments of a batch of texts: own(document), first and last word of each, key, and their bytes in joined."""

    def __init__(self, texts: list, frequent: np.ndarray, window: int = WINDOW):
        split = [split_words(t) for t in texts]
        n = np.array([len(x) for x in split], np.int64)
        self.joined = b" ".join([b" ".join(x) for x in split if x])
        gap = np.flatnonzero(np.frombuffer(self.joined, np.uint8) == 32)
        self.begin = np.concatenate([[0], gap + 1])
        self.end = np.concatenate([gap, [len(self.joined)]])
        self.before = np.cumsum(n) - n
        doc = np.repeat(np.arange(len(texts)), n)
        windows = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :]) if len(doc) >= window else np.zeros(0, np.int64)
        if not len(windows):
            self.own = self.first = self.last = self.key = np.zeros(0, np.int64)
            return
        word = xxh64_spans(self.joined, self.begin, self.end)
        least = (_hash_of([word[i : len(word) - GRAM + 1 + i] for i in range(GRAM)]) >> np.uint64(PLACE + 1) << np.uint64(PLACE)) | np.arange(len(word) - GRAM + 1, dtype=np.uint64)
        wide, want = 1, window - GRAM + 1
        while wide < want:
            step = min(wide, want - wide)
            least = np.minimum(least[:-step], least[step:])
            wide += step
        least = least[windows]
        fresh = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        first, last = windows[fresh], windows[np.concatenate([fresh[1:] - 1, [len(windows) - 1]])]
        key = (least[fresh] >> np.uint64(PLACE)).astype(np.int64)
        if len(frequent) and (hot := np.isin(key, frequent)).any():
            size = (last - first + 1)[hot]
            single = np.repeat(first[hot] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            own_key = _hash_of([word[single + i] for i in range(window)]) >> np.uint64(2) | np.uint64(1 << 62)
            first, last, key = (np.concatenate(x) for x in ((first[~hot], single), (last[~hot], single), (key[~hot], own_key.astype(np.int64))))
        self.first, self.last, self.key = first, last + window, key
        self.own = doc[first]


def _frequent(docs: DataFrame, rows: int, window: int) -> np.ndarray:
    """Keys of at least a share of the segments of a sample; there can't be more than 1 / FREQUENT of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = np.unique(Segments(batch.column(0).to_pylist(), np.zeros(0, np.int64), window).key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(key, -1)), pa.array(np.append(n, n.sum()))], names=["key", "n"])

    own = docs.filter(F.pmod(F.xxhash64("file", "at"), F.lit(max(1, rows // SAMPLE))) == 0).select("text")
    number = own.mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    most = number.orderBy(F.desc("n"), "key").limit(1 + int(1 / FREQUENT)).collect()  # the sum of all comes first
    total = max((r.n for r in most if r.key < 0), default=0)
    return np.array(sorted(r.key for r in most if r.key >= 0 and r.n >= max(16, FREQUENT * total)), np.int64)


class Merger:
    """Segments of a task, each sent once for the least id that holds it."""

    def __init__(self, parts: int, most: int = MERGE_BYTES, hold: int = HELD_BYTES):
        self.parts, self.most, self.hold = parts, most, hold
        self.held: dict[bytes, tuple | list] = {}
        self.size = 0
        self.known: list[list] = []

    def gone(self, file: int, at: int, starts: list[int], size: int) -> None:
        """Words that a smaller id is known to hold; neighbours make one row."""
        for start in starts:
            last = self.known[-1] if self.known else None
            if last and last[0] == file and last[1] == at and last[2] <= start <= last[3]:
                last[3] = max(last[3], start + size)
            else:
                self.known.append([file, at, start, start + size])

    def add(self, words: bytes, size: int, key: int, file: int, at: int, doc_id: int, start: int) -> None:
        old = self.held.get(words)
        if old is None:
            self.held[words] = (key, file, at, doc_id, 1, start)
            self.size += len(words)
            return
        if type(old) is tuple:  # repeated: least id, key, rows that hold it, sent, repeated since
            old = self.held[words] = [old[3], old[0], [(old[1], old[2], [old[5]])], False, True]
        old[4] = True
        if doc_id > old[0]:
            self.gone(file, at, [start], size)
        elif doc_id < old[0]:
            for x in old[2]:
                self.gone(*x, size)
            old[0], old[2], old[3] = doc_id, [(file, at, [start])], False
        elif not old[3] and old[2][-1][:2] == (file, at):
            old[2][-1][2].append(start)
        else:
            old[2] = [*([] if old[3] else old[2]), (file, at, [start])]
            old[3] = False

    def send(self) -> Iterator[pa.RecordBatch]:
        """SENT rows of what hasn't been sent yet; repeated segments stay held as far as there is room."""
        words = [w for w, old in self.held.items() if type(old) is tuple]
        again = [(w, old) for w, old in self.held.items() if type(old) is list]
        single = np.fromiter(chain.from_iterable(old for old in self.held.values() if type(old) is tuple), np.int64, 6 * len(words)).reshape(-1, 6)
        more: list = [None] * len(words)  # the only start is in the row
        rows = []
        for w, old in again:
            if not old[3]:
                for file, at, starts in old[2]:
                    rows.append((old[1], file, at, old[0], len(starts), starts[0]))
                    more.append(starts)
                    words.append(w)
        if words:
            number = np.concatenate([single, np.array(rows, np.int64).reshape(-1, 6)])
            bucket = number[:, 0] % self.parts
            by = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.diff(bucket[by], prepend=-1))
            packed, texts = [], []
            for pick in np.split(by, edge[1:]):
                packed.append(_pack(number[pick], more, pick))
                texts.append(zstandard.compress(b"\n".join([words[i] for i in pick.tolist()]), 3))
            none = pa.nulls(len(edge), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[by][edge]), none, none, none, none, pa.array(packed, pa.binary()), pa.array(texts, pa.binary())], names=SENT_NAMES)
        if self.known:
            columns = np.array(self.known, np.int64).T
            none = pa.nulls(len(self.known), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((columns[0] ^ columns[1]) % self.parts), *(pa.array(c) for c in columns), none, none], names=SENT_NAMES)
            self.known = []
        kept, room = {}, self.hold
        for w, old in again:
            if old[4] and room > 0:
                kept[w] = [*old[:3], True, False]
                room -= len(w)
        self.held, self.size = kept, self.hold - room


def _pack(rows: np.ndarray, starts: list[list[int]], pick: np.ndarray) -> bytes:
    """(key, file, at, doc_id, number of starts, first start) of each segment, and all starts: differences, compressed."""
    every = [x for i, first in zip(pick.tolist(), rows[:, 5].tolist()) for x in starts[i] or (first,)] if (rows[:, 4] > 1).any() else rows[:, 5]
    moved = np.diff(rows[:, 1:5], axis=0, prepend=0)
    head = np.array([len(rows), len(every)], np.int64)
    return zstandard.compress(b"".join((head.tobytes(), moved.T.tobytes(), np.diff(np.asarray(every, np.int64), prepend=0).astype(np.int32).tobytes(), (rows[:, 0] >> 2).astype(np.uint32).tobytes())), 3)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(file, at, doc_id, number of starts) of each segment, all starts, and 32 bits of the keys."""
    data = zstandard.decompress(packed)
    n, m = np.frombuffer(data, np.int64, 2)
    rows = np.cumsum(np.frombuffer(data, np.int64, 4 * n, 16).reshape(4, n), axis=1)
    starts = np.cumsum(np.frombuffer(data, np.int32, m, 16 + 32 * n), dtype=np.int64)
    return rows, starts, np.frombuffer(data, np.uint32, n, 16 + 32 * n + 4 * m)


def segments(docs: DataFrame, frequent: np.ndarray, parts: int, window: int = WINDOW) -> DataFrame:
    """SENT rows of docs(file, at, doc_id, text): packed segments for a bucket of shards, and words known to go."""
    bounds = MERGE_BYTES, HELD_BYTES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(parts, *bounds)
        for batch in batches:
            file, at, doc_id = (batch.column(i).to_pylist() for i in range(3))
            found = Segments(batch.column(3).to_pylist(), frequent, window)
            begin, end = found.begin[found.first].tolist(), found.end[found.last - 1].tolist()
            start, size = (found.first - found.before[found.own]).tolist(), (found.last - found.first).tolist()
            for own, a, b, key, s, n in zip(found.own.tolist(), begin, end, found.key.tolist(), start, size):
                merger.add(found.joined[a:b], n, key, file[own], at[own], doc_id[own], s)
                if merger.size > merger.most:
                    yield from merger.send()
        yield from merger.send()

    return docs.select("file", "at", "doc_id", "text").mapInArrow(work, SENT)


class BitVector:
    """Bits, eight in a byte, with the ones before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = (np.cumsum(ones, dtype=np.int64) - ones).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class FMIndex:
    """Backward search over words numbered from 1, 0 between segments; patterns of up to depth words."""

    def __init__(self, text: np.ndarray, depth: int):
        self.suffixes = _suffixes(text, depth)
        number = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=number))])
        rest = text[self.suffixes - 1]
        self.levels = []
        for level in reversed(range(max(1, (number - 1).bit_length()))):
            bits = ((rest >> level) & 1).astype(bool)
            self.levels.append((level, BitVector(bits), int(len(bits) - np.count_nonzero(bits))))
            rest = np.concatenate([rest[~bits], rest[bits]])
        self.zero = self._walk(np.arange(number), np.zeros(number, np.int64))

    def _walk(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones, zeros in self.levels:
            up = ones.rank(at)
            at = np.where((word >> level) & 1, zeros + up, at - up)
        return at

    def back(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of word followed by what the rows from low to high begin with."""
        both = self._walk(np.concatenate([word, word]), np.concatenate([low, high]))
        move = self.first[word] - self.zero[word]
        return both[: len(word)] + move, both[len(word) :] + move


def _suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text in the order of the next depth symbols; doubling, in which only ties are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable").astype(np.int32)
    rank = np.empty(n, np.int32)
    tied, known = np.arange(n, dtype=np.int32), 1
    new = np.concatenate([[True], np.diff(text[order]) != 0])
    rank[order] = np.maximum.accumulate(np.where(new, tied, 0))
    while known < depth:
        own = order[tied]
        group = rank[own]
        more = np.concatenate([group[1:] == group[:-1], [False]])
        more[1:] |= more[:-1]  # both ends of a tie
        tied, own, group = tied[more], own[more], group[more]
        if not len(tied):
            break
        step = min(known, depth - known)
        after = own + step
        key = group.astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[tied] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[own] = np.maximum.accumulate(np.where(new, tied, 0))
        known += step
    return order


def repeats(words: list[bytes], doc_id: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first word, last word + 1) of the words in windows that a segment of a smaller id holds too."""
    numbers: dict[bytes, int] = defaultdict(count(1).__next__)
    split = [x.split(b" ") for x in words]
    size = np.array([len(x) for x in split], np.int64)
    base = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum() + len(size)), np.int32)
    text[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = np.fromiter((numbers[w] for x in split for w in x), np.int32, int(size.sum()))
    del split, numbers
    index = FMIndex(text, window)
    own, at = np.arange(len(size)), np.zeros(len(size), np.int64)
    read = np.ones(len(size), np.int64)
    last = text[base + window - 1]
    low, high = index.first[last], index.first[last + 1]
    found = []
    while len(own):
        alone, whole = high - low <= 1, read == window
        if (stop := alone | whole).any():
            if (hit := whole & ~alone).any():
                found.append(np.stack([own[hit], at[hit], low[hit], high[hit]]))
            at = np.where(stop, at + np.where(whole, 1, window - read + 1), at)
            go = at + window <= size[own]
            own, at, read, low, high, stop = (x[go] for x in (own, at, read, low, high, stop))
            read = np.where(stop, 1, read)
            last = text[base[own] + at + window - 1]
            low, high = np.where(stop, index.first[last], low), np.where(stop, index.first[last + 1], high)
            continue
        low, high = index.back(text[base[own] + at + window - 1 - read], low, high)
        read += 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    own, at, low, high = np.concatenate(found, axis=1)
    holder = np.append(np.repeat(doc_id, size + 1)[index.suffixes], np.iinfo(np.int64).max)
    begin, which = np.unique(low, return_inverse=True)
    end = np.empty(len(begin), np.int64)
    end[which] = high
    least = np.minimum.reduceat(holder, np.stack([begin, end], axis=1).ravel())[::2]
    later = least[which] < doc_id[own]
    by = np.lexsort((at[later], own[later]))
    own, at = own[later][by], at[later][by]
    if not len(own):
        return (np.zeros(0, np.int64),) * 3
    fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] > at[:-1] + window)])
    close = np.concatenate([fresh[1:], [True]])
    return own[fresh], at[fresh], at[close] + window


def _resolve(numbers: list[bytes], texts: list[bytes], window: int) -> Iterator[pa.RecordBatch]:
    """(file, at, start, stop) of the words to go among the packed segments of a bucket."""
    parts = [_unpack(x) for x in numbers]
    rows = np.concatenate([p[0] for p in parts], axis=1)
    starts, key = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    edge = np.cumsum([p[0].shape[1] for p in parts])
    by = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[by], prepend=-1, append=-1))[:-1] if len(by) else by
    doc_id = rows[2][by]
    differs = np.minimum.reduceat(doc_id, first) < np.maximum.reduceat(doc_id, first)
    by = by[np.repeat(differs, np.diff(np.append(first, len(by))))]  # a key of a single id has nothing to remove
    if not len(by):
        return
    wanted = np.zeros(len(key), bool)
    wanted[by] = True
    words: list[bytes | None] = [None] * len(key)
    for a, b, packed in zip([0, *edge[:-1].tolist()], edge.tolist(), texts):
        pick = np.flatnonzero(wanted[a:b]).tolist()
        if pick:
            own = zstandard.decompress(packed).split(b"\n")
            for i in pick:
                words[a + i] = own[i]
    begin = np.cumsum(rows[3]) - rows[3]
    size = np.cumsum([len(words[i]) for i in by.tolist()])
    turn = np.append(key[by][1:] != key[by][:-1], True)
    ends = np.flatnonzero(turn) + 1
    low = 0
    while low < len(by):
        full = np.searchsorted(size, (size[low - 1] if low else 0) + SHARD_BYTES, "right")
        at = np.searchsorted(ends, full, "right") - 1
        high = int(ends[at]) if at >= 0 and ends[at] > low else int(ends[np.searchsorted(ends, low, "right")])
        shard = by[low:high]
        low = high
        own, a, b = repeats([words[i] for i in shard.tolist()], rows[2][shard], window)
        if len(own):
            pick = shard[own]
            n = rows[3][pick]
            each = np.repeat(np.arange(len(pick)), n)
            start = starts[np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + begin[pick][each]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0][pick][each]), pa.array(rows[1][pick][each]), pa.array(start + a[each]), pa.array(start + b[each])], names=["file", "at", "start", "stop"])


def removals(sent: DataFrame, parts: int, window: int = WINDOW) -> DataFrame:
    """(file, at, start, stop): words to go, from all SENT rows; the shards are runs of the keys of a bucket.

    A bucket's segments are held packed; only those whose key stands under several ids are unpacked.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, texts = [], []
        for batch in batches:
            known = batch.filter(batch.column("numbers").is_null())
            if known.num_rows:
                yield known.select(["file", "at", "start", "stop"])
            own = batch.filter(batch.column("numbers").is_valid())
            numbers += own.column("numbers").to_pylist()
            texts += own.column("texts").to_pylist()
        if numbers:
            yield from _resolve(numbers, texts, window)

    return sent.repartition(parts, "bucket").mapInArrow(work, "file long, at long, start long, stop long")


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, carried columns): each row of docs without the words that a smaller id holds.

    A word goes if it stands in a window of so many consecutive words that also starts in a row of a smaller id; all
    windows are judged on the texts as they came. kept has the other words, joined by a space. Ids are whole numbers.
    Rows with the same id don't remove each other's words; a row with a null id keeps all words and removes none. Null
    and empty texts have no words. Further columns of docs don't matter, whatever their names, unless they are carried.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rest = [F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)]
    whole = keyed(docs, "row_key_of_text")
    own = whole.select(F.col("row_key_of_text.file").alias("file"), F.col("row_key_of_text.at").alias("at"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(id_col).alias("given"), *rest)
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size["bytes"] // PART_BYTES)
    able = own.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    gone = removals(segments(able, _frequent(able, size["rows"], window), parts, window), parts, window)
    cuts = gone.groupBy("file", "at").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    joined = own.drop("doc_id").join(cuts, ["file", "at"], "left").select("text", "starts", "stops", "given", *[f"carry{i}" for i in range(len(carry))])
    kinds = {f.name: f.dataType for f in own.schema.fields}
    fields = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()), *[(c, kinds[c]) for c in joined.columns[3:]]]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, n_gone, kept = [], [], []
            for text, starts, stops in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = split_words(text)
                n.append(len(words))
                if starts:
                    edge = np.bincount(starts, minlength=len(words) + 1) - np.bincount(stops, minlength=len(words) + 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                n_gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *batch.columns[3:]], names=schema.names)

    done = joined.mapInArrow(work, schema)
    return done.select(F.col("given").alias(id_col), "n_words", "n_removed", "kept", *[F.col(f"carry{i}").alias(c) for i, c in enumerate(carry)])
