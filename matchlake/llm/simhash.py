"""SimHash near-duplicates with pivot distance tables.

Every text gets a fingerprint of one or more 64-bit words. Candidate pairs are pruned with a table of Hamming distances
to reference fingerprints (pivots): if the distances of two fingerprints to any pivot differ by more than the
threshold, the triangle inequality rules the pair out. Survivors are verified by their own Hamming distance.

Pivot distances alone are no key to shuffle by (they crowd around half the width), so candidates come from buckets
that cannot miss a link; the pivots prune inside the buckets. Copies share a fingerprint and are one node, large
buckets are dealt out anew by further bits; what is still large is split into blocks that meet pairwise, and each block
returns a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import cut, join_hot, small_batches, stored, stretches
from matchlake.llm.components import components
from matchlake.llm.shingles import majority_bits, shingle_hashes

WIDTH = 64
#: Reference fingerprints; any fixed values do, these are hashes of their number.
PIVOTS = 16
#: A bucket of more members is split into blocks of about this many.
BLOCK = 256
#: Buckets of more fingerprints are dealt out anew by further blocks of bits.
LARGE = 1 << 14


def pivots(n_words: int) -> np.ndarray:
    return np.array([[xxhash.xxh64_intdigest(f"{p}/{w}".encode(), 7) for w in range(n_words)] for p in range(PIVOTS)], np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row of docs. A text without words, or null, has fingerprint 0."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [majority_bits(*shingle_hashes(texts[a:b], shingle)) for a, b in stretches(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, "doc_id long, fp long")


def _close(values: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs (a, b) of rows link: pivot tables first, then the distance itself."""
    keep = np.ones(len(a), bool)
    alive = np.arange(len(a))
    for p in range(0, table.shape[1], 4):
        gap = np.abs(table[a[alive], p : p + 4] - table[b[alive], p : p + 4]).max(axis=1)
        keep[alive[gap > most]] = False
        alive = alive[gap <= most]
    far = np.bitwise_count(values[a[alive]] ^ values[b[alive]]).sum(axis=1, dtype=np.int32) > most
    keep[alive[far]] = False
    return keep


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A star for each component of a graph of n nodes."""
    near = np.zeros((n, n), bool)
    near[a, b] = near[b, a] = True
    left, out = near.any(axis=1), []
    while left.any():
        root = int(np.argmax(left))
        seen = np.zeros(n, bool)
        seen[root] = True
        front = seen.copy()
        while front.any():
            front = near[front].any(axis=0) & ~seen
            seen |= front
        left &= ~seen
        out += [(root, int(i)) for i in np.flatnonzero(seen) if i != root]
    return out


def bucket_links(values: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of values that link inside the buckets offsets[i]:offsets[i+1]; a forest where there are many."""
    ref = pivots(values.shape[1])
    table = np.stack([np.bitwise_count(values ^ p).sum(axis=1, dtype=np.int16) for p in ref], axis=1)
    size = np.diff(offsets)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(size[size > 1]).tolist():
        base = offsets[:-1][size == m]
        i, j = np.triu_indices(m, 1)
        step = max(1, 200_000 // len(i))
        for s in range(0, len(base), step):
            a, b = (base[s : s + step, None] + i).ravel(), (base[s : s + step, None] + j).ravel()
            keep = _close(values, table, a, b, most)
            if m <= 8:
                out_a.append(a[keep])
                out_b.append(b[keep])
                continue
            keep = keep.reshape(-1, len(i))
            for row in np.flatnonzero(keep.any(axis=1)).tolist():
                if found := _forest(m, i[keep[row]], j[keep[row]]):
                    pair = np.array(found) + base[s + row]
                    out_a.append(pair[:, 0])
                    out_b.append(pair[:, 1])
    return np.concatenate(out_a), np.concatenate(out_b)


def links_in_buckets(keyed: DataFrame, most: int, n_words: int) -> DataFrame:
    """Links (u, v) between nodes of keyed(bucket long, node long, fp array<long>) that share a bucket."""
    size = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = keyed.join(size, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = dealt.groupBy("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("node", "fp")).alias("members"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            flat = members.flatten()
            offsets = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(members).to_numpy(zero_copy_only=False))])
            node = flat.field("node").to_numpy(zero_copy_only=False)
            values = flat.field("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, n_words)
            a, b = bucket_links(values, offsets, most)
            u, v = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            uv = np.unique(np.stack([u, v], axis=1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])

    return meets.select("members").mapInArrow(work, "u long, v long").distinct()


def split_large(keyed: DataFrame, sets: list[tuple[tuple[int, int], ...]], most: int) -> DataFrame:
    """keyed(bucket, number, node, fp) with the buckets of over LARGE members dealt into smaller ones; no link is missed.

    Members of a bucket agree in the bits of its number in sets. The ranges of the other bits, of which there are
    `most`, are halved, and at least `most` of these halves agree for every link, so some choice of that many does. A
    member goes to a bucket for each choice, however many members there are.
    """
    large = cut(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("bucket"))
    if large.isEmpty():
        return keyed.drop("number")
    ends = sorted({r for s in sets for r in s})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, number, node = (batch.column(i).to_numpy() for i in range(3))
            out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for i in np.unique(number).tolist():
                own = number == i
                free = [r for r in ends if r not in sets[i]]
                halves = [half for at, width in free for half in ((at, width // 2), (at + width // 2, width - width // 2))]
                fp = node[own].view(np.uint64)
                bits = [(fp >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in halves]
                for k, choice in enumerate(combinations(range(len(halves)), len(halves) - most)):
                    key = _mixed(bucket[own].view(np.uint64), k + 1)
                    for c in choice:
                        key = _mixed(key ^ bits[c], c + 1)
                    out.append((key, node[own]))
            key, member = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(member)], names=["bucket", "node"])

    again = keyed.join(large, "bucket", "left_semi").select("bucket", "number", "node").mapInArrow(work, "bucket long, node long").withColumn("fp", F.array("node"))
    return keyed.join(large, "bucket", "left_anti").drop("number").unionByName(again)


def block_keys(n_rows: int, most: int) -> list[tuple[tuple[int, int], ...]]:
    """Bit ranges whose joint values are the bucket keys.

    With b blocks, of which at most `most` can differ, some choice of b - most blocks agrees for every link, so no
    link is missed whatever b is. b only balances copies of rows against chance meetings, so that it grows with the rows.
    """
    for b in range(most + 1, most + 6):
        edge = [round(i * WIDTH / b) for i in range(b + 1)]
        sets = list(combinations([(edge[i], edge[i + 1] - edge[i]) for i in range(b)], b - most))
        if sum(n_rows / 2.0 ** sum(w for _, w in s) for s in sets) <= 4:
            break
    return sets


def classes(fps: DataFrame, most: int = 4) -> DataFrame:
    """(fp, component_id) for every fingerprint of fps(doc_id, fp): the smallest doc_id reachable over links of at most `most` bits."""
    groups = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    sets = block_keys(groups.count(), most)
    part = lambda shift, width: F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1)

    def key(number: int, ranges) -> F.Column:
        out = F.lit(number).cast("long")
        for shift, width in ranges:
            out = F.shiftleft(out, width).bitwiseOR(part(shift, width))
        return out

    keyed = groups.select(F.posexplode(F.array(*[key(i, s) for i, s in enumerate(sets)])).alias("number", "bucket"), F.col("fp").alias("node"), F.array("fp").alias("fp"))
    roots = components(links_in_buckets(split_large(keyed, sets, most), most, 1))
    placed = cut(groups.join(roots, groups.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    return join_hot(placed, least, "root").select("fp", "component_id")


def simhash_classes(docs: DataFrame, shingle: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Null and empty texts have fingerprint 0 and link like others. Repeated rows give repeated results. A null doc_id
    is kept and never is the smallest of a class that has another. An empty table gives no rows. Further columns of
    docs are not read.
    """
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    return fps.join(classes(fps, most), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Words of the wide fingerprint, and how many of a text's least shingle hashes are bucket keys.
WIDE, LEAST = 4, 6
#: Least exact Jaccard similarity of the shingle sets of two texts that link.
SIMILAR = 0.8
#: Bits of 256 that a pair may differ in to be compared exactly: two texts of similarity 0.8 have vectors of cosine
#: 2 * 0.8 / 1.8, so acos(0.889) / pi * 256 = 38.7 in the mean; over three standard deviations (5.7) more are allowed, so
#: that one pair in a thousand is missed at 0.8, and none to speak of above.
WIDE_MOST = 57
#: A bucket whose texts have more shingles is split into blocks of about this many; bits of the filter of texts to read again.
SHINGLES, FILTER_BITS = 1 << 20, 1 << 25


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    x = hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number * 0x632BE59BD9B4E019 % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sets(texts: list, shingle: int) -> list[np.ndarray]:
    hashes, count = shingle_hashes(texts, shingle)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(count)[:-1])]


def _keyed_texts(docs: DataFrame, text_col: str) -> tuple[F.Column, F.Column]:
    text = F.col(text_col)
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("node"), text.alias("text")


def wide_fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, node, fp array<long>, least array<long>, size): 256 bits over the set of shingles, its least hashes, its size.

    node is the hash of the text, 0 where it has no words. A set of fewer hashes than LEAST repeats its first.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, node long, fp array<long>, least array<long>, size long" + (f", row {docs.schema[row_col].dataType.simpleString()}" if row_col else "")
    names = ["doc_id", "node", "fp", "least", "size", *(["row"] if row_col else [])]

    def rows(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        sets = _sets(texts, shingle)
        own = np.concatenate(sets)
        size = np.array([len(x) for x in sets], np.int64)
        with np.errstate(over="ignore"):
            mixed = [_mixed(own, i) for i in range(WIDE)]
        fp = np.stack([majority_bits(m, size) for m in mixed], axis=1).view(np.int64)
        for f, m in zip(fp, np.split(mixed[0], np.cumsum(size)[:-1])):
            least = np.sort(np.partition(m, LEAST - 1)[:LEAST] if len(m) > LEAST else m).view(np.int64)
            yield f, np.append(least, np.repeat(least[:1], LEAST - len(least))), len(m)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int64())
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [row for a, b in stretches(texts) for row in rows(texts[a:b])]
            size = np.array([r[2] for r in found], np.int64)
            node = np.where(size > 0, batch.column(1).to_numpy(), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(node), *(pa.array([r[i] for r in found], lists) for i in (0, 1)), pa.array(size), *batch.columns[3:]], names=names)

    return docs.select(F.col(id_col).cast("long"), *_keyed_texts(docs, text_col), *([row_col] if row_col else [])).mapInArrow(work, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """(node, shingles array<long>) for the texts of docs whose node is in wanted(node), once each, and for a few others.

    The workers skip nearly all other texts by a bit map of bounded size; a join with the nodes has to follow.
    """
    bits = 1 << 16
    while bits < min(8 * wanted.count(), FILTER_BITS):
        bits *= 2
    slot = wanted.select(F.col("node").bitwiseAND(F.lit(bits - 1).cast("long")).alias("slot"))
    rows = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits")).toArrow()
    own = np.zeros(bits // 64, np.int64)
    own[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(own)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            at = node & (bits - 1)
            pick = np.flatnonzero((held.value[at >> 6] >> (at & 63)) & 1)
            pick = pick[np.sort(np.unique(node[pick], return_index=True)[1])]
            texts = batch.column(1).take(pa.array(pick)).to_pylist()
            for a, b in stretches(texts):
                sets = [x.view(np.int64) for x in _sets(texts[a:b], shingle)]
                yield pa.RecordBatch.from_arrays([pa.array(node[pick[a:b]]), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    found = docs.select(*_keyed_texts(docs, text_col)).mapInArrow(work, "node long, shingles array<long>")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


class Meetings:
    """A batch of (bucket, i, j, members array<struct<node, own, fp, least, ...>>): blocks i and j of a bucket."""

    def __init__(self, batch: pa.RecordBatch):
        members = batch.column(3)
        self.keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
        self.flat = members.flatten()
        count = pa.compute.list_value_length(members).to_numpy(zero_copy_only=False)
        self.offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        self.of = np.repeat(np.arange(len(count)), count)
        self.node, self.own = (self.flat.field(k).to_numpy(zero_copy_only=False) for k in ("node", "own"))
        self.fp = self.flat.field("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WIDE)
        self.least = self.flat.field("least").flatten().to_numpy(zero_copy_only=False).reshape(-1, LEAST)

    def pairs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members at most `most` bits apart, the nearest first in each part; of all meetings of two nodes in one.

        That is the bucket of the least hash that they share, and there the meeting of their blocks, or of their block with itself.
        """
        table = np.stack([np.bitwise_count(self.fp ^ p).sum(axis=1, dtype=np.int16) for p in pivots(WIDE)], axis=1)
        size = np.diff(self.offsets)
        for m in np.unique(size[size > 1]).tolist():
            base = self.offsets[:-1][size == m]
            i, j = np.triu_indices(m, 1)
            step = max(1, 200_000 // len(i))
            for s in range(0, len(base), step):
                a, b = (base[s : s + step, None] + i).ravel(), (base[s : s + step, None] + j).ravel()
                keep = _close(self.fp, table, a, b, most)
                a, b = a[keep], b[keep]
                keys = self.keys[self.of[a]]
                shared = (self.least[a][:, :, None] == self.least[b][:, None, :]).any(axis=2)
                first = np.where(shared, self.least[a], np.iinfo(np.int64).max).min(axis=1)
                here = (first == keys[:, 0]) & ((self.own[a] != self.own[b]) | (keys[:, 1] == keys[:, 2]))
                a, b = a[here], b[here]
                order = np.argsort(np.bitwise_count(self.fp[a] ^ self.fp[b]).sum(axis=1, dtype=np.int32), kind="stable")
                yield a[order], b[order]


def similar(x: np.ndarray, y: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether two sets, as arrays of distinct values, have a Jaccard similarity of `least` or more."""
    if min(len(x), len(y)) < int(least * max(len(x), len(y))):
        return False
    union = len(np.unique(np.concatenate([x, y])))
    return (len(x) + len(y) - union) / union >= least


def similar_links(docs: DataFrame, groups: DataFrame, most: int, shingle: int, text_col: str) -> DataFrame:
    """Links (u, v) between nodes of groups(node, fp, least, size) that share a bucket, differ in at most `most` bits and are similar.

    Only texts that have a close one are read again for their sets. Each pair that no link joins yet in its meeting is
    compared, so that the links join what all similar pairs would.
    """
    keyed = groups.select(F.explode(F.array_distinct("least")).alias("bucket"), "node", "fp", "least", "size")
    size = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).filter("n > 1")
    dealt = keyed.join(size, "bucket").withColumn("blocks", F.least(F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / SHINGLES)), F.col("n")).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.struct("node", "own", "fp", "least").alias("member"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meet = Meetings(batch)
            row = np.unique(np.concatenate([np.zeros(0, np.int64), *(x for pair in meet.pairs(most) for x in pair)]))
            kinds = [pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(pa.array(meet.keys[meet.of[row], k], t) for k, t in enumerate(kinds)), meet.flat.take(pa.array(row))], names=["bucket", "i", "j", "member"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meet, links = Meetings(batch), []
            sets = meet.flat.field("shingles")
            above = list(range(len(meet.node)))

            def root(x: int) -> int:
                while above[x] != x:
                    above[x] = x = above[above[x]]
                return x

            own = lambda x: sets[x].values.to_numpy(zero_copy_only=False)
            for a, b in meet.pairs(most):
                for x, y in zip(a.tolist(), b.tolist()):
                    if (u := root(x)) != (v := root(y)) and similar(own(x), own(y)):
                        above[max(u, v)] = min(u, v)
                        links.append((x, y))
            row = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(meet.node[row].min(axis=1)), pa.array(meet.node[row].max(axis=1))], names=["u", "v"])

    member = "struct<node: long, own: int, fp: array<long>, least: array<long>>"
    members = lambda df: df.groupBy("bucket", "i", "j").agg(F.collect_list("member").alias("members"))
    met = stored(members(dealt).mapInArrow(close, f"bucket long, i int, j int, member {member}"), "near-met").withColumn("node", F.col("member.node"))
    sets = shingle_sets(docs, met.select("node").distinct(), shingle, text_col)
    with_sets = met.join(sets, "node").select("bucket", "i", "j", F.struct("member.*", "shingles").alias("member"))
    return members(with_sets).mapInArrow(compared, "u long, v long").distinct()


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, most: int = WIDE_MOST, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, group_id) for every row of docs: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

    Texts that share one of their least shingle hashes meet in a bucket (of pairs of similarity 0.8, about one in ten
    thousand shares none of six). Pivots and the Hamming distance of 256-bit fingerprints tell which of them are compared;
    the sets themselves decide. group_id is the smallest doc_id reachable over links. Null and empty texts, and those without
    words, are one group. A null doc_id stays null and is never the smallest beside another; an empty table gives no rows.
    With row_col, a column that tells rows apart where ids don't, row and stays are returned as well: of each group one
    row stays, that of the smallest doc_id, and of equal ones that of the smallest row.
    """
    fps = stored(wide_fingerprints(docs, shingle, id_col, text_col, row_col), "wide-fp")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *([F.col("row")] if row_col else []))
    # texts of one hash are equal, so that any of their fingerprints is all of theirs; the least is the same in every run
    groups = cut(fps.groupBy("node").agg(F.min(own).alias("rep"), F.min(F.struct("fp", "least", "size")).alias("f")).select("node", "rep", "f.*"))
    roots = components(similar_links(docs, groups, most, shingle, text_col)).withColumnRenamed("node", "of")
    placed = cut(groups.join(roots, groups.node == roots.of, "left").select("node", "rep", F.coalesce("root", "node").alias("root")))
    least = placed.groupBy("root").agg(F.min("rep").alias("first"))
    found = fps.select("doc_id", "node", *(["row"] if row_col else []), own.alias("own")).join(join_hot(placed.select("node", "root"), least, "root").select("node", "first"), "node")
    return found.select("doc_id", F.col("first.doc_id").alias("group_id"), *(["row", (F.col("own") == F.col("first")).alias("stays")] if row_col else []))
