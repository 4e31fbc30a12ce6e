"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An occurrence of an item of n characters with at most e edits shares at least n - q + 1 - q * e of the item's q-grams
with the document, all on diagonals (document position less item position) that differ by at most e from its first.
Shared q-grams are counted in bands of BAND diagonals that overlap by 2 * e, so one band holds all those of an
occurrence; bands that reach the bound are verified by alignment inside the band. The filter loses nothing; the
alignment decides. Items of under LONG characters have shorter grams, and those of under Q[0] characters, for which a
gram says nothing, are looked up as whole words.

Documents stay where they are: the items are the small, stated side and are given to the workers in blocks of at most
BLOCK_CHARS characters, each block against all documents. Shared grams are gone through in stretches of at most
POSTINGS pairs of places, so that memory follows neither a text's length times an item's nor how often a gram repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import small_batches, stored, words

#: Lengths of the grams of items under LONG characters, and of the others.
Q, LONG = (6, 12), 24
BAND = 32
#: Pairs of places of shared grams that are counted at a time.
POSTINGS = 1 << 18
#: Characters of benchmark items in a block; the index of a block takes about 40 times as many bytes.
BLOCK_CHARS = 2_000_000
#: Bits of the table that sorts out most positions before the exact look-up.
SIEVE = 22
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str | None) -> str:
    """A-Z lower-cased, words separated by one space."""
    return b" ".join(words(text)).decode("utf-8", "surrogatepass")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_codes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of the q characters from each position on; equal characters give equal codes."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    small = (points ^ (points >> np.uint32(8))).astype(np.uint8).tobytes() + b"\0" * 8
    eight = np.ndarray(shape=(len(points) + 1,), dtype="<u8", buffer=small, strides=(1,))
    if q < 8:
        mixed = (eight[:n] & np.uint64((1 << 8 * q) - 1)) * MIX_A
    else:
        mixed = (eight[:n] * MIX_A) ^ (eight[q - 8 : q - 8 + n] * MIX_B)
    return mixed ^ (mixed >> np.uint64(29))


def budget(n: int, rate: float) -> int:
    """Edits allowed in an item of n characters; an error if so many could leave none of its q-grams untouched."""
    most, q = int(n * rate), gram_length(n)
    if most > max(0, (n - q) // q):
        raise ValueError(f"{most} edits in {n} characters may touch all grams of {q}: the rate must be lower")
    return most


def gram_length(n: int) -> int:
    return Q[n >= LONG]


def align(item: np.ndarray, doc: np.ndarray, first: int, width: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of item in doc on diagonals first .. first + width - 1, if within most.

    Row i, column k is the cell of item character i and document position i + first + k. Starts are free; ties go to
    the earliest start.
    """
    n, unit = len(item), 1 << 32
    padded = np.full(n + width, 0xFFFFFFFF, np.uint32)
    lo, hi = max(first, 0), min(first + n + width - 1, len(doc))
    if hi <= lo:
        return None
    padded[lo - first : hi - first] = doc[lo:hi]
    columns = np.arange(width, dtype=np.int64)
    step = columns * unit
    far = np.int64(1) << 60
    cell = np.where((columns + first >= 0) & (columns + first <= len(doc)), columns, far)
    for i in range(n):
        along = cell + unit * (padded[i : i + width] != item[i])
        down = np.append(cell[1:], far) + unit
        cell = np.minimum(along, down)
        cell = np.minimum.accumulate(cell - step) + step
        if int(cell.min()) >= (most + 1) * unit:
            return None
    ends = np.flatnonzero((columns + first + n >= 0) & (columns + first + n <= len(doc)))
    if not len(ends):
        return None
    best = ends[np.argmin(cell[ends])]
    edits, k = divmod(int(cell[best]), unit)
    return (edits, first + k, first + n + int(best)) if edits <= most else None


class Items:
    """Index of items whose grams have q characters: the sieve, the sorted gram codes and where each stands."""

    def __init__(self, q: int, ids: list[int], texts: list[str], rate: float):
        self.q, self.ids, self.texts = q, ids, texts
        self.points = [code_points(t) for t in texts]
        self.most = np.array([budget(len(p), rate) for p in self.points], np.int64)
        size = np.array([len(p) - q + 1 for p in self.points], np.int64)
        self.longest = int(size.max(initial=0)) + q
        self.bound = np.maximum(size - q * self.most, 1)
        codes = [gram_codes(p, q) for p in self.points]
        code = np.concatenate([np.zeros(0, np.uint64), *codes])
        order = np.argsort(code, kind="stable")
        self.code, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.arange(len(size)), size)[order]
        self.at = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in size)])[order]
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[code >> np.uint64(64 - SIEVE)] = True

    def _counted(self, spot: np.ndarray, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, band, hits) of all bands, those that end before the places still to come as soon as they are done."""
        times = self.count[found]
        stop = np.cumsum(times)
        keys, hits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        unpack = lambda k: (k >> 40, (k & ((1 << 40) - 1)) - (1 << 30))
        for a in range(0, int(stop[-1]), POSTINGS):
            i = np.arange(a, min(a + POSTINGS, int(stop[-1])))
            p = np.searchsorted(stop, i, "right")
            where = self.first[found[p]] + i - (stop[p] - times[p])
            item, diagonal = self.item[where], spot[p] - self.at[where]
            # a band starts at each multiple of BAND and takes BAND + 2 * e diagonals, so a hit is in one band or more
            most = self.most[item]
            last = diagonal // BAND
            copies = last - (diagonal - 2 * most - BAND) // BAND
            band = np.repeat(last, copies) - (np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies))
            new, n = np.unique(np.repeat(item, copies) * (1 << 40) + band + (1 << 30), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            hits = np.bincount(back, weights=np.concatenate([hits, n]), minlength=len(keys)).astype(np.int64)
            item, band = unpack(keys)
            over = (band + 1) * BAND + 2 * self.most[item] + self.longest < spot[p[-1]]
            if over.any():
                yield item[over], band[over], hits[over]
                keys, hits = keys[~over], hits[~over]
        yield *unpack(keys), hits

    def search(self, doc: np.ndarray, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of the best occurrence of each item in a text in normal form."""
        code = gram_codes(doc, self.q)
        spot = np.flatnonzero(self.sieve[code >> np.uint64(64 - SIEVE)])
        if not len(spot) or not len(self.code):
            return []
        own = code[spot]
        found = np.minimum(np.searchsorted(self.code, own), len(self.code) - 1)
        real = self.code[found] == own
        spot, found = spot[real], found[real]
        if not len(spot) or int(self.count[found].sum()) < int(self.bound.min()):
            return []
        best: dict[int, tuple[int, int, int]] = {}
        sought: set[int] = set()
        for item, band, hits in self._counted(spot, found):
            good = hits >= self.bound[item]
            for k, b in zip(item[good].tolist(), band[good].tolist()):
                if k not in sought and (at := text.find(self.texts[k])) >= 0:
                    best[k] = (0, at, at + len(self.texts[k]))
                sought.add(k)
                # what is left to look for: fewer edits, or as many and a place before; none but an exact find has 0
                e = most = int(self.most[k])
                if k in best:
                    most = best[k][0] - (b * BAND - e > best[k][1])
                if most < 1:
                    continue
                got = align(self.points[k], doc, b * BAND - e, BAND + 4 * e, most)
                if got and (k not in best or got < best[k]):
                    best[k] = got
        return [(self.ids[k], *best[k]) for k in sorted(best)]


class Block:
    """A block of items, by length: whole words, short grams, long grams."""

    def __init__(self, ids: list[int], texts: list[str], rate: float):
        own = [(i, t) for i, t in zip(ids, map(normal, texts)) if t]
        self.few: dict[int, dict[tuple[str, ...], list[int]]] = {}
        for i, t in own:
            if len(t) < Q[0]:
                w = tuple(t.split(" "))
                self.few.setdefault(len(w), {}).setdefault(w, []).append(i)
        parts = [(q, [x for x in own if len(x[1]) >= Q[0] and gram_length(len(x[1])) == q]) for q in Q]
        self.items = [Items(q, [i for i, _ in part], [t for _, t in part], rate) for q, part in parts if part]

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        plain = normal(text)
        doc = code_points(plain)
        out = [hit for items in self.items for hit in items.search(doc, plain)]
        if self.few:
            own = plain.split(" ")
            for n, known in self.few.items():
                for w in known.keys() & set(zip(*(own[i:] for i in range(n)))):
                    at = f" {plain} ".find(f" {' '.join(w)} ")
                    out += [(i, 0, at, at + len(" ".join(w))) for i in known[w]]
        return out


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS, row_col: str | None = None) -> DataFrame:
    """doc_id, item_id, edits, start, end for each item that occurs in a row of docs with at most rate edits a character.

    Start and end count the characters of the document's normal form (A-Z lower-cased, words separated by one space).
    Of several occurrences of an item the one of fewest edits, then the first, is given. Items of fewer than Q[0]
    characters occur where their words stand, unchanged; items without words, or null, match nothing. Null and empty
    texts hold nothing. Repeated rows give repeated results; an empty table on either side gives none; further columns
    are not read. Beyond one block each block's matches are written before the next is taken to the driver. A column
    named by row_col, which tells rows apart where ids don't, is returned as row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    read = docs.select(F.col(id_col).cast("long"), text_col, *([row_col] if row_col else []))
    items = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item")).filter("item IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("item")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(chars) // block_chars))
    names = ["doc_id", "item_id", "edits", "start", "end", *(["row"] if row_col else [])]
    schema = "doc_id long, item_id long, edits long, start long, end long" + (f", row {docs.schema[row_col].dataType.simpleString()}" if row_col else "")

    def against(block) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Block(*block.value, rate)
            for batch in batches:
                rows = [(at, *hit) for at, text in enumerate(batch.column(1).to_pylist()) for hit in index.search(text)]
                at, *columns = (pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * 5))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *columns, *(c.take(at) for c in batch.columns[2:])], names=names)

        return read.mapInArrow(work, schema)

    found = []
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == b).toArrow()
        block = spark.sparkContext.broadcast((own.column(0).to_pylist(), own.column(1).to_pylist()))
        if blocks == 1:
            return against(block)
        found.append(stored(against(block), "contaminated"))
        block.destroy()
    return reduce(DataFrame.unionByName, found)
