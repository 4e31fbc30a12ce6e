"""Token counts of byte-level BPE by prefix dynamic programming.

The text is split as the vocabulary's pre-tokenizer does. Inside a piece, last[i] is the last token of the encoding of
the piece's first i bytes and count[i] its number of tokens: last[i] is the one token t that ends there and may follow
last[i - len(t)], and count[i] = count[i - len(t)] + 1. The counts at all prefixes are then known without encoding any
of them. A text's table holds, for each code point, by how much the count of the prefix that ends with it differs from
that of the prefix before, in one signed byte (nine where one doesn't hold it): sums over it give the exact token count of every prefix, and so answer
any truncation or budget.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import small_batches, stored

#: Fixed value: how byte-level BPE splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the contractions that the split takes before anything else.
SHORT = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Pieces that a worker remembers in each of two generations; the older one goes when the younger is full. Longer ones aren't.
REMEMBER, LENGTH = 500_000, 100


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Steps of each piece, worked out when they are first asked for: one signed byte for each code point."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec.get("normalizer"):
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.vocab = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        #: The length of the longest token that ends with two bytes.
        self.ends: dict[bytes, int] = {}
        for token in sorted(self.vocab, key=len):
            if len(token) > 1:
                self.ends[token[-2:]] = len(token)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split, self.space = regex.compile(SPLIT), regex.compile(r"\s\s+(?=\S)")
        #: For each token: the rank of the merge that makes it and the length of that merge's left part.
        self.made = {bytes([b]): (-1, 0) for b in range(256)} | {a + b: (r, len(a)) for (a, b), r in self.rank.items()}
        if len(self.made) != len(self.rank) + 256:
            raise ValueError(f"{path} makes a token by more than one merge")
        self.alone: dict[bytes, bool] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE: join the pair of the lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, token: bytes) -> bool:
        """Whether the token's own bytes are encoded as this one token."""
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = self.merged(token) == [token]
        return found

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether the border between two tokens outlives the merges of a + b.

        Undo the merges at the border from the last one back: as long as two neighbours across it stand side by side,
        their own pair must not come up before the merge that takes one of them away.
        """
        rank, made = self.rank, self.made
        before = 1 << 60
        while True:
            if rank.get((a, b), 1 << 60) < before:
                return False
            (ra, cut_a), (rb, cut_b) = made[a], made[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, a[cut_a:]
            else:  # equal pairs merge from the left
                before, b = rb + 1, b[:cut_b]

    def prefixes(self, data: bytes) -> list[int]:
        """Token count of each prefix of a piece, from the empty one to the whole."""
        vocab, last, count, ends = self.vocab, [b""], [0], self.ends
        for end in range(1, len(data) + 1):
            # no token that ends with these two bytes is longer
            for start in range(max(0, end - ends.get(data[end - 2 : end], 1)) if end > 1 else 0, end):
                token = data[start:end]
                if token in vocab and (self.may_follow(last[start], token) if start else self.whole(token)):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        return count

    def __missing__(self, piece: str) -> bytes:
        if len(self) > REMEMBER:
            self.older = dict(self)
            self.clear()
        found = self.older.get(piece)
        if found is None:
            found = self.worked_out(piece)
        if len(piece) <= LENGTH:
            self[piece] = found
        return found

    def worked_out(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        counts = self.prefixes(data)
        if len(data) > len(piece):  # a prefix of the text ends with a code point
            counts = [c for i, c in enumerate(counts) if i == len(data) or data[i] & 0xC0 != 0x80]
        if piece in SHORT:  # cut short it is a sign and a letter
            counts[1:-1] = range(1, len(piece))
        steps = [b - a for a, b in zip(counts, counts[1:])]
        return bytes([x & 255 for x in steps]) if max(steps) < 128 > -min(steps) else packed(steps)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text, and the special strings between them (True)."""
        if not self.special or "<" not in text and not self.special.search(text):
            yield text, False
            return
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    def total(self, text: str) -> int:
        """Token count of a text that ends there, by its pieces; no special strings."""
        return int(sum(unpacked(self[p]).sum() for p in self.split.findall(text)))

    def steps(self, text: str) -> bytes:
        """The table of a text: sums over its first i bytes give the token count of the text's first i code points."""
        out: list[bytes] = []
        before = ""
        for part, special in self.parts(text):
            if special:
                # cut short, a special string is ordinary text that may join what stands before it
                at = [self.total(before + part[:i]) for i in range(len(part))]
                out.append(packed(np.diff([*at, at[0] + 1])))
                before = ""
                continue
            before = part
            own = b"".join(map(self.__getitem__, self.split.findall(part)))
            if self.space.search(part):
                own = self.with_spaces(part, own)
            out.append(own)
        return b"".join(out)

    def with_spaces(self, part: str, own: bytes) -> bytes:
        """Steps where a prefix may end with several blanks: there they stay together, of which the last joins the next word in the whole text."""
        steps = unpacked(own)
        for m in self.space.finditer(part):
            a, b = m.span()
            more = int(unpacked(self[part[a:b]]).sum() - steps[a:b].sum())
            steps[b - 1] += more
            steps[b] -= more
        return packed(steps)


#: A step that a byte doesn't hold: this byte, and the step in eight more.
WIDE = b"\x80"


def packed(steps: np.ndarray) -> bytes:
    """A byte for each step, nine for one beyond 127 either way."""
    steps = np.asarray(steps, np.int64)
    out, at = [], 0
    for i in np.flatnonzero(np.abs(steps) > 127).tolist():
        out += [steps[at:i].astype(np.int8).tobytes(), WIDE, struct.pack("<q", steps[i])]
        at = i + 1
    return b"".join([*out, steps[at:].astype(np.int8).tobytes()])


def unpacked(data: bytes) -> np.ndarray:
    out, at = [], 0
    while (wide := data.find(WIDE, at)) >= 0:
        out += [np.frombuffer(data[at:wide], np.int8).astype(np.int64), np.frombuffer(data, "<i8", 1, wide + 1)]
        at = wide + 9
    return np.concatenate([*out, np.frombuffer(data[at:], np.int8).astype(np.int64)])


def counts_of(steps: bytes) -> np.ndarray:
    """Token counts of all prefixes, from the empty one to the whole text."""
    return np.concatenate([[0], np.cumsum(unpacked(steps))])


def longest_within(steps: bytes, limit: int) -> int:
    """Code points of the longest prefix of at most `limit` tokens."""
    return int(np.flatnonzero(counts_of(steps) <= limit)[-1])


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One vocabulary a worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def token_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, steps for every row of docs: the token counts of all prefixes of its text (see counts_of).

    Counts are those of the library for the vocabulary at path, without added tokens. Null texts are empty; an empty
    text has 0 tokens and no steps. Repeated rows give repeated results, an empty table none; further columns are not
    read.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            steps = [known.steps(t) for t in texts]
            n = [int(unpacked(x).sum()) for x in steps]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(steps, pa.binary())], names=["doc_id", "n_bytes", "n_tokens", "steps"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, steps binary")


def within_limit(table: DataFrame, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_chars from a token table: cut_chars is the longest prefix, in code points, of at most limit tokens."""
    small_batches(table.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [longest_within(steps, limit) if n > limit else len(unpacked(steps)) for n, steps in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cut, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "cut_chars"])

    found = table.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, cut_chars long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token table of docs, written, and the answers to a budget of limit tokens from it."""
    return within_limit(stored(token_table(docs, path, id_col, text_col), "token-table"), limit)
