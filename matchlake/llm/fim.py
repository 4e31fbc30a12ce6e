"""Fill-in-middle transformation over a sparse index of the multibyte characters of UTF-8.

Text is cut at code points but lies in bytes. The index holds only the characters of more than one byte: where they
begin, and how many bytes beyond one they and those before them take. A place in code points becomes one in bytes, and
the other way round, by one searchsorted among these; between them a place differs by a constant, so ASCII costs
nothing. The index is built once for all texts of an Arrow batch, whose bytes lie side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.common import small_batches

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100: documents that are transformed, and those of them whose suffix comes first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


class SparseIndex:
    """Exception index of UTF-8 bytes; other bytes than UTF-8 count as their lead bytes say."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])
        self.char = self.at - self.excess[:-1]

    def to_byte(self, char):
        """Bytes before so many code points."""
        return char + self.excess[np.searchsorted(self.char, char)]

    def to_char(self, byte):
        """Code points before a byte that begins one, or the end."""
        return byte - self.excess[np.searchsorted(self.at, byte)]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each string begins, with the end of the last."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return own, at - at[0]


def _strings(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary()).cast(pa.string())


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """marked, h1 to h4, text, and further columns -> n, form, prefix_chars, middle_chars, output, and those columns."""
    marked, *h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
    data, at = _bytes(batch.column(5))
    index, raw = SparseIndex(data), data.tobytes()
    char = index.to_char(at)
    n = np.diff(char)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    plain = marked.astype(bool) | (n == 0) | (h[2] % 100 >= TRANSFORMED)
    last_first = h[3] % 100 < SUFFIX_FIRST
    p, m = index.to_byte(char[:-1] + low).tolist(), index.to_byte(char[:-1] + high).tolist()
    output, forms = [], []
    for i, (a, b, c, d) in enumerate(zip(at[:-1].tolist(), p, m, at[1:].tolist())):
        if plain[i]:
            forms.append("plain")
            output.append(raw[a:d])
        elif last_first[i]:
            forms.append("spm")
            output.append(b"".join((SUFFIX, raw[c:d], PREFIX, raw[a:b], MIDDLE, raw[b:c])))
        else:
            forms.append("psm")
            output.append(b"".join((PREFIX, raw[a:b], SUFFIX, raw[c:d], MIDDLE, raw[b:c])))
    cut = [pa.array(n), pa.array(forms, pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), _strings(output)]
    return pa.RecordBatch.from_arrays([*cut, *batch.columns[6:]], names=["n", "form", "prefix_chars", "middle_chars", "output", *batch.schema.names[6:]])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, carried columns): each row of docs, transformed.

    The id decides by its hash where a text is cut and in which form it goes out: `plain` as it is, `psm` as prefix,
    suffix, middle, `spm` as suffix, prefix, middle. prefix_chars and middle_chars count code points, null if plain.
    A null text is an empty one, which is plain; a null id is one of no digits. Rows with equal ids and texts have
    equal results. Texts that hold a mark already are plain, so that every output can be taken apart again.
    Columns of docs that aren't carried don't matter, whatever their names. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | text.contains(mark.decode())
    rest = [F.col(c).alias(f"carry{i}") for i, c in enumerate((id_col, *carry))]
    own = docs.select(marked.alias("marked"), *h, text.alias("text"), *rest)
    kinds = [own.schema[f"carry{i}"].dataType for i in range(1 + len(carry))]
    made = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    schema = T.StructType([T.StructField(k, v) for k, v in made + [(f"carry{i}", k) for i, k in enumerate(kinds)]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cut(batch)

    done = own.mapInArrow(work, schema)
    return done.select(F.col("carry0").alias(id_col), *[k for k, _ in made], *[F.col(f"carry{i + 1}").alias(c) for i, c in enumerate(carry)])


def restore(output: bytes, form: str) -> tuple[bytes, int | None, int | None]:
    """The text from its output and form, and the cuts in code points."""
    if form == "plain":
        return output, None, None
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    a = output.index(second, len(first))
    b = output.index(MIDDLE, a + len(second))
    head, tail, middle = output[len(first) : a], output[a + len(second) : b], output[b + len(MIDDLE) :]
    prefix, suffix = (tail, head) if form == "spm" else (head, tail)
    text = prefix + middle + suffix
    cuts = SparseIndex(np.frombuffer(text, np.uint8)).to_char(np.array([len(prefix), len(prefix) + len(middle)]))
    return text, int(cuts[0]), int(cuts[1] - cuts[0])


def restored(done: DataFrame) -> DataFrame:
    """done with restored_text, rebuilt from output and form alone.

    Cuts that the output itself shows must be those that stand beside it, or the task fails: the output is damaged.
    A null output has no text.
    """
    small_batches(done.sparkSession)
    schema = T.StructType([*done.schema.fields, T.StructField("restored_text", T.StringType())])
    names = done.columns
    at = [names.index(c) for c in ("output", "form", "prefix_chars", "middle_chars")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            output, form, prefix, middle = (batch.column(i) for i in at)
            for out, kind, *cuts in zip(output.cast(pa.binary()).to_pylist(), form.to_pylist(), prefix.to_pylist(), middle.to_pylist()):
                if out is None:
                    texts.append(None)
                    continue
                text, *found = restore(out, kind)
                if found != cuts:
                    raise ValueError(f"damaged output: it is cut after {found[0]} and {found[1]} more code points, not {cuts}")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns, _strings(texts)], names=[*names, "restored_text"])

    return done.mapInArrow(work, schema)
