"""Fill-in-middle: the sparse index against Python's strings, every row against the rule written out, round trips."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchlake.llm.fim import SparseIndex, fill_in_middle, restore, restored


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_index_converts_both_ways(text):
    data = text.encode()
    index = SparseIndex(np.frombuffer(data, np.uint8))
    for chars in range(len(text) + 1):
        size = len(text[:chars].encode())
        assert index.to_byte(chars) == size and index.to_char(size) == chars


def test_index_holds_exceptions_only():
    assert len(SparseIndex(np.frombuffer(b"plain ascii" * 1000, np.uint8)).at) == 0
    assert len(SparseIndex(np.frombuffer(("a" * 999 + "é").encode(), np.uint8)).at) == 1


def plainly(doc_id, text):
    """The rule, over a Python string."""
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


EXTRA = [(i, t) for i, t in enumerate(["<P>", "a<S>b", "x<M>", "<", "<S", "<<P", "P><S", "漢字🙂é" * 50, "🙂", "﻿á", "é<" * 9, "a" * 100_000 + "é" + "b" * 100_000], 5000)]


def test_every_row_against_the_rule(spark, docs, corpus):
    more = spark.createDataFrame([(i, t, "en", "src", "x", 1, 2.0, "k") for i, t in EXTRA], docs.schema)
    found = restored(fill_in_middle(docs.union(more), carry=("lang", "row"))).collect()
    key = lambda r: (str(r[0]), r[5], str(r))
    assert sorted((tuple(r[:6]) for r in found), key=key) == sorted((plainly(i, t) for i, t in corpus + EXTRA), key=key)
    assert {r.lang for r in found} == {"en"} and {r.row for r in found} == {1}
    assert sorted(r.restored_text for r in found) == sorted(t or "" for _, t in corpus + EXTRA)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_ids_of_any_kind_and_empty_tables(spark, docs, empty):
    assert fill_in_middle(empty).collect() == []
    assert restored(fill_in_middle(empty)).collect() == []
    words = docs.select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("text").alias("output"))
    row = fill_in_middle(words.filter("doc_id = 'k903'"), text_col="output").first()
    assert tuple(row) == plainly("k903", "a")


def test_damaged_output_fails(spark, docs):
    done = fill_in_middle(docs.filter("doc_id < 60")).filter("form = 'psm'").limit(1)
    with pytest.raises(Exception, match="damaged output"):
        restored(done.withColumn("prefix_chars", F.col("prefix_chars") + 1)).collect()


def test_restore_alone():
    assert restore("<S>zz<P>é<M>yy".encode(), "spm") == ("éyyzz".encode(), 1, 2)
    assert restore(b"<P><<S><<M><", "psm") == (b"<<<", 1, 1)
