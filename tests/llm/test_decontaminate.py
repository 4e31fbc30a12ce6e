import random
import tracemalloc

from matchlake.llm import decontaminate as dc


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def least_edits(item, doc):
    """Fewest edits of item against any substring of doc."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(doc):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def changed(rng, text, n):
    s = list(text)
    for _ in range(n):
        i, kind = rng.randrange(len(s)), rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("qxz")
        elif kind == 1:
            s.insert(i, rng.choice("qxz"))
        else:
            del s[i]
    return "".join(s)


def test_against_brute_force(spark, corpus):
    rng = random.Random(11)
    texts = [t for _, t in corpus[:20]]
    items = [(i, dc.normal(t)[:130].strip()) for i, t in enumerate(texts[:8])]
    items += [(10 + n, "".join(rng.choice("bcdfgh ") for _ in range(n)).replace(" ", "x")) for n in (6, 9, 11, 12, 15, 19, 20, 21, 23, 24, 30, 36)] + [(50, None), (51, ""), (52, " \t"), (53, "Qw"), (54, "q w e")]
    long = [(i, t) for i, t in items if len(dc.normal(t)) >= dc.Q[0]]
    rows = []
    for n in range(60):
        k, host = rng.randrange(8), rng.choice(texts[8:])[:300]
        e = rng.randrange(12)
        at = rng.randrange(len(host))
        rows.append((n, host[:at] + " " + changed(rng, items[k][1], e).upper() + " " + host[at:]))
    for n in range(60, 200):
        k, host = rng.choice(long)[1], rng.choice(texts[8:])[:200]
        rows.append((n + 1000, f"{host} {changed(rng, k, rng.randrange(3))} {host}"))
    rows += [(2000, "a qw z"), (2001, "aqw qwz"), (2002, "q w"), (2003, "x q  W\te"), (2004, "qw")]
    rows += [(n + 100, t[:400]) for n, t in enumerate(texts[8:])] + [(None, None), (200, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = set()
    for i, t in rows:
        for k, item in long:
            most = int(len(dc.normal(item)) * 0.05)
            d = least_edits(dc.normal(item), dc.normal(t))
            if d <= most:
                want.add((i, k, d))
    want |= {(2000, 53, 0), (2004, 53, 0), (2003, 54, 0)}
    for chars in (dc.BLOCK_CHARS, 300):
        got = dc.contaminated(docs, bench, block_chars=chars).collect()
        assert {(r.doc_id, r.item_id, r.edits) for r in got} == want and len(got) == len(want)
    for r in got:
        assert edits(dc.normal(dict(items)[r.item_id]), dc.normal(dict(rows)[r.doc_id])[r.start : r.end]) == r.edits
    assert 20 < len(want)


def test_empty_sides(spark, docs, empty):
    bench = spark.createDataFrame([(1, "a passage that is long enough to be looked for")], "item_id long, text string")
    assert dc.contaminated(empty, bench).collect() == []
    assert dc.contaminated(docs, bench.limit(0)).collect() == []


def test_repeated_grams_take_bounded_memory():
    """A text and an item that share all of their grams everywhere, as they are and with one letter changed."""
    item, text = "x " * 1000, "x " * 3000
    for own, edits in ((item, 0), (item[:900] + "q" + item[901:], 1)):
        block = dc.Block([1], [own], 0.05)
        tracemalloc.start()
        ((i, e, start, _),) = block.search(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (i, e, start) == (1, edits, 0) and peak < 200 << 20


def test_stretches_change_nothing(monkeypatch):
    rng = random.Random(13)
    texts = ["".join(rng.choice("ab ") for _ in range(2000)) for _ in range(3)]
    items = [dc.normal(texts[0])[100:140], dc.normal(texts[1])[5:300], "ab" * 20, "a b" * 30]
    whole = [dc.Block(list(range(4)), items, 0.05).search(t) for t in texts]
    assert whole[0] and whole[1]
    monkeypatch.setattr(dc, "POSTINGS", 97)
    assert [dc.Block(list(range(4)), items, 0.05).search(t) for t in texts] == whole
