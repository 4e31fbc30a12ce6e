import random
from collections import defaultdict

from matchlake.llm.packing import Plan, pack, word_lengths

SIZES = (16, 32, 64)


def best_fit(lengths, sizes, overhead):
    """Best fit decreasing, one item at a time: the rooms that are left over, sorted."""
    rooms = []
    todo = sorted(lengths, reverse=True)
    while todo:
        n = todo[0]
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
            todo.pop(0)
        else:
            left = todo.count(n)
            size = min((c for c in sizes if c >= n), key=lambda c: ((c + overhead) / (c // n), -c))
            rooms += [size] * -(-left // (size // n))
    return sorted(rooms)


def test_plan_is_best_fit():
    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = Plan(counts, SIZES, 2)
        rooms = sorted(r for r, groups in plan.open.items() for _, n, _ in groups for _ in range(n))
        assert rooms == best_fit(lengths, SIZES, 2)
        assert all(c <= size and not [s for s in SIZES if c <= s < size] for _, _, c, size in plan.bins)


def check(rows, lengths):
    by_bin, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_bin[r.bin_id].append(r)
        by_doc[r.doc_id].append(r)
    for got in by_bin.values():
        got.sort(key=lambda r: r.bin_start)
        at = 0
        for r in got:  # pieces lie one after the other
            assert r.bin_start == at
            at += r.piece_length
        assert at <= got[0].bin_size and got[0].bin_size == min(s for s in SIZES if s >= at) and len({r.bin_size for r in got}) == 1
    for doc, n in lengths.items():
        assert sum(r.piece_length for r in by_doc[doc]) == n
        assert [r.piece for r in sorted(by_doc[doc], key=lambda r: r.piece)] == list(range(-(-n // 64)))


def test_whole_packing(spark):
    rng = random.Random(4)
    lengths = {i: rng.choice([5, 5, 5, rng.randint(1, 64), rng.randint(60, 400)]) for i in range(500)}
    df = spark.createDataFrame([(i, n) for i, n in lengths.items()] + [(9000, 0), (9001, None)], "doc_id long, length long")
    rows = pack(df, SIZES, 2).collect()
    check(rows, lengths)
    assert {r.doc_id for r in rows} == set(lengths)


def test_texts(docs, empty, corpus):
    got = word_lengths(docs).collect()
    assert sorted(r.length for r in got) == sorted(len((t or "").encode().split()) + 1 for _, t in corpus)
    assert sum(r.piece_length for r in pack(word_lengths(docs)).collect()) == sum(r.length for r in got)
    assert pack(word_lengths(empty)).collect() == []


def test_null_and_repeated_ids_share_no_task(spark, monkeypatch):
    """A third of the rows without an id, a third with the same: every piece has a place of its own, in many salts."""
    from matchlake.llm import packing

    monkeypatch.setattr(packing, "RANKED", 50)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, 5 + i % 2, "clash") for i in range(1500)]
    found = pack(spark.createDataFrame(rows, "doc_id long, length long, salt string"), SIZES, 2)
    got = found.collect()
    assert len(got) == 1500 and sum(r.doc_id is None for r in got) == 500 and sum(r.doc_id == 7 for r in got) == 500
    spots = {(r.bin_id, r.bin_start) for r in got}
    assert len(spots) == 1500
    by_bin = defaultdict(list)
    for r in got:
        by_bin[r.bin_id].append((r.bin_start, r.piece_length))
    for own in by_bin.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
