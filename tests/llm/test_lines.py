import random
from collections import Counter

from matchlake.llm.lines import LineRuns, drop_frequent_lines

BLANK = " \t\n\r\x0b\x0c"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(corpus, min_docs, min_chars=1):
    seen = Counter(k for _, t in corpus for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or seen[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def rows(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect())


def test_against_brute_force(docs, corpus):
    want = brute(corpus, 10)
    assert rows(drop_frequent_lines(docs, 10)) == want
    assert rows(drop_frequent_lines(docs, 10, few_settled=0)) == want  # by the join
    assert rows(drop_frequent_lines(docs, 10, batches=7)) == want  # several levels of runs
    assert sum(n for (i, _, m, _), n in want.items() if m) >= 15


def test_short_lines_stay(docs, corpus):
    assert rows(drop_frequent_lines(docs, 2, min_chars=5)) == brute(corpus, 2, 5)


def test_carried_columns_and_empty(docs, empty):
    got = drop_frequent_lines(docs, 10, carry=("score", "row", "lang"))
    assert got.columns[-3:] == ["score", "row", "lang"] and {tuple(r)[-3:] for r in got.collect()} == {(2.0, 1, "en")}
    assert drop_frequent_lines(empty, 10).collect() == []


def test_runs_are_merged_where_they_lie(spark):
    """Batch, anti-join and compaction: one shuffle of the new lines, and no sort of what is a run already."""
    rng = random.Random(2)
    lines = spark.createDataFrame([(rng.randrange(500), rng.randrange(3)) for _ in range(4000)], "h long, g long").cache()
    runs = LineRuns(spark, 4)
    total = Counter()
    for b in range(8):
        part = lines.filter(f"abs(xxhash64(h, g, {b})) % 8 < 2")
        total.update((r.h, r.g) for r in part.collect())
        runs.add(part)
    again = runs.batch(lines)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert runs.settled and plan.count("SortMergeJoin") == 1 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert plan.index("SortMergeJoin") < plan.index("Exchange") < plan.index("partial_count")
    plan = runs._merge(runs.levels[-1][0], runs.settled[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    settled = {(r.h, r.g): r.n for r in runs.finish().collect()}
    assert settled.keys() == {k for k, n in total.items() if n >= 4}
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("run_", "settled_", "merged_")) and t.name.endswith(runs.dir.rpartition("-")[2])]


def test_stores_are_closed_in_both_branches(spark, docs):
    """No table stays in the catalog, and the session's settings are as they were."""
    from matchlake.llm.lines import SORTED

    before, tables = spark.conf.get(SORTED), {t.name for t in spark.catalog.listTables()}
    for few in (0, 1000):
        drop_frequent_lines(docs, 10, few_settled=few).collect()
        assert {t.name for t in spark.catalog.listTables()} == tables and spark.conf.get(SORTED) == before
