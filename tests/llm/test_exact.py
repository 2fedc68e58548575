import hashlib
from collections import defaultdict

from channelgraph.llm.exact import exact_dedup, exact_groups

ROWS = [
    (1, "Hello World"), (2, "hello world"), (3, "HELLO WORLD"), (4, "Élan"), (5, "élan"), (6, None), (7, ""), (8, "b" * 300_000),
    (9, "B" * 300_000), (9, "B" * 300_000), (None, "hello world"), (10, "a"), (11, "other"), (None, None), (12, "b" * 299_999 + "c"),
]


def lower(text):
    return (text or "").encode().lower()


def test_groups(docs_of, clashing):
    for df in (docs_of(ROWS), clashing(docs_of(ROWS)).repartition(7)):
        for keep, pick in (("largest", max), ("smallest", min)):
            rows = exact_groups(df, keep).collect()
            groups = defaultdict(list)
            for i, text in ROWS:
                groups[hashlib.sha256(lower(text)).hexdigest()].append(i)
            assert sorted((r["sha"], r["id"] or 0) for r in rows) == sorted((s, i or 0) for s, g in groups.items() for i in g)
            kept = defaultdict(int)
            for r in rows:
                group = groups[r["sha"]]
                assert r["group_size"] == len(group)
                assert r["keep_id"] == pick(i for i in group if i is not None)
                kept[r["sha"]] += r["kept"]
                assert not r["kept"] or r["id"] == r["keep_id"]
            assert set(kept.values()) == {1}


def test_a_run_over_many_tasks(spark, docs_of):
    docs = docs_of([(i, "same" if i % 3 else f"own {i}") for i in range(3000)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = exact_groups(docs).collect()
        assert {r["keep_id"] for r in rows if r["group_size"] > 1} == {2999}
        assert sum(r["kept"] for r in rows) == 1001 and {r["group_size"] for r in rows} == {1, 2000}
        assert sorted(r["doc_id"] for r in exact_dedup(docs).collect()) == sorted([2999, *range(0, 3000, 3)])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dedup_keeps_columns(docs_of, clashing):
    df = clashing(docs_of(ROWS))
    out = exact_dedup(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert sorted(lower(r["text"]) for r in rows) == sorted({lower(t) for _, t in ROWS})
    assert all(r["row"] == "own-row" for r in rows)


def test_empty_table(docs_of):
    assert exact_groups(docs_of([])).collect() == [] and exact_dedup(docs_of([])).collect() == []
