import random

import pytest

import corpus_pipeline
from channelgraph.llm.mixing import source_rates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(draw, n=80):
    text = " ".join("".join(draw.choice("aeiorstn") for _ in range(draw.randrange(2, 9))) for _ in range(n)) + "."
    return text.capitalize() if draw.random() < 0.5 else text


def junk(draw):
    return " ".join(draw.choice(["BUY!!", "NOW!!", "x$$$"]) for _ in range(40))


@pytest.fixture(scope="module")
def tables(spark, docs_of, clashing, small):
    draw = random.Random(11)
    texts = {i: prose(draw) for i in range(300)} | {i: junk(draw) for i in range(300, 420)}
    texts |= {500 + i: texts[i][0].swapcase() + texts[i][1:] if i % 2 else texts[i] for i in range(30)}  # equal after lower-casing
    texts |= {600 + i: texts[100 + i] + " " + prose(draw, 3) for i in range(30)}  # near
    texts |= {700: None, 701: "", 702: prose(draw, 20_000)}
    docs = docs_of([(i, t, f"s{i % 4}" if i % 3 else "hot") for i, t in texts.items()])
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(420)], "doc_id long, quality int, toxic int")
    return small(documents=docs, labels=labels), texts


def test_stages(spark, tables):
    folder, texts = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == COLUMNS
        docs = spark.createDataFrame(out.collect(), docs.schema)
        held.append([r["doc_id"] for r in docs.collect()])
    quality, exact, near, mixed = held
    clean = [i for i in range(300)]
    assert set(clean) <= set(quality) and not set(quality) & set(range(300, 420)) and len(quality) == len(set(quality))
    assert set(quality) - set(exact) >= set(range(30)) and set(range(500, 530)) <= set(exact)
    assert set(exact) - set(near) == set(range(600, 630))
    assert set(mixed) <= set(near) and abs(len(mixed) - len(near)) < 80 and len(mixed) > len(set(mixed))
    by_source = {r["source"]: r["rate"] for r in source_rates(docs).collect()}
    assert by_source["hot"] < min(v for k, v in by_source.items() if k != "hot")


def test_run_packs_what_was_drawn(spark, tables):
    folder, texts = tables
    rows = corpus_pipeline.run(spark, folder).withColumnRenamed("doc_id", "id").collect()
    copies = {}
    for r in rows:
        copies[r["id"], r["piece"]] = copies.get((r["id"], r["piece"]), 0) + 1
    # each copy of a document has all of its pieces
    assert all(n == copies[i, 0] for (i, _), n in copies.items())
    ends = {}
    for r in rows:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(ends) <= 1.25 * sum(r["length"] for r in rows) / 4096 + 1


def test_stages_take_empty_tables(spark, docs_of, small):
    folder = small(documents=docs_of([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, folder).collect() == []
