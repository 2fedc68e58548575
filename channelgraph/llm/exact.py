"""Exact deduplication by content sort.

Normalised texts are sorted across the cluster: sampled splitters deal them out by range, each task sorts what it got
(spilling where it must), equal texts stand next to each other, and each row is compared in full with the one before.
The sort key is (first characters of the normalised text, SHA-256 of all of it, id). The splitters are therefore small
however long the texts are, and a text with very many copies is cut into several ranges by the id; such a run goes on in
the next task, and the runs at the ends of tasks (two a task at most) are put together afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelgraph.llm.common import documents, settle

PREFIX_CHARS = 48
#: A task's runs and rows are numbered from its index times this.
TASK_SPAN = 1 << 36


def _lowered(text: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and nothing else changed; null is empty."""
    return pc.ascii_lower(text.fill_null(""))


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()], pa.string())


def _keys(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _lowered(pc.struct_field(batch.column(0), text_col))
            prefix = pc.utf8_slice_codeunits(texts, 0, PREFIX_CHARS)
            yield pa.RecordBatch.from_arrays([batch.column(0), prefix, _digests(texts)], ["row", "prefix", "sha"])

    return run


def _runs(id_col: str, text_col: str, whole_rows: bool):
    """Reads a task's sorted rows and tells where runs of equal texts begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * TASK_SPAN
        last, n_runs, n_rows, end = None, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = _lowered(pc.struct_field(batch.column(0), text_col))
            new = np.ones(len(texts), dtype=bool)
            new[0] = last is None or texts[0].as_py() != last
            new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
            last = texts[-1].as_py()
            run_no = pa.array(base + n_runs - 1 + np.cumsum(new))
            ordinal = pa.array(base + n_rows + np.arange(len(texts)))
            n_runs, n_rows = n_runs + int(new.sum()), n_rows + len(texts)
            row, sha = batch.column(0), batch.column(1)
            if not whole_rows:
                yield pa.RecordBatch.from_arrays([pc.struct_field(row, id_col), sha, run_no, ordinal], ["id", "sha", "run", "ord"])
                continue
            # the first row of each run, and each task's last row as a mark of where it ended
            first = pa.array(new)
            out = [row.filter(first), sha.filter(first), run_no.filter(first), pa.array(np.zeros(int(new.sum()), dtype=bool))]
            yield pa.RecordBatch.from_arrays(out, ["row", "sha", "run", "mark"])
            tail = len(texts) - 1
            end = pa.RecordBatch.from_arrays([row.slice(tail), sha.slice(tail), run_no.slice(tail), pa.array([True])], ["row", "sha", "run", "mark"])
        if whole_rows and end is not None:
            yield end

    return run


def content_sorted(docs: DataFrame, keep: str, id_col: str, text_col: str) -> DataFrame:
    """``row`` and ``sha``, equal texts adjacent across the ranges, the row to keep first in each run."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = held.mapInArrow(_keys(text_col), T.StructType([*held.schema.fields, T.StructField("prefix", T.StringType()), T.StructField("sha", T.StringType())]))
    by_id = F.col(f"row.`{id_col}`").desc_nulls_last() if keep == "largest" else F.col(f"row.`{id_col}`").asc_nulls_last()
    order = [F.col("prefix"), F.col("sha"), by_id]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "sha")


def exact_groups(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, sha (of the normalised text), keep_id, group_size, kept.

    Texts are equal when they agree after lower-casing A-Z. ``keep`` is "largest" or "smallest" (id); null ids come last
    either way, and of fully repeated rows one is kept. Null text counts as empty and equals it. An empty table gives
    no rows. Other columns of ``docs`` are not read.
    """
    narrow = docs.select(F.col(id_col), F.col(text_col))
    kind = narrow.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("sha", T.StringType()), T.StructField("run", T.LongType()), T.StructField("ord", T.LongType())])
    rows = settle(content_sorted(narrow, keep, id_col, text_col).mapInArrow(_runs(id_col, text_col, False), out), "exact-rows")
    runs = rows.groupBy("run").agg(F.count("*").alias("n"), F.min("ord").alias("head"), F.min_by("id", "ord").alias("head_id"), F.min("sha").alias("sha"))
    runs = settle(runs, "exact-runs")
    # a run may go on over the end of a task: only a task's first and last run can have a part elsewhere
    part = F.floor(F.col("run") / TASK_SPAN)
    ends = runs.groupBy(part.alias("part")).agg(F.array(F.min("run"), F.max("run")).alias("ends")).select(F.explode("ends").alias("run")).distinct()
    outer = settle(runs.join(ends, "run", "left_semi"), "exact-ends")
    same = Window.partitionBy("sha")
    joined = outer.select(
        "run",
        F.sum("n").over(same).alias("group_size"),
        F.min("head").over(same).alias("head"),
        F.min_by("head_id", "head").over(same).alias("keep_id"),
    )
    inner = runs.join(ends, "run", "left_anti").select("run", F.col("n").alias("group_size"), "head", F.col("head_id").alias("keep_id"))
    groups = settle(inner.unionByName(joined), "exact-groups")
    return rows.join(groups, "run").select("id", "sha", "keep_id", "group_size", (F.col("ord") == F.col("head")).alias("kept"))


def exact_dedup(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, one row of each group of equal texts (see :func:`exact_groups`)."""
    ordered = content_sorted(docs, keep, id_col, text_col)
    out = T.StructType([*ordered.schema.fields, T.StructField("run", T.LongType()), T.StructField("mark", T.BooleanType())])
    firsts = settle(ordered.mapInArrow(_runs(id_col, text_col, True), out), "exact-firsts")
    # a first row of a task continues a run when the text of its range ended an earlier task: one row a task at most
    part = F.floor(F.col("run") / TASK_SPAN)
    heads = firsts.filter(~F.col("mark") & (F.col("run") % TASK_SPAN == 0)).select(F.col("run"), "sha", part.alias("part"))
    tails = firsts.filter("mark").select(F.col("sha").alias("tail_sha"), part.alias("tail_part"))
    again = heads.join(tails, (F.col("sha") == F.col("tail_sha")) & (F.col("tail_part") < F.col("part")), "left_semi").select("run")
    return firsts.filter(~F.col("mark")).join(F.broadcast(again), "run", "left_anti").select("row.*")


def op3_content_sort(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


ORACLE_OP3 = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
