"""Removal of long repeated byte strings.

Only stretches that can hold a repeat are brought together. Every string of ``least`` bytes has an anchor, its stretch of
GRAM bytes with the smallest hash, which is the same wherever the string stands. Strings in a row with one anchor are a
segment. Segments whose anchor occurs once are left; equal segments are one text with a count; what is left of an anchor
goes to one task, where the suffixes of its texts are sorted and intervals on their Burrows-Wheeler transform find the
strings that start twice (:mod:`channelgraph.llm.suffixes`).

An anchor with very many different segments (the edge of a passage that many documents quote) is divided: its strings are
dealt out by where the anchor stands in them, each part keyed by all bytes that its strings have in common, which are more
than the anchor's. Parts in one text only drop out, and after three such steps a part is a single string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelgraph.llm.common import byte_slices, documents, drop_settled, settle, utf8
from channelgraph.llm.hashing import U, Stretches, digests
from channelgraph.llm.suffixes import sharing

LEAST = 200
GRAM = 40
#: Different texts of an anchor that one task sorts together; more are divided, DIVIDE ways a step.
TOGETHER, DIVIDE = 512, 8
SLICE = 1 << 20
#: Bytes of texts whose suffixes are sorted at once.
SORTED = 1 << 20
SEGMENT = "id long, th long, start long, m int, anchor int, key long, same long, left long, right long"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text (null: empty) and th, a hash of the text: rows that agree in id and th are interchangeable."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))


def _squeezed(texts: DataFrame) -> DataFrame:
    """The same with compressed text, to be moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([squeeze.compress(t.as_buffer()) for t in utf8(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["id", "th", "z"])

    return texts.mapInArrow(run, "id long, th long, z binary")


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring numbers."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def _segments(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(2))
            for a, b in byte_slices(texts, texts, SLICE):
                ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset + a : texts.offset + b + 1].astype(np.int64)
                if ends[-1] - ends[0] < least:
                    continue
                data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
                ends = ends - ends[0]
                hashed = Stretches(data)
                grams = hashed.fixed(GRAM)
                # a hash's lower bits give way to its place, so that the least one is also the first of equals
                bits = U(int(len(grams)).bit_length())
                placed = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
                anchors = (sliding_least(placed, least - GRAM + 1) & ((U(1) << bits) - U(1))).astype(np.int64)
                own = np.zeros(len(anchors), dtype=bool)
                doc = np.repeat(np.arange(b - a), np.diff(ends))[: len(anchors)]
                own[:] = np.arange(len(anchors)) + least <= ends[doc + 1]
                new = own.copy()
                new[1:] &= (anchors[1:] != anchors[:-1]) | ~own[:-1] | (doc[1:] != doc[:-1])
                start = np.flatnonzero(new)
                if not len(start):
                    continue
                serial = np.cumsum(new) - 1
                m = np.bincount(serial[own], minlength=len(start))
                stop = start + m + (least - 1)
                held = data.tobytes()
                same = digests([held[i:j] for i, j in zip(start.tolist(), stop.tolist(), strict=True)])
                # the bytes on either side of the anchor: a string of which half the rest lies on that side holds them
                at, side = anchors[start], (least - GRAM + 1) // 2
                left = pa.array(hashed(np.maximum(at - side, 0), at).view(np.int64), mask=at - side < start)
                right = pa.array(hashed(at + GRAM, np.minimum(at + GRAM + side, len(data))).view(np.int64), mask=at + GRAM + side > stop)
                row = pa.array(a + doc[start])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row), batch.column(1).take(row), pa.array(start - ends[doc[start]]), pa.array(m.astype(np.int32)),
                        pa.array((anchors[start] - start).astype(np.int32)), pa.array(grams[anchors[start]].view(np.int64)), pa.array(same.view(np.int64)), left, right,
                    ],
                    ["id", "th", "start", "m", "anchor", "key", "same", "left", "right"],
                )

    return run


def _bodies(least: int):
    """Cuts the wanted segments out of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            held = 0
            for z, listed in zip(batch.column(0), batch.column(1), strict=True):
                wanted = listed.as_py()
                text = expand.decompress(z.as_buffer()) if wanted else b""
                for w in wanted:
                    for i, name in enumerate(("root", "m", "anchor", "key")):
                        out[i].append(w[name])
                    out[4].append(text[w["start"] : w["start"] + w["m"] + least - 1])
                    held += len(out[4][-1])
                if held > 2 << 20:
                    yield _body_batch(out)
                    out, held = [[], [], [], [], []], 0
            if out[0]:
                yield _body_batch(out)

    return run


def _body_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["root", "m", "anchor", "key", "body"])


PART = "root long, lead int, m int, anchor int, low int, high int, key long, same long, count long, body binary"


def _divided(least: int):
    """Deals the strings of a segment out by the anchor's place in them, DIVIDE ways.

    A string with the anchor ``o`` bytes after its start belongs to the range low <= o < high; all strings of a range have
    the bytes from ``low`` before the anchor to ``least`` - high + 1 after its start in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PART.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for r in batch.to_pylist():
                step = -(-(r["high"] - r["low"]) // DIVIDE)
                for low in range(r["low"], r["high"], step):
                    high = min(low + step, r["high"])
                    first, last = max(0, r["anchor"] - high + 1), min(r["m"], r["anchor"] - low + 1)
                    if first >= last:
                        continue
                    common = r["body"][r["anchor"] - low : r["anchor"] + least - high + 1]
                    body = r["body"][first : last + least - 1]
                    key, same = digests([b"%d %d " % (low, high) + common, body]).astype(np.int64)
                    row = (r["root"], r["lead"] + first, last - first, r["anchor"] - first, low, high, int(key), int(same), r["count"], body)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[f.split()[1]]) for x, f in zip(out, PART.split(", "), strict=True)], names)

    return run


def _marked(least: int):
    """The starts of repeated strings in each text; rows come sorted by key, and a key's texts are sorted together."""

    def marks(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        found = sharing([r[3] for r in rows], least)
        at, out = 0, [[], [], [], []]
        for key, same, m, body in rows:
            edge = np.flatnonzero(np.diff(np.concatenate([[False], found[at : at + m], [False]]).astype(np.int8)))
            at += len(body) + 1
            for a, b in edge.reshape(-1, 2).tolist():
                for column, value in zip(out, (key, same, a, b), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["key", "same", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, key = [], 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                if row[0] != key:
                    key = row[0]
                    if held >= SORTED:
                        yield from marks(rows)
                        rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        yield from marks(rows)

    return run


def repeated_starts(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, a, b: the strings of ``least`` bytes that start in [a, b) of this text start elsewhere too."""
    texts = _texts(docs, id_col, text_col)
    segments = settle(texts.mapInArrow(_segments(least), SEGMENT), "repeat-segments")
    # written first: a join of two tables as they stand can split the rows of an anchor that is everywhere
    often = settle(segments.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeat-anchors")
    segments_left = settle(segments.join(often, "key"), "repeat-candidates")
    drop_settled(segments)
    place = F.struct("id", "th", "start", "anchor")
    sides = [F.first(c).alias(c) for c in ("left", "right")]
    roots = segments_left.groupBy("key", "same", "m").agg(F.count("*").alias("count"), F.min(place).alias("place"), *sides)
    roots = settle(roots.withColumn("root", F.monotonically_increasing_id()), "repeat-roots")

    # a text that stands several times repeats whole. Others share a string only with texts of the same anchor that agree with
    # them on one side of it at least, so the rest need not be moved and sorted; unequal hashes prove unequal bytes
    ends = roots.select("root", "key", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.col("left").alias("side")), F.struct(F.lit(1).alias("at"), F.col("right").alias("side")))).alias("end"))
    ends = ends.select("root", "key", "end.*").filter(F.col("side").isNotNull())
    met = ends.groupBy("key", "at", "side").agg(F.count("*").alias("n")).filter("n > 1").select("key", "at", "side")
    several = roots.join(ends.join(met, ["key", "at", "side"], "left_semi").select("root").distinct(), "root", "left_semi")
    wanted = several.groupBy("place.id", "place.th").agg(F.collect_list(F.struct("root", "m", "place.anchor", "place.start", "key", "count")).alias("wanted"))
    wanted = wanted.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "wanted")
    # rows that agree in id and text are one text; each segment is cut out of one of them
    held = _squeezed(texts).join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    cut = held.select("z", "wanted").mapInArrow(_bodies(least), "root long, m int, anchor int, key long, body binary").dropDuplicates(["root"])
    bodies = settle(cut.join(roots.select("root", "same", "count"), "root"), "repeat-bodies")

    level = bodies.select("root", F.lit(0).alias("lead"), "m", "anchor", F.lit(0).alias("low"), F.lit(least - GRAM + 1).alias("high"), "key", "same", "count", "body")
    parts = None
    while True:
        distinct = level.groupBy("key", "same").agg(F.sum("count").alias("total"))
        keys = distinct.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("total").alias("total"))
        keys = settle(keys.filter("total > 1"), "repeat-keys")
        crowded = keys.filter(F.col("kinds") > TOGETHER).select("key")
        ready = level.join(keys.filter(F.col("kinds") <= TOGETHER).select("key"), "key")
        parts = ready if parts is None else parts.unionByName(ready)
        if crowded.isEmpty():
            break
        level = settle(level.join(crowded, "key", "left_semi").select(*[f.split()[0] for f in PART.split(", ")]).mapInArrow(_divided(least), PART), "repeat-level")
    parts = settle(parts, "repeat-parts")

    sorted_texts = parts.groupBy("key", "same", "m").agg(F.first("body").alias("body")).select("key", "same", "m", "body")
    marked = sorted_texts.repartition("key").sortWithinPartitions("key", "same").mapInArrow(_marked(least), "key long, same long, a int, b int")
    twice = parts.groupBy("key", "same", "m").agg(F.sum("count").alias("count")).filter("count > 1")
    whole = twice.select("key", "same", F.lit(0).alias("a"), F.col("m").alias("b"))
    found = settle(marked.unionByName(whole), "repeat-marks")
    spans = parts.select("root", "lead", "key", "same").join(found, ["key", "same"])
    spans = spans.select("root", (F.col("lead") + F.col("a")).alias("a"), (F.col("lead") + F.col("b")).alias("b"))
    alone = roots.filter("count > 1").select("root", F.lit(0).alias("a"), F.col("m").alias("b"))
    spans = roots.select("root", "key", "same", "m").join(spans.unionByName(alone).distinct(), "root").drop("root")
    out = segments_left.select("id", "th", "start", "key", "same", "m").join(spans, ["key", "same", "m"])
    return out.select("id", "th", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def covered(starts: list[dict], least: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under strings that start in the given ranges."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"] + least - 1) for s in starts):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def without_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans (array of start and end of the removed runs), kept (binary).

    A byte goes when a string of ``least`` bytes over it also starts anywhere else in the table, overlaps and the same
    document included, judged on the texts as they came. Null text is empty; repeated rows count as often as they stand.
    Shorter texts stay whole. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    starts = repeated_starts(docs, least, id_col, text_col)
    listed = starts.groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("starts"))
    listed = listed.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "starts")
    joined = _squeezed(_texts(docs, id_col, text_col)).join(listed, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                sizes, spans, kept = [], [], []
                for z, s in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    text = expand.decompress(z.as_buffer())
                    runs, at, pieces = covered(s or [], least), 0, []
                    for a, b in runs:
                        pieces.append(text[at:a])
                        at = b
                    sizes.append(len(text))
                    spans.append([{"start": a, "end": b} for a, b in runs])
                    kept.append(b"".join([*pieces, text[at:]]) if runs else text)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return joined.select("id", "z", "starts").mapInArrow(run, "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def op2_bwt_substrings(spark, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        removed_bytes(F.col("spans")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
