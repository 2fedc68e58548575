"""Runs of repeated words, found online by dyadic square catching.

Words are appended to a stream. Each completed block of 2 ** k words becomes a catcher: it looks for itself at every
distance q with 2 ** k <= q < 2 ** (k + 1), which it can tell as soon as that many more words have come. Blocks that
follow each other and recur at one distance are squares of that period and make one chain; where a chain breaks, the comparison
of the words around its ends gives the whole stretch with that period. A run of four or more periods holds two such blocks
at least, so none is missed. Blocks are told apart by 64-bit names, each made of the names of its halves; the runs
reported are compared word by word, and a stream in which a name misled is read again with other names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelgraph.llm.common import byte_slices, documents, ship_package, utf8
from channelgraph.llm.hashing import U, mixed, numbered_words

#: A run has at least this many periods and words.
LEAST_PERIODS, LEAST_WORDS = 4, 6
SLICE = 4 << 20
#: Words that are appended to a stream at once.
PIECE = 1 << 18
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Growing:
    """A one-dimensional array that can be appended to."""

    def __init__(self):
        self._room, self.size = np.zeros(1024, dtype=np.uint64), 0

    def extend(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self._room):
            room = np.zeros(max(2 * len(self._room), self.size + len(values)), dtype=np.uint64)
            room[: self.size] = self._room[: self.size]
            self._room = room
        self._room[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def values(self) -> np.ndarray:
        return self._room[: self.size]


class _Level:
    """The catchers of one block size: how many blocks have looked, and the chains that are still going on."""

    def __init__(self):
        self.names, self.looked = _Growing(), 0
        self.shift, self.since = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)


class RunCatcher:
    """Takes words (numbers from 0) as they come. ``longest`` bounds the length of a run, where it is known."""

    def __init__(self, longest: int | None = None, salt: int = 0):
        self.longest, self._factor = longest, U(2 * int(mixed(np.array([salt + 1], dtype=np.uint64))[0] >> U(1)) + 1)
        self.levels = [_Level()]
        self._found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @property
    def size(self) -> int:
        return self.levels[0].names.size

    def append(self, words: np.ndarray) -> None:
        self.levels[0].names.extend(words.astype(np.uint64) + U(1))  # no name is 0
        reach = self.size if self.longest is None else min(self.size, self.longest)
        k = 0
        while LEAST_PERIODS << k <= reach:
            if k == len(self.levels):
                self.levels.append(_Level())
            level = self.levels[k]
            if k:
                below, half = self.levels[k - 1].names.values, 1 << (k - 1)
                done = level.names.size
                left, right = below[done : len(below) - half], below[done + half :]
                level.names.extend(mixed(left * self._factor + right) | U(1))
            self._look(k, (level.names.size >> k) - 1, False)
            k += 1

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and period of all runs, by start and period. Nothing may be appended afterwards."""
        for k in range(len(self.levels)):
            if LEAST_PERIODS << k <= self.size:
                self._look(k, self.size >> k, True)
        start, end, period = (np.concatenate([f[i] for f in self._found] or [np.zeros(0, np.int64)]) for i in range(3))
        # a multiple of the period gives the same stretch again; the smallest counts
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[new], end[new], period[new]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]

    def sound(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
        """Whether the words of all runs repeat as reported."""
        words = self.levels[0].names.values
        return all(np.array_equal(words[a : b - q], words[a + q : b]) for a, b, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True))

    def _look(self, k: int, upto: int, last: bool) -> None:
        """Blocks up to ``upto`` compare themselves with what stands one to two blocks further on."""
        level, size = self.levels[k], 1 << k
        first, level.looked = level.looked, max(level.looked, upto)
        rows = level.looked - first
        if rows <= 0 and not (last and len(level.shift)):
            return
        names = level.names.values
        row, shift = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if rows > 0:
            ahead = names[(first + 1) * size : (level.looked + 1) * size]
            if len(ahead) < rows * size:
                ahead = np.concatenate([ahead, np.zeros(rows * size - len(ahead), dtype=np.uint64)])
            row, shift = np.nonzero(ahead.reshape(rows, size) == names[first * size : level.looked * size : size, None][:rows])
        # place 0 of a distance stands for a chain that came this far, places 1 .. rows for the new blocks
        width = max(rows, 0) + 1
        key = np.sort(np.concatenate([level.shift * width, shift * width + row + 1]))
        if not len(key):
            return
        place, distance = key % width, key // width
        begins = np.ones(len(key), dtype=bool)
        begins[1:] = (key[1:] != key[:-1] + 1) | (place[1:] == 0)
        ends = np.append(begins[1:], True)
        distance, head, tail = distance[begins], place[begins], place[ends]
        came = np.zeros(len(head), dtype=np.int64)
        came[head == 0] = level.since  # both in the order of their distances
        since = np.where(head == 0, came, first + head - 1)
        goes_on = (tail == width - 1) & (not last)
        level.shift, level.since = distance[goes_on], since[goes_on]
        closed = ~goes_on
        self._close(k, size + distance[closed], since[closed], first + tail[closed])

    def _close(self, k: int, period: np.ndarray, first: np.ndarray, after: np.ndarray) -> None:
        """Chains of the blocks [first, after): the words around give the whole stretches."""
        long = after - first > 1
        period = period[long]
        left, right = first[long] << k, after[long] << k
        for low in range(k - 1, -1, -1):
            names, step = self.levels[low].names.values, 1 << low
            at = np.maximum(left - step, 0)
            left = left - step * ((left >= step) & (names[at] == names[at + period]))
            at = np.minimum(right + period, len(names) - 1)
            right = right + step * ((right + period < len(names)) & (names[np.minimum(right, len(names) - 1)] == names[at]))
        length = right + period - left
        keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        self._found.append((left[keep], (right + period)[keep], period[keep]))


def runs_in(stream: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the runs of a stream, which is appended in pieces."""
    salt = 0
    while True:
        catcher = RunCatcher(longest, salt)
        for a in range(0, len(stream), PIECE):
            catcher.append(stream[a : a + PIECE])
        found = catcher.finish()
        if catcher.sound(*found):
            return found
        salt += 1


def _streams(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Texts of similar length as one stream with a mark of its own after each: texts, their places, words, longest."""
    n = np.diff(first)
    classes = np.where(n > 0, np.log2(np.maximum(n, 1)).astype(np.int64), -1)
    fresh = int(words.max()) + 1 if len(words) else 0
    for c in np.unique(classes[n >= LEAST_WORDS]):
        doc = np.flatnonzero((classes == c) & (n >= LEAST_WORDS))
        size = n[doc]
        place = np.cumsum(size + 1) - size - 1
        stream = np.empty(int((size + 1).sum()), dtype=np.int64)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        stream[np.repeat(place, size) + within] = words[np.repeat(first[doc], size) + within]
        stream[place + size] = fresh + np.arange(len(doc))
        yield doc, place, stream, int(size.max())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch.column(1))
        for a, b in byte_slices(texts, texts, SLICE):
            ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset + a : texts.offset + b + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
            kinds, words, first = numbered_words(data, ends - ends[0])
            parts = []
            for doc, place, stream, longest in _streams(words, first):
                start, end, period = runs_in(stream, longest)
                at = np.searchsorted(place, start, side="right") - 1
                parts.append((doc[at], start - place[at], end - start, period))
            doc, start, length, period = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(4))
            order = np.lexsort((period, start, doc))
            doc, start, length, period = doc[order], start[order], length[order], period[order]
            # a word goes where a run holds it behind its first period
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, first[doc] + start + period, 1)
            np.add.at(change, first[doc] + start + length, -1)
            kept = np.cumsum(change)[:-1] == 0
            stays = np.concatenate([[0], np.cumsum(kept)])[first].astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(stays), kinds.take(pa.array(words[kept])))
            collapsed = pc.binary_join(left, pa.scalar(b" ")).cast(pa.string())
            listed = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"]),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), listed.cast(RUNS), collapsed], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (array of start, length, period, by start and period), collapsed.

    Words are cut at the white space of ASCII and compared byte for byte. A run is a stretch of words with smallest
    period q and at least max(6, 4 * q) words that no neighbour continues. ``collapsed`` is the text without the words
    that a run holds behind its first period, joined by single spaces. Null, empty and blank texts have no words and no
    runs; repeated rows are read each for itself; ids may be null; an empty table gives no rows; other columns are not
    read. A text of any length is read whole, in pieces, with about 8 bytes for each word and block size.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_runs, schema)


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One in ten texts, told by the checksum of the id, repeats itself from some word on."""
    for batch in batches:
        texts = batch.column(1)
        chosen, new = np.zeros(batch.num_rows, dtype=bool), []
        for row, doc in enumerate(batch.column(0).to_pylist()):
            g, rest = divmod(zlib.crc32(b"" if doc is None else str(doc).encode()), 10)
            if rest or not texts[row].is_valid:
                continue
            words = texts[row].as_py().encode().split()
            if words:
                a = g % len(words)
                p = 1 + (len(words) - a) // (3 + g % 8)
                words[a:] = [words[a + i % p] for i in range(len(words) - a)]
                chosen[row] = True
                new.append(b" ".join(words).decode())
        texts = pc.replace_with_mask(texts, pa.array(chosen), pa.array(new, texts.type))
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])


def op13_dyadic_runs(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = periodic_runs(docs.mapInArrow(_planted, docs.schema))
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    # runs come by start and period, so the first of equal ratios stays
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
