"""Best-fit packing planned on a histogram of lengths.

Documents are tokenised and cut into pieces of at most the capacity. How many pieces have each length (4096 counts at
most) is all that the planner sees: it places counts, longest first, each into the open sequences with the least room
that still fits. The plan is a short table of slots; the pieces of a length take its slots by their rank within it.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelgraph.llm.common import byte_slices, documents, settle, utf8

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Words that a worker remembers; past this many it forgets all of them and starts again.
WORDS, CORES = 200_000, 400_000
#: ASCII marks that the tokenizer never joins with letters beside them; ' starts contractions, < | > special tokens.
EDGE_MARKS = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'
#: White space of the tokenizer's pattern. str.split() also takes the four separators below for it.
WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Pieces that a worker remembers, and as many older ones.
PIECES = 200_000
#: Bytes of texts whose pieces are told apart together.
SLICE = 4_000_000
#: Kinds of the characters up to U+00FF after lower-casing, as the tokenizer's pattern has them: white space, letters, numbers, others.
SPACE, LETTER, NUMBER, OTHER = range(4)
KINDS = np.array(
    [SPACE if WHITE.match(chr(c)) else LETTER if chr(c).isalpha() else NUMBER if chr(c).isnumeric() else OTHER for c in range(256)], dtype=np.uint8
)
#: The character by which the model knows a byte.
PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
ALPHABET = {b: b for b in PRINTED} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in PRINTED)}
#: Ranks are counted in so many groups per length.
BUCKETS = 256


class Remembered(dict):
    """Values of keys, made when first asked for. When full it sets its entries aside; what is asked for again comes back."""

    def __init__(self, make: Callable[[bytes], bytes], most: int = PIECES):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: bytes) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) < 100:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


def split_pieces(raw: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where the pieces of the tokenizer's pattern begin in lower-cased text of one byte a character, and the pieces.

    A piece is a run of letters, one number, a run of other marks, or an apostrophe with s, t, m, d, re, ve or ll where no
    mark comes before it.
    """
    kind = np.append(KINDS[raw], [SPACE] * 3).astype(np.uint8)
    begins = (kind[:-3] != SPACE) & ((kind[:-3] != np.append(SPACE, kind[:-4])) | (kind[:-3] == NUMBER))
    quotes = np.flatnonzero((raw == ord("'")) & begins)
    next_, after = (np.append(raw, [0, 0])[quotes + n] for n in (1, 2))
    one = np.isin(next_, np.frombuffer(b"stmd", dtype=np.uint8))
    two = (np.isin(next_, np.frombuffer(b"rv", dtype=np.uint8)) & (after == ord("e"))) | ((next_ == ord("l")) & (after == ord("l")))
    begins[quotes[one | two] + 1] = False
    ends = np.append(quotes[one] + 2, quotes[two] + 3)
    begins[ends[kind[ends] == LETTER]] = True
    starts = np.flatnonzero(begins)
    inside = kind[:-3] != SPACE
    offsets = np.append((np.cumsum(inside, dtype=np.int32) - 1)[starts], inside.sum()).astype(np.int32)
    return starts, pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])


class WordTokens:
    """Ids of a text, word by word: this kind of tokenizer drops white space and joins nothing across it.

    A word not seen yet is split into marks, letters and marks where that is safe, and else goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.pieces = Remembered(self._piece)

    def _piece(self, piece: bytes) -> bytes:
        alphabet = piece.decode("latin-1")
        if not piece.isalpha():  # of ASCII
            alphabet = alphabet.encode().decode("latin-1").translate(ALPHABET)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(alphabet)])

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """:meth:`ids` of each text. Pieces of texts with characters up to U+00FF are told apart together.

        Such texts look the same in the tokenizer's normal form but for their case, and each different piece is looked up once.
        """
        found, plain, at = [b""] * len(texts), [], []
        for n, text in enumerate(texts):
            try:
                if "<|" in text:  # there may be special tokens
                    raise ValueError
                plain.append(text.lower().encode("latin-1"))
                at.append(n)
            except ValueError:
                found[n] = self.ids(text)
        if plain:
            starts, pieces = split_pieces(np.frombuffer(b"\n".join(plain), dtype=np.uint8))
            coded = pieces.dictionary_encode()
            ids = pa.array(map(self.pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), pa.binary()).take(coded.indices)
            first = np.cumsum([0, *[len(p) + 1 for p in plain]])
            ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int32)
            cuts = ends[np.searchsorted(starts, first)].tolist()
            data = memoryview(ids.buffers()[2] or b"")
            for k, n in enumerate(at):
                found[n] = bytes(data[cuts[k] : cuts[k + 1]])
        return found

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _core(self, core: str) -> bytes:
        plain = core.isascii()
        if plain:
            core = core.lower()
        found = self.cores.get(core)
        if found is None:
            # plain letters look the same in the model's own alphabet
            found = np.array([t.id for t in self.model.tokenize(core)], dtype="<u4").tobytes() if plain else self._whole(core)
            if len(self.cores) >= CORES:
                self.cores.clear()
            self.cores[core] = found
        return found

    def word(self, word: str) -> bytes:
        right = word.rstrip(EDGE_MARKS)
        core = right.lstrip(EDGE_MARKS)
        if core.isalpha() and len(core) < 100:
            found = self._core(core)
            if len(core) < len(right):
                found = self._core_marks(right[: len(right) - len(core)]) + found
            if len(right) < len(word):
                found += self._core_marks(word[len(right) :])
        else:
            found = self._whole(word)
        if len(word) < 100:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    def _core_marks(self, marks: str) -> bytes:
        found = self.cores.get(marks)
        if found is None:
            found = self._whole(marks)
            if len(marks) < 20:
                self.cores[marks] = found
        return found

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        words = [w for w in WHITE.split(text) if w] if any(s in text for s in SEPARATORS) else text.split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            known = self.words.get
            return b"".join([known(w) or self.word(w) for w in words])


_tokens: dict[str, WordTokens] = {}


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokens:
            _tokens[path] = WordTokens(path)
        tokens, end, width = _tokens[path], np.array([END_ID], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            out: dict[str, list] = defaultdict(list)
            texts = utf8(batch.column(1))
            for first, last in byte_slices(batch, texts, SLICE):
                given = [t.decode("utf-8") for t in texts[first:last].to_numpy(zero_copy_only=False)]
                for row, ids in enumerate(tokens.all_ids(given), first):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), width)):
                        part = ids[at : at + width]
                        out["row"].append(row)
                        out["piece"].append(piece)
                        out["start"].append(at // 4)
                        out["length"].append(len(part) // 4)
                        out["crc"].append(zlib.crc32(part))
                        if with_ids:
                            out["ids"].append(part)
            if not out:
                continue
            columns = [batch.column(0).take(pa.array(out["row"])), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(out["ids"], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece (from 0), start, length, ids_crc32, and with ``with_ids`` the ids as little-endian 32-bit numbers.

    A document is the ids of its whole text and the end id; null text is empty, so it is the end id alone. Only documents
    longer than ``capacity`` are cut. ``tokenizer``: a file of a tokenizer that drops white space.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    narrow = docs.select(F.col(id_col), F.col(text_col))
    fields = [T.StructField("id", narrow.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    return narrow.mapInArrow(_pieces(path, capacity, with_ids), T.StructType(fields))


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Each slot (length, first_rank, last_rank, per_sequence, first_sequence, offset) takes the ranks first_rank to
    last_rank of a length: ``per_sequence`` pieces one after the other into each sequence from first_sequence on, from
    ``offset``. Sequences with the same content are kept as one range, and every visit at least halves a range's room, so
    the plan has at most a few dozen slots per length whatever the counts are.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: ranges (first sequence, how many)
    rooms = np.zeros(capacity + 1, dtype=bool)
    slots, sequences = [], 0

    def put(left: int, first: int, count: int) -> None:
        if count and left:
            room[left].append((first, count))
            rooms[left] = True

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                left = length + int(fitting[0])
                first, count = room[left].pop()
                rooms[left] = bool(room[left])
            else:
                left, first, count = capacity, sequences, -(-todo // (capacity // length))
                sequences += count
            per = left // length
            full = min(count, todo // per)
            if full:
                slots.append((length, rank, rank + full * per - 1, per, first, capacity - left))
                put(left - per * length, first, full)
                rank, todo = rank + full * per, todo - full * per
            rest = 0
            if full < count and todo:
                rest, some = 1, todo
                slots.append((length, rank, rank + some - 1, some, first + full, capacity - left))
                put(left - some * length, first + full, 1)
                rank, todo = rank + some, 0
            put(left, first + full + rest, count - full - rest)
    return slots


def packed(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """``pieces`` (settled; with id, piece, length) with sequence_id and offset. Every column is kept."""
    spark = pieces.sparkSession
    bucket = F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int")
    counted = settle(pieces.groupBy("length", bucket.alias("_bucket")).agg(F.count("*").alias("_n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # <= capacity rows
    plan = spark.createDataFrame(
        plan_slots(histogram, capacity), "_length long, _first long, _last long, _per long, _sequence long, _offset long"
    )
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_bucket").orderBy("id", "piece", "start", "ids_crc32")
    ranks = pieces.withColumn("_bucket", bucket).withColumn("_rank", F.row_number().over(within) - 1)
    ranks = ranks.join(starts, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    ranks = ranks.withColumn("_rank", F.col("_rank") + F.col("_start"))
    # the plan's size depends on the capacity alone, so it may go to every task
    slot = (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last"))
    placed = ranks.join(F.broadcast(plan), slot)
    nth = F.col("_rank") - F.col("_first")
    return placed.select(
        *[F.col(c) for c in pieces.columns],
        (F.col("_sequence") + F.floor(nth / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_per") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the documents: one row per piece (see :func:`tokenized_pieces`) with sequence_id and offset.

    Every row of ``docs`` is a document of its own, repeated ids and texts included. An empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    return packed(settle(tokenized_pieces(docs, capacity, tokenizer, with_ids, id_col, text_col), "packing-pieces"), capacity)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, n_tokens, doc_ids and ids (array of int).

    A sequence holds at most the capacity of ids, so its group is small whatever the input.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4").astype(np.int32) for parts in batch.column(1).to_pylist()]
            owners = [[p["id"] for p in parts] for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(owners, pa.list_(batch.column(1).type.value_type.field("id").type)), pa.array(ids, pa.list_(pa.int32()))],
                ["sequence_id", "n_tokens", "doc_ids", "ids"],
            )

    grouped = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "id", "ids"))).alias("parts"))
    kind = pieces.schema["id"].dataType.simpleString()
    return grouped.mapInArrow(joined, f"sequence_id long, n_tokens long, doc_ids array<{kind}>, ids array<int>")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
