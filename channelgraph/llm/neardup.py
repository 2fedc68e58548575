"""Near-duplicates by bottom-k sketches of word shingles.

A document is the set of its hashed shingles; its sketch are the K smallest hashes. Equal sets are one node from the
start. The first INDEXED values of each node's sketch are inverted into lists.

* Rare lists (at most RARE nodes) give the pairs of nodes in them, where sizes allow the similarity and the union of the
  two sketches estimates it high enough; each such pair is compared on its full sets.
* Common values are in lists of any length, and no pairs are made of those. A node can have a partner with which it shares
  common values alone only if common values make up much of its own sketch; just such nodes enter, for the first COMMON of
  their common values. A list is dealt out in blocks of bounded size; a task compares the full sets of two blocks at once
  by a matrix product and returns a spanning forest of the links it found. First all blocks meet the list's first block.
  What that does not tie to the list's largest group then meets the whole list, so a family of many near copies costs in
  proportion to its size, and only sets that stand apart in it cost more.

Every link is thus confirmed on full sets. Two sets of similarity 0.8 share each sketch value with probability 0.8 at
least, so that they share fewer values than these rules need with probability below 1e-7; more similar ones far below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channelgraph.llm.common import byte_slices, documents, drop_settled, settle, ship_package, utf8
from channelgraph.llm.components import components
from channelgraph.llm.hashing import U, digests, lowered, mixed, numbered_words

SHINGLE, PERCENT = 5, 80
K, INDEXED, RARE, COMMON = 48, 32, 16, 10
#: A partner with common values only needs this share of the indexed ones to be common: six deviations below 0.8.
COMMON_SHARE = 0.375
#: Estimates under this, six deviations below 0.8, are not looked into.
LEAST_ESTIMATE = 0.8 - 6 * (0.16 / K) ** 0.5
#: Nodes and shingles of a block.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 400_000
SLICE = 2 << 20
PAD = np.uint32(0xFFFFFFFF)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text (binary) the sorted distinct 63-bit hashes of its shingles of ``size`` words; fewer words are one
    shingle, no words none. Words are hashed one by one and their hashes mixed in order."""
    for a, b in byte_slices(texts, texts, SLICE):
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset + a : texts.offset + b + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        kinds, numbers, first = numbered_words(lowered(data), ends - ends[0])
        words = digests(kinds)[numbers]
        hashes = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        for j in range(size):
            hashes = mixed(hashes * U(0x100000001B3) + words[j : len(words) - size + 1 + j]) if len(hashes) else hashes
        for t in range(b - a):
            n = int(first[t + 1] - first[t])
            if n >= size:
                own = hashes[first[t] : first[t + 1] - size + 1]
            else:
                own = np.zeros(min(n, 1), dtype=np.uint64)
                for w in words[first[t] : first[t + 1]]:
                    own = mixed(own * U(0x100000001B3) + w + U(n))
            yield np.unique(own >> U(1))


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, sketch = [], [], [], []
            for s in shingle_sets(utf8(batch.column(2)), size):
                n.append(len(s))
                a.append(int(mixed(s).sum(dtype=np.uint64).astype(np.int64)))
                b.append(int(mixed(s ^ U(0x5555555555555555)).sum(dtype=np.uint64).astype(np.int64)))
                sketch.append(s[:K].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))],
                ["id", "th", "n", "a", "b", "sketch"],
            )

    return run


def _padded(column: pa.Array) -> np.ndarray:
    """Sketches as rows of K 32-bit numbers (the upper bits, which keep the order), padded."""
    flat = (column.flatten().to_numpy(zero_copy_only=False).astype(np.uint64) >> U(31)).astype(np.uint32)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), K), PAD, dtype=np.uint32)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def union_estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of paired padded sketches, from the K smallest values of their union."""
    both = np.sort(np.concatenate([left, right], axis=1), axis=1)
    real = both != PAD
    first = real.copy()
    first[:, 1:] &= both[:, 1:] != both[:, :-1]
    twice = np.zeros_like(real)
    twice[:, :-1] = real[:, 1:] & (both[:, 1:] == both[:, :-1])
    known = np.cumsum(first, axis=1) <= K
    seen = (first & known).sum(axis=1)
    return (twice & first & known).sum(axis=1) / np.maximum(seen, 1)


def _rare_pairs(percent: int):
    """Pairs of each list's nodes; rows come sorted by value."""

    def pairs(value: np.ndarray, node: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        for step in range(1, RARE):
            left = np.arange(max(0, len(value) - step))
            right = left + step
            fit = (value[left] == value[right]) & (100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right]))
            left, right = left[fit], right[fit]
            for at in range(0, len(left), 1 << 15):
                l, r = left[at : at + (1 << 15)], right[at : at + (1 << 15)]
                good = union_estimate(sketch[l], sketch[r]) >= LEAST_ESTIMATE
                u, v = node[l[good]], node[r[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)] + [_padded(batch.column(3))]
            held = new if rest is None else [np.concatenate([r, x]) for r, x in zip(rest, new, strict=True)]
            done = int(np.searchsorted(held[0], held[0][-1]))  # the last list may go on
            yield from pairs(*[h[:done] for h in held])
            rest = [h[done:] for h in held]
        if rest is not None:
            yield from pairs(*rest)

    return run


def block_links(node: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the sets: all pairs are compared on full sets, in matrix form."""
    size, n = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(size), n)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((size, size))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    begin = np.cumsum(df) - df
    for d in np.unique(df[(df > 1) & (df < 24)]):
        own = owner[begin[df == d][:, None] + np.arange(d)[None]]  # the d owners of each such shingle
        for i in range(d):
            for j in range(i):
                np.add.at(shared, (own[:, i], own[:, j]), 1)
    shared += shared.T
    often = df[column] >= 24
    own, col = owner[often], np.unique(column[often], return_inverse=True)[1] if often.any() else column[often]
    for a in range(0, int(col.max()) + 1 if len(col) else 0, 4096):
        part = (col >= a) & (col < a + 4096)
        dense = np.zeros((size, 4096), dtype=np.float32)
        dense[own[part], col[part] - a] = 1
        shared += dense @ dense.T
    linked = 100 * shared >= percent * (n[:, None] + n[None] - shared)
    np.fill_diagonal(linked, True)
    label = np.arange(size)
    while True:
        least = np.where(linked, label[None], size).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    child = np.flatnonzero(label != np.arange(size))
    return node[child], node[label[child]]


def _compare(percent: int):
    """Links within each group of full sets; rows come sorted by group and node."""

    def links(node: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(node) > 1:
            u, v = block_links(np.array(node), sets, percent)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, sets = None, [], []
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in range(5)], batch.column(5), strict=True)
            for *group, one, own in rows:
                if group != key:
                    yield from links(node, sets)
                    key, node, sets = group, [], []
                if not node or node[-1] != one:
                    node.append(one)
                    sets.append(np.frombuffer(own.as_buffer(), dtype=np.int64))
        yield from links(node, sets)

    return run


def _links_within(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the nodes of each group (kind, key, i, j)."""
    grouped = members.join(sets, "node").select("kind", "key", "i", "j", "node", "own")
    grouped = grouped.repartition("kind", "key", "i", "j").sortWithinPartitions("kind", "key", "i", "j", "node")
    return grouped.mapInArrow(_compare(percent), "u long, v long")


def _apart(dealt: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Groups in which the nodes of each long list that are not in its largest group meet all of the list.

    Together with what the first round compared, every two nodes of a list have then met or are connected.
    """
    labelled = dealt.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = settle(labelled, "near-labelled")
    sizes = labelled.groupBy("value", "root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    largest = sizes.groupBy("value").agg(
        F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("all_size"), F.sum("shingles").alias("all_shingles"),
        F.max_by("shingles", F.struct("size", "root")).alias("most_shingles"),
    )
    left, left_shingles = F.col("all_size") - F.col("most.size"), F.col("all_shingles") - F.col("most_shingles")
    piles = F.greatest(F.ceil(left / BLOCK_NODES), F.ceil(left_shingles / BLOCK_SHINGLES)).cast("int")
    largest = settle(largest.filter(left > 0).select("value", F.col("most.root").alias("main"), piles.alias("piles")), "near-largest")
    if largest.isEmpty():
        return None
    rows = labelled.join(largest, "value")
    pile = F.pmod(F.xxhash64("node", F.lit(1)), F.col("piles")).cast("int")
    rest = rows.filter(F.col("root") != F.col("main")).select("value", "node", pile.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    everyone = rows.select("value", "node", F.explode(F.sequence(F.lit(0), F.col("piles") - 1)).alias("i"), F.col("block").alias("j"))
    met = rest.unionByName(everyone).distinct()
    return settle(met.select(F.lit(2).alias("kind"), F.col("value").alias("key"), "i", "j", "node"), "near-apart")


def _sets_of(size: int):
    """Full sets of the wanted documents; a row whose text has another set than the wanted one is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, a, b = (batch.column(c).to_pylist() for c in (1, 2, 3))
            kept, out = [], []
            for i, s in enumerate(shingle_sets(utf8(batch.column(0)), size)):
                if int(mixed(s).sum(dtype=np.uint64).astype(np.int64)) == a[i] and int(mixed(s ^ U(0x5555555555555555)).sum(dtype=np.uint64).astype(np.int64)) == b[i]:
                    kept.append(node[i])
                    out.append(s.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(out, pa.binary())], ["node", "own"])

    return run


def _text_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def near_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, th (a hash of the text), n_shingles, group and component_id.

    Texts are lower-cased in A-Z and cut at the white space of ASCII; shingles are ``size`` words. Two rows are linked
    when ``percent`` of the union of their sets is in both; rows that links
    connect have the same group, a number, and component_id is the smallest id among them. Null and blank texts have no
    shingles, no group, and are linked with nothing. Rows without id are linked like others and never name a component
    unless it has no other. Repeated rows are one set. Very long texts are read whole, and compared on all their shingles.
    An empty table gives no rows. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = narrow.select("id", _text_hash("text").alias("th"), "text")
    rows = settle(keyed.mapInArrow(_sketches(size), "id long, th long, n long, a long, b long, sketch array<long>"), "near-sketches")
    # the text of a node is that of its smallest id, null ids last
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    nodes = rows.filter("n > 0").groupBy("a", "b", "n").agg(first.alias("first"), F.first("sketch").alias("sketch"))
    nodes = nodes.select("a", "b", "n", "sketch", F.col("first.id").alias("first"), F.col("first.th").alias("first_th"))
    # numbered as they are written; from then on the numbers stand
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    posted = nodes.select("node", "n", F.explode(F.slice("sketch", 1, INDEXED)).alias("value"))
    # written first: a join of two tables as they stand can split the rows of a value that is everywhere
    common = settle(posted.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "near-values")
    shared = settle(posted.join(common, "value"), "near-postings")

    listed = shared.filter(F.col("df") <= RARE).select("value", "node").join(nodes.select("node", "n", "sketch"), "node")
    listed = listed.select("value", "node", "n", "sketch").repartition("value").sortWithinPartitions("value", "node")
    pairs = settle(listed.mapInArrow(_rare_pairs(percent), "u long, v long").distinct(), "near-pairs")

    often = shared.filter(F.col("df") > RARE)
    place = F.row_number().over(Window.partitionBy("node").orderBy("value"))
    total = F.count("*").over(Window.partitionBy("node"))
    enough = F.col("total") >= COMMON_SHARE * F.least(F.lit(INDEXED), F.col("n"))
    few = F.least(F.lit(COMMON), F.floor(F.col("n") * (100 - percent) / 100) + 1)
    entered = settle(often.withColumn("place", place).withColumn("total", total).filter(enough & (F.col("place") <= few)).select("value", "node", "n"), "near-common")
    weight = entered.groupBy("value").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_NODES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = entered.join(weight.filter("members > 1").select("value", blocks.alias("blocks")), "value")
    dealt = settle(dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "near-dealt")
    meets = F.when(F.col("block") == 0, F.sequence(F.least(F.lit(1), F.col("blocks") - 1), F.col("blocks") - 1)).otherwise(F.array("block"))
    in_blocks = dealt.select(F.lit(1).alias("kind"), F.col("value").alias("key"), F.lit(0).alias("i"), F.explode(meets).alias("j"), "node")
    star = F.explode(F.array("u", "v"))
    in_stars = pairs.select(F.lit(0).alias("kind"), F.col("v").alias("key"), F.lit(0).alias("i"), F.lit(0).alias("j"), star.alias("node")).distinct()
    members = settle(in_stars.unionByName(in_blocks), "near-members")

    wanted = members.select("node").distinct().join(nodes.select("node", "first", "first_th", "a", "b"), "node")
    texts = keyed.join(wanted, F.col("id").eqNullSafe(F.col("first")) & (F.col("th") == F.col("first_th"))).select("text", "node", "a", "b")
    sets = settle(texts.mapInArrow(_sets_of(size), "node long, own binary"), "near-sets")
    links = settle(_links_within(members, sets, percent), "near-links")
    roots = components(links)
    apart = _apart(dealt.filter("blocks > 1"), roots)
    if apart is not None:
        links = links.unionByName(_links_within(apart, sets, percent))
        roots = components(links)
    groups = nodes.select("node", "a", "b", "n", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = settle(groups.join(names, "root").select("a", "b", "n", F.col("root").alias("group"), "component_id"), "near-groups")
    for done in (common, shared, pairs, entered, dealt, members, sets):
        drop_settled(done)
    found = rows.select("id", "th", "n", "a", "b").join(groups, ["a", "b", "n"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return found.select("id", "th", F.col("n").alias("n_shingles"), "group", own.alias("component_id"))


def near_dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, one row of each group (see :func:`near_groups`): that of the smallest id, null ids last,
    and of fully repeated rows one. Rows without shingles all stay."""
    found = settle(near_groups(docs, size, percent, id_col, text_col), "near-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first")
    firsts = found.filter(F.col("group").isNotNull()).groupBy("group").agg(first).select("first.id", "first.th", F.lit(True).alias("_one"))
    bare = found.filter(F.col("group").isNull()).select("id", "th", F.lit(False).alias("_one")).distinct()
    stay = firsts.unionByName(bare).select(F.col("id").alias("_stay_id"), F.col("th").alias("_stay_th"), "_one")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    held = held.select("row", F.col(f"row.`{id_col}`").cast("long").alias("_id"), _text_hash(f"row.`{text_col}`").alias("_th"))
    kept = held.join(stay, F.col("_id").eqNullSafe(F.col("_stay_id")) & (F.col("_th") == F.col("_stay_th")))
    nth = F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id"))
    return kept.withColumn("_nth", nth).filter(~F.col("_one") | (F.col("_nth") == 1)).select("row.*")


def op8_bottom_k(spark, sf_dir: str) -> DataFrame:
    """Shingles of four words, as its contract asks."""
    found = near_groups(documents(spark, sf_dir), size=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
