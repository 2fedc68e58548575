"""Removal of lines that many documents share, in DataFrame functions only.

Keys of long lines are hashed; the hashes are range-partitioned and sorted, within a hash by document and position. A pass
over that order sees the first occurrence of a hash (in the largest document), and one of each further document. What
comes back are no texts but bitmaps: for each document the 64-line words of its keep bitmap in which a line goes, with the
number of untouched words before each. Texts are cut by their bitmap where they are.

A hash with a large share of all lines is dealt out over slots by document, so that no task holds all of it. There are at
most HOT such hashes, whatever the size of the table, and only their totals are sent to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channelgraph.llm.common import documents, settle

LEAST_CHARS, LEAST_DOCS = 40, 5
#: A hash is hot when it stands for more than one in HOT of all long lines; so there are fewer than HOT of them.
HOT, SLOTS = 4096, 256
# fixed values: what is stripped from the ends of a line
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORDS = "array<struct<skip: int, bits: bigint>>"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lowered(line: Column) -> Column:
    """A-Z in lower case and nothing else changed; lower() alone does for lines of ASCII."""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def long_lines(docs: DataFrame, least_chars: int, id_col: str, text_col: str) -> DataFrame:
    """id, th (a hash of the text), pos (from 0) and h (128 bits of the SHA-256 of the key) of every line whose key is long enough."""
    rows = docs.select(F.col(id_col).alias("id"), _text_hash(F.col(text_col)).alias("th"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    rows = rows.select("id", "th", "pos", F.btrim("line", F.lit(WHITE)).alias("line")).filter(F.char_length("line") >= least_chars)
    return rows.select("id", "th", "pos", F.substring(F.unhex(F.sha2(_lowered(F.col("line")), 256)), 1, 16).alias("h"))


def hot_hashes(lines: DataFrame) -> DataFrame:
    """The hashes of more than one in HOT lines: first by their two leading bytes, then in full among those."""
    lead = F.substring("h", 1, 2)
    by_lead = settle(lines.groupBy(lead.alias("lead")).agg(F.count("*").alias("n")), "line-leads")  # 65 536 rows at most
    many = F.lit((by_lead.agg(F.sum("n")).first()[0] or 0) / HOT)
    leads = by_lead.filter(F.col("n") > many).select("lead")  # fewer than HOT
    among = lines.join(F.broadcast(leads), lead == F.col("lead"), "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    return settle(among.filter(F.col("n") > many).select(F.col("h").alias("hot_h")), "line-hot")  # fewer than HOT


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th and pos of the lines that go."""
    lines = settle(long_lines(docs, least_chars, id_col, text_col), "line-hashes")
    hot = hot_hashes(lines)
    dealt = lines.join(F.broadcast(hot), F.col("h") == F.col("hot_h"), "left")
    slot = F.when(F.col("hot_h").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SLOTS))).otherwise(F.lit(-1)).cast("int")
    dealt = dealt.select("h", slot.alias("slot"), "id", "th", "pos").repartitionByRange("h", "slot")
    # a range holds whole cells (hash, slot), so these windows need no further exchange
    cell = Window.partitionBy("h", "slot")
    sorted_cell = cell.orderBy(F.col("id").desc_nulls_last(), "th", "pos")
    place = F.row_number().over(sorted_cell)
    new = (F.col("place") == 1) | ~F.col("id").eqNullSafe(F.lag("id").over(sorted_cell))
    seen = dealt.withColumn("place", place).withColumn("top", F.first("id").over(sorted_cell)).withColumn("new", new.cast("long"))
    seen = seen.withColumn("docs", F.sum("new").over(cell)).filter((F.col("slot") >= 0) | (F.col("docs") >= least_docs))
    seen = settle(seen.select("h", "slot", "id", "th", "pos", "place", "top", "docs"), "line-cells")
    heads = seen.filter((F.col("slot") >= 0) & (F.col("place") == 1))
    totals = heads.groupBy(F.col("h").alias("all_h")).agg(F.sum("docs").alias("all_docs"), F.max("top").alias("all_top"))
    totals = totals.filter(F.col("all_docs") >= least_docs)
    cold = seen.filter("slot < 0").filter(~F.col("id").eqNullSafe(F.col("top")))
    warm = seen.filter("slot >= 0").join(F.broadcast(totals), F.col("h") == F.col("all_h")).filter(~F.col("id").eqNullSafe(F.col("all_top")))
    return cold.select("id", "th", "pos").unionByName(warm.select("id", "th", "pos"))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th and words of each text that loses lines; texts that keep all have no row.

    ``words``: for each 64 lines of which one goes ``bits`` (bit i: line i stays) and ``skip``, the number of whole words
    of ones before it. A text has at most one entry for 64 lines.
    """
    gone = dropped_lines(docs, least_chars, least_docs, id_col, text_col)
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = gone.groupBy("id", "th", F.expr("pos div 64").cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    listed = words.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("listed"))
    before = lambda i: F.when(i > 0, F.get("listed", i - 1)["word"]).otherwise(-1)
    packed = F.transform("listed", lambda w, i: F.struct((w["word"] - before(i) - 1).alias("skip"), w["bits"].alias("bits")))
    return listed.select("id", "th", packed.cast(NO_WORDS).alias("words"))


def without_shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_dropped, text (what stays, joined by line feeds).

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least ``least_chars`` code
    points in at least ``least_docs`` documents lose all their lines but those of the largest id that has them. Rows
    of one id are one document; rows without id are together one, smaller than all others. Null and empty texts are one
    empty line. Repeated rows lose the same lines. Of a very long text only the hashes of its lines move, besides the text itself
    once. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    bitmaps = keep_bitmaps(docs, least_chars, least_docs, id_col, text_col)
    bitmaps = bitmaps.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "words")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", _text_hash(F.col("text")))
    joined = texts.join(bitmaps, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    # the bitmap without gaps, so that a line finds its word by place
    dense = F.flatten(F.transform("words", lambda w: F.concat(F.array_repeat(F.lit(-1).cast("long"), w["skip"]), F.array(w["bits"]))))
    cut = joined.select("id", _lines(F.col("text")).alias("lines"), dense.alias("dense"))

    def stays(i: Column) -> Column:
        word = F.coalesce(F.get("dense", F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
        return F.getbit(word, F.pmod(i, F.lit(64))) == 1

    kept = F.when(F.col("dense").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda line, i: stays(i)))
    return cut.withColumn("kept", kept).select(
        "id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


def op12_shared_lines(spark, sf_dir: str) -> DataFrame:
    return without_shared_lines(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


ORACLE_OP12 = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM t),
k AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, pos, line, top IS NOT NULL AND top <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
