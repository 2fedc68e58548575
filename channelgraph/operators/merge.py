"""Merging new deliveries into stored tables, and maintenance of what is stored.

Parquet has no row updates, so each merge is a pure function from old and new tables to the merged table. Callers
write the result to a new place or to the touched partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from channelgraph.functions.ids import infer_type
from channelgraph.functions.media import is_downloaded, media_kind
from channelgraph.functions.text import any_has_text, is_dedupable, norm_phash, own_excerpt
from channelgraph.operators.texts import with_reference
from channelgraph.schemas import MEDIA, MEDIA_FIELDS, PROFILE_COLUMNS, TEXT_REF
from channelgraph.session import drop_settled, settle

MESSAGE_KEY = ["peer_external_id", "telegram_message_id"]


# ---- messages

def _text_columns(*tables: DataFrame) -> list[str]:
    """What the text of a message is: its own, and the reference to a shared one where a table has such."""
    return ["content", "text_ref"] if any("text_ref" in t.columns for t in tables) else ["content"]


def _alike(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """All with the column of references as soon as one has it."""
    return tuple(with_reference(t) for t in tables) if "text_ref" in _text_columns(*tables) else tables


def _merged_media(old: Column, new: Column, strict_kind: bool) -> Column:
    """Old fields win, except the kind, where the new one does."""
    parts = []
    for name in MEDIA_FIELDS:
        first, second = (new, old) if name == "kind" else (old, new)
        parts.append(F.coalesce(first[name], second[name]).alias(name))
    merged = F.struct(*parts)
    if strict_kind:
        return F.when(merged["kind"].isNotNull(), merged)
    return F.when(old.isNotNull() | new.isNotNull(), merged)


def fold_versions(delta: DataFrame, order: str, strict_kind: bool = True) -> DataFrame:
    """Several deliveries of a message become the one row that applying them in order would leave.

    ``order`` ranks the deliveries of a message; the stored row, where there is one, is the first of them. With ``strict_kind`` the media seen before the first known kind
    survive only if the kind arrived with the very next delivery (see ``merge_messages``).
    """
    kind, rank = F.col("media.kind"), F.col(order)
    texts = _text_columns(delta)
    versions = delta.groupBy(*MESSAGE_KEY).agg(
        F.count("*").alias("versions"),
        F.min_by(F.struct("id", "date", "from_external_id", "media", "text_embedded", "image_embedded"), rank).alias("first"),
        F.max_by(F.struct(*texts), rank).alias("last"),
        F.max_by("fwd_from", F.when(F.col("fwd_from").isNotNull(), rank)).alias("fwd_from"),
        F.max_by(kind, F.when(kind.isNotNull(), rank)).alias("kind"),
        F.min(F.when(kind.isNotNull(), rank)).alias("known_from"),
    )
    single = F.col("versions") == 1
    if strict_kind:
        eligible = rank >= F.col("known_from")
    else:
        eligible = F.lit(True)
    rest = (
        delta.select(*MESSAGE_KEY, "media", order)
        .join(versions.filter(~single).select(*MESSAGE_KEY, "known_from"), MESSAGE_KEY)
        .groupBy(*MESSAGE_KEY)
        .agg(
            F.count(F.when(rank < F.col("known_from"), 1)).alias("before"),
            *[
                F.min_by(f"media.{f}", F.when(F.col(f"media.{f}").isNotNull() & eligible, rank)).alias(f"m_{f}")
                for f in MEDIA_FIELDS
                if f != "kind"
            ],
        )
    )
    carried = F.when((F.col("before") == 1) | F.lit(not strict_kind), F.col("first.media"))
    folded = F.struct(
        *[
            (F.col("kind") if f == "kind" else F.coalesce(carried[f], F.col(f"m_{f}"))).alias(f)
            for f in MEDIA_FIELDS
        ]
    )
    several = F.when(F.col("kind").isNotNull(), folded) if strict_kind else F.when(
        F.coalesce(*[folded[f] for f in MEDIA_FIELDS]).isNotNull(), folded
    )
    return versions.join(rest, MESSAGE_KEY, "left").select(
        F.col("first.id").alias("id"),
        *MESSAGE_KEY,
        F.col("first.date").alias("date"),
        *[F.col(f"last.{c}").alias(c) for c in texts],
        F.col("first.from_external_id").alias("from_external_id"),
        "fwd_from",
        F.when(single, F.col("first.media")).otherwise(several).cast(MEDIA).alias("media"),
        F.col("first.text_embedded").alias("text_embedded"),
        F.col("first.image_embedded").alias("image_embedded"),
    )


def merge_messages(
    base: DataFrame, delta: DataFrame, order: str | None = None, strict_kind: bool = True
) -> DataFrame:
    """Upsert messages by (peer, message number); adds ``inserted``, true for messages that were not there.

    Text is the new one. The forward header is the new one if there is one. Media fields keep their old value and
    only fill gaps, except the kind. Id, date, sender and embedding flags stay. With ``strict_kind`` a message that
    was already stored loses its media where neither side knows a kind; that is what the stored procedure this
    reproduces does.

    ``delta`` holds each message once, or ``order`` ranks its deliveries. Stored and new messages are treated apart:
    a left join can broadcast a small delivery, so the stored texts then stay where they are, which a full outer join
    could not; finding the new messages moves keys only.
    """
    base, delta = _alike(base, delta)
    if order is not None:
        return _merge_ranked(base, delta, order, strict_kind)
    old = base.alias("o")
    new = delta.withColumn("sent", F.lit(True)).alias("n")
    sent = F.col("sent").isNotNull()
    media = F.when(sent, _merged_media(F.col("o.media"), F.col("n.media"), strict_kind)).otherwise(F.col("o.media"))
    kept = old.join(new, MESSAGE_KEY, "left").select(
        "o.id",
        *MESSAGE_KEY,
        "o.date",
        *[F.when(sent, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in _text_columns(base)],
        "o.from_external_id",
        F.coalesce("n.fwd_from", "o.fwd_from").alias("fwd_from"),
        media.alias("media"),
        "o.text_embedded",
        "o.image_embedded",
        F.lit(False).alias("inserted"),
    )
    added = delta.join(base.select(*MESSAGE_KEY), MESSAGE_KEY, "left_anti").withColumns(
        {"text_embedded": F.lit(False), "image_embedded": F.lit(False), "inserted": F.lit(True)}
    )
    return kept.unionByName(added.select(*kept.columns))


def _merge_ranked(base: DataFrame, delta: DataFrame, order: str, strict_kind: bool) -> DataFrame:
    """Several deliveries of a message over a stored table: the stored row is the version before all deliveries.

    The text of a touched row is never that of the stored one, so stored texts are read for untouched rows only.
    """
    keys = delta.select(*MESSAGE_KEY).distinct()
    texts = _text_columns(base)
    columns = ["id", *MESSAGE_KEY, "date", *texts, "from_external_id", "fwd_from", "media", "text_embedded", "image_embedded"]
    kind = delta.schema[order].dataType
    held = base.join(keys, MESSAGE_KEY, "left_semi").withColumns(
        {c: F.lit(None).cast(TEXT_REF if c == "text_ref" else "string") for c in texts}
        | {"_rank": F.struct(F.lit(0).alias("delivered"), F.lit(None).cast(kind).alias("at"))}
    )
    sent = delta.withColumns(
        {
            "text_embedded": F.lit(False),
            "image_embedded": F.lit(False),
            "_rank": F.struct(F.lit(1).alias("delivered"), F.col(order).alias("at")),
        }
    )
    folded = fold_versions(held.select(*columns, "_rank").unionByName(sent.select(*columns, "_rank")), "_rank", strict_kind)
    fresh = held.select(*MESSAGE_KEY, F.lit(False).alias("fresh"))
    folded = folded.join(fresh, MESSAGE_KEY, "left").withColumn("inserted", F.col("fresh").isNull()).drop("fresh")
    untouched = base.join(keys, MESSAGE_KEY, "left_anti").withColumn("inserted", F.lit(False))
    return untouched.select(*columns, "inserted").unionByName(folded.select(*columns, "inserted"))


def month_of(date: str = "date") -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none"))


def write_by_month(messages: DataFrame, path: str) -> None:
    """The layout that :func:`write_back` keeps up: one folder per month, rows in order of peer. A busy peer lies in several files."""
    order = ["month", "peer_external_id", "date", "telegram_message_id"]
    rows = messages.withColumn("month", month_of()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def write_back(spark: SparkSession, path: str, delta: DataFrame, order: str | None = None, strict_kind: bool = True) -> DataFrame:
    """Merge deliveries into messages stored by month, rewriting only the months in which something changes.

    A stored message keeps its date, so its month is found from keys alone; new messages belong to the month of their
    own date. The new months are complete before the first old one goes. Returns (month) of what was rewritten.
    """
    stored = spark.read.parquet(path)
    schema = stored.drop("month").schema
    if "text_ref" in delta.columns and "text_ref" not in schema.fieldNames():
        raise ValueError("the stored messages hold no references to texts: resolve those of the delivery first")
    keys = delta.select(*MESSAGE_KEY).distinct()
    old = stored.select(*MESSAGE_KEY, "month").join(keys, MESSAGE_KEY, "left_semi").select("month")
    months = settle(old.unionByName(delta.select(month_of().alias("month"))).distinct(), "months")
    names = [r["month"] for r in months.collect()]  # one string per month of history
    touched = stored.filter(F.col("month").isin(names)).drop("month")
    merged = merge_messages(touched, delta, order, strict_kind).drop("inserted")
    for column in set(schema.fieldNames()) - set(merged.columns):
        merged = merged.withColumn(column, {"has_text": any_has_text, "excerpt": own_excerpt}[column](merged.columns))
    fresh = settle(merged.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), "rewritten")
    write_by_month(fresh, path)
    drop_settled(fresh)
    return months


# ---- peers

def fold_latest(delta: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key: of every column the latest value that is present."""
    rank = F.col(order)
    return delta.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns if c not in (key, order)]
    )


def merge_peers(base: DataFrame, delta: DataFrame, order: str | None = None) -> DataFrame:
    """Upsert peers: the type is the new one, every other field is the new one if there is one."""
    given = [c for c in ("peer_type", "access_hash", *PROFILE_COLUMNS) if c in delta.columns]
    if order is not None:
        delta = fold_latest(delta, "external_id", order, given)
    old, new = base.alias("o"), delta.select("external_id", *given).alias("n")
    return old.join(new, "external_id", "full_outer").select(
        *[
            F.col(c)
            if c == "external_id"
            else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
            if c in given
            else F.col(f"o.{c}")
            for c in base.columns
        ]
    )


def merge_peer_stubs(peers: DataFrame, stubs: DataFrame) -> DataFrame:
    """Peers known only by id: insert new ones, and fill the title of known ones that have none.

    ``stubs`` holds (external_id, title, seen_at), any number of rows per id.
    """
    title = F.col("title")
    named = stubs.groupBy("external_id").agg(
        F.min_by(title, F.when(title.isNotNull(), F.struct("seen_at", title))).alias("stub_title")
    )
    merged = peers.withColumn("stored", F.lit(True)).join(named, "external_id", "full_outer")
    return merged.withColumns(
        {
            "title": F.coalesce("title", "stub_title"),
            "peer_type": F.when(F.col("stored").isNotNull(), F.col("peer_type")).otherwise(
                infer_type(F.col("external_id"))
            ),
        }
    ).select(*peers.columns)


def discover_peers(mentions: DataFrame, order: str) -> DataFrame:
    """Communities mentioned in pages of history, each once as first seen; users are not catalogued."""
    columns = [c for c in mentions.columns if c not in ("external_id", order)]
    communities = mentions.filter(
        F.col("peer_type").isin("channel", "megagroup", "chat") & F.col("external_id").isNotNull()
    )
    first = communities.groupBy("external_id").agg(F.min_by(F.struct(*columns), order).alias("first"))
    return first.select("external_id", *[F.col(f"first.{c}").alias(c) for c in columns])


def first_message(peers: DataFrame, probes: DataFrame) -> DataFrame:
    """Set a peer's first visible message from probes (external_id, message_id, date): the lowest number counts."""
    lowest = (
        probes.filter(F.col("message_id").isNotNull() & F.col("date").isNotNull())
        .groupBy("external_id")
        .agg(F.min(F.struct("message_id", "date")).alias("probe"))
    )
    known_id, known_at = F.col("first_message_id"), F.col("first_message_at")
    better = F.col("probe").isNotNull() & (
        known_id.isNull() | known_at.isNull() | (known_id > F.col("probe.message_id"))
    )
    return (
        peers.join(lowest, "external_id", "left")
        .withColumns(
            {
                "first_message_id": F.when(better, F.col("probe.message_id")).otherwise(known_id),
                "first_message_at": F.when(better, F.col("probe.date")).otherwise(known_at),
            }
        )
        .drop("probe")
    )


def first_message_missing(peers: DataFrame) -> DataFrame:
    return peers.filter(F.col("first_message_at").isNull() | F.col("first_message_id").isNull())


def purge_probe_only(messages: DataFrame, peers: DataFrame, fetched: DataFrame) -> DataFrame:
    """Drop a peer's only message where it is just the probe for its first message and nothing was fetched."""
    probes = (
        peers.filter(F.col("first_message_id").isNotNull())
        .select(F.col("external_id").alias("peer_external_id"), "first_message_id")
        .join(fetched.select("peer_external_id"), "peer_external_id", "left_anti")
    )
    number = F.col("telegram_message_id")
    spans = messages.groupBy("peer_external_id").agg(
        F.min(number).alias("lo"), F.max(number).alias("hi"), F.max(number.isNull()).alias("unnumbered")
    )
    probe = F.col("first_message_id")
    others = spans.join(probes, "peer_external_id").filter(F.col("unnumbered") | (F.col("lo") != probe) | (F.col("hi") != probe))
    others = others.select("peer_external_id")
    doomed = probes.join(others, "peer_external_id", "left_anti").select(
        "peer_external_id", F.col("first_message_id").alias("telegram_message_id")
    )
    return messages.join(doomed, MESSAGE_KEY, "left_anti")


# ---- embeddings

def _latest_vectors(stored: DataFrame, fresh: DataFrame, key: str, order: str | None) -> DataFrame:
    body = ["model_id", "dim", "embedding"]
    if order is not None:
        fresh = fresh.groupBy(key).agg(F.max_by(F.struct(*body), order).alias("row")).select(key, "row.*")
    kept = stored.select(key, *body).join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh.select(key, *body))


def _flagged(rows: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    marks = ids.select(key).distinct().withColumn("mark", F.lit(True))
    return rows.join(marks, key, "left").withColumn(flag, F.col(flag) | F.col("mark").isNotNull()).drop("mark")


def merge_text_embeddings(
    stored: DataFrame, fresh: DataFrame, messages: DataFrame, order: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Replace vectors by message and flag those messages. Returns the vectors and the messages."""
    vectors = _latest_vectors(stored, fresh, "message_id", order)
    ids = fresh.select(F.col("message_id").alias("id"))
    return vectors, _flagged(messages, "id", ids, "text_embedded")


def merge_image_embeddings(
    stored: DataFrame,
    fresh: DataFrame,
    blobs: DataFrame,
    links: DataFrame,
    messages: DataFrame,
    order: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace vectors by image and flag the image and every message linked to it."""
    fresh = fresh.filter(is_dedupable(F.col("phash"))).withColumn("phash", norm_phash(F.col("phash")))
    vectors = _latest_vectors(stored, fresh, "phash", order)
    linked = links.join(fresh.select("phash"), "phash", "left_semi").select(F.col("message_id").alias("id"))
    return (
        vectors,
        _flagged(blobs, "phash", fresh, "image_embedded"),
        _flagged(messages, "id", linked, "image_embedded"),
    )


def reset_text_embeddings(vectors: DataFrame, messages: DataFrame, counts: DataFrame):
    """Drop all text vectors with everything that says they exist."""
    return (
        vectors.filter(F.lit(False)),
        messages.withColumn("text_embedded", F.lit(False)),
        counts.withColumn("text_embedded", F.lit(0).cast("bigint")),
    )


def reset_image_embeddings(
    vectors: DataFrame, blobs: DataFrame, messages: DataFrame, counts: DataFrame, links: DataFrame, cache: DataFrame
):
    """Drop all image vectors; what can be embedded is then what has its file stored or cached."""
    cached = cache.select("phash", F.lit(True).alias("cached")).dropDuplicates(["phash"])
    able = (
        blobs.join(cached, "phash", "left")
        .filter(F.coalesce(F.trim("canonical_path") != "", F.lit(False)) | F.col("cached").isNotNull())
        .select("phash")
    )
    per_peer = (
        links.select("peer_external_id", "phash")
        .distinct()
        .join(able, "phash", "left_semi")
        .groupBy("peer_external_id")
        .agg(F.count("*").alias("able"))
    )
    recounted = counts.join(per_peer, "peer_external_id", "left").withColumns(
        {
            "image_embedded_unique": F.lit(0).cast("bigint"),
            "image_embeddable": F.coalesce("able", F.lit(0)),
        }
    )
    return (
        vectors.filter(F.lit(False)),
        blobs.withColumn("image_embedded", F.lit(False)),
        messages.withColumn("image_embedded", F.lit(False)),
        recounted.drop("able"),
    )


# ---- maintenance

def mark_downloaded(
    messages: DataFrame, links: DataFrame, phashes: DataFrame, downloaded: bool, path: str | None
) -> tuple[DataFrame, DataFrame]:
    """Set the download flag and path on every message of the given images.

    Returns the messages and, per peer, how many of them changed state.
    """
    hit = (
        links.join(phashes.select("phash"), "phash", "left_semi")
        .select(F.col("message_id").alias("id"), F.lit(True).alias("hit"))
        .distinct()
    )
    flags = {"downloaded": F.lit("true" if downloaded else "false"), "path": F.lit(path).cast("string")}
    media = F.col("media")
    changed = F.struct(*[flags.get(f, media[f]).alias(f) for f in MEDIA_FIELDS])
    marked = (
        messages.join(hit, "id", "left")
        .withColumn("media", F.when(F.col("hit").isNotNull(), changed).otherwise(media).cast(MEDIA))
        .drop("hit")
    )
    flips = (
        messages.select("id", "peer_external_id", "media.downloaded")
        .join(hit, "id", "left_semi")
        .filter(is_downloaded(F.struct("downloaded")) != F.lit(downloaded))
        .groupBy("peer_external_id")
        .agg(F.count("*").alias("flipped"))
    )
    return marked, flips


def reclassify_media(messages: DataFrame) -> DataFrame:
    """Rewrite stored kinds where MIME type or file name say something else."""
    media = F.col("media")
    derived = media_kind(media)
    stale = media.isNotNull() & derived.isNotNull() & ~media["kind"].eqNullSafe(derived)
    return messages.withColumn("media", F.when(stale, media.withField("kind", derived)).otherwise(media))
