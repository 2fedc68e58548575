"""The registered queries: every operator run over the whole derived archive, with flat result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelgraph.functions import forwards as fwd
from channelgraph.functions import ids, media, predicates, scores, text, timecov, vectors
from channelgraph.operators import (
    counts,
    coverage,
    encode,
    expand,
    forwards,
    graph,
    images,
    input_lists,
    knn,
    layers,
    listing,
    merge,
    offset_index,
    origin_index,
    partials,
    peer_search,
    profile,
    reach,
    rollups,
    scope,
    texts,
    vector_index,
    whole_headers,
)
from channelgraph.plans import exports
from channelgraph.schemas import MEDIA, MEDIA_FIELDS, MEDIA_KINDS, PROFILE_COLUMNS, TABLES
from channelgraph.session import scratch_path, settle
from channelgraph.sources import sinks
from channelgraph.sources.archive import load_catalog
from channelgraph.sources.derived import (
    PEER_ID,
    DerivedArchive,
    message_base,
    ntz,
    open_archive,
    raw_messages,
    redelivered_messages,
)
from channelgraph.streaming import engine, jobs, live

NOW = "2024-02-15 00:00:00"
START, END = "2024-01-08 00:00:00", "2024-01-20 23:59:59.999"
FOCUS = -1000000000001
LOW_TAU = scores.ScopeParams(tau=0.05)

Query = Callable[[DerivedArchive], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, so that results compare without regard to integer width."""
    narrow = (T.IntegerType, T.ShortType)
    return df.select(
        *[F.col(f.name).cast("bigint") if isinstance(f.dataType, narrow) else F.col(f.name) for f in df.schema.fields]
    )


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query):
        return lambda spark, sf_dir: tidy(fn(open_archive(spark, sf_dir)))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- sources and merges

@query
def s1_catalog_scan(a):
    _ = a.slim_messages
    catalog = load_catalog(a.spark, a.root)
    return catalog.slim_messages.groupBy(F.to_date("date").cast("string").alias("day")).agg(
        F.count("*").alias("messages"), F.count_distinct("peer_external_id").alias("peers")
    )


def _flat_message(df, *extra):
    return df.select(
        "peer_external_id", "telegram_message_id", "id", "date", F.md5("content").alias("content_md5"),
        F.col("fwd_from.from_name").alias("from_name"), F.col("fwd_from.channel_post").alias("channel_post"),
        *[F.col(f"media.{f}").alias(f"m_{f}") for f in MEDIA_FIELDS], "text_embedded", "image_embedded", *extra,
    )


def _flat_shared(a, df, *extra):
    """The same of messages that refer to texts."""
    return _flat_message(texts.with_texts(df, a.message_texts), *extra)


@query
def i1_merge_messages(a):
    return _flat_shared(a, merge.merge_messages(a.slim_messages, redelivered_messages(message_base(a.source))), "inserted")


@query
def i1_merge_messages_lenient(a):
    delta = redelivered_messages(message_base(a.source))
    return _flat_shared(a, merge.merge_messages(a.slim_messages, delta, strict_kind=False), "inserted")


def three_deliveries(base):
    """Each message up to three times more, with and without kinds; one in four is new to the archive."""
    once = redelivered_messages(base)
    rank = F.col("id") - 10_000_000
    kinds = [F.when(rank % 7 == 3, F.lit("image")), F.when(rank % 7 != 5, F.lit("audio")), F.when(rank % 3 == 1, F.lit("gif"))]
    names = [F.when(rank % 2 == 0, F.lit("a.bin")), F.lit("b.bin"), F.when(rank % 5 == 0, F.lit("c.bin"))]
    given = []
    for n, (kind, name) in enumerate(zip(kinds, names, strict=True)):
        media = F.struct(
            *[
                (kind if f == "kind" else name if f == "file_name" else F.when(rank % (n + 2) == 0, F.concat(F.lit(f"{f}{n}-"), rank.cast("string"))) if f in ("width", "path") else F.lit(None))
                .cast(MEDIA[f].dataType).alias(f)
                for f in MEDIA_FIELDS
            ]
        )
        given.append(
            once.filter((rank + n) % 4 < 3).withColumns(
                {"media": F.when(rank % 11 != n, media), "content": F.concat_ws("/", F.lit(str(n)), "content"), "seq": F.lit(n)}
            )
        )
    return given[0].unionByName(given[1]).unionByName(given[2])


@query
def i1_write_back(a):
    """The later delivery merged into an archive stored by month, and the whole read back."""
    path = scratch_path(a.spark, "by-month")
    merge.write_by_month(a.slim_messages, path)
    merge.write_back(a.spark, path, redelivered_messages(message_base(a.source)))
    return _flat_shared(a, a.spark.read.parquet(path))


def _partials_after_write_back(a):
    """Partials of the archive by month, kept up while the later delivery is written back."""
    path = scratch_path(a.spark, "by-month")
    merge.write_by_month(a.slim_messages, path)
    kept = partials.MonthlyPartials(a.spark, path, scratch_path(a.spark, "partials"))
    kept.rebuild()
    kept.write_back(redelivered_messages(message_base(a.source)))
    return kept


@query
def a1_monthly_partials(a):
    return _partials_after_write_back(a).peers()


@query
def a8_monthly_partials(a):
    return _partials_after_write_back(a).images()


def _whole_headers(a):
    """Headers with keys that no struct has, and JSON nulls, through two deliveries."""
    more = F.expr("""',"views":' || CAST(telegram_message_id % 7 AS STRING) || CASE WHEN telegram_message_id % 5 = 0 THEN ',"note":null' ELSE '' END ||
        CASE WHEN telegram_message_id % 4 = 0 THEN ',"extra":{"a":[1,' || CAST(telegram_message_id AS STRING) || ']}' ELSE '' END || '}'""")

    def opened(text):
        return F.left(text, F.length(text) - 1)

    def sent(rows, media, seq):
        return rows.select(*merge.MESSAGE_KEY, whole_headers.whole(F.col("header")).alias("fwd_from"), whole_headers.whole(media).alias("media"), F.lit(seq).alias("seq"))

    base = message_base(a.source)
    first = raw_messages(base).withColumnRenamed("fwd_from", "header")
    second = redelivered_messages(base).withColumn("header", F.to_json("fwd_from")).withColumn("text", F.to_json("media"))
    third = second.filter("telegram_message_id % 2 = 0").withColumn("header", F.lit(None).cast("string"))
    late = F.expr("""CASE WHEN telegram_message_id % 4 = 0 THEN '{"kind":null,"late":true}' WHEN telegram_message_id % 3 > 0 THEN '{"kind":"gif","views":-1}' END""")
    stored = sent(first, F.concat(opened(F.col("media")), more), 0)
    delta = sent(second, F.concat(opened(F.col("text")), F.lit(',"views":100,"note":"n"}')), 1).unionByName(sent(third, late, 2))
    path = scratch_path(a.spark, "whole-headers")
    stored.drop("seq").write.parquet(path)
    return whole_headers.merge_headers(a.spark.read.parquet(path), delta, "seq")


@query
def i1_whole_headers(a):
    """Every key of every media header after the deliveries; a message without media has one row without a key."""
    rows = _whole_headers(a).select(*merge.MESSAGE_KEY, F.explode_outer(whole_headers.keys_of(F.col("media"))).alias("key", "value"))
    return rows.select(*merge.MESSAGE_KEY, "key", F.is_variant_null("value").alias("is_null"), F.try_variant_get("value", "$", "string").alias("value"))


@query
def i1_whole_headers_typed(a):
    """The structs read back from whole headers."""
    rows = whole_headers.typed(_whole_headers(a))
    return rows.select(*merge.MESSAGE_KEY, "media.kind", "media.mime_type", "media.size_bytes", F.col("fwd_from.from_name").alias("from_name"))


@query
def i1_merge_deliveries(a):
    """Three deliveries at once over the stored archive; the oracle applies them one by one."""
    return _flat_shared(a, merge.merge_messages(a.slim_messages, three_deliveries(message_base(a.source)), order="seq"), "inserted")


def _peer_deliveries(a):
    """Suppliers as two deliveries of profiles, half of them of peers that are already known."""
    s = a.source.supplier
    ext = F.expr("-(1000000000000 + 2 * s_suppkey + 1)").alias("external_id")
    first = s.select(
        ext, F.lit("megagroup").alias("peer_type"), F.expr("CASE WHEN s_suppkey % 3 <> 0 THEN s_name END").alias("title"),
        F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey END").alias("username"),
        F.lit(None).cast("string").alias("about"), F.expr("CAST(s_suppkey AS INT)").alias("participants_count"),
        F.lit(1).alias("seq"),
    )
    second = s.select(
        ext, F.lit("channel").alias("peer_type"), F.lit(None).cast("string").alias("title"),
        F.expr("'t' || s_suppkey").alias("username"), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN s_name END").alias("about"),
        F.lit(None).cast("int").alias("participants_count"), F.lit(2).alias("seq"),
    )
    return first.unionByName(second)


@query
def i2_merge_peers(a):
    return merge.merge_peers(a.peers, _peer_deliveries(a), order="seq").select(
        "external_id", "peer_type", "title", "username", "about", "participants_count", "verified"
    )


@query
def i3_merge_peer_stubs(a):
    stubs = a.forward_edge_messages.select(
        F.col("to_external_id").alias("external_id"), F.col("from_name").alias("title"),
        F.col("message_date").alias("seen_at"),
    )
    return merge.merge_peer_stubs(a.peers, stubs).select("external_id", "peer_type", "title")


@query
def i4_discover_peers(a):
    mentions = a.source.events.withColumn("k", F.expr("user_id + 1 + event_id % 3")).select(
        F.expr(PEER_ID.format(k="k")).alias("external_id"),
        F.expr("CASE WHEN k % 10 = 9 THEN 'user' WHEN k % 10 = 8 THEN 'chat' WHEN k % 3 = 0 THEN 'megagroup' ELSE 'channel' END").alias("peer_type"),
        F.expr("'T' || event_id").alias("title"), "event_id",
    )
    return merge.discover_peers(mentions, "event_id")


@query
def i5_first_message(a):
    probes = a.slim_messages.select(
        F.col("peer_external_id").alias("external_id"), F.col("telegram_message_id").alias("message_id"), "date"
    )
    return merge.first_message(a.peers, probes).select("external_id", "first_message_id", "first_message_at")


@query
def i5_first_message_missing(a):
    return merge.first_message_missing(a.peers).select("external_id")


@query
def i6_forward_occurrences(a):
    return forwards.forward_occurrences(a.slim_messages)


@query
def i6_forward_occurrences_new(a):
    covered = a.peer_fetch_coverage.select(F.col("peer_external_id").alias("from_external_id"))
    stored = a.forward_edge_messages.join(covered, "from_external_id", "left_semi")
    return forwards.forward_occurrences(a.slim_messages, stored=stored)


@query
def i7_forward_edges(a):
    return forwards.forward_edges(a.forward_edge_messages)


@query
def i7_merge_edges(a):
    """Edges of two halves of the occurrences, put together."""
    stored, fresh = (
        forwards.forward_edges(a.forward_edge_messages.filter(F.pmod("message_id", F.lit(2)) == half), keep_named=True)
        for half in (0, 1)
    )
    return forwards.merge_edges(stored, fresh).drop("named_by")


@query
def i7_recount_edges(a):
    doubled = a.forward_edges.withColumn("forward_count", F.col("forward_count") * 2)
    covered = a.peer_fetch_coverage.select(F.col("peer_external_id").alias("from_external_id"))
    some = a.forward_edge_messages.join(covered, "from_external_id", "left_semi")
    return forwards.recount_edges(doubled, some).select("from_external_id", "to_external_id", "forward_count")


@query
def i8_image_links(a):
    return images.image_links(a.slim_messages)


@query
def i8_merge_links(a):
    """Stored links met by a later harvest that knows new dates, and numbers for those that have none."""
    number = F.when(F.col("message_id") % 3 > 0, F.col("telegram_message_id"))
    stored = a.image_blob_messages.withColumn("telegram_message_id", number).filter("message_id % 5 <> 0")
    later = (F.col("message_date") + F.expr("INTERVAL 1 DAY")).alias("message_date")
    fresh = a.image_blob_messages.filter("message_id % 2 = 0").select(
        "phash", "message_id", later, "peer_external_id", F.when(F.col("message_id") % 4 > 0, F.col("telegram_message_id")).alias("telegram_message_id")
    )
    return images.merge_links(stored, fresh)


@query
def i9_image_blobs(a):
    harvests = a.slim_messages.select(
        F.col("media.phash").alias("phash"), F.col("media.path").alias("canonical_path"), F.col("date").alias("seen_at")
    )
    return images.image_blobs(a.image_blob_messages, harvests)


def _fresh_text_vectors(a):
    return a.source.embeddings.select(
        (F.col("vec_id") * 2 + 1).alias("message_id"), F.lit("t2").alias("model_id"), F.size("embedding").alias("dim"),
        "embedding",
    )


@query
def i10_merge_text_embeddings(a):
    merged, _ = merge.merge_text_embeddings(a.message_text_embeddings, _fresh_text_vectors(a), a.slim_messages)
    return merged.select("message_id", "model_id", "dim", r6(F.col("embedding")[0].cast("double")).alias("x0"))


@query
def i10_text_embedded_flags(a):
    _, flagged = merge.merge_text_embeddings(a.message_text_embeddings, _fresh_text_vectors(a), a.slim_messages)
    return flagged.select("id", "text_embedded")


def _image_embedding_merge(a):
    fresh = (
        a.image_embeddings.filter("model_id = 'm1'")
        .withColumn("phash", F.concat(F.lit(" "), F.upper("phash")))
        .withColumn("model_id", F.lit("m2"))
    )
    return merge.merge_image_embeddings(a.image_embeddings, fresh, a.image_blobs, a.image_blob_messages, a.slim_messages)


@query
def i10_merge_image_embeddings(a):
    return _image_embedding_merge(a)[0].select("phash", "model_id", "dim")


@query
def i10_blob_flags(a):
    return _image_embedding_merge(a)[1].select("phash", "image_embedded")


@query
def i10_image_embedded_flags(a):
    return _image_embedding_merge(a)[2].select("id", "image_embedded")


@query
def i11_reset_text(a):
    vectors_, messages, counters = merge.reset_text_embeddings(a.message_text_embeddings, a.slim_messages, a.peer_counts)
    flagged = messages.groupBy("peer_external_id").agg(F.count(F.when(F.col("text_embedded"), 1)).alias("flagged"))
    left = vectors_.groupBy(F.col("message_id").alias("peer_external_id")).agg(F.count("*").alias("vectors"))
    return (
        counters.select("peer_external_id", "text_embedded", "text_total")
        .join(flagged, "peer_external_id")
        .join(left, "peer_external_id", "left_anti")
    )


@query
def i11_reset_images(a):
    *_, counters = merge.reset_image_embeddings(
        a.image_embeddings, a.image_blobs, a.slim_messages, a.peer_counts, a.image_blob_messages, a.image_cache
    )
    return counters.select("peer_external_id", "image_embeddable", "image_embedded_unique", "image_unique")


def _marked(a):
    stored = a.image_blobs.filter(F.trim("canonical_path") != "").select("phash")
    return merge.mark_downloaded(a.slim_messages, a.image_blob_messages, stored, False, "gone/x")


@query
def i12_mark_downloaded(a):
    return _marked(a)[0].select("id", F.col("media.downloaded").alias("downloaded"), F.col("media.path").alias("path"), F.col("media.kind").alias("kind"))


@query
def i12_download_flips(a):
    return _marked(a)[1]


@query
def i13_reclassify_media(a):
    return merge.reclassify_media(a.slim_messages).select("id", F.col("media.kind").alias("kind"), F.col("media.tl").alias("tl"))


@query
def i14_purge_probe_only(a):
    orders = a.source.orders.select(
        F.expr("-(1000000000000 + o_custkey * 10 + month(o_orderdate) % 10)").alias("peer_external_id"),
        F.col("o_orderkey").alias("telegram_message_id"), F.col("o_orderstatus").alias("status"),
    )
    firsts = orders.groupBy(F.col("peer_external_id").alias("external_id")).agg(
        F.min("telegram_message_id").alias("first_message_id")
    )
    fetched = orders.filter("status = 'P'").select("peer_external_id").distinct()
    return merge.purge_probe_only(orders, firsts, fetched)


@query
def i15_classify_media(a):
    attr = "struct<type:string,file_name:string,duration:int,w:int,h:int>"
    raw = a.source.events.select(
        F.col("event_id").alias("id"),
        F.expr(
            f"""CASE event_id % 8
              WHEN 7 THEN NULL
              ELSE named_struct('tl', CASE event_id % 8 WHEN 0 THEN 'MessageMediaPhoto' WHEN 1 THEN 'MessageMediaWebPage'
                                       ELSE 'MessageMediaDocument' END,
                'document', CASE WHEN event_id % 8 >= 2 AND event_id % 24 <> 2 THEN named_struct('id', event_id, 'size', event_id * 3,
                  'mime_type', CASE event_id % 5 WHEN 0 THEN 'image/webp' WHEN 1 THEN ' Audio/OGG' WHEN 2 THEN ''
                                 WHEN 3 THEN 'application/zip' END,
                  'attributes', CAST(array(
                     named_struct('type', CASE event_id % 8 WHEN 2 THEN 'sticker' WHEN 3 THEN 'animated' WHEN 4 THEN 'video' WHEN 5 THEN 'image_size' ELSE 'other' END,
                                  'file_name', '', 'duration', 7, 'w', CAST(event_id % 3 * 100 AS INT), 'h', 50),
                     named_struct('type', 'filename', 'file_name', CASE event_id % 6 WHEN 0 THEN 'a.MKV' WHEN 1 THEN 'b.flac' WHEN 2 THEN '' ELSE 'dir.gif/x' END,
                                  'duration', 9, 'w', 1, 'h', 1)) AS array<{attr}>)) END) END"""
        ).alias("raw"),
    )
    done = profile.classify_media(raw)
    return done.select("id", *[F.col(f"media.{f}").alias(f"m_{f}") for f in MEDIA_FIELDS])


@query
def i16_flatten_profile(a):
    raw = a.source.customer.select(
        "c_custkey",
        F.expr(
            """named_struct('id', c_custkey, 'title', CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_name || ' ' WHEN c_custkey % 3 = 1 THEN '  ' END,
                 'first_name', CASE WHEN c_custkey % 4 <> 0 THEN 'Ann' END, 'last_name', CASE WHEN c_custkey % 5 = 0 THEN ' Lee' END,
                 'username', CASE WHEN c_custkey % 2 = 0 THEN '@n' || c_custkey END,
                 'usernames', array(named_struct('username', 'x' || c_custkey, 'active', true, 'editable', false),
                                    named_struct('username', 'N' || c_custkey, 'active', CAST(NULL AS BOOLEAN), 'editable', true)),
                 'verified', c_custkey % 2 = 0, 'linked_monoforum_id', c_custkey % 4 - 1, 'participants_count', CAST(c_custkey AS INT))"""
        ).alias("entity"),
        F.expr(
            """named_struct('about', c_mktsegment, 'linked_chat_id', CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 5 END,
                 'migrated_from_chat_id', c_custkey % 3, 'slowmode_seconds', c_nationkey,
                 'participants_count', CASE WHEN c_custkey % 6 = 0 THEN 99 END,
                 'location', CASE WHEN c_custkey % 7 = 0 THEN named_struct('address', ' here ', 'geo_point', named_struct('lat', c_acctbal, 'long', 1.5D)) END)"""
        ).alias("full"),
    )
    return profile.flatten_profile(raw).select(
        "c_custkey", "title", "first_name", "last_name", "username", text.usernames_csv(F.col("usernames")).alias("handles"),
        F.col("usernames")[0]["active"].alias("first_active"), "verified", "linked_monoforum_id", "participants_count",
        "about", "linked_chat_id", "migrated_from_chat_id", "slowmode_seconds", "location_address", "location_lat",
        "location_lng", "premium",
    )


@query
def k1_write_csv(a):
    path = scratch_path(a.spark, "csv")
    columns = ["external_id", "peer_type", "title", "usernames", "verified", "created_at", "location_lat"]
    sinks.write_csv(a.peers, path, columns)
    schema = ", ".join(f"{c} string" for c in columns)
    return a.spark.read.options(header=True, escape='"', multiLine=True).schema(schema).csv(path)


@query
def k2_write_json(a):
    path = scratch_path(a.spark, "json")
    sinks.write_json(a.peers.select("external_id", "title", "usernames", "created_at", "verified"), path)
    back = a.spark.read.schema(
        "external_id bigint, title string, usernames array<struct<username:string>>, created_at string, verified boolean"
    ).json(path)
    return back.select("external_id", "title", F.col("usernames")[0]["username"].alias("handle"), "created_at", "verified")


@query
def k3_write_partitioned(a):
    path = scratch_path(a.spark, "by-type")
    sinks.write_partitioned(a.peers.select("external_id", "peer_type", "title"), path)
    return a.spark.read.parquet(path).groupBy("peer_type").agg(F.count("*").alias("peers"), F.min("external_id").alias("lowest"))


# ---- column rules

@query
def f1_media_kind(a):
    return a.slim_messages.select("id", media.media_kind(F.col("media")).alias("kind"))


@query
def f1_media_kind_by_hints(a):
    return a.slim_messages.select("id", media.media_kind_by_hints(F.col("media")).alias("kind"))


@query
def f2_kind_from_hints(a):
    none = F.array().cast("array<struct<type:string>>")
    return a.source.events.select(
        "event_id",
        media.kind_from_hints(
            F.expr("CASE event_id % 4 WHEN 0 THEN ' IMAGE/SVG+xml' WHEN 1 THEN 'image/vnd.dwg' WHEN 2 THEN 'Video/x' END"),
            F.expr("CASE event_id % 3 WHEN 0 THEN 'c:\\\\\\\\tmp\\\\\\\\p.jpeg ' WHEN 1 THEN 'dir.mp3/readme' END"),
            F.when(F.expr("event_id % 11 = 0"), F.expr("array(named_struct('type', 'audio'))")).otherwise(none),
        ).alias("kind"),
    )


@query
def f3_signed_ids(a):
    signed = F.col("external_id")
    return a.peers.select(
        "external_id", ids.infer_type(signed).alias("inferred"), ids.is_target(signed).alias("target"),
        ids.raw_channel(signed).alias("raw"), ids.signed_channel(ids.raw_channel(signed)).alias("again"),
    )


@query
def f4_fwd_origin(a):
    return a.slim_messages.select("id", fwd.fwd_origin(F.col("fwd_from")).alias("origin"))


@query
def f5_fwd_origin_msg(a):
    return a.slim_messages.select("id", fwd.fwd_origin_msg(F.col("fwd_from")).alias("origin_mid"))


@query
def f6_fwd_name(a):
    return a.slim_messages.select("id", fwd.fwd_name(F.col("fwd_from")).alias("name"))


@query
def f7_phash(a):
    return a.slim_messages.select("id", text.norm_phash(F.col("media")["phash"]).alias("phash"), text.is_dedupable(F.col("media")["phash"]).alias("usable"))


@query
def f8_excerpt(a):
    return a.messages.select("id", text.excerpt(F.col("content")).alias("excerpt"))


@query
def f9_has_text(a):
    return a.messages.select("id", text.has_text(F.col("content")).alias("has_text"))


@query
def f10_guarded_numbers(a):
    return a.slim_messages.select(
        "id", media.digits_or_null(F.col("media")["size_bytes"]).alias("size"), media.digits_or_null(F.col("media")["duration"], "double").alias("duration"),
        media.digits_or_null(F.col("media")["duration"]).alias("whole"), media.digits_or_null(F.col("media")["mime_type"]).alias("none"),
    )


@query
def f11_is_downloaded(a):
    return a.slim_messages.select("id", media.is_downloaded(F.col("media")).alias("downloaded"))


@query
def f12_media_item_id(a):
    item = media.media_item_id(F.col("media"), F.col("id"))
    parsed = media.parse_item_id(item)
    return a.slim_messages.select("id", item.alias("item"), parsed["kind"].alias("kind"), parsed["ident"].alias("ident"))


@query
def f13_format_bytes(a):
    size = F.expr("CAST(pow(1 + n_chars % 1500, 1 + doc_id % 4) AS BIGINT)")
    return a.source.documents.select("doc_id", media.format_bytes(size).alias("label"))


@query
def f14_coverage_ratio(a):
    spans = a.slim_messages.groupBy("peer_external_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    known = a.peers.select(F.col("external_id").alias("peer_external_id"), "first_message_at")
    return spans.join(known, "peer_external_id").select(
        "peer_external_id", timecov.layer_fill(F.col("first_message_at"), timecov.bound(NOW), F.col("hi")).alias("fill")
    )


@query
def f15_timeline_segment(a):
    seg = timecov.timeline_segment(
        F.col("first_message_at"), timecov.bound("2024-01-25 00:00:00"), F.col("covered_after"), F.col("covered_before"), F.lit(0.25)
    )
    cov = a.peer_fetch_coverage.withColumnRenamed("peer_external_id", "external_id")
    return a.peers.join(cov, "external_id", "left").select("external_id", r6(seg["left"]).alias("left"), r6(seg["width"]).alias("width"))


@query
def f16_peer_label(a):
    kind, title, name = F.col("peer_type"), F.col("title"), F.col("username")
    entity = text.entity_label(kind, title, F.col("first_name"), F.col("last_name"), name, F.col("external_id"))
    node = text.node_title(
        F.when(kind == "chat", "image").when(kind == "bot", "message").otherwise("peer"), title, name, F.col("external_id"), F.col("created_at")
    )
    return a.peers.select(
        "external_id", text.peer_label(title, name, F.col("about")).alias("label"), entity.alias("entity"), node.alias("node")
    )


@query
def f17_usernames(a):
    handles = text.usernames(F.col("username"), F.col("usernames"))
    return a.peers.select(
        "external_id", text.usernames_csv(F.col("usernames")).alias("csv"),
        F.array_join(F.transform(handles, lambda h: h["username"]), ",").alias("handles"),
        F.get(handles, F.lit(0))["active"].alias("first_active"),
    )


@query
def f18_restriction_reason(a):
    return a.peers.select("external_id", text.restriction_csv(F.col("restriction_reason")).alias("reasons"))


@query
def f19_unit_vector(a):
    scaled = F.transform("embedding", lambda x: x * 3)
    u = vectors.unit(scaled)
    written = vectors.parse_vector(F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", "), F.lit("]")))
    return a.source.embeddings.select(
        "vec_id", r6(u[0]).alias("x0"), r6(vectors.dot(u, u)).alias("norm"), r6(vectors.unit(written)[1]).alias("x1"),
        vectors.unit(F.transform("embedding", lambda x: x * 0)).isNull().alias("zero_rejected"),
    )


@query
def f20_dot(a):
    sides = a.source.embeddings.groupBy("label").agg(F.max_by("embedding", "vec_id").alias("other"))
    return a.source.embeddings.join(sides, "label").select("vec_id", r6(vectors.dot(F.col("embedding"), F.col("other"))).alias("dot"))


@query
def f21_relevance(a):
    scored = scope.image_scores(a.image_embeddings, a.scope_inputs, LOW_TAU)
    return scored.select(
        "phash", r6("s").alias("s"), r6("r").alias("r"), r6(scores.relevance(F.col("s"), scores.ScopeParams())).alias("r_default"),
        r6(scores.relevance(F.col("s"), scores.ScopeParams(tau=0.9, gamma=1.0))).alias("r_steep"),
    )


@query
def f22_mix(a):
    return a.peer_counts.select(
        "peer_external_id", r6(scores.mix(F.col("posts").cast("double"), F.col("image_unique"), scores.ScopeParams())).alias("mix")
    )


@query
def f23_forward_score(a):
    p = scores.ScopeParams()
    mixed = scores.mix(F.col("posts").cast("double"), F.col("image_unique"), p)
    return a.peer_counts.select("peer_external_id", r6(scores.forward_score(mixed, F.col("total_forwards") - 5, p)).alias("score"))


@query
def f25_media_preview(a):
    p = media.media_preview(F.col("media"), F.lit(None).cast("string"))
    return a.slim_messages.select("id", p.alias("p")).select("id", *[F.col(f"p.{f}").alias(f) for f in (
        "kind", "phash", "size_bytes", "size_label", "mime_type", "file_name", "duration", "width", "height")])


@query
def f28_node_size(a):
    nodes, _ = graph.forward_graph(a.forward_edges, a.peers, a.peer_fetch_coverage)
    return graph.node_size(nodes).select("id", r6("size").alias("size"))


@query
def f30_in_range(a):
    lo = timecov.start_of_day(timecov.bound("2024-01-10 13:00:00"))
    hi = timecov.end_of_day(timecov.bound("2024-01-12 01:00:00"))
    return a.slim_messages.filter(timecov.in_range(F.col("date"), lo, hi)).select("id", "date")


# ---- filters

@query
def p1_message_scope(a):
    return a.slim_messages.filter(predicates.message_scope(FOCUS, START, END, {"none", "image", "video"})).select("id")


@query
def p1_message_scope_media(a):
    return a.slim_messages.filter(predicates.message_scope(media=predicates.parse_media("gif,document"))).select("id")


def _origin_index(a):
    """Messages by month with the postings of origins beside them."""
    path = scratch_path(a.spark, "by-month")
    merge.write_by_month(a.slim_messages, path)
    index = origin_index.OriginIndex(a.spark, path, scratch_path(a.spark, "origins"))
    index.rebuild()
    return index


@query
def p1_indexed_scope(a):
    """As p1_message_scope, from one peer's messages and its postings."""
    return _origin_index(a).scope(FOCUS, START, END, {"none", "image", "video"}).select("id")


@query
def p1_indexed_scopes(a):
    """Per peer of the catalog, how many messages and images it posted or others forwarded from it, and when."""
    found = _origin_index(a).scopes(a.peers, START, END)
    return found.groupBy("external_id").agg(
        F.count("*").alias("messages"),
        F.count(F.when(F.col("media_kind") == "image", 1)).alias("images"),
        F.count(F.when(F.col("peer_external_id") != F.col("external_id"), 1)).alias("forwarded"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


@query
def p1_indexed_scopes_after_write_back(a):
    """The same after a delivery whose months alone were indexed again, over all dates."""
    index = _origin_index(a)
    index.write_back(redelivered_messages(message_base(a.source)))
    return index.scopes(a.peers).groupBy("external_id").agg(F.count("*").alias("messages"), F.sum("id").alias("ids"))


@query
def p1_indexed_messages(a):
    """The stored messages of a scope, whole."""
    index = _origin_index(a)
    found = settle(index.whole(index.scope(FOCUS, START, END)).select("id", "telegram_message_id", "content", "text_ref"), "scope")
    return texts.with_few_texts(found, a.message_texts).select("id", "telegram_message_id", F.md5("content").alias("content_md5"))


@query
def p2_origin_matches(a):
    return a.slim_messages.filter(fwd.origin_matches(F.col("fwd_from"), FOCUS - 1)).select("id")


@query
def p3_link_scope(a):
    return a.image_blob_messages.filter(predicates.link_scope(START, END)).select("phash", "message_id")


@query
def p4_export_scope(a):
    return a.slim_messages.filter(predicates.export_scope(None, START, END, text_only=True, media_only=True, columns=a.slim_messages.columns)).select("id")


@query
def p5_peer_matches(a):
    return a.peers.filter(predicates.peer_matches(" @U12")).select("external_id")


def _needles(a):
    """Search texts out of the peers themselves: pieces of titles, handles, ids and types, and what nobody has."""
    part = F.array(
        F.right("title", F.lit(3)), F.concat(F.lit("@"), F.upper("username")), F.right(F.col("external_id").cast("string"), F.lit(2)),
        F.substring("title", 3, 9), F.substring("peer_type", 2, 4), F.concat("title", F.lit("?")), F.concat(F.lit(" "), F.left("username", F.lit(1))),
    )
    return a.peers.filter(F.abs("external_id") % 50 == 1).select(F.explode(part).alias("needle")).filter("needle IS NOT NULL")


@query
def p5_indexed_matches(a):
    """Many searches at once through the index of short strings."""
    index = peer_search.PeerIndex(a.spark, scratch_path(a.spark, "peer-index")).build(a.peers)
    return index.search(_needles(a))


@query
def p6_resolve_peer_id(a):
    return listing.resolve_peer(a.peers, str(FOCUS))


@query
def p6_resolve_peer_handle(a):
    return listing.resolve_peer(a.peers, "@ALT41")


@query
def p7_has_pixels(a):
    return images.has_pixels(a.image_blobs, a.image_cache).select("phash")


# ---- joins

@query
def j1_messages_with_peer(a):
    return listing.with_peer(a.slim_messages.select("id", "peer_external_id"), a.peers).select("id", "peer_type", "peer_title", "peer_username")


@query
def j2_first_phash(a):
    return a.slim_messages.select(F.col("id").alias("message_id")).join(listing.first_phash(a.image_blob_messages), "message_id", "left")


@query
def j3_unlinked_forwards(a):
    return forwards.unlinked_forwards(a.slim_messages, a.forward_edge_messages).select("id")


@query
def j4_images_of_peer(a):
    return a.image_blobs.join(images.images_of_peer(a.image_blob_messages, FOCUS), "phash", "left_semi").select("phash", "refcount")


@query
def j5_stored_originals(a):
    return listing.stored_originals(a.slim_messages, forwards.origin_keys(a.slim_messages)).select("id", "peer_external_id", "telegram_message_id")


@query
def j6_blobs_with_links(a):
    return a.image_blobs.join(a.image_blob_messages, "phash", "left").groupBy("phash").agg(F.count("message_id").alias("links"))


@query
def j7_pending_by_model(a):
    return knn.pending_text(a.slim_messages, a.message_text_embeddings, "t1").select("message_id")


@query
def j8_count_spine(a):
    parts = [
        counts.message_counts(a.slim_messages).select("peer_external_id"),
        counts.image_counts(a.image_blob_messages, a.image_blobs, a.image_cache).select("peer_external_id"),
        counts.edge_totals(a.forward_edges).select("peer_external_id"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("peer_external_id").agg(F.count("*").alias("tables"))


@query
def j9_best_match(a):
    return knn.best_match(a.image_embeddings, a.scope_inputs, "phash").select("phash", r6("s").alias("s"))


@query
def j10_forwarded_images(a):
    return scope.forwarded_images(a.forward_edge_messages, a.image_blob_messages, a.peers).select("origin_peer_id", "message_id", "phash")


@query
def j11_edge_titles(a):
    return forwards.edge_titles(a.forward_edges, a.peers).select(
        "from_external_id", "to_external_id", "from_title", "from_username", "to_title", "to_username", "forward_count"
    )


@query
def j12_items_of_peer(a):
    return rollups.media_items(a.slim_messages, "video", FOCUS).select("item_id", "id")


@query
def j13_first_message_dates(a):
    return coverage.first_message_dates(a.peers, a.slim_messages).select("external_id", "first_message_id", "first_message_at")


@query
def j14_named_fan_out(a):
    return rollups.with_peer_names(images.image_peers(a.image_blob_messages, a.slim_messages), a.peers).select(
        "phash", "peer_external_id", "peer_type", "peer_title", "appearances", "forwarded"
    )


@query
def j15_unpersisted_images(a):
    return images.unpersisted(a.image_blob_messages, a.image_blobs)


# ---- aggregations

@query
def a1_peer_counts(a):
    return counts.peer_counts(a.slim_messages, a.image_blob_messages, a.image_blobs, a.image_cache, a.forward_edges)


@query
def a2_message_deltas(a):
    return counts.message_deltas(a.slim_messages)


@query
def a3_apply_deltas(a):
    shrink = a.peer_counts.select(
        (F.col("peer_external_id") - F.expr("CASE WHEN posts % 2 = 0 THEN 1000000 ELSE 0 END")).alias("peer_external_id"),
        (-F.col("video_total") * 2).alias("video_total"), F.col("posts"),
    )
    return counts.apply_deltas(a.peer_counts, shrink)


@query
def a4_phash_snapshot(a):
    return images.phash_snapshot(a.image_blob_messages, a.image_blobs, a.image_cache)


@query
def a4_snapshot_diff(a):
    before = images.phash_snapshot(a.image_blob_messages, a.image_blobs, a.image_cache)
    embedded = a.image_embeddings.select("phash", F.lit(True).alias("has"))
    blobs = a.image_blobs.join(embedded, "phash", "left").withColumn("image_embedded", F.col("image_embedded") | F.col("has").isNotNull()).drop("has")
    return images.snapshot_diff(before, images.phash_snapshot(a.image_blob_messages, blobs, a.image_cache))


@query
def a5_media_windows(a):
    return coverage.media_windows(a.slim_messages, a.image_blob_messages)


@query
def a6_fetch_coverage(a):
    floor = a.peers.select(F.col("external_id").alias("peer_external_id"), (F.col("first_message_id") + 1).alias("min_id"))
    return coverage.fetch_coverage(a.slim_messages, floor)


@query
def a7_media_coverage(a):
    policy = a.peer_fetch_coverage.select(
        "peer_external_id", F.lit(True).alias("videos_excluded"), F.lit(False).alias("large_excluded"),
        F.expr("CASE WHEN peer_external_id % 6 = 0 THEN 777 END").cast("bigint").alias("max_media_bytes"),
    )
    return coverage.media_coverage(a.slim_messages, policy, a.peer_media_coverage)


@query
def a8_image_rollup(a):
    return images.image_rollup(a.image_blobs, a.image_blob_messages)


@query
def a8_image_rollup_of_peer(a):
    return images.image_rollup(a.image_blobs, a.image_blob_messages, FOCUS)


@query
def a9_image_peers(a):
    return images.image_peers(a.image_blob_messages, a.slim_messages)


@query
def a10_video_rollup(a):
    return rollups.video_rollup(a.slim_messages)


@query
def a10_video_rollup_of_peer(a):
    return rollups.video_rollup(a.slim_messages, FOCUS)


@query
def a11_file_rollup(a):
    return rollups.file_rollup(a.slim_messages)


@query
def a12_video_peers(a):
    return rollups.item_peers(a.slim_messages, "video")


@query
def a12_file_peers(a):
    return rollups.item_peers(a.slim_messages, "document")


@query
def a13_kind_histogram(a):
    return counts.kind_histogram(a.slim_messages, a.peer_fetch_coverage)


@query
def a14_catalog_totals(a):
    return counts.catalog_totals(a.slim_messages, a.peer_counts, a.image_blobs)


@query
def a14_storage_bytes(a):
    """Bytes per source of the documents, as files under one folder each would be counted."""
    files = a.source.documents.select(
        F.concat(F.lit("data/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
    )
    return counts.storage_bytes(files)


@query
def a15_graph_endpoints(a):
    return listing.community_ids(a.forward_edges)


@query
def a16_id_span(a):
    return coverage.id_span(a.slim_messages, a.peers)


@query
def a17_shared_images(a):
    return images.shared_images(a.image_blob_messages)


@query
def a18_evidence_sums(a):
    scored = scope.image_scores(a.image_embeddings, a.scope_inputs, LOW_TAU)
    forwarded = scope.forwarded_images(a.forward_edge_messages, a.image_blob_messages, a.peers)
    sums = scope.evidence_sums(scope.evidence_pairs(a.image_blob_messages, forwarded, scored), scored)
    return sums.select("peer_external_id", r6("scope_r").alias("scope_r"), "scope_j", r6("forward_r").alias("forward_r"), "forward_j")


@query
def a19_edge_totals(a):
    return counts.edge_totals(a.forward_edges)


# ---- sets

@query
def u1_id_spine(a):
    spine = a.slim_messages.select("peer_external_id").unionByName(a.image_blob_messages.select("peer_external_id"))
    return spine.unionByName(a.forward_edges.select(F.col("from_external_id").alias("peer_external_id"))).distinct()


@query
def u2_edge_ends(a):
    ends = a.forward_edges.select(F.col("from_external_id").alias("id"))
    return ends.unionByName(a.forward_edges.select(F.col("to_external_id").alias("id"))).distinct().agg(F.count("*").alias("peers"))


@query
def u3_node_kinds(a):
    peers_, _ = graph.forward_graph(a.forward_edges, a.peers, a.peer_fetch_coverage)
    notes, _ = graph.message_layer(graph.scoped_forwards(a.slim_messages), a.slim_messages, a.message_texts)
    shared, _ = graph.shared_image_graph(a.image_blob_messages, a.peers, a.peer_fetch_coverage)
    nodes = peers_.unionByName(notes).unionByName(shared.filter("kind = 'image'"))
    return nodes.groupBy("kind").agg(F.count("*").alias("nodes"))


# ---- orders and pages

@query
def t1_message_page(a):
    rows = listing.message_page(a.slim_messages, a.peers, limit=50, offset=100, texts=a.message_texts)
    return rows.select("id", "date", "telegram_message_id", "peer_title", F.md5("content").alias("content"), "total")


@query
def t1_message_page_after(a):
    rows = a.slim_messages.select("id", "date", "telegram_message_id")
    return listing.page_after(rows, ["date", "telegram_message_id", "id"], ("2024-01-15 00:00:00", 0, 0), 50)


@query
def t2_image_page(a):
    rows = images.image_rollup(a.image_blobs, a.image_blob_messages)
    return listing.page(rows, images.image_order("peers"), 50, with_total=True).select("phash", "unique_peers", "appearances", "total")


@query
def t2_image_page_by_date(a):
    return listing.page(images.image_rollup(a.image_blobs, a.image_blob_messages), images.image_order("date"), 50, 10).select("phash", "last_seen_at")


@query
def t1_video_page(a):
    rows = rollups.video_rollup(a.slim_messages)
    return listing.page(rows, rollups.item_order(), 50, 5, with_total=True).select("item_id", "appearances", "unique_peers", "last_seen_at", "total")


@query
def t1_file_page(a):
    rows = rollups.file_rollup(a.slim_messages)
    return listing.page(rows, rollups.item_order(), 50, with_total=True).select("item_id", "appearances", "unique_peers", "last_seen_at", "total")


@query
def t3_newest_with_flag(a):
    rows = a.slim_messages.select("id", "date")
    return listing.newest(rows, 100, [F.desc_nulls_last("date"), F.asc("id")])


def _listed(a):
    return listing.attach_stats(a.peers, a.peer_counts, a.peer_fetch_coverage, a.peer_media_coverage)


@query
def t4_peer_order(a):
    return listing.page(_listed(a), listing.peer_order("posts", "desc"), 100).select("external_id", "posts", "forwards_total")


@query
def t4_peer_order_subscribers(a):
    return listing.page(_listed(a), listing.peer_order("subscribers", "asc"), 100).select("external_id", "participants_count")


@query
def t5_latest_sample(a):
    return forwards.latest_sample(a.slim_messages)


@query
def t6_video_sources(a):
    return rollups.media_sources(a.slim_messages, "video", k=16).select("item_id", "id", "rank")


@query
def t6_image_sources(a):
    return rollups.image_sources(a.image_blob_messages, k=4).select("phash", "message_id", "rank")


@query
def t1_indexed_pages(a):
    """A page of seven at every 997th place of the listing, and of every peer the third to fifth newest, found by counts."""
    path = scratch_path(a.spark, "by-month")
    merge.write_by_month(a.slim_messages, path)
    index = offset_index.OffsetIndex(a.spark, path, scratch_path(a.spark, "offsets"))
    index.rebuild()
    places = a.slim_messages.agg(F.explode(F.sequence(F.lit(0), F.count("*"), F.lit(997))).alias("offset"))
    of_all = places.select(F.concat(F.lit("all:"), "offset").alias("page"), F.lit(None).cast("long").alias("peer"), "offset", F.lit(7).alias("limit"))
    of_peers = a.peers.select(
        F.concat(F.lit("peer:"), "external_id").alias("page"), F.col("external_id").alias("peer"), F.lit(2).alias("offset"), F.lit(3).alias("limit")
    )
    return index.pages(of_all.unionByName(of_peers), a.peers).select("page", "place", "id", "date")


@query
def t7_type_ahead(a):
    return a.peers.filter(predicates.peer_matches("Customer#0000001")).orderBy("external_id").limit(8).select("external_id", "title")


# ---- graphs

def _forward_graph(a):
    return graph.forward_graph(a.forward_edges, a.peers, a.peer_fetch_coverage)


def _message_layer(a, **limits):
    return graph.message_layer(graph.scoped_forwards(a.slim_messages, **limits), a.slim_messages, a.message_texts)


def _whole_graph(a):
    return a.graph_nodes, a.graph_edges


@query
def g1_forward_graph_nodes(a):
    return _forward_graph(a)[0].select(
        "id", "external_id", "peer_type", "label", "username", "scraped", "is_scraping", "degree", "forward_volume",
        "forwards_unique", "forwards_total",
    )


@query
def g1_forward_graph_edges(a):
    return _forward_graph(a)[1]


@query
def g2_origin_keys(a):
    return forwards.origin_keys(a.slim_messages)


@query
def g3_message_layer_nodes(a):
    return _message_layer(a)[0].select("id", "external_id", "label", "media_kind", "date", "telegram_message_id", "stub", "message_id")


@query
def g3_message_layer_edges(a):
    return _message_layer(a)[1]


@query
def g3_message_graph_newest(a):
    """The newest 500 forwards of a scope, as a screen with that limit would ask for."""
    nodes, _, _ = graph.newest_message_graph(a.slim_messages, 500, a.message_texts, start=START, end=END)
    return nodes.select("id", "label", "date", "message_id")


def _shared_graph(a, **limits):
    return graph.shared_image_graph(a.image_blob_messages, a.peers, a.peer_fetch_coverage, **limits)


@query
def g4_shared_image_nodes(a):
    return _shared_graph(a)[0].select("id", "kind", "external_id", "peer_type", "label", "scraped", "degree", "forward_volume", "date")


@query
def g4_shared_image_edges(a):
    return _shared_graph(a)[1]


@query
def g4_shared_image_nodes_of_peer(a):
    return _shared_graph(a, peer=FOCUS, start=START, end=END)[0].select("id", "kind", "degree", "forward_volume")


@query
def g5_graph_stats(a):
    return graph.graph_stats(a.forward_edges, a.forward_edge_messages, a.slim_messages)


@query
def g5_graph_stats_of_peer(a):
    return graph.graph_stats(a.forward_edges, a.forward_edge_messages, a.slim_messages, peer=FOCUS, media={"image", "none"})


@query
def g5_shared_image_stats(a):
    return graph.shared_image_stats(a.image_blob_messages)


@query
def g5_shared_image_stats_of_peer(a):
    return graph.shared_image_stats(a.image_blob_messages, peer=FOCUS, start=START, end=END)


WITH_MESSAGES = layers.Layers(forward_messages=True, unscraped_peers=False, forward_to=True, media=frozenset({"none", "image", "video"}))


@query
def g6_filter_graph_nodes(a):
    return layers.filter_graph(*_whole_graph(a), WITH_MESSAGES)[0].select("id", "kind")


@query
def g6_filter_graph_edges(a):
    return layers.filter_graph(*_whole_graph(a), WITH_MESSAGES)[1].select("source", "target", "kind", "count")


@query
def g6_default_layers(a):
    return layers.filter_graph(*_whole_graph(a), layers.PRESETS["peer-forwards"])[0].select("id", "kind")


@query
def g6_default_layer_edges(a):
    return layers.filter_graph(*_whole_graph(a))[1].select("source", "target", "kind", "count")


@query
def g6_shared_image_preset(a):
    return layers.filter_graph(*_shared_graph(a), layers.PRESETS["shared-images"])[0].select("id", "kind")


@query
def g7_self_forwards(a):
    """Over an archive in which every second peer forwards its own posts."""
    _, edges = _whole_graph(a)
    turned = edges.filter("kind = 'sent_to'").select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("forwarded_from").alias("kind"), "count")
    own = turned.filter("CAST(source AS BIGINT) % 2 = 0")
    kept = edges.filter("kind = 'sent_to' OR (kind = 'forwarded_from' AND TRY_CAST(source AS BIGINT) % 4 = 3)")
    return layers.self_forwards(kept.unionByName(own))


@query
def g8_merge_graph(a):
    nodes, edges = layers.merge_graph(_forward_graph(a), _whole_graph(a))
    return nodes.select("kind").unionByName(edges.select("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query
def g8_new_nodes(a):
    old, _ = _message_layer(a, end=START)
    return layers.new_nodes(old, a.graph_nodes.filter("kind = 'message'")).select("id")


@query
def g9_graph_fingerprint(a):
    return layers.graph_fingerprint(*_forward_graph(a))


@query
def g10_forwarders(a):
    nodes, edges = _whole_graph(a)
    return layers.neighbours(nodes, edges, "forwarded_from")


@query
def g10_sent_to(a):
    nodes, edges = _whole_graph(a)
    return layers.neighbours(nodes, edges, "sent_to")


@query
def g10_appeared_in(a):
    return layers.neighbours(*_shared_graph(a), "appeared_in")


@query
def g11_expand(a):
    """Five rounds out from every peer without a known first message."""
    seeds = a.peers.filter("first_message_id IS NULL AND external_id < 0").select(F.col("external_id").alias("peer_id"))
    return expand.expand(a.forward_edges, seeds, max_depth=5)


@query
def g11_reach(a):
    """All rounds out from a tenth of the peers, visited ones held as bitmaps."""
    seeds = a.peers.filter("external_id < 0 AND abs(external_id) % 10 = 1").select(F.col("external_id").alias("peer_id"))
    return reach.reach(a.forward_edges, seeds)


def _frontier(a):
    """Peers that forwards point to, waiting in the order in which they were first seen."""
    seen = a.forward_edges.groupBy(F.col("to_external_id").alias("peer_id")).agg(F.min("first_seen_at").alias("seq"))
    return seen.select("peer_id", F.lit(1).alias("depth"), F.expr("peer_id % 25 = 0").alias("retry"), "seq")


@query
def g12_rank_frontier(a):
    return expand.rank_frontier(_frontier(a), a.peers, use_scope=True, k=20).select("peer_id", "retry", "forward_score")


@query
def g12_rank_frontier_fifo(a):
    return expand.rank_frontier(_frontier(a), a.peers, use_scope=False, k=20).select("peer_id", "retry")


# ---- search and relevance

def _questions(a):
    return a.scope_inputs.select(F.col("id").alias("query_id"), "embedding")


@query
def v1_knn_messages(a):
    return knn.knn_messages(a.message_text_embeddings, _questions(a), 20, "t0").select("query_id", "message_id", r6("score").alias("score"), "rank")


def _every_hundredth(a):
    """The vectors whose id is divisible by 100: as questions they grow with the table."""
    return a.source.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query
def v1_knn_messages_whole(a):
    return knn.knn_messages(a.message_text_embeddings, _every_hundredth(a), 20, "t0").select("query_id", "message_id", r6("score").alias("score"), "rank")


@query
def v2_knn_images_whole(a):
    return knn.knn_images(a.image_embeddings, _every_hundredth(a), 20, "m0").select("query_id", "phash", r6("score").alias("score"), "rank")


@query
def v3_hydrate_messages_whole(a):
    hits = knn.knn_messages(a.message_text_embeddings, _every_hundredth(a), 20, "t0").withColumnRenamed("message_id", "id")
    rows = listing.list_messages(a.slim_messages, a.peers)
    return knn.hydrate(hits, rows, "id").select("query_id", "id", "rank", "score", "peer_title", "media_kind", "forwarded")


@query
def v3_hydrate_images_whole(a):
    hits = knn.knn_images(a.image_embeddings, _every_hundredth(a), 20, "m0")
    shown = a.image_blob_messages.join(hits.select("phash"), "phash", "left_semi")
    return knn.hydrate(hits, images.image_rollup(a.image_blobs, shown), "phash").select(
        "query_id", "phash", "rank", "score", "appearances", "unique_peers"
    )


@query
def v3_hit_peers_whole(a):
    hits = knn.knn_images(a.image_embeddings, _every_hundredth(a), 20, "m0")
    found = images.hit_peers(hits, a.image_blob_messages, a.slim_messages, a.peers)
    return found.select("query_id", "phash", "peer_external_id", "peer_title", "appearances", "forwarded", "last_seen_at", "place")


def _indexed(a, vectors, key, probes=None):
    """The whole search through an inverted file built for it."""
    index = vector_index.build_index(vectors, key, scratch_path(a.spark, "vector-index"))
    found = vector_index.search(index, _every_hundredth(a), 20, probes)
    return found.select("query_id", key, r6("score").alias("score"), "rank")


@query
def v1_index_messages(a):
    return _indexed(a, a.message_text_embeddings.filter("model_id = 't0'"), "message_id")


@query
def v1_index_messages_all_cells(a):
    return _indexed(a, a.message_text_embeddings.filter("model_id = 't0'"), "message_id", vector_index.MOST_CELLS)


@query
def v2_index_images(a):
    return _indexed(a, a.image_embeddings.filter("model_id = 'm0'"), "phash")


@query
def v1_knn_messages_of_peer(a):
    return knn.knn_messages(a.message_text_embeddings, _questions(a), 5, "t0", a.slim_messages, FOCUS).select("query_id", "message_id", "rank")


@query
def v2_knn_images(a):
    return knn.knn_images(a.image_embeddings, _questions(a), 20, "m0").select("query_id", "phash", r6("score").alias("score"), "rank")


@query
def v2_knn_images_of_peer(a):
    return knn.knn_images(a.image_embeddings, _questions(a), 5, "m0", a.image_blob_messages, FOCUS).select("query_id", "phash", "rank")


@query
def v3_hydrate_messages(a):
    hits = knn.knn_messages(a.message_text_embeddings, _questions(a), 20, "t0").withColumnRenamed("message_id", "id")
    rows = listing.list_messages(a.slim_messages, a.peers)
    return knn.hydrate(hits, rows, "id").select("query_id", "id", "rank", "score", "peer_title", "media_kind", "forwarded")


@query
def v3_hydrate_images(a):
    hits = knn.knn_images(a.image_embeddings, _questions(a), 20, "m0")
    shown = a.image_blob_messages.join(hits.select("phash"), "phash", "left_semi")
    return knn.hydrate(hits, images.image_rollup(a.image_blobs, shown), "phash").select(
        "query_id", "phash", "rank", "score", "appearances", "unique_peers"
    )


@query
def v3_hit_peers(a):
    hits = knn.knn_images(a.image_embeddings, _questions(a), 20, "m0")
    found = images.hit_peers(hits, a.image_blob_messages, a.slim_messages, a.peers)
    return found.select("query_id", "phash", "peer_external_id", "peer_title", "appearances", "forwarded", "last_seen_at", "place")


@query
def v4_pending_text(a):
    return knn.pending_text(a.slim_messages, a.message_text_embeddings, "t0").select("message_id", "date")


@query
def v5_pending_images(a):
    skip = a.image_cache.filter("phash < '8'").select("phash")
    return knn.pending_images(a.image_blobs, a.image_embeddings, a.image_cache, "m0", exclude=skip).select("phash")


def _numbers_text(embedding):
    """A vector of whole numbers as text, every component of it."""
    return F.array_join(F.transform(embedding, lambda x: x.cast("bigint").cast("string")), ",")


@query
def v6_embed_text(a):
    pending = knn.pending_text(a.slim_messages, a.message_text_embeddings, "multilingual-e5-small", texts=a.message_texts)
    done = encode.embed_text(pending, encode.HashingEncoder, "multilingual-e5-small")
    return done.select("message_id", "model_id", "dim", _numbers_text(F.col("embedding")).alias("vector"))


@query
def v6_embed_images(a):
    pending = knn.pending_images(a.image_blobs, a.image_embeddings, a.image_cache, "m9")
    content = a.source.documents.select(F.substring(F.md5("text"), 1, 16).alias("phash"), F.encode("text", "UTF-8").alias("content"))
    content = content.dropDuplicates(["phash"])
    done = encode.embed_images(pending.join(content, "phash"), encode.HashingEncoder, "m9")
    return done.select("phash", "model_id", "dim", _numbers_text(F.col("embedding")).alias("vector"))


@query
def v6_embed_progress(a):
    content = a.image_blobs.join(a.image_cache, "phash", "left").select("phash", F.encode("cache_path", "UTF-8").alias("content"))
    return encode.embed_progress(content)


def _rerank(a, params=LOW_TAU):
    return scope.rerank(a.image_embeddings, a.scope_inputs, a.image_blob_messages, a.forward_edge_messages, a.peers, params)


def _rounded_scores(df):
    return df.select(
        "peer_external_id", r6("scope_r").alias("scope_r"), "scope_j", r6("scope_score").alias("scope_score"),
        r6("forward_r").alias("forward_r"), "forward_j", "forward_n_events", r6("forward_score").alias("forward_score"),
    )


@query
def v7_image_scores(a):
    return _rerank(a)["images"].select("phash", r6("s").alias("s"), r6("r").alias("r"), "version")


@query
def v7_evidence(a):
    return _rerank(a)["evidence"]


@query
def v7_forward_events(a):
    return _rerank(a)["events"].select("message_id", "phash", "origin_peer_id")


@query
def v7_peer_scores(a):
    return _rounded_scores(_rerank(a)["peers"])


@query
def v7_peer_scores_default(a):
    return _rounded_scores(_rerank(a, scores.ScopeParams())["peers"])


@query
def v7_no_inputs(a):
    cleared = scope.rerank(
        a.image_embeddings, a.scope_inputs.filter(F.lit(False)), a.image_blob_messages, a.forward_edge_messages, a.peers
    )
    return _rounded_scores(cleared["peers"])


@query
def v7_changed_inputs(a):
    """Scores after inputs were added and others deleted, by lists of each image's closest inputs."""
    source = a.source.embeddings.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("id"), "embedding")
    first, added, gone = source.filter("id % 3 <> 0"), source.filter("id % 3 = 0"), source.filter("id % 4 = 0")
    lists = input_lists.build(a.image_embeddings, first, kept=2)
    lists = input_lists.add(lists, a.image_embeddings, first, added, kept=2)
    lists = input_lists.remove(lists, a.image_embeddings, source.filter("id % 4 <> 0"), gone, kept=2)
    known = input_lists.scores(lists, LOW_TAU)
    again = scope.rerank(a.image_embeddings, source, a.image_blob_messages, a.forward_edge_messages, a.peers, LOW_TAU, scored=known)
    return _rounded_scores(again["peers"])


@query
def v8_score_increment(a):
    """From an empty state, the fetched peers are embedded first and the others after them."""
    empty = scope.rerank(
        a.image_embeddings, a.scope_inputs.filter(F.lit(False)), a.image_blob_messages, a.forward_edge_messages, a.peers
    )
    args = (a.image_embeddings, a.scope_inputs, a.image_blob_messages, a.forward_edge_messages, a.peers)
    covered = a.peer_fetch_coverage.select("peer_external_id")
    state = scope.score_increment(*args, empty, covered, LOW_TAU)
    rest = a.peer_counts.select("peer_external_id").join(covered, "peer_external_id", "left_anti")
    return _rounded_scores(scope.score_increment(*args, state, rest, LOW_TAU)["peers"])


@query
def v8_score_increment_part(a):
    empty = scope.rerank(
        a.image_embeddings, a.scope_inputs.filter(F.lit(False)), a.image_blob_messages, a.forward_edge_messages, a.peers
    )
    state = scope.score_increment(
        a.image_embeddings, a.scope_inputs, a.image_blob_messages, a.forward_edge_messages, a.peers, empty,
        a.peer_fetch_coverage, LOW_TAU,
    )
    return _rounded_scores(state["peers"])


@query
def v9_scope_inputs(a):
    return scope.scope_inputs(a.scope_inputs).select("id", "body", r6(F.col("embedding")[0]).alias("x0"), "created_at")


@query
def v9_needs_rescore(a):
    return scope.needs_rescore(a.scope_inputs, "2024-01-01 00:00:00", "2024-01-02 00:00:00")


@query
def v11_hash_images(a):
    """Vectors drawn as 8 x 8 grey images, in the precision of their components."""
    scale, middle = F.lit(255).cast("float"), F.lit(128).cast("float")
    cell = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.round(x * scale + middle))).cast("bigint")), 2, "0")
    drawn = a.source.embeddings.select(
        "vec_id",
        F.struct(
            F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"),
            F.unhex(F.array_join(F.transform("embedding", cell), "")).alias("data"),
        ).alias("image"),
    )
    return encode.hash_pixels(drawn, "vec_id")


@query
def v12_missing_phash(a):
    return images.missing_phash(a.slim_messages).select("id", "peer_external_id", "telegram_message_id")


@query
def v13_classify_files(a):
    """Documents stored behind the first bytes of various formats."""
    head = F.expr(
        """unhex(CASE doc_id % 8 WHEN 0 THEN 'FFD8FF' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN '4749463839'
             WHEN 3 THEN '52494646000000005745425056' WHEN 4 THEN '0000001866747970' WHEN 5 THEN '1A45DFA3'
             WHEN 6 THEN '5249464600000000' ELSE '' END)"""
    )
    content = F.concat(head, F.encode("text", "UTF-8"))
    return a.source.documents.select("doc_id", encode.file_type(content).alias("t")).select("doc_id", "t.*")


# ---- catalog views and exports

def _flat_stats(df, *keep):
    flat = []
    for kind in MEDIA_KINDS:
        fields = ("total", "hashed", "downloaded", "unique") if kind == "image" else ("total", "downloaded")
        flat += [F.col(f"media.{kind}.{f}").alias(f"{kind}_{f}") for f in fields]
    return df.select(
        "external_id", *keep, "has_fetch_coverage", "has_media_coverage", "posts", "forwards_unique", "forwards_total", *flat,
        "videos_excluded", "large_excluded", "max_media_bytes",
        F.col("embed_text.done").alias("text_done"), F.col("embed_text.total").alias("text_total"),
        F.col("embed_images.done").alias("images_done"), F.col("embed_images.total").alias("images_total"),
    )


@query
def c1_attach_stats(a):
    return _flat_stats(_listed(a))


@query
def c2_list_peers(a):
    rows = listing.list_peers(a.peers, a.peer_counts, a.peer_fetch_coverage, a.peer_media_coverage)
    return _flat_stats(rows, "title", "scope_score", "forward_score", "created_at")


@query
def c3_peer_coverage(a):
    report = coverage.peer_coverage(
        a.peers, a.slim_messages, a.image_blob_messages, a.peer_counts, a.peer_fetch_coverage, a.peer_media_coverage, NOW
    )
    layer = [
        F.col(f"media_layers.{k}.{f}").alias(f"{k}_{f}") for k in MEDIA_KINDS for f in ("covered_after", "covered_before", "fill")
    ]
    embeds = [
        F.col(f"embeds.{k}.{f}").alias(f"{k}_embed_{f}")
        for k in ("text", "images") for f in ("total", "done", "covered_after", "covered_before", "fill")
    ]
    return report.select(
        "external_id", F.col("timeline.start").alias("timeline_start"), F.col("timeline.end").alias("timeline_end"),
        F.col("timeline.first_message_id").alias("first_message_id"), F.col("posts.covered_after").alias("posts_after"),
        F.col("posts.count").alias("posts_count"), F.col("posts.fill").alias("posts_fill"),
        F.col("media_pass.max_media_bytes").alias("pass_bytes"), "forwards_fill", *layer, *embeds,
    )


@query
def c4_list_messages(a):
    return listing.list_messages(a.slim_messages, a.peers, texts=a.message_texts).withColumn("content", F.md5("content")).drop("peer_usernames")


@query
def c4_list_messages_cut(a):
    """The same as a screen asks for it, texts cut at 2000 characters."""
    return listing.list_messages(a.slim_messages, a.peers, content_chars=2000, texts=a.message_texts).select("id", F.md5("content").alias("content"))


@query
def c5_message_detail(a):
    rows = listing.message_detail(a.slim_messages, a.image_blob_messages, a.message_texts)
    return rows.select(
        "id", "telegram_message_id", "date", F.md5("content").alias("content"), "media_kind", F.col("media.phash").alias("phash"),
        F.col("media.size_label").alias("size_label"), F.col("media.duration").alias("duration"), F.col("media.width").alias("width"),
    )


@query
def c6_lookup_origin(a):
    return listing.lookup_origin(a.slim_messages, forwards.origin_keys(a.slim_messages))


@query
def x1_export_peers(a):
    rows = exports.export_peers(a.peers, a.peer_counts, a.peer_fetch_coverage, a.peer_media_coverage)
    return rows.select(
        "external_id", "peer_type", "title", "username", "usernames", "about", "created_at", "updated_at", "participants_count",
        "posts", "forwards_unique", "forwards_total", "images_unique", "images_persisted", "videos_total", "videos_downloaded",
        "audio_total", "gif_total", "document_total", "verified", "restriction_reason", "location_lat", "has_fetch_coverage",
        "embed_text", "embed_images", "videos_excluded", "large_excluded", "max_media_bytes",
    )


def _profiled_peers(a):
    """The peers with all profile columns, as the flattening of entities gives them."""
    k = "c_custkey"

    def struct(fields: dict[str, str]) -> Column:
        return F.struct(*[F.expr(e.format(k=k)).alias(n) for n, e in fields.items()])

    entity = {
        "id": "{k}", "title": "CASE WHEN {k} % 3 = 0 THEN ' ' || c_name || ' ' WHEN {k} % 3 = 1 THEN '  ' END",
        "first_name": "CASE WHEN {k} % 4 <> 0 THEN 'Ann' END", "last_name": "CASE WHEN {k} % 5 = 0 THEN ' Lee' END",
        "username": "CASE WHEN {k} % 2 = 0 THEN '@n' || {k} END",
        "usernames": """array(named_struct('username', 'x' || {k}, 'active', true, 'editable', false),
                              named_struct('username', 'N' || {k}, 'active', CAST(NULL AS BOOLEAN), 'editable', true))""",
        "date": "CAST('2023-05-' || lpad(CAST({k} % 28 + 1 AS STRING), 2, '0') || ' 00:00:00' AS TIMESTAMP_NTZ)",
        "restriction_reason": """CASE WHEN {k} % 9 = 0 THEN array(named_struct('platform', 'ios', 'reason', 'porn', 'text', ' blocked '),
                              named_struct('platform', '', 'reason', 'terms', 'text', 'terms')) END""",
        "linked_monoforum_id": "{k} % 4 - 1", "migrated_to_channel_id": "{k} % 5 - 2", "participants_count": "CAST({k} AS INT)",
    } | {f: f"CASE WHEN {{k}} % 5 <> 4 THEN ({{k}} + {n}) % {n + 2} = 0 END" for n, f in enumerate(profile.ENTITY_FLAGS)}
    full = {
        "about": "c_mktsegment", "linked_chat_id": "CASE WHEN {k} % 2 = 0 THEN {k} ELSE {k} + 5 END", "migrated_from_chat_id": "{k} % 3",
        "participants_count": "CASE WHEN {k} % 6 = 0 THEN 99 END", "hidden_prehistory": "{k} % 3 = 0",
        "participants_hidden": "CASE WHEN {k} % 2 = 0 THEN {k} % 4 = 0 END",
        "location": "CASE WHEN {k} % 7 = 0 THEN named_struct('address', ' here ', 'geo_point', named_struct('lat', c_acctbal, 'long', 1.5D)) END",
    } | {f: f"CASE WHEN {{k}} % 7 <> {n % 7} THEN {{k}} * 10 + {n} END" for n, f in enumerate(profile.FULL_NUMBERS)}
    raw = a.source.customer.select(
        F.expr(PEER_ID.format(k=k)).alias("external_id"), struct(entity).alias("entity"), struct(full).alias("full"),
        F.expr(f"CASE WHEN {k} % 2 = 0 THEN CAST('2024-04-' || lpad(CAST({k} % 28 + 1 AS STRING), 2, '0') || ' 00:00:00' AS TIMESTAMP_NTZ) END").alias("last_message_at"),
    )
    return a.peers.drop(*PROFILE_COLUMNS, "last_message_at").join(profile.flatten_profile(raw), "external_id")


@query
def x1_export_peers_whole(a):
    """All 63 columns, over peers with whole profiles."""
    return exports.export_peers(_profiled_peers(a), a.peer_counts, a.peer_fetch_coverage, a.peer_media_coverage)


@query
def x2_export_forward_edges(a):
    return exports.export_forward_edges(a.forward_edges, a.peers, a.peers)


@query
def x1_saved_peer_files(a):
    """Peers saved as CSV, one folder per type, and read back."""
    path = scratch_path(a.spark, "peers")
    rows = exports.export_peers(a.peers, a.peer_counts, a.peer_fetch_coverage, a.peer_media_coverage, ["channel", "bot"])
    exports.save(rows, path, exports.peer_export_order(), partition="peer_type")
    schema = ", ".join([f"{c} string" for c in exports.PEER_COLUMNS] + ["by_peer_type string"])
    back = a.spark.read.options(header=True, escape='"', multiLine=True).schema(schema).csv(path)
    return back.groupBy("by_peer_type").agg(F.count("*").alias("peers"), F.count("posts").alias("with_posts"), F.max("embed_text").alias("embed_text"))


@query
def x3_export_messages(a):
    return exports.export_messages(a.slim_messages, a.peers, a.image_blob_messages, texts=a.message_texts).withColumn("content", F.md5("content"))


@query
def x3_export_messages_scoped(a):
    rows = exports.export_messages(
        a.slim_messages, a.peers, a.image_blob_messages, forwards=False, peer=FOCUS, start=START, end=END, text_only=True, media_only=True
    )
    return rows.select("id", "date", "peer_title", "forwarded", "fwd_from_peer_id", "fwd_from_name", "media_kind", "image_phash")


@query
def x3_export_messages_nested(a):
    _, records = exports.export_messages_nested(a.slim_messages, a.peers, a.image_blob_messages)
    return records.select(
        "peer_external_id", "id", F.col("forward.from_peer_id").alias("from_peer_id"), F.col("forward.from_name").alias("from_name"),
        F.col("media.kind").alias("kind"), F.col("media.document_id").alias("document_id"), F.col("media.phash").alias("phash"),
    )


@query
def x3_export_message_headers(a):
    headers, _ = exports.export_messages_nested(a.slim_messages, a.peers, a.image_blob_messages)
    return headers.drop("usernames")


@query
def x4_export_images(a):
    return exports.export_images(a.image_blobs, a.image_blob_messages, a.slim_messages, a.peers)[0]


@query
def x4_export_image_peers(a):
    return exports.export_images(a.image_blobs, a.image_blob_messages, a.slim_messages, a.peers)[1]


@query
def x5_export_videos(a):
    return exports.export_videos(a.slim_messages, a.peers)[0]


@query
def x5_export_video_peers(a):
    return exports.export_videos(a.slim_messages, a.peers, FOCUS)[1]


@query
def x6_export_files(a):
    return exports.export_files(a.slim_messages, a.peers)[0]


@query
def x6_export_file_peers(a):
    return exports.export_files(a.slim_messages, a.peers)[1]


# ---- streams

#: Folders a key log is dealt out to; each is a file or more a batch, so archives of this size want few.
STREAM_BUCKETS = 16


def _deliveries(a):
    """The archive delivered once, then everything again with edits, as files for a stream."""
    path = scratch_path(a.spark, "deliveries")
    first = a.slim_messages.withColumn("seq", F.col("id"))
    again = redelivered_messages(message_base(a.source)).withColumn("seq", F.col("id"))
    columns = [c for c in jobs.DELIVERIES.fieldNames() if c in again.columns]
    first.select(*columns, "text_ref").unionByName(again.select(*columns), allowMissingColumns=True).write.parquet(path)
    return path


def _twice(a):
    """Every message delivered two times, as files for a stream: what a delivery holds, without what the archive stores beside it."""
    path = scratch_path(a.spark, "deliveries")
    once = a.slim_messages.withColumn("seq", F.col("id")).select(*jobs.DELIVERIES.fieldNames())
    once.unionByName(once.withColumn("seq", F.col("seq") + 10**9)).write.parquet(path)
    return path


def _stream(a, on_batch, path=None):
    stream = jobs.read_deliveries(a.spark, path or _deliveries(a), files_per_batch=8)
    jobs.run_available(stream, on_batch, scratch_path(a.spark, "stream"))


@query
def w1_message_stream(a):
    store = jobs.MessageStream(a.spark, scratch_path(a.spark, "w1"))
    _stream(a, store.on_batch)
    empty = a.spark.createDataFrame([], TABLES["messages"])
    return _flat_shared(a, store.merged(empty), "inserted")


@query
def w1_message_stream_over_base(a):
    """Three deliveries of each message, in mixed order, over an archive that holds half of the messages already."""
    store = jobs.MessageStream(a.spark, scratch_path(a.spark, "w1"))
    path = scratch_path(a.spark, "deliveries")
    sent = three_deliveries(message_base(a.source)).withColumn("seq", F.col("seq").cast("long"))
    sent.select(*[c for c in jobs.DELIVERIES.fieldNames() if c in sent.columns]).write.parquet(path)
    _stream(a, store.on_batch, path)
    return _flat_shared(a, store.merged(a.slim_messages.filter("id % 2 = 0")), "inserted")


@query
def w2_counter_stream(a):
    store = jobs.CounterStream(a.spark, scratch_path(a.spark, "w2"), STREAM_BUCKETS)
    _stream(a, store.on_batch, _twice(a))
    return store.counters()


def _delivered_twice(a):
    """Every message in two deliveries, as a stream."""
    return jobs.read_deliveries(a.spark, _twice(a), files_per_batch=8)


@query
def w2_counter_state(a):
    """The counters by state that the engine keeps."""
    store = engine.counter_store(a.spark, scratch_path(a.spark, "w2-state"))
    store.run(engine.counter_totals(_delivered_twice(a)), scratch_path(a.spark, "stream"))
    return store.totals()


@query
def w2_live_counters(a):
    """All twenty counters, kept by deltas and bitmaps while messages arrive twice and the images' facts beside them."""
    store = live.LiveCounters(a.spark, scratch_path(a.spark, "w2-live"), STREAM_BUCKETS)
    jobs.run_available(_delivered_twice(a), store.on_batch, scratch_path(a.spark, "stream"))
    path = scratch_path(a.spark, "blobs")
    images.blob_flags(a.image_blobs, a.image_cache, trim_paths=False).repartition(2).write.parquet(path)
    blobs = jobs.read_deliveries(a.spark, path, 1, live.FLAGS)
    jobs.run_available(blobs, store.on_blobs, scratch_path(a.spark, "stream"))
    return store.counters()


@query
def w3_forward_state(a):
    store = engine.edge_store(a.spark, scratch_path(a.spark, "w3-state"))
    store.run(engine.edge_totals(_delivered_twice(a)), scratch_path(a.spark, "stream"))
    return store.totals()


@query
def w3_forward_stream(a):
    store = jobs.ForwardStream(a.spark, scratch_path(a.spark, "w3"), STREAM_BUCKETS)
    _stream(a, store.on_batch, _twice(a))
    return store.edges()


@query
def w4_coverage_stream(a):
    store = jobs.CoverageStream(a.spark, scratch_path(a.spark, "w4"))
    _ = a.slim_messages
    _stream(a, store.on_batch, a.path("slim_messages"))
    return store.coverage()


@query
def w5_relevance_stream(a):
    tables = {
        "vectors": a.image_embeddings, "inputs": a.scope_inputs, "links": a.image_blob_messages,
        "occ": a.forward_edge_messages, "peers": a.peers,
    }
    store = jobs.RelevanceStream(a.spark, scratch_path(a.spark, "w5"), tables, LOW_TAU)
    path = scratch_path(a.spark, "embedded")
    a.peer_counts.select("peer_external_id").repartition(3).write.parquet(path)
    stream = jobs.read_deliveries(a.spark, path, 2, T.StructType([T.StructField("peer_external_id", T.LongType())]))
    jobs.run_available(stream, store.on_batch, scratch_path(a.spark, "stream"))
    return _rounded_scores(store.peer_scores())


