"""Oracles for joins, aggregations, listings, catalog views and exports."""

from oracles.base import over_archive as q

FAN = """fan AS (SELECT l.phash, l.peer_external_id, count(*) AS appearances, count(m.fwd_from) AS forwarded, max(l.message_date) AS last_seen_at
           FROM links l JOIN messages m ON m.id = l.message_id GROUP BY 1, 2)"""
ROLLUP = """rollup_images AS (SELECT b.phash, canonical_path, refcount, count(l.message_id) AS appearances,
             count(DISTINCT l.peer_external_id) AS unique_peers, max(l.message_date) AS last_seen_at
           FROM blobs b LEFT JOIN links l USING (phash) GROUP BY ALL)"""


def _items(kind: str, extra: str, where: str = "true") -> str:
    return f"""SELECT item_id, max(TRY_CAST(msize AS BIGINT)) AS size_bytes, max(json_extract_string(media, '$.mime_type')) AS mime_type,
             max(fname) AS file_name, {extra} bool_or(downloaded AND nullif(mpath, '') IS NOT NULL) AS persisted,
             count(*) AS appearances, count(DISTINCT peer_external_id) AS unique_peers, max(date) AS last_seen_at
           FROM pm WHERE media_kind = '{kind}' AND {where} GROUP BY 1"""


VIDEO_EXTRA = """max(TRY_CAST(mduration AS DOUBLE)) AS duration, max(TRY_CAST(mwidth AS BIGINT)) AS width,
             max(TRY_CAST(mheight AS BIGINT)) AS height,"""
OWN_VIDEOS = "item_id IN (SELECT item_id FROM pm WHERE media_kind = 'video' AND peer_external_id = -1000000000001)"


def _item_peers(kind: str, where: str = "true") -> str:
    return f"""SELECT item_id, peer_external_id, count(*) AS appearances, count(fwd_from) AS forwarded, max(date) AS last_seen_at
           FROM pm WHERE media_kind = '{kind}' AND {where} GROUP BY 1, 2"""


def _named(source: str, key: str) -> str:
    return f"""SELECT {key}, peer_external_id, peer_type, title AS peer_title, username AS peer_username, usernames_csv AS peer_usernames,
             appearances, forwarded FROM {source} JOIN peers ON external_id = peer_external_id"""


def _windows() -> str:
    tests = {
        "image": "media_kind = 'image' AND has_phash", "video": "media_kind = 'video' AND downloaded",
        "audio": "media_kind = 'audio' AND downloaded", "gif": "media_kind = 'gif' AND downloaded",
        "document": "media_kind = 'document' AND downloaded", "text_embed": "has_text AND text_embedded",
        "image_embed": "media_kind = 'image' AND image_embedded",
    }
    cols = ", ".join(
        f"min(date) FILTER (WHERE {t}) AS {n}_after, max(date) FILTER (WHERE {t}) AS {n}_before" for n, t in tests.items()
    )
    return f"""raw_windows AS (SELECT peer_external_id, {cols} FROM pm GROUP BY 1),
         link_span AS (SELECT peer_external_id, min(message_date) AS la, max(message_date) AS lb FROM links GROUP BY 1),
         windows AS (SELECT * EXCLUDE (la, lb) REPLACE (coalesce(image_after, la) AS image_after,
           CASE WHEN image_after IS NULL THEN lb ELSE image_before END AS image_before) FROM raw_windows LEFT JOIN link_span USING (peer_external_id))"""


WINDOWS = _windows()

STATS = """stats AS (
  SELECT p.*, f.peer_external_id IS NOT NULL AS has_fetch, mc.peer_external_id IS NOT NULL AS has_media, pc.* EXCLUDE (peer_external_id),
    coalesce(mc.videos_excluded, false) AS videos_excluded, coalesce(mc.large_excluded, false) AS large_excluded,
    nullif(mc.max_media_bytes, 0) AS max_media_bytes,
    CASE WHEN coalesce(pc.posts, 0) > 0 THEN pc.posts ELSE messages_scraped END AS shown,
    CASE WHEN coalesce(pc.image_persisted, 0) > 0 THEN pc.image_persisted ELSE coalesce(pc.image_downloaded, 0) END AS kept
  FROM peers p LEFT JOIN peer_counts pc ON pc.peer_external_id = p.external_id
    LEFT JOIN fetch_cov f ON f.peer_external_id = p.external_id LEFT JOIN media_cov mc ON mc.peer_external_id = p.external_id
),
shown_stats AS (
  SELECT *, has_fetch OR shown > 0 AS scraped,
    has_fetch OR coalesce(unique_forwards, 0) > 0 OR coalesce(total_forwards, 0) > 0 AS has_forwards,
    has_media OR coalesce(image_total, 0) > 0 OR kept > 0 OR coalesce(image_hashed, 0) > 0 OR coalesce(image_unique, 0) > 0 AS show_image,
    has_media OR coalesce(video_total, 0) > 0 OR coalesce(video_downloaded, 0) > 0 AS show_video,
    has_media OR coalesce(audio_total, 0) > 0 OR coalesce(audio_downloaded, 0) > 0 AS show_audio,
    has_media OR coalesce(gif_total, 0) > 0 OR coalesce(gif_downloaded, 0) > 0 AS show_gif,
    has_media OR coalesce(document_total, 0) > 0 OR coalesce(document_downloaded, 0) > 0 AS show_document
  FROM stats
)"""


STAT_COLUMNS = (
    """external_id, has_fetch AS has_fetch_coverage, has_media OR coalesce(image_unique, 0) > 0 AS has_media_coverage,
    CASE WHEN scraped THEN shown END AS posts, CASE WHEN has_forwards THEN coalesce(unique_forwards, 0) END AS forwards_unique,
    CASE WHEN has_forwards THEN coalesce(total_forwards, 0) END AS forwards_total,
    CASE WHEN show_image THEN coalesce(image_total, 0) END AS image_total, CASE WHEN show_image THEN coalesce(image_hashed, 0) END AS image_hashed,
    CASE WHEN show_image THEN kept END AS image_downloaded, CASE WHEN show_image THEN coalesce(image_unique, 0) END AS image_unique, """
    + ", ".join(
        f"CASE WHEN show_{k} THEN coalesce({k}_{f}, 0) END AS {k}_{f}"
        for k in ("video", "audio", "gif", "document")
        for f in ("total", "downloaded")
    )
    + """, videos_excluded, large_excluded, max_media_bytes,
    CASE WHEN scraped AND text_total > 0 THEN text_embedded END AS text_done, CASE WHEN scraped AND text_total > 0 THEN text_total END AS text_total,
    CASE WHEN scraped AND image_embeddable > 0 THEN image_embedded_unique END AS images_done,
    CASE WHEN scraped AND image_embeddable > 0 THEN image_embeddable END AS images_total"""
)

ORIGINS = "okeys AS (SELECT DISTINCT origin_peer, origin_mid FROM pm WHERE origin_peer IS NOT NULL AND origin_mid IS NOT NULL)"

_NOW = "TIMESTAMP '2024-02-15 00:00:00'"


def _fill(after: str) -> str:
    return f"""CASE WHEN first_at IS NULL OR {after} IS NULL THEN 0::DOUBLE ELSE
      round(greatest(0, least(1, epoch({_NOW} - {after}) / epoch({_NOW} - first_at))), 4) END"""


_LAYERS = ", ".join(
    f"{k}_after AS {k}_covered_after, {k}_before AS {k}_covered_before, {_fill(f'{k}_after')} AS {k}_fill"
    for k in ("image", "video", "audio", "gif", "document")
)

ORACLES = {
    # ---- joins
    "j1_messages_with_peer": q(
        "SELECT id, peer_type, title AS peer_title, username AS peer_username FROM messages JOIN peers ON external_id = peer_external_id"
    ),
    "j2_first_phash": q("SELECT m.id AS message_id, min(phash) AS link_phash FROM messages m LEFT JOIN links ON message_id = id GROUP BY 1"),
    "j3_unlinked_forwards": q("SELECT id FROM messages WHERE fwd_from IS NOT NULL AND id NOT IN (SELECT message_id FROM occ)"),
    "j4_images_of_peer": q("SELECT phash, refcount FROM blobs WHERE phash IN (SELECT phash FROM links WHERE peer_external_id = -1000000000001)"),
    "j5_stored_originals": q(
        """SELECT id, peer_external_id, telegram_message_id FROM messages
           WHERE (peer_external_id, telegram_message_id) IN (SELECT (origin_peer, origin_mid) FROM okeys)""",
        ORIGINS,
    ),
    "j6_blobs_with_links": q("SELECT phash, refcount AS links FROM blobs"),
    "j7_pending_by_model": q(
        """SELECT id AS message_id FROM pm LEFT JOIN text_embeddings e ON e.message_id = id WHERE has_text AND model_id IS DISTINCT FROM 't1'"""
    ),
    "j8_count_spine": q(
        """SELECT peer_external_id, count(*) AS tables FROM (SELECT DISTINCT peer_external_id FROM messages UNION ALL
             SELECT DISTINCT peer_external_id FROM links UNION ALL SELECT DISTINCT from_id FROM edges) GROUP BY 1"""
    ),
    "j10_forwarded_images": q(
        """SELECT to_id AS origin_peer_id, message_id, phash FROM occ JOIN links USING (message_id) JOIN peers ON external_id = to_id"""
    ),
    "j11_edge_titles": q(
        """SELECT from_id AS from_external_id, to_id AS to_external_id, a.title AS from_title, a.username AS from_username,
             b.title AS to_title, b.username AS to_username, n AS forward_count
           FROM edges LEFT JOIN peers a ON a.external_id = from_id LEFT JOIN peers b ON b.external_id = to_id"""
    ),
    "j12_items_of_peer": q(f"SELECT item_id, id FROM pm WHERE media_kind = 'video' AND {OWN_VIDEOS}"),
    "j13_first_message_dates": q(
        """SELECT external_id, first_message_id, coalesce(first_message_at, m.date) AS first_message_at FROM peers
           LEFT JOIN messages m ON m.peer_external_id = external_id AND m.telegram_message_id = first_message_id"""
    ),
    "j14_named_fan_out": q(
        """SELECT phash, peer_external_id, peer_type, title AS peer_title, appearances, forwarded FROM fan JOIN peers ON external_id = peer_external_id""",
        FAN,
    ),
    "j15_unpersisted_images": q(
        "SELECT DISTINCT peer_external_id, phash FROM links JOIN blobs USING (phash) WHERE nullif(canonical_path, '') IS NULL"
    ),
    # ---- aggregations
    "a1_peer_counts": q("SELECT * FROM peer_counts"),
    "a2_message_deltas": q(
        """SELECT peer_external_id, posts, text_total, image_total, image_downloaded, video_total, video_downloaded, audio_total,
             audio_downloaded, gif_total, gif_downloaded, document_total, document_downloaded FROM message_counts"""
    ),
    "a3_apply_deltas": q(
        """, d AS (SELECT peer_external_id - CASE WHEN posts % 2 = 0 THEN 1000000 ELSE 0 END AS pid, posts AS dp FROM peer_counts),
           j AS (SELECT coalesce(peer_external_id, pid) AS peer_external_id, c.* EXCLUDE (peer_external_id, posts, video_total),
               coalesce(posts, 0) + coalesce(dp, 0) AS posts, CASE WHEN pid IS NOT NULL THEN 0 ELSE video_total END AS video_total
             FROM peer_counts c FULL JOIN d ON pid = peer_external_id)
           SELECT * FROM (SELECT peer_external_id, posts, CAST(coalesce(video_total, 0) AS BIGINT) AS video_total, """
        + ", ".join(
            f"coalesce({c}, 0) AS {c}"
            for c in (
                "text_total", "text_embedded", "image_total", "image_hashed", "image_downloaded", "image_unique", "image_persisted",
                "image_embeddable", "image_embedded_unique", "video_downloaded", "audio_total", "audio_downloaded", "gif_total",
                "gif_downloaded", "document_total", "document_downloaded", "unique_forwards", "total_forwards",
            )
        )
        + " FROM j)"
    ),
    "a4_phash_snapshot": q(
        """SELECT DISTINCT phash, peer_external_id, CAST(1 AS BIGINT) AS image_unique, CAST(coalesce(trim(canonical_path) <> '', false) AS BIGINT) AS image_persisted,
             CAST(image_embedded OR coalesce(trim(canonical_path) <> '', false) OR phash IN (SELECT phash FROM image_cache) AS BIGINT) AS image_embeddable,
             CAST(image_embedded AS BIGINT) AS image_embedded_unique FROM links JOIN blobs USING (phash)"""
    ),
    "a4_snapshot_diff": q(
        """, p AS (SELECT DISTINCT phash, peer_external_id FROM links),
           f AS (SELECT phash, image_embedded AS e0, coalesce(trim(canonical_path) <> '', false) OR phash IN (SELECT phash FROM image_cache) AS able,
               image_embedded OR phash IN (SELECT phash FROM image_embeddings) AS e1 FROM blobs)
           SELECT peer_external_id, CAST(0 AS BIGINT) AS image_unique, CAST(0 AS BIGINT) AS image_persisted,
             count(*) FILTER (WHERE e1 AND NOT e0 AND NOT able) AS image_embeddable, count(*) FILTER (WHERE e1 AND NOT e0) AS image_embedded_unique
           FROM p JOIN f USING (phash) GROUP BY 1 HAVING count(*) FILTER (WHERE e1 AND NOT e0) > 0"""
    ),
    "a5_media_windows": q("SELECT * FROM windows", WINDOWS),
    "a6_fetch_coverage": q(
        """SELECT peer_external_id, min(date) AS covered_after, max(date) AS covered_before FROM messages
           LEFT JOIN peers ON external_id = peer_external_id
           WHERE first_message_id IS NULL OR telegram_message_id >= first_message_id + 1 GROUP BY 1"""
    ),
    "a7_media_coverage": q(
        """SELECT coalesce(f.peer_external_id, m.peer_external_id) AS peer_external_id,
             coalesce(f.covered_after, m.covered_after) AS covered_after, coalesce(f.covered_before, m.covered_before) AS covered_before,
             CASE WHEN f.peer_external_id IS NOT NULL THEN true ELSE videos_excluded END AS videos_excluded,
             CASE WHEN f.peer_external_id IS NOT NULL THEN false ELSE large_excluded END AS large_excluded,
             CAST(coalesce(CASE WHEN f.peer_external_id % 6 = 0 THEN 777 END, max_media_bytes) AS BIGINT) AS max_media_bytes
           FROM fetch_cov f FULL JOIN media_cov m ON m.peer_external_id = f.peer_external_id"""
    ),
    "a8_image_rollup": q("SELECT * FROM rollup_images", ROLLUP),
    "a8_image_rollup_of_peer": q(
        "SELECT * FROM rollup_images WHERE phash IN (SELECT phash FROM links WHERE peer_external_id = -1000000000001)", ROLLUP
    ),
    "a9_image_peers": q("SELECT * FROM fan", FAN),
    "a10_video_rollup": q(_items("video", VIDEO_EXTRA)),
    "a10_video_rollup_of_peer": q(_items("video", VIDEO_EXTRA, OWN_VIDEOS)),
    "a11_file_rollup": q(_items("document", "")),
    "a12_video_peers": q(_item_peers("video")),
    "a12_file_peers": q(_item_peers("document")),
    "a13_kind_histogram": q(
        """SELECT count(*) AS messages, count(*) FILTER (WHERE media_kind = 'image') AS image, count(*) FILTER (WHERE media_kind = 'video') AS video,
             count(*) FILTER (WHERE media_kind = 'audio') AS audio, count(*) FILTER (WHERE media_kind = 'gif') AS gif,
             count(*) FILTER (WHERE media_kind = 'document') AS document
           FROM pm WHERE peer_external_id IN (SELECT peer_external_id FROM fetch_cov)"""
    ),
    "a14_catalog_totals": q(
        """SELECT (SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM blobs) AS images_hashed,
             (SELECT count(*) FROM blobs WHERE trim(canonical_path) <> '') AS images_downloaded,
             count(DISTINCT item_id) AS videos_downloaded, count(DISTINCT mpath) AS video_paths
           FROM pm WHERE media_kind = 'video' AND downloaded AND trim(mpath) <> ''"""
    ),
    "a14_storage_bytes": """WITH s AS (SELECT source AS folder, count(*) AS count, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1)
           SELECT folder, count, bytes, CASE WHEN bytes < 1024 THEN bytes || ' B'
             WHEN bytes < 1048576 AND bytes / 1024 >= 10 THEN printf('%.0f', bytes / 1024) || ' KB'
             WHEN bytes < 1048576 THEN regexp_replace(printf('%.1f', bytes / 1024), '\\.0$', '') || ' KB'
             WHEN bytes / 1048576 >= 10 THEN printf('%.0f', bytes / 1048576) || ' MB'
             ELSE regexp_replace(printf('%.1f', bytes / 1048576), '\\.0$', '') || ' MB' END AS bytes_label FROM s""",
    "a15_graph_endpoints": q("SELECT from_id AS id FROM edges UNION SELECT to_id FROM edges"),
    "a16_id_span": q(
        """SELECT peer_external_id, min(telegram_message_id) AS lo, max(telegram_message_id) AS hi FROM messages
           LEFT JOIN peers ON external_id = peer_external_id WHERE telegram_message_id IS DISTINCT FROM first_message_id GROUP BY 1"""
    ),
    "a17_shared_images": q(
        """SELECT phash, count(DISTINCT peer_external_id) AS unique_peers, count(*) AS appearances, min(message_date) AS first_seen
           FROM links GROUP BY 1 HAVING count(DISTINCT peer_external_id) >= 2"""
    ),
    "a19_edge_totals": q("SELECT peer_external_id, unique_forwards, CAST(total_forwards AS BIGINT) AS total_forwards FROM edge_counts"),
    "u1_id_spine": q("SELECT * FROM spine"),
    "u2_edge_ends": q("SELECT count(*) AS peers FROM (SELECT from_id FROM edges UNION SELECT to_id FROM edges)"),
    # ---- orders and pages
    "t1_message_page": q(
        """SELECT id, date, telegram_message_id, title AS peer_title, md5(content) AS content, (SELECT count(*) FROM messages) AS total FROM messages JOIN peers ON external_id = peer_external_id
           ORDER BY date DESC, telegram_message_id DESC, id DESC LIMIT 50 OFFSET 100"""
    ),
    "t1_message_page_after": q(
        "SELECT id, date, telegram_message_id FROM messages WHERE date < TIMESTAMP '2024-01-15' ORDER BY date DESC, telegram_message_id DESC, id DESC LIMIT 50"
    ),
    "t1_video_page": q(
        f"""SELECT item_id, appearances, unique_peers, last_seen_at, count(*) OVER () AS total FROM ({_items("video", VIDEO_EXTRA)})
           ORDER BY last_seen_at DESC NULLS LAST, item_id LIMIT 50 OFFSET 5"""
    ),
    "t1_file_page": q(
        f"""SELECT item_id, appearances, unique_peers, last_seen_at, count(*) OVER () AS total FROM ({_items("document", "")})
           ORDER BY last_seen_at DESC NULLS LAST, item_id LIMIT 50"""
    ),
    "t2_image_page": q(
        """SELECT phash, unique_peers, appearances, (SELECT count(*) FROM rollup_images) AS total FROM rollup_images ORDER BY unique_peers > 1 DESC, unique_peers < appearances DESC,
             unique_peers DESC, appearances DESC, last_seen_at DESC NULLS LAST, phash LIMIT 50""",
        ROLLUP,
    ),
    "t2_image_page_by_date": q(
        "SELECT phash, last_seen_at FROM rollup_images ORDER BY last_seen_at DESC NULLS LAST, unique_peers DESC, appearances DESC, phash LIMIT 50 OFFSET 10",
        ROLLUP,
    ),
    "t3_newest_with_flag": q("SELECT id, date, (SELECT count(*) > 100 FROM messages) AS truncated FROM messages ORDER BY date DESC, id LIMIT 100"),
    "t4_peer_order": q(
        """, s AS (SELECT external_id, is_scraping, CASE WHEN scraped THEN shown END AS posts,
               CASE WHEN has_forwards THEN coalesce(total_forwards, 0) END AS forwards_total,
               coalesce(image_total, 0) + coalesce(video_total, 0) + coalesce(audio_total, 0) + coalesce(gif_total, 0) + coalesce(document_total, 0) AS media
             FROM shown_stats)
           SELECT external_id, posts, forwards_total FROM s ORDER BY is_scraping DESC, posts DESC NULLS LAST, forwards_total DESC NULLS LAST,
             media DESC, external_id DESC LIMIT 100""",
        STATS,
    ),
    "t4_peer_order_subscribers": q(
        """SELECT external_id, CAST(participants_count AS BIGINT) AS participants_count FROM peers
           ORDER BY is_scraping DESC, participants_count ASC NULLS LAST, external_id DESC LIMIT 100"""
    ),
    "t5_latest_sample": q(
        """, s AS (SELECT peer_external_id AS via, unnest([o1, o2]) AS target, date, telegram_message_id FROM pm WHERE fwd_from IS NOT NULL)
           SELECT via, target, arg_max(telegram_message_id, date) AS telegram_message_id FROM s WHERE target < 0 GROUP BY 1, 2"""
    ),
    "t6_video_sources": q(
        """SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY date DESC, id DESC) AS rank FROM pm WHERE media_kind = 'video'
           QUALIFY rank <= 16"""
    ),
    "t6_image_sources": q(
        "SELECT phash, message_id, row_number() OVER (PARTITION BY phash ORDER BY message_date DESC, message_id DESC) AS rank FROM links QUALIFY rank <= 4"
    ),
    "t1_indexed_pages": q(
        """SELECT page, place, id, date FROM (
             SELECT id, date, row_number() OVER (ORDER BY date DESC NULLS LAST, telegram_message_id DESC, id DESC) - 1 AS place,
               'all:' || (place - place % 997) AS page, place % 997 < 7 AS shown
             FROM messages JOIN peers ON external_id = peer_external_id
             UNION ALL
             SELECT id, date, row_number() OVER (PARTITION BY peer_external_id ORDER BY date DESC NULLS LAST, telegram_message_id DESC, id DESC) - 1 AS place,
               'peer:' || peer_external_id AS page, place BETWEEN 2 AND 4 AS shown
             FROM messages JOIN peers ON external_id = peer_external_id)
           WHERE shown"""
    ),
    "t7_type_ahead": q(
        "SELECT external_id, title FROM peers WHERE title ILIKE '%customer#0000001%' ORDER BY external_id LIMIT 8"
    ),
    # ---- catalog views
    "c1_attach_stats": q(f"SELECT {STAT_COLUMNS} FROM shown_stats", STATS),
    "c2_list_peers": q(f"SELECT {STAT_COLUMNS}, title, scope_score, forward_score, created_at FROM shown_stats", STATS),
    "c3_peer_coverage": q(
        f"""SELECT external_id, first_at AS timeline_start, {_NOW} AS timeline_end, first_message_id, posts_after, posts_count,
             {_fill('posts_after')} AS posts_fill, pass_bytes,
             CASE WHEN coalesce(total_forwards, 0) > 0 THEN {_fill('posts_after')} ELSE 0 END AS forwards_fill, {_LAYERS},
             coalesce(text_total, 0) AS text_embed_total, coalesce(text_embedded, 0) AS text_embed_done,
             text_embed_after AS text_embed_covered_after, text_embed_before AS text_embed_covered_before, {_fill('text_embed_after')} AS text_embed_fill,
             coalesce(image_embeddable, 0) AS images_embed_total, coalesce(image_embedded_unique, 0) AS images_embed_done,
             image_embed_after AS images_embed_covered_after, image_embed_before AS images_embed_covered_before, {_fill('image_embed_after')} AS images_embed_fill
           FROM (SELECT s.* , CASE WHEN scraped THEN shown END AS posts_count, w.* EXCLUDE (peer_external_id), f.covered_after AS posts_after,
                   mc.max_media_bytes AS pass_bytes, coalesce(s.first_message_at, m.date) AS first_at
                 FROM shown_stats s LEFT JOIN windows w ON w.peer_external_id = s.external_id LEFT JOIN fetch_cov f ON f.peer_external_id = s.external_id
                 LEFT JOIN media_cov mc ON mc.peer_external_id = s.external_id
                 LEFT JOIN messages m ON m.peer_external_id = s.external_id AND m.telegram_message_id = s.first_message_id)""",
        STATS + ", " + WINDOWS,
    ),
    "c4_list_messages": q(
        """SELECT id, telegram_message_id, date, md5(content) AS content, from_external_id, fwd_from IS NOT NULL AS forwarded, media_kind,
             peer_external_id, peer_type, title AS peer_title, username AS peer_username FROM pm JOIN peers ON external_id = peer_external_id"""
    ),
    "c4_list_messages_cut": q("SELECT id, md5(content[1:2000]) AS content FROM pm JOIN peers ON external_id = peer_external_id"),
    "c5_message_detail": q(
        """SELECT id, telegram_message_id, date, md5(CASE WHEN trim(content) <> '' THEN content END) AS content, media_kind,
             trim(mphash) AS phash, CASE WHEN msize IS NULL THEN NULL WHEN CAST(msize AS BIGINT) < 1024 THEN msize || ' B'
               WHEN CAST(msize AS BIGINT) < 10240 THEN regexp_replace(printf('%.1f', CAST(msize AS DOUBLE) / 1024), '\\.0$', '') || ' KB'
               ELSE printf('%.0f', CAST(msize AS DOUBLE) / 1024) || ' KB' END AS size_label,
             TRY_CAST(mduration AS DOUBLE) AS duration, TRY_CAST(mwidth AS BIGINT) AS width FROM pm"""
    ),
    "c6_lookup_origin": q(
        """SELECT k.origin_peer, k.origin_mid, coalesce(m.id, c.id) AS id, m.id IS NOT NULL AS stored FROM okeys k
           LEFT JOIN messages m ON m.peer_external_id = k.origin_peer AND m.telegram_message_id = k.origin_mid
           LEFT JOIN (SELECT origin_peer, origin_mid, arg_max(id, date) AS id FROM pm GROUP BY 1, 2) c
             ON c.origin_peer = k.origin_peer AND c.origin_mid = k.origin_mid""",
        ORIGINS,
    ),
    # ---- exports
    "x1_export_peers": q(
        """SELECT external_id, peer_type, title, username, usernames_csv AS usernames, about, created_at, updated_at,
             CAST(participants_count AS BIGINT) AS participants_count, CASE WHEN scraped THEN shown END AS posts,
             CASE WHEN has_forwards THEN coalesce(unique_forwards, 0) END AS forwards_unique,
             CASE WHEN has_forwards THEN coalesce(total_forwards, 0) END AS forwards_total,
             CASE WHEN show_image THEN coalesce(image_unique, 0) END AS images_unique, CASE WHEN show_image THEN kept END AS images_persisted,
             CASE WHEN show_video THEN coalesce(video_total, 0) END AS videos_total, CASE WHEN show_video THEN coalesce(video_downloaded, 0) END AS videos_downloaded,
             CASE WHEN show_audio THEN coalesce(audio_total, 0) END AS audio_total, CASE WHEN show_gif THEN coalesce(gif_total, 0) END AS gif_total,
             CASE WHEN show_document THEN coalesce(document_total, 0) END AS document_total, verified, restriction_csv AS restriction_reason, location_lat,
             has_fetch AS has_fetch_coverage, CASE WHEN scraped AND text_total > 0 THEN text_embedded || '/' || text_total END AS embed_text,
             CASE WHEN scraped AND image_embeddable > 0 THEN image_embedded_unique || '/' || image_embeddable END AS embed_images,
             videos_excluded, large_excluded, max_media_bytes FROM shown_stats""",
        STATS,
    ),
    "x1_export_peers_whole": q(
        """SELECT external_id, peer_type,
             CASE WHEN k % 3 = 0 THEN c_name WHEN k % 4 <> 0 AND k % 5 = 0 THEN 'Ann Lee' WHEN k % 4 <> 0 THEN 'Ann' WHEN k % 5 = 0 THEN 'Lee' END AS title,
             CASE WHEN k % 4 <> 0 THEN 'Ann' END AS first_name, CASE WHEN k % 5 = 0 THEN 'Lee' END AS last_name,
             CASE WHEN k % 2 = 0 THEN '@n' || k END AS username,
             CASE WHEN k % 2 = 0 THEN 'N' || k || ';x' || k ELSE 'x' || k || ';N' || k END AS usernames, c_mktsegment AS about,
             CAST('2023-05-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') || ' 00:00:00' AS TIMESTAMP) AS telegram_date, created_at, updated_at,
             CASE WHEN k % 2 = 0 THEN CAST('2024-04-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') || ' 00:00:00' AS TIMESTAMP) END AS last_message_at,
             CAST(CASE WHEN k % 6 = 0 THEN 99 ELSE k END AS BIGINT) AS participants_count, CASE WHEN scraped THEN shown END AS posts,
             CASE WHEN has_forwards THEN coalesce(unique_forwards, 0) END AS forwards_unique,
             CASE WHEN has_forwards THEN coalesce(total_forwards, 0) END AS forwards_total,
             CASE WHEN show_image THEN coalesce(image_unique, 0) END AS images_unique, CASE WHEN show_image THEN kept END AS images_persisted,
             CASE WHEN show_video THEN coalesce(video_total, 0) END AS videos_total, CASE WHEN show_video THEN coalesce(video_downloaded, 0) END AS videos_downloaded,
             CASE WHEN show_audio THEN coalesce(audio_total, 0) END AS audio_total, CASE WHEN show_gif THEN coalesce(gif_total, 0) END AS gif_total,
             CASE WHEN show_document THEN coalesce(document_total, 0) END AS document_total, """
        + ", ".join(
            f"CASE WHEN k % 5 <> 4 THEN (k + {n}) % {n + 2} = 0 END AS {c}"
            for n, c in enumerate(
                """verified scam fake restricted noforwards forum gigagroup join_to_send join_request has_link has_geo deleted premium
                deactivated slowmode_enabled""".split()
            )
        )
        + ", "
        + ", ".join(
            f"CAST(CASE WHEN k % 7 <> {n % 7} THEN k * 10 + {n} END AS BIGINT) AS {c}"
            for n, c in enumerate(
                """slowmode_seconds available_min_id admins_count kicked_count banned_count online_count ttl_period pinned_msg_id
                common_chats_count""".split()
            )
        )
        + """, CASE WHEN k % 9 = 0 THEN 'ios:porn: blocked; terms' ELSE '' END AS restriction_reason, k % 3 = 0 AS hidden_prehistory,
             CASE WHEN k % 2 = 0 THEN k % 4 = 0 END AS participants_hidden,
             CASE WHEN k % 2 = 1 THEN -(1000000000000 + k + 5) END AS linked_chat_id,
             CASE WHEN k % 4 - 1 > 0 THEN -(1000000000000 + k % 4 - 1) END AS linked_monoforum_id,
             CASE WHEN k % 3 > 0 THEN -(k % 3) END AS migrated_from_chat_id,
             CASE WHEN k % 5 - 2 > 0 THEN -(1000000000000 + k % 5 - 2) END AS migrated_to_channel_id,
             CASE WHEN k % 7 = 0 THEN 'here' END AS location_address, CASE WHEN k % 7 = 0 THEN c_acctbal END AS location_lat,
             CASE WHEN k % 7 = 0 THEN CAST(1.5 AS DOUBLE) END AS location_lng,
             has_fetch AS has_fetch_coverage, CASE WHEN scraped AND text_total > 0 THEN text_embedded || '/' || text_total END AS embed_text,
             CASE WHEN scraped AND image_embeddable > 0 THEN image_embedded_unique || '/' || image_embeddable END AS embed_images,
             videos_excluded, large_excluded, max_media_bytes
           FROM shown_stats JOIN (SELECT c_custkey AS k, c_name, c_mktsegment, c_acctbal FROM customer) ON k = c_custkey""",
        STATS,
    ),
    "x1_saved_peer_files": q(
        """SELECT peer_type AS by_peer_type, count(*) AS peers, count(*) FILTER (WHERE scraped) AS with_posts,
             max(CASE WHEN scraped AND text_total > 0 THEN text_embedded || '/' || text_total END) AS embed_text
           FROM shown_stats WHERE peer_type IN ('channel', 'bot') GROUP BY 1""",
        STATS,
    ),
    "x2_export_forward_edges": q(
        """SELECT from_id AS from_external_id, CASE WHEN from_id < -1000000000000 THEN 'channel' ELSE 'chat' END AS from_peer_type, a.title AS from_title,
             a.username AS from_username, to_id AS to_external_id, CASE WHEN to_id < -1000000000000 THEN 'channel' ELSE 'chat' END AS to_peer_type,
             b.title AS to_title, b.username AS to_username, last_name AS last_from_name, n AS forward_count, first_seen AS first_seen_at,
             last_seen AS last_seen_at FROM edges JOIN peers a ON a.external_id = from_id LEFT JOIN peers b ON b.external_id = to_id"""
    ),
    "x3_export_messages": q(
        """SELECT id, telegram_message_id, date, peer_external_id, peer_type, title AS peer_title, username AS peer_username,
             usernames_csv AS peer_usernames, from_external_id, md5(content) AS content, fwd_from IS NOT NULL AS forwarded, origin_peer AS fwd_from_peer_id,
             fwd_name AS fwd_from_name, media_kind, docid AS media_document_id, json_extract_string(media, '$.mime_type') AS media_mime_type,
             fname AS media_file_name, msize AS media_size_bytes, mduration AS media_duration, mwidth AS media_width, mheight AS media_height,
             phash AS image_phash, text_embedded, image_embedded
           FROM pm JOIN peers ON external_id = peer_external_id LEFT JOIN (SELECT message_id, min(phash) AS phash FROM links GROUP BY 1) l ON l.message_id = id"""
    ),
    "x3_export_messages_scoped": q(
        """SELECT id, date, title AS peer_title, fwd_from IS NOT NULL AS forwarded, CAST(NULL AS BIGINT) AS fwd_from_peer_id,
             CAST(NULL AS VARCHAR) AS fwd_from_name, media_kind, phash AS image_phash
           FROM pm JOIN peers ON external_id = peer_external_id LEFT JOIN links ON message_id = id
           WHERE pm.peer_external_id = -1000000000001 AND date >= TIMESTAMP '2024-01-08' AND date <= TIMESTAMP '2024-01-20 23:59:59.999'
             AND has_text AND mkind IS NOT NULL"""
    ),
    "x3_export_messages_nested": q(
        """SELECT pm.peer_external_id, CAST(id AS VARCHAR) AS id, origin_peer AS from_peer_id, fwd_name AS from_name, media_kind AS kind,
             docid AS document_id, phash FROM pm JOIN peers ON external_id = peer_external_id LEFT JOIN links ON message_id = id"""
    ),
    "x3_export_message_headers": q(
        "SELECT external_id, peer_type, title, username, posts AS messages FROM peers JOIN message_counts ON peer_external_id = external_id"
    ),
    "x4_export_images": q(
        "SELECT phash, appearances, unique_peers, last_seen_at, coalesce(canonical_path <> '', false) AS persisted, refcount FROM rollup_images", ROLLUP
    ),
    "x4_export_image_peers": q(_named("fan", "phash"), FAN),
    "x5_export_videos": q(
        "SELECT item_id AS video_id, * EXCLUDE (item_id, duration), CAST(floor(duration) AS BIGINT) AS duration FROM (" + _items("video", VIDEO_EXTRA) + ")"
    ),
    "x5_export_video_peers": q(_named("(" + _item_peers("video", OWN_VIDEOS) + ")", "item_id AS video_id")),
    "x6_export_files": q("SELECT item_id AS file_id, * EXCLUDE (item_id) FROM (" + _items("document", "") + ")"),
    "x6_export_file_peers": q(_named("(" + _item_peers("document") + ")", "item_id AS file_id")),
}
