"""Oracles for sources, merges and column rules."""

from oracles.base import PEER, over_archive as q

DELTA = (
    """delta AS (
  SELECT event_id + 10000000 AS id, """
    + PEER.format(k="user_id")
    + """ AS peer_external_id,
    event_id + 1 + CASE WHEN event_id % 4 = 3 THEN 10000000 ELSE 0 END AS telegram_message_id, ts AS date,
    CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'edit ' || event_id END AS content,
    CASE WHEN event_id % 3 = 2 THEN '{"from_name":"Z"}' END AS fwd_from,
    CASE event_id % 5 WHEN 0 THEN '{"tl":"MessageMediaDocument","mime_type":"video/mp4","size_bytes":77}'
                      WHEN 1 THEN '{"kind":"video","width":10}' END AS media
  FROM base
)"""
)

FIELDS = (
    "tl", "downloaded", "size_bytes", "document_id", "mime_type", "duration", "width", "height", "file_name",
    "phash", "path",
)


def _merged_rows(strict: bool = True) -> str:
    def j(side: str, f: str) -> str:
        return f"json_extract_string({side}.media, '$.{f}')"

    new_kind = f"coalesce({j('d', 'kind')}, {j('m', 'kind')})"
    keep = f"({new_kind} IS NOT NULL OR NOT (m.id IS NOT NULL AND d.id IS NOT NULL))" if strict else "true"
    media = ",\n    ".join(
        f"CASE WHEN {keep} THEN coalesce({j('m', f)}, {j('d', f)}) END AS m_{f}" for f in FIELDS
    )
    return f"""SELECT coalesce(m.peer_external_id, d.peer_external_id) AS peer_external_id,
    coalesce(m.telegram_message_id, d.telegram_message_id) AS telegram_message_id,
    coalesce(m.id, d.id) AS id, coalesce(m.date, d.date) AS date,
    md5(CASE WHEN d.id IS NOT NULL THEN d.content ELSE m.content END) AS content_md5,
    json_extract_string(coalesce(d.fwd_from, m.fwd_from), '$.from_name') AS from_name,
    json_extract_string(coalesce(d.fwd_from, m.fwd_from), '$.channel_post') AS channel_post,
    {new_kind} AS m_kind, {media},
    coalesce(m.text_embedded, false) AS text_embedded, coalesce(m.image_embedded, false) AS image_embedded,
    m.id IS NULL AS inserted
  FROM messages m FULL JOIN delta d USING (peer_external_id, telegram_message_id)"""


def _merged(strict: bool) -> str:
    return q(_merged_rows(strict), DELTA)


def deliveries(base_filter: str = "true") -> str:
    """Three deliveries applied one after the other, each a full join of what is there and what comes."""
    kinds = ("CASE WHEN r % 7 = 3 THEN 'image' END", "CASE WHEN r % 7 <> 5 THEN 'audio' END", "CASE WHEN r % 3 = 1 THEN 'gif' END")
    names = ("CASE WHEN r % 2 = 0 THEN 'a.bin' END", "'b.bin'", "CASE WHEN r % 5 = 0 THEN 'c.bin' END")
    given = {"kind": kinds, "file_name": names}
    steps = [DELTA]
    start = ", ".join(f"json_extract_string(media, '$.{f}') AS m_{f}" for f in ("kind", *FIELDS))
    steps.append(
        f"""s0 AS (SELECT id, peer_external_id, telegram_message_id, date, content, fwd_from, {start},
          text_embedded, image_embedded, false AS inserted FROM messages WHERE {base_filter})"""
    )
    for n in range(3):
        def sent(f: str) -> str:
            if f in given:
                return given[f][n]
            return f"CASE WHEN r % {n + 2} = 0 THEN '{f}{n}-' || r END" if f in ("width", "path") else "NULL"

        fields = ", ".join(f"CASE WHEN r % 11 <> {n} THEN {sent(f)} END AS n_{f}" for f in ("kind", *FIELDS))
        steps.append(
            f"""d{n} AS (SELECT id AS new_id, peer_external_id, telegram_message_id, date AS new_date,
              concat_ws('/', '{n}', content) AS new_content, fwd_from AS new_fwd, {fields}
            FROM (SELECT *, id - 10000000 AS r FROM delta) WHERE (r + {n}) % 4 < 3)"""
        )
        kept = "new_id IS NULL OR id IS NULL OR coalesce(n_kind, m_kind) IS NOT NULL"
        merged = ", ".join(f"CASE WHEN {kept} THEN coalesce(m_{f}, n_{f}) END AS m_{f}" for f in FIELDS)
        steps.append(
            f"""s{n + 1} AS (SELECT coalesce(id, new_id) AS id, peer_external_id, telegram_message_id, coalesce(date, new_date) AS date,
              CASE WHEN new_id IS NULL THEN content ELSE new_content END AS content, coalesce(new_fwd, fwd_from) AS fwd_from,
              coalesce(n_kind, m_kind) AS m_kind, {merged}, coalesce(text_embedded, false) AS text_embedded,
              coalesce(image_embedded, false) AS image_embedded, coalesce(inserted, true) AS inserted
            FROM s{n} FULL JOIN d{n} USING (peer_external_id, telegram_message_id))"""
        )
    return q(
        f"""SELECT peer_external_id, telegram_message_id, id, date, md5(content) AS content_md5,
          json_extract_string(fwd_from, '$.from_name') AS from_name, json_extract_string(fwd_from, '$.channel_post') AS channel_post,
          {", ".join("m_" + f for f in ("kind", *FIELDS))}, text_embedded, image_embedded, inserted FROM s3""",
        ", ".join(steps),
    )


ORACLES = {
    "i1_merge_deliveries": deliveries(),
    "s1_catalog_scan": q(
        """SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS messages, count(DISTINCT peer_external_id) AS peers
           FROM messages GROUP BY 1"""
    ),
    "i1_merge_messages": _merged(True),
    "i1_write_back": _merged(True).replace(",\n    m.id IS NULL AS inserted", ""),
    "i1_merge_messages_lenient": _merged(False),
    "i2_merge_peers": q(
        """SELECT coalesce(p.external_id, s.ext) AS external_id,
             CASE WHEN s.ext IS NOT NULL THEN 'channel' ELSE peer_type END AS peer_type,
             coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_name END, title) AS title,
             coalesce('t' || s_suppkey, username) AS username,
             coalesce(CASE WHEN s_suppkey % 5 = 0 THEN s_name END, about) AS about,
             coalesce(s_suppkey, participants_count) AS participants_count, verified
           FROM peers p FULL JOIN (SELECT *, -(1000000000000 + 2 * s_suppkey + 1) AS ext FROM supplier) s ON s.ext = p.external_id"""
    ),
    "i3_merge_peer_stubs": q(
        """, stubs AS (SELECT to_id, arg_min(fwd_name, message_date) FILTER (WHERE fwd_name IS NOT NULL) AS name FROM occ GROUP BY 1)
           SELECT coalesce(external_id, to_id) AS external_id,
             CASE WHEN external_id IS NOT NULL THEN peer_type WHEN to_id < -1000000000000 THEN 'channel' ELSE 'chat' END AS peer_type,
             coalesce(title, name) AS title
           FROM peers FULL JOIN stubs ON to_id = external_id"""
    ),
    "i4_discover_peers": q(
        """, m AS (SELECT event_id, user_id + 1 + event_id % 3 AS k FROM events)
           SELECT external_id, peer_type, 'T' || min(event_id) AS title FROM (
             SELECT event_id, """
        + PEER.format(k="k")
        + """ AS external_id,
               CASE WHEN k % 10 = 9 THEN 'user' WHEN k % 10 = 8 THEN 'chat' WHEN k % 3 = 0 THEN 'megagroup' ELSE 'channel' END AS peer_type
             FROM m) WHERE peer_type <> 'user' GROUP BY 1, 2"""
    ),
    "i5_first_message": q(
        """, probe AS (SELECT peer_external_id AS pid, min(telegram_message_id) AS lo, arg_min(date, telegram_message_id) AS probe_at
                       FROM messages GROUP BY 1),
           x AS (SELECT *, lo IS NOT NULL AND (first_message_id IS NULL OR first_message_at IS NULL OR first_message_id > lo) AS better
                 FROM peers LEFT JOIN probe ON pid = external_id)
           SELECT external_id, CASE WHEN better THEN lo ELSE first_message_id END AS first_message_id,
             CASE WHEN better THEN probe_at ELSE first_message_at END AS first_message_at FROM x"""
    ),
    "i5_first_message_missing": q("SELECT external_id FROM peers WHERE first_message_id IS NULL OR first_message_at IS NULL"),
    "i6_forward_occurrences": q(
        """SELECT from_id AS from_external_id, to_id AS to_external_id, message_id, message_date, telegram_message_id,
             fwd_name AS from_name FROM occ"""
    ),
    "i6_forward_occurrences_new": q(
        """SELECT from_id AS from_external_id, to_id AS to_external_id, message_id, message_date, telegram_message_id,
             fwd_name AS from_name FROM occ WHERE from_id NOT IN (SELECT peer_external_id FROM fetch_cov)"""
    ),
    "i7_forward_edges": q(
        """SELECT from_id AS from_external_id, to_id AS to_external_id,
             CASE WHEN from_id < -1000000000000 THEN 'channel' ELSE 'chat' END AS from_peer_type,
             CASE WHEN to_id < -1000000000000 THEN 'channel' ELSE 'chat' END AS to_peer_type,
             last_name AS last_from_name, n AS forward_count, first_seen AS first_seen_at, last_seen AS last_seen_at FROM edges"""
    ),
    "i7_merge_edges": q(
        """SELECT from_id AS from_external_id, to_id AS to_external_id,
             CASE WHEN from_id < -1000000000000 THEN 'channel' ELSE 'chat' END AS from_peer_type,
             CASE WHEN to_id < -1000000000000 THEN 'channel' ELSE 'chat' END AS to_peer_type,
             last_name AS last_from_name, n AS forward_count, first_seen AS first_seen_at, last_seen AS last_seen_at FROM edges"""
    ),
    "i7_recount_edges": q(
        """SELECT from_id AS from_external_id, to_id AS to_external_id,
             CASE WHEN from_id IN (SELECT peer_external_id FROM fetch_cov) THEN n ELSE 2 * n END AS forward_count FROM edges"""
    ),
    "i8_merge_links": q(
        """SELECT phash, message_id, CASE WHEN message_id % 2 = 0 THEN message_date + INTERVAL 1 DAY ELSE message_date END AS message_date,
             peer_external_id, CASE WHEN message_id % 2 = 0 AND message_id % 4 > 0 THEN telegram_message_id
               WHEN message_id % 5 <> 0 AND message_id % 3 > 0 THEN telegram_message_id END AS telegram_message_id
           FROM links WHERE message_id % 2 = 0 OR message_id % 5 <> 0"""
    ),
    "i8_image_links": q("SELECT phash, message_id, message_date, peer_external_id, telegram_message_id FROM links"),
    "i9_image_blobs": q(
        """SELECT phash, canonical_path, refcount FROM (
             SELECT nhash AS phash, arg_min(mpath, date) FILTER (WHERE mpath IS NOT NULL) AS canonical_path
             FROM pm WHERE nhash <> '0000000000000000' GROUP BY 1) JOIN link_counts USING (phash)"""
    ),
    "i10_merge_text_embeddings": q(
        """, fresh AS (SELECT vec_id * 2 + 1 AS message_id, 't2' AS model_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
           SELECT message_id, model_id, CAST(len(v) AS BIGINT) AS dim, round(v[1], 6) AS x0 FROM (
             SELECT * FROM fresh UNION ALL SELECT * FROM text_embeddings WHERE message_id NOT IN (SELECT message_id FROM fresh))"""
    ),
    "i10_text_embedded_flags": q(
        "SELECT id, text_embedded OR id IN (SELECT vec_id * 2 + 1 FROM embeddings) AS text_embedded FROM messages"
    ),
    "i10_merge_image_embeddings": q(
        "SELECT phash, CASE model_id WHEN 'm1' THEN 'm2' ELSE model_id END AS model_id, CAST(len(v) AS BIGINT) AS dim FROM image_embeddings"
    ),
    "i10_blob_flags": q(
        """SELECT phash, image_embedded OR phash IN (SELECT phash FROM image_embeddings WHERE model_id = 'm1') AS image_embedded FROM blobs"""
    ),
    "i10_image_embedded_flags": q(
        """SELECT id, image_embedded OR id IN (SELECT message_id FROM links WHERE phash IN
             (SELECT phash FROM image_embeddings WHERE model_id = 'm1')) AS image_embedded FROM messages"""
    ),
    "i11_reset_text": q(
        """SELECT peer_external_id, CAST(0 AS BIGINT) AS text_embedded, text_total, CAST(0 AS BIGINT) AS flagged FROM peer_counts"""
    ),
    "i11_reset_images": q(
        """, able AS (SELECT phash FROM blobs WHERE trim(canonical_path) <> '' UNION SELECT phash FROM image_cache)
           SELECT peer_external_id, coalesce(n, 0) AS image_embeddable, CAST(0 AS BIGINT) AS image_embedded_unique, image_unique
           FROM peer_counts LEFT JOIN (SELECT peer_external_id, count(DISTINCT phash) AS n FROM links
             WHERE phash IN (SELECT phash FROM able) GROUP BY 1) USING (peer_external_id)"""
    ),
    "i12_mark_downloaded": q(
        """, hit AS (SELECT DISTINCT message_id FROM links WHERE phash IN (SELECT phash FROM blobs WHERE trim(canonical_path) <> ''))
           SELECT id, CASE WHEN message_id IS NOT NULL THEN 'false' ELSE json_extract_string(media, '$.downloaded') END AS downloaded,
             CASE WHEN message_id IS NOT NULL THEN 'gone/x' ELSE mpath END AS path, mkind AS kind
           FROM pm LEFT JOIN hit ON message_id = id"""
    ),
    "i12_download_flips": q(
        """SELECT peer_external_id, count(*) AS flipped FROM pm WHERE downloaded AND id IN
             (SELECT message_id FROM links WHERE phash IN (SELECT phash FROM blobs WHERE trim(canonical_path) <> '')) GROUP BY 1"""
    ),
    "i13_reclassify_media": q("SELECT id, coalesce(media_kind, mkind) AS kind, tl FROM pm"),
    "i14_purge_probe_only": """WITH o AS (
             SELECT -(1000000000000 + o_custkey * 10 + month(o_orderdate) % 10) AS peer_external_id,
               o_orderkey AS telegram_message_id, o_orderstatus AS status FROM orders),
           lone AS (SELECT peer_external_id FROM o GROUP BY 1 HAVING count(*) = 1 AND max(status) <> 'P')
           SELECT * FROM o WHERE peer_external_id NOT IN (SELECT peer_external_id FROM lone)""",
    "i15_classify_media": """WITH r AS (
             SELECT event_id, event_id % 8 AS t, event_id % 24 <> 2 AS has_doc,
               CASE event_id % 5 WHEN 0 THEN 'image/webp' WHEN 1 THEN ' Audio/OGG' WHEN 2 THEN '' WHEN 3 THEN 'application/zip' END AS mime,
               CASE event_id % 6 WHEN 0 THEN 'a.MKV' WHEN 1 THEN 'b.flac' WHEN 2 THEN NULL ELSE 'dir.gif/x' END AS fname
             FROM events),
           d AS (SELECT *, t BETWEEN 2 AND 6 AND has_doc AS doc, lower(trim(mime)) AS m FROM r)
           SELECT event_id AS id,
             CASE WHEN t = 7 THEN NULL WHEN t = 0 THEN 'MessageMediaPhoto' WHEN t = 1 THEN 'MessageMediaWebPage' ELSE 'MessageMediaDocument' END AS m_tl,
             CASE WHEN t = 0 THEN 'image' WHEN NOT doc THEN NULL
               WHEN t = 2 THEN CASE WHEN m = 'image/webp' THEN 'image' END
               WHEN t = 3 THEN 'gif' WHEN m = 'audio/ogg' THEN 'audio' WHEN t = 4 THEN 'video' WHEN t = 5 OR m = 'image/webp' THEN 'image'
               WHEN fname = 'a.MKV' THEN 'video' WHEN fname = 'b.flac' THEN 'audio' ELSE 'document' END AS m_kind,
             CASE WHEN t <> 7 THEN 'false' END AS m_downloaded,
             CASE WHEN doc THEN CAST(event_id * 3 AS VARCHAR) END AS m_size_bytes,
             CASE WHEN doc THEN CAST(event_id AS VARCHAR) END AS m_document_id,
             CASE WHEN doc THEN nullif(mime, '') END AS m_mime_type,
             CASE WHEN doc AND t IN (4, 5) THEN '7' END AS m_duration,
             CASE WHEN doc AND t IN (4, 5) AND event_id % 3 > 0 THEN CAST(event_id % 3 * 100 AS VARCHAR) END AS m_width,
             CASE WHEN doc AND t IN (4, 5) THEN '50' END AS m_height,
             CASE WHEN doc THEN fname END AS m_file_name, CAST(NULL AS VARCHAR) AS m_phash, CAST(NULL AS VARCHAR) AS m_path
           FROM d""",
    "i16_flatten_profile": """WITH c AS (SELECT *, c_custkey AS k FROM customer)
           SELECT k AS c_custkey,
             CASE WHEN k % 3 = 0 THEN c_name WHEN k % 4 <> 0 AND k % 5 = 0 THEN 'Ann Lee' WHEN k % 4 <> 0 THEN 'Ann' WHEN k % 5 = 0 THEN 'Lee' END AS title,
             CASE WHEN k % 4 <> 0 THEN 'Ann' END AS first_name, CASE WHEN k % 5 = 0 THEN 'Lee' END AS last_name,
             CASE WHEN k % 2 = 0 THEN '@n' || k END AS username,
             CASE WHEN k % 2 = 0 THEN 'N' || k || ';x' || k ELSE 'x' || k || ';N' || k END AS handles,
             true AS first_active, k % 2 = 0 AS verified,
             CASE WHEN k % 4 - 1 > 0 THEN -(1000000000000 + k % 4 - 1) END AS linked_monoforum_id,
             CASE WHEN k % 6 = 0 THEN 99 ELSE k END AS participants_count, c_mktsegment AS about,
             CASE WHEN k % 2 = 1 THEN -(1000000000000 + k + 5) END AS linked_chat_id,
             CASE WHEN k % 3 > 0 THEN -(k % 3) END AS migrated_from_chat_id, CAST(c_nationkey AS BIGINT) AS slowmode_seconds,
             CASE WHEN k % 7 = 0 THEN 'here' END AS location_address, CASE WHEN k % 7 = 0 THEN c_acctbal END AS location_lat,
             CASE WHEN k % 7 = 0 THEN CAST(1.5 AS DOUBLE) END AS location_lng, CAST(NULL AS BOOLEAN) AS premium
           FROM c""",
    "k1_write_csv": q(
        """SELECT CAST(external_id AS VARCHAR) AS external_id, peer_type, title,
             CASE WHEN handles IS NOT NULL THEN '[{"username":"' || handles[1] || '","active":false,"editable":true},{"username":"'
               || handles[2] || '","editable":false},{"username":"' || handles[3] || '","active":true}]' END AS usernames,
             CAST(verified AS VARCHAR) AS verified, strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at,
             CAST(location_lat AS VARCHAR) AS location_lat FROM peers"""
    ),
    "k2_write_json": q(
        """SELECT external_id, title, handles[1] AS handle, strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at, verified FROM peers"""
    ),
    "k3_write_partitioned": q("SELECT peer_type, count(*) AS peers, min(external_id) AS lowest FROM peers GROUP BY 1"),
    # ---- column rules
    "f1_media_kind": q("SELECT id, media_kind AS kind FROM pm"),
    "f1_media_kind_by_hints": q(
        """SELECT id, CASE WHEN mkind IN ('image', 'gif', 'video', 'audio') THEN mkind WHEN mime = 'image/png' THEN 'image' WHEN mime = 'image/gif' THEN 'gif'
             WHEN fname = 'clip.MOV' THEN 'video' WHEN tl = 'MessageMediaDocument' THEN 'document' WHEN tl = 'MessageMediaPhoto' THEN 'image' END AS kind FROM pm"""
    ),
    "f2_kind_from_hints": """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'audio' WHEN event_id % 4 = 2 THEN 'video'
             WHEN event_id % 3 = 0 THEN 'image' ELSE 'document' END AS kind FROM events""",
    "f3_signed_ids": q(
        """SELECT external_id, CASE WHEN peer_type IN ('channel', 'megagroup') THEN 'channel' WHEN peer_type = 'chat' THEN 'chat' ELSE 'user' END AS inferred,
             peer_type IN ('channel', 'megagroup', 'chat') AS target,
             CASE WHEN peer_type IN ('channel', 'megagroup') THEN c_custkey + 1 END AS raw,
             CASE WHEN peer_type IN ('channel', 'megagroup') THEN external_id END AS again FROM peers"""
    ),
    "f4_fwd_origin": q("SELECT id, origin_peer AS origin FROM pm"),
    "f5_fwd_origin_msg": q("SELECT id, origin_mid FROM pm"),
    "f6_fwd_name": q("SELECT id, fwd_name AS name FROM pm"),
    "f7_phash": q("SELECT id, nhash AS phash, coalesce(nhash <> '0000000000000000', false) AS usable FROM pm"),
    "f8_excerpt": q("SELECT id, nullif(trim(content[1:80]), '') AS excerpt FROM messages"),
    "f9_has_text": q("SELECT id, has_text FROM pm"),
    "f10_guarded_numbers": q(
        """SELECT id, TRY_CAST(msize AS BIGINT) AS size, TRY_CAST(mduration AS DOUBLE) AS duration,
             CAST(NULL AS BIGINT) AS whole, CAST(NULL AS BIGINT) AS none FROM pm"""
    ),
    "f11_is_downloaded": q("SELECT id, downloaded FROM pm"),
    "f12_media_item_id": q(
        """SELECT id, item_id AS item, CASE WHEN docid IS NULL THEN 'message' ELSE 'document' END AS kind,
             coalesce(docid, CAST(id AS VARCHAR)) AS ident FROM pm"""
    ),
    "f13_format_bytes": """WITH s AS (SELECT doc_id, CAST(pow(1 + n_chars % 1500, 1 + doc_id % 4) AS BIGINT) AS b FROM documents),
           u AS (SELECT doc_id, b, CASE WHEN b < 1024 THEN 0 WHEN b < 1024^2 THEN 1 WHEN b < 1024^3 THEN 2 WHEN b < 1024^4 THEN 3 ELSE 4 END AS e FROM s),
           v AS (SELECT *, b / pow(1024, e) AS x, ['B', 'KB', 'MB', 'GB', 'TB'][e + 1] AS unit FROM u)
           SELECT doc_id, CASE WHEN e = 0 THEN b || ' B' WHEN x >= 10 THEN printf('%.0f', x) || ' ' || unit
             ELSE regexp_replace(printf('%.1f', x), '\\.0$', '') || ' ' || unit END AS label FROM v""",
    "f14_coverage_ratio": q(
        """SELECT peer_external_id, CASE WHEN first_message_at IS NULL THEN 0 ELSE
             round(greatest(0, least(1, epoch(TIMESTAMP '2024-02-15 00:00:00' - covered_before) / epoch(TIMESTAMP '2024-02-15 00:00:00' - first_message_at))), 4) END AS fill
           FROM spans JOIN peers ON external_id = peer_external_id"""
    ),
    "f15_timeline_segment": q(
        """, x AS (SELECT external_id, CAST(epoch_ms(first_message_at) AS DOUBLE) AS s, CAST(epoch_ms(TIMESTAMP '2024-01-25 00:00:00') AS DOUBLE) AS e,
               CAST(epoch_ms(covered_after) AS DOUBLE) AS ca, CAST(epoch_ms(covered_before) AS DOUBLE) AS cb
             FROM peers LEFT JOIN fetch_cov ON peer_external_id = external_id),
           y AS (SELECT *, least(e, greatest(s, ca)) AS lo FROM x),
           z AS (SELECT *, least(e, greatest(lo, cb)) AS hi FROM y)
           SELECT external_id, CASE WHEN s IS NULL OR ca IS NULL OR e <= s THEN 75.0::DOUBLE ELSE round((lo - s) / (e - s) * 100, 6) END AS "left",
             CASE WHEN s IS NULL OR ca IS NULL OR e <= s THEN 25.0::DOUBLE ELSE round((hi - s) / (e - s) * 100 - (lo - s) / (e - s) * 100, 6) END AS width FROM z"""
    ),
    "f16_peer_label": q(
        """SELECT external_id, coalesce(title, '@' || username, about) AS label,
             CASE WHEN peer_type IN ('user', 'bot') THEN coalesce('@' || username, CAST(external_id AS VARCHAR))
                  ELSE coalesce(title, '@' || username, CAST(external_id AS VARCHAR)) END AS entity,
             CASE peer_type WHEN 'chat' THEN coalesce('Shared · ' || title, 'Shared image') WHEN 'bot' THEN strftime(created_at, '%Y-%m-%d')
                  ELSE coalesce(title, '@' || username, CAST(external_id AS VARCHAR)) END AS node FROM peers"""
    ),
    "f17_usernames": q(
        """SELECT external_id, usernames_csv AS csv,
             CASE WHEN handles IS NOT NULL THEN 'U' || c_custkey || ',alt' || c_custkey ELSE coalesce(username, '') END AS handles,
             CASE WHEN username IS NOT NULL THEN true END AS first_active FROM peers"""
    ),
    "f18_restriction_reason": q("SELECT external_id, restriction_csv AS reasons FROM peers"),
    "f19_unit_vector": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
           n AS (SELECT *, sqrt(list_inner_product(v, v)) AS len FROM e)
           SELECT vec_id, round(v[1] / len, 6) AS x0, CAST(1 AS DOUBLE) AS norm, round(v[2] / len, 6) AS x1, true AS zero_rejected FROM n""",
    "f20_dot": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
           s AS (SELECT label, arg_max(v, vec_id) AS o FROM e GROUP BY 1)
           SELECT vec_id, round(list_inner_product(v, o), 6) AS dot FROM e JOIN s USING (label)""",
    "f22_mix": q("SELECT peer_external_id, round(posts / (posts + 2.0 + 0.15 * image_unique), 6) AS mix FROM peer_counts"),
    "f23_forward_score": q(
        """SELECT peer_external_id, round(posts / (posts + 2.0 + 0.15 * image_unique) + 0.05 * ln(1 + greatest(total_forwards - 5, 0)), 6) AS score FROM peer_counts"""
    ),
    "f25_media_preview": q(
        """SELECT id, media_kind AS kind, CASE WHEN media_kind IS NOT NULL THEN trim(mphash) END AS phash,
             CASE WHEN media_kind IS NOT NULL THEN TRY_CAST(msize AS BIGINT) END AS size_bytes,
             CASE WHEN msize IS NULL THEN NULL WHEN CAST(msize AS BIGINT) < 1024 THEN msize || ' B'
               WHEN CAST(msize AS BIGINT) < 10240 THEN regexp_replace(printf('%.1f', CAST(msize AS DOUBLE) / 1024), '\\.0$', '') || ' KB'
               ELSE printf('%.0f', CAST(msize AS DOUBLE) / 1024) || ' KB' END AS size_label,
             CASE WHEN media_kind IS NOT NULL THEN json_extract_string(media, '$.mime_type') END AS mime_type, fname AS file_name,
             TRY_CAST(mduration AS DOUBLE) AS duration, TRY_CAST(mwidth AS BIGINT) AS width, TRY_CAST(mheight AS BIGINT) AS height FROM pm"""
    ),
    "f30_in_range": q("SELECT id, date FROM messages WHERE date >= TIMESTAMP '2024-01-10' AND date <= TIMESTAMP '2024-01-12 23:59:59.999'"),
    # ---- filters
    "p1_message_scope": q(
        """SELECT id FROM pm WHERE (peer_external_id = -1000000000001 OR o1 = -1000000000001 OR o2 = -1000000000001)
             AND date >= TIMESTAMP '2024-01-08' AND date <= TIMESTAMP '2024-01-20 23:59:59.999'
             AND (media_kind IS NULL OR media_kind IN ('image', 'video'))"""
    ),
    "p1_indexed_scope": q(
        """SELECT id FROM pm WHERE -1000000000001 IN (peer_external_id, coalesce(o1, 0), coalesce(o2, 0))
             AND date BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20 23:59:59.999' AND coalesce(media_kind, 'none') IN ('none', 'image', 'video')"""
    ),
    "p1_indexed_scopes": q(
        """SELECT external_id, count(*) AS messages, count(*) FILTER (media_kind = 'image') AS images,
             count(*) FILTER (peer_external_id <> external_id) AS forwarded, min(date) AS first_date, max(date) AS last_date
           FROM (SELECT DISTINCT id, peer_external_id, media_kind, date, unnest([peer_external_id, o1, o2]) AS external_id FROM pm)
             JOIN peers USING (external_id)
           WHERE date BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20 23:59:59.999' GROUP BY 1"""
    ),
    "p1_indexed_messages": q(
        """SELECT id, telegram_message_id, md5(content) AS content_md5 FROM pm
           WHERE -1000000000001 IN (peer_external_id, coalesce(o1, 0), coalesce(o2, 0))
             AND date BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20 23:59:59.999'"""
    ),
    "p1_message_scope_media": q("SELECT id FROM pm WHERE media_kind IN ('gif', 'document')"),
    "p2_origin_matches": q("SELECT id FROM pm WHERE o1 = -1000000000002 OR o2 = -1000000000002"),
    "p3_link_scope": q(
        "SELECT phash, message_id FROM links WHERE message_date >= TIMESTAMP '2024-01-08' AND message_date <= TIMESTAMP '2024-01-20 23:59:59.999'"
    ),
    "p4_export_scope": q(
        """SELECT id FROM pm WHERE date >= TIMESTAMP '2024-01-08' AND date <= TIMESTAMP '2024-01-20 23:59:59.999' AND has_text AND mkind IS NOT NULL"""
    ),
    "p5_peer_matches": q(
        "SELECT external_id FROM peers WHERE title ILIKE '%u12%' OR username ILIKE '%u12%' OR peer_type LIKE '%u12%' OR CAST(external_id AS VARCHAR) LIKE '%u12%'"
    ),
    "p5_indexed_matches": q(
        """SELECT DISTINCT needle, external_id FROM (SELECT needle, ltrim(lower(trim(needle)), '@') AS part FROM needles)
             JOIN peers ON contains(lower(concat_ws(chr(0), title, username, peer_type, external_id)), part)""",
        """needles AS (
  SELECT DISTINCT needle FROM (
    SELECT unnest([right(title, 3), '@' || upper(username), right(CAST(external_id AS VARCHAR), 2), substr(title, 3, 9), substr(peer_type, 2, 4),
                   title || '?', ' ' || left(username, 1)]) AS needle
    FROM peers WHERE abs(external_id) % 50 = 1)
  WHERE needle IS NOT NULL)""",
    ),
    "p6_resolve_peer_id": q("SELECT external_id, username FROM peers WHERE external_id = -1000000000001"),
    "p6_resolve_peer_handle": q("SELECT external_id, username FROM peers WHERE handles[1] = 'alt41'"),
    "p7_has_pixels": q(
        """SELECT phash FROM blobs WHERE (trim(canonical_path) <> '' AND canonical_path NOT LIKE '%://%') OR phash IN (SELECT phash FROM image_cache)"""
    ),
}


# whole headers as maps of JSON values, the deliveries applied one after the other
def _step(old: str, new: str) -> str:
    kind = "CASE WHEN list_contains(map_keys({0}), 'kind') THEN MAP {{'kind': {0}['kind']}} ELSE MAP {{}}::MAP(VARCHAR, JSON) END"
    whole = f"coalesce({old}, MAP {{}}::MAP(VARCHAR, JSON))", f"coalesce({new}, MAP {{}}::MAP(VARCHAR, JSON))"
    known = f"list_contains(map_keys({whole[0]}), 'kind') OR list_contains(map_keys({whole[1]}), 'kind')"
    return f"CASE WHEN {known} THEN map_concat({whole[1]}, {whole[0]}, {kind.format(whole[1])}) END"


WHOLE = DELTA + """,
w0 AS (
  SELECT peer_external_id, telegram_message_id, fwd_from, CAST(CAST(left(media, length(media) - 1) || ',"views":' || telegram_message_id % 7 ||
    CASE WHEN telegram_message_id % 5 = 0 THEN ',"note":null' ELSE '' END ||
    CASE WHEN telegram_message_id % 4 = 0 THEN ',"extra":{"a":[1,' || telegram_message_id || ']}' ELSE '' END || '}' AS JSON) AS MAP(VARCHAR, JSON)) AS w
  FROM messages
),
w1 AS (
  SELECT peer_external_id, telegram_message_id, coalesce(d.fwd_from, m.fwd_from) AS fwd_from,
    CASE WHEN m.peer_external_id IS NULL THEN n WHEN d.peer_external_id IS NULL THEN w ELSE """ + _step("w", "n") + """ END AS w, d.peer_external_id IS NOT NULL AS again
  FROM w0 m FULL JOIN (
    SELECT *, CAST(CAST(left(media, length(media) - 1) || ',"views":100,"note":"n"}' AS JSON) AS MAP(VARCHAR, JSON)) AS n FROM delta
  ) d USING (peer_external_id, telegram_message_id)
),
w2 AS (
  SELECT peer_external_id, telegram_message_id, fwd_from, CASE WHEN again AND telegram_message_id % 2 = 0 THEN """ + _step("w", "n") + """ ELSE w END AS w
  FROM (SELECT *, CAST(CAST(CASE WHEN telegram_message_id % 4 = 0 THEN '{"kind":null,"late":true}'
                                 WHEN telegram_message_id % 3 > 0 THEN '{"kind":"gif","views":-1}' END AS JSON) AS MAP(VARCHAR, JSON)) AS n FROM w1)
)"""
ORACLES |= {
    "i1_whole_headers": q(
        """SELECT peer_external_id, telegram_message_id, e.key AS key, e.value IS NULL OR e.value = 'null' AS is_null, e.value ->> '$' AS value
           FROM (SELECT peer_external_id, telegram_message_id, unnest(map_entries(w)) AS e FROM w2)
           UNION ALL SELECT peer_external_id, telegram_message_id, NULL, false, NULL FROM w2 WHERE w IS NULL""",
        WHOLE,
    ),
    "i1_whole_headers_typed": q(
        """SELECT peer_external_id, telegram_message_id, w['kind'] ->> '$' AS kind, w['mime_type'] ->> '$' AS mime_type, w['size_bytes'] ->> '$' AS size_bytes,
             json_extract_string(fwd_from, '$.from_name') AS from_name FROM w2""",
        WHOLE,
    ),
}


# the full recount of what the later delivery leaves
LEFT = DELTA + ",\nkept AS (" + _merged_rows() + """),
kept_hints AS (
  SELECT k.*, [
    if(m_kind <> 'document' AND list_contains(['image', 'gif', 'video', 'audio'], m_kind), m_kind, NULL),
    if(lower(m_mime_type) = 'image/gif', 'gif', if(regexp_matches(lower(m_mime_type), '^(video|audio)/|^image/') AND NOT regexp_matches(lower(m_mime_type), '^image/.*(svg|dwg)'), split_part(lower(m_mime_type), '/', 1), NULL)),
    s.kind, if(m_kind = 'document', m_kind, NULL), MAP {'MessageMediaPhoto': 'image', 'MessageMediaDocument': 'document'}[m_tl]
  ] AS hints
  FROM kept k LEFT JOIN suffix_kinds s ON s.suffix = lower(split_part(m_file_name, '.', -1)) AND contains(m_file_name, '.')
),
kept_facts AS (
  SELECT *, list_filter(hints, lambda h: h IS NOT NULL)[1] AS media_kind, coalesce(m_downloaded IN ('true', 't', '1'), false) AS done,
    coalesce(trim(m_phash) <> '', false) AS hashed, coalesce(content_md5 NOT IN (md5('   '), md5('')), false) AS has_text
  FROM kept_hints
)"""
_KINDS = ("image", "video", "audio", "gif", "document")
_TESTS = {k: f"media_kind = '{k}' AND done" for k in _KINDS} | {
    "image": "media_kind = 'image' AND hashed", "text_embed": "has_text AND text_embedded", "image_embed": "media_kind = 'image' AND image_embedded",
}
ORACLES |= {
    "a1_monthly_partials": q(
        "SELECT peer_external_id, count(*) AS posts, count(*) FILTER (has_text) AS text_total, count(*) FILTER (has_text AND text_embedded) AS text_embedded, "
        + "count(*) FILTER (media_kind = 'image' AND hashed) AS image_hashed, "
        + ", ".join(f"count(*) FILTER (media_kind = '{k}') AS {k}_total, count(*) FILTER (media_kind = '{k}' AND done) AS {k}_downloaded" for k in _KINDS)
        + ", min(date) AS covered_after, max(date) AS covered_before, "
        + ", ".join(f"min(date) FILTER ({t}) AS {k}_after, max(date) FILTER ({t}) AS {k}_before" for k, t in _TESTS.items())
        + " FROM kept_facts GROUP BY 1",
        LEFT,
    ),
    "p1_indexed_scopes_after_write_back": q(
        # headers of the delivery name nobody
        """SELECT external_id, count(*) AS messages, CAST(sum(id) AS BIGINT) AS ids FROM (
             SELECT DISTINCT coalesce(m.id, d.id) AS id,
               unnest([peer_external_id, CASE WHEN d.fwd_from IS NULL THEN o1 END, CASE WHEN d.fwd_from IS NULL THEN o2 END]) AS external_id
             FROM pm m FULL JOIN delta d USING (peer_external_id, telegram_message_id))
           JOIN peers USING (external_id) GROUP BY 1""",
        DELTA,
    ),
    "a8_monthly_partials": q(
        """SELECT lower(trim(m_phash)) AS phash, count(*) AS appearances, count(DISTINCT peer_external_id) AS unique_peers, max(date) AS last_seen_at
           FROM kept WHERE regexp_full_match(lower(trim(m_phash)), '[0-9a-f]{16}') AND lower(trim(m_phash)) <> '0000000000000000' GROUP BY 1""",
        LEFT,
    ),
}
