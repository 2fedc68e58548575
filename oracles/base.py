"""Shared WITH list: the derived archive, written in DuckDB SQL over the given tables.

Nested columns stay JSON text here and are read with DuckDB's JSON functions, so that the parsing of the library is
checked by other means.
"""

PEER = """CASE WHEN {k} % 10 = 9 THEN {k} + 1 WHEN {k} % 10 = 8 THEN -({k} + 1)
               ELSE -(1000000000000 + {k} + 1) END"""

KIND_COUNTS = [f"{kind}_{what}" for kind in ("image", "video", "audio", "gif", "document") for what in ("total", "downloaded")]
ALL_COUNTS = [
    "posts", "text_total", "text_embedded", "image_hashed", "image_unique", "image_persisted", "image_embeddable", "image_embedded_unique",
    "unique_forwards", "total_forwards", *KIND_COUNTS,
]

ARCHIVE = (
    """WITH
n_docs AS (SELECT count(*) AS n FROM documents),
base AS (
  SELECT e.event_id, e.user_id, e.ts, d.doc_id, d.text, substring(md5(d.text), 1, 16) AS phash,
         e.user_id + 1 + e.event_id % 3 AS okey
  FROM events e, n_docs JOIN documents d ON d.doc_id = e.event_id % n
),
first_events AS (SELECT user_id, min(event_id) + 1 AS fm, min(ts) AS ft FROM events GROUP BY 1),
peers AS (
  SELECT """
    + PEER.format(k="c_custkey")
    + """ AS external_id,
    c_custkey,
    CASE WHEN c_custkey % 20 = 19 THEN 'bot' WHEN c_custkey % 10 = 9 THEN 'user' WHEN c_custkey % 10 = 8 THEN 'chat'
         WHEN c_custkey % 3 = 0 THEN 'megagroup' ELSE 'channel' END AS peer_type,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS title,
    CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'u' || c_custkey END AS username,
    CASE WHEN c_custkey % 4 = 1 THEN ['alt' || c_custkey, 'U' || c_custkey, '@ALT' || c_custkey] END AS handles,
    CASE WHEN c_custkey % 4 = 1 THEN 'alt' || c_custkey || ';U' || c_custkey ELSE '' END AS usernames_csv,
    CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment END AS about,
    CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS INTEGER) END AS participants_count,
    CASE WHEN c_custkey % 5 <> 4 THEN c_custkey % 2 = 0 END AS verified,
    CASE WHEN c_custkey % 9 = 0 THEN 'ios:porn: blocked; terms' ELSE '' END AS restriction_csv,
    CASE WHEN c_custkey % 25 = 0 THEN c_acctbal END AS location_lat,
    CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 ELSE 0 END AS messages_scraped,
    c_custkey % 97 = 5 AS is_scraping,
    CAST('2024-02-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || ' 00:00:00' AS TIMESTAMP) AS created_at,
    CAST('2024-03-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || ' 00:00:00' AS TIMESTAMP) AS updated_at,
    CASE WHEN c_custkey % 4 <> 3 THEN fm END AS first_message_id,
    CASE WHEN c_custkey % 4 = 0 THEN ft END AS first_message_at,
    CAST(c_custkey % 11 AS DOUBLE) / 10 AS scope_score,
    CAST(c_custkey % 101 AS DOUBLE) / 100 AS forward_score
  FROM customer LEFT JOIN first_events ON user_id = c_custkey
),
messages AS (
  SELECT event_id AS id, """
    + PEER.format(k="user_id")
    + """ AS peer_external_id, event_id + 1 AS telegram_message_id, ts AS date,
    CASE WHEN event_id % 13 = 0 THEN '   ' WHEN event_id % 17 = 0 THEN NULL ELSE text END AS content,
    CASE WHEN user_id % 4 = 0 THEN user_id + 1 END AS from_external_id,
    CASE WHEN event_id % 3 = 2 THEN NULL ELSE
      '{"' || CASE WHEN event_id % 2 = 0 THEN 'from_id' ELSE 'saved_from_peer' END || '":{"_":"' ||
      CASE WHEN okey % 10 = 9 THEN 'PeerUser","user_id":' WHEN okey % 10 = 8 THEN 'PeerChat","chat_id":'
           ELSE 'PeerChannel","channel_id":' END || CAST(okey + 1 AS VARCHAR) || '}' ||
      CASE WHEN event_id % 38 = 1 THEN ',"from_id":{"tl":"PeerUser","user_id":"' || CAST(okey + 7 AS VARCHAR) || '"}'
           ELSE '' END ||
      CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ',"saved_from_msg_id":' || CAST(event_id % 23 AS VARCHAR)
           ELSE ',"channel_post":' || CAST(event_id % 23 + 1 AS VARCHAR) END ||
      CASE WHEN event_id % 5 = 0 THEN ',"from_name":" N' || CAST(okey AS VARCHAR) || ' "' ELSE '' END || '}'
    END AS fwd_from,
    CASE event_id % 11
      WHEN 0 THEN '{"tl":"MessageMediaPhoto","kind":"image","phash":"' || phash || '","downloaded":true}'
      WHEN 1 THEN '{"tl":"MessageMediaDocument","kind":"document","mime_type":"image/png","file_name":"a.PNG"}'
      WHEN 2 THEN '{"tl":"MessageMediaDocument","kind":"document","mime_type":"application/octet-stream","file_name":"clip.MOV","document_id":"' || CAST(event_id % 50 AS VARCHAR) || '","size_bytes":' || CAST(event_id AS VARCHAR) || ',"downloaded":true,"path":"v/' || CAST(event_id % 50 AS VARCHAR) || '"}'
      WHEN 3 THEN '{"tl":"MessageMediaDocument","kind":"video","mime_type":"video/mp4","duration":12.5,"width":640,"height":480,"downloaded":false}'
      WHEN 4 THEN '{"tl":"MessageMediaDocument","mime_type":"image/gif"}'
      WHEN 5 THEN '{"tl":"MessageMediaDocument","kind":"audio","mime_type":"audio/ogg"}'
      WHEN 6 THEN '{"tl":"MessageMediaDocument","kind":"document","mime_type":"application/pdf","file_name":"n.pdf","document_id":"' || CAST(event_id % 30 AS VARCHAR) || '"}'
      WHEN 7 THEN '{"tl":"MessageMediaWebPage"}'
      WHEN 8 THEN '{"tl":"MessageMediaPhoto","phash":" ' || CASE WHEN event_id % 4 = 0 THEN '0000000000000000' ELSE upper(phash) END || ' ","downloaded":"t"}'
      WHEN 9 THEN '{"tl":"MessageMediaPhoto","kind":"image","phash":"' || phash || '","downloaded":"1","path":"blobs/' || CAST(doc_id AS VARCHAR) || '"}'
    END AS media,
    event_id % 2 = 0 AS text_embedded, event_id % 4 = 0 AS image_embedded
  FROM base
),
mj AS (
  SELECT *, json_extract_string(media, '$.kind') AS mkind, lower(json_extract_string(media, '$.mime_type')) AS mime,
    json_extract_string(media, '$.file_name') AS fname, json_extract_string(media, '$.tl') AS tl,
    json_extract_string(media, '$.phash') AS mphash, json_extract_string(media, '$.path') AS mpath,
    json_extract_string(media, '$.document_id') AS docid, json_extract_string(media, '$.size_bytes') AS msize,
    json_extract_string(media, '$.duration') AS mduration, json_extract_string(media, '$.width') AS mwidth,
    json_extract_string(media, '$.height') AS mheight,
    coalesce(json_extract_string(media, '$.downloaded') IN ('true', 't', '1'), false) AS downloaded,
    coalesce(nullif(json_extract_string(fwd_from, '$.from_id._'), ''), json_extract_string(fwd_from, '$.from_id.tl')) AS tag1,
    coalesce(nullif(json_extract_string(fwd_from, '$.saved_from_peer._'), ''), json_extract_string(fwd_from, '$.saved_from_peer.tl')) AS tag2
  FROM messages
),
fwd_ids AS (
  SELECT *,
    CASE tag1 WHEN 'PeerChannel' THEN -(1000000000000 + CAST(json_extract_string(fwd_from, '$.from_id.channel_id') AS BIGINT))
              WHEN 'PeerChat' THEN -CAST(json_extract_string(fwd_from, '$.from_id.chat_id') AS BIGINT)
              WHEN 'PeerUser' THEN CAST(json_extract_string(fwd_from, '$.from_id.user_id') AS BIGINT) END AS o1,
    CASE tag2 WHEN 'PeerChannel' THEN -(1000000000000 + CAST(json_extract_string(fwd_from, '$.saved_from_peer.channel_id') AS BIGINT))
              WHEN 'PeerChat' THEN -CAST(json_extract_string(fwd_from, '$.saved_from_peer.chat_id') AS BIGINT)
              WHEN 'PeerUser' THEN CAST(json_extract_string(fwd_from, '$.saved_from_peer.user_id') AS BIGINT) END AS o2,
    CAST(json_extract_string(fwd_from, '$.channel_post') AS BIGINT) AS post,
    CAST(json_extract_string(fwd_from, '$.saved_from_msg_id') AS BIGINT) AS saved_id
  FROM mj
),
suffix_kinds AS (
  SELECT unnest(string_split(suffixes, ' ')) AS suffix, kind FROM (VALUES
    ('gif', 'gif'), ('image', 'jpg jpeg png webp bmp tif tiff heic heif avif jfif'),
    ('video', 'mp4 m4v mov mkv webm avi 3gp mpeg mpg'), ('audio', 'mp3 m4a ogg oga flac wav opus aac')) t(kind, suffixes)
),
kind_hints AS (
  -- what each part of the record says of the kind, in the order in which it is believed
  SELECT f.*, [
    if(mkind <> 'document' AND list_contains(['image', 'gif', 'video', 'audio'], mkind), mkind, NULL),
    if(mime = 'image/gif', 'gif', if(regexp_matches(mime, '^(video|audio)/|^image/') AND NOT regexp_matches(mime, '^image/.*(svg|dwg)'), split_part(mime, '/', 1), NULL)),
    s.kind,
    if(mkind = 'document', mkind, NULL),
    MAP {'MessageMediaPhoto': 'image', 'MessageMediaDocument': 'document'}[tl]
  ] AS hints
  FROM fwd_ids f LEFT JOIN suffix_kinds s ON s.suffix = lower(split_part(fname, '.', -1)) AND contains(fname, '.')
),
pm AS (
  SELECT * EXCLUDE (hints), list_filter(hints, lambda h: h IS NOT NULL)[1] AS media_kind,
    coalesce(o1, o2) AS origin_peer,
    CASE WHEN post > 0 THEN post WHEN saved_id > 0 THEN saved_id END AS origin_mid,
    nullif(trim(json_extract_string(fwd_from, '$.from_name')), '') AS fwd_name,
    coalesce(trim(content) <> '', false) AS has_text,
    coalesce(trim(mphash) <> '', false) AS has_phash,
    CASE WHEN regexp_full_match(lower(trim(mphash)), '[0-9a-f]{16}') THEN lower(trim(mphash)) END AS nhash,
    coalesce(nullif(docid, ''), 'msg:' || id) AS item_id
  FROM kind_hints
),
occ AS (
  SELECT peer_external_id AS from_id, origin_peer AS to_id, id AS message_id, date AS message_date,
         telegram_message_id, fwd_name
  FROM pm WHERE origin_peer < 0 AND peer_external_id < 0 AND origin_peer <> peer_external_id
),
edges AS (
  SELECT from_id, to_id, count(*) AS n, min(message_date) AS first_seen, max(message_date) AS last_seen,
         arg_max(fwd_name, message_date) FILTER (WHERE fwd_name IS NOT NULL) AS last_name
  FROM occ GROUP BY 1, 2
),
links AS (
  SELECT nhash AS phash, id AS message_id, date AS message_date, peer_external_id, telegram_message_id
  FROM pm WHERE nhash <> '0000000000000000'
),
blob_docs AS (SELECT substring(md5(text), 1, 16) AS phash, min(doc_id) AS vec_id FROM documents GROUP BY 1),
link_counts AS (SELECT phash, count(*) AS refcount FROM links GROUP BY 1),
blobs AS (
  SELECT d.phash, d.vec_id,
    CASE WHEN vec_id % 4 = 0 THEN 'blobs/images/' || vec_id WHEN vec_id % 16 = 1 THEN '  '
         WHEN vec_id % 16 = 2 THEN 's3://x/' || vec_id END AS canonical_path,
    vec_id % 3 = 0 AS image_embedded, coalesce(refcount, 0) AS refcount,
    CAST('2024-01-' || lpad(CAST(vec_id % 28 + 1 AS VARCHAR), 2, '0') || ' 00:00:00' AS TIMESTAMP) AS updated_at
  FROM blob_docs d LEFT JOIN link_counts USING (phash)
),
image_cache AS (SELECT phash, 'cache/' || phash AS cache_path FROM blobs WHERE vec_id % 5 = 0),
image_embeddings AS (
  SELECT phash, CASE WHEN vec_id % 5 = 4 THEN 'm1' ELSE 'm0' END AS model_id, CAST(embedding AS DOUBLE[]) AS v
  FROM blobs JOIN embeddings USING (vec_id)
),
text_embeddings AS (
  SELECT id AS message_id, CASE WHEN label % 2 = 0 THEN 't0' ELSE 't1' END AS model_id, CAST(embedding AS DOUBLE[]) AS v
  FROM messages JOIN embeddings ON vec_id = id
),
scope_inputs AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings WHERE vec_id IN (SELECT max(vec_id) FROM embeddings GROUP BY label)
),
spans AS (SELECT peer_external_id, min(date) AS covered_after, max(date) AS covered_before FROM messages GROUP BY 1),
fetch_cov AS (SELECT * FROM spans WHERE peer_external_id % 2 = 0),
media_cov AS (
  SELECT *, peer_external_id % 2 = 0 AS videos_excluded, peer_external_id % 4 = 0 AS large_excluded,
    CAST(CASE WHEN peer_external_id % 5 = 0 THEN 0 WHEN peer_external_id % 7 = 0 THEN NULL ELSE 5000000 END AS BIGINT) AS max_media_bytes
  FROM spans WHERE peer_external_id % 3 = 0
),
blob_facts AS (
  SELECT phash, 1 AS shown, CAST(length(canonical_path) > 0 AS INT) AS stored, CAST(image_embedded AS INT) AS embedded,
    CAST(length(trim(canonical_path)) > 0 OR cache_path IS NOT NULL OR image_embedded AS INT) AS able
  FROM blobs LEFT JOIN image_cache USING (phash)
),
image_counts AS (
  SELECT peer_external_id, sum(shown) AS image_unique, sum(stored) AS image_persisted, sum(able) AS image_embeddable, sum(embedded) AS image_embedded_unique
  FROM (SELECT DISTINCT peer_external_id, phash FROM links) JOIN blob_facts USING (phash) GROUP BY 1
),
message_facts AS (
  SELECT peer_external_id, media_kind, downloaded, has_phash, has_text, text_embedded, count(*) AS n FROM pm GROUP BY ALL
),
kind_counts AS (
  PIVOT (SELECT peer_external_id, media_kind, n, n * CAST(downloaded AS INT) AS done FROM message_facts)
  ON media_kind IN ('image', 'video', 'audio', 'gif', 'document') USING sum(n) AS total, sum(done) AS downloaded GROUP BY peer_external_id
),
message_counts AS (
  SELECT peer_external_id, * EXCLUDE (peer_external_id) REPLACE (""" + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in KIND_COUNTS) + """)
  FROM (
    SELECT peer_external_id, CAST(sum(n) AS BIGINT) AS posts, CAST(sum(if(has_text, n, 0)) AS BIGINT) AS text_total,
      CAST(sum(if(has_text AND text_embedded, n, 0)) AS BIGINT) AS text_embedded,
      CAST(sum(if(has_phash AND media_kind = 'image', n, 0)) AS BIGINT) AS image_hashed
    FROM message_facts GROUP BY 1) JOIN kind_counts USING (peer_external_id)
),
edge_counts AS (SELECT from_id AS peer_external_id, count(*) AS unique_forwards, sum(n) AS total_forwards FROM edges GROUP BY 1),
spine AS (
  SELECT DISTINCT unnest(p) AS peer_external_id FROM (
    SELECT list(peer_external_id) AS p FROM messages UNION ALL SELECT list(peer_external_id) FROM links UNION ALL SELECT list(from_id) FROM edges)
),
peer_counts AS (
  SELECT peer_external_id, """ + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ALL_COUNTS) + """
  FROM spine LEFT JOIN (message_counts FULL JOIN image_counts USING (peer_external_id) FULL JOIN edge_counts USING (peer_external_id)) USING (peer_external_id)
)
"""
)


def over_archive(body: str, ctes: str = "") -> str:
    """A query over the archive tables. ``ctes``, or a body that starts with a comma, adds WITH entries."""
    return ARCHIVE + (f", {ctes}\n" if ctes else "") + body
