"""Oracles for graphs, search, relevance and streams."""

from oracles.base import over_archive as q
from oracles.catalog import ORACLES as CATALOG
from oracles.ingest import ORACLES as INGEST
from oracles.ingest import deliveries

TARGET_TYPE = "CASE WHEN {k} < -1000000000000 THEN 'channel' ELSE 'chat' END"

FORWARD_GRAPH = f"""half AS (
  SELECT from_id AS id, to_id AS nbr, n, 1 AS out, n AS out_n FROM edges
  UNION ALL SELECT to_id, from_id, n, 0, 0 FROM edges),
metrics AS (SELECT id, count(DISTINCT nbr) AS degree, sum(n) AS volume, sum(out) AS unique_out, sum(out_n) AS total_out FROM half GROUP BY 1),
names AS (SELECT from_id AS id, arg_min(last_name, to_id) FILTER (WHERE last_name IS NOT NULL) AS name FROM edges GROUP BY 1),
peer_nodes AS (
  SELECT CAST(m.id AS VARCHAR) AS id, 'peer' AS kind, m.id AS external_id, coalesce(p.peer_type, {TARGET_TYPE.format(k="m.id")}) AS peer_type,
    coalesce(p.title, '@' || p.username, names.name) AS label, p.username,
    m.id IN (SELECT peer_external_id FROM fetch_cov) OR coalesce(p.messages_scraped, 0) > 0 AS scraped, coalesce(p.is_scraping, false) AS is_scraping,
    degree, CAST(volume AS BIGINT) AS forward_volume, CAST(unique_out AS BIGINT) AS forwards_unique, CAST(total_out AS BIGINT) AS forwards_total
  FROM metrics m LEFT JOIN peers p ON p.external_id = m.id LEFT JOIN names ON names.id = m.id),
peer_edges AS (SELECT CAST(from_id AS VARCHAR) AS source, CAST(to_id AS VARCHAR) AS target, 'forward_from' AS kind, n AS count FROM edges)"""


def layer(where: str = "true", tag: str = "") -> str:
    """The message layer by window functions over the scan order."""
    return f"""fw{tag} AS (
  SELECT id, peer_external_id, date, nullif(trim(content[1:80]), '') AS excerpt, media_kind, origin_peer, origin_mid,
    row_number() OVER (PARTITION BY origin_peer, origin_mid ORDER BY date DESC, id) AS rn
  FROM pm WHERE id IN (SELECT message_id FROM occ) AND origin_mid IS NOT NULL AND {where}),
stub_ranks{tag} AS (
  SELECT origin_peer, origin_mid, min(date) AS date, min(rn) FILTER (WHERE excerpt IS NOT NULL) AS re,
    min(rn) FILTER (WHERE media_kind IS NOT NULL) AS rk FROM fw{tag} GROUP BY 1, 2),
originals{tag} AS (
  SELECT s.*, m.id AS stored_id, m.date AS stored_date, nullif(trim(m.content[1:80]), '') AS stored_excerpt, m.media_kind AS stored_kind,
    CASE WHEN m.id IS NOT NULL THEN 'm:' || m.id ELSE 'm:orig:' || s.origin_peer || ':' || s.origin_mid END AS node_id
  FROM stub_ranks{tag} s LEFT JOIN pm m ON m.peer_external_id = s.origin_peer AND m.telegram_message_id = s.origin_mid),
message_nodes{tag} AS (
  SELECT o.node_id AS id, 'message' AS kind, o.origin_peer AS external_id, CASE WHEN stored_id IS NOT NULL THEN stored_excerpt ELSE e.excerpt END AS label,
    CASE WHEN stored_id IS NOT NULL THEN stored_kind ELSE k.media_kind END AS media_kind,
    CASE WHEN stored_id IS NOT NULL THEN stored_date ELSE o.date END AS date, o.origin_mid AS telegram_message_id, stored_id IS NULL AS stub,
    coalesce(stored_id, w.id) AS message_id
  FROM originals{tag} o
    LEFT JOIN fw{tag} e ON e.origin_peer = o.origin_peer AND e.origin_mid = o.origin_mid AND e.rn = o.re
    LEFT JOIN fw{tag} k ON k.origin_peer = o.origin_peer AND k.origin_mid = o.origin_mid AND k.rn = o.rk
    LEFT JOIN fw{tag} w ON w.origin_peer = o.origin_peer AND w.origin_mid = o.origin_mid AND w.rn = greatest(1, coalesce(o.re, 1), coalesce(o.rk, 1))),
message_edges{tag} AS (
  SELECT node_id AS source, CAST(origin_peer AS VARCHAR) AS target, 'sent_to' AS kind, CAST(1 AS BIGINT) AS count FROM originals{tag}
  UNION ALL SELECT DISTINCT CAST(f.peer_external_id AS VARCHAR), o.node_id, 'forwarded_from', CAST(1 AS BIGINT)
    FROM fw{tag} f JOIN originals{tag} o ON o.origin_peer = f.origin_peer AND o.origin_mid = f.origin_mid)"""


LAYER = layer()

WHOLE = f"""{FORWARD_GRAPH}, {LAYER},
all_nodes AS (SELECT id, kind, scraped, is_scraping, CAST(NULL AS VARCHAR) AS media_kind, label FROM peer_nodes
  UNION ALL SELECT id, kind, NOT stub, false, media_kind, label FROM message_nodes),
all_edges AS (SELECT * FROM peer_edges UNION ALL SELECT * FROM message_edges)"""


def shared(links: str = "links", peer: str = "") -> str:
    focus = f"AND phash IN (SELECT phash FROM seen WHERE peer_external_id = {peer})" if peer else ""
    return f"""seen AS (SELECT phash, peer_external_id, count(*) AS n, min(message_date) AS first FROM {links} GROUP BY 1, 2),
shared AS (SELECT phash, count(*) AS peers, CAST(sum(n) AS BIGINT) AS n, min(first) AS first FROM seen GROUP BY 1 HAVING count(*) >= 2 {focus}),
shown AS (SELECT seen.* FROM seen WHERE phash IN (SELECT phash FROM shared)),
shared_edges AS (SELECT 'img:' || phash AS source, CAST(peer_external_id AS VARCHAR) AS target, 'appeared_in' AS kind, n AS count FROM shown),
shared_peers AS (SELECT peer_external_id, count(*) AS images, CAST(sum(n) AS BIGINT) AS n FROM shown GROUP BY 1),
shared_nodes AS (
  SELECT 'img:' || phash AS id, 'image' AS kind, CAST(0 AS BIGINT) AS external_id, 'image' AS peer_type, peers || ' peers' AS label, true AS scraped,
    peers AS degree, n AS forward_volume, first AS date FROM shared
  UNION ALL SELECT CAST(s.peer_external_id AS VARCHAR), 'peer', s.peer_external_id, coalesce(p.peer_type, 'channel'), coalesce(p.title, '@' || p.username),
    s.peer_external_id IN (SELECT peer_external_id FROM fetch_cov) OR coalesce(p.messages_scraped, 0) > 0, images, n, NULL
  FROM shared_peers s LEFT JOIN peers p ON p.external_id = s.peer_external_id)"""


SHARED = shared()
WINDOW = "(SELECT * FROM links WHERE message_date >= TIMESTAMP '2024-01-08' AND message_date <= TIMESTAMP '2024-01-20 23:59:59.999')"
SHARED_OF_PEER = shared(WINDOW, "-1000000000001")

VISIBLE = f"""{WHOLE},
froms AS (SELECT target AS id, source AS peer FROM all_edges WHERE kind = 'forwarded_from'),
tos AS (SELECT source AS id, target AS peer FROM all_edges WHERE kind = 'sent_to'),
selfs AS (SELECT DISTINCT id FROM froms WHERE id IN (SELECT id FROM tos)
  AND id NOT IN (SELECT f.id FROM froms f LEFT JOIN tos t ON t.id = f.id AND t.peer = f.peer WHERE t.id IS NULL)),
vis AS (SELECT * FROM all_nodes WHERE id NOT IN (SELECT id FROM selfs)
  AND CASE WHEN kind = 'message' THEN coalesce(media_kind, 'none') IN ('none', 'image', 'video') ELSE scraped OR is_scraping END),
expanded AS (SELECT * FROM all_edges UNION ALL SELECT target, source, 'forward_to', count FROM all_edges WHERE kind = 'forward_from'),
ve AS (SELECT * FROM expanded WHERE source IN (SELECT id FROM vis) AND target IN (SELECT id FROM vis)),
kept AS (SELECT * FROM vis WHERE kind <> 'message' OR (id IN (SELECT source FROM ve WHERE kind = 'sent_to')
  AND id IN (SELECT target FROM ve WHERE kind = 'forwarded_from')))"""

COSINE = "list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v))"


def scored(tau: float) -> str:
    return f"""sims AS (SELECT a.phash, max({COSINE}) AS s FROM image_embeddings a, scope_inputs b GROUP BY 1),
scored AS (SELECT phash, s, CASE WHEN s > {tau} THEN pow((s - {tau}) / (1 - {tau}), 2) ELSE 0 END AS r FROM sims),
fwd_images AS (SELECT to_id AS origin_peer_id, from_id, message_id, phash FROM occ JOIN links USING (message_id)
  WHERE to_id IN (SELECT external_id FROM peers)),
evidence AS (SELECT DISTINCT peer_external_id, 'scope' AS pile, phash FROM links WHERE phash IN (SELECT phash FROM scored)
  UNION SELECT DISTINCT origin_peer_id, 'forward', phash FROM fwd_images WHERE phash IN (SELECT phash FROM scored)),
events_of AS (SELECT message_id, phash, origin_peer_id FROM fwd_images WHERE phash IN (SELECT phash FROM scored))"""


def peer_scores(evidence: str = "evidence", events: str = "events_of") -> str:
    return f"""ev AS (SELECT peer_external_id, sum(r) FILTER (WHERE pile = 'scope') AS sr, count(*) FILTER (WHERE pile = 'scope') AS sj,
  sum(r) FILTER (WHERE pile = 'forward') AS fr, count(*) FILTER (WHERE pile = 'forward') AS fj FROM {evidence} JOIN scored USING (phash) GROUP BY 1),
en AS (SELECT origin_peer_id, count(*) AS n FROM {events} GROUP BY 1),
sums AS (SELECT external_id AS peer_external_id, coalesce(sr, 0) AS sr, coalesce(sj, 0) AS sj, coalesce(fr, 0) AS fr, coalesce(fj, 0) AS fj, coalesce(n, 0) AS n
  FROM peers LEFT JOIN ev ON ev.peer_external_id = external_id LEFT JOIN en ON origin_peer_id = external_id)"""


SCORE_ROWS = """SELECT peer_external_id, round(sr, 6) AS scope_r, sj AS scope_j, round(sr / (sr + 2 + 0.15 * sj), 6) AS scope_score,
  round(fr, 6) AS forward_r, fj AS forward_j, n AS forward_n_events, round(fr / (fr + 2 + 0.15 * fj) + 0.05 * ln(1 + n), 6) AS forward_score FROM sums"""

LOW = scored(0.05)
PART = """part_evidence AS (SELECT DISTINCT peer_external_id, 'scope' AS pile, phash FROM links WHERE phash IN (SELECT phash FROM scored)
    AND peer_external_id IN (SELECT peer_external_id FROM fetch_cov)
  UNION SELECT DISTINCT origin_peer_id, 'forward', phash FROM fwd_images WHERE phash IN (SELECT phash FROM scored)
    AND from_id IN (SELECT peer_external_id FROM fetch_cov)),
part_events AS (SELECT message_id, phash, origin_peer_id FROM fwd_images WHERE phash IN (SELECT phash FROM scored)
    AND from_id IN (SELECT peer_external_id FROM fetch_cov))"""


def knn(table: str, key: str, model: str, k: int, where: str = "true") -> str:
    return f"""hits AS (SELECT b.id AS query_id, {key}, {COSINE} AS score,
  row_number() OVER (PARTITION BY b.id ORDER BY {COSINE} DESC, {key}) AS rank
  FROM {table} a, scope_inputs b WHERE model_id = '{model}' AND {where} QUALIFY rank <= {k})"""


BAND = """CASE WHEN {n} > 80000 OR {e} > 200000 OR {b} > 83886080 THEN '{worst}' WHEN {n} > 25000 OR {e} > 80000 OR {b} > 26214400 THEN 'confirm' ELSE 'auto' END"""


def graph_stats(scope: str, open_scope: bool) -> str:
    cap = "m" if open_scope else "least(m, 40000)"
    band = BAND.format(
        n=f"(p + {cap})", e=f"(l + 2 * {cap})", b=f"(p * 220 + {cap} * 420 + (l + 2 * {cap}) * 80)", worst="block" if open_scope else "confirm"
    )
    return q(
        f"""SELECT p AS peer_count, l AS peer_edge_count, t AS message_forward_count, m AS scoped_message_count, p + m AS estimated_nodes,
             l + 2 * m AS estimated_edges, p * 220 + m * 420 + (l + 2 * m) * 80 AS bytes_estimate, {band} AS band,
             {"m > 40000" if open_scope else "false"} AS messages_omitted
           FROM (SELECT (SELECT count(*) FROM (SELECT from_id FROM edges UNION SELECT to_id FROM edges)) AS p, (SELECT count(*) FROM edges) AS l,
             (SELECT count(*) FROM occ) AS t, (SELECT count(*) FROM pm WHERE id IN (SELECT message_id FROM occ) AND {scope}) AS m)"""
    )


def shared_stats(ctes: str, open_scope: bool) -> str:
    cap, edges = ("i", "e") if open_scope else ("least(i, 40000)", "least(e, 320000)")
    band = BAND.format(n=f"(p + {cap})", e=edges, b=f"(p * 220 + {cap} * 420 + {edges} * 80)", worst="block" if open_scope else "confirm")
    return q(
        f"""SELECT p AS peer_count, i AS image_count, e AS edge_count, p + i AS estimated_nodes, e AS estimated_edges,
             p * 220 + i * 420 + e * 80 AS bytes_estimate, {band} AS band, {"i > 40000" if open_scope else "false"} AS images_omitted
           FROM (SELECT count(DISTINCT peer_external_id) AS p, count(DISTINCT phash) AS i, count(*) AS e FROM shown)""",
        ctes,
    )


OF_PEER = """(peer_external_id = -1000000000001 OR coalesce(o1 = -1000000000001, false) OR coalesce(o2 = -1000000000001, false))
             AND (media_kind IS NULL OR media_kind = 'image')"""

NEWEST = """id IN (SELECT id FROM pm WHERE id IN (SELECT message_id FROM occ) AND date >= TIMESTAMP '2024-01-08' AND date <= TIMESTAMP '2024-01-20 23:59:59.999'
             ORDER BY date DESC, id LIMIT 500)"""

FRONTIER = """frontier AS (SELECT to_id AS peer_id, min(first_seen) AS seq, to_id % 25 = 0 AS retry, coalesce(any_value(forward_score), 0) AS forward_score
             FROM edges LEFT JOIN peers ON external_id = to_id GROUP BY to_id)"""


def _expand(depth: int, seeds: str = "first_message_id IS NULL AND external_id < 0") -> str:
    """Breadth-first rounds, written out one by one."""
    rounds = [f"r0 AS (SELECT DISTINCT external_id AS peer_id, CAST(NULL AS BIGINT) AS via, 0 AS depth FROM peers WHERE {seeds})"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT peer_id FROM r{i}" for i in range(d))
        rounds.append(
            f"""r{d} AS (SELECT to_id AS peer_id, min(from_id) AS via, {d} AS depth FROM edges JOIN r{d - 1} ON from_id = peer_id
                 WHERE to_id NOT IN ({seen}) GROUP BY 1)"""
        )
    union = " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(depth + 1))
    return q(f"SELECT peer_id, via, CAST(depth AS BIGINT) AS depth FROM ({union})", ", ".join(rounds))


ORACLES = {
    "f21_relevance": q(
        """SELECT phash, round(s, 6) AS s, round(r, 6) AS r, round(CASE WHEN s > 0.4 THEN pow((s - 0.4) / 0.6, 2) ELSE 0 END, 6) AS r_default,
             round(CASE WHEN s > 0.9 THEN (s - 0.9) / 0.1 ELSE 0 END, 6) AS r_steep FROM scored""",
        LOW,
    ),
    "f28_node_size": q(
        """SELECT id, round((8 * 0.3 + (8 * 2.6 - 8 * 0.3) * ln(1 + forward_volume) / ln(1 + (SELECT greatest(1, max(forward_volume)) FROM peer_nodes)))
             * CASE WHEN is_scraping THEN 1.2 ELSE 1 END, 6) AS size FROM peer_nodes""",
        FORWARD_GRAPH,
    ),
    "j9_best_match": q("SELECT phash, round(s, 6) AS s FROM sims", LOW),
    "a18_evidence_sums": q(
        "SELECT peer_external_id, round(sr, 6) AS scope_r, nullif(sj, 0) AS scope_j, round(fr, 6) AS forward_r, nullif(fj, 0) AS forward_j FROM ev",
        LOW + ", " + peer_scores(),
    ),
    "u3_node_kinds": q(
        """SELECT kind, count(*) AS nodes FROM (SELECT kind FROM peer_nodes UNION ALL SELECT kind FROM message_nodes
             UNION ALL SELECT kind FROM shared_nodes WHERE kind = 'image') GROUP BY 1""",
        f"{FORWARD_GRAPH}, {LAYER}, {SHARED}",
    ),
    "g1_forward_graph_nodes": q("SELECT * EXCLUDE (kind) FROM peer_nodes", FORWARD_GRAPH),
    "g1_forward_graph_edges": q("SELECT * FROM peer_edges", FORWARD_GRAPH),
    "g2_origin_keys": q("SELECT DISTINCT origin_peer, origin_mid FROM pm WHERE origin_peer IS NOT NULL AND origin_mid IS NOT NULL"),
    "g3_message_layer_nodes": q("SELECT * EXCLUDE (kind) FROM message_nodes", LAYER),
    "g3_message_layer_edges": q("SELECT * FROM message_edges", LAYER),
    "g3_message_graph_newest": q("SELECT id, label, date, message_id FROM message_nodes", layer(NEWEST)),
    "g4_shared_image_nodes": q("SELECT * FROM shared_nodes", SHARED),
    "g4_shared_image_edges": q("SELECT * FROM shared_edges", SHARED),
    "g4_shared_image_nodes_of_peer": q("SELECT id, kind, degree, forward_volume FROM shared_nodes", SHARED_OF_PEER),
    "g5_graph_stats": graph_stats("true", True),
    "g5_graph_stats_of_peer": graph_stats(OF_PEER, False),
    "g5_shared_image_stats": shared_stats(SHARED, True),
    "g5_shared_image_stats_of_peer": shared_stats(SHARED_OF_PEER, False),
    "g6_filter_graph_nodes": q("SELECT id, kind FROM kept", VISIBLE),
    "g6_filter_graph_edges": q(
        "SELECT source, target, kind, count FROM ve WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)", VISIBLE
    ),
    "g6_default_layers": q("SELECT id, kind FROM peer_nodes", FORWARD_GRAPH),
    "g6_default_layer_edges": q("SELECT source, target, kind, count FROM peer_edges", FORWARD_GRAPH),
    "g6_shared_image_preset": q("SELECT id, kind FROM shared_nodes", SHARED),
    "g7_self_forwards": q(
        """, f AS (SELECT target AS id, source AS peer FROM message_edges WHERE kind = 'forwarded_from' AND CAST(source AS BIGINT) % 4 = 3
             UNION SELECT source, target FROM message_edges WHERE kind = 'sent_to' AND CAST(target AS BIGINT) % 2 = 0),
           t AS (SELECT source AS id, target AS peer FROM message_edges WHERE kind = 'sent_to')
           SELECT DISTINCT id FROM f WHERE id NOT IN (SELECT f.id FROM f LEFT JOIN t ON t.id = f.id AND t.peer = f.peer WHERE t.id IS NULL)""",
        LAYER,
    ),
    "g8_merge_graph": q(
        """SELECT kind, count(*) AS n FROM (SELECT kind FROM peer_nodes UNION ALL SELECT kind FROM message_nodes UNION ALL SELECT kind FROM peer_edges
             UNION ALL SELECT kind FROM message_edges) GROUP BY 1""",
        f"{FORWARD_GRAPH}, {LAYER}",
    ),
    "g8_new_nodes": q(
        "SELECT id FROM message_nodes WHERE id NOT IN (SELECT id FROM message_nodes_old)",
        f"""{LAYER}, {layer("date <= TIMESTAMP '2024-01-08'", "_old")}""",
    ),
    "g10_forwarders": q(
        "SELECT e.target AS id, e.source AS peer, p.label AS peer_label FROM message_edges e JOIN peer_nodes p ON p.id = e.source WHERE e.kind = 'forwarded_from'",
        f"{FORWARD_GRAPH}, {LAYER}",
    ),
    "g10_sent_to": q(
        "SELECT e.source AS id, e.target AS peer, p.label AS peer_label FROM message_edges e JOIN peer_nodes p ON p.id = e.target WHERE e.kind = 'sent_to'",
        f"{FORWARD_GRAPH}, {LAYER}",
    ),
    "g9_graph_fingerprint": q(
        """SELECT (SELECT count(*) FROM peer_nodes) AS nodes, (SELECT count(*) FROM peer_edges) AS edges, md5(
             (SELECT CAST(coalesce(sum(('0x' || md5(id || '|' || kind || '|' || scraped || '|' || is_scraping || '|' || degree || '|' || forward_volume || '|')[1:15])::BIGINT), 0) AS VARCHAR) FROM peer_nodes)
             || '|' || (SELECT CAST(coalesce(sum(('0x' || md5(source || '|' || kind || '|' || target || '|' || count)[1:15])::BIGINT), 0) AS VARCHAR) FROM peer_edges)) AS fingerprint""",
        FORWARD_GRAPH,
    ),
    "g10_appeared_in": q(
        "SELECT e.source AS id, e.target AS peer, p.label AS peer_label FROM shared_edges e JOIN shared_nodes p ON p.id = e.target", SHARED
    ),
    "g11_expand": _expand(5),
    # seeds stand so close together that nothing is further than a few rounds from one
    "g11_reach": _expand(12, "external_id < 0 AND abs(external_id) % 10 = 1"),
    "g12_rank_frontier": q(
        """SELECT peer_id, retry, forward_score FROM frontier ORDER BY retry DESC, CASE WHEN retry THEN seq END, forward_score DESC, peer_id DESC LIMIT 20""",
        FRONTIER,
    ),
    "g12_rank_frontier_fifo": q("SELECT peer_id, retry FROM frontier ORDER BY retry DESC, seq LIMIT 20", FRONTIER),
    "v1_knn_messages": q("SELECT query_id, message_id, round(score, 6) AS score, rank FROM hits", knn("text_embeddings", "message_id", "t0", 20)),
    "v1_knn_messages_of_peer": q(
        "SELECT query_id, message_id, rank FROM hits",
        knn("text_embeddings", "message_id", "t0", 5, "message_id IN (SELECT id FROM messages WHERE peer_external_id = -1000000000001)"),
    ),
    "v2_knn_images": q("SELECT query_id, phash, round(score, 6) AS score, rank FROM hits", knn("image_embeddings", "phash", "m0", 20)),
    "v2_knn_images_of_peer": q(
        "SELECT query_id, phash, rank FROM hits",
        knn("image_embeddings", "phash", "m0", 5, "phash IN (SELECT phash FROM links WHERE peer_external_id = -1000000000001)"),
    ),
    "v3_hydrate_messages": q(
        """SELECT query_id, id, rank, round(score, 4) AS score, title AS peer_title, media_kind, fwd_from IS NOT NULL AS forwarded
           FROM hits JOIN pm ON id = message_id JOIN peers ON external_id = peer_external_id""",
        knn("text_embeddings", "message_id", "t0", 20),
    ),
    "v3_hydrate_images": q(
        """SELECT query_id, phash, rank, round(score, 4) AS score, refcount AS appearances,
             (SELECT count(DISTINCT peer_external_id) FROM links l WHERE l.phash = hits.phash) AS unique_peers FROM hits JOIN blobs USING (phash)""",
        knn("image_embeddings", "phash", "m0", 20),
    ),
    "v3_hit_peers": q(
        """SELECT query_id, phash, peer_external_id, title AS peer_title, appearances, forwarded, last_seen_at,
             row_number() OVER (PARTITION BY query_id, phash ORDER BY appearances DESC, last_seen_at DESC, peer_external_id) AS place
           FROM hits JOIN (SELECT l.phash, l.peer_external_id, count(*) AS appearances, count(m.fwd_from) AS forwarded, max(l.message_date) AS last_seen_at
             FROM links l JOIN messages m ON m.id = l.message_id GROUP BY 1, 2) USING (phash) JOIN peers ON external_id = peer_external_id""",
        knn("image_embeddings", "phash", "m0", 20),
    ),
    "v6_embed_images": q(
        """SELECT phash, 'm9' AS model_id, CAST(64 AS BIGINT) AS dim FROM blobs
           WHERE (trim(canonical_path) <> '' AND canonical_path NOT LIKE '%://%') OR phash IN (SELECT phash FROM image_cache)"""
    ),
    "v4_pending_text": q(
        "SELECT id AS message_id, date FROM pm WHERE has_text AND id NOT IN (SELECT message_id FROM text_embeddings WHERE model_id = 't0')"
    ),
    "v5_pending_images": q(
        """SELECT phash FROM blobs WHERE ((trim(canonical_path) <> '' AND canonical_path NOT LIKE '%://%') OR phash IN (SELECT phash FROM image_cache))
             AND phash NOT IN (SELECT phash FROM image_embeddings WHERE model_id = 'm0')
             AND phash NOT IN (SELECT phash FROM image_cache WHERE phash < '8')"""
    ),
    "v6_embed_progress": q(
        """SELECT count(*) FILTER (WHERE phash IN (SELECT phash FROM image_cache)) AS done,
             count(*) FILTER (WHERE phash NOT IN (SELECT phash FROM image_cache)) AS skipped FROM blobs"""
    ),
    "v7_image_scores": q("SELECT phash, round(s, 6) AS s, round(r, 6) AS r, CAST(0 AS BIGINT) AS version FROM scored", LOW),
    "v7_evidence": q("SELECT * FROM evidence", LOW),
    "v7_forward_events": q("SELECT * FROM events_of", LOW),
    "v7_peer_scores": q(SCORE_ROWS, LOW + ", " + peer_scores()),
    "v7_peer_scores_default": q(SCORE_ROWS, scored(0.4) + ", " + peer_scores()),
    "v7_changed_inputs": q(
        SCORE_ROWS,
        "changed_inputs AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 = 0 AND vec_id % 4 <> 0), "
        + LOW.replace("scope_inputs b", "changed_inputs b") + ", " + peer_scores(),
    ),
    "v7_no_inputs": q(
        """SELECT external_id AS peer_external_id, 0::DOUBLE AS scope_r, 0::BIGINT AS scope_j, 0::DOUBLE AS scope_score, 0::DOUBLE AS forward_r,
             0::BIGINT AS forward_j, 0::BIGINT AS forward_n_events, 0::DOUBLE AS forward_score FROM peers"""
    ),
    "v8_score_increment": q(SCORE_ROWS, LOW + ", " + peer_scores()),
    "v8_score_increment_part": q(SCORE_ROWS, f"{LOW}, {PART}, {peer_scores('part_evidence', 'part_events')}"),
    "v9_scope_inputs": q(
        """SELECT id, 'label ' || label AS body, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS x0,
             CAST('2024-01-01 00:00:' || lpad(CAST(label % 60 AS VARCHAR), 2, '0') AS TIMESTAMP) AS created_at FROM scope_inputs"""
    ),
    "v9_needs_rescore": q("SELECT count(*) > 0 AS needs_rescore FROM scope_inputs"),
    "v12_missing_phash": q(
        "SELECT id, peer_external_id, telegram_message_id FROM pm WHERE media_kind = 'image' AND NOT has_phash"
    ),
    "v13_classify_files": """WITH t AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif'
             WHEN 3 THEN 'image/webp' WHEN 4 THEN 'video/mp4' WHEN 5 THEN 'video/webm' END AS content_type FROM documents)
           SELECT doc_id, split_part(content_type, '/', 1) AS kind, content_type,
             CASE content_type WHEN 'image/png' THEN '.png' WHEN 'image/gif' THEN '.gif' WHEN 'image/webp' THEN '.webp' ELSE '.jpg' END AS suffix FROM t""",
    # ---- streams: the same tables as from one batch
    "w1_message_stream": INGEST["i1_merge_messages"].replace("m.id IS NULL AS inserted", "true AS inserted").replace(
        "coalesce(m.text_embedded, false) AS text_embedded, coalesce(m.image_embedded, false) AS image_embedded",
        "false AS text_embedded, false AS image_embedded",
    ),
    "w1_message_stream_over_base": deliveries("id % 2 = 0"),
    "w2_counter_stream": q(
        """SELECT peer_external_id, posts, text_total, image_total, image_downloaded, video_total, video_downloaded, audio_total,
             audio_downloaded, gif_total, gif_downloaded, document_total, document_downloaded FROM message_counts"""
    ),
    "w3_forward_stream": INGEST["i7_forward_edges"],
    "w4_coverage_stream": q("SELECT * FROM spans"),
    "w5_relevance_stream": q(SCORE_ROWS + " WHERE sj > 0 OR fj > 0 OR n > 0", LOW + ", " + peer_scores()),
}

# the same searches with the vectors as questions whose id is divisible by 100
HUNDREDTH = "hundredth AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),\n"
ORACLES |= {
    f"{name}_whole": ORACLES[name].replace("hits AS (", HUNDREDTH + "hits AS (").replace("scope_inputs b", "hundredth b")
    for name in ("v1_knn_messages", "v2_knn_images", "v3_hydrate_messages", "v3_hydrate_images", "v3_hit_peers")
}


def indexed(table: str, key: str, model: str, rounds: int = 4, k: int = 20) -> str:
    """The exact search within the cells of a k-means by cosine that starts from the vectors with the smallest hash of their id.

    As many cells are asked as hold 95 of 100 exact neighbours of 128 stored vectors."""
    cosine = "list_cosine_similarity({a}, {b})"
    steps = [
        f"vv AS (SELECT {key} AS key, v, sqrt(list_inner_product(v, v)) AS norm FROM {table} WHERE model_id = '{model}')",
        "nn AS (SELECT greatest(1, least(4096, CAST(round(sqrt(count(*))) AS BIGINT))) AS cells FROM vv)",
        "c0 AS (SELECT row_number() OVER (ORDER BY md5(CAST(key AS VARCHAR)), key) - 1 AS cell, v AS c FROM vv QUALIFY cell < (SELECT cells FROM nn))",
    ]
    for n in range(rounds + 1):
        near = cosine.format(a="v", b="c")
        steps.append(f"a{n} AS MATERIALIZED (SELECT key, v, norm, cell FROM vv, c{n} QUALIFY row_number() OVER (PARTITION BY key ORDER BY {near} DESC, cell) = 1)")
        steps.append(
            f"""c{n + 1} AS MATERIALIZED (SELECT cell, list(m ORDER BY pos) AS c FROM (
  SELECT cell, pos, avg(v[pos] / norm) AS m FROM a{n}, range(1, (SELECT max(len(v)) + 1 FROM vv)) t(pos) GROUP BY cell, pos) GROUP BY cell
  UNION ALL SELECT cell, c FROM c{n} WHERE cell NOT IN (SELECT cell FROM a{n}))"""
        )
    other = COSINE.replace("a.v", "o.v").replace("b.v", "m.v")
    asked, hit = cosine.format(a="b.v", b="c"), COSINE.replace("b.v", "p.v")
    steps += [
        f"measured AS MATERIALIZED (SELECT key, v FROM a{rounds} ORDER BY md5(CAST(key AS VARCHAR)), key LIMIT 128)",
        f"""neighbours AS (SELECT m.key, o.cell FROM measured m JOIN a{rounds} o ON m.key <> o.key
  QUALIFY row_number() OVER (PARTITION BY m.key ORDER BY {other} DESC, o.key) <= 10)""",
        f"""cell_order AS (SELECT b.key, cell, row_number() OVER (PARTITION BY b.key ORDER BY {cosine.format(a="b.v", b="c")} DESC, cell) AS place
  FROM measured b, c{rounds})""",
        "needed AS (SELECT place, row_number() OVER (ORDER BY place) AS n, count(*) OVER () AS total FROM neighbours JOIN cell_order USING (key, cell))",
        "probes AS (SELECT coalesce(min(place), 1) AS probes FROM needed WHERE n >= 0.95 * total)",
        f"""asked AS (SELECT b.id, b.v, cell FROM hundredth b, c{rounds}
  QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY {asked} DESC, cell) <= (SELECT probes FROM probes))""",
        f"""hits AS (SELECT p.id AS query_id, a.key, {hit} AS score, row_number() OVER (PARTITION BY p.id ORDER BY {hit} DESC, a.key) AS rank
  FROM asked p JOIN a{rounds} a ON a.cell = p.cell QUALIFY rank <= {k})""",
    ]
    return HUNDREDTH + ",\n".join(steps)


ORACLES |= {
    "v1_index_messages": q("SELECT query_id, key AS message_id, round(score, 6) AS score, rank FROM hits", indexed("text_embeddings", "message_id", "t0")),
    "v1_index_messages_all_cells": ORACLES["v1_knn_messages_whole"],
    "v2_index_images": q("SELECT query_id, key AS phash, round(score, 6) AS score, rank FROM hits", indexed("image_embeddings", "phash", "m0")),
}

ORACLES |= {"w2_counter_state": ORACLES["w2_counter_stream"], "w3_forward_state": ORACLES["w3_forward_stream"], "w2_live_counters": CATALOG["a1_peer_counts"]}


def hashed_vectors(payloads: str) -> str:
    """``vectors``: the vector of each payload (columns c, payload as BLOB): counts of hashed triples of neighbouring bytes in 64 cells."""
    return f"""payloads AS MATERIALIZED ({payloads}),
bytes AS MATERIALIZED (SELECT c, list_transform(regexp_extract_all('0000' || hex(payload), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM payloads),
triples AS (SELECT c, unnest(list_transform(range(1, len(b) - 1), lambda i: b[i] * 65536 + b[i + 1] * 256 + b[i + 2])) AS t FROM bytes),
cells AS (SELECT c, ((t * 2654435761) % 4294967296 // 256) % 64 AS k, count(*) AS n FROM triples GROUP BY ALL),
vectors AS (
  SELECT p.c, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY k) AS vector
  FROM payloads p CROSS JOIN range(64) t(k) LEFT JOIN cells USING (c, k) GROUP BY p.c
)"""


ORACLES |= {
    # each text is encoded once, however many messages carry it
    "v6_embed_text": q(
        "SELECT id AS message_id, 'multilingual-e5-small' AS model_id, CAST(64 AS BIGINT) AS dim, vector FROM pm JOIN vectors ON c = content WHERE has_text",
        hashed_vectors("SELECT content AS c, encode('passage: ' || trim(content, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS payload FROM (SELECT DISTINCT content FROM pm WHERE has_text)"),
    ),
    "v6_embed_images": q(
        """SELECT phash, 'm9' AS model_id, CAST(64 AS BIGINT) AS dim, vector FROM blobs JOIN vectors ON c = phash
           WHERE (trim(canonical_path) <> '' AND canonical_path NOT LIKE '%://%') OR phash IN (SELECT phash FROM image_cache)""",
        hashed_vectors("SELECT substring(md5(text), 1, 16) AS c, encode(any_value(text)) AS payload FROM documents WHERE text <> '' GROUP BY 1"),
    ),
}


ORACLES |= {
    # an 8 x 8 image is resampled to 32 x 32 along rows, then columns; of its cosine transform the low 8 x 8 are held against their median
    "v11_hash_images": """WITH
pixels AS (
  SELECT vec_id, i // 8 AS y, i % 8 AS s, greatest(0, least(255, round(x * 255::FLOAT + 128::FLOAT)))::DOUBLE AS g
  FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)
),
offsets AS (SELECT t, s, s + 0.5::DOUBLE - (t + 0.5::DOUBLE) / 4 AS x FROM range(32) a(t), range(8) b(s)),
raw_weights AS (
  SELECT t, s, CASE WHEN x = 0 THEN 1 WHEN abs(x) < 3 THEN sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) ELSE 0 END AS w FROM offsets
),
weights AS (SELECT t, s, w / sum(w) OVER (PARTITION BY t) AS w FROM raw_weights),
wide AS (SELECT vec_id, y, t, greatest(0, least(255, round_even(sum(g * w), 0))) AS g FROM pixels JOIN weights USING (s) GROUP BY ALL),
full_size AS (
  SELECT vec_id, c.t AS u, wide.t, greatest(0, least(255, round_even(sum(g * w), 0))) AS g FROM wide JOIN weights c ON c.s = wide.y GROUP BY ALL
),
cosines AS (SELECT k, n, 2 * cos(pi() * k * (2 * n + 1) / 64) AS c FROM range(8) a(k), range(32) b(n)),
half AS (SELECT vec_id, u, k AS l, sum(g * c) AS v FROM full_size JOIN cosines ON n = t GROUP BY ALL),
low AS (SELECT vec_id, k, l, sum(v * c) AS v FROM half JOIN cosines ON n = u GROUP BY ALL),
bits AS (SELECT vec_id, k * 8 + l AS i, CAST(v > median(v) OVER (PARTITION BY vec_id) AS INTEGER) AS b FROM low),
digits AS (SELECT vec_id, i // 4 AS d, sum(b << (3 - i % 4)::INTEGER) AS digit FROM bits GROUP BY ALL)
SELECT vec_id, string_agg(printf('%x', digit::INTEGER), '' ORDER BY d) AS phash FROM digits GROUP BY vec_id""",
}
