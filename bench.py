"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores. Building the archive is timed apart, as
``ingest``; each query then runs once to warm up and three times (``BENCH_RUNS``) to a sink that takes every row, of which the
median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from channelgraph.plans.queries import registered  # noqa: E402
from channelgraph.session import local_session  # noqa: E402
from channelgraph.sources.derived import open_archive  # noqa: E402

HEADLINE = [
    "i1_merge_messages", "i6_forward_occurrences", "i7_forward_edges", "a1_peer_counts", "a5_media_windows",
    "a8_image_rollup", "a9_image_peers", "a10_video_rollup", "a17_shared_images", "c1_attach_stats",
    "c3_peer_coverage", "c6_lookup_origin", "g1_forward_graph_nodes", "g3_message_layer_nodes",
    "g3_message_layer_edges", "g4_shared_image_nodes", "g5_graph_stats", "g6_filter_graph_nodes", "g11_expand",
    "v1_knn_messages", "v2_knn_images", "v7_peer_scores", "v8_score_increment", "x1_export_peers",
    "x3_export_messages", "t1_message_page", "t6_image_sources", "w2_counter_stream",
]
TABLES = [
    "messages", "peers", "forward_edge_messages", "forward_edges", "image_blob_messages", "image_blobs", "image_cache",
    "image_embeddings", "message_text_embeddings", "scope_inputs", "peer_fetch_coverage", "peer_media_coverage",
    "peer_counts", "graph_nodes", "graph_edges",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    started = time.time()
    archive = open_archive(spark, sf_dir)
    for table in TABLES:
        getattr(archive, table)
    times["ingest"] = round(time.time() - started, 3)
    chosen = sys.argv[1:] or HEADLINE
    queries = registered()
    for name in chosen:
        runs = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "3"))):
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(statistics.median(runs[1:] or runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
