"""Relevance of peers by how close their images, and the images forwarded from them, come to example inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelgraph.functions.scores import ScopeParams, forward_score, mix, relevance
from channelgraph.functions.vectors import is_valid, unit
from channelgraph.operators.knn import best_match
from channelgraph.session import settle

SCORES = ("scope_r", "scope_j", "scope_score", "forward_r", "forward_j", "forward_n_events", "forward_score")


def scope_inputs(inputs: DataFrame) -> DataFrame:
    """Inputs with a usable vector, at length one, oldest first."""
    return (
        inputs.filter(is_valid(F.col("embedding")))
        .withColumn("embedding", unit(F.col("embedding")))
        .orderBy("created_at", "id")
    )


def needs_rescore(inputs: DataFrame, last_rerank_at, updated_at) -> DataFrame:
    """Inputs exist and the scores were never computed, or not since the last change."""
    last, changed = (F.lit(v).cast("timestamp_ntz") for v in (last_rerank_at, updated_at))
    stale = last.isNull() | F.coalesce(changed > last, F.lit(False))
    return inputs.agg(((F.count("*") > 0) & stale).alias("needs_rescore"))


def image_scores(vectors: DataFrame, inputs: DataFrame, params: ScopeParams) -> DataFrame | None:
    """Similarity and relevance of every image with a valid vector, whichever model made it."""
    matched = best_match(vectors, inputs, "phash")
    if matched is None:
        return None
    return matched.select(
        "phash", "s", relevance(F.col("s"), params).alias("r"), F.lit(params.version).alias("version")
    )


def forwarded_images(occ: DataFrame, links: DataFrame, peers: DataFrame) -> DataFrame:
    """Image appearances in forwarded messages, with the catalogued peer they came from."""
    slim = occ.select(F.col("to_external_id").alias("origin_peer_id"), "from_external_id", "message_id")
    known = peers.select(F.col("external_id").alias("origin_peer_id"))
    return slim.join(links.select("message_id", "phash"), "message_id").join(known, "origin_peer_id", "left_semi")


def evidence_pairs(links: DataFrame, forwarded: DataFrame, scored: DataFrame) -> DataFrame:
    """Distinct (peer, pile, phash): images a peer shows, and images others forwarded from it."""
    own = links.select("peer_external_id", F.lit("scope").alias("pile"), "phash")
    sent = forwarded.select(F.col("origin_peer_id").alias("peer_external_id"), F.lit("forward").alias("pile"), "phash")
    pairs = own.unionByName(sent).distinct()
    return pairs.join(scored.select("phash"), "phash", "left_semi").select("peer_external_id", "pile", "phash")


def forward_events(forwarded: DataFrame, usable: DataFrame) -> DataFrame:
    """One event per message and image that was forwarded from somewhere."""
    known = forwarded.join(usable.select("phash"), "phash", "left_semi")
    return known.groupBy("message_id", "phash").agg(F.min("origin_peer_id").alias("origin_peer_id"))


def evidence_sums(evidence: DataFrame, scored: DataFrame) -> DataFrame:
    """Summed relevance and number of images per peer, one column pair per pile."""
    return (
        evidence.join(scored.select("phash", "r"), "phash")
        .groupBy("peer_external_id")
        .pivot("pile", ["scope", "forward"])
        .agg(F.sum("r").alias("r"), F.count("phash").alias("j"))
    )


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("origin_peer_id").alias("peer_external_id")).agg(F.count("*").alias("n"))


def with_scores(rows: DataFrame, params: ScopeParams) -> DataFrame:
    """Peer scores from the sums."""
    mixed = mix(F.col("forward_r"), F.col("forward_j"), params)
    return rows.withColumns(
        {
            "scope_score": mix(F.col("scope_r"), F.col("scope_j"), params),
            "forward_score": forward_score(mixed, F.col("forward_n_events"), params),
        }
    )


def rerank(
    vectors: DataFrame,
    inputs: DataFrame,
    links: DataFrame,
    occ: DataFrame,
    peers: DataFrame,
    params: ScopeParams = ScopeParams(),
    scored: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Rebuild all scores: ``images``, ``evidence``, ``events`` and ``peers``.

    Without inputs everything is cleared and every peer scores zero. Image scores and the images of forwards are each
    needed several times, so both are written once. ``scored`` gives image scores that are known already
    (:func:`channelgraph.operators.input_lists.scores`); vectors and inputs are then not read.
    """
    ids = peers.select(F.col("external_id").alias("peer_external_id"))
    scored = image_scores(vectors, inputs, params) if scored is None else scored
    if scored is None:
        spark = vectors.sparkSession
        zero = ids.select("peer_external_id", *[F.lit(0.0).alias(c) for c in SCORES])
        for c in ("scope_j", "forward_j", "forward_n_events"):
            zero = zero.withColumn(c, F.lit(0).cast("bigint"))
        return {
            "images": spark.createDataFrame([], "phash string, s double, r double, version int"),
            "evidence": spark.createDataFrame([], "peer_external_id bigint, pile string, phash string"),
            "events": spark.createDataFrame([], "message_id bigint, phash string, origin_peer_id bigint"),
            "peers": zero,
        }
    scored = settle(scored, "image-scores")
    forwarded = settle(forwarded_images(occ, links, peers), "forwarded-images")
    evidence = evidence_pairs(links, forwarded, scored)
    events = forward_events(forwarded, scored)
    sums = evidence_sums(evidence, scored)
    counted = event_counts(events)
    rows = ids.join(sums, "peer_external_id", "left").join(counted, "peer_external_id", "left")
    filled = rows.select(
        "peer_external_id",
        F.coalesce("scope_r", F.lit(0.0)).alias("scope_r"),
        F.coalesce("scope_j", F.lit(0)).alias("scope_j"),
        F.coalesce("forward_r", F.lit(0.0)).alias("forward_r"),
        F.coalesce("forward_j", F.lit(0)).alias("forward_j"),
        F.coalesce("n", F.lit(0)).alias("forward_n_events"),
    )
    return {
        "images": scored,
        "evidence": evidence,
        "events": events,
        "peers": with_scores(filled, params).select("peer_external_id", *SCORES),
    }


def score_increment(
    vectors: DataFrame,
    inputs: DataFrame,
    links: DataFrame,
    occ: DataFrame,
    peers: DataFrame,
    state: dict[str, DataFrame],
    embedded_peers: DataFrame,
    params: ScopeParams = ScopeParams(),
) -> dict[str, DataFrame]:
    """Add what newly embedded images of some peers contribute to the stored scores.

    ``state`` is as ``rerank`` returns it. Evidence and events only ever grow: an image counts for a peer once, with
    the relevance it has when first seen. Returns the new state; ``fresh_evidence`` and ``fresh_events`` hold what
    was added, for appending.
    """
    chosen = embedded_peers.select("peer_external_id").distinct()
    own = links.join(chosen, "peer_external_id", "left_semi")
    sent = occ.join(chosen.withColumnRenamed("peer_external_id", "from_external_id"), "from_external_id", "left_semi")
    forwarded = settle(forwarded_images(sent, links, peers), "forwarded-images")
    involved = own.select("phash").unionByName(forwarded.select("phash")).distinct()
    scored = image_scores(vectors.join(involved, "phash", "left_semi"), inputs, params)
    if scored is None:
        return {**state, "fresh_evidence": state["evidence"].limit(0), "fresh_events": state["events"].limit(0)}
    scored = settle(scored, "image-scores")
    images = state["images"].join(scored.select("phash"), "phash", "left_anti").unionByName(scored)
    pairs = evidence_pairs(own, forwarded, scored)
    fresh = settle(pairs.join(state["evidence"], ["peer_external_id", "pile", "phash"], "left_anti"), "evidence")
    events = forward_events(forwarded, vectors)
    fresh_events = events.join(state["events"], ["message_id", "phash"], "left_anti")
    sums = evidence_sums(fresh, scored).select(
        "peer_external_id", *[F.col(c).alias(f"d_{c}") for c in ("scope_r", "scope_j", "forward_r", "forward_j")]
    )
    touched = (
        chosen.unionByName(forwarded.select(F.col("origin_peer_id").alias("peer_external_id")))
        .distinct()
        .withColumn("touched", F.lit(True))
    )
    old = state["peers"]
    rows = (
        old.join(sums, "peer_external_id", "left")
        .join(event_counts(fresh_events), "peer_external_id", "left")
        .join(touched, "peer_external_id", "left")
    )
    kept = {c: F.col(c) for c in ("scope_score", "forward_score")}
    added = rows.select(
        "peer_external_id",
        *[
            (F.col(c) + F.coalesce(f"d_{c}", F.lit(0))).alias(c)
            for c in ("scope_r", "scope_j", "forward_r", "forward_j")
        ],
        (F.col("forward_n_events") + F.coalesce("n", F.lit(0))).alias("forward_n_events"),
        *[c.alias(f"old_{name}") for name, c in kept.items()],
        "touched",
    )
    rescored = with_scores(added, params)
    for name in kept:
        rescored = rescored.withColumn(
            name, F.when(F.col("touched").isNotNull(), F.col(name)).otherwise(F.col(f"old_{name}"))
        )
    return {
        "images": images,
        "evidence": state["evidence"].unionByName(fresh),
        "events": state["events"].unionByName(fresh_events.select(*state["events"].columns)),
        "peers": rescored.select("peer_external_id", *SCORES),
        "fresh_evidence": fresh,
        "fresh_events": fresh_events,
    }
