"""Whole headers merged key by key equal deliveries applied one after the other."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from channelgraph.operators import whole_headers

SCHEMA = "peer_external_id long, telegram_message_id long, fwd_from string, media string, seq int"


def applied(old, new, strict):
    """One delivery over what is stored, both as (fwd_from, media); ``old`` is None for a new message."""
    if old is None:
        return new
    fwd = new[0] if new[0] is not None else old[0]
    if old[1] is None and new[1] is None:
        return fwd, None
    held, sent = old[1] or {}, new[1] or {}
    merged = {**sent, **held}
    if "kind" in sent:
        merged["kind"] = sent["kind"]
    return fwd, merged if "kind" in merged or not strict else None


def deliveries(seed):
    draw = random.Random(seed)
    values = [None, 1, -2.5, "", "text", True, [1, None], {"deep": {"er": [1]}}, "ünï\"\\\n"]

    def header(keys, chance):
        if draw.random() < chance:
            return None
        return {k: draw.choice(values) for k in draw.sample(keys, draw.randint(0, len(keys)))}

    rows = []
    for number in range(150):
        for seq in sorted(draw.sample(range(9), draw.randint(1, 5))):
            rows.append((1, number, header(["from_id", "other"], 0.5), header(["kind", "tl", "views", "x y", "päth"], 0.2), seq))
    return rows


def frame(spark, rows):
    texts = [(p, n, *[None if h is None else json.dumps(h) for h in (f, m)], s) for p, n, f, m, s in rows]
    made = spark.createDataFrame(texts, SCHEMA)
    return made.withColumns({c: whole_headers.whole(F.col(c)) for c in ("fwd_from", "media")})


def check(spark, stored, sent, strict):
    want = {}
    for p, n, f, m, _ in stored:
        want[p, n] = (f, m)
    for p, n, f, m, _ in sorted(sent, key=lambda r: r[4]):
        want[p, n] = applied(want.get((p, n)), (f, m), strict)
    got = {}
    merged = whole_headers.merge_headers(frame(spark, stored).drop("seq"), frame(spark, sent), "seq", strict)
    for r in merged.withColumns({c: F.to_json(c) for c in ("fwd_from", "media")}).collect():
        assert (r[0], r[1]) not in got
        got[r[0], r[1]] = tuple(None if r[c] is None else json.loads(r[c]) for c in ("fwd_from", "media"))
    # an object that no key is left in counts as absent
    assert {k: (f, m or None) for k, (f, m) in got.items()} == {k: (f, m or None) for k, (f, m) in want.items()}


def test_random_deliveries_over_stored_headers(spark):
    for seed, strict in ((1, True), (2, False)):
        rows = deliveries(seed)
        stored = [r for r in rows if r[4] == 0] + [(2, 7, {"a": 1}, {"views": 3}, 0)]
        check(spark, stored, [r for r in rows if r[4] > 0], strict)


def test_nothing_stored_or_nothing_sent(spark):
    rows = deliveries(3)
    check(spark, [], rows, True)
    check(spark, [r for r in rows if r[4] == min(s[4] for s in rows if s[1] == r[1])], [], True)


def test_text_that_is_no_object(spark):
    texts = [(1, 1, "{", "no json", 1), (1, 1, "null", "[1]", 2), (1, 2, None, "[1]", 1), (1, 3, "null", '{"kind":null}', 1), (1, 3, '{"a":1}', "3", 2)]
    sent = spark.createDataFrame(texts, SCHEMA)
    sent = sent.withColumns({c: whole_headers.whole(F.col(c)) for c in ("fwd_from", "media")})
    got = {r[0]: (r[1], r[2]) for r in whole_headers.fold_headers(sent, "seq").select("telegram_message_id", F.to_json("fwd_from"), F.to_json("media")).collect()}
    assert got == {1: (None, None), 2: (None, "[1]"), 3: ('{"a":1}', '{"kind":null}')}
    kinds = whole_headers.typed(whole_headers.fold_headers(sent, "seq")).select("telegram_message_id", "media.kind").collect()
    assert {r[0]: r[1] for r in kinds} == {1: None, 2: None, 3: None}
