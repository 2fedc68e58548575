"""Where a forwarded message came from, read from its typed header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from channelgraph.functions.ids import CHANNEL_MARK, signed_channel
from channelgraph.functions.text import strip_to_null

_HEADERS = ("from_id", "saved_from_peer")


def _tag(peer: Column) -> Column:
    return F.coalesce(F.nullif(peer["_"], F.lit("")), peer["tl"])


def _resolve(peer: Column) -> Column:
    tag = _tag(peer)

    def raw(name: str) -> Column:
        return peer[name].try_cast("bigint")

    return F.coalesce(
        F.when(F.contains(tag, F.lit("PeerChannel")), signed_channel(raw("channel_id"))),
        F.when(F.contains(tag, F.lit("PeerChat")), -F.abs(raw("chat_id"))),
        F.when(F.contains(tag, F.lit("PeerUser")), raw("user_id")),
    )


def fwd_origin(fwd: Column) -> Column:
    """Signed id of the origin: the first of the two headers that names one."""
    return F.coalesce(*[_resolve(fwd[name]) for name in _HEADERS])


def fwd_origin_msg(fwd: Column) -> Column:
    """Id of the original post, if the header carries a positive one."""

    def positive(name: str) -> Column:
        value = fwd[name].try_cast("bigint")
        return F.when(value > 0, value)

    return F.coalesce(positive("channel_post"), positive("saved_from_msg_id"))


def fwd_name(fwd: Column) -> Column:
    return strip_to_null(fwd["from_name"])


def origin_matches(fwd: Column, peer_id: int) -> Column:
    """Either header names this peer, with the exact tag and a digits-only id."""
    if peer_id < -CHANNEL_MARK:
        tag, field, raw = "PeerChannel", "channel_id", -peer_id - CHANNEL_MARK
    elif peer_id < 0:
        tag, field, raw = "PeerChat", "chat_id", -peer_id
    else:
        tag, field, raw = "PeerUser", "user_id", peer_id

    def header(name: str) -> Column:
        peer = fwd[name]
        return (
            (F.coalesce(peer["_"], peer["tl"]) == tag)
            & peer[field].rlike(r"^[0-9]+\z")
            & (peer[field].try_cast("bigint") == raw)
        )

    return F.coalesce(header("from_id"), F.lit(False)) | F.coalesce(header("saved_from_peer"), F.lit(False))


def header_origins(fwd: Column) -> Column:
    """The peers that :func:`origin_matches` finds in a header, none to two, each once."""

    def exact(peer: Column) -> Column:
        tag = F.coalesce(peer["_"], peer["tl"])

        def raw(name: str) -> Column:
            return F.when(peer[name].rlike(r"^[0-9]+\z"), peer[name].try_cast("bigint"))

        channel, chat = raw("channel_id"), raw("chat_id")
        return (
            F.when((tag == "PeerChannel") & (channel > 0), -(F.lit(CHANNEL_MARK) + channel))
            .when((tag == "PeerChat") & (chat > 0) & (chat <= CHANNEL_MARK), -chat)
            .when(tag == "PeerUser", raw("user_id"))
        )

    return F.array_distinct(F.array_compact(F.array(*[exact(fwd[name]) for name in _HEADERS])))
