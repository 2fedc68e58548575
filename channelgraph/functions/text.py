"""Text, handle, label and hash rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_HASH = "0" * 16
EXCERPT_CHARS = 80
# The characters Unicode counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def blank_to_null(c: Column) -> Column:
    """Spaces only, as SQL trims; text without anything else becomes null."""
    trimmed = F.trim(c)
    return F.when(trimmed != "", trimmed)


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind. Only the ends are looked at, however long the text."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_to_null(c: Column) -> Column:
    stripped = strip(c)
    return F.when(stripped != "", stripped)


def has_text(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def excerpt(c: Column) -> Column:
    return blank_to_null(F.left(c, F.lit(EXCERPT_CHARS)))


def _referred(columns: list[str], field: str, own: Column) -> Column:
    """What the reference says of a shared text; ``own`` for messages that carry theirs."""
    if "text_ref" not in columns:
        return own
    return F.when(F.col("text_ref").isNotNull(), F.col(f"text_ref.{field}")).otherwise(own)


def any_has_text(columns: list[str]) -> Column:
    return _referred(columns, "has_text", has_text(F.col("content")))


def own_excerpt(columns: list[str]) -> Column:
    """What a message stores beside its text; that of a shared text is cut from it where it is shown."""
    return F.when(F.col("text_ref").isNull(), excerpt(F.col("content"))) if "text_ref" in columns else excerpt(F.col("content"))


def has_words(columns: list[str]) -> Column:
    """Whether anything remains after all white space is stripped."""
    return _referred(columns, "has_words", strip_to_null(F.col("content")).isNotNull())


def stored_has_text(columns: list[str]) -> Column:
    """The stored flag where the table has one, so that the text column is not read."""
    return F.col("has_text") if "has_text" in columns else any_has_text(columns)


def stored_excerpt(columns: list[str]) -> Column:
    """The excerpt of a text of the message's own; null where it refers to a shared one."""
    return (F.col("excerpt") if "excerpt" in columns else own_excerpt(columns)).alias("excerpt")


def has_excerpt(columns: list[str]) -> Column:
    """Whether there is an excerpt, of a shared text too."""
    return _referred(columns, "has_excerpt", stored_excerpt(columns).isNotNull())


def norm_phash(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low.rlike(r"^[0-9a-f]{16}\z"), low)


def is_dedupable(c: Column) -> Column:
    return F.coalesce(norm_phash(c) != ZERO_HASH, F.lit(False))


def peer_label(title: Column, username: Column, fallback: Column | None = None) -> Column:
    choices = [strip_to_null(title), F.concat(F.lit("@"), strip_to_null(username))]
    if fallback is not None:
        choices.append(strip_to_null(fallback))
    return F.coalesce(*choices)


def entity_label(
    peer_type: Column, title: Column, first_name: Column, last_name: Column, username: Column, external_id: Column
) -> Column:
    """Name shown for a live entity: people by their names, communities by title, then handle, then id."""
    person = peer_type.isin("user", "bot")
    name = blank_to_null(
        F.concat_ws(" ", F.when(first_name != "", first_name), F.when(last_name != "", last_name))
    )
    handle = F.when(username != "", F.concat(F.lit("@"), username))
    return F.coalesce(
        F.when(person, name).otherwise(F.when(title != "", title)), handle, external_id.cast("string")
    )


def node_title(kind: Column, label: Column, username: Column, external_id: Column, date: Column) -> Column:
    """Title of a graph node; messages show their day as an ISO date."""
    shown, handle = strip_to_null(label), strip_to_null(username)
    image = F.coalesce(F.concat(F.lit("Shared · "), shown), F.lit("Shared image"))
    at = F.when(handle.startswith("@"), handle).otherwise(F.concat(F.lit("@"), handle))
    return (
        F.when(kind == "message", F.date_format(date, "yyyy-MM-dd"))
        .when(kind == "image", image)
        .otherwise(F.coalesce(shown, at, external_id.cast("string")))
    )


def canonical_handle(c: Column) -> Column:
    return F.nullif(F.ltrim(strip(c), F.lit("@")), F.lit(""))


def _keep_first(rows: Column, key) -> Column:
    """Drop later elements whose key was seen; keeps order. Handles per peer are a handful."""
    empty = F.filter(rows, lambda r: F.lit(False))
    return F.aggregate(
        rows,
        empty,
        lambda acc, r: F.when(F.exists(acc, lambda seen: key(seen) == key(r)), acc).otherwise(
            F.concat(acc, F.array(r))
        ),
    )


def usernames(primary: Column, extra: Column) -> Column:
    """Handles of a peer: the primary first, then the others in order, each once ignoring case."""
    main = canonical_handle(primary)
    listed = F.transform(
        F.coalesce(extra, F.array().cast("array<struct<username:string,active:boolean,editable:boolean>>")),
        lambda h: F.struct(
            canonical_handle(h["username"]).alias("username"),
            h["active"].alias("active"),
            h["editable"].alias("editable"),
        ),
    )
    listed = _keep_first(
        F.filter(listed, lambda h: h["username"].isNotNull()), lambda h: F.lower(h["username"])
    )
    same = F.filter(listed, lambda h: F.lower(h["username"]) == F.lower(main))
    head = F.when(
        F.size(same) > 0,
        F.transform(
            same,
            lambda h: F.struct(
                h["username"].alias("username"),
                F.coalesce(h["active"], F.lit(True)).alias("active"),
                h["editable"].alias("editable"),
            ),
        ),
    ).otherwise(
        F.array(
            F.struct(
                main.alias("username"), F.lit(True).alias("active"), F.lit(None).cast("boolean").alias("editable")
            )
        )
    )
    rest = F.filter(listed, lambda h: F.lower(h["username"]) != F.lower(main))
    return F.when(main.isNotNull(), F.concat(head, rest)).otherwise(listed)


def usernames_csv(handles: Column) -> Column:
    names = F.filter(
        F.transform(handles, lambda h: canonical_handle(h["username"])), lambda n: n.isNotNull()
    )
    return F.coalesce(F.array_join(_keep_first(names, F.lower), ";"), F.lit(""))


def clean_restrictions(reasons: Column) -> Column:
    def part(entry: Column, name: str) -> Column:
        return F.coalesce(strip_to_null(entry[name]), F.lit("")).alias(name)

    rows = F.transform(reasons, lambda e: F.struct(part(e, "platform"), part(e, "reason"), part(e, "text")))
    return F.filter(rows, lambda e: (e["platform"] != "") | (e["reason"] != "") | (e["text"] != ""))


def restriction_csv(reasons: Column) -> Column:
    def chunk(entry: Column) -> Column:
        head = F.concat_ws(":", F.nullif(entry["platform"], F.lit("")), F.nullif(entry["reason"], F.lit("")))
        text = entry["text"]
        return (
            F.when((text == "") | F.contains(head, text), head)
            .when(head != "", F.concat(head, F.lit(": "), text))
            .otherwise(text)
        )

    parts = F.filter(F.transform(clean_restrictions(reasons), chunk), lambda p: p != "")
    return F.coalesce(F.array_join(parts, "; "), F.lit(""))
