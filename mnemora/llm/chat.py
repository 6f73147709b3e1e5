r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar::

    conversation := turn*
    turn         := "### " role ": " body "</turn>\n"

``### `` and ``</turn>`` are control strings; inside a role or body they count only without an
escaping backslash. A turn is first rendered as it is and parsed again by the same deterministic
parser; where the parse isn't identical to the source, its conflicting content is escaped
(``\`` -> ``\\``, ``### `` -> ``\### ``, ``</turn>`` -> ``<\/turn>``, in roles also ``: `` -> ``:\ ``).
The whole conversation is then parsed again, and anything but the source stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MID, END = "### ", ": ", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"


def _escape(text: Column) -> Column:
    for old, new in (("\\", "\\\\"), (HEAD, "\\" + HEAD), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit(MID), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(MID), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>``: the turns of a formatted conversation, unescaped.

    A turn that breaks the grammar becomes null, so that it never equals a source turn. Null gives null.
    """

    def turn(piece: Column) -> Column:
        at, body_end = F.instr(piece, MID), F.length(piece) - len(END)
        head, body = F.substring(piece, 1, at - 1), F.substring(piece, at + len(MID), body_end - at - len(MID) + 1)
        sound = (at > 0) & piece.endswith(END) & (
            at + len(MID) - 1 <= body_end
        ) & ~F.contains(body, F.lit("</turn>")) & ~F.contains(head, F.lit("</turn>"))
        return F.when(sound, F.struct(unescape(head).alias("role"), unescape(body).alias("text")))

    pieces = F.split(formatted, r"(?<!\\)### ", -1)
    turns = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    return F.when(F.element_at(pieces, 1) == "", turns).when(formatted.isNotNull(), F.array(F.lit(None).cast("struct<role:string,text:string>")))


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    r"""One row per conversation: ``conv_id, turns, pieces, formatted``.

    ``turns`` are the source turns in order of turn (ties by role, then text; null turns first; null
    roles and texts count as empty). ``pieces`` cut ``formatted`` into ``struct<text, loss>``: under the
    loss mask stands each body of ``loss_role``, still escaped, and nothing else. A null conv_id is a
    conversation of its own; repeated rows are repeated turns; no rows give no conversations.

    One shuffle by conv_id. Rendering, checking and escaping of turns happens before it, row by row;
    a conversation is one value of the result, so its turns meet in one task in any case.
    """
    empty = F.lit("")
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    source = F.array(F.struct("role", "text"))
    plain = parse(_render(F.col("role"), F.col("text"))) == source
    turns = turns.withColumn("plain", F.coalesce(plain, F.lit(False)))
    turns = turns.select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("plain"), F.col("role")).otherwise(_escape_role(F.col("role"))).alias("head"),
        F.when(F.col("plain"), F.col("text")).otherwise(_escape(F.col("text"))).alias("body"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("t"))

    def pieces(t: Column) -> Column:
        loss = t["role"] == loss_role
        opening = F.concat(F.lit(HEAD), t["head"], F.lit(MID))
        parts = lambda text, on: F.struct(text.alias("text"), F.lit(on).alias("loss"))
        return F.when(
            loss, F.array(parts(opening, False), parts(t["body"], True), parts(F.lit(END), False))
        ).otherwise(F.array(parts(F.concat(opening, t["body"], F.lit(END)), False)))

    shaped = grouped.select(
        "conv_id",
        F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        F.flatten(F.transform("t", pieces)).alias("pieces"),
        F.array_join(F.transform("t", lambda t: _render(t["head"], t["body"])), "").alias("formatted"),
    )
    same = F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False))
    checked = F.when(same, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("conversation doesn't parse back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    )
    return shaped.withColumn("formatted", checked)


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says, read back from it: turns by the parser, loss text from the mask."""
    turns = parse(F.col("formatted"))
    read = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
    found = formatted.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), read.alias("read"), loss.alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars")
    )
    hexed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.select(
        "conv_id", "n_turns", hexed("read").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        hexed("loss").alias("loss_sha256"), "formatted_chars"
    )


#: The digests, worked out from the source rows; lengths follow from the escaping rules alone.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role) + length(text) AS own,
         regexp_matches(role, '(?s)\\.') OR regexp_matches(text, '(?s)\\.') OR contains(role, '### ') OR contains(text, '### ')
           OR contains(role, '</turn>') OR contains(text, '</turn>') OR contains(role, ': ') AS escaped,
         length(role) + length(text) - length(replace(role, '\', '')) - length(replace(text, '\', ''))
           + (length(role) + length(text) - length(replace(role, '### ', '')) - length(replace(text, '### ', ''))) / 4
           + (length(role) + length(text) - length(replace(role, '</turn>', '')) - length(replace(text, '</turn>', ''))) / 7
           + (length(role) - length(replace(role, ': ', ''))) / 2 AS more
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(own + 14 + CASE WHEN escaped THEN more ELSE 0 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
