"""Perspective rotation of multi-party dialogues, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the others as
users under their names; a mask names the code points that the assistant is trained on: its own texts and the closing
marks after them.  System turns are context for all and nobody's perspective.

The rendering of a whole conversation is one text for each perspective.  A very long one comes in several rows, in the
order of ``part`` and ``piece``: a part has ``span`` turn numbers, a piece at most ``span`` turns of a part (turn numbers
may repeat), so no row holds more of one conversation than that.  ``start`` is the place of a row's text in the whole, and
the texts joined in order are the whole: nothing is left out between rows.  Participants are those of the whole
conversation.

Defined cases: a null role speaks as "unknown"; a null text is empty; a null turn comes first (part -1); turns with
equal numbers follow role, then text; repeated rows are rendered as often; rows with a null conversation id form one
conversation; a conversation of system turns alone gives no rows; the marks' opening "<|" inside a text or a role is
written "< |"; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


SYSTEM, ASSISTANT, USER = "<|system|>\n", "<|assistant|>\n", ("<|user name=", "|>\n")


def _lengths(parts: DataFrame) -> DataFrame:
    """For each row of ``parts`` and each speaker of its conversation, the place of the row's text in the whole."""
    turns = parts.select("conv_id", "part", "piece", F.explode(F.transform("said", lambda t: F.struct(t["role"].alias("role"), F.length(t["text"]).alias("n")))).alias("t"))
    told = turns.groupBy("conv_id", "part", "piece", F.col("t.role").alias("role")).agg(F.count("*").alias("turns"), F.sum("t.n").alias("chars"))
    as_user = sum(map(len, USER)) + F.length("role")
    head = F.when(F.col("role") == "system", len(SYSTEM)).otherwise(as_user)
    place = ["conv_id", "part", "piece"]
    plain = told.groupBy(*place).agg(F.sum(F.col("chars") + F.col("turns") * (head + len(END) + 1)).alias("length")).alias("l")
    own = told.where("role <> 'system'").select(*place, F.col("role").alias("speaker"), (F.col("turns") * (len(ASSISTANT) - as_user)).alias("more")).alias("o")
    speakers = own.select("conv_id", "speaker").distinct().alias("s")
    same = lambda a, b, *names: reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])
    pairs = plain.join(speakers, same("l", "s", "conv_id")).select("l.*", "s.speaker").alias("p")
    sized = pairs.join(own, same("p", "o", *place, "speaker"), "left").select("p.*", (F.col("length") + F.coalesce("more", F.lit(0))).alias("own_length"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return sized.select(*place, "speaker", F.coalesce(F.sum("own_length").over(before), F.lit(0)).cast("long").alias("start"))


def rotate(turns: DataFrame, *, span: int = 512) -> DataFrame:
    """One row for each conversation, part, piece and perspective: ``conv_id, part, piece, speaker, start, n_turns, n_own,
    text, mask``; the mask's places are within the row's text."""
    rows = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / span), F.lit(-1)).cast("long").alias("part"),
        F.struct("turn", _plain(F.coalesce("role", F.lit("unknown"))).alias("role"), _plain(F.coalesce("text", F.lit(""))).alias("text")).alias("said"),
    )
    # the window's exchange serves the aggregate too
    ranked = rows.withColumn("piece", F.floor((F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("said")) - 1) / span).cast("long"))
    parts = ranked.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list("said")).alias("said"))
    same = reduce(Column.__and__, [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("conv_id", "part", "piece")])
    pairs = parts.alias("p").join(_lengths(parts).alias("s"), same).select("p.*", "s.speaker", "s.start")

    def own(t: Column) -> Column:
        return (t["role"] == F.col("speaker")) & (t["role"] != "system")

    def head(t: Column) -> Column:
        return F.when(t["role"] == "system", F.lit(SYSTEM)).when(own(t), F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER[0]), t["role"], F.lit(USER[1])))

    pieces = F.transform("said", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), own(t).alias("own")))
    cut = pairs.select("conv_id", "part", "piece", "speaker", "start", pieces.alias("pieces"))
    # the place of each piece's body, then only the assistant's
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + 1).alias("at"),
            F.when(p["own"], F.array_append(a["spans"], F.concat_ws(":", (a["at"] + F.length(p["head"])).cast("string"), (a["at"] + F.length(p["head"]) + F.length(p["body"])).cast("string")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return cut.select(
        "conv_id", "part", "piece", "speaker", "start",
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.array_join(spans, ",").alias("mask"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS body,
         coalesce(CAST(floor(turn / 512) AS BIGINT), -1) AS part
  FROM conversations
), q AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, body) - 1) / 512) AS BIGINT) AS piece FROM t
), s AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), r AS (
  SELECT q.conv_id, q.part, q.piece, s.speaker, q.role = s.speaker AS own, q.body || '<|end|>' AS body,
         CASE WHEN q.role = 'system' THEN '<|system|>' WHEN q.role = s.speaker THEN '<|assistant|>' ELSE '<|user name=' || q.role || '|>' END || chr(10) AS head,
         row_number() OVER (PARTITION BY q.conv_id, q.part, q.piece, s.speaker ORDER BY q.turn NULLS FIRST, q.role, q.body) AS n
  FROM q JOIN s ON q.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, piece, speaker ORDER BY n) - 1 AS stop FROM r
), g AS (
  SELECT conv_id, part, piece, speaker, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
         string_agg(head || body || chr(10), '' ORDER BY n) AS text,
         coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY n) FILTER (WHERE own), '') AS mask
  FROM o GROUP BY conv_id, part, piece, speaker
)
SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY part, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM g
"""
