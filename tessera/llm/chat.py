"""Multi-party perspective rotation of dialogues; DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once with that speaker as assistant, the other speakers
as named users, and a loss mask over the assistant's words (the closing mark included). Speakers with an instruction role keep
it and get no view of their own. Masks are spans of character offsets into the rendered view, so words that look like markup
can't move them.

A view comes in parts of PART_ROWS rows each, in the order of the dialogue: its text is the parts' texts one after the other, start
is where a part begins in it, and masks count from the beginning of the view. So a dialogue of any length is whole, and none is
gathered in one task. Most conversations have one part, grouped as they are. The rows of longer ones are counted by (turn, role,
text), put in order by ranges, numbered in each range and moved on by the rows of the ranges before: neither a hot conversation nor
a hot turn is sorted in one task.

Cases: null text is empty, null roles are speakers named "unknown", null turns come first, a null conv_id is a conversation of
its own, repeated rows are rendered as often as they occur, ties of turn go by role and text; a conversation of instructions
alone has no view; an empty table gives an empty result; very long texts are rendered whole; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Rows of one part.
PART_ROWS = 512
INSTRUCTIONS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _header(role: Column, perspective: Column) -> Column:
    name = F.when(role == perspective, F.lit("assistant")).when(role.isin(*INSTRUCTIONS), role).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(OPEN), name, F.lit("\n"))


def long_parts(turns: DataFrame, part_rows: int) -> DataFrame:
    """conv_id, part, turns of long conversations: every part's rows in order."""
    counted = turns.groupBy("conv_id", "turn", "role", "said").agg(F.count("*").alias("copies"))
    ranged = stored(counted.repartitionByRange("conv_id", "turn", "role", "said").withColumn("range", F.spark_partition_id()), "chat-ranges")
    sums = ranged.groupBy(F.col("conv_id").alias("of"), F.col("range").alias("of_range")).agg(F.sum("copies").alias("rows"))
    # One row a range and conversation.
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("of").orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(sums.select("of", "of_range", before.alias("offset")), "chat-offsets")
    in_range = Window.partitionBy("range", "conv_id").orderBy("turn", "role", "said").rowsBetween(Window.unboundedPreceding, 0)
    numbered = ranged.withColumn("up_to", F.sum("copies").over(in_range)).join(offsets, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")))
    end = F.col("offset") + F.col("up_to")
    placed = numbered.withColumn("first", end - F.col("copies")).withColumn("end", end)
    parts = placed.withColumn("part", F.explode(F.sequence(F.floor(F.col("first") / part_rows), F.floor((F.col("end") - 1) / part_rows))))
    here = F.least("end", (F.col("part") + 1) * part_rows) - F.greatest("first", F.col("part") * part_rows)
    row = F.struct("turn", "role", "said", here.cast("int").alias("copies"))
    lists = parts.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    each = F.flatten(F.transform("rows", lambda r: F.array_repeat(F.struct(r["turn"].alias("turn"), r["role"].alias("role"), r["said"].alias("said")), r["copies"])))
    return lists.select("conv_id", "part", each.alias("turns"))


def rendered(views: DataFrame) -> DataFrame:
    """conv_id, perspective, part, start, n_turns, text, mask of views with their turns."""
    pieces = F.transform("turns", lambda t: F.struct(_header(t["role"], F.col("perspective")).alias("head"), F.concat(t["said"], F.lit(CLOSE)).alias("body"), (t["role"] == F.col("perspective")).alias("own")))
    first = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        begin = acc["at"] + F.length(piece["head"])
        end = begin + F.length(piece["body"])
        spans = F.when(piece["own"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    text = F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))))
    mask = F.aggregate("pieces", first, step, lambda acc: acc["spans"])
    return views.withColumn("pieces", pieces).select("conv_id", "perspective", "part", "start", F.size("turns").alias("n_turns"), text.alias("text"), mask.alias("mask"))


def perspectives(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """conv_id, perspective, part, start, n_turns, text, mask (array of start and end offsets in the view)."""
    turns = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), F.coalesce(text, F.lit("")).alias("said"))
    long = stored(turns.groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("rows")).where(F.col("rows") > part_rows).select("of"), "chat-long")
    is_long = F.col("conv_id").eqNullSafe(F.col("of"))
    speakers = turns.where(~F.col("role").isin(*INSTRUCTIONS)).select(F.col("conv_id").alias("who"), F.col("role").alias("perspective")).distinct()
    of_view = F.col("conv_id").eqNullSafe(F.col("who"))

    short = turns.join(long, is_long, "left_anti").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "said"))).alias("turns"))
    whole = short.join(speakers, of_view).select("conv_id", "perspective", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("start"), "turns")

    parts = stored(long_parts(turns.join(long, is_long, "left_semi"), part_rows), "chat-parts")
    views = parts.join(speakers, of_view).select("conv_id", "perspective", "part", "turns")
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.length(_header(t["role"], F.col("perspective"))) + F.length(t["said"]) + len(CLOSE) + 1)
    # One row a part and view.
    before = F.coalesce(F.sum("size").over(Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = views.select("conv_id", "perspective", "part", size.alias("size")).select(F.col("conv_id").alias("who"), F.col("perspective").alias("by"), F.col("part").alias("nth"), before.alias("start"))
    begun = views.join(starts, of_view & (F.col("perspective") == F.col("by")) & (F.col("part") == F.col("nth"))).select("conv_id", "perspective", "part", "start", "turns")
    return rendered(whole).unionByName(rendered(begun))


#: The same views in DuckDB SQL, with the mask as text.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1)::BIGINT AS place
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
pieces AS (
  SELECT t.conv_id, s.perspective, t.place, t.place // {PART_ROWS} AS part, t.role,
         '{OPEN}' || CASE WHEN t.role = s.perspective THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || t.role END || chr(10) AS head,
         t.said || '{CLOSE}' AS body
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, (sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS after
  FROM pieces)
SELECT conv_id, perspective, part, min(after - 1 - length(body) - length(head))::BIGINT AS start, count(*)::INT AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY place) AS text,
       coalesce(string_agg((after - 1 - length(body))::BIGINT || '-' || (after - 1)::BIGINT, ',' ORDER BY place) FILTER (WHERE role = perspective), '') AS mask
FROM placed GROUP BY conv_id, perspective, part"""
