r"""Multi-party perspective rotation: one training example per conversation and participant.

Every role but ``system`` is a participant. For each of them the whole dialogue is rendered with that
speaker as the assistant and the others as users under their names; system turns stay system turns.
``mask`` lists the character spans [start, end) that a loss should cover: the assistant's own words
with the end mark, so that the model learns to stop.

Texts and names cannot forge a delimiter: a ``<`` before ``|`` or ``\`` gets a ``\`` behind it, which ``unescaped`` takes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.llm.common import table

START, MID, END = "<|start|>", "<|message|>", "<|end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(?=[|\\])", r"<\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(?=[|\\])", "<")


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, n_turns, n_own, n_chars, rendered, mask (array of struct(start, end)).

    Turns go by (turn, role, text), nulls first. A null role is a speaker of its own, null in ``speaker`` and a user without a name to
    others; a null text is empty; equal rows are turns of their own. A conversation of
    system turns alone has no participant and gives no row. A null conv_id is one conversation. Each
    row holds its dialogue whole, however long, up to the 2 GB of a Spark value; places are running sums taken once
    for a conversation, so work is in proportion to what is rendered.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = turns.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(escaped(F.coalesce("text", F.lit(""))), F.lit(END)).alias("body"),
        F.when(F.col("role") == "system", F.lit("system")).otherwise(F.concat(F.lit("user"), F.coalesce(F.concat(F.lit(" name="), escaped(F.col("role"))), F.lit("")))).alias("label"),
    )
    frame = len(START + MID)
    t = t.select("conv_id", "role", "label", "body", F.row_number().over(order).alias("at"), F.sum(F.length("label") + frame + F.length("body")).over(upto).alias("end"))
    whole = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "role", "label", "body", "end"))).alias("turns"))
    people = F.array_distinct(F.transform(F.filter("turns", lambda x: ~x["role"].eqNullSafe("system")), lambda x: F.struct(x["role"].alias("speaker"), F.length(x["label"]).alias("named"))))
    seen = whole.select("conv_id", "turns", F.explode(people).alias("p")).select("conv_id", "turns", "p.speaker", "p.named")
    seen = seen.withColumn("own", F.filter("turns", lambda x: x["role"].eqNullSafe(F.col("speaker"))))
    # the speaker's earlier turns are "assistant" here, not the label that the sums hold
    shift = lambda k: (k + 1) * (len("assistant") - F.col("named"))
    mask = F.transform("own", lambda x, k: F.struct((x["end"] + shift(k) - F.length(x["body"])).cast("long").alias("start"), (x["end"] + shift(k)).cast("long").alias("end")))
    label = lambda x: F.when(x["role"].eqNullSafe(F.col("speaker")), F.lit("assistant")).otherwise(x["label"])
    return seen.select(
        "conv_id",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.size("own").cast("long").alias("n_own"),
        (F.element_at("turns", -1)["end"] + F.size("own") * (len("assistant") - F.col("named"))).cast("long").alias("n_chars"),
        F.array_join(F.transform("turns", lambda x: F.concat(F.lit(START), label(x), F.lit(MID), x["body"])), "").alias("rendered"),
        mask.alias("mask"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``rotate``, with the mask written ``start:end,start:end``."""
    rows = rotate(table(spark, sf_dir, "conversations"))
    return rows.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ","))


def sql() -> str:
    escape = lambda x: rf"regexp_replace({x}, '<([|\\])', '<\\\1', 'g')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text, {escape("coalesce(text, '')")} || '{END}' AS body,
  CASE WHEN role = 'system' THEN 'system' WHEN role IS NULL THEN 'user' ELSE 'user name=' || {escape('role')} END AS label FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role IS DISTINCT FROM 'system'),
r AS (SELECT t.*, s.speaker, '{START}' || CASE WHEN role IS NOT DISTINCT FROM speaker THEN 'assistant' ELSE label END || '{MID}' AS head
  FROM t JOIN s ON s.conv_id IS NOT DISTINCT FROM t.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST, rid) AS stop FROM r)
SELECT conv_id, speaker, count(*)::BIGINT AS n_turns, (count(*) FILTER (role IS NOT DISTINCT FROM speaker))::BIGINT AS n_own, max(stop)::BIGINT AS n_chars,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST, rid) AS rendered,
  coalesce(string_agg((stop - length(body))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop) FILTER (role IS NOT DISTINCT FROM speaker), '') AS mask
FROM o GROUP BY conv_id, speaker"""
