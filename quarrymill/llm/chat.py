"""Chat formatting with cumulative-snapshot collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import discard, materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def format_chats(turns: DataFrame, trained_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, n_turns, text, spans) of every maximal conversation: one that no logged conversation continues.

    Logs hold snapshots of a conversation as it grows.  A rolling hash of position, role and text (two 64-bit sums by
    exclusive or, so a prefix's hash is a running aggregate) names each prefix; a conversation whose whole hash is a
    proper prefix of another is dropped by an anti-join; of equal conversations the smallest id stays.
    The rest is rendered turn by turn; spans are (start, length) in code points of what the trained role says.

    Turns are ordered by turn (nulls first), then role and text, both where prefixes are hashed and where turns are
    rendered; turns that repeat one in all three count once.
    Null roles and texts are empty.  Rows without a conversation id belong to none and are left out.
    Other columns are not read.  An empty table gives an empty result.

    Hashes are joined after being reduced to distinct ones, so a first turn or a conversation that a third of the log
    shares is one row there.  One conversation is one row of the result, so its turns meet in one task: its rendered
    text is the only thing here that grows with a single id.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    whole_conv = Window.partitionBy("conv")
    said = rows.distinct().withColumn("pos", F.row_number().over(order)).withColumn("n", F.count("*").over(whole_conv))
    hashed = said.select("conv", "pos", "n", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(1), "role").alias("b"))
    placed = materialize(hashed, "chat-turns")
    order = Window.partitionBy("conv").orderBy("pos")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    prefixes = placed.select(
        "conv", "pos", "n", F.bit_xor(F.xxhash64("pos", "a", "b")).over(up_to).alias("h1"), F.bit_xor(F.xxhash64("b", "a", "pos")).over(up_to).alias("h2")
    )
    prefixes = materialize(prefixes, "chat-prefixes")
    whole = materialize(prefixes.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv")), "chat-whole")
    proper = materialize(prefixes.where("pos < n").select(F.col("pos").alias("p"), F.col("h1").alias("p1"), F.col("h2").alias("p2")).distinct(), "chat-proper")
    kept = whole.join(proper, (F.col("n") == F.col("p")) & (F.col("h1") == F.col("p1")) & (F.col("h2") == F.col("p2")), "left_anti")
    kept = materialize(kept.select(F.col("conv").alias("kept_conv"), "n"), "chat-kept")
    discard(placed, prefixes, whole, proper)
    said = rows.join(kept, F.col("conv") == F.col("kept_conv"), "left_semi")
    gathered = said.groupBy("conv").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("turn", "role", "text")))).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"))
    piece = lambda t: F.concat(head(t), t["text"], F.lit(CLOSE + "\n"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    walked = F.aggregate(
        "turns",
        start,
        lambda acc, t: F.struct(
            (acc["at"] + F.length(piece(t))).alias("at"),
            F.when(t["role"] == trained_role, F.array_append(acc["spans"], F.struct((acc["at"] + F.length(head(t))).cast("long").alias("start"), F.length(t["text"]).cast("long").alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return gathered.select(F.col("conv").alias(conv_col), F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", piece), "").alias("text"), walked.alias("spans"))


ORACLE = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(md5(role || chr(31) || text), '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS h
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), whole AS (SELECT h, min(conv_id) AS conv_id FROM p WHERE pos = n GROUP BY h),
kept AS (SELECT conv_id FROM whole WHERE h NOT IN (SELECT h FROM p WHERE pos < n))
SELECT conv_id, count(*) AS n_turns,
  string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10), '' ORDER BY pos) AS text,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS n_trained_chars
FROM p JOIN kept USING (conv_id) GROUP BY conv_id
"""
