"""Chat formatting with collapse of cumulative snapshots, in DataFrame functions alone.

Logged conversations often are snapshots: a later log repeats an earlier one and adds turns.  Each turn gets a rolling
hash of all turns up to it (128 bits: two exclusive-or sums of position-dependent hashes); a conversation whose whole
hash is the hash of a proper prefix of another one is left out by an anti-join, and of equal conversations the one with
the smallest id stays.  The rest is rendered.

Both joins are between distinct hashes, so a first turn that a third of all conversations share is one row in them.

Rows without conversation id belong to no conversation and are dropped; turns are ordered by (turn, role, text), nulls
first; a row that repeats another one of its conversation is one turn; a null role or text renders as empty but differs
from an empty one in the comparison.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), role, text and h1, h2: the rolling hashes of the turns up to this one."""
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).filter("conv is not null")
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    same = F.lag(F.struct("turn", "role", "text")).over(order).eqNullSafe(F.struct("turn", "role", "text"))
    once = rows.withColumn("again", same).filter(~F.col("again")).withColumn("pos", F.row_number().over(order))
    hashed = once.withColumn("a", _turn_hash(1)).withColumn("b", _turn_hash(2))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.withColumns({"h1": F.expr("bit_xor(a)").over(upto), "h2": F.expr("bit_xor(b)").over(upto)}).select("conv", "pos", "role", "text", "h1", "h2")


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", opening: str = "<|{}|>\n", closing: str = "<|end|>\n") -> DataFrame:
    """Maximal conversations: id, n_turns, n_copies (equal conversations, itself included) and text.

    opening: goes before a turn, with {} for its role; closing: goes after it.
    """
    all_turns = turns(conversations, conv_col, turn_col, role_col, text_col)
    size = F.count("*").over(Window.partitionBy("conv"))
    marked = all_turns.withColumn("n", size)
    whole = marked.filter("pos = n").groupBy("h1", "h2", "n").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    prefix = marked.filter("pos < n").select("h1", "h2", F.col("pos").cast("long").alias("n")).distinct()
    kept = whole.join(prefix, ["h1", "h2", "n"], "left_anti").select("conv", "copies")
    before, _, after = opening.partition("{}")
    line = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit(after), F.coalesce("text", F.lit("")), F.lit(closing))
    lined = all_turns.select("conv", "pos", line.alias("line"))
    chats = lined.join(kept, "conv").groupBy("conv", "copies").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return chats.select(F.col("conv").alias(conv_col), "n_turns", F.col("copies").alias("n_copies"), F.array_join(F.col("lines.line"), "").alias("text"))


#: The same for the table ``conversations`` in DuckDB; prefixes are compared as lists of turns.
ORACLE = """
WITH once AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
  FROM once GROUP BY conv_id
),
w AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, t FROM c GROUP BY t),
p AS (SELECT DISTINCT list_slice(t, 1, i) AS t FROM (SELECT t, unnest(range(1, len(t))) AS i FROM c))
SELECT c.conv_id, c.n_turns, w.n_copies, c.text
FROM w JOIN c USING (conv_id) WHERE w.t NOT IN (SELECT t FROM p)
"""
