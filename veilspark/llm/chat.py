"""Operator 5: collapse of logged conversation snapshots, then rendering for chat training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


LANES = 4  # running sums of 40 bits each that make a prefix hash
_LANE = (1 << 40) - 1


def prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with i, the place in the conversation (from 1), n, its number of turns, and
    prefix, the rolling hash of the conversation up to the turn.

    Each turn is hashed with its place, and the hash rolls on by adding the next turn's, so equal hashes mean equal
    beginnings and a turn costs the same however many come before it. Null role and null text are values of their
    own, apart from empty ones.
    """
    said = F.sha2(F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), "role"), F.lit("-")), F.coalesce(F.concat(F.lit("="), "text"), F.lit("-"))), 256)
    order = Window.partitionBy("conv_id").orderBy("turn", "said", "role", "text")
    rows = turns.withColumn("said", said).withColumn("i", F.row_number().over(order))
    lanes = [F.xxhash64("said", "i", F.lit(lane)).bitwiseAND(F.lit(_LANE)) for lane in range(LANES)]
    for lane, h in enumerate(lanes):
        rows = rows.withColumn(f"l{lane}", h)
    upto = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = F.array(*[F.sum(f"l{lane}").over(upto) for lane in range(LANES)])
    return rows.select("conv_id", "role", "text", "i", F.count("*").over(Window.partitionBy("conv_id")).alias("n"), rolled.alias("prefix"))


def maximal(rows: DataFrame) -> DataFrame:
    """Of rows of prefixes() the conv_id of conversations that are no beginning of a longer one; of equal ones the
    smallest.

    Equal conversations meet in a minimum that is taken before the shuffle, and hashes of beginnings are made
    distinct before the anti-join, so a very common conversation or first turn is one key with one row.
    """
    one = rows.filter("i = n").groupBy("prefix").agg(F.min("conv_id").alias("conv_id"))
    shorter = rows.filter("i < n").select("prefix").distinct()
    return one.join(shorter, "prefix", "left_anti").select("conv_id")


def render(turns: Column) -> Column:
    """<|role|> line, text line for each turn; a null role reads unknown, a null text is empty."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))), "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered for each maximal conversation of turns (conv_id, turn, role, text).

    Turns go by number (null first), equal numbers by a hash of role and text; a repeated row is a turn said twice.
    Rows without conv_id belong to no conversation and are left out. Conversations may have any number of turns,
    of texts of any length; a conversation's rendering is one value. An empty table gives an empty result; other
    columns are left alone, whatever their names.
    """
    rows = prefixes(turns.select("conv_id", "turn", "role", "text").filter("conv_id is not null"))
    kept = rows.join(maximal(rows.select("conv_id", "i", "n", "prefix")), "conv_id", "left_semi")
    whole = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "role", "text"))).alias("turns"))
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), render(F.col("turns")).alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
with t as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first,
      sha256(concat_ws(chr(31), coalesce('=' || role, '-'), coalesce('=' || text, '-'))), role, text) as i,
    sha256(concat_ws(chr(31), coalesce('=' || role, '-'), coalesce('=' || text, '-'))) as said
  from conversations where conv_id is not null),
p as (select conv_id, i, string_agg(said, '' order by i) over (partition by conv_id order by i rows unbounded preceding) as beginning from t),
c as (
  select conv_id, count(*) as n_turns,
    string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' order by i) as rendered
  from t group by conv_id),
w as (select p.conv_id, beginning from p join c on c.conv_id = p.conv_id and p.i = c.n_turns),
o as (select beginning, min(conv_id) as conv_id from w group by beginning),
k as (select conv_id from o where beginning not in (select p.beginning from p join c on c.conv_id = p.conv_id and p.i < c.n_turns))
select conv_id, n_turns::bigint as n_turns, rendered from c where conv_id in (select conv_id from k)
"""
