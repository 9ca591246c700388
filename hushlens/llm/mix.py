"""Mixing sources to target weights along a time-varying curriculum.

Every source s has a weight schedule w_s(t) on training time t in [0, 1]: linear from (1 + tilt) * share to (1 - tilt) * share,
so its integral is the target share for any tilt. Its cumulative token demand is D_s(t) = budget * integral of w_s from 0 to t.
The records of a source, in hash order and repeated as often as demand asks for and the cap allows, lie one after another on a
token axis; a record that begins at token c gets the position t with D_s(t) = c, found by inverting the quadratic. Records that
begin beyond the demand of t = 1 are not chosen. The chosen records of all sources are range-sorted by position.

No source is summed in one task: records fall by hash into blocks, block totals are added up, and the running sum inside a
block starts from the total before it. The number of blocks follows the number of rows. A source is short if the records
chosen for it, all of them as often as allowed, end before its demand does.

Spellings of a source are united by dropping case, outer blanks and the kind of separator. Defined results: rows with null
source or with a source that has no target count towards the total size but are never chosen; null or empty texts have 0
tokens and are chosen like others while demand lasts; null target or cap counts as 0; equal hashes are ordered by id; an
empty table reports 0 tokens and null shares for every source.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKENIZERS, cut_lineage, small_side, spread
from .tokens import VOCABULARY, token_count

MAX_SOURCES = 10_000


def source_key(source: Column) -> Column:
    """One spelling of a source's name."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"[\s _-]+", " "))), " ", "_")


def sized(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """_key, _source, tokens of every row; checkpointed, because the totals and the choice both need it."""
    rows = spread(df.select(F.col(key).alias("_key"), source_key(F.col(source)).alias("_source"), F.col(text).alias("_text")), F.xxhash64("_key", "_text"))
    return cut_lineage(rows.select("_key", "_source", token_count(F.col("_text"), folder, vocabulary).cast("long").alias("tokens")))


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target_share, max_repeats, total size of all rows (budget), own size, rows, demand, repeats needed."""
    own = sizes.groupBy("_source").agg(F.sum("tokens").alias("own_tokens"), F.count(F.lit(1)).alias("n_rows"))
    goal = targets.select(F.col("source"), source_key(F.col("source")).alias("_source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    budget = own.agg(F.sum("own_tokens")).first()[0] or 0
    out = goal.join(own, "_source", "left").withColumn("budget", F.lit(budget).cast("long"))
    out = out.withColumns({"own_tokens": F.coalesce("own_tokens", F.lit(0)), "n_rows": F.coalesce("n_rows", F.lit(0)), "demand": F.col("target_share") * F.col("budget")})
    needed = F.when(F.col("own_tokens") > 0, F.ceil(F.col("demand") / F.col("own_tokens"))).otherwise(0)
    return out.withColumn("repeats", F.least(needed, F.col("max_repeats")).cast("int"))


def position(c: Column, share: Column, budget: Column, tilt: float) -> Column:
    """The t in [0, 1] with budget * share * ((1 + tilt) * t - tilt * t^2) = c."""
    x = F.try_divide(c, budget * share)
    return x if tilt == 0 else F.least(F.lit(1.0), ((1 + tilt) - F.sqrt(F.greatest(F.lit(0.0), (1 + tilt) ** 2 - 4 * tilt * x))) / (2 * tilt))


def mix(df: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", tilt: dict[str, float] | None = None, block_rows: int = 10_000, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The chosen records (key, source, repeat, tokens, position), range-sorted by position, and the report of shares.

    targets: source, target_share, max_repeats; at most MAX_SOURCES rows. tilt, by source, within [-1, 1]: positive puts a
    source early, negative late.
    """
    sizes = sized(df, key=key, text=text, source=source, folder=folder, vocabulary=vocabulary)
    goals = cut_lineage(plan(sizes, targets).coalesce(1))
    rows = sizes.count()
    blocks = max(1, -(-rows // max(block_rows, isqrt(rows))))
    rows = sizes.join(small_side(goals.select("_source", "source", "target_share", "budget", "demand", "own_tokens", "repeats"), MAX_SOURCES), "_source")
    rows = rows.withColumn("_turn", F.xxhash64("_key", F.lit(7))).withColumn("_block", F.floor(F.col("_turn") / F.lit(2.0**64 / blocks)))
    totals = rows.groupBy("_source", "_block").agg(F.sum("tokens").alias("_sum"))
    # A source has at most the square root of the rows in blocks, and a block of it about as many rows: no window grows beyond.
    before = totals.select("_source", "_block", (F.sum("_sum").over(Window.partitionBy("_source").orderBy("_block")) - F.col("_sum")).alias("_before"))
    inside = F.sum("tokens").over(Window.partitionBy("_source", "_block").orderBy("_turn", "_key", "tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    placed = rows.withColumn("_inside", inside).join(before, ["_source", "_block"]).withColumn("_start", F.col("_before") + F.col("_inside"))
    placed = placed.where(F.col("repeats") > 0).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    placed = placed.withColumn("_start", F.col("_start") + (F.col("repeat") - 1) * F.col("own_tokens")).where(F.col("_start") < F.col("demand"))
    at = position(F.col("_start"), F.col("target_share"), F.col("budget"), 0.0)
    for name, slope in (tilt or {}).items():
        at = F.when(F.col("source") == name, position(F.col("_start"), F.col("target_share"), F.col("budget"), slope)).otherwise(at)
    chosen = placed.select(F.col("_key").alias(key), "source", "repeat", "tokens", at.alias("position"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = chosen.repartitionByRange(parts, "position", key, "repeat").sortWithinPartitions("position", key, "repeat")
    used = chosen.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count(F.lit(1)).alias("used_records"), F.max("repeat").alias("most_repeats"))
    report = goals.join(used, "source", "left").withColumns({"used_tokens": F.coalesce("used_tokens", F.lit(0)), "used_records": F.coalesce("used_records", F.lit(0)), "most_repeats": F.coalesce("most_repeats", F.lit(0))})
    report = report.withColumn("short", F.col("used_tokens") < F.col("demand"))  # the records chosen do not reach to the end of the demand
    report = report.withColumns({"share_of_budget": F.try_divide("used_tokens", "budget"), "share_reached": F.try_divide("used_tokens", F.sum("used_tokens").over(Window.partitionBy(F.lit(0))))})
    return ordered, report.select("source", "target_share", "max_repeats", "budget", "own_tokens", "n_rows", "demand", "short", "used_tokens", "used_records", "most_repeats", "share_of_budget", "share_reached")
