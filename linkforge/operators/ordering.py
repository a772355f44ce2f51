"""Winners per key by a total order. Every choice is an aggregate (max_by, min_by), so partial aggregation
reduces hot keys before the shuffle; no window sorts a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkforge.runtime import checkpointed

ORDER = "_ord"


def with_order(df: DataFrame, *by: Column) -> DataFrame:
    """Add the source order: the given columns, or the order of the scan."""
    return df.withColumn(ORDER, F.struct(*by) if by else F.monotonically_increasing_id())


def row_numbers(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` with an exact rank from 1 as column ``name``: a range partitioning by the order, and offsets per
    partition, so that no task holds all rows."""
    ranged = df.withColumn("_order", order).repartitionByRange("_order").sortWithinPartitions("_order").withColumn("_id", F.monotonically_increasing_id())
    ranged = checkpointed(ranged.drop("_order"))  # the counts and the rows must see the same partitions
    part = F.shiftright("_id", 33)
    counts = ranged.select(part.alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each partition
    out = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_start")


def _pick(df: DataFrame, keys: list[Column], rank: Column, lowest: bool) -> DataFrame:
    names = [f"_k{i}" for i in range(len(keys))]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    choose = F.min_by if lowest else F.max_by
    best = df.select(*[k.alias(n) for k, n in zip(keys, names)], row.alias("_row"), rank.alias("_rank"))
    return best.groupBy(*names).agg(choose("_row", "_rank").alias("_row")).select("_row.*")


def first_wins(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """The row of least ``order`` per key; NULL is a key value like any other. ``order`` must be total."""
    return _pick(df, keys, order, lowest=True)


def last_wins(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """The row of greatest ``order`` per key."""
    return _pick(df, keys, order, lowest=False)


def best_by(df: DataFrame, keys: list[Column], rank: Column, order: Column) -> DataFrame:
    """The row of greatest ``rank`` per key, of least ``order`` among equals (order: a number)."""
    return _pick(df, keys, F.struct(rank, (-order)), lowest=False)


def strict_majority(df: DataFrame, keys: list[str], vote: Column) -> DataFrame:
    """Per key the vote that more than half of the non-NULL votes agree on: keys, winner, votes, total.

    Keys without such a vote have a NULL winner; ties have no majority, so order does not matter."""
    counts = df.select(*keys, vote.alias("_vote")).where("_vote is not null").groupBy(*keys, "_vote").agg(F.count(F.lit(1)).alias("n"))
    agg = [F.max_by("_vote", F.struct("n", "_vote")).alias("winner"), F.max("n").alias("votes"), F.sum("n").alias("total")]
    out = counts.groupBy(*keys).agg(*agg) if keys else counts.agg(*agg)
    return out.withColumn("winner", F.when(2 * F.col("votes") > F.col("total"), F.col("winner")))


def merged_people(df: DataFrame, keys: list[str], name: str = "name", confidence: str = "confidence", order: str = "pos", excluded: Column | None = None, most: int | None = None) -> DataFrame:
    """Per key and lower-cased name the person of highest confidence (first among equals), as an array of
    structs by falling confidence, then name. ``excluded`` is an array of lower-cased names to leave out."""
    df = df if excluded is None else df.where(~F.coalesce(F.array_contains(excluded, F.lower(name)), F.lit(False)))
    best = best_by(df, [*[F.col(k) for k in keys], F.lower(F.col(name))], F.col(confidence), F.col(order))
    rest = [c for c in best.columns if c not in keys]
    ranked = F.sort_array(F.collect_list(F.struct((-F.col(confidence)).alias("_c"), F.lower(name).alias("_n"), F.struct(*rest).alias("p"))))
    people = F.transform(ranked, lambda x: x["p"])
    return best.groupBy(*keys).agg((F.slice(people, 1, most) if most else people).alias("people"))
