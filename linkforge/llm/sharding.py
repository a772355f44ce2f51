"""K-d tree sharding (operator 4), in DataFrame expressions only.

The tree splits the whole table into leaves of near-equal bytes, as many as a target size or a number of shards
asks for. A node with k leaves is cut along its widest metadata dimension (source, language or size, each scaled
by its range over the table; strings count as their rank among the table's distinct values) so that one side gets
the bytes of floor(k / 2) leaves. The cut is an exact weighted quantile: histograms of a fixed number of buckets
narrow on the dimension's whole values, then among documents of one value on a hash, until the cut falls between
two documents. So a source that holds a third of all rows is cut like any other. Each level is checkpointed. Only
bucket positions of cuts reach the driver; each level's cuts, at most one for each leaf, go back as a table of
literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from linkforge.runtime import checkpointed

DIMENSIONS = ("source", "lang", "size")
#: Bits of the hash that orders documents of one value; bits resolved by each histogram.
HASH_BITS, STEP_BITS = 36, 14
#: Rows of one shard that one task numbers; distinct values that may be broadcast.
SLOT_ROWS, BROADCAST_VALUES = 100_000, 200_000


@dataclass
class Node:
    """A part of the table on its way to be cut: ``leaves`` shards from ``shard`` on, named by that shard."""

    shard: int
    leaves: int
    dim: int = 0
    low: int = 0
    #: What the lower side shall weigh, and what lies below the cut's bucket.
    goal: float = 0.0
    before: float = 0.0
    #: The cut's bucket: values from ``at`` on; once the value is known, hashes from ``tie`` on (-1: not yet).
    at: int = 0
    tie: int = -1
    #: Bits that are still open.
    bits: int = 0


def _literals(spark: SparkSession, nodes: list[Node]) -> DataFrame:
    """A broadcast table of cuts, one row for each node."""
    rows = ", ".join(f"({n.shard}, {n.dim}, {n.low}L, {n.goal!r}D, {n.before!r}D, {n.at}L, {n.tie}L, {max(n.bits - STEP_BITS, 0)}, {n.shard + n.leaves // 2})" for n in nodes)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS t(node, dim, low, goal, before, at, from, shift, above)"))


def _coded(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a string column replaced by its rank among the distinct values; null is -1, before all others.

    Ranks are exact: a range partitioning of the distinct values, and offsets per partition."""
    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = checkpointed(values.repartitionByRange(column).sortWithinPartitions(column).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = ranged.select(part.alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each partition
    ranks = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part").select(column, (F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("_rank"))
    ranks = F.broadcast(ranks) if ranged.count() <= BROADCAST_VALUES else ranks
    return rows.join(ranks, column, "left").withColumn(column, F.coalesce("_rank", F.lit(-1).cast("long"))).drop("_rank")


#: A row's place along its node's dimension.
_VALUE = "dims[dim] - low"


def _cut(rows: DataFrame, nodes: list[Node]) -> None:
    """Find each node's weighted quantile by narrowing histograms."""
    undecided = nodes
    while undecided:
        frame = rows.select("node", "dims", "tie", "size").join(_literals(rows.sparkSession, undecided), "node")
        inside = F.expr(f"from < 0 or {_VALUE} = at")
        bucket = F.expr(f"shiftright(if(from < 0, {_VALUE} - at, tie - from), shift)")
        histogram = (
            frame.where(inside).select("node", "goal", "before", bucket.alias("bucket"), "size").where(F.col("bucket").between(0, (1 << STEP_BITS) - 1))
            .groupBy("node", "goal", "before", "bucket").agg(F.sum("size").cast("double").alias("weight"), F.count(F.lit(1)).alias("n"))
        )
        upto = F.sum("weight").over(Window.partitionBy("node").orderBy("bucket")) + F.col("before")  # a row for each bucket at most
        crossing = histogram.withColumn("upto", upto).where("upto >= goal")
        found = crossing.groupBy("node").agg(F.min_by(F.struct("bucket", "upto", "weight", "n"), "bucket").alias("b")).collect()  # a row for each node at most
        seen, going = {r.node: r.b for r in found}, []
        for n in undecided:
            if (b := seen.get(n.shard)) is None:  # nothing is left there
                continue
            n.bits = max(n.bits - STEP_BITS, 0)
            n.before = b.upto - b.weight
            if n.tie < 0:
                n.at += b.bucket << n.bits
            else:
                n.tie += b.bucket << n.bits
            if b.n > 1 and n.bits:
                going.append(n)
            elif b.n > 1 and n.tie < 0:  # the value is known: its documents are told apart by hash
                n.tie, n.bits = 0, HASH_BITS
                going.append(n)
            elif n.goal - n.before > b.upto - n.goal:  # one document, or equal hashes: it goes to the nearer side
                if n.tie < 0:
                    n.at += 1 << n.bits
                else:
                    n.tie += 1 << n.bits
        undecided = going


def kd_shards(docs: DataFrame, shards: int | None = 24, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row; the law is ``bytes``.

    size is the text's UTF-8 bytes (null: none) plus 8. Shards 0 to ``shards`` - 1 hold near-equal bytes:
    each cut is off by half a document at most. With ``target_bytes`` there are as many shards as keep their
    mean at or below it. Slots number a shard's rows from 0 without gaps, in the order of a hash of doc_id
    (where doc_ids repeat, of doc_id and the row's place in the scan, so that such rows can be cut apart too).
    Null source or language sorts first; null texts weigh 8; repeated rows are separate rows; a null doc_id is a
    value like any other. Other columns are ignored; a missing source or language column counts as null. An empty
    table gives an empty result; with fewer rows than shards some shards stay empty.
    """
    spark, text = docs.sparkSession, F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    has = set(docs.columns)
    size = (F.octet_length(text) + 8).cast("long")
    named = [c for c in DIMENSIONS if c != "size"]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"),
        *[(F.col(c) if c in has else F.lit(None)).cast("string").alias(c) for c in named],
    )
    repeats = not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    rows = checkpointed(rows.withColumn("hash", F.xxhash64("doc_id", F.monotonically_increasing_id()) if repeats else F.xxhash64("doc_id")))
    for c in named:
        rows = _coded(rows, c)
    tie = F.col("hash").bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    placed = checkpointed(rows.select("doc_id", "size", "text_crc32", "hash", F.array(*DIMENSIONS).alias("dims"), tie.alias("tie"), F.lit(0).alias("node")))
    columns, spans, buckets, nodes = placed.columns, None, 1, None
    while nodes is None or (nodes := [n for n in nodes if n.leaves > 1]):
        ends = [f(F.col("dims")[i]).alias(f"{k}{i}") for i in range(len(DIMENSIONS)) for k, f in (("low", F.min), ("high", F.max))]
        stats = placed.groupBy("node").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), *ends)
        seen = {r.node: r for r in stats.collect()}  # a row for each node at most
        if not seen:
            break
        width = lambda r, i: r[f"high{i}"] - r[f"low{i}"]
        if nodes is None:
            leaves = max(1, -(-seen[0].bytes // target_bytes)) if target_bytes else shards
            nodes, spans = [Node(0, leaves)], [width(seen[0], i) or 1 for i in range(len(DIMENSIONS))]
            buckets = max(64, -(-seen[0].n // (leaves * SLOT_ROWS)))
            if leaves == 1:
                break
        for n in nodes:
            if r := seen.get(n.shard):
                n.dim = max(range(len(DIMENSIONS)), key=lambda i: width(r, i) / spans[i])
                n.low, n.goal, n.bits = r[f"low{n.dim}"], float(r.bytes) * (n.leaves // 2) / n.leaves, width(r, n.dim).bit_length()
        _cut(placed, nodes)
        below = F.expr(f"at is null or {_VALUE} < at or ({_VALUE} = at and tie < from)")
        side = F.when(below, F.col("node")).otherwise(F.col("above"))
        placed = checkpointed(placed.join(_literals(spark, nodes), "node", "left").select(*[side.alias(c) if c == "node" else F.col(c) for c in columns]))
        nodes = [x for n in nodes for x in (Node(n.shard, n.leaves // 2), Node(n.shard + n.leaves // 2, n.leaves - n.leaves // 2))]
    placed = placed.select("doc_id", "size", "text_crc32", "hash", F.col("node").alias("shard")).withColumn("part", F.pmod(F.shiftright("hash", 20), F.lit(buckets)))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("offset"))
    inner = F.row_number().over(Window.partitionBy("shard", "part").orderBy("hash", "doc_id", "text_crc32")).cast("long") - 1
    return placed.withColumn("inner", inner).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("inner")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
