"""Benchmark decontamination (operator 3), in DataFrame expressions only: size-partitioned MinHash containment.

1. Texts become arrays of 5-word shingle hashes; documents fall into partitions by the power of two above
   their number of distinct shingles.
2. A document's signature is a one-permutation MinHash: hash space is cut into bins, four for each shingle
   of the partition's upper size, and each bin keeps its minimum. Long documents thus have long signatures
   and a short item is found in them as surely as in short ones: a shared shingle is a bin's minimum with
   a known probability of 0.88 or more. Minima that no item has go at once.
3. An item is indexed by its rarest shingles only, by how many documents have them as minima. It may lack a
   quarter of its shingles, so of that quarter and eight more at least eight are in any document that holds it;
   all eight escape the minima with probability below 4e-8 (2e-6 for items of eight shingles). A shingle that
   many items and documents have in common therefore makes no candidates, unless items have no others.
4. A candidate's containment is estimated from all of the item's shingles among the minima, and dropped if that
   is six standard deviations below what three quarters would give. The rest is verified on the
   shingles themselves: 4 * shared >= 3 * shingles of the item. Items below eight shingles are looked up
   with all shingles of a document instead of minima, and verified without estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkforge.llm import words
from linkforge.runtime import checkpointed

#: Words of a shingle; bins for each shingle as a power of two; items below this size skip the bins.
SHINGLE, BIN_BITS, SMALL_ITEM = 5, 2, 8
#: Shingles beyond those that an item may lack by which it is indexed; standard deviations that an estimate may be off.
SURPLUS, DEVIATIONS = 8, 6.0
#: Postings (24 bytes each), or numbers of documents, that may be broadcast.
BROADCAST_POSTINGS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), "")


def _starts(words: str) -> Column:
    """Where shingles begin: one for fewer than five words, none without words."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _hashes(words: str) -> Column:
    """Shingle hashes: words are hashed once, shingles from their words' hashes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    each = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
    one = F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= SHINGLE, each(h)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))
    return F.get(one, F.lit(0))


def _shingles(words: str) -> Column:
    """Distinct shingles; words hold no blank, so joining them by one is unambiguous."""
    return F.array_distinct(F.transform(_starts(words), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for every item of which a document holds three quarters or more.

    ``docs`` has doc_id and text, ``items`` item_id and text. Words are split at ASCII white space after A-Z
    are lower-cased; items under five words are one shingle; null, empty and blank texts contain nothing and
    are contained in nothing. Repeated rows of either side count once. Null ids are left out. Other columns
    are ignored. Empty tables give an empty result.
    """
    docs = words.id_and_text(docs).where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), word_array(F.col("text").cast("string")).alias("item_words")).where("item_id is not null and size(item_words) > 0")
    items = items.withColumn("item_shingles", F.array_sort(_shingles("item_words"))).dropDuplicates(["item_id", "item_shingles"]).withColumn("item_hashes", F.array_distinct(_hashes("item_words")))
    # items of equal sets are searched as one
    sets = checkpointed(items.groupBy("item_shingles").agg(F.first("item_hashes").alias("item_hashes")).withColumn("set_id", F.monotonically_increasing_id()).withColumn("n_item", F.size("item_shingles")))
    postings = checkpointed(sets.select("set_id", "n_item", F.explode("item_hashes").alias("h")))
    n_postings, n_small = postings.agg(F.count(F.lit(1)), F.count_if(F.col("n_item") < SMALL_ITEM)).first()

    def within(n: int, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n <= BROADCAST_POSTINGS else df

    prepared = docs.select("doc_id", word_array(F.col("text")).alias("words")).select("doc_id", F.array_sort(F.array_distinct(_hashes("words"))).alias("hs"))
    bits = F.ceil(F.log2(F.greatest(F.size("hs"), F.lit(1)))).cast("int") + BIN_BITS
    load = F.size("hs") / F.pow(F.lit(2.0), bits)  # shingles for each bin
    sized = prepared.select("doc_id", "hs", (F.lit(64) - bits).alias("shift"), F.when(load > 0, (1 - F.exp(-load)) / load).otherwise(F.lit(1.0)).alias("rate"))
    # sorted hashes of one bin stand together, so a bin's minimum is the first of its run
    if n_small:
        expr = "transform(hs, (x, i) -> struct(x as h, i = 0 or shiftrightunsigned(x, shift) != shiftrightunsigned(hs[greatest(i - 1, 0)], shift) as low))"
        probes = sized.select("doc_id", "rate", F.explode(F.expr(expr)).alias("e")).select("doc_id", "rate", "e.h", "e.low")
    else:
        expr = "filter(hs, (x, i) -> i = 0 or shiftrightunsigned(x, shift) != shiftrightunsigned(hs[greatest(i - 1, 0)], shift))"
        probes = sized.select("doc_id", "rate", F.explode(F.expr(expr)).alias("h")).withColumn("low", F.lit(True))
    known = postings.groupBy("h").agg(F.bool_or(F.col("n_item") < SMALL_ITEM).alias("small"))
    hits = checkpointed(probes.join(within(n_postings, known), "h").where("low or small").select("doc_id", "rate", "h", "low"))

    # rarest first; a shingle that no document has is rarest of all and counts among those that may be lacking
    seen = hits.where("low").groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy(F.coalesce("n_docs", F.lit(0)), "h"))  # one item's shingles
    lacking = F.col("n_item") - F.ceil(F.col("n_item") * 3 / 4)
    index = checkpointed(postings.join(seen, "h", "left").withColumn("rank", rank).where(F.col("rank") <= lacking + F.when(F.col("n_item") < SMALL_ITEM, 1).otherwise(SURPLUS)).select("h", "set_id", (F.col("n_item") < SMALL_ITEM).alias("small")))
    candidates = hits.join(within(n_postings, index), "h").where("low or small").select("doc_id", "set_id").distinct()

    minima = hits.where("low").groupBy("doc_id").agg(F.min("rate").alias("rate"), F.collect_set("h").alias("minima"))  # of one document
    judged = candidates.join(minima, "doc_id", "left").join(within(n_postings, sets.select("set_id", "n_item", "item_hashes")), "set_id")
    least = F.ceil(F.col("n_item") * 3 / 4)
    bound = least * F.col("rate") - DEVIATIONS * F.sqrt(least * F.col("rate") * (1 - F.col("rate")))
    likely = (F.col("n_item") < SMALL_ITEM) | (F.size(F.array_intersect("minima", "item_hashes")) >= bound)
    pairs = checkpointed(judged.where(likely).select("doc_id", "set_id"))

    n_pairs = pairs.count()
    ids = within(n_pairs, pairs.select("doc_id").distinct())
    held = docs.join(ids, "doc_id", "left_semi") if n_pairs <= BROADCAST_POSTINGS else docs
    found = held.join(pairs, "doc_id").select("doc_id", "set_id", word_array(F.col("text")).alias("words"))
    found = found.select("doc_id", "set_id", _shingles("words").alias("shingles")).join(within(n_postings, sets.select("set_id", "item_shingles")), "set_id")
    counted = found.select("doc_id", "item_shingles", F.size(F.array_intersect("shingles", "item_shingles")).alias("n_shared"), F.size("item_shingles").alias("n_item"))
    contained = counted.where("4 * n_shared >= 3 * n_item").join(items.select("item_id", "item_shingles"), "item_shingles")
    return contained.groupBy("doc_id", "item_id").agg(F.max("n_shared").cast("long").alias("n_shared"), F.max("n_item").cast("long").alias("n_item"))
