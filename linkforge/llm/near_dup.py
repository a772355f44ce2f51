"""MinHash near-dedup with b-bit signatures (operator 2).

1. One pass turns a text into its set of 5-word shingles, a 128-bit digest of the set, 32 band keys
   of four minima each, and a packed signature that keeps the low 4 bits of 128 minima.
2. Documents with equal sets collapse into one class by digest, so groups of copies of any size are
   one row from here on; partial aggregation absorbs them before the shuffle.
3. Classes that share a band key are candidates. A bucket yields pairs of its smallest member with the others
   only (never all pairs): a star. Bit counts over the packed signatures give the collision-corrected estimate,
   pairs well below the threshold are dropped, the rest are confirmed on their full sets by
   100 * intersection >= 75 * union. A star of any size is dealt out in pieces that each bring the
   smallest member along. A group of near copies mostly ends here, in work in proportion to its size.
4. A bucket is left over only if members other than the smallest are still in different components. Left-over
   buckets that share a component form chains, whose signatures alone are compared first, block against block: who
   has no likely partner in another component goes, and likely partners form clusters.
5. Clusters are searched breadth first on their full sets. All but small ones are cut into blocks and every pair of
   blocks is searched, so no link is lost and no task holds a cluster whole.

Two documents of similarity 0.75 share a band with probability 1 - (1 - 0.75^4)^32 = 1 - 5e-6.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from linkforge.llm import words
from linkforge.llm.components import connected
from linkforge.runtime import checkpointed, ship

HASHES, BANDS, ROWS, BITS = 128, 32, 4, 4
#: The estimate has a standard deviation of 0.04 at the threshold; pairs below it by six of these are dropped.
MARGIN = 0.25
#: Shingles in a block of a cluster: a sixth of it, but at least the first and at most the second.
LEAST_SHINGLES, BLOCK_SHINGLES = 50_000, 2_000_000
#: Signatures in a block of a chain: a fiftieth of it, within these bounds (100 bytes each).
CHAIN_BLOCK = (500, 100_000)
#: Shingles in a piece of a star.
STAR_SHINGLES = 20_000
#: Numbers of documents (8 bytes each) that may be broadcast to pick texts before they are shuffled.
BROADCAST_IDS = 500_000

_RNG = np.random.default_rng(20_240_229)
_MULT = (_RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def minima(shingles: np.ndarray, block: int = 1024) -> np.ndarray:
    """128 minima of a non-empty set, in blocks so that long texts need no more memory."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), block):
        part = short[None, at : at + block] * _MULT
        part += _ADD
        np.minimum(best, part.min(axis=1), out=best)
    return best


def packed(mins: np.ndarray) -> bytes:
    """The low 4 bits of each minimum, two to a byte."""
    low = (words.mix(mins.astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity of one packed signature to many from bit counts, corrected for chance agreement of 4-bit values."""
    differ = one[None, :] ^ others
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    unequal = np.bitwise_count(differ & np.uint64(0x1111111111111111)).sum(axis=1)
    agree, chance = 1.0 - unequal / HASHES, 1.0 / (1 << BITS)
    return (agree - chance) / (1.0 - chance)


def band_keys(mins: np.ndarray) -> list[int]:
    rows = mins.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(words.BASE)
    for j in range(ROWS):
        key = words.mix(key ^ (rows[:, j] + np.uint64(j << 33)))
    return key.view(np.int64).tolist()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch):
            n, digests, sigs, keys = [], [], [], []
            texts = words.raw_texts(part)
            for s in words.shingle_sets(texts):
                n.append(len(s))
                if not len(s):
                    digests.append(None), sigs.append(None), keys.append(None)
                    continue
                m = minima(s)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(np.frombuffer(packed(m), np.int64).tolist())
                keys.append(band_keys(m))
            crc = pa.array([zlib.crc32(t) for t in texts], pa.int64())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), crc, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, longs), pa.array(keys, longs)],
                names=["doc_id", "crc", "n", "digest", "sig", "bands"],
            )


def _likely(percent: int) -> Column:
    """Whether the sizes n, m and signatures sig, other of two sets allow a link: the estimate of ``estimates``."""
    nibbles = "transform(zip_with(sig, other, (x, y) -> x ^ y), x -> x | shiftrightunsigned(x, 2))"
    unequal = f"aggregate(transform({nibbles}, x -> bit_count((x | shiftrightunsigned(x, 1)) & 1229782938247303441L)), 0, (a, x) -> a + x)"
    agree, chance = 1 - F.expr(unequal) / HASHES, 1 / (1 << BITS)
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & ((agree - chance) / (1 - chance) >= percent / 100 - MARGIN)


def _members(part: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    """Rows with their sets, but for rows that only share the doc_id of the text that is meant."""
    sets = words.shingle_sets(words.raw_texts(part))
    for row, s in zip(part.drop_columns(["text"]).to_pylist(), sets):
        if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == row["digest"]:
            yield row, s


def _star(percent: int):
    """Links of each part's first row (its centre) with the part's other rows."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre, own = None, None, None
        for batch in batches:
            for part in words.slices(batch):
                a, b = [], []
                for row, s in _members(part):
                    if row["part"] != key:
                        key, centre, own = row["part"], row["node"], s
                    elif row["node"] != centre:
                        shared = len(np.intersect1d(own, s, assume_unique=True))
                        if 100 * shared >= percent * (len(own) + len(s) - shared):
                            a.append(row["node"]), b.append(centre)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return verify


def linked(sets: list[np.ndarray], sigs: np.ndarray, known: np.ndarray, percent: int) -> np.ndarray:
    """A component number for each member, by breadth-first search over confirmed links; members that share a
    number in ``known`` are in one component from the start and are not compared."""
    total = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, total)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    starts, ends = words.spans(sizes)
    mark = np.zeros(int(ids.max()) + 1, bool)
    label, left = np.full(total, -1, np.int64), np.arange(total)

    def take(new: np.ndarray, component: int) -> list[int]:
        joined = np.flatnonzero(np.isin(known, known[new]) & (label < 0))
        label[joined] = component
        return joined.tolist()

    for seed in range(total):
        if label[seed] >= 0:
            continue
        queue = take(np.asarray([seed]), seed)
        left = left[label[left] < 0]
        while queue and len(left):
            v = queue.pop()
            near = left[estimates(sigs[v], sigs[left]) >= percent / 100 - MARGIN]
            low, high = np.minimum(sizes[near], sizes[v]), np.maximum(sizes[near], sizes[v])
            near = near[100 * low >= percent * high]
            if not len(near):
                continue
            own = ids[starts[v] : ends[v]]
            mark[own] = True
            shared = np.fromiter((np.count_nonzero(mark[ids[starts[u] : ends[u]]]) for u in near.tolist()), np.int64, len(near))
            mark[own] = False
            hit = near[100 * shared >= percent * (sizes[v] + sizes[near] - shared)]
            if len(hit):
                queue += take(hit, seed)
                left = left[label[left] < 0]
    return label


def related(sigs: np.ndarray, sizes: np.ndarray, labels: np.ndarray, blocks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members that have a likely partner (by size and signature) of another label, and for each the
    smallest label that likely partners lead to. Members of two blocks are compared across them only."""
    halves = np.unique(blocks)
    ours, theirs = np.flatnonzero(blocks == halves[0]), np.flatnonzero(blocks == halves[-1])
    names, code = np.unique(labels, return_inverse=True)
    root, hit = np.arange(len(names)), np.zeros(len(labels), bool)
    other, size = sigs[theirs], sizes[theirs]
    for v in ours.tolist():
        fits = (estimates(sigs[v], other) >= percent / 100 - MARGIN) & (100 * np.minimum(size, sizes[v]) >= percent * np.maximum(size, sizes[v]))
        near = theirs[fits & (code[theirs] != code[v])]
        if len(near):
            hit[v] = hit[near] = True
            found = np.unique(root[np.append(code[near], code[v])])
            if len(found) > 1:
                root[np.isin(root, found)] = found[0]
    at = np.flatnonzero(hit)
    return at, names[root[code[at]]]


def _relater(percent: int):
    def relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def found() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            column = lambda c: rows.column(c).to_numpy()
            sigs = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).view(np.uint64)
            at, peers = related(sigs, column("n"), column("label"), column("block"), percent)
            return pa.RecordBatch.from_arrays([pa.array(column("node")[at]), pa.array(column("label")[at]), pa.array(peers)], names=["node", "label", "peer"])

        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if held and parts[low] != key:
                    yield found()
                    held = []
                key = parts[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield found()

    return relate


def _searcher(percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, sets = None, {}, []

        def found() -> pa.RecordBatch:
            nodes = list(rows)
            sigs = np.asarray([rows[x]["sig"] for x in nodes], np.int64).view(np.uint64)
            known = np.asarray([rows[x]["label"] for x in nodes], np.int64)
            component = linked(sets, sigs, known, percent)
            pairs = {(int(k), int(known[c])) for k, c in zip(known, component) if k != known[c]}
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for part in words.slices(batch):
                for row, s in _members(part):
                    if row["part"] != key and rows:
                        yield found()
                        rows, sets = {}, []
                    key = row["part"]
                    if row["node"] not in rows:
                        rows[row["node"]] = row
                        sets.append(s)
        if rows:
            yield found()

    return search


def _block_pairs(mine: Column) -> Column:
    """Numbers of the pairs of the block ``mine`` with each of the column blocks, itself included."""
    return F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda o: F.least(o, mine) * F.col("blocks") + F.greatest(o, mine))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, text_crc32, n_shingles, component_id, kept and stays for every row of ``docs`` (doc_id long, text string).

    Words are split at ASCII white space after A-Z are lower-cased. Null and empty texts have an empty
    set, link with nothing and are kept. Texts under five words are one shingle. Equal texts, repeated
    rows included, share a component; the smallest doc_id is kept. Rows that repeat a doc_id with another
    text are judged by that text: each has the component of its own text, and is kept if that is named by
    its doc_id; stays is as kept, but for one set of a component only, should several of its sets have that doc_id.
    Rows without doc_id keep a null component and are kept. text_crc32 is that of the text's
    UTF-8 (null: empty). Other columns are ignored. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = words.id_and_text(docs)
    signed = checkpointed(docs.mapInArrow(_sign, "doc_id long, crc long, n long, digest binary, sig array<long>, bands array<long>"))
    classes = (
        signed.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    )
    classes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))

    def with_texts(wanted: DataFrame) -> DataFrame:
        """part, node, ... with the class's digest and signature and its text, by part, smallest place first."""
        rows = checkpointed(wanted.join(classes.select("node", "rep", "digest", "sig"), "node"))
        reps, few = rows.select(F.col("rep").alias("doc_id")).distinct(), rows.count() <= BROADCAST_IDS
        picked = docs.join(F.broadcast(reps), "doc_id", "left_semi") if few else docs
        held = picked.join(rows, picked.doc_id == rows.rep).select(*wanted.columns, "digest", "sig", "text")
        return held.repartition("part").sortWithinPartitions("part", "place", "node")

    keyed = classes.select("node", F.explode("bands").alias("bucket"))
    heads = keyed.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = checkpointed(keyed.join(heads, "bucket").where("node != head").select("bucket", "node", "head", "size"))
    sized = classes.select("node", "n", "sig")
    stars = members.select("node", "head").distinct().join(sized, "node").join(sized.select(F.col("node").alias("head"), F.col("n").alias("m"), F.col("sig").alias("other")), "head")
    stars = checkpointed(stars.where(_likely(percent)).select("node", "head", "n"))
    pieces = stars.groupBy("head").agg(F.ceil(F.sum("n") / STAR_SHINGLES).cast("int").alias("pieces"))
    part = F.xxhash64("head", "piece").alias("part")
    points = stars.join(pieces, "head").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).select(part, "node", F.lit(1).alias("place"))
    centres = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(part, F.col("head").alias("node"), F.lit(0).alias("place"))
    links = checkpointed(with_texts(points.unionByName(centres)).mapInArrow(_star(percent), "a long, b long"))
    labels = connected(links)

    labelled = members.where("size > 2").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    open_ = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    rest = checkpointed(labelled.join(open_, "bucket").select("node", "label", "low").distinct())
    if not rest.isEmpty():
        chains = connected(rest.select(F.col("label").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("chain"))
        chained = checkpointed(rest.select("node", "label").distinct().join(chains, "label").join(sized, "node"))
        small, large = CHAIN_BLOCK
        cuts = chained.groupBy("chain").agg(F.count(F.lit(1)).alias("c")).select("chain", F.ceil(F.col("c") / F.least(F.greatest(F.lit(small), F.col("c") / 50), F.lit(large))).cast("int").alias("blocks"))
        cut = chained.join(cuts, "chain").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).select("*", F.explode(_block_pairs(F.col("block"))).alias("pair"))
        cut = cut.select(F.xxhash64("chain", "pair").alias("part"), "node", "label", "n", "sig", "block").repartition("part").sortWithinPartitions("part")
        rest = checkpointed(cut.mapInArrow(_relater(percent), "node long, label long, peer long").distinct())
    if not rest.isEmpty():
        clusters = connected(rest.where("label != peer").select(F.col("label").alias("a"), F.col("peer").alias("b")).distinct())
        rest = rest.select("node", "label").distinct().join(clusters.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label").join(classes.select("node", "n"), "node")
        total = F.col("total")
        blocks = rest.groupBy("cluster").agg(F.sum("n").alias("total")).select("cluster", F.ceil(total / F.least(F.greatest(F.lit(LEAST_SHINGLES), total / 6), F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
        # a cut cluster: each block meets every other block, and a block pair is one search of its own
        pairs = _block_pairs(F.pmod(F.xxhash64("node"), F.col("blocks")))
        groups = rest.join(blocks, "cluster").select("node", "label", "cluster", F.explode(pairs).alias("pair")).select(F.xxhash64("cluster", "pair").alias("part"), "node", F.lit(0).alias("place"), "label")
        more = checkpointed(with_texts(groups).mapInArrow(_searcher(percent), "a long, b long"))
        if not more.isEmpty():
            labels = connected(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))

    named = classes.join(labels, "node", "left").select("node", "digest", "rep", "copies", F.coalesce("label", "node").alias("label"), F.col("label").isNotNull().alias("linked"))
    least = named.where("linked").groupBy("label").agg(F.min(F.struct("rep", "node")).alias("least"))
    final = named.where("copies > 1 or linked").join(least, "label", "left").select("digest", F.coalesce("least.rep", "rep").alias("component"), F.coalesce(F.col("least.node") == F.col("node"), F.lit(True)).alias("leads"))
    kept = F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True))
    return signed.select("doc_id", "crc", "n", "digest").join(final, "digest", "left").select(
        "doc_id",
        F.col("crc").alias("text_crc32"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        kept.alias("kept"),
        (kept & F.coalesce("leads", F.lit(True))).alias("stays"),
    )
