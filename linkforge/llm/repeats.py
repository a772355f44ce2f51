"""Repeated runs across a corpus by winnowing, seeding and extending (the engine of operators 6 and 7).

A text is a sequence of tokens (words, or lines). A run of T tokens is a window. Winnowing hashes every
k consecutive tokens and takes the smallest hash of each T - k + 1 in a row, so each window has one
fingerprint (its anchor) and equal windows have equal anchors at equal offsets.

1. Of documents with equal texts only the first is searched; what the others repeat is known.
2. Anchors are counted with partial aggregation; those seen once cannot lie in a repeated window.
   Occurrences of shared anchors are found by a shuffled semi join, never by pairing occurrences.
3. Each occurrence is extended both ways as far as windows have it as their anchor. Where all occurrences of
   an anchor have the same extent, all but the first place are repeats as a whole.
4. Where extents of one anchor differ, its occurrences are compared window by window, as extents may agree in
   part: grouping window hashes finds the first place of each, and a join marks the others.
5. Overlapping later windows merge into maximal runs, which are removed.

Documents are told apart by doc_id where it is unique, and by doc_id and a checksum of the text where it is not.
What repeats inside one document is marked while its text is at hand. Groups are reduced by partial aggregates
before they move. Joins back to a group's first document use a key of their own, so that both sides are exchanged
for the join and adaptive execution can split a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkforge.llm import words


@dataclass(frozen=True)
class Rule:
    """How texts become tokens and how long a repeated run must be."""

    split: Callable[[bytes], list[bytes]]
    length: int
    gram: int

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Per window: row, start, hash, and its anchor's hash and position. Anchors are leftmost minima."""
        rows = [self.split(t) for t in texts]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = words.hashed([w for row in rows for w in row])
        whole = words.rolling(flat, self.length)
        at = np.flatnonzero(words.inside(counts, self.length, len(whole)))
        if not len(at):
            none = np.empty(0, np.int64)
            return none, none, whole[:0], whole[:0], none
        # a gram's leading bits over its position: one sliding minimum gives the leftmost smallest gram
        grams = words.rolling(flat, self.gram)
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width, span = self.length - self.gram + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        where = (np.minimum(low[at], low[at + (width - span)]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        best = grams[where]
        starts, ends = words.spans(counts)
        row = np.searchsorted(ends, at, side="right")
        return row, at - starts[row], whole[at], best, where - starts[row]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _heads(row: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Where the windows of a new anchor begin."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (where[1:] != where[:-1])
    return np.flatnonzero(new)


def _again(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which entries have a key that their row has at an earlier entry."""
    out = np.zeros(len(row), bool)
    both = words.mix(key ^ words.mix(row.astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(both)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):  # few, as a rule: only these are told apart in full
        at = np.flatnonzero(np.isin(both, twice))
        order = at[np.lexsort((at, key[at], row[at]))]
        out[order[1:]] = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    return out


def _ids(part: pa.RecordBatch, row: np.ndarray) -> pa.Array:
    """The documents of rows; they are the first column."""
    return part.column(0).take(pa.array(row))


def _anchors(rule: Rule, counted: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                row, _, _, anchor, where = rule.windows(words.raw_texts(part))
                head = _heads(row, where)
                if counted:
                    anchor, n = np.unique(_counted_key(anchor[head]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([_signed(anchor), pa.array(np.minimum(n, 2).astype(np.int8))], names=["anchor", "n"])
                else:
                    cols = [_ids(part, row[head]), _signed(_counted_key(anchor[head])), pa.array(where[head].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["unit", "anchor", "pos"])

    return emit


def _seeded(rule: Rule, part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The windows whose anchors stand at the positions in ``seeds``."""
    row, start, whole, anchor, where = rule.windows(words.raw_texts(part))
    known = np.concatenate([np.asarray(s or [], np.int64) + (i << 32) for i, s in enumerate(part.column("seeds").to_pylist())])
    hit = np.isin((row << 32) + where, known)
    return tuple(x[hit] for x in (row, start, whole, anchor, where))


def _extents(rule: Rule):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                row, start, whole, anchor, where = _seeded(rule, part)
                head = _heads(row, where)
                size = np.diff(np.concatenate([head, [len(row)]]))
                tagged = words.mix(whole ^ words.mix((where - start).astype(np.uint64)))
                extent = words.mix(np.add.reduceat(tagged, head) ^ anchor[head]) if len(head) else whole
                cols = [_ids(part, row[head]), _signed(anchor[head]), _signed(extent), pa.array(_again(row[head], extent))]
                cols += [pa.array(x.astype(np.int32)) for x in (start[head], size, where[head])]
                yield pa.RecordBatch.from_arrays(cols, names=["unit", "anchor", "extent", "again", "start", "size", "pos"])

    return emit


def _windows(rule: Rule):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                row, start, whole, _, _ = _seeded(rule, part)
                cols = [_ids(part, row), _signed(whole), pa.array(_again(row, whole)), pa.array(start.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["unit", "window", "again", "start"])

    return emit


def _passages(rule: Rule, least: int):
    """Every run of fewer than ``rule.length`` tokens that holds ``least`` words or more: its hash, place and tokens."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                rows = [rule.split(t) for t in words.raw_texts(part)]
                counts = np.fromiter(map(len, rows), np.int64, len(rows))
                tokens = [w for row in rows for w in row]
                flat, total = words.hashed(tokens), np.cumsum([0, *(len(w.split()) for w in tokens)])
                starts, ends = words.spans(counts)
                for size in range(1, rule.length):
                    whole = words.rolling(flat, size)
                    at = np.flatnonzero(words.inside(counts, size, len(whole)) & (total[size:] - total[: len(whole)] >= least))
                    row = np.searchsorted(ends, at, side="right")
                    key = words.mix(whole[at] ^ np.uint64(size))
                    cols = [_ids(part, row), _signed(key), pa.array(_again(row, key)), pa.array((at - starts[row]).astype(np.int32)), pa.array(np.full(len(at), size, np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["unit", "passage", "again", "start", "size"])

    return emit


def _counted_key(anchor: np.ndarray) -> np.ndarray:
    """Six bytes of an anchor: enough to tell which are seen once, and a quarter less to shuffle. Two anchors with
    one key only make more occurrences pass to the next step."""
    return anchor >> np.uint64(16)


def _fresh_key(column: str):
    """A join key that Spark must exchange for: the same value under an expression of its own."""
    return F.col(column).bitwiseXOR(F.lit(1)).alias("key")


def _later(found: DataFrame, key: str, *rest: str) -> DataFrame:
    """unit, start and ``rest`` of the rows of ``found`` whose key an earlier document has, or their own before them."""
    firsts = found.where("not again").groupBy(key).agg(F.min("unit").alias("first"), F.max("unit").alias("last")).where("first != last").select(_fresh_key(key), "first")
    rows = found.select(_fresh_key(key), "unit", "again", "start", *rest).join(firsts, "key", "left")
    return rows.where("again or unit != first").select("unit", "start", *rest)


def with_copies(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` (doc_id not null, text, ...) with ``copy`` (a smaller doc_id has the same text), the column that
    tells documents apart, in their order, and its type.

    That is doc_id if it is unique. If not it is ``unit``, made of doc_id and the text's CRC-32."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    unit, kind = "doc_id", "bigint"
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        unit, kind = "unit", "decimal(38,0)"
        place = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.crc32(text).cast("decimal(10,0)")
        docs = docs.withColumn("unit", F.coalesce(place.cast(kind), F.lit(0).cast(kind)))
    digests = docs.select("doc_id", *({unit} - {"doc_id"}), F.md5(text).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last")
    firsts = firsts.select(F.concat("digest", F.lit("+")).alias("key"), "first")
    copies = digests.withColumn("key", F.concat("digest", F.lit("+"))).join(firsts, "key").where("doc_id != first")
    return docs.join(copies.groupBy(unit).agg(F.lit(True).alias("copy")), unit, "left"), unit, kind


def repeated_runs(docs: DataFrame, rule: Rule, passages: int | None = None) -> DataFrame:
    """``docs`` with ``runs`` (array of start, size): windows of the document whose tokens also start earlier,
    NULL if there are none, and ``copy``: an earlier document has the same text, so all its windows do.

    Earlier means a smaller doc_id, or the same document and a smaller start. ``docs`` has doc_id (not null),
    text and whatever else shall come along. Rows that repeat doc_id and text are one document; other texts of
    the same doc_id are documents of their own, in the order of their checksums. Every branch reads the same
    exchange of ``docs``, so texts are shuffled once.

    With ``passages`` there is a column of that name (array of start, size) too: runs of fewer than
    ``rule.length`` tokens that hold so many words or more and also start earlier.
    """
    flagged, unit, kind = with_copies(docs)
    own = flagged.where("copy is null").select(unit, "text")
    counts = own.mapInArrow(_anchors(rule, True), "anchor long, n byte").groupBy("anchor").agg(F.sum("n").alias("n"))
    shared = counts.where("n > 1").select(_fresh_key("anchor"))
    seen = own.mapInArrow(_anchors(rule, False), f"unit {kind}, anchor long, pos int").select(_fresh_key("anchor"), "unit", "pos")

    def by_document(places: DataFrame, name: str, *what: str) -> DataFrame:
        grouped = F.collect_set(F.struct(*what) if len(what) > 1 else F.col(what[0]))
        return places.groupBy("unit").agg(grouped.alias(name)).withColumnRenamed("unit", unit)

    def seeded(places: DataFrame) -> DataFrame:
        return own.join(by_document(places, "seeds", "pos"), unit)

    found = seeded(seen.join(shared, "key", "left_semi")).mapInArrow(_extents(rule), f"unit {kind}, anchor long, extent long, again boolean, start int, size int, pos int")
    heads = found.where("not again").groupBy("anchor").agg(F.min("unit").alias("first"), F.max("unit").alias("last"), F.min("extent").alias("low"), F.max("extent").alias("high"))
    heads = heads.where("first != last or low != high").select(_fresh_key("anchor"), "first", (F.col("low") != F.col("high")).alias("differ"))
    places = found.select(_fresh_key("anchor"), "unit", "again", "start", "size", "pos").join(heads, "key", "left").where("again or differ or unit != first")
    # one array for both uses below, so that Spark computes it once: what goes as a whole, and (pos) what is compared by window
    marks = by_document(places.withColumn("pos", F.expr("if(differ and not again, pos, -1)")), "marks", "start", "size", "pos")
    seeds = F.transform(F.filter("marks", lambda m: m["pos"] >= 0), lambda m: m["pos"])
    windows = own.join(marks, unit).select(unit, "text", seeds.alias("seeds")).where("size(seeds) > 0").mapInArrow(_windows(rule), f"unit {kind}, window long, again boolean, start int")
    whole = F.transform(F.filter("marks", lambda m: m["pos"] < 0), lambda m: F.struct(m["start"].alias("start"), m["size"].alias("size")))
    late = by_document(_later(windows, "window").withColumn("size", F.lit(1)), "late", "start", "size")
    none = F.array().cast("array<struct<start:int,size:int>>")
    marked = flagged.join(marks, unit, "left").join(late, unit, "left").withColumn("runs", F.concat(F.coalesce(whole, none), F.coalesce("late", none))).drop("marks", "late")
    if passages is not None:
        held = own.mapInArrow(_passages(rule, passages), f"unit {kind}, passage long, again boolean, start int, size int")
        marked = marked.join(by_document(_later(held, "passage", "size"), "passages", "start", "size"), unit, "left")
    return marked.drop(*({unit} - {"doc_id"}))


def covered(runs: list[dict] | None, copy: bool | None, length: int, size: int) -> np.ndarray | None:
    """Tokens that the windows cover, None if there are none: overlapping windows merge into maximal runs."""
    if copy:
        return np.ones(size, bool) if size >= length else None
    if not runs:
        return None
    edge = np.zeros(size + 1, np.int32)
    start = np.asarray([r["start"] for r in runs], np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + np.asarray([r["size"] for r in runs], np.int64) + length - 1, -1)
    return np.cumsum(edge[:size]) > 0


def without_runs(docs: DataFrame) -> DataFrame:
    """``docs`` in the shape of ``repeated_runs``, with nothing found."""
    return docs.selectExpr("*", "cast(null as boolean) as copy", "cast(null as array<struct<start:int,size:int>>) as runs")
