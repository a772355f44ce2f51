"""Line dedup by winnowing over line hashes (operator 6): later copies of runs of three lines or more go.

On request one or two lines go as well if they hold a number of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from linkforge.llm import words
from linkforge.llm.repeats import Rule, covered, repeated_runs, without_runs
from linkforge.runtime import ship

#: Lines of the shortest run that is removed; fingerprints are single line hashes, minima of this many in a row.
LENGTH = 3


def lines(text: bytes) -> list[bytes]:
    """The lines that hold a word; blank lines are no part of a run and stay where they are."""
    return [x for x in text.split(b"\n") if x.split()]


RULE = Rule(lines, LENGTH, 1)


def _gone(text: str | None, size: int, runs: list[dict] | None, copy: bool | None, passages: list[dict] | None, least: int | None) -> np.ndarray | None:
    """Lines that go, None if there are none."""
    drop = covered(runs, copy, LENGTH, size)
    if copy and drop is None and least is not None and size and len(text.encode().split()) >= least:
        return np.ones(size, bool)
    if passages:
        drop = np.zeros(size, bool) if drop is None else drop
        for p in passages:
            drop[p["start"] : p["start"] + p["size"]] = True
    return drop


def _cut(least: int | None):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                more = [c for c in part.schema.names if c == "rest"]
                n, gone, texts = [], [], []
                passages = part.column("passages").to_pylist() if least is not None else [None] * part.num_rows
                for text, runs, copy, found in zip(*(part.column(c).to_pylist() for c in ("text", "runs", "copy")), passages):
                    size = len(lines((text or "").encode()))
                    drop = _gone(text, size, runs, copy, found, least)
                    n.append(size)
                    if drop is None:
                        gone.append(0), texts.append(text)
                        continue
                    gone.append(int(drop.sum()))
                    marks = iter(drop.tolist())
                    texts.append("\n".join(x for x in text.split("\n") if not (x.encode().split() and next(marks))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), *(part.column(c) for c in more)],
                    names=["doc_id", "text", "n_lines", "n_removed", *more],
                )

    return cut


def line_dedup(docs: DataFrame, rest: Column | None = None, passage_words: int | None = None) -> DataFrame:
    """doc_id, text (without the removed lines), n_lines and n_removed for every row.

    Lines are split at newlines; those without a word are skipped when runs are formed and are never
    removed. A line goes if it lies in a run of three or more consecutive lines that also starts earlier
    (smaller doc_id, or same document and earlier line); runs are judged on the input. Null texts stay
    null. With ``passage_words``, runs of one or two lines that hold so many words go by the same rule; without
    it, as in the registered query, they stay and documents under three lines are left as they are. Of equal texts the smallest doc_id keeps its
    lines. Rows that repeat doc_id and text are the same place; other texts of a doc_id are places of their own, in
    the order of their CRC-32. Rows without doc_id are left as they are. Other
    columns are ignored, but for ``rest``: it comes along as a column of that name. An empty table gives an
    empty result.
    """
    ship(docs.sparkSession)
    more = [] if rest is None else [rest.alias("rest")]
    docs = words.id_and_text(docs, *more)
    named = docs.where("doc_id is not null")
    marked = repeated_runs(named, RULE, passage_words)
    strays = without_runs(docs.where("doc_id is null"))
    if passage_words is not None:
        strays = strays.selectExpr("*", "cast(null as array<struct<start:int,size:int>>) as passages")
    schema = T._parse_datatype_string("doc_id long, text string, n_lines long, n_removed long")
    for field in docs.schema.fields[2:]:
        schema = schema.add(field)
    return marked.unionByName(strays).mapInArrow(_cut(passage_words), schema)
