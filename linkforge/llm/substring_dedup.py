"""Substring dedup by seed and extend (operator 7): repeated runs of 20 words or more go, save their first place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkforge.llm import words
from linkforge.llm.repeats import Rule, covered, repeated_runs, without_runs
from linkforge.runtime import ship

#: Words of the shortest repeat, and of the winnowed seeds inside it.
LENGTH, SEED = 20, 6
RULE = Rule(bytes.split, LENGTH, SEED)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch):
            n, gone, texts = [], [], []
            for text, runs, copy in zip(words.raw_texts(part), part.column("runs").to_pylist(), part.column("copy").to_pylist()):
                row = text.split()
                drop = covered(runs, copy, LENGTH, len(row))
                n.append(len(row))
                gone.append(0 if drop is None else int(drop.sum()))
                texts.append(b" ".join(row if drop is None else [w for w, d in zip(row, drop.tolist()) if not d]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) for every row.

    A word goes if a window of 20 consecutive words of its document covers it and the window's words also
    start earlier: in a smaller doc_id, or in the same document at a smaller start. Windows are judged on
    the input. Null and empty texts have no words; texts under 20 words are left as they are. Of equal
    texts the smallest doc_id keeps its words. Rows that repeat doc_id and text are the same place, so they
    do not remove each other; other texts of a doc_id are places of their own, in the order of their CRC-32.
    Rows without doc_id are never matched and keep every word. Other columns are ignored; an empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    docs = words.id_and_text(docs)
    marked = repeated_runs(docs.where("doc_id is not null"), RULE)
    strays = without_runs(docs.where("doc_id is null"))
    return marked.unionByName(strays).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
