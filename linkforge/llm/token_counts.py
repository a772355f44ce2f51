"""Token counts by rank-synchronous merging of ragged arrays (operator 9).

All distinct pre-tokens of a batch lie end to end in one symbol array. Every round finds each sequence's
lowest-rank adjacent pair by a segmented minimum and merges all its occurrences in all sequences at once;
sequences without a mergeable pair leave. What survives is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkforge.llm import words
from linkforge.llm.bpe import NONE, Vocabulary, vocabulary
from linkforge.runtime import ship

#: Pre-tokens whose counts a worker remembers; when full, the table starts anew.
REMEMBERED = 400_000
#: Bytes of pre-tokens merged together.
FLAT_BYTES = 1 << 20


def merge_counts(vocab: Vocabulary, tokens: list[bytes]) -> np.ndarray:
    """Symbols that survive in each pre-token when no pair merges any more."""
    counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
    out = counts.copy()
    live = np.flatnonzero(counts > 1)
    symbols = vocab.of_byte[np.frombuffer(b"".join(tokens[i] for i in live.tolist()), np.uint8)]
    sizes = counts[live]
    while len(live):
        starts, ends = words.spans(sizes)
        pair = np.full(len(symbols), -1, np.int32)
        pair[:-1] = vocab.find(symbols[:-1], symbols[1:])
        pair[ends - 1] = -1
        rank = np.where(pair >= 0, vocab.ranks[pair], NONE)
        best = np.minimum.reduceat(rank, starts)
        done = best == NONE
        if done.any():
            out[live[done]] = sizes[done]
            stay = np.repeat(~done, sizes)
            symbols, pair, rank = symbols[stay], pair[stay], rank[stay]
            live, sizes, best = live[~done], sizes[~done], best[~done]
            if not len(live):
                break
            starts, ends = words.spans(sizes)
        chosen = rank == np.repeat(best, sizes)
        # occurrences that overlap (x x x) merge from the left: every second one of a run
        at = np.arange(len(symbols))
        head = chosen.copy()
        head[1:] &= ~chosen[:-1]
        run = np.maximum.accumulate(np.where(head, at, 0))
        chosen &= (at - run) % 2 == 0
        symbols = symbols.copy()
        symbols[chosen] = vocab.made[pair[chosen]]
        keep = np.ones(len(symbols), bool)
        keep[1:] = ~chosen[:-1]
        sizes = np.add.reduceat(keep.astype(np.int64), starts)
        symbols = symbols[keep]
    return out


class Counter:
    """Counts the tokens of batches of texts; a bounded table remembers pre-tokens."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known = vocab, dict.fromkeys(vocab.added, 1)

    def count(self, texts: list[str]) -> list[int]:
        rows = [self.vocab.pretokens(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = dict.fromkeys(self.vocab.added, 1)
        new = list(set().union(*rows).difference(self.known))
        raw = [t.encode() for t in new]
        held, at = 0, 0
        for i, t in enumerate(raw):
            held += len(t)
            if held >= FLAT_BYTES or i == len(raw) - 1:
                self.known.update(zip(new[at : i + 1], merge_counts(self.vocab, raw[at : i + 1]).tolist()))
                held, at = 0, i + 1
        size_of = self.known.__getitem__
        return [sum(map(size_of, row)) for row in rows]


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(path))
        for batch in batches:
            for part in words.slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                size = [len(t) for t in words.raw_texts(part)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(counter.count(texts), pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row.

    Counts equal those of the file's own library without begin, end or other added tokens; the string of a
    special token inside a text counts once. Null texts are empty: zero bytes and tokens. Rows are counted
    one by one, so repeated rows and null ids change nothing; other columns are ignored; an empty table
    gives an empty result. ``path`` must exist on every worker.
    """
    ship(docs.sparkSession)
    docs = words.id_and_text(docs)
    return docs.mapInArrow(_counter(path), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
