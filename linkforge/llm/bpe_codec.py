"""BPE encoding and decoding with segment trees (operator 5).

A pre-token's adjacent pairs are the leaves of a segment tree whose nodes hold the smallest
(rank, position) below them, so the root is the leftmost lowest-rank merge. A merge sets at most three
leaves and repairs their paths to the root, in time logarithmic in the length, until the root holds no
mergeable pair. Trees of equal size stand side by side in one numpy array and advance together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkforge.llm import words
from linkforge.llm.bpe import NONE, Vocabulary, vocabulary
from linkforge.runtime import ship

#: Pre-tokens whose ids a worker remembers; when full, the table starts anew.
REMEMBERED = 400_000
#: Tree cells that one batch of trees may hold.
TREE_CELLS = 1 << 21


def _forest(vocab: Vocabulary, symbols: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge rows of ``symbols`` (n x width, padded with -1) to the end; returns symbols and which survive."""
    n, leaves = len(symbols), width
    shift = np.int64(leaves)
    following = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
    alive = symbols >= 0
    tree = np.full((n, 2 * leaves), NONE * shift, np.int64)
    rows, at = np.nonzero(alive[:, :-1] & alive[:, 1:])
    pair = vocab.find(symbols[rows, at], symbols[rows, at + 1])
    good = pair >= 0
    tree[rows[good], leaves + at[good]] = vocab.ranks[pair[good]] * shift + at[good]
    level = leaves
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    live = np.arange(n)
    while True:
        root = tree[live, 1]
        live = live[root < NONE * shift]
        if not len(live):
            return symbols, alive
        a = (tree[live, 1] % shift).astype(np.int64)
        b = following[live, a].astype(np.int64)
        merged = vocab.made[vocab.find(symbols[live, a], symbols[live, b])]
        symbols[live, a] = merged
        alive[live, b] = False
        c = following[live, b].astype(np.int64)
        following[live, a] = c
        has_next = c < lengths[live]
        before[live[has_next], c[has_next]] = a[has_next]
        p = before[live, a].astype(np.int64)
        tree[live, leaves + b] = NONE * shift
        # the pairs that now begin at a and before a
        right = np.full(len(live), -1, np.int32)
        right[has_next] = symbols[live[has_next], c[has_next]]
        pair = vocab.find(merged, right)
        tree[live, leaves + a] = np.where(pair >= 0, vocab.ranks[pair] * shift + a, NONE * shift)
        has_prev = p >= 0
        pair = vocab.find(symbols[live[has_prev], p[has_prev]], merged[has_prev])
        tree[live[has_prev], leaves + p[has_prev]] = np.where(pair >= 0, vocab.ranks[pair] * shift + p[has_prev], NONE * shift)
        nodes_r = np.concatenate([live, live, live[has_prev]])
        nodes = (np.concatenate([a, b, p[has_prev]]) + leaves) >> 1
        while nodes[0] >= 1:
            tree[nodes_r, nodes] = np.minimum(tree[nodes_r, 2 * nodes], tree[nodes_r, 2 * nodes + 1])
            nodes >>= 1


def encode_pretokens(vocab: Vocabulary, tokens: list[bytes]) -> list[list[int]]:
    """Ids of each pre-token. Lengths are grouped by powers of two so that trees of a batch match."""
    out: list[list[int]] = [[]] * len(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    classes = np.maximum(1, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    for width in np.unique(classes).tolist():
        members = np.flatnonzero((classes == width) & (sizes > 0))
        step = max(1, TREE_CELLS // width)
        for at in range(0, len(members), step):
            some = members[at : at + step]
            lengths = sizes[some]
            flat = np.frombuffer(b"".join(tokens[i] for i in some.tolist()), np.uint8)
            grid = np.full((len(some), width), -1, np.int32)
            grid[np.arange(width)[None, :] < lengths[:, None]] = vocab.of_byte[flat]
            if width > 1:
                grid, alive = _forest(vocab, grid, lengths, width)
            else:
                alive = grid >= 0
            ids, start = grid[alive].tolist(), 0
            for i, end in zip(some.tolist(), np.cumsum(alive.sum(axis=1)).tolist()):
                out[i] = ids[start:end]
                start = end
    return out


class Encoder:
    """Encodes batches of texts; a bounded table remembers the ids of pre-tokens."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known = vocab, {t: [i] for t, i in vocab.added.items()}

    def encode(self, texts: list[str]) -> list[list[int]]:
        rows = [self.vocab.pretokens(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {t: [i] for t, i in self.vocab.added.items()}
        new = list(set().union(*rows).difference(self.known))
        self.known.update(zip(new, encode_pretokens(self.vocab, [t.encode() for t in new])))
        ids_of = self.known.__getitem__
        return [list(chain.from_iterable(map(ids_of, row))) for row in rows]


def decode(vocab: Vocabulary, ids: list[int]) -> str:
    """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(vocab.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _coder(path: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder = Encoder(vocab)
        for batch in batches:
            for part in words.slices(batch):
                ids = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([decode(vocab, x) for x in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return code


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> and decoded string for every row, with the vocabulary file at ``path``.

    Ids are what the file's own library gives without added begin or end tokens; strings of special tokens
    in a text become their ids. Null texts count as empty: no ids, empty decoded text. Rows are coded one by
    one, so repeated rows and null ids change nothing; other columns are ignored; an empty table gives an
    empty result. ``path`` must exist on every worker.
    """
    ship(docs.sparkSession)
    docs = words.id_and_text(docs)
    return docs.mapInArrow(_coder(path), "doc_id long, ids array<int>, decoded string")


def _digester(path: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder, name_of = Encoder(vocab), list(map(str, range(len(vocab.bytes)))).__getitem__
        for batch in batches:
            for part in words.slices(batch):
                n, coded, texts = [], [], []
                for ids in encoder.encode([t or "" for t in part.column("text").to_pylist()]):
                    n.append(len(ids))
                    coded.append(hashlib.sha256(",".join(map(name_of, ids)).encode()).hexdigest())
                    texts.append(hashlib.sha256(decode(vocab, ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def code_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of what
    ``encode_decode`` gives, hashed where the ids are made so that they need not leave the worker."""
    ship(docs.sparkSession)
    docs = words.id_and_text(docs)
    return docs.mapInArrow(_digester(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
