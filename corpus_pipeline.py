"""From raw documents to token ids: five stages over whole tables, each stored and read again.

1. quality rules: rejected documents go, kept ones lose their failing lines;
2. line dedup: later copies of runs of three lines or more go, and documents left without a word;
3. MinHash near-dedup: one document of each group stays;
4. benchmark decontamination: documents that hold three quarters of an item go;
5. BPE encoding and decoding: token counts and digests of what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkforge.llm.bpe_codec import code_digests
from linkforge.llm.decontamination import contained_items
from linkforge.llm.line_dedup import line_dedup
from linkforge.llm.near_dup import near_duplicates
from linkforge.llm.quality_rules import quality_rules
from linkforge.llm.queries import tokenizer_path
from linkforge.runtime import stored, table


def _quoted(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in columns]


def _others(docs: DataFrame) -> Column:
    """What a text stage carries along: all columns but the id, the text and its length, by number, as names may clash."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    return F.struct(F.lit(0).alias("none"), *(c.alias(f"c{i}") for i, c in enumerate(_quoted(rest))))


def _as_documents(changed: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The columns of ``documents`` again, in their order, from doc_id, a new text and the others."""
    own = {"doc_id": F.col("doc_id"), "text": F.col(text), "n_chars": F.length(text).cast("long")}
    rest = [c for c in columns if c not in own]
    return changed.select(*((own[c] if c in own else F.col("rest")[f"c{rest.index(c)}"]).alias(c) for c in columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines; n_chars is that of the new text.

    Every row is judged by itself: repeated rows and null ids change nothing. Null, empty and blank texts and those
    under ten words go by the base rule. A very long text is judged whole. Extra columns of any name come along; an
    empty table stays empty."""
    return _as_documents(quality_rules(docs, _others(docs)).where("kept"), "clean_text", docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of three lines; those left without a word go, null texts among them.

    Of equal runs the first in the order of doc_id (of its texts' checksums, where one repeats) and line stays. Rows that
    repeat doc_id and text are one place and do not remove each other. Rows without doc_id are left as they are. Extra
    columns of any name come along; an empty table stays empty."""
    left = line_dedup(docs, _others(docs)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _as_documents(left, "text", docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest doc_id. Null, empty and blank texts are groups of their
    own. Rows without doc_id are no part of a group and all stay. Rows that repeat a doc_id with the same text become
    one (the first by their other columns); with another text they are judged by that text. Extra columns of any name
    come along, also those without an order; an empty table stays empty."""
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    marks = near_duplicates(docs).where("stays and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc")).distinct()
    kept = docs.join(marks, (docs.doc_id == marks._id) & (crc == marks._crc), "left_semi")
    repeated = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not repeated.isEmpty():
        again = kept.join(repeated, "doc_id", "left_semi")
        order = [c for c, (_, kind) in zip(_quoted(docs.columns), docs.dtypes) if "map<" not in kind and "variant" not in kind]
        row = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(_quoted(docs.columns))))
        first = again.groupBy(F.col("doc_id").alias("i"), F.sha2("text", 256).alias("t")).agg(F.min_by(row, F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("r"))
        first = first.select(*(F.col("r")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)))
        kept = kept.join(repeated, "doc_id", "left_anti").select(*_quoted(docs.columns)).unionByName(first)
    return kept.select(*_quoted(docs.columns)).unionByName(docs.where("doc_id is null"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold three quarters or more of an item's shingles go; the others stay as they are.

    Texts are told apart by a 64-bit hash, so rows without doc_id or of a repeated one are each judged by their own
    text. Null, empty and blank texts hold nothing and stay. Extra columns of any name come along; an empty table, or
    one without items, stays as it is."""
    items = table(spark, sf_dir, "benchmark")
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    held = contained_items(texts, items).select(F.col("doc_id").alias("_hash")).distinct()
    return docs.join(held, F.xxhash64(docs.text) == held._hash, "left_anti").select(*_quoted(docs.columns))


def coding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row. Null texts count as empty: no token, digests of
    nothing. Repeated rows and null ids stay rows of their own; other columns go; an empty table gives an empty result."""
    return code_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding and decoding", coding_stage),
]

#: Connected components and BPE are beyond plain SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{i}")
    return docs
