"""From raw documents to packed sequences: five stages, each written as Parquet and read again as the next one's input.

Stages run one after the other: the result of one is written before the next starts, which first removes the
intermediate tables of the one before it. Operators see a document's id and text only; all its columns travel beside
them in a struct, so no column of the input can clash with one of theirs. All stages take nulls in any column, empty
texts, repeated rows and empty tables; what becomes of them is said with each.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.llm import lines, minhash, packing, pii, quality
from sunlattice.llm.scratch import new_path, owner, remove

#: Intermediate tables of the stage that ran last, by session and folder.
_held: dict[tuple[int, str], list[str]] = {}


@contextmanager
def _stage(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """Removes the intermediate tables of the stage before, and keeps those of this one until the next stage."""
    remove(spark, _held.pop((id(spark), sf_dir), []))
    with owner() as tables:
        yield
        _held[id(spark), sf_dir] = tables


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))


def _whole(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, with the result's text and n_chars (if it is a number) counted anew."""
    new = {"text": F.col("text")}
    if dict(docs.dtypes).get("n_chars") in ("tinyint", "smallint", "int", "bigint"):
        new["n_chars"] = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return result.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (null and empty texts are); failing lines of the others are removed. Repeated rows are
    judged alike, and rows with a null doc_id like any other."""
    with _stage(spark, sf_dir):
        judged = quality.judge(_slim(docs)).where("kept").withColumn("text", F.col("clean_text"))
        return _whole(judged, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one are removed; a document of which no word is left goes. Rows with a null doc_id
    or text pass unchanged; rows with equal doc_id and text are one document and keep the same lines."""
    with _stage(spark, sf_dir):
        clean = lines.dedup_lines(_slim(docs))
        some = F.col("text").rlike(r"[^\x20\x09-\x0D]")
        return _whole(clean.where((F.col("n_removed") == 0) | some), docs)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (five-word shingles, similarity 0.8). Rows
    that repeat its id and text stay with it; rows with a null doc_id stay, and so do those without words."""
    with _stage(spark, sf_dir):
        verdict = minhash.near_duplicates(docs.select("doc_id", "text")).where("not kept and doc_id is not null")
        gone = verdict.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
        own = (docs["doc_id"] == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"])
        return docs.join(gone, own, "left_anti")


def pii_sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is generalised to its kind, and disclosing terms are removed. All rows stay; null texts stay null."""
    with _stage(spark, sf_dir):
        return _whole(pii.sanitise(_slim(docs)), docs)


def bestfit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there; null and empty texts are one token."""
    with _stage(spark, sf_dir):
        return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_neardup", minhash_neardup),
    ("pii_sanitisation", pii_sanitisation),
    ("bestfit_packing", bestfit_packing),
]

#: SimHash, MinHash, the vocabulary and the local search aren't SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of sf_dir and return the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = new_path(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
