"""Documents to training rows: five stages, each one operator of ``geodiag.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; the
result is written as Parquet in the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodiag.llm.minhash import near_duplicates
from geodiag.llm.mixing import mix
from geodiag.llm.quality import accepted
from geodiag.llm.sampling import encode
from geodiag.llm.substrings import remove_repeats
from geodiag.runtime import discard, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule and whose host isn't rejected.

    Null and empty texts have too few words and go. Repeated rows and ties are treated alike, each as its text
    and host ask for; rows without doc_id or source count as any other. An empty table stays empty, other columns pass.
    """
    return accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked at five words and 0.8.

    Of rows with one doc_id all different texts stay, or none; of equal ones one row, the smallest by
    its JSON text, so columns may be of any type. Rows without doc_id are linked with nothing, but of those with
    equal texts one stays. Null and empty texts are linked with nothing; an empty table stays empty.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()

    def single(rows: DataFrame) -> DataFrame:
        # the smallest by what can be ordered in any table: the row's JSON text. Rows that differ in nothing of it are equal
        order = F.struct(F.length("text"), F.to_json(F.struct("*")))
        one = rows.groupBy("doc_id", F.sha2("text", 256).alias("same")).agg(F.min_by(F.struct("*"), order).alias("row"))
        return one.select(*(F.col("row")[c].alias(c) for c in docs.columns))

    # rows lie by doc_id after the join and are grouped where they are; a union before would send whole rows once more
    return single(docs.join(kept, "doc_id", "left_semi")).unionByName(single(docs.where("doc_id is null")))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has too.

    Null, empty and short texts and rows without doc_id stay as they are; rows with one doc_id are one document to
    others. A document of which no word is left goes. An empty table stays empty, other columns pass.
    """
    return remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each row as often as its source's target asks for.

    Null and empty texts have no size and are taken no time. A null source is one of its own, after all others. Repeated rows are
    rows of their own; ties between them are settled by order. An empty table stays empty, other columns pass.
    """
    return mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's sampled segmentation: ``doc_id, source, n_tokens, ids``.

    Null and empty texts have no pieces. Samples are drawn by row key and text, so repeated rows have one segmentation; a null
    doc_id is a key of its own. An empty table stays empty.
    """
    return encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("near duplicates", near_copies), ("substring dedup", repeats), ("mixing", mixing), ("sentencepiece", pieces)]

#: mixing and piece sampling, on top of chained alignments, have no form in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)
        docs = done
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
