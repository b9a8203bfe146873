"""The corpus pipeline: five stages over documents, each by one operator of quillon.llm.

A stage gets all that its predecessor kept. All but the last return the columns of documents;
the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.jaccard_join import representatives
from quillon.llm.packing import pack
from quillon.llm.quality_classifier import quality_classifier
from quillon.llm.quality_rules import quality_rules
from quillon.llm.queries import vocabulary
from quillon.llm.shared import column, written
from quillon.llm.suffix_dedup import suffix_dedup

#: Near duplicates: words of a shingle, and the similarity in hundredths.
SHINGLE, SIMILARITY = 5, 80
#: Words of a generation that packing remembers: a worker packs beside what four stages have left in its executor.
GENERATION = 100_000


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all of the row in one column, so that none of its columns meets an operator's own."""
    return docs.select("doc_id", "text", F.struct(*[column(c) for c in docs.columns]).alias("row"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counted rules and the isolation forest keep.

    Null and empty texts are rejected; repeated rows, ties and long texts are judged each by itself.
    """
    return quality_rules(_whole(docs), _labels(spark, sf_dir), ["row"]).where("kept").select("row.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote accepts. Null and empty texts score 0 and are rejected; repeated rows are scored each."""
    return quality_classifier(_whole(docs), _labels(spark, sf_dir), ["row"]).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least doc_id, null only if there is no other.

    Texts without words are no duplicates of each other and stay, a repeated (doc_id, text) once.
    """
    return representatives(docs, SHINGLE, SIMILARITY)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that occur elsewhere; n_chars, if there, follows the text.

    Null texts become empty ones. Repeated rows are occurrences of each other, so both lose what they share.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(*[column(c) for c in rest]).alias("row"))
    out = suffix_dedup(packed, carry=["row"], text=True).withColumn("chars", F.length("kept_text").cast("long"))
    made = {"text": F.col("kept_text").alias("text"), "n_chars": F.col("chars").alias("n_chars")}
    return out.select(*[made.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in their sequences. A null or empty text has one piece, its end token."""
    return pack(docs, vocabulary("word_bpe_49k.json"), generation=GENERATION)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near duplicates", near_duplicates), ("repeated substrings", repeated_substrings), ("packing", packing)]

#: SQL can't express the forest, the vote, or the program of patterns; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
