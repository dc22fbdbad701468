"""Training-data pipeline: language, quality, near-duplicates, personal data, packing.

Every stage takes the documents its predecessor kept, and its decisions take effect. All but the
last return the columns of ``documents``; columns beyond these pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import language, near_duplicates, packing, pii, quality
from threadlake.scratch import Scratch

def _renamed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Columns under names that no operator uses, and the name of the text."""
    names = [f"_column_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("text")]


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[f"_column_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; learnt from the labelled ones not held out.

    Rejected are documents without a letter, and those with a lower score than any labelled document
    not held out that is given its own language; all of these count. Null and empty texts go;
    repeated rows and ties of languages are treated alike. All rows are labelled once and written.
    """
    model = language.fit(docs.where(~language.held_out()))
    given, text = _renamed(docs)
    id, lang = (given.columns[docs.columns.index(c)] for c in ("doc_id", "lang"))
    found = Scratch(spark, "language").write(language.identify(given, model, text), "labelled")
    least = language.least_right(found.where(~language.held_out(id)), text, lang)
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least)
    return _restored(found.where(known), docs)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are more likely good than not (or as likely); null and
    empty texts fail."""
    counts = quality.with_counts(docs.select("text"), keep_text=False)
    model = quality.fit(counts)
    given, text = _renamed(docs)
    return _restored(quality.judge(quality.with_counts(given, text), model).where("kept"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates.

    Rows are numbered, so that repeated and null ids are told apart; the row with the smallest
    number of a class stays.
    """
    scratch = Scratch(spark, "near-duplicates")
    given, text = _renamed(docs)
    numbered = scratch.write(given.withColumn("_row", F.monotonically_increasing_id()), "rows")
    classes = near_duplicates.near_duplicates(numbered, scratch, "_row", text)
    copies = classes.where(F.col("_row") != F.col("class_id")).select("_row")
    return _restored(numbered.join(copies, "_row", "left_anti"), docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data and revealing terms replaced; n_chars follows the text.

    The stage before has left one document of each class of near-duplicates, so every text is
    evidence of its own.
    """
    given, text = _renamed(docs)
    clean = pii.sanitise(given, Scratch(spark, "pii"), text, keep_text=False, apart=True)
    out = _restored(clean.withColumnRenamed("sanitised", text), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in training sequences; null and empty texts take a place of size 0."""
    sized = packing.with_sizes(docs)
    return packing.pack(Scratch(spark, "packing").write(sized, "sized"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", remove_personal_data),
    ("packing", pack_documents),
]

#: The stages cannot be said in SQL; tests hold them against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written before the next one reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
