"""A corpus pipeline: language ID, quality classifier, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import langid, neardup, packing, quality
from rillmark.llm.common import marked, stored, table
from rillmark.llm.queries import tokenizer_path

#: A language prediction below this is no language that was learnt.
LEAST_LANGUAGE_SCORE = 0.3

#: SQL expresses none of the stages.
ORACLE_SQL = None


#: What stages look at. Other columns are carried.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """docs with all columns that no stage reads under names of their own, which nothing that a stage adds can have."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in READ else f"carried column {i}") for i, c in enumerate(docs.columns)])


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of _plain(docs) in rows, under docs' names."""
    return rows.select(*[F.col(f"`{p}`").alias(c) for p, c in zip(_plain(docs).columns, docs.columns, strict=True)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language; a text that is null, has no letter or fits no language goes."""
    plain = _plain(docs)
    model = langid.fit(*langid.training_sample(plain, 3, 1))
    found = langid.predict(plain, model)
    return _named(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    plain = _plain(docs)
    model = quality.fit(plain, table(spark, sf_dir, "labels"))
    return _named(quality.score(plain, model).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least doc_id. Of rows of one doc_id the least one stays, by all
    columns in order, those of kinds without an order (maps) by their JSON; rows without doc_id all stay."""
    plain = _plain(docs)
    found = neardup.near_duplicates(plain).where("doc_id is not null")
    # most documents are kept and have one row: texts of others alone are dealt
    other = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept")).where("n > 1 or not kept")
    other = stored(other, "other")
    flagged = marked(plain, other)
    sure = flagged.where("doc_id is null or not _may").drop("_may")
    maybe = flagged.where("doc_id is not null and _may").drop("_may")
    once = maybe.join(other, "doc_id", "left_anti").select(*sure.columns)
    rows = maybe.join(other.where("kept"), "doc_id", "left_semi")
    columns = [f"`{c}`" for c in plain.columns]
    order = [F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else F.col(c) for c, (_, kind) in zip(columns, plain.dtypes, strict=True)]
    least = rows.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")).select("_r.*")
    return _named(sure.unionByName(once).unionByName(least), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the training sequences of token ids; where each piece of each document lies in them."""
    return packing.spans(packing.pack_sequences(docs, tokenizer_path()))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents.

    Nulls, empty and very long texts, and ties are what each stage says. Rows without doc_id aren't learnt from nor linked, and
    stay if language and quality do; of several rows of a document one stays. An empty table gives an empty result. Columns
    beyond those of documents, whatever their names and kinds, are carried as they are to the last stage, which has its own.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
