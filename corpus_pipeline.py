"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delver.llm.common import fresh, stored
from delver.llm.decontaminate import mark
from delver.llm.langid import identify, train
from delver.llm.linededup import line_dedup
from delver.llm.minhash import near_duplicates
from delver.llm.mixing import materialise, mix

#: A document whose best language is less likely than this is rejected, as is one without letters.
MIN_LANGUAGE_SCORE = 0.4


def _hidden(docs: DataFrame, *names: str) -> dict[str, str]:
    """New names for the columns of docs that an operator would replace."""
    own = [c for c in docs.columns if c.lower() in names]
    return dict(zip(own, fresh(docs.columns, *[f"_{c}" for c in own]), strict=True))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters go.

    A null or empty text goes. Repeated rows have one fate, equal margins fall to the language that sorts first. An
    empty table stays empty. Other columns pass through, lang_pred and score as they were.
    """
    renamed = _hidden(docs, "lang_pred", "score")
    scored = identify(docs.withColumnsRenamed(renamed), train(docs))
    kept = scored.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({h: c for c, h in renamed.items()}).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines leave the texts; a document of which nothing but white space is left goes.

    A null text and a text that loses nothing stay as they are. Lines on exactly the least number of sites are
    boilerplate; repeated rows have one fate. An empty table stays empty. n_chars, if there is one, is
    counted anew where lines went. Other columns pass through, n_lines and n_removed as they were.
    """
    renamed = _hidden(docs, "n_lines", "n_removed")
    out = line_dedup(docs.withColumnsRenamed(renamed)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop("n_lines", "n_removed").withColumnsRenamed({h: c for c, h in renamed.items()}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest (doc_id, hash of text).

    Rows are told apart by doc_id and text, so two texts under one doc_id are two documents; rows alike in both
    are one, but for rows without doc_id, which all stay. Null and empty texts stay. An empty table stays empty.
    Other columns pass through, whatever their names.
    """
    (tag,) = fresh(docs.columns, "tag")
    gone = near_duplicates(docs).where("not kept").select("doc_id", F.col("tag").alias(tag)).distinct()
    tagged = docs.withColumn(tag, F.xxhash64("text"))
    kept = tagged.join(gone, (tagged["doc_id"] == gone["doc_id"]) & (tagged[tag] == gone[tag]), "left_anti")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", tag]).unionByName(kept.where("doc_id is null")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Rows are judged one by one, those without doc_id, too.

    Null and empty texts are clean, repeated rows have one fate, an empty table stays empty. Other columns pass
    through, n_hit as it was.
    """
    renamed = _hidden(docs, "n_hit")
    marked = mark(docs.withColumnsRenamed(renamed), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where("n_hit = 0").drop("n_hit").withColumnsRenamed({h: c for c, h in renamed.items()}).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once for each epoch that its source's weight asks for.

    A null source is a source; a null or empty text comes once per whole epoch; repeated rows have one fate; ties
    of the permuting hashes are broken by doc_id and text. An empty table stays empty. Other columns pass
    through; weight, epoch, block_rank and doc_rank are added or replaced.
    """
    return materialise(docs, mix(docs))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
]

#: Kernel classification and hashed darts have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
