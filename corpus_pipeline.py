"""The corpus pipeline: five stages over documents, each an operator of tidepool.llm.

STAGES lists (name, function) in their order; a function takes (spark, docs,
sf_dir), where docs is what the stage before has kept, and returns a DataFrame
that is written and read again as the next one's docs. All but the last return
the columns of documents.

Documents without text have nothing toxic, fail the base rule of the quality stage
and go there. The near-duplicate stage keeps one row of those that repeat id and
text; rows without an id are none another's copies. Columns that documents has beyond
its own stay until the last stage. Empty tables pass through as such.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import line_dedup, minhash, packing, quality_rules, toxicity
from tidepool.llm.shared import marked, prefilter, read, release_scratch, restored_batches, scratch, unused


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, model)(docs["text"]) < 0.5)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the cutoffs chosen under limited risk."""
    at = unused("__rules", docs)
    return quality_rules.judge(docs, read(spark, sf_dir, "labels"), at=at).where(f"{at}.kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats. n_chars follows the text; a document goes only if all its words went, each with a line that repeats an earlier one."""
    at = unused("__lines", docs)
    out = line_dedup.dedup_lines(docs, at=at)
    out = out.where((F.col(f"{at}.n_words_removed") < F.col(f"{at}.n_words")) | (F.col(f"{at}.n_words") == 0))
    new = {"text": F.col(f"{at}.text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col(f"{at}.n_removed") > 0, F.length(f"{at}.text").cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more), and one row of those that repeat id and text."""
    found = scratch(minhash.near_duplicates(docs, percent=80), "components")
    gone = found.where("not kept").select("doc_id").distinct()
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    concerned = scratch(gone.union(repeated).distinct(), "concerned")
    # texts that the filter lets by are dealt out to meet those ids; the others stay where they are
    hit = unused("__hit", docs)
    told = marked(docs, "doc_id", concerned, hit)
    kept = told.where(~F.col(hit)).select(*docs.columns).union(told.where(hit).join(concerned, "doc_id", "left_anti").select(*docs.columns))
    if repeated.isEmpty():
        return kept
    # the repeated ids' rows alone are brought together with their texts
    again = prefilter(docs, "doc_id", repeated).join(repeated, "doc_id", "left_semi").join(gone, "doc_id", "left_anti").select(*docs.columns)
    return kept.union(again.dropDuplicates(["doc_id", "text"]))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality_rules", apply_quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: The trained and risk-controlled stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table. What a stage has written for itself is deleted when the stage is done."""
    docs = read(spark, sf_dir, "documents")
    with restored_batches(spark):
        for name, stage in STAGES:
            docs = scratch(stage(spark, docs, sf_dir), name)
            release_scratch(spark, newest=1)
    return docs
