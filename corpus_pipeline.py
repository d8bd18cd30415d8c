"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing sources, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return
the columns of documents. run() writes each stage's rows to the shared folder and reads
them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm import jaccard_join, language_id, line_dedup, mixing, packing
from lockstep.llm.common import documents, forget, scratch, settle
from lockstep.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, fitted on docs' own learning folds, doesn't reject."""
    return language_id.accepted(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; documents of which nothing is left go."""
    out = line_dedup.dedup(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    columns = {c: F.col("doc")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, size).otherwise(columns["n_chars"])
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.75 or more hold together."""
    return jaccard_join.one_row_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those with a null doc_id are drawn by their text."""
    return mixing.mix(docs, by_text=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, a row each."""
    return packing.pack(docs, tokenizer_path(spark))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' rows. At any time the documents of one stage, or of two while one is written, are on disk, and what the stage at work has settled."""
    docs, last = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(settle(stage(spark, docs, sf_dir)))
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
