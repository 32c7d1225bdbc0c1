"""The training-corpus pipeline: toxicity, line dedup, near-dedup, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes to the shared folder and reads
back as the next stage's ``docs``. All stages but the last return the columns of ``documents``; where a stage changes a
text, ``n_chars`` follows. Fitted parts (the toxicity model) are fitted on the stage's own input and the labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import hilbert_packing, line_spread, mixing, probminhash, toxicity_pu
from eventloom.llm.frames import TEXTS_PER_TASK, positional, read
from eventloom.session import gathered, materialize

#: The line and mixing stages have SQL of their own (op8, op10); learned scores, sketches and token ids have none.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, set to the length of the text."""
    if "n_chars" not in docs.columns:
        return docs
    names = docs.columns
    row = positional(docs)
    text, kind = F.col(f"__c{names.index('text')}"), dict(docs.dtypes)["n_chars"]
    return row.select(*(
        (F.char_length(text).cast(kind) if name == "n_chars" else F.col(f"__c{i}")).alias(name)
        for i, name in enumerate(names)))


def _few(out: DataFrame, docs: DataFrame) -> DataFrame:
    """A stage's result in parts of about ``TEXTS_PER_TASK`` of the documents it was given."""
    return gathered(out, docs.count(), TEXTS_PER_TASK)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _few(toxicity_pu.without_toxic(docs, read(spark, sf_dir, "labels")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _few(_measured(line_spread.without_boilerplate(docs)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _few(probminhash.without_near_duplicates(docs), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _few(_measured(mixing.mixed_documents(docs)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _few(hilbert_packing.pack(docs), docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
