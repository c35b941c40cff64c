"""A training corpus from `documents`: five stages, each written as Parquet and read again.

Toxic documents go; one document of each near-duplicate group stays; secrets are replaced;
sources are mixed to their weights; what is left is packed into sequences of token ids.

Defined results, stage by stage: null and empty texts are scored as texts without words, are
near duplicates of nothing, hold no secret, are taken 0 times by the mix (which so drops
them), and would pack as their closing id; very long texts are read whole by all stages and
cut, never shortened, by the last; rows with a null id are kept, and link with nothing; of
rows that repeat an id one is kept after the second stage; ties between near duplicates go
to the least id; a null source or language is one of its own; an empty table gives empty
results. All stages but the last return the columns they are given, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docprov.llm import jaccard, mixing, packing, secrets, toxicity
from docprov.llm.common import staged_alone, table, unstaged
from docprov.llm.queries import learnable
from docprov.session import attach


def no_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the learnable labels, does not reject."""
    attach(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, learnable(table(spark, sf_dir, "labels"))))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    attach(spark)
    return jaccard.without_duplicates(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    attach(spark)
    return secrets.redact(docs, length="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or the parts of them, that the mix takes, as often as it does."""
    attach(spark)
    return mixing.mixed_documents(docs, length="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, with the documents in them."""
    attach(spark)
    return packing.sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", no_toxic),
    ("near duplicates", no_copies),
    ("secrets", no_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: A trained classifier, permutations and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        before, docs = docs, staged_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if n:
            unstaged(before)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
