"""The corpus pipeline: five filtering and packing stages over `documents`, each written before the next one reads.

1. language: documents whose language no centroid explains go (null texts and texts without letters among them).
2. near_duplicates: of each group of documents linked by shingle overlap the one with the smallest id stays.
3. decontamination: no words of a benchmark window may stay, so the coverage limit is 0 and hit documents go.
4. secrets: every reported secret is replaced by a mark; the documents stay.
5. packing: the token counts of what is left are packed into bins of several lengths.

All but the last return the columns of documents. Stages accept empty tables and null texts as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklark.llm import decontamination, jaccard, language, packing, secrets
from tracklark.session import discard, materialize, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.fit(docs.where(~language.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"), most_coverage=0)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(packing.with_lengths(docs))


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The language stage clusters and the packing stage places by rules that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs, held = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs, path = materialize(stage(spark, docs, sf_dir))
        discard(spark, *held)
        held = [path]
    return docs
