"""The training-data pipeline: toxic documents go, then exact and near copies, then benchmark leaks; the rest is packed.

In every stage a null text is an empty one, documents with null ids take part and come after all others, repeated rows are rows like others, very long
texts are read whole, further columns stay (but not the name _tallyforge_row, which the stages use for a while), and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from tallyforge.llm.common import ROW, numbered, stored, table, vocabulary, without
from tallyforge.sources.scratch import drop_stored, tables_stored


#: Documents in an Arrow batch on its way to Python: some MB, where Spark's 10,000 rows may be a hundred.
BATCH_ROWS = "1000"


def _tuned(spark: SparkSession) -> None:
    """Unless the session was given another size, batches are of BATCH_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, BATCH_ROWS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go; none do where no labels can be learned from."""
    _tuned(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays: the one with the most code points, then the smallest doc_id; null and blank texts are equal."""
    _tuned(spark)
    rows = numbered(docs)
    return without(rows, exact_dedup.exact_dedup(rows, row_col=ROW).filter("not kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the smallest doc_id. Groups are those of op6's contract; the pipeline takes without_similar."""
    _tuned(spark)
    rows = numbered(docs)
    return without(rows, near_dedup.near_dedup(rows, row_col=ROW).filter("not kept"))


def without_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id. Links: a Jaccard similarity of 0.8 or more, on five-word shingles;
    texts without words are one group."""
    _tuned(spark)
    rows = numbered(docs)
    return without(rows, near_dedup.similar_dedup(rows, row_col=ROW).filter("not kept"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten benchmark words, or with a whole shorter item, go; an empty benchmark takes none."""
    _tuned(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, laid out in sequences; an empty text is a piece of one token."""
    _tuned(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_similar),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL cannot express the classifier, SimHash and packing; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written before the next reads it; what a stage stored on its way is dropped then. Without documents: no pieces."""
    docs, before = table(spark, sf_dir, "documents"), tables_stored()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        drop_stored(keep=before + tables_stored()[-1:])
    return STAGES[-1][1](spark, docs, sf_dir)
