"""The training-corpus pipeline: toxicity, line dedup, SimHash near-dedup, PII surrogates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``documents``; ``n_chars`` follows the text. Null texts count as empty where a stage reads them. SQL can't
express the stages' models and hashes, so ``ORACLE_SQL`` is None; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import linededup, packing, pii, simhash, toxicity
from tapeloom.llm.common import drop_table, write_table
from tapeloom.llm.queries import pii_key


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, ``n_chars`` (where there is one) set to the text's length."""
    return docs.select([F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose score is below 0.5; the model learns from the labelled ones outside the held-out fold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=True).filter("_predicted = 0").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the lines that at least 10 documents share; every document stays, if need be with an empty text."""
    return _counted(linededup.drop_repeated_lines(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (5-word shingles, a similarity of about 0.8 or more)."""
    return simhash.one_of_each(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets by keyed surrogates; every document stays."""
    return _counted(pii.pseudonymise(docs, pii_key(spark)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences of at most 2048 ids: one row per piece."""
    return packing.pack(docs, _tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("pii", replace_private),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder, read by the next, then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        after = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            drop_table(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
