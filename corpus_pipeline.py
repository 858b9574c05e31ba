"""The corpus pipeline: language ID, near-duplicates, PII, mixing and BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the
shared folder and gives the reread table to the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm.bpe import encode
from driftwood.llm.cluster import shared_folder
from driftwood.llm.language import predict, train
from driftwood.llm.mixing import mix
from driftwood.llm.near_dedup import representatives
from driftwood.llm.pii import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose leading language has a smaller share of its words is rejected.
LEAST_SCORE = 0.3
#: What the mix takes, in percent of all words, and the sources' weights.
MIX_PERCENT, MIX_WEIGHTS = 150, (5, 2, 1)
#: Rows and bytes of an Arrow batch: whole texts are long, and both sides of a Python worker
#: hold a batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def _own(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents, to be handed to workers in small batches.  A stage is run
    by whoever writes it, so the setting stays; ``run`` puts back what was there."""
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    return docs.select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language: rejected are those without letters (null and
    empty texts too) and those with no leading language.  ``lang`` stays as it was."""
    docs = _own(spark, docs)
    found = predict(docs, train(docs), keep=COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one of least id, of each class of near-duplicates.  Null keys
    come last, rows of null text stay unless they repeat a key, and of rows that repeat key
    and text one stays."""
    return representatives(_own(spark, docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; ``n_chars`` follows the text.  Null
    texts and their lengths stay as they are, and rows that repeat key and text are alike."""
    return redact(_own(spark, docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix does: not at all, once or twice.  Null texts
    have no words, null sources are a source of their own, null keys are keys like any
    other, and rows that repeat source and key are taken alike."""
    docs = _own(spark, docs)
    times = mix(docs, percent=MIX_PERCENT, weights=MIX_WEIGHTS).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "times").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    mixed = docs.join(times.where("times > 0"), same)
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy")).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the ids of each text and their number; null and empty texts have none, and
    repeated rows are encoded each on its own."""
    import public_tokenizers

    ids = encode(_own(spark, docs), public_tokenizers.path("word_bpe_49k.json"), keep=COLUMNS)
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

#: SQL cannot express these stages; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``.  What a stage has written is
    removed when the next one has been written; the last one's table stays."""
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    before = {name: spark.conf.get(name) for name in BATCH}
    try:
        for i, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(at := f"{folder}/{i}-{name}")
            docs = spark.read.parquet(at)
            if last is not None:
                path = spark._jvm.org.apache.hadoop.fs.Path(last)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            last = at
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return docs
