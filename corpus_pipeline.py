"""From raw documents to token ids: drop toxic texts, boilerplate lines and near copies, mix sources, encode.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a frame. All but the
last keep the columns of documents. Stages that run Python set the session's bytes of an Arrow batch
(small_batches), for good, since what they return is computed later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import bpe, linededup, mixing, setsketch, toxicity
from stowage.llm.common import small_batches, stored, table
from stowage.llm.queries import tokenizer_path

#: No stage of a neural net, of sketches or of BPE can be put in SQL; tests compare run() with brute force.
ORACLE_SQL = None

#: Words of a shingle in the near-dedup stage; pairs of words are the contract of op9 alone.
SHINGLE = 5

#: Ids to drop, or to look at again, go to all executors only up to so many.
BROADCAST_KEYS = 1_000_000


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score below 0.5."""
    small_batches(spark)
    net = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, net, out="__toxicity").where(F.col("__toxicity") < 0.5).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that stand in too large a part of their source's documents; every document stays."""
    return _sized(linededup.drop_boilerplate(docs, text="text", host="source").select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the row with the smallest id, of one id the least text; ids may repeat or be null (last)."""
    small_batches(spark)
    key, ids = "doc_id", docs.groupBy("doc_id").count()
    if not ids.where("count > 1 or doc_id is null").isEmpty():  # rows get ids of their own, in the order in which they stay
        key, order = "__row", [F.col("doc_id").asc_nulls_last(), "text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
        docs = stored(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()))
    gone = setsketch.near_duplicates(docs, key, size=SHINGLE).where(~F.col("kept")).select(key)
    return _without(docs, gone.distinct(), key).drop("__row")


def _without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    few = ids.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(ids) if few else ids, key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, each as often as the mix takes it."""
    return mixing.training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts."""
    small_batches(spark)
    coded = bpe.encode(docs, tokenizer_path(), keep=["doc_id", "text"])
    sha = lambda c: F.sha2(c, 256)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", sha(F.col("ids")).alias("ids_sha256"), sha(F.encode("decoded", "UTF-8")).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
