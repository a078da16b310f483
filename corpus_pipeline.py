"""From raw documents to packed training sequences, in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that the one before has kept.

Every stage keeps the columns of its input, whatever their names (a column called score is the
input's own). Null texts count as empty and ids may be null or repeated: each row is judged for itself.
An empty table goes through as an empty table. Stage by stage:

- quality: an empty text has the score of one empty line and goes or stays by it; equal texts share their fate
- exact dedup: empty texts are copies of one another; ties go to the smaller id
- near dedup: texts without words are no copies of anything; ties go to the smaller id, then the first row
- mixing: an empty text has size 0 and is drawn like others; rows of one id and text share their draw
- packing: an empty text is its end id; very long texts are cut where a sequence is full
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import fresh_names, removed, saved
from factloom.llm.exact_dedup import drop_exact_copies
from factloom.llm.mixing import mixed
from factloom.llm.near_dedup import drop_near_copies
from factloom.llm.packing import pack
from factloom.llm.quality_crf import quality
from factloom.llm.queries import byte_bpe


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = score, good, held_out = tuple(fresh_names(docs, "score", "good", "held_out"))
    return quality(docs, labels, names=names).where(f"{good} = 1").drop(score, good, held_out)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1,024 ids."""
    return pack(docs, byte_bpe()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A conditional random field and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths: list[str] = []
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"), paths)
        removed(spark, paths[:-1])  # its predecessor is read no more
        paths = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
