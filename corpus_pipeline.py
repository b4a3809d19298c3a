"""From raw documents to token ids: language ID, near-dedup, mixing of sources, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the documents are written as Parquet and read again. Ids are taken to name documents: rows of one id stay or go
together in the first stage, and one of them stays in the second and third. A document without an id goes by its text:
there it gets a number from NAMELESS on, which no real id may reach, so that real ids are preferred. Null texts and
sources, empty tables and columns named like a stage's own are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestloom.llm import bpe, langid, mixing, near_dedup, vocab
from nestloom.llm.common import dropping, small_side, table, written
from nestloom.llm.queries import BYTE_BPE

ORACLE_SQL = None
NAMELESS = 1 << 62
_KEY = "nestloom_key_"


def _keyed(docs: DataFrame) -> DataFrame:
    of_text = F.lit(NAMELESS) + F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(9)), F.lit(NAMELESS - 1))
    return docs.withColumn(_KEY, F.coalesce(F.col("doc_id").cast("bigint"), of_text))


def _one_of_each(docs: DataFrame) -> DataFrame:
    """Of the rows of one key one stays."""
    repeated = written(docs.groupBy(_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(_KEY), "repeated")
    if repeated.isEmpty():
        return docs
    again = small_side(repeated)
    return docs.join(again, _KEY, "left_anti").select(docs.columns).unionByName(docs.join(again, _KEY, "left_semi").select(docs.columns).dropDuplicates([_KEY]))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which no row has an identified language."""
    keyed = _keyed(docs)
    found = langid.identify_documents(keyed, _KEY)
    rejected = found.groupBy(_KEY).agg(F.max("kept").alias("kept_")).where("not kept_").select(_KEY)
    return keyed.join(small_side(written(rejected, "rejected")), _KEY, "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the least id stays, once."""
    keyed = _keyed(docs)
    found = near_dedup.near_duplicates(keyed, k=5, percent=80, id_col=_KEY)
    copies = written(found.where("not kept").select(F.col("doc_id").alias(_KEY)).distinct(), "near_copies")
    return _one_of_each(keyed.join(small_side(copies), _KEY, "left_anti").select(keyed.columns)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    keyed = _one_of_each(_keyed(docs))
    copies = mixing.mix_sources(keyed, id_col=_KEY).where("copies > 0").select(F.col("doc_id").alias(_KEY), F.col("copies").cast("int").alias("nestloom_copies_"))
    mixed = keyed.join(small_side(written(copies, "copies")), _KEY)
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("nestloom_copies_"))).alias("nestloom_copy_")).drop("nestloom_copy_")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of each document of the mix."""
    return bpe.encode_decode(docs, vocab.path(BYTE_BPE), keep_ids=True)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with dropping(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
