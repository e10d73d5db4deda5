"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` applies them to the table ``documents``.

All stages read the columns of ``documents`` and return no others: extra columns,
whatever their names, are left out. Repeated rows are documents of their own
until near-duplicates go. Any column may be null, texts may be empty or very
long, and an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import mixing, neardup, packing, pseudonyms, quality
from annalist.llm.queries import PSEUDONYM_KEY, tokenizer_path
from annalist.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, accepts. A
    null or empty text gets the model's prior, and all texts 0.5 where no document
    is labelled; below 0.7 they go. Equal texts stay or go together."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest
    number; of repeated rows one. Documents without a text are no copies of each
    other and stay; all empty texts are one class. Null numbers come last."""
    return neardup.deduplicated(docs.select(*COLUMNS))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in place of personal data; formats keep their length, so only
    ``n_chars`` of texts with addresses may change. Null texts stay null, with a
    null ``n_chars``; equal values have equal pseudonyms in all documents."""
    named = pseudonyms.pseudonymised(docs.select(*COLUMNS), PSEUDONYM_KEY)
    return named.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; none for no copies. A null
    source is a source. Texts without words weigh nothing and are taken as often as
    their source's rate says, rounded down."""
    copies = mixing.mix(docs.select(*COLUMNS), carry=COLUMNS).where("copies > 0")
    return copies.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there. A
    null or empty text is the end sign alone; a long one is cut, never shortened."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", hide_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokenizing, training and searching have no SQL form; the tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, last = [stage for _, stage in STAGES]
    return last(spark, reduce(lambda kept, stage: cut_lineage(stage(spark, kept, sf_dir)), before, docs), sf_dir)
