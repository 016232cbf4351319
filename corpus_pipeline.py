"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import language_id, line_dedup, mixing, packing, simhash
from linkloom.llm.common import materialize, table, word_count
from linkloom.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: A prediction of at least this score sets a document's language, whatever it says itself.
SURE = 0.5
#: Column that holds all columns a stage doesn't work on, so that none can clash with an operator's own.
REST = "_rest"


def _apart(docs: DataFrame, *needed: str) -> DataFrame:
    """The ``needed`` columns, and all others in one struct."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*others, F.lit(0).alias("_")).alias(REST))


def _together(made: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The documents' columns again, in their order: changed ones, those worked on, those put aside."""
    held = set(made.schema[REST].dataType.names)
    values = [changed[c] if c in changed else F.col(REST)[c] if c in held else F.col(f"`{c}`") for c in columns]
    return made.select(*[value.alias(c) for value, c in zip(values, columns, strict=True)])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter in the text) go; the others get the language found, if it is sure or they have none."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    parted = _apart(docs, "doc_id", "text", "lang")
    model = language_id.fit(parted.where(~held_out), "text", "lang", F.col("doc_id"))
    found = language_id.identify(parted, model).where("lang_pred <> 'und'")
    lang = F.when((F.col("score") >= SURE) | F.col("lang").isNull(), F.col("lang_pred")).otherwise(F.col("lang"))
    return _together(found, docs.columns, lang=lang)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; a document that loses all its words goes."""
    made = line_dedup.drop_repeated_lines(_apart(docs, "doc_id", "text"))
    kept = made.where((F.col("n_dropped") == 0) | (word_count(F.col("kept_text")) > 0))
    return _with_text(kept, F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return _together(simhash.deduplicated(_apart(docs, "doc_id", "text")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    mixed = mixing.mixed_documents(_apart(docs, "doc_id", "source", "text"), word_count(F.col("text")))
    return _with_text(mixed, F.col("text"), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a sequence, with its ids."""
    return packing.pack(docs, tokenizer_path())


def _with_text(made: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    return _together(made, columns, text=text, n_chars=F.length(text).cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_languages),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, XXH64 fingerprints and the tokenizer are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
