"""A corpus in five stages: toxicity, language, near duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents.  run() writes
each stage's rows to the shared folder as Parquet and reads them for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import _text, decontaminate, jaccard_join, language, pack, toxicity
from attestry.llm.queries import tokenizer_path

#: Language scores below this are no text of any learned language: unrelated trigrams reach that cosine by chance.
MIN_LANGUAGE_SCORE = (1 + language.CHANCE) / 2
#: Distinct words, or distinct characters, from which on a text says enough to be rejected for its score.
TELLING_WORDS, TELLING_CHARACTERS = 16, 40
#: Columns that the stages read; all others travel under names that no operator uses.
READ = ["doc_id", "text", "lang"]


def _kept(docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that keep leaves, with the columns of docs, whatever their names, as they were."""
    names = [c if c in READ else f"_column{k}" for k, c in enumerate(docs.columns)]
    left = keep(docs.toDF(*names))
    return left.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are likelier toxic than not.

    Null and empty texts get the score of no toxic segment; repeated rows are each judged; an empty table stays empty.
    """
    labels = _text.read(spark, sf_dir, "labels")
    return _kept(docs, lambda rows: toxicity.toxicity(rows, labels).filter("predicted = 0"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose profile is no nearer to a learned language than chance.

    Texts of few distinct words and characters say too little for that and stay. Null and empty texts go; rows of null lang teach nothing but are judged, all of them going where nothing can be learned;
    repeated rows are each judged; an empty table stays empty.
    """
    distinct = lambda pattern: F.size(F.array_distinct(F.split(F.lower("text"), pattern)))
    telling = (distinct("[\\x20\\x09-\\x0D]+") >= TELLING_WORDS) | (distinct("") >= TELLING_CHARACTERS)
    known = (F.col("score") >= MIN_LANGUAGE_SCORE) | ~telling
    return _kept(docs, lambda rows: language.language_id(rows).filter((F.col("lang_pred") != "und") & known))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates.

    Texts without a word are near to nothing and all stay; of repeated rows one stays; an empty table stays empty.
    """
    return _kept(docs, jaccard_join.keep_one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark window.

    Null and empty texts hold none; repeated rows are each judged; an empty table, or an empty benchmark, rejects nothing.
    """
    benchmark = _text.read(spark, sf_dir, "benchmark")
    return _kept(docs, lambda rows: decontaminate.decontaminate(rows, benchmark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents, packed along the curve, with their ids; see ``pack`` for its defined cases."""
    return pack.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Classifiers and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces; each stage's rows go from the shared folder once the next stage's are written."""
    docs = _text.read(spark, sf_dir, "documents")
    folder = _text.new_folder(spark, "pipeline")
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            _text.remove(spark, done)
        done = f"{folder}/{name}"
    return docs
