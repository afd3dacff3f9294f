"""A corpus pipeline: each stage takes all that the one before kept, and returns documents again.

Stages: language identification (documents without a letter, or like no learned language, go), line dedup, near-dedup
by SimHash and by prefixes of shingle sets (one document of each group stays), benchmark decontamination (documents that
hold an item go), SentencePiece coding (ids and decoded text are added). Every stage takes (spark, docs, sf_dir) and
returns a DataFrame; `run` writes each one's result to the shared folder and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, decontamination, langid, line_dedup, sentencepiece_codec, similar

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3  # of four languages, a guess has 0.25: below this a text is like none of them


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; null texts and texts without a letter go, and all documents if none
    is labelled. Rows that repeat an id are judged one by one; columns of the input stay as they are, whatever their
    names.
    """
    _shared.ship(spark)
    names = _shared.free_name(docs, "lang_pred"), _shared.free_name(docs, "score")
    found = langid.predicted(docs, langid.train(docs), names=names)
    return found.where((F.col(names[0]) != langid.UNDETERMINED) & (F.col(names[1]) >= LEAST_SCORE)).drop(*names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat earlier ones, but for at most three edits (lines of fewer than 20 characters: exactly);
    n_chars follows the text. Documents that lose lines and have none left but blank ones go; all others stay, null
    texts and rows without an id as they are. Rows that repeat an id are documents of their own unless their texts
    agree.
    """
    _shared.ship(spark)
    out = line_dedup.deduplicated(docs, most=3, least=20, drop_blank=True, short=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (sets of five-word shingles of similarity 0.8 or more, or
    linked by such pairs): the one with the smallest doc_id. Rows of that id all stay, and so do rows without an id;
    documents without words, null texts included, are one group.
    """
    _shared.ship(spark)
    return similar.one_of_each(docs, size=5, least="0.8").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage close to a benchmark item. Null and empty texts stay, as do all documents if
    there are no items; rows that repeat an id are judged one by one.
    """
    items = _shared.table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontamination.decontaminated(docs, items).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids (begin and end ids included) and decoded_text, of each row; a null text is empty. Columns that
    have these names already become token_ids_input and decoded_text_input.
    """
    _shared.ship(spark)
    return sentencepiece_codec.with_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again. Tables that a stage keeps for itself go when its
    result is written, and that result when the next one is.
    """
    docs, before = _shared.table(spark, sf_dir, "documents", *COLUMNS), None
    for name, stage in STAGES:
        with _shared.kept_for(spark) as made:
            docs, path = _shared.stored_at(stage(spark, docs, sf_dir), name)
            made.remove(path)
            made += [before] if before else []
        before = path
    return docs
