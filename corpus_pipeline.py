"""A corpus from documents to token files: five stages, each written as Parquet and read again before the next.

quality rules -> near duplicates -> benchmark decontamination -> mixing to target weights -> token ids. Each stage works on all that the one before kept, and is written before the next is called.

All stages take rows with nulls in any column, empty tables (which stay empty) and further columns of any name, which they keep as they are; what each makes of nulls, ties and repeated rows is said with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import binary, common, decontaminate, mixing, neardup, quality_rules


@common.stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the robust outlier test reject.

    A null or empty text has no words and fails the base rules. A null language or source is a group like any other. Repeated rows are judged alike, so all stay or all go.
    """
    return quality_rules.pass_rules(docs)


@common.stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates, of a similarity of 0.8 or more.

    It is the one with the smallest id. Of rows that repeat an id and its text one stays; other texts of the id are documents of their own. Rows without an id, a text or a word are linked with nothing and stay.
    """
    return neardup.without_near_duplicates(docs, 80)


@common.stage
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out, and drops documents that are mostly such passages.

    A null or empty text has none and stays as it is, as all do where the benchmark is empty; a null or empty item matches nothing. Repeated rows are cut alike. n_chars follows the text.
    """
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


@common.stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in the queue's order.

    A null source is one more source, the last. Rows of an equal finish time go by their id; rows that repeat an id are each taken by itself. A document without words has no size, and isn't taken.
    """
    return mixing.mixed(docs)


@common.stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files; returns what is read back from them.

    Files are in the order of ids, rows without one first, those of one id by their text; a null or empty text is its end id alone. Repeated rows are written each. No documents: no files, no rows.
    """
    import public_tokenizers

    return binary.round_trip(docs, str(public_tokenizers.path("word_bpe_49k.json")))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", clean),
    ("mixing", mix),
    ("token_ids", token_ids),
]
#: Exact similarity over all pairs and the tokenizer can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, common.staged(stage(spark, docs, sf_dir), name)
        if k:
            common.drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
