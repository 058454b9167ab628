"""From raw documents to packed training sequences: five stages, each calling one training-data operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.llm.common import load, written
from ledgerleaf.llm.op1_quality import kept_documents
from ledgerleaf.llm.op2_jaccard_join import one_of_each
from ledgerleaf.llm.op6_decontamination import without_spans
from ledgerleaf.llm.op8_personal_data import redacted
from ledgerleaf.llm.op10_packing import digest, pack

#: The last stages' rows come from statistics, an automaton and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text fails the base rule and goes; long texts are judged whole. Repeated rows, and rows that tie, are
    judged alike. An empty table stays empty; further columns, whatever their names, are carried along.
    """
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are linked by a Jaccard similarity of 0.8 or more.

    The smallest doc_id stays, and one row of those that repeat it. Rows with a null doc_id, and rows without words, all
    stay. Long texts are one set like others. An empty table stays empty; further columns are carried along.
    """
    return one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words under benchmark windows; those at least half covered go.

    A null text has no words and stays null. Overlapping windows, of one item or several, remove a word once; long texts
    are read whole and repeated rows treated alike. An empty table stays empty; further columns are carried along.
    """
    return without_spans(docs, load(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of its kinds.

    A null text stays null. Of overlapping spans one replaces all that it shares; long texts are read whole and repeated
    rows treated alike. An empty table stays empty; further columns are carried along.
    """
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, by doc_id.

    A null or empty text is the end id alone; a long one fills several sequences. Repeated rows are packed each by itself,
    and ties in length go by file and row. An empty table gives no pieces; further columns do not matter.
    """
    return digest(pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
