"""Queries of the training-data problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finweave.llm import addresses, langid, leak, mixture, names
from finweave.sources.tables import load


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_party(load(spark, d, "entities"))


def p3_parties(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its party."""
    return names.parties(load(spark, d, "entities"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_place(load(spark, d, "entities"))


def p7_places(spark: SparkSession, d: str) -> DataFrame:
    """Every address with the class of its place."""
    return addresses.place_classes(load(spark, d, "entities"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "item_text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Each leak with the length of its passage and where it begins."""
    return _leaks(spark, d)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(mixture.supply(load(spark, d, "documents")), load(spark, d, "mixture_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares really reached."""
    tokens, targets = mixture.supply(load(spark, d, "documents")), load(spark, d, "mixture_targets")
    return mixture.shares(mixture.mix(tokens, targets), tokens, targets)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents")
    return langid.segments(documents, "doc_id", "text", langid.train(langid.sample(documents, "text", "lang")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.relabelled(load(spark, d, "documents"), "doc_id", "lang", langid.document_languages(_segments(spark, d)))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its languages, each with its words and confidence; nulls where none could be told."""
    return load(spark, d, "documents").select("doc_id").join(langid.document_languages(_segments(spark, d)), "doc_id", "left")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


QUERIES = {f.__name__: f for f in (p3_found, p3_parties, p7_found, p7_places, p8_found, p8_passages, p9_mixture, p9_shares, p10_found, p10_documents, p10_segments)}
SQL: dict[str, str] = {}
