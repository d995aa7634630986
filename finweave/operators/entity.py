"""Entity resolution by weighted field similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.constants import ENTITY_WEIGHTS
from finweave.functions.text import dice, entity_address, entity_name, grams, jaccard, tokens
from finweave.operators.components import connected_components
from finweave.session import materialize

DEFAULT_THRESHOLD = 0.80


def check_threshold(threshold: float) -> float:
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    return threshold


def features(entities: DataFrame) -> DataFrame:
    """What similarities are computed from: id, name and its tokens and bigrams, address tokens, dob, national_id, accounts."""
    exact = lambda c: F.lower(F.trim(c))
    return entities.where("entity_id is not null").select(
        F.col("entity_id").alias("id"), entity_name(F.col("name")).alias("name"), entity_address(F.col("address")).alias("address"), exact("dob").alias("dob"), exact("national_id").alias("nid"),
        F.array_sort(F.array_distinct(F.filter(F.coalesce("account_numbers", F.array().cast("array<string>")), lambda x: x.isNotNull()))).alias("accounts"),
    ).withColumns({"name_tokens": tokens(F.col("name")), "name_grams": grams(F.col("name")), "address_tokens": tokens(F.col("address"))})


def similarity(a: str = "a", b: str = "b") -> Column:
    """Weighted sum over name, address, dob, national_id and accounts of two feature rows held in struct columns.

    Names: 0.6 token Jaccard and 0.4 bigram Dice. Addresses: token Jaccard, two missing ones being equal. dob and national_id: equality, null equal to nothing.
    Accounts: Jaccard, 0 if either has none.
    """
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    same = lambda n: F.coalesce(x(n) == y(n), F.lit(False)).cast("double")
    name = jaccard(x("name_tokens"), y("name_tokens")) * 0.6 + dice(x("name"), y("name"), x("name_grams"), y("name_grams")) * 0.4
    accounts = F.when((F.size(x("accounts")) == 0) | (F.size(y("accounts")) == 0), 0.0).otherwise(jaccard(x("accounts"), y("accounts")))
    w = ENTITY_WEIGHTS
    return name * w["name"] + jaccard(x("address_tokens"), y("address_tokens")) * w["address"] + same("dob") * w["dob"] + same("nid") * w["national_id"] + accounts * w["account_numbers"]


def similar_pairs(entities: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Pairs of ids with at least this similarity: id_a < id_b, similarity.

    Blocking loses nothing at thresholds of 0.8 and more: without equal national_id and dob a pair reaches 0.65; with an equal dob alone it needs equal
    names, addresses and account sets to reach 0.8, so the key is dob and the account set. Below that dob alone is the key, and at 0.65 and
    less this raises, for no key is lossless.
    """
    check_threshold(threshold)
    if threshold <= 0.65:
        raise ValueError("no lossless blocking at 0.65 and below")
    rows = materialize(features(entities), "er-features")
    by_dob = F.when(F.col("dob").isNotNull() & ((F.size("accounts") > 0) if threshold >= 0.8 else F.lit(True)), F.xxhash64(F.lit("dob"), "dob", *(["accounts"] if threshold >= 0.8 else [])))
    keys = rows.select("id", F.explode(F.array_compact(F.array(F.when(F.col("nid").isNotNull(), F.xxhash64(F.lit("nid"), "nid")), by_dob))).alias("k"))
    pairs = keys.withColumnRenamed("id", "id_a").join(keys.withColumnRenamed("id", "id_b"), "k").where("id_a < id_b").select("id_a", "id_b").distinct()
    side = lambda n: rows.select(F.col("id").alias(f"id_{n}"), F.struct("*").alias(n))
    return pairs.join(side("a"), "id_a").join(side("b"), "id_b").withColumn("similarity", similarity()).where(F.col("similarity") >= threshold).select("id_a", "id_b", "similarity")


def resolve(entities: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Every entity id with its group, named by the smallest id; entities without a partner are their own group."""
    groups = connected_components(similar_pairs(entities, threshold), "id_a", "id_b")
    return entities.where("entity_id is not null").select("entity_id").distinct().join(groups.withColumnRenamed("node", "entity_id"), "entity_id", "left").select("entity_id", F.coalesce("component", "entity_id").alias("group_id"))


def network(groups: DataFrame) -> DataFrame:
    """Related ids within a group: entity_id, related_id. A group of n gives n (n - 1) rows by definition."""
    other = groups.select("group_id", F.col("entity_id").alias("related_id"))
    return groups.join(other, "group_id").where("entity_id <> related_id").select("entity_id", "related_id")


def merge(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a group: of each field the first filled value in order of id, the accounts of all, the greatest risk score.

    Aggregates only, so a group is never collected; min_by picks the first filled value.
    """
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    first = lambda c: F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col("entity_id"))).alias(c)
    rows = entities.join(groups, "entity_id")
    plain = rows.groupBy("group_id").agg(first("name"), first("address"), first("dob"), first("national_id"), F.max("risk_score").alias("risk_score"), F.count(F.lit(1)).alias("members"))
    accounts = rows.select("group_id", F.explode("account_numbers").alias("x")).distinct().groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("x")), "|").alias("accounts"))
    return plain.join(accounts, "group_id", "left").withColumn("accounts", F.coalesce("accounts", F.lit("")))


__all__ = ["features", "similarity", "similar_pairs", "resolve", "network", "merge", "check_threshold"]
