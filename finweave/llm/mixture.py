"""Mixing sources to target weights: whole documents in blocks, interleaved by Pfair windows."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from heapq import heappop, heappush
from math import lcm

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finweave.session import attach, materialize

TOKENIZER = os.environ.get("FINWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Least tokens of a block, and most blocks of a mixture: beyond them blocks grow. The interleaving keeps every source within one block of its target at any point.
BLOCK_TOKENS, BLOCKS = 10_000, 1_000_000
#: Documents of a bucket and buckets of a group when running totals are built.
BUCKET, GROUP = 1000, 1024


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("finweave", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, columns: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """``columns`` and n_tokens of each text by a public tokenizer; a null text has none. The vocabulary is shipped with the job."""
    import public_tokenizers

    name, pattern = os.path.basename(path), public_tokenizers.PATTERN
    documents.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name), pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*columns, "n_tokens"])

    rows = documents.select(*columns, text)
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_tokens bigint")


def source_name(column: str):
    """One spelling of a source: lower case, words joined by an underscore."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(column)), r"[\s\-_]+", "_"), F.lit(""))


@dataclass
class Target:
    source: str
    weight: float
    max_repeats: int
    total: int
    documents: int
    share: float = 0.0
    quota: int = 0


def schedule(weights: list[float], blocks: int) -> list[np.ndarray]:
    """The slots of each weight's blocks among the first ``blocks`` slots.

    Block k of a source with share u is released at floor(k/u) and due at ceil((k+1)/u); of the released ones the earliest deadline
    takes the slot. Shares are exact fractions that sum to 1, so every block is in time and no source is ever a whole block from its share, however long
    the schedule is.
    """
    parts = [Fraction(w) for w in weights]
    unit = lcm(*(p.denominator for p in parts)) if parts else 1
    whole = [int(p * unit) for p in parts]
    all_ = sum(whole)
    slots: list[list[int]] = [[] for _ in whole]
    waiting = [(0, k) for k in range(len(whole))]  # (release, source) of each source's next block
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for t in range(blocks):
        while waiting and waiting[0][0] <= t:
            _, k = heappop(waiting)
            heappush(ready, (-(-(len(slots[k]) + 1) * all_ // whole[k]), k))
        _, k = heappop(ready)
        slots[k].append(t)
        heappush(waiting, (len(slots[k]) * all_ // whole[k], k))
    return [np.array(s, np.int64) for s in slots]


def plan(supply: DataFrame, targets: DataFrame, size: int | None = None) -> list[Target]:
    """The targets (a fixed table) with what each source holds, its share and its quota of tokens.

    ``size`` is the wanted total; sources that reach their cap of repeats before their share of it fall short. Without it the total is the largest at which
    none does, so all shares are met. Sources without documents can't contribute; their weight
    goes to the others in proportion. Sources without a target don't take part; weights that are null or not positive neither.
    """
    have = {r["source"]: (r["total"], r["n"]) for r in supply.join(F.broadcast(targets.select(source_name("source").alias("source"))), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("n")).collect()}
    rows = targets.select(source_name("source").alias("source"), "target_weight", "max_repeats").where("source is not null").orderBy("source").collect()
    out = [Target(r["source"], float(r["target_weight"] or 0), max(0, r["max_repeats"] if r["max_repeats"] is not None else 1), *have.get(r["source"], (0, 0))) for r in rows]
    able = [t for t in out if t.weight > 0 and t.total * t.max_repeats > 0]
    if not able:
        return out
    weight = sum(t.weight for t in able)
    most = min(t.total * t.max_repeats * weight / t.weight for t in able)
    for t in able:
        t.share = t.weight / weight
        t.quota = min(t.total * t.max_repeats, int((most if size is None else size) * t.share + 0.5))
    return out


def running_totals(rows: DataFrame, key: str, value: str, counts: dict[str, int], order: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows ahead in the same key, in an order drawn by hash.

    Sums run inside buckets of about BUCKET rows, over the buckets of a group, and over groups, so a key with a third of all rows is
    added up by as many tasks as it has buckets.
    """
    buckets = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(max(1, n // BUCKET)))))
    drawn = rows.withColumn("__h", F.xxhash64(order)).withColumn("__b", F.pmod("__h", buckets[F.col(key)]).cast("int")).withColumn("__g", F.floor(F.col("__b") / GROUP).cast("int"))
    sums = drawn.groupBy(key, "__g", "__b").agg(F.sum(value).alias("__s"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = sums.groupBy(key, "__g").agg(F.sum("__s").alias("__s")).withColumn("__group", F.coalesce(F.sum("__s").over(ahead(Window.partitionBy(key).orderBy("__g"))), F.lit(0))).drop("__s")
    offsets = sums.withColumn("__bucket", F.coalesce(F.sum("__s").over(ahead(Window.partitionBy(key, "__g").orderBy("__b"))), F.lit(0))).join(over, [key, "__g"]).drop("__s")
    inside = F.coalesce(F.sum(value).over(ahead(Window.partitionBy(key, "__g", "__b").orderBy("__h", order))), F.lit(0))
    return drawn.withColumn("__in", inside).join(offsets, [key, "__g", "__b"]).withColumn("before", F.col("__in") + F.col("__bucket") + F.col("__group")).drop("__h", "__b", "__g", "__in", "__bucket", "__group")


def supply(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens of all documents that have a source and at least one token."""
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), source_name(source).alias("source"), F.col(text).alias("text"))
    return materialize(count_tokens(rows.where("source is not null"), ["doc_id", "source"], "text", path).where("n_tokens > 0"), "mixture-tokens")


def mix(tokens: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS, size: int | None = None) -> DataFrame:
    """The mixture: slot, source, doc_id, repeat (from 0), n_tokens; ordered by slot, documents of one block share a slot.

    A source is laid out in hash order, once for each repeat, and cut off at its quota; the block a document begins in decides its slot. ``size`` as in ``plan``.
    """
    able = [t for t in plan(tokens, targets, size) if t.quota > 0]
    spark = tokens.sparkSession
    if not able:
        return spark.createDataFrame([], "slot bigint, source string, doc_id bigint, repeat int, n_tokens bigint")
    length = max(t.quota / t.share for t in able)
    block = max(block, -(-int(length) // BLOCKS))
    blocks = -(-int(length) // block) + len(able)
    slots = schedule([t.weight for t in able], blocks)
    frame = pd.DataFrame({"source": np.repeat([t.source for t in able], [len(s) for s in slots]), "k": np.concatenate([np.arange(len(s)) for s in slots]), "slot": np.concatenate(slots)})
    # the last block of a source may be due only beyond the schedule; it stands at its end
    table = spark.createDataFrame([(t.source, t.total, t.quota, blocks + n) for n, t in enumerate(able)], "source string, total bigint, quota bigint, end bigint")
    rows = running_totals(tokens.join(F.broadcast(table.select("source")), "source", "left_semi"), "source", "n_tokens", {t.source: t.documents for t in able}, "doc_id")
    placed = (
        rows.join(F.broadcast(table), "source")  # one row a target
        .where("before < quota")
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1 - F.col("before")) / F.col("total")).cast("int"))))
        .withColumn("k", F.floor((F.col("before") + F.col("repeat") * F.col("total")) / block).cast("bigint"))
    )
    slot = spark.createDataFrame(frame, "source string, k bigint, slot bigint")  # about BLOCKS rows at most
    return attach(placed, slot, ["source", "k"], rows=len(frame)).select(F.coalesce("slot", "end").alias("slot"), "source", "doc_id", "repeat", "n_tokens")


def shares(mixture: DataFrame, tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """For every target what was reached: target_share, reachable_share, actual_share, tokens, documents, mean_repeats, available_tokens."""
    wanted = plan(tokens, targets)
    weight = sum(max(0.0, t.weight) for t in wanted) or 1.0
    rows = [(t.source, t.weight / weight, t.share, t.total, t.max_repeats) for t in wanted]
    table = tokens.sparkSession.createDataFrame(rows, "source string, target_share double, reachable_share double, available_tokens bigint, max_repeats int")
    reached = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())  # a row a target
    return (
        table.join(reached, "source", "left")
        .withColumn("actual_share", F.when(all_tokens > 0, F.coalesce("tokens", F.lit(0)) / all_tokens).otherwise(F.lit(0.0)))
        .select(
            "source", "target_share", "reachable_share", "actual_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
            F.when(F.col("available_tokens") > 0, F.coalesce("tokens", F.lit(0)) / F.col("available_tokens")).alias("mean_repeats"), "max_repeats", "available_tokens",
        )
    )
