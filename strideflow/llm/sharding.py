"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group and stay together. A group is a vector (bytes, tokens,
rows), each in parts of a shard's even share, so that the three weigh alike; it goes to the
shard where the dot product with the shard's residual capacity is highest, the largest
groups first. Groups that are heavy in any resource are few, and are placed first; only one
above ``CUT``, half of a shard, is cut into pieces, as a group that holds a third of all
rows fits in no shard of forty. The other groups are dealt by a hash to cells of about
``CELL``; each cell has its part of the capacity that the heavy ones left and places its
groups by itself, so that cells run side by side whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_rows, read_table, staged, text_or_empty, unit_hash, within_rank

ROW_OVERHEAD = 16
SHARDS = 40
#: A group above this part of a shard's share of a resource is heavy.
HEAVY = 1 / 256
#: The part of a shard's share of a resource above which a group of equal texts is cut.
CUT = 0.5
#: The part of a shard that its pieces have at most, small enough to be spread evenly.
PIECE = 1 / 16
#: Groups that are placed one after the other, at about most.
CELL = 10_000
#: The text's share of a row's tokens: white-space separated words.
WORD = r"[^\x20\x09-\x0D]+"
RESOURCES = ("bytes", "tokens", "rows")


def place(items: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each item: the one whose residual capacity has the highest dot product with it.

    ``items``: one row for each item, one column for each resource, in parts of a shard;
    ``residual``: one row for each shard, in the same unit, which is brought up to date.
    Items are placed from the one with the largest part of any resource down.
    """
    out = np.zeros(len(items), dtype=np.int32)
    for i in np.lexsort((np.arange(len(items)), -items.max(axis=1, initial=0))):
        best = int(np.argmax(residual @ items[i]))
        out[i] = best
        residual[best] -= items[i]
    return out


def shard(documents: DataFrame, shards: int = SHARDS, cell: int = CELL) -> DataFrame:
    """Every row of ``documents`` (doc_id, text) with its shard and its slot there.

    Returns doc_id, size, tokens, text_crc32, shard, slot. Size is the text's UTF-8 bytes
    plus 16; a null text has no bytes, no tokens and the checksum of no bytes, and forms
    one group with the empty text. Repeated rows are kept, each with a slot of its own;
    a null doc_id is a value like any other. An empty table gives an empty result. Other
    columns are not read.
    """
    text = text_or_empty()
    rows = documents.select(
        F.col("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__hash"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = staged(rows, "shard-rows")  # from here on a row's number is the same in every reading
    spark = documents.sparkSession
    key = ["__hash", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    groups = staged(groups, "shard-groups")
    whole = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in RESOURCES], F.count(F.lit(1)).alias("n")).first()
    even = np.array([max(whole[c], 1) / shards for c in RESOURCES])
    parts = [F.col(c) / F.lit(float(x)) for c, x in zip(RESOURCES, even, strict=True)]
    groups = groups.withColumn("__part", F.greatest(*parts))

    # Every resource has fewer than shards / HEAVY heavy groups, so all that follows about them is bounded by the number of shards.
    heavy = groups.where(F.col("__part") > HEAVY).select(*[F.col(c).alias(f"h_{c}") for c in key], F.when(F.col("__part") > CUT, F.least(F.ceil(F.col("__part") / PIECE), F.col("rows"))).otherwise(F.lit(1)).alias("pieces"))
    heavy = F.broadcast(staged(heavy, "shard-heavy"))
    same = [F.col(c) == F.col(f"h_{c}") for c in key]
    marked = rows.join(heavy, same[0] & same[1] & same[2], "left")
    marked = marked.withColumn("piece", F.floor(unit_hash("__row") * F.col("pieces")).cast("int")).drop("pieces", *[f"h_{c}" for c in key])
    pieces = marked.where("piece is not null").groupBy(*key, "piece").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    few = pieces.toPandas().sort_values([*key, "piece"])
    residual = np.ones((shards, len(RESOURCES)))
    few["shard"] = place(few[list(RESOURCES)].to_numpy(dtype=float) / even, residual)
    plan = spark.createDataFrame(few[[*key, "piece", "shard"]].astype("int64").values.tolist(), "__hash long, text_crc32 long, size long, piece int, shard int")
    first = marked.where("piece is not null").join(F.broadcast(plan), [*key, "piece"])

    n_cells = max(1, -(-whole["n"] // cell))

    def place_cell(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(key)
        return own[key].assign(shard=place(own[list(RESOURCES)].to_numpy(dtype=float) / even, residual / n_cells))

    light = groups.where(F.col("__part") <= HEAVY).withColumn("__cell", F.pmod(F.xxhash64(*key), F.lit(n_cells)))
    placed = light.select(*key, *RESOURCES, "__cell").groupBy("__cell").applyInPandas(place_cell, "__hash long, text_crc32 long, size long, shard int")
    others = marked.where("piece is null").join(placed, key)
    columns = ["doc_id", "size", "tokens", "text_crc32", "__row", "shard"]
    both = staged(first.select(*columns).unionByName(others.select(*columns)), "shard-placed")
    out = within_rank(both, "shard", unit_hash("__row"), [F.col("doc_id"), F.col("__row")], "slot", group_rows(whole["rows"], spark))
    return out.drop("__row")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law of near equal bytes."""
    out = shard(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
