"""Shards of near-equal bytes from groups that must not be divided.

Karmarkar-Karp differencing for k shards: every group begins as a partial
partition with its size in one shard; the two partial partitions with the
largest spread (fullest less emptiest shard) are combined, the fullest shard of
one with the emptiest of the other, until one is left.

Groups of more than a small share of the bytes, of which there can only be few,
are differenced on the driver. The others are dealt by hash into parts of
bounded size; a task differences each part into k bundles, and the bundles,
whose number is bounded too, are differenced with the large groups.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents, salted_rank, written

SHARDS = 8
#: Groups that one task differences (about 1 KB each), and the parts there are at least and at most before the last step.
GROUPS_A_PART, PARTS = 50_000, 256


def difference(tuples: list[tuple[int, ...]]) -> list[list[int]]:
    """For each tuple of k sums, the shard to which each of its k places goes. Ties go by position, so equal input gives equal output."""
    if not tuples:
        return []
    k = len(tuples[0])
    joined: list[tuple[int, int, list[tuple[int, int]]]] = []  # two partial partitions, and for each place the places of these
    heap, orders = [], []
    for i, sums in enumerate(tuples):
        order = sorted(range(k), key=lambda j: -sums[j])
        orders.append(order)
        heap.append((-(sums[order[0]] - sums[order[-1]]), i, tuple(sums[j] for j in order)))
    heapq.heapify(heap)
    n = len(tuples)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        met = sorted(((x[j] + y[k - 1 - j], j) for j in range(k)), key=lambda z: (-z[0], z[1]))
        joined.append((a, b, [j for _, j in met]))
        heapq.heappush(heap, (-(met[0][0] - met[-1][0]), n + len(joined) - 1, tuple(s for s, _ in met)))
    shard: list[list[int]] = [[]] * (n + len(joined))
    shard[heap[0][1]] = list(range(k))
    for i in range(len(joined) - 1, -1, -1):
        a, b, places = joined[i]
        left, right = [0] * k, [0] * k
        for place, j in enumerate(places):
            left[j] = right[k - 1 - j] = shard[n + i][place]
        shard[a], shard[b] = left, right
        shard[n + i] = []
    out = []
    for i in range(n):
        own = [0] * k
        for place, j in enumerate(orders[i]):
            own[j] = shard[i][place]
        out.append(own)
    return out


def assign_groups(groups: DataFrame, shards: int = SHARDS, groups_a_part: int = GROUPS_A_PART, parts: int = PARTS) -> DataFrame:
    """(group_key, shard) from a written table of group_key (string) and bytes (long), one row a group.

    Large is a group of more than 1/(shards x parts) of all bytes, so there are
    fewer than shards x parts of them; the driver differences at most twice as
    many sizes. If the parts needed exceed `parts`, a second level of tasks
    differences the tuples of many parts into one.
    """
    spark = groups.sparkSession
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        return groups.select("group_key", F.lit(0).alias("shard")).limit(0)
    large = F.col("bytes") * (shards * parts) > total
    many = max(parts, -(-n // groups_a_part))

    def local(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "group_key"], ascending=[False, True])
        found = difference([(int(x),) + (0,) * (shards - 1) for x in rows["bytes"]])
        return pd.DataFrame({"group_key": rows["group_key"], "bytes": rows["bytes"], "part": rows["part"], "place": [x[0] for x in found]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index="part", columns="place", values="bytes", fill_value=0, aggfunc="sum").reindex(columns=range(shards), fill_value=0).sort_index()
        found = difference([tuple(int(x) for x in own) for own in table.to_numpy()])
        flat = [(p, j, to) for p, own in zip(table.index, found) for j, to in enumerate(own)]
        return pd.DataFrame(flat, columns=["part", "place", "to"]).assign(over=rows["over"].iloc[0])

    dealt = groups.filter(~large).withColumn("part", F.pmod(F.xxhash64("group_key"), F.lit(many)).cast("long"))
    placed = written(dealt.groupBy("part").applyInPandas(local, "group_key string, bytes long, part long, place int"), "placed")
    if many > parts:
        sums = placed.groupBy("part", "place").agg(F.sum("bytes").alias("bytes")).withColumn("over", F.pmod("part", F.lit(parts)))
        to = sums.groupBy("over").applyInPandas(merge, "part long, place int, to int, over long")
        placed = written(placed.join(to, ["part", "place"]).select("group_key", "bytes", F.col("over").alias("part"), F.col("to").alias("place")), "merged")
    bundles = [(r["part"], r["place"], r["bytes"]) for r in placed.groupBy("part", "place").agg(F.sum("bytes").alias("bytes")).collect()]
    alone = [(r["group_key"], r["bytes"]) for r in groups.filter(large).collect()]
    items = sorted([(-int(x), 0, k, 0) for k, x in alone] + [(-int(x), 1, p, j) for p, j, x in bundles])
    found = [own[0] for own in difference([(-x,) + (0,) * (shards - 1) for x, _, _, _ in items])]
    by_key = [(k, s) for (_, kind, k, _), s in zip(items, found) if not kind]
    by_place = [(k, j, s) for (_, kind, k, j), s in zip(items, found) if kind]
    out = placed.join(F.broadcast(spark.createDataFrame(by_place, "part long, place int, shard int")), ["part", "place"]).select("group_key", "shard")
    return out.union(spark.createDataFrame(by_key, "group_key string, shard int"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; equal texts share a shard and bytes are near equal.

    size: UTF-8 bytes of the text plus 1; a null text is grouped with the empty
    ones. slot: a gapless number from 0 in the shard. Repeated rows and null ids
    stay. A group larger than a shard's share makes its shard the largest; it is
    not divided. Columns other than doc_id and text are not read.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.md5(raw.cast("binary")).alias("group_key"))
    rows = written(rows, "sized")
    groups = written(rows.groupBy("group_key").agg(F.sum("size").alias("bytes")), "groups")
    placed = rows.join(written(assign_groups(groups, shards), "shards"), "group_key")
    order = [F.col(c) for c in ("doc_id", "group_key")]
    return salted_rank(placed, ["shard"], order, "slot", salts=1024).select("doc_id", "size", "text_crc32", "shard", "slot")


def op10_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
