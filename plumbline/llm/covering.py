"""Covering bit masks for Hamming search, and exact linking within a radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import sized, written

#: Fingerprints of a bucket that are compared in one task; larger buckets are divided by further masks.
BUCKET = 512
#: With so few free bits a bucket is not divided any more.
LAST_BITS = 9


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """2^(radius+1) - 1 masks over the given bit positions.

    Position j has a nonzero vector over GF(2) of radius+1 bits; for each
    nonzero v there is a mask of the positions whose vectors are not orthogonal
    to v. Up to `radius` positions give so many equations in one unknown more,
    so some v is orthogonal to all of them: its mask leaves these positions out,
    and two words that differ only there are equal under it.
    """
    n = (1 << (radius + 1)) - 1
    vectors = [j % n + 1 for j in range(len(positions))]
    return [sum(1 << p for p, x in zip(positions, vectors) if (x & v).bit_count() & 1) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(words: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that connect what can be connected by links within the radius, one fewer than the members of each component."""
    near = np.bitwise_count(words[:, None] ^ words[None, :]) <= radius
    free, out = np.ones(len(words), dtype=bool), []
    while free.any():
        todo = [int(free.argmax())]
        free[todo[0]] = False
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(near[i] & free).tolist():
                free[j] = False
                out.append((i, j))
                todo.append(j)
    return out


def links_within(words: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """Links (u, v) that connect the same words as all pairs within the radius do.

    words: a written table with one distinct long a row in column `word`. Each
    table of the covering family deals the words by their masked value. A bucket
    of two gives its pair; one of up to BUCKET gives a spanning forest of its
    links; a larger one is divided by covering masks over the bits that its own
    mask leaves free, which loses no pair. Every level leaves half of the free
    bits, so a bucket has at most 2^8 words after three levels.
    """
    spark = words.sparkSession
    families, links = [(0, 0)], []
    rows = words.select(F.lit(0).alias("family"), "word")
    while True:
        masks = []
        for family, mask in families:
            free = [b for b in range(bits) if not mask >> b & 1]
            for sub in covering_masks(free, radius):
                masks.append((family, len(masks), mask | sub))
        free = max(bits - m.bit_count() for _, _, m in masks)
        if free >= bits:
            raise ValueError("too few bits for this radius")
        # the words of a bucket differ only in the free bits, so there are at most 2^free of them
        most = BUCKET if free > LAST_BITS else 1 << free
        if len(families) == 1:
            dealt = rows.select("word", F.posexplode(F.array(*[F.col("word").bitwiseAND(F.lit(signed(m))) for _, _, m in masks])).alias("table", "key"))
        else:
            # at most 31^3 rows of three numbers
            of = spark.createDataFrame([(f, t, signed(m)) for f, t, m in masks], "family int, table int, mask long")
            dealt = rows.join(F.broadcast(of), "family").select("word", "table", F.col("word").bitwiseAND(F.col("mask")).alias("key"))
        buckets = dealt.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("u"), F.max("word").alias("v")).filter("n > 1")
        buckets = written(buckets, "buckets")
        links.append(buckets.filter((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)).select("u", "v"))
        full = dealt.join(sized(buckets.filter("n > 2").select("table", "key", "n")), ["table", "key"])
        small = full.filter(F.col("n") <= most).groupBy("table", "key").agg(F.collect_list("word").alias("words"))

        def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(0)
                offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
                u, v = [], []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    own = values[a:b]
                    for i, j in forest(own, radius):
                        u.append(own[i])
                        v.append(own[j])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (u, v)], ["u", "v"])

        links.append(small.select("words").mapInArrow(connect, "u long, v long"))
        if buckets.filter(F.col("n") > most).isEmpty():
            break
        rows = full.filter(F.col("n") > most).select(F.col("table").alias("family"), "word")
        families = [(t, m) for _, t, m in masks]
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out
