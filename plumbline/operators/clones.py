"""Clones of functions or texts: exact, by skeleton, by SimHash, and what differs between siblings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS, Mining, Module
from plumbline.operators.graph import weak_components
from plumbline.session import written

#: Rows of a part (about 20 bytes each, two parts in a task), bands of lengths within the window's factor, pairs in one batch, and tasks.
BLOCK, BANDS, PAIR_ROWS, MOST_TASKS = 8192, 4, 100_000, 10_000


def exact_groups(functions: DataFrame, t: Module = DEFAULTS.module) -> DataFrame:
    """(path, structural_hash, members, min_loc, max_loc): equal structure within a file. functions: path, name, structural_hash, loc, distinct_kinds."""
    rows = functions.filter((F.col("structural_hash") != 0) & (F.col("loc") >= t.dup_min_loc) & (F.col("distinct_kinds") >= t.dup_min_kinds))
    out = rows.groupBy("path", "structural_hash").agg(F.count(F.lit(1)).alias("members"), F.min("loc").alias("min_loc"), F.max("loc").alias("max_loc"), F.bool_and(F.startswith("name", F.lit("test_"))).alias("__tests"))
    return out.filter((F.col("members") >= t.dup_min_group) & ~F.col("__tests") & (F.col("max_loc") * 10 <= F.col("min_loc") * 13)).drop("__tests")


def similar_groups(functions: DataFrame, t: Module = DEFAULTS.module) -> DataFrame:
    """Equal skeletons of longer functions that are in no exact group."""
    taken = exact_groups(functions, t).select("path", "structural_hash")
    rows = functions.filter(F.col("loc") >= t.dup_skeleton_loc).join(taken, ["path", "structural_hash"], "left_anti")
    return rows.groupBy("path", "skeleton_hash").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= t.dup_min_group)


def allowed_distance(loc: Column, t: Mining = DEFAULTS.mining) -> Column:
    """Differing bits that two functions may have, by the length of the shorter: 7 to clone_distance."""
    return F.least(F.lit(t.clone_distance), F.lit(7) + F.floor((F.greatest(loc, F.lit(6)) - 6) / 3).cast("int"))


def _blocks(items: DataFrame, columns: list[str], t: Mining) -> DataFrame:
    """items dealt to blocks x <= y, so that any two within the window of lengths meet in exactly one: rows (bx, by, own, and columns); own: 0 for a row of x, 1 of y.

    A band holds lengths up to a factor, so partners are in the same band or a
    few above. A band is cut by hash into parts of about BLOCK rows; what is in
    one task is two parts, whatever the band's or a length's number of rows.
    """
    factor = (100 + t.clone_window_pct) / 100
    step = factor ** (1 / BANDS)
    rows = items.withColumn("band", F.floor(F.log(F.col("loc").cast("double")) / F.lit(math.log(step))).cast("int"))
    # a row a band, of which there are as many as the logarithm of the greatest length says
    sizes = {r["band"]: r["n"] for r in rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    low, parts = {}, 0
    for band in sorted(sizes):
        low[band], parts = parts, parts - (-sizes[band] // BLOCK)
    ends = {band: low[band] - (-sizes[band] // BLOCK) for band in low}
    # one band more than the factor reaches, against rounding at a band's edge; the parts of neighbouring bands have consecutive numbers
    near = {band: [x for x in low if abs(x - band) <= BANDS + 1] for band in low}
    of = [(band, low[band], ends[band] - low[band], min(low[x] for x in near[band]), max(ends[x] for x in near[band]) - 1) for band in low]
    tasks = min(1 + sum(n * (last - first + 1) for _, _, n, first, last in of) // 8, MOST_TASKS)
    rows = rows.join(F.broadcast(items.sparkSession.createDataFrame(of, "band int, low int, many int, first int, last int")), "band")
    rows = rows.withColumn("part", (F.col("low") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int")).withColumn("other", F.explode(F.sequence("first", "last")))
    dealt = rows.select(F.least("part", "other").alias("bx"), F.greatest("part", "other").alias("by"), (F.col("part") > F.col("other")).cast("int").alias("own"), *columns)
    # the number is given, for work is not in proportion to bytes
    return dealt.repartition(tasks, "bx", "by").sortWithinPartitions("bx", "by")


def _compared(items: DataFrame, found: Callable[[_Block], Iterator[tuple[np.ndarray, ...]]], schema: str, t: Mining) -> DataFrame:
    """What `found` gives for every two parts that meet. items: id, word, loc, and file and start if these are to be looked at."""
    columns = [c for c in ("id", "word", "loc", "file", "start") if c in items.columns]
    names = [x.split()[0] for x in schema.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[list[pa.RecordBatch]]:
            key, held = None, []
            for batch in batches:
                at = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
                cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
                for p, q in zip(cuts[:-1], cuts[1:]):
                    if q > p:
                        if key != (key := tuple(at[:, p].tolist())) and held:
                            yield held
                            held = []
                        held.append(batch.slice(p, q - p))
            if held:
                yield held

        for held in blocks():
            for arrays in found(_Block(pa.Table.from_batches(held))):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)

    return _blocks(items.select(*columns), columns, t).mapInArrow(compare, schema)


class _Block:
    """The rows of two parts, sorted by length, and their near pairs."""

    def __init__(self, rows: pa.Table):
        loc = rows.column("loc").to_numpy()
        order = np.argsort(loc, kind="stable")
        take = lambda c: rows.column(c).to_numpy()[order]
        self.loc, self.ids, self.words, self.own = loc[order].astype(np.int64), take("id"), take("word").view(np.uint64), take("own")
        self.one = not self.own.any()
        self.file = self.start = None
        if "file" in rows.column_names:
            self.file, self.start = rows.column("file").combine_chunks().dictionary_encode().indices.to_numpy()[order], take("start").astype(np.int64)

    def limits(self, t: Mining) -> tuple[np.ndarray, np.ndarray]:
        """For each row the end of the rows that are not too long for it, and the bits that it may differ in from one that is no shorter."""
        return np.searchsorted(self.loc * 100, self.loc * (100 + t.clone_window_pct), side="right"), np.minimum(t.clone_distance, 7 + (np.maximum(self.loc, 6) - 6) // 3)

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """Whether the rows are no overlapping places of one file."""
        if self.file is None:
            return np.ones(len(others), dtype=bool)
        over = (self.start[i] < self.start[others] + self.loc[others]) & (self.start[others] < self.start[i] + self.loc[i])
        return ~((self.file[others] == self.file[i]) & over)


def near_pairs(items: DataFrame, t: Mining = DEFAULTS.mining) -> DataFrame:
    """(a, b, distance): SimHashes within the distance that their length allows and lengths within the window.

    items: id (unique, long), word (long), loc; with file and start, overlapping
    places of one file are no pair. The distance is a fifth of the word's bits,
    at which texts of one language are near by the million (on the tables here
    one in sixteen of all pairs within the window), so tables of masked words
    would meet every pair many times over. So what is compared are all pairs
    within the window, each once: rows are dealt to bands of lengths, bands to
    parts of BLOCK rows, and a task compares the words of two parts.
    """
    rows = items.filter(F.col("loc") >= t.clone_min_loc)

    def found(block: _Block) -> Iterator[tuple[np.ndarray, ...]]:
        ends, most = block.limits(t)
        left, right, bits, held = [], [], [], 0
        for i in range(len(block.ids)):
            d = np.bitwise_count(block.words[i + 1 : ends[i]] ^ block.words[i])
            hit = np.flatnonzero(d <= most[i])
            if not block.one:
                hit = hit[block.own[i + 1 + hit] != block.own[i]]
            if len(hit) and block.file is not None:
                hit = hit[block.apart(i, i + 1 + hit)]
            if len(hit):
                others = block.ids[i + 1 + hit]
                left.append(np.minimum(others, block.ids[i]))
                right.append(np.maximum(others, block.ids[i]))
                bits.append(d[hit].astype(np.int32))
                held += len(hit)
            if held > PAIR_ROWS or held and i + 1 == len(block.ids):
                yield np.concatenate(left), np.concatenate(right), np.concatenate(bits)
                left, right, bits, held = [], [], [], 0

    return _compared(rows, found, "a long, b long, distance int", t)


def clusters(items: DataFrame, t: Mining = DEFAULTS.mining) -> DataFrame:
    """(id, cluster): the least id of all that near pairs connect. items as for near_pairs; without file and start, an id is a place of its own.

    Rows of one word and length (and place) are one class, by its least id.
    Pairs are not listed: each task links what is connected inside its two
    parts by a spanning forest, so links are in proportion to rows.
    """
    rows = items.filter(F.col("loc") >= t.clone_min_loc)
    key = [c for c in ("word", "loc", "file", "start") if c in items.columns]
    classes = written(rows.groupBy(*key).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")

    def found(block: _Block) -> Iterator[tuple[np.ndarray, ...]]:
        ends, most = block.limits(t)
        begins = np.searchsorted(ends, np.arange(len(ends)), side="right")
        free, u, v = np.ones(len(block.ids), dtype=bool), [], []
        rest = np.flatnonzero(free)
        while len(rest):
            todo = [int(rest[0])]
            free[todo[0]] = False
            while todo:
                i = todo.pop()
                rest = rest[free[rest]]
                near = rest[np.searchsorted(rest, begins[i]) : np.searchsorted(rest, ends[i])]
                near = near[np.bitwise_count(block.words[near] ^ block.words[i]) <= np.minimum(most[near], most[i])]
                near = near[block.apart(i, near)]
                free[near] = False
                u.append(np.full(len(near), block.ids[i]))
                v.append(block.ids[near])
                todo += near.tolist()
            rest = rest[free[rest]]
        if u:
            yield np.concatenate(u), np.concatenate(v)

    links = written(_compared(classes.drop("n"), found, "src long, dst long", t), "links")
    found_ = weak_components(links).withColumnsRenamed({"node": "id", "component": "cluster"})
    of = classes.join(found_, "id", "left").filter("cluster is not null" if "file" in key else "cluster is not null or n > 1")
    of = of.select(*[F.col(c).alias(f"__{c}") for c in key], F.coalesce("cluster", "id").alias("cluster"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    return rows.join(of, reduce(lambda x, y: x & y, same)).select("id", "cluster")


def vulnerable_siblings(members: DataFrame, sinks: DataFrame) -> DataFrame:
    """Members of a cluster of which another member holds a dangerous sink and they do not. members: cluster, path, start, end; sinks: path, line."""
    hit = members.join(sinks, "path").filter("line between start and end").select("cluster", "path", "start", "end").distinct()
    return members.join(hit.select("cluster").distinct(), "cluster", "left_semi").join(hit, ["cluster", "path", "start", "end"], "left_anti").select("cluster", "path", "start", "end").distinct()


def token_simhash(tokens: DataFrame, hash_: Column) -> DataFrame:
    """(id, word): the 64-bit SimHash of each id's tokens; a bit is set if more than half of the hashes have it. tokens: id and the columns of hash_. Sums of single bits, pre-aggregated."""
    bits = [F.sum(F.shiftrightunsigned(hash_, k).bitwiseAND(F.lit(1)).cast("long")).alias(f"b{k}") for k in range(64)]
    counted = tokens.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *bits)
    word = F.lit(0).cast("long")
    for k in range(64):
        word = word.bitwiseOR(F.when(F.col(f"b{k}") * 2 > F.col("n"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select("id", word.alias("word"))
