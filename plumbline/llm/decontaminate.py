"""Benchmark passages in training texts, found by spaced seeds, with DataFrame functions only.

A seed is a fixed mask over SPAN consecutive words that reads some positions
and ignores the others. The masks form a covering family: whichever
SUBSTITUTED positions of a span are other words, some mask ignores them all.
The hashes of the masked words of benchmark and corpus are joined; around each
hit the words of the item and of the text are compared place by place: a
passage is found by its part of equal words or by a run of equal words. An item
of fewer than SPAN words has one mask, which reads all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents, shielded, sized, written
from plumbline.llm.covering import covering_masks

SPAN, SUBSTITUTED = 10, 2
#: An item's words that are compared, before and after the first word of a hit.
BEFORE, AFTER = 10, 20
#: Part of the compared words that must be equal, or consecutive words that are enough.
OVERLAP, RUN = 0.8, 13
#: Words of an item at least; shorter ones, which any text may hold by chance, are not looked for.
LEAST_WORDS = 4
#: Rows of the benchmark's hashes (about 40 bytes each) that are broadcast. A larger benchmark is joined by shuffle, of those places only whose hash is in a bitmap of the benchmark's (BITS a hash, 2^MOST_BITS at most, 16 MB).
BROADCAST_ROWS = 500_000
BITS, MOST_BITS = 16, 27

MASKS = [[p for p in range(SPAN) if m >> p & 1] for m in covering_masks(list(range(SPAN)), SUBSTITUTED)]


def _hashes(text: Column) -> Column:
    """A hash for each word: runs of letters and digits, lower-cased."""
    return F.transform(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), lambda x: F.xxhash64(x))


def _seeds(df: DataFrame, words: str, at: str, key: str, short: list[int], whole: bool = False) -> DataFrame:
    """A row for each place and mask that fits there: the place, and the hash of the words that the mask reads. short: the sizes of items without masks of their own; with whole, only for words of just that number."""
    df = df.filter(F.size(words) >= (min(short) if short else SPAN)).withColumn(at, F.explode(F.sequence(F.lit(0), F.size(words) - (min(short) if short else SPAN))))
    keys = [F.xxhash64(F.lit(m), *[F.get(words, F.col(at) + p) for p in mask]) for m, mask in enumerate(MASKS)]
    if not short:
        return df.withColumn(key, F.explode(F.array(*keys)))
    keys = [F.when(F.size(words) - F.col(at) >= SPAN, k) for k in keys]
    for n in short:
        fits = ((F.size(words) == n) & (F.col(at) == 0)) if whole else (F.size(words) - F.col(at) >= n)
        keys.append(F.when(fits, F.xxhash64(F.lit(-n), *[F.get(words, F.col(at) + p) for p in range(n)])))
    return df.withColumn(key, F.explode(F.array(*keys))).filter(F.col(key).isNotNull())


def _compared() -> Column:
    """Equal words, compared words and the longest run of equal ones, around a hit at __at in __words and __item_at in __item_words."""
    low = F.greatest(F.lit(0), F.col("__item_at") - BEFORE)
    high = F.least(F.size("__item_words"), F.col("__item_at") + AFTER)
    shift = F.col("__at") - F.col("__item_at")

    def step(a: Column, i: Column) -> Column:
        equal = F.coalesce(F.get("__item_words", i) == F.when(i + shift >= 0, F.get("__words", i + shift)), F.lit(False))
        run = F.when(equal, a["run"] + 1).otherwise(0)
        return F.struct((a["same"] + equal.cast("int")).alias("same"), run.alias("run"), F.greatest(a["longest"], run).alias("longest"))

    start = F.struct(F.lit(0).alias("same"), F.lit(0).alias("run"), F.lit(0).alias("longest"))
    return F.aggregate(F.sequence(low, high - 1), start, step, lambda a: F.struct((a["same"] / (high - low)).alias("overlap"), a["longest"].alias("run")))


def _bitmap(seeds: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row: an array of longs whose bits tell which hashes, by their last bits, may be among the seeds; and the number of longs."""
    size = 1 << max(0, min(MOST_BITS, (n * BITS).bit_length()) - 6)
    at = F.col("__seed").bitwiseAND(F.lit(size * 64 - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    longs = seeds.groupBy(F.shiftrightunsigned(at, 6).alias("id")).agg(F.bit_or(one).alias("bits"))
    every = seeds.sparkSession.range(size).join(longs, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bitmap")), size


def may_be_among(seeds: DataFrame, n: int, key: Column) -> Column:
    """False for most keys that are not one of the n in __seed of seeds, true for all that are."""
    bitmap, longs = _bitmap(seeds, n)
    at = F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(longs - 1)).cast("int")
    return F.getbit(F.get(written(bitmap, "bitmap").scalar(), at), key.bitwiseAND(F.lit(63)).cast("int")) == 1


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", overlap: float = OVERLAP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(__id, __key, items, overlap) for each text that holds a benchmark passage; __key is the hash of the text.

    benchmark: item_id, text. items: the sorted ids of the items it overlaps;
    overlap: the greatest part of equal words around a hit. An item is in a text
    if that part is `overlap` at least or RUN consecutive words are equal; an
    item of LEAST_WORDS to SPAN words if it stands there whole. Items of fewer
    words, and empty or null texts, have no hits. Rows equal in id and text
    count as one.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__key"), _hashes(text).alias("__words"))
    items = benchmark.select(F.col("item_id").alias("__item"), F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("w"))
    items = written(items.select("__item", F.transform("w", lambda x: F.xxhash64(x)).alias("__item_words")).filter(F.size("__item_words") >= LEAST_WORDS).distinct(), "items")
    short = sorted(r[0] for r in items.filter(F.size("__item_words") < SPAN).select(F.size("__item_words")).distinct().collect())
    seeds = written(_seeds(items, "__item_words", "__item_at", "__seed", short, True).select("__seed", "__item", "__item_at").distinct(), "seeds")
    mine = _seeds(rows, "__words", "__at", "__seed", short)
    if (n := seeds.count()) <= broadcast_rows:
        hits = mine.join(F.broadcast(seeds), "__seed").join(F.broadcast(items), "__item")
    else:
        places = mine.select("__id", "__key", "__at", "__seed").filter(may_be_among(seeds, n, F.col("__seed"))).join(seeds.hint("merge"), "__seed").select("__id", "__key", "__item", "__at", "__item_at").distinct()
        per_text = places.groupBy("__id", "__key").agg(F.collect_list(F.struct("__item", "__at", "__item_at")).alias("of"))
        named = rows.select(F.col("__id").alias("i"), F.col("__key").alias("k"), "__words").dropDuplicates(["i", "k"])
        hits = per_text.join(named, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__key") == F.col("k"))).select("__id", "__key", "__words", F.explode("of").alias("o")).select("__id", "__key", "__words", "o.*").join(items, "__item")
    hits = hits.select("__id", "__key", "__item", _compared().alias("c")).filter((F.col("c.overlap") >= overlap) | (F.col("c.run") >= RUN)).select("__id", "__key", "__item", "c.overlap")
    best = hits.groupBy("__id", "__key", "__item").agg(F.max("overlap").alias("overlap"))
    return best.groupBy("__id", "__key").agg(F.sort_array(F.collect_list("__item")).alias("items"), F.max("overlap").alias("overlap"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without the texts that hold a benchmark passage; all columns stay as they are. A null text holds none."""
    names = docs.columns
    docs, new = shielded(docs)
    id_col, text_col = new[id_col], new[text_col]
    hits = written(benchmark_hits(docs, benchmark, id_col, text_col, broadcast_rows=broadcast_rows).select("__id", "__key"), "leaks")
    hits = sized(hits, broadcast_rows)
    return docs.join(hits, docs[id_col].eqNullSafe(hits["__id"]) & (F.xxhash64(docs[text_col].cast("string")) == hits["__key"]), "left_anti").toDF(*names)


def op5_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    hits = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("key"))
    out = keys.join(hits, keys["doc_id"].eqNullSafe(hits["__id"]) & (keys["key"] == hits["__key"]), "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
