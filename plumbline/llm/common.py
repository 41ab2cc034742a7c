"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import read_by_streams, shared_path, shared_root, written

__all__ = ["ARROW_ROWS", "BROADCAST_ROWS", "PART_CHARS", "documents", "parts", "remembers", "salted_rank", "shared_path", "shared_root", "shielded", "sized", "small_batches", "written"]

#: Rows in one Arrow batch: bounds a Python worker's memory also where every text of a batch is very long.
ARROW_ROWS = 500

#: Characters of texts that are worked on at once, unless one text alone has more.
PART_CHARS = 2 << 20


def parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in lists of few enough characters."""
    own, chars = [], 0
    for text in texts:
        if own and chars + len(text or "") > PART_CHARS:
            yield own
            own, chars = [], 0
        own.append(text)
        chars += len(text or "")
    if own:
        yield own


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., so that none has a name that an operator gives, and the new names by the old."""
    new = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*new), dict(zip(docs.columns, new))


_remembered: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """In a Python worker, which serves one operator after another: the memory of any other owner is emptied now, and `forget` empties this one's later."""
    for name in [x for x in _remembered if x != owner]:
        _remembered.pop(name)()
    _remembered[owner] = forget


#: Rows of a few numbers each that are broadcast in a join (under 50 MB).
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, which is a written table, to be broadcast if it has few rows, and else joined by sorting.

    The planner's own guess is the size of compressed files, which may be a
    hundredth of the rows in memory, so it is not left to that.
    """
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows in this session, and reads without buffers that stay."""
    read_by_streams(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def salted_rank(df: DataFrame, group: list[str], order: list[Column], out: str, salts: int = 256) -> DataFrame:
    """Adds out: a gapless number from 0 within each group, without gathering a group in one task.

    A group's rows are dealt over `salts` parts by the hash of `order`; a part's
    first number is the count of the group's rows in earlier parts. The counts
    are pre-aggregated; their table has at most groups x salts rows. Rows that
    are equal in `order` are numbered in any order.
    """
    from pyspark.sql import Window

    salt, base = f"{out}__salt", f"{out}__base"
    df = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(*group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*group, salt).agg(F.count(F.lit(1)).alias(base))
    counts = counts.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)).cast("long"))
    ranked = df.withColumn(out, (F.row_number().over(Window.partitionBy(*group, salt).orderBy(*order)) - 1).cast("long"))
    return ranked.join(counts, [*group, salt]).withColumn(out, F.col(out) + F.col(base)).drop(salt, base)
