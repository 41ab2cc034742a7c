"""Token ids in ORC files that can be read by stripe and pruned by document.

Layout of the files: rows in ascending document order over all files, the ids
as a list column that ORC stores with integer run-length encoding, a row index
every INDEX_STRIDE rows and Bloom filters on the document ids, so that a
reader of one document skips files and stripes by their metadata. Each row has
its place in its file and the ids before it in the file; the ids before a file
follow from the files' own totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import documents, shared_path, small_batches
from plumbline.llm.tokenizing import encoder, tokenizer_path

STRIPE_BYTES = 64 << 20
INDEX_STRIDE = 2_000
BLOOM_FPP = 0.01
END_ID = 0
#: One row a file is broadcast up to so many files (under 20 MB); beyond it the join shuffles.
BROADCAST_FILES = 100_000

SCHEMA = "doc_id long, place long, local_start long, n_tokens long, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes the ids as ORC under path, ascending by document id.

    A null or empty text gives the end id alone. Null ids come first. Rows that
    share an id stay separate rows, ordered by the hash of their text (equal
    rows: any order). An empty table gives files without rows. Other columns
    are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        place = start = 0
        for batch in batches:
            ids = enc.encode(batch.column(1).to_pylist(), end)
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ends = np.cumsum(n)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(place, place + len(n))), pa.array(start + ends - n), pa.array(n), tokens],
                ["doc_id", "place", "local_start", "n_tokens", "tokens"],
            )
            place, start = place + len(n), start + int(n.sum())

    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.option("compression", "snappy")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(INDEX_STRIDE))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and tokens, from the files.

    A filter on doc_id reaches the ORC scan, which prunes stripes and row groups
    by statistics and Bloom filters. start needs the totals of all files: one
    narrow column is read for them and summed per file.
    """
    rows = spark.read.schema(SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_name"))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    # by the task's number, which has more digits from task 100 000 on
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("base"))
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    n_files = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(files).getFileCount()
    if where is not None:
        rows = rows.filter(where)
    rows = rows.join(F.broadcast(totals) if n_files <= BROADCAST_FILES else totals, "file")
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """Replaces the ids by ids_crc32, of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("tokens"))
            offsets, values = column.offsets.to_numpy() , column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"))
    return with_crc32(read_tokens(spark, path))
