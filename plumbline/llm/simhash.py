"""SimHash near-duplicates, found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents, small_batches, written
from plumbline.llm.components import components
from plumbline.llm.covering import links_within

SEED, RADIUS = 42, 4

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of `words` words, repeats included; fewer words: of the whole sequence; none: empty.

    A-Z is lower-cased; words are separated by the space and by \\t to \\r, and
    joined by one space.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_digest
    ends = (np.cumsum([len(x) + 1 for x in parts]) - 1).tolist()
    starts = [0, *[x + 1 for x in ends[:-1]]]
    spans = zip(starts, ends[words - 1 :]) if len(parts) >= words else [(0, len(joined))]
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), dtype=">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half of the hashes (none: zero), as a signed number."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, word): the 64-bit SimHash of every whole text over shingles of `words` words.

    Null, empty or blank text: zero. Repeated rows and null ids stay. Columns
    other than doc_id and text are not read.
    """
    small_batches(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(x.as_py(), words)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "word"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(digest, "doc_id long, word long")


def simhash_components(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, word, component_id) of every document; component_id is the smallest doc_id that links within the radius reach.

    Documents of one fingerprint are one node, however many they are. A null id
    is never the smallest (a component of null ids alone has a null
    component_id). An empty table gives no row.
    """
    rows = written(fingerprints(docs, words), "fingerprints")
    nodes = written(rows.groupBy("word").agg(F.min("doc_id").alias("least")), "nodes")
    links = links_within(nodes.select("word"), radius)
    roots = written(components(links), "roots")
    linked = nodes.join(roots, nodes["word"] == roots["node"]).select("word", "least", "root")
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = linked.join(best, "root").select("word", "component_id")
    alone = nodes.join(roots, nodes["word"] == roots["node"], "left_anti").select("word", F.col("least").alias("component_id"))
    return rows.join(labels.union(alone), "word").select("doc_id", "word", "component_id")


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(documents(spark, sf_dir), words=4, radius=RADIUS)
    return out.select("doc_id", F.lower(F.lpad(F.hex("word"), 16, "0")).alias("fingerprint"), "component_id")
