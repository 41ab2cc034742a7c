"""Removal of multi-line passages that repeat across a corpus, with DataFrame functions only.

A text's lines are hashed, and a hash is rolled over every two neighbouring line
hashes. In each of several chunkings it says whether a chunk begins with these
two lines, and whether one ends with them: a chunk goes from a line where one
begins to the next where one ends. Both ends are chosen by lines inside the
chunk and by nothing outside it, so a passage is cut alike wherever it stands,
whatever is put in or taken out beside it. A chunk has two lines at least, and
2.3 in the mean; chunks overlap, so that most lines are the first line of one.
A line of LONG_LINE characters is a chunk by itself.

Where no chunking has a chunk of the least size (two lines and LEAST_CHARS
characters) at a line, the shortest run of lines from there or up to there takes
its place. So every repeated passage of that size goes whole; nine in ten of
the shortest, and all longer ones but for an edge, go by the chunkings alone.

Chunks are counted globally by their hash; of a repeated chunk the first
occurrence stays and the others go, if they are the same bytes. Bytes are
compared line by line, as a line is in several chunks: a chunk's hash must be of
one list of line hashes, and a line's of one line. Whole texts are shuffled only
where a bitmap does not rule out that they have a repeated chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents, shielded, sized, written
from plumbline.llm.decontaminate import may_be_among

#: Chunkings, and lines of a chunk at most.
CHUNKINGS, MOST_LINES = 4, 6
#: A line of so many characters is a chunk; it takes about 50 words.
LONG_LINE = 200
#: Characters of a chunk of several lines at least.
LEAST_CHARS = 40
#: Rows of repeated chunks (some 50 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def _lines(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds __lines, __hashes and __key, the identity of a text."""
    text = F.col(text_col).cast("string")
    return docs.withColumns({"__lines": F.split(text, "\n", -1), "__key": F.xxhash64(text)}).withColumn("__hashes", F.transform("__lines", lambda x: _hash(x)))


def _rolled() -> Column:
    """For every two neighbouring lines the chunkings that begin a chunk with them (low bits) and that end one (next bits), each with a chance of three in four."""

    def of(i: Column) -> Column:
        before, after = F.get("__hashes", i), F.get("__hashes", i + 1)
        rolled = F.shiftleft(before, 1).bitwiseOR(F.shiftrightunsigned(before, 63)).bitwiseXOR(after)
        return rolled.bitwiseOR(F.shiftrightunsigned(rolled, 32)).bitwiseAND(F.lit((1 << 2 * CHUNKINGS) - 1)).cast("int")

    return F.transform(F.sequence(F.lit(0), F.size("__hashes") - 2), of)


def _runs() -> Column:
    """(first, n) of the chunks of all chunkings, from __rolled."""
    every = F.lit((1 << CHUNKINGS) - 1)

    def of(i: Column) -> Column:
        open_, found = F.get("__rolled", i).bitwiseAND(every), []
        for d in range(MOST_LINES - 1):
            ends = F.shiftrightunsigned(F.coalesce(F.get("__rolled", i + d), F.lit(0)), CHUNKINGS)
            found.append(F.when(open_.bitwiseAND(ends) != 0, F.struct(i.alias("first"), F.lit(d + 2).alias("n"))))
            open_ = open_.bitwiseAND(F.bitwise_not(ends))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size("__rolled") - 1), of))


def _windows() -> Column:
    """(first, n) from __lines: of LEAST_CHARS and two lines at least the shortest windows that end at a line or begin at one.

    Whatever passage of so many lines and characters repeats, the windows inside it cover all its lines.
    """
    place = "array<struct<i:int,c:int>>"
    start = F.struct(F.lit(0).alias("c"), F.array().cast(place).alias("tail"), F.lit(False).alias("met"), F.array().cast("array<struct<first:int,n:int>>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        # the tail has the starts from that of the last window on; a window that begins earlier has more characters
        end = a["c"] + F.length(F.get("__lines", e))
        enough = F.size(F.filter(a["tail"], lambda x: end - x["c"] >= LEAST_CHARS))
        skip = F.when(a["met"] & (enough > 1), 1).otherwise(0)
        new = F.transform(F.slice(a["tail"], skip + 1, enough - skip), lambda x: F.struct(x["i"].alias("first"), (e - x["i"] + 1).alias("n")))
        tail = F.concat(F.slice(a["tail"], F.greatest(enough, F.lit(1)), F.size(a["tail"])), F.array(F.struct(e.alias("i"), a["c"].alias("c"))))
        return F.struct(end.alias("c"), tail.alias("tail"), (a["met"] | (enough > 0)).alias("met"), F.concat(a["out"], new).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size("__lines") - 1), start, step, lambda a: a["out"])


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edges: bool = True) -> DataFrame:
    """__id, __key, first, n and chunk (hash) of every chunk that may be removed; without edges only what the chunkings choose, and long lines."""
    rows = _lines(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text").drop("__text").filter("__lines is not null")
    at = F.sequence(F.lit(0), F.size("__lines") - 1)
    long_ = F.transform(F.filter(at, lambda i: F.length(F.get("__lines", i)) >= LONG_LINE), lambda i: F.struct(i.alias("first"), F.lit(1).alias("n")))
    none = F.array().cast("array<struct<first:int,n:int>>")
    rows = rows.withColumn("__rolled", F.when(F.size("__lines") > 1, _rolled()))
    several = F.when(F.size("__lines") > 1, F.array_distinct(F.concat(_runs(), _windows())) if edges else _runs()).otherwise(none)
    rows = rows.select("__id", "__key", "__lines", "__hashes", F.explode(F.concat(long_, several)).alias("run"))
    own = lambda c: F.slice(c, F.col("run.first") + 1, F.col("run.n"))
    rows = rows.filter((F.col("run.n") == 1) | (F.aggregate(own("__lines"), F.lit(0), lambda a, x: a + F.length(x)) >= LEAST_CHARS))
    return rows.select("__id", "__key", F.col("run.first").alias("first"), F.col("run.n").alias("n"), F.xxhash64(own("__hashes")).alias("chunk"))


def _divided(docs: DataFrame, id_col: str, text_col: str, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs that may be among texts (__id, __key; a written table), and docs that are not, told by a bitmap and without a shuffle."""
    seeds = texts.select(F.xxhash64("__id", "__key").alias("__seed"))
    may = may_be_among(seeds, texts.count(), F.xxhash64(id_col, F.xxhash64(F.col(text_col).cast("string"))))
    return docs.filter(may), docs.filter(~may)


def _compared() -> Column:
    """(whole, hash, bytes) of the lines and chunks of __of, from __lines; for a chunk its line hashes are the bytes."""
    hashed = lambda c: F.transform(F.slice("__lines", c["first"] + 1, c["n"]), lambda x: _hash(x).cast("string"))
    at = F.array_distinct(F.flatten(F.transform("__of", lambda c: F.sequence(c["first"], c["first"] + c["n"] - 1))))
    lines = F.transform(F.transform(at, lambda i: F.get("__lines", i)), lambda x: F.struct(F.lit(False).alias("whole"), _hash(x).alias("hash"), x.alias("bytes")))
    return F.concat(lines, F.transform("__of", lambda c: F.struct(F.lit(True).alias("whole"), c["chunk"].alias("hash"), F.array_join(hashed(c), " ").alias("bytes"))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, edges: bool = True) -> DataFrame:
    """docs with the repeated chunks cut out of the text, and removed_lines, the number of lines cut.

    Every passage of two lines and LEAST_CHARS characters or more, and every
    long line, that stands in an earlier place goes whole (without edges: what
    the chunkings find of it). A chunk that overlaps its own first occurrence
    stays.

    The first occurrence, which stays, is that of the smallest id (null first),
    then of the smallest text hash and line. Rows that are equal in id and text
    count as one document and are treated alike. A null or empty text stays as
    it is; a text of which every line goes becomes empty. Chunks of one hash are
    the same only if their bytes are. Other columns pass through; one named
    removed_lines is replaced. An empty table gives an empty one.
    """
    names = docs.columns
    docs, new = shielded(docs)
    id_col, text_col = new[id_col], new[text_col]
    rows = written(chunks(docs, id_col, text_col, edges), "chunks")
    place = F.struct("__id", "__key", "first")
    # nearly all chunks stand once: only hashes and numbers are shuffled for them, places for the others
    repeated = written(rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("chunk"), "repeated")
    hits = written(rows.join(sized(repeated, broadcast_rows), "chunk"), "hits")
    kept = written(hits.groupBy("chunk").agg(F.min(place).alias("kept")), "kept")

    text = F.col(text_col).cast("string")

    def met(some: DataFrame, per_text: DataFrame, how: str) -> DataFrame:
        per_text = per_text.withColumnsRenamed({"__id": "__of_id", "__key": "__of_key"})
        return some.join(per_text.hint("merge"), F.col(id_col).eqNullSafe(F.col("__of_id")) & (F.xxhash64(text) == F.col("__of_key")), how)

    # byte comparison: equal bytes are one group, whatever their number, before anything is shuffled
    of = written(hits.groupBy("__id", "__key").agg(F.collect_set(F.struct("first", "n", "chunk")).alias("__of")), "of")
    own = met(_divided(docs, id_col, text_col, of)[0].select(id_col, text_col), of, "inner").select(F.col("__of_id").alias("__id"), F.col("__of_key").alias("__key"), F.split(text, "\n", -1).alias("__lines"), "__of")
    kinds = own.select(F.explode(_compared()).alias("k")).select("k.*").distinct().groupBy("whole", "hash").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = written(kinds.filter("kinds > 1").select("whole", "hash"), "kinds")
    sure = hits.join(sized(kept, broadcast_rows), "chunk")
    if not kinds.isEmpty():
        # a hash of several texts: each of them has a first occurrence of its own
        own = own.select("__id", "__key", "__lines", F.explode("__of").alias("c")).select("__id", "__key", "c.*", F.slice("__lines", F.col("c.first") + 1, F.col("c.n")).alias("__lines"))
        lines = own.select("chunk", F.explode("__lines").alias("line")).withColumn("hash", _hash(F.col("line")))
        unlike = lines.join(kinds.filter("not whole"), "hash").select("chunk").union(kinds.filter("whole").select("hash")).distinct()
        unlike, own = written(unlike, "unlike"), own.withColumn("bytes", F.array_join("__lines", "\n")).drop("__lines")
        apart = own.join(sized(unlike, broadcast_rows), "chunk")
        firsts = apart.groupBy("chunk", "bytes").agg(F.min(place).alias("kept"))
        sure = sure.join(sized(unlike, broadcast_rows), "chunk", "left_anti").unionByName(apart.join(firsts, ["chunk", "bytes"]).drop("bytes"))

    cut = sure.filter(~place.eqNullSafe(F.col("kept")))
    cut = cut.filter(~(F.col("__id").eqNullSafe(F.col("kept.__id")) & (F.col("__key") == F.col("kept.__key")) & (F.col("first") < F.col("kept.first") + F.col("n"))))
    cut = written(cut.select("__id", "__key", "first", "n").distinct(), "cut")
    per_text = written(cut.groupBy("__id", "__key").agg(F.collect_list(F.struct("first", "n")).alias("__cut")), "per_text")
    may, others = _divided(docs, id_col, text_col, per_text)
    out = met(may, per_text, "left").select(*docs.columns, "__cut").union(others.withColumn("__cut", F.lit(None).cast(per_text.schema["__cut"].dataType)))
    stays = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.exists("__cut", lambda c: (i >= c["first"]) & (i < c["first"] + c["n"])))
    out = out.withColumn("__stays", F.when(F.col("__cut").isNotNull(), stays))
    removed = F.when(F.col("__stays").isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)) - F.size("__stays"))
    out = out.withColumns({"removed_lines": removed.cast("int"), text_col: F.when(F.col("__stays").isNull(), F.col(text_col)).otherwise(F.array_join("__stays", "\n"))})
    return out.select(*[F.col(new[c]).alias(c) for c in names if c != "removed_lines"], "removed_lines")


def op2_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
