"""Editing sessions in batch: baselines, checkpoints, regressions, clones across files, outcomes.

events: session, path, ts, seq (a total order within a session) and the facts of
each operator. Every window is over one session and path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("ts", "seq")


def first_touch(events: DataFrame) -> DataFrame:
    """The first event of each session and path, whose text before the edit is the baseline."""
    return events.withColumn("__r", F.row_number().over(_order("session", "path"))).filter("__r = 1").drop("__r")


def is_checkpoint(edit: Column) -> Column:
    """Every second edit up to the second, then every fifth."""
    return F.when(edit <= 2, edit % 2 == 0).otherwise(edit % 5 == 0)


def edit_counts(events: DataFrame) -> DataFrame:
    """events with edit (from 1 in session and path) and checkpoint."""
    out = events.withColumn("edit", F.row_number().over(_order("session", "path")).cast("long"))
    return out.withColumn("checkpoint", is_checkpoint(F.col("edit")))


def module_regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(session, path, smell, n, base): smells that a path has more often than at first. Both: session, path, smell, n."""
    base = baseline.select("session", "path", "smell", F.col("n").alias("base"))
    out = current.join(base, ["session", "path", "smell"], "left").withColumn("base", F.coalesce("base", F.lit(0)))
    return out.filter("n > base")


FAMILY = ["god_method", "complex_method", "large_method"]


def worsened(current: DataFrame, baseline: DataFrame, names: DataFrame) -> DataFrame:
    """Findings of current whose magnitudes or count exceed the baseline's, or that have none.

    Both: session, path, function, hash, smell, m1, m2, m3, n; names: session,
    path, function of now. A finding's baseline is that of its name; else that
    of its hash, if the function of that name is gone; else, for a smell of the
    family of large methods, that of a relative, found in the same two ways.
    """
    key = ["session", "path"]
    base = baseline.select(*key, F.col("function").alias("bf"), F.col("hash").alias("bh"), F.col("smell").alias("bs"), F.col("m1").alias("b1"), F.col("m2").alias("b2"), F.col("m3").alias("b3"), F.col("n").alias("bn"))
    gone = base.join(names.select(*key, F.col("function").alias("bf")).distinct(), [*key, "bf"], "left_anti")
    rank = F.when(F.col("bs") == F.col("smell"), 0).otherwise(F.array_position(F.array(*[F.lit(x) for x in FAMILY]), F.col("bs")) * 2)
    kin = (F.col("bs") == F.col("smell")) | (F.col("bs").isin(FAMILY) & F.col("smell").isin(FAMILY))
    by_name = current.join(base, key).filter((F.col("bf") == F.col("function")) & kin).withColumn("way", rank)
    by_hash = current.join(gone, key).filter((F.col("bh") == F.col("hash")) & (F.col("hash") != 0) & kin).withColumn("way", rank + 1)
    fields = [*key, "function", "smell"]
    best = by_name.unionByName(by_hash).groupBy(*fields).agg(F.min_by(F.struct("b1", "b2", "b3", "bn"), F.struct("way", "bf")).alias("b"))
    out = current.join(best, fields, "left")
    more = (F.col("m1") > F.col("b.b1")) | (F.col("m2") > F.col("b.b2")) | (F.col("m3") > F.col("b.b3")) | (F.col("n") > F.col("b.bn"))
    return out.filter(F.col("b").isNull() | more).drop("b")


def session_clones(functions: DataFrame) -> DataFrame:
    """(session, path, function, other_path): functions with a structure that the session saw before in another file. functions: session, path, function, hash, ts, seq."""
    later = functions.filter("hash <> 0")
    earlier = later.groupBy("session", "hash", F.col("path").alias("other_path")).agg(F.min(F.struct("ts", "seq")).alias("first"))
    met = later.join(earlier, ["session", "hash"]).filter((F.col("path") != F.col("other_path")) & (F.col("first") < F.struct("ts", "seq")))
    return met.groupBy("session", "path", "function").agg(F.min_by("other_path", "first").alias("other_path"))


def hallucinated_imports(imports: DataFrame, known: list[DataFrame]) -> DataFrame:
    """Imported roots that are neither of the standard library, declared, internal nor there before. Each of known: root."""
    out = imports
    for k in known:
        out = out.join(k.select("root").distinct(), "root", "left_anti")
    return out


def unused_added(added: DataFrame, texts: DataFrame) -> DataFrame:
    """Added names that stand as a word exactly once in all texts. Texts are cut into words once; names are joined to the counts."""
    words = texts.select(F.explode(F.split("text", r"[^A-Za-z0-9_]+")).alias("name")).filter("name <> ''")
    counts = words.join(F.broadcast(added.select("name").distinct()), "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return added.join(counts.filter("n = 1").select("name"), "name", "left_semi")


def backstop(changed: DataFrame, checked: DataFrame, most: int = 100) -> DataFrame:
    """Changed paths that the session did not check, the first `most` by name."""
    return changed.join(checked, ["session", "path"], "left_anti").withColumn("__r", F.row_number().over(Window.partitionBy("session").orderBy("path"))).filter(F.col("__r") <= most).drop("__r")


def outcomes(findings: DataFrame, final: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, function, smell, outcome) of the first finding of each: ignored (still there), addressed (the function stayed without it), moved (its body is elsewhere) or removed.

    findings: path, function, smell, hash, ts, seq; final: path, function, smell; functions (at the end): path, function, hash.
    """
    first = findings.groupBy("path", "function", "smell").agg(F.min_by("hash", F.struct("ts", "seq")).alias("hash"))
    still = final.select("path", "function", "smell").distinct().withColumn("still", F.lit(True))
    there = functions.select("path", "function").distinct().withColumn("there", F.lit(True))
    bodies = functions.select("hash").distinct().withColumn("body", F.lit(True))
    out = first.join(still, ["path", "function", "smell"], "left").join(there, ["path", "function"], "left").join(bodies, "hash", "left")
    state = F.when(F.col("still"), "ignored").when(F.col("there"), "addressed").when(F.col("body"), "moved").otherwise("removed")
    return out.select("path", "function", "smell", state.alias("outcome"))


def redistributed(old: DataFrame, new: DataFrame, share: float = 0.8) -> DataFrame:
    """(id, matched): removed bodies of which most lines stand in added ones, as often. old, new: id, line."""
    a = old.groupBy("id", "line").agg(F.count(F.lit(1)).alias("n"))
    b = new.groupBy("line").agg(F.count(F.lit(1)).alias("m"))
    total = a.groupBy("id").agg(F.sum("n").alias("all"))
    met = a.join(b, "line").groupBy("id").agg(F.sum(F.least("n", "m")).alias("met"))
    return total.join(met, "id").withColumn("matched", F.col("met") / F.col("all")).filter(F.col("matched") >= share).select("id", "matched")


def last_value_taint(events: DataFrame, key: str, source: Column, clean: Column, sink: Column) -> DataFrame:
    """Sinks that a source reached: the last event of the key that is a source or cleans is a source."""
    w = Window.partitionBy(key).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(source, F.lit(1)).when(clean, F.lit(0)), ignorenulls=True).over(w)
    return events.withColumn("__sink", sink).withColumn("__state", state).filter("__sink and __state = 1").drop("__sink", "__state")
