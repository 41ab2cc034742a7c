"""License notices in texts by ordered signature rules, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents
from plumbline.llm.license_rules import rules

#: The base phrases and their labels.
PHRASES = [(("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word in lower-cased text, and in text as it is (where A-Z are the letters to be lower-cased).
_IN, _OUT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE_CONFIDENCE = 0.7


def _phrase(words: tuple[str, ...]) -> str:
    return rf"(?<!{_IN})" + rf"{_OUT}+".join(words) + rf"(?!{_IN})"


def _n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_RAW_WORD)).cast("long")


def _has(text: Column, keyword: str) -> Column:
    return _any([F.contains(text, F.lit(w)) for w in keyword.split("|")])


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: __id, n_words, n_base, first_word, last_word, base_labels, detections (arrays).

    A detection is (label, rule, priority, confidence, start, end): characters
    from 0 of the text with A-Z lower-cased, of a rule whose keywords the text
    contains. A detection whose interval lies in that of another of higher
    priority, or of equal priority and greater length, or the same interval and
    an earlier rule, is suppressed. A null text counts as empty; texts without
    keywords get empty arrays. No rows are lost or merged.
    """
    table = rules()
    words = sorted({w for r in table for w in (r[4], r[5]) if w})
    at = {w: i for i, w in enumerate(words)}
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    wide = F.lower(raw)
    may_base = _any([reduce(lambda a, b: a & b, [F.contains(wide, F.lit(w)) for w in p]) for p, _ in PHRASES])
    # every notice's keyword alone may fire the form "named", so these decide whether a text has to be looked at
    may_rule = _any([_has(wide, w) for w in sorted({r[5] for r in table})])
    df = docs.select(F.col(id_col).alias("__id"), _n_words(raw).alias("n_words"), F.when(may_base | may_rule, F.translate(raw, UPPER, LOWER)).alias("__low"))

    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        parts = F.when(reduce(lambda a, b: a & b, [F.contains("__low", F.lit(w)) for w in phrase]), F.split("__low", _phrase(phrase), -1))
        name = f"__parts_{label}"
        df = df.withColumn(name, parts)
        times = F.when(F.col(name).isNull(), 0).otherwise(F.size(name) - 1).cast("long")
        counts.append(times)
        firsts.append(F.when(times > 0, _n_words(F.get(name, F.lit(0)))))
        lasts.append(F.when(times > 0, F.col("n_words") - _n_words(F.element_at(name, -1)) - len(phrase)))
        labels.append(F.when(times > 0, F.lit(label)))
    df = df.select(
        "__id",
        "n_words",
        "__low",
        reduce(lambda a, b: a + b, counts).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.sort_array(F.array_compact(F.array(*labels))).alias("base_labels"),
    )

    has = F.when(F.col("__low").isNotNull(), F.array(*[_has(F.col("__low"), w) for w in words]))
    df = df.withColumn("__has", has)
    listed = F.array(*[F.struct(F.lit(o).alias("rule"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(c).alias("confidence"), F.lit(at[f] if f else -1).alias("f"), F.lit(at[n]).alias("n"), F.lit(x).alias("pattern")) for o, p, label, c, f, n, x in table])
    tried = F.filter(listed, lambda r: F.get("__has", r["n"]) & ((r["f"] < 0) | F.get("__has", r["f"])))
    found = F.flatten(F.transform(F.when(F.col("__has").isNotNull(), tried), lambda r: _places(r, F.regexp_extract_all("__low", r["pattern"], F.lit(0)), F.split("__low", r["pattern"]))))
    df = df.withColumn("__found", F.coalesce(found, F.array().cast("array<struct<label:string,rule:int,priority:int,confidence:double,start:int,end:int>>")))

    def hidden(d: Column) -> Column:
        length = d["end"] - d["start"]
        return F.exists(
            "__found",
            lambda o: (o["start"] <= d["start"])
            & (o["end"] >= d["end"])
            & ((o["priority"] > d["priority"]) | (o["priority"] == d["priority"]) & ((o["end"] - o["start"] > length) | (o["end"] - o["start"] == length) & (o["rule"] < d["rule"]))),
        )

    kept = F.filter("__found", lambda d: ~hidden(d))
    return df.select("__id", "n_words", "n_base", "first_word", "last_word", "base_labels", kept.alias("detections"))


def _places(rule: Column, matches: Column, gaps: Column) -> Column:
    """Where a rule's matches stand: each after the gaps and matches before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<label:string,rule:int,priority:int,confidence:double,start:int,end:int>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        one = F.struct(rule["label"].alias("label"), rule["rule"].alias("rule"), rule["priority"].alias("priority"), rule["confidence"].alias("confidence"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def op9_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(documents(spark, sf_dir))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.col("detections.label"))))
    best = F.coalesce(F.array_max(F.col("detections.confidence")), F.lit(0.0))
    score = F.greatest(best, F.when(F.size("base_labels") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0)))
    return out.select(F.col("__id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
