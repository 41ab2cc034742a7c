"""Spaced seeds against a plain comparison of every place of every text with every place of every item."""

import random

import regex
from pyspark.sql import functions as F

from plumbline.llm import decontaminate as dec


def words(text):
    return regex.split(r"[^\p{L}\p{N}]+", (text or "").lower())


def brute(docs, bench):
    out = {}
    for i, t in docs:
        w, found = words(t), {}
        for k, b in bench:
            item = [x for x in words(b) if x]
            for at in range(len(w)):
                for j in range(len(item)):
                    if len(item) < dec.SPAN:
                        hit = len(item) >= dec.LEAST_WORDS and not j and w[at : at + len(item)] == item
                    else:
                        hit = j + dec.SPAN <= len(item) and at + dec.SPAN <= len(w) and any(all(w[at + p] == item[j + p] for p in mask) for mask in dec.MASKS)
                    if not hit:
                        continue
                    low, high = max(0, j - dec.BEFORE), min(len(item), j + dec.AFTER)
                    same = [0 <= x + at - j < len(w) and w[x + at - j] == item[x] for x in range(low, high)]
                    run = longest = 0
                    for x in same:
                        run = run + 1 if x else 0
                        longest = max(longest, run)
                    if sum(same) / (high - low) >= dec.OVERLAP or longest >= dec.RUN:
                        found[k] = max(found.get(k, 0.0), sum(same) / (high - low))
        if found:
            out[i] = (sorted(found), max(found.values()))
    return out


def test_items_and_overlap_equal_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)]
    new = lambda n: [r.choice(vocabulary) + r.choice(["", "x", "y"]) for _ in range(n)]
    items = [new(n) for n in (3, 4, 6, 9, 10, 14, 40, 60)] + [["echo"] * 12]
    bench = [(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, ""), (92, "?!")]
    docs = [(0, None), (1, ""), (2, " ".join(["echo"] * 200)), (3, "echo echo")]
    for i in range(4, 60):
        text = new(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            item = list(r.choice(items))
            a = r.randrange(len(item))
            part = item if r.random() < 0.5 else item[a : a + r.choice([9, 12, 13, 20])]
            part = [x if r.random() > 0.06 else "other" for x in part]
            at = r.randint(0, len(text))
            text[at:at] = part
        docs.append((i, ", ".join(text)))
    want = brute(docs, bench)
    assert any(set(x) & {1, 2, 3} for x, _ in want.values()) and any(y < dec.OVERLAP for _, y in want.values())
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for most in (dec.BROADCAST_ROWS, 0):
        got = {x["__id"]: (x["items"], x["overlap"]) for x in dec.benchmark_hits(df, b, broadcast_rows=most).collect()}
        assert got == want


def test_the_bitmap_has_every_seed(spark):
    seeds = spark.range(500).select(F.xxhash64("id").alias("__seed"))
    bitmap, longs = dec._bitmap(seeds, 500)
    bits = bitmap.first()["bitmap"]
    assert len(bits) == longs == 128
    inside = lambda x: bits[(x >> 6) % longs] >> (x & 63) & 1
    assert all(inside(x["__seed"]) for x in seeds.collect())
    others = [x[0] for x in spark.range(1000, 3000).select(F.xxhash64("id")).collect()]
    assert sum(map(inside, others)) < 0.15 * len(others)


def test_queries_on_a_directory(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g"), (2, None), (2, None), (3, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "b c d e")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, dec.op5_spaced_seed_leaks(spark, str(tmp_path)).collect()))
    assert got == [(1, True, [7], 1.0), (2, False, [], 0.0), (2, False, [], 0.0), (3, False, [], 0.0)]
