"""Vocabularies, cohesion, naturalness and recurring patterns."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS, Mining, Named
from plumbline.session import written


def words_of(name: Column) -> Column:
    """Lower-case parts of at least three characters of an identifier: cut at case changes and non-alphanumerics."""
    cut = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(cut)), " "), lambda w: F.length(w) >= 3)


def conceptual_cohesion(vocabulary: DataFrame, t: Named = DEFAULTS.named) -> DataFrame:
    """(class, methods, terms, cohesion): mean pairwise TF-IDF cosine of a class's methods. vocabulary: class, method, word, one row an occurrence.

    Unit vectors: the sum of all pairwise products is (|sum of vectors|^2 - sum of
    |vector|^2) / 2, so no pairs are formed.
    """
    # written, for it is read five times and the vocabulary is far longer
    tf = written(vocabulary.groupBy("class", "method", "word").agg(F.count(F.lit(1)).alias("tf")), "tf")
    methods = tf.select("class", "method").distinct().groupBy("class").agg(F.count(F.lit(1)).alias("methods"))
    df = tf.groupBy("class", "word").agg(F.count(F.lit(1)).alias("df"))
    x = tf.join(df, ["class", "word"]).join(methods, "class").withColumn("x", F.col("tf") * (F.log((1 + F.col("methods")) / (1 + F.col("df"))) + 1))
    norm = x.groupBy("class", "method").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    unit = x.join(norm, ["class", "method"]).withColumn("u", F.col("x") / F.col("norm"))
    total = unit.groupBy("class", "word").agg(F.sum("u").alias("s")).groupBy("class").agg(F.sum(F.col("s") * F.col("s")).alias("square"), F.count(F.lit(1)).alias("terms"))
    own = norm.filter("norm > 0").groupBy("class").agg(F.count(F.lit(1)).cast("double").alias("ones"))
    out = total.join(own, "class").join(methods, "class")
    pairs = F.col("methods") * (F.col("methods") - 1)
    return out.select("class", "methods", "terms", F.when(pairs > 0, (F.col("square") - F.col("ones")) / pairs).alias("cohesion"))


def low_cohesion(cohesion: DataFrame, t: Named = DEFAULTS.named) -> DataFrame:
    return cohesion.filter((F.col("methods") >= t.cohesion_methods) & (F.col("terms") >= t.cohesion_vocabulary) & (F.col("cohesion") < t.cohesion_min))


def ngrams(tokens: DataFrame, order: int, keys: list[str]) -> DataFrame:
    """(keys, gram, n): counts of runs of `order` tokens. tokens: keys and an array `tokens`."""
    at = F.sequence(F.lit(1), F.size("tokens") - order + 1)
    grams = tokens.filter(F.size("tokens") >= order).select(*keys, F.explode(F.transform(at, lambda i: F.array_join(F.slice("tokens", i, F.lit(order)), " "))).alias("gram"))
    return grams.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))


def naturalness(functions: DataFrame, t: Mining = DEFAULTS.mining) -> DataFrame:
    """(id, group, tokens, entropy): mean bits a token of each function under an n-gram model of all others, mixed with a cache of its own.

    functions: id (unique), group, tokens (array). For each place, counts of the
    last tokens of each order come from one table of counts and lose the
    function's own; probabilities of the orders are interpolated evenly from the
    shortest, and mixed with the cache by gamma / (gamma + places seen). A place
    and order is one narrow row (context, token), shuffled twice: to the counts,
    which are aggregated before, and to its function. Joins sort, for the counts
    grow with the data and compress too well for the planner's guess of a size.
    """
    orders = range(1, t.ngram_order + 1)
    rows = functions.filter(F.size("tokens") >= t.ngram_tokens)

    def gram_at(order: int, i: Column) -> Column:
        context = F.array_join(F.slice("tokens", F.greatest(i - order + 2, F.lit(1)), F.lit(order - 1)), "\x01") if order > 1 else F.lit("")
        return F.struct(F.lit(order).alias("order"), i.alias("at"), context.alias("context"), F.get("tokens", i).alias("token"))

    at = F.sequence(F.lit(0), F.size("tokens") - 1)
    grams = F.flatten(F.array(*[F.transform(F.slice(at, F.lit(o), F.size("tokens")), partial(gram_at, o)) for o in orders]))
    places = rows.select("id", "group", F.explode(grams).alias("p")).select("id", "group", "p.*")
    counted = places.groupBy("group", "order", "context", "token").agg(F.count(F.lit(1)).alias("all"))
    contexts = counted.groupBy("group", "order", "context").agg(F.sum("all").alias("all_c"), F.count(F.lit(1)).alias("kinds"))
    model = counted.join(contexts.hint("merge"), ["group", "order", "context"])
    met = places.join(model.hint("merge"), ["group", "order", "context", "token"]).repartition("id")
    own_c = Window.partitionBy("id", "order", "context")
    gram = Window.partitionBy("id", "order", "context", "token").orderBy("at")
    met = met.withColumns({"own": F.count(F.lit(1)).over(gram.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "again": F.row_number().over(gram) - 1}).withColumn("own_c", F.count(F.lit(1)).over(own_c))
    rest = F.col("all_c") - F.col("own_c")
    p = F.when(rest > 0, (F.col("all") - F.col("own")) / rest)
    one = F.col("order") == 1
    scored = met.groupBy("id", "group", "at").agg(F.max(F.when(one, F.col("kinds"))).alias("v"), F.max(F.when(one, F.col("again"))).alias("again"), *[F.max(F.when(F.col("order") == o, p)).alias(f"p{o}") for o in orders])
    prob = 1.0 / F.col("v")
    for order in orders:
        own_p = F.col(f"p{order}")
        prob = F.when(own_p.isNull(), prob).otherwise(0.5 * own_p + 0.5 * prob)
    seen = F.least("at", F.lit(t.ngram_cache))
    global_share = t.ngram_gamma / (t.ngram_gamma + seen)
    cached = F.when(seen > 0, F.col("again") / seen).otherwise(0.0)
    mixed = F.greatest(global_share * prob + (1 - global_share) * cached, F.lit(1e-12))
    return scored.withColumn("bits", -F.log2(mixed)).groupBy("id", "group").agg(F.count(F.lit(1)).alias("tokens"), F.avg("bits").alias("entropy"))


def unnatural(scores: DataFrame, t: Mining = DEFAULTS.mining) -> DataFrame:
    """(id, group, entropy, z): functions whose entropy lies far above their group's.

    z is by the median of the absolute deviations, or by their mean where that
    median is zero; groups of fewer than natural_functions functions, or without
    any spread, have none.
    """
    middle = scores.groupBy("group").agg(F.median("entropy").alias("mid"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= t.natural_functions)
    off = scores.join(middle, "group").withColumn("off", F.col("entropy") - F.col("mid"))
    spread = off.groupBy("group").agg(F.median(F.abs("off")).alias("mad"), F.avg(F.abs("off")).alias("mean"))
    unit = F.when(F.col("mad") > 0, 0.6745 / F.col("mad")).when(F.col("mean") > 0, 0.7979 / F.col("mean"))
    return off.join(spread, "group").withColumn("z", unit * F.col("off")).filter(F.col("z") > t.ngram_zscore).select("id", "group", "entropy", "z")


def frequent_patterns(subtrees: DataFrame, t: Mining = DEFAULTS.mining) -> DataFrame:
    """(pattern, support, files): patterns of enough support that are closed: no single parent pattern always holds them. subtrees: pattern, parent (null at a root), place."""
    support = subtrees.groupBy("pattern").agg(F.count(F.lit(1)).alias("support"), F.count_distinct("place").alias("files")).filter(F.col("support") >= t.min_support)
    by_parent = subtrees.groupBy("pattern", "parent").agg(F.count(F.lit(1)).alias("n"))
    always = by_parent.filter("parent is not null").join(support.select("pattern", "support"), "pattern").filter("n = support")
    parents = support.select(F.col("pattern").alias("parent"), F.col("support").alias("parent_support"))
    absorbed = always.join(parents, "parent").filter("parent_support = support").select("pattern")
    return support.join(absorbed, "pattern", "left_anti")


def mdl_gain(usage: Column, size: Column, vocabulary: Column, total: Column) -> Column:
    """Bits that naming a pattern saves; none without uses or data."""
    b = F.log2(F.greatest(vocabulary, F.lit(2)).cast("double"))
    gain = usage * (size - 1) * b - size * b - usage * (F.log2(total.cast("double")) - F.log2(usage.cast("double")))
    return F.when((usage <= 0) | (total <= 0), F.lit(0.0)).otherwise(gain)


def idf(df: Column, n: Column) -> Column:
    return F.log(n / df)


def categorise(root_kind: Column, rules: dict[str, str], default: str = "other") -> Column:
    """The category of the first pattern that the root kind matches."""
    out = F.lit(default)
    for pattern, name in reversed(list(rules.items())):
        out = F.when(root_kind.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def swap_p_value(pairs: list[tuple[int, int]], samples: int = 200, seed: int = 0x5EED) -> float:
    """How unusual it is that so many columns share two rows or more, among matrices of the same margins; 0.5 if there are over 256 columns or under two edges.

    pairs: (row, column), which are sorted first, so equal input gives an equal value.
    """
    import random

    edges = sorted(set(pairs))
    columns = {c for _, c in edges}
    if len(columns) > 256 or len(edges) < 2:
        return 0.5

    def statistic(e: list[tuple[int, int]]) -> int:
        per: dict[int, int] = {}
        for _, c in e:
            per[c] = per.get(c, 0) + 1
        rows: dict[int, list[int]] = {}
        for r, c in e:
            rows.setdefault(r, []).append(c)
        shared: dict[tuple[int, int], int] = {}
        for own in rows.values():
            own.sort()
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    shared[a, b] = shared.get((a, b), 0) + 1
        return sum(1 for v in shared.values() if v >= 2)

    rng, real = random.Random(seed), statistic(edges)
    below = above = 0
    for _ in range(samples):
        now, have = list(edges), set(edges)
        for _ in range(5 * len(edges)):
            i, j = rng.randrange(len(now)), rng.randrange(len(now))
            (a, b), (c, d) = now[i], now[j]
            if a != c and b != d and (a, d) not in have and (c, b) not in have:
                have -= {(a, b), (c, d)}
                have |= {(a, d), (c, b)}
                now[i], now[j] = (a, d), (c, b)
        got = statistic(now)
        below += got <= real
        above += got >= real
    return (min(below, above) + 1) / (samples + 1) if min(below, above) < samples else 0.5
