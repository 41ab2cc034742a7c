"""Kernel vectors and boundaries of thresholds, as literals."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline import config
from plumbline.functions import paths as P
from plumbline.operators import classes as C
from plumbline.operators import clones, deps, graph, history, report, session_state, smells, stats, text


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_pagerank_of_a_star_and_a_chain(spark):
    # leaves have (1 - d) / n plus their share of the hub's lost mass, so by hand: hub = h, leaf = l, h + 5 l = 1, l = 0.15 / 6 + 0.85 h / 6
    r = dict(rows(graph.pagerank(edges(spark, [(x, 9) for x in range(5)])), "node", "rank"))
    leaf = (0.15 / 6 + 0.85 / 6) / (1 + 5 * 0.85 / 6)
    assert all(abs(r[x] - leaf) < 1e-5 for x in range(5)) and abs(r[9] - (1 - 5 * leaf)) < 1e-5
    chain = dict(rows(graph.pagerank(edges(spark, [(x, x + 1) for x in range(6)])), "node", "rank"))
    assert [chain[x] for x in range(7)] == sorted(chain.values())
    loop = dict(rows(graph.pagerank(edges(spark, [(0, 1), (1, 2), (2, 0)])), "node", "rank"))
    assert all(abs(x - 1 / 3) < 1e-9 for x in loop.values())
    assert graph.pagerank(edges(spark, [])).count() == 0


def test_louvain_of_two_squares_and_of_loops():
    # two squares with both diagonals (six edges each) and one bridge: 12 / 13 of the edges are inside, each side has half of the ends
    square = lambda at: [(at + a, at + b, 1.0) for a in range(4) for b in range(a + 1, 4)]
    of, q = graph.louvain(square(0) + square(10) + [(0, 10, 1.0)])
    assert len({of[x] for x in range(4)}) == 1 and len({of[x] for x in range(10, 14)}) == 1 and of[0] != of[10]
    assert math.isclose(q, 12 / 13 - 0.5)
    assert len(set(graph.louvain(square(0))[0].values())) == 1
    of, q = graph.louvain([(x, x, 2.0) for x in range(5)])
    assert len(set(of.values())) == 5 and q == 0


def ring(n):
    return {(i, (i + 1) % n) for i in range(n)}


@pytest.mark.parametrize("n,pairs,shape", [(2, {(0, 1), (1, 0)}, "Tiny"), (3, ring(3), "Circle"), (3, {(a, b) for a in range(3) for b in range(3) if a != b}, "Clique"), (6, {x for i in range(1, 6) for x in ((0, i), (i, 0))}, "Star"), (8, ring(8) | {(0, 3), (2, 5), (4, 7)}, "Chain")])
def test_cycle_shapes(n, pairs, shape):
    assert graph.cycle_shape(n, pairs) == shape


def test_methods_with_common_fields_are_counted_like_pairs(spark):
    r = random.Random(2)
    made = [(f"m{i}", "f", f"C{i % 3}", r.sample(["a", "b", "c", "d", "e", None], r.randint(0, 5)) + ["a"] * (i % 2 and r.randint(0, 1)), i % 7 == 0) for i in range(60)]
    df = spark.createDataFrame(made, "id string, file string, class string, fields array<string>, is_ctor boolean")
    for few in (6, 2):
        for (name, value) in rows(C.tcc(df, few), "class", "tcc"):
            own = [set(m[3]) - {None} for m in made if m[2] == name and not m[4]]
            pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
            assert math.isclose(value, sum(bool(a & b) for a, b in pairs) / len(pairs))


def test_calls_are_resolved_by_the_first_way(spark):
    methods = spark.createDataFrame([("1", "A", "go"), ("2", "B", "go"), ("3", None, "run"), ("4", "C", "run"), ("5", "C", "only")], "id string, class string, name string")
    calls = spark.createDataFrame([("x", "A", "go", "B", None), ("y", "A", "go", None, "B"), ("z", None, "run", None, "C"), ("w", None, "run", "Z", None), ("v", None, "only", None, None), ("u", None, "none", None, None), ("y", "A", "go", "B", None)], "src string, src_class string, callee string, receiver_type string, hint_class string")
    assert rows(C.resolve_calls(calls, methods), "src", "dst", "confidence") == [("v", "5", 3), ("w", "3", 2), ("w", "4", 2), ("x", "2", 4), ("y", "1", 4), ("y", "2", 4), ("z", "4", 3)]


@pytest.mark.parametrize("few", [500_000, 0])
def test_calls_are_shuffled_only_when_they_are_resolved(spark, monkeypatch, few):
    monkeypatch.setattr(C, "REGISTRY_ROWS", few, raising=False)
    methods = spark.createDataFrame([(str(i), f"C{i % 7}", f"m{i % 5}") for i in range(70)] + [("a", None, "run"), ("b", "C1", "run")], "id string, class string, name string")
    ways = [(f"C{i % 9}", f"m{i % 6}", f"C{i % 8}" if i % 3 else None, f"C{i % 7}" if i % 2 else None) for i in range(500)]
    calls = [(f"s{i % 250}", *w) for i, w in enumerate(ways)] + [("t", None, "run", "C9", None), ("u", "C1", "run", None, None)] * 2
    made, want = [tuple(r) for r in methods.collect()], {}
    for src, own, callee, receiver, hint in calls:
        met = next(((c, level) for c, level in ((receiver, 4), (own, 4), (hint, 3)) if c and (c, callee) in {x[1:] for x in made}), None)
        few_classes = len({x[1] for x in made if x[2] == callee}) <= config.DEFAULTS.named.call_targets
        for i, c, n in made:
            if n == callee and (met and met[0] == c or not met and few_classes):
                want[src, i] = max(want.get((src, i), 0), met[1] if met else 2)
    got = C.resolve_calls(spark.createDataFrame(calls, "src string, src_class string, callee string, receiver_type string, hint_class string"), methods)
    assert rows(got, "src", "dst", "confidence") == sorted((s, d, c) for (s, d), c in want.items())
    assert "Generate" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [8192, 7])
def test_near_pairs_and_clusters_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(clones, "BLOCK", block)
    r = random.Random(block)
    base = [r.getrandbits(64) for _ in range(12)]
    made = []
    for i in range(150):
        word = r.choice(base)
        for _ in range(r.choice([0, 0, 3, 6, 9])):
            word ^= 1 << r.randrange(64)
        made.append((i, word - (1 << 64) if word >> 63 else word, r.choice([3, 6, 7, 9, 20, 24, 26, 31, 40]), f"f{r.randrange(4)}", r.randrange(200)))
    df = spark.createDataFrame(made, "id long, word long, loc int, file string, start int")
    for columns in (["id", "word", "loc"], ["id", "word", "loc", "file", "start"]):
        want = []
        for i, a in enumerate(made):
            for b in made[i + 1 :]:
                short, long_ = sorted((a[2], b[2]))
                over = len(columns) > 3 and a[3] == b[3] and a[4] < b[4] + b[2] and b[4] < a[4] + a[2]
                d = ((a[1] ^ b[1]) & (1 << 64) - 1).bit_count()
                if short >= 6 and long_ * 100 <= short * 130 and d <= min(12, 7 + (short - 6) // 3) and not over:
                    want.append((a[0], b[0], d))
        assert rows(clones.near_pairs(df.select(columns)), "a", "b", "distance") == sorted(want, key=repr)
        root = {x: x for p in want for x in p[:2]}
        for _ in root:
            for a, b, _ in want:
                root[a] = root[b] = min(root[a], root[b])
        assert rows(clones.clusters(df.select(columns)), "id", "cluster") == sorted(root.items(), key=repr)


def test_strong_components_and_reach(spark):
    assert graph.strong_components([(1, 2), (2, 1), (2, 3), (4, 4), (5, 6)]) == [[1, 2], [4]]
    assert rows(graph.reachable(edges(spark, [(1, 2), (2, 3), (3, 1)])), "src", "dst") == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]
    assert graph.strong_components([(i, i + 1) for i in range(5000)] + [(5000, 0)]) == [list(range(5001))]
    assert rows(graph.weak_components(edges(spark, [(i, i + 1) for i in range(20)] + [(50, 51)])), "node", "component")[-1] == (9, 0)


@pytest.mark.parametrize("few", [graph.DRIVER_EDGES, 0, 9])
def test_weak_components_need_few_rounds_on_a_long_chain(spark, monkeypatch, few):
    counted = []
    monkeypatch.setattr(graph, "written", lambda df, name, write=graph.written: counted.append(name) or write(df, name))
    r = random.Random(5)
    far = r.sample(range(100, 900), 400)
    made = [(f"n{a:03}", f"n{b:03}") for a, b in [*zip(far, far[1:]), (900, 901), (903, 902), (904, 904), (901, 902), (905, 906)]]
    want = {x: min(f"n{y:03}" for y in far) for x in (f"n{y:03}" for y in far)} | {f"n90{i}": "n900" for i in range(4)} | {"n904": "n904", "n905": "n905", "n906": "n905"}
    assert dict(rows(graph.weak_components(spark.createDataFrame([*made, (None, "n904")], "src string, dst string"), few), "node", "component")) == want
    assert len(counted) <= (5 if few > 9 else 50)
    inner = spark.createDataFrame(made, "src string, dst string").select(F.struct("src").alias("src"), F.struct(F.col("dst").alias("src")).alias("dst"))
    if few:
        assert {x[0][0]: x[1][0] for x in graph.weak_components(inner.filter("src.src like 'n9%'"), few).collect()} == {k: v for k, v in want.items() if k.startswith("n9")}


def test_instability(spark):
    got = spark.range(1).select(graph.instability(F.lit(5), F.lit(0)).alias("a"), graph.instability(F.lit(0), F.lit(0)).alias("b"), graph.instability(F.lit(1), F.lit(3)).alias("c")).first()
    assert tuple(got) == (0.0, 0.0, 0.75)


def commits(spark, *sets):
    return spark.createDataFrame([(f"c{i}", f"a{i % 2}", 100 + i, f) for i, own in enumerate(sets) for f in own], "hash string, author string, ts long, file string")


def drift(spark, *sets, **t):
    c = commits(spark, *sets)
    typed = c.select("file").distinct()
    th = config.History(**{"min_support": 1, **t})
    return rows(history.drift(c, spark.createDataFrame([], "src string, dst string"), typed, th), "file_a", "file_b", "lift")


def test_co_change(spark):
    c = commits(spark, "abc")
    assert rows(history.co_change_pairs(c), "file_a", "file_b", "support") == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1)]
    assert history.co_change_pairs(commits(spark, [f"f{i}" for i in range(41)])).count() == 0
    assert history.co_change_pairs(commits(spark, [f"f{i}" for i in range(40)])).count() == 780


def test_drift(spark):
    assert drift(spark, "ab", "ab", "ab") == []
    assert drift(spark, "ab", "ab", "ab", "z", "z") == [("a", "b", 15 / 9)]
    assert drift(spark, "ab", "ab", "a", "a", "a", "z", "z") == []
    linked = commits(spark, "ab", "ab", "ab", "z", "z")
    assert history.drift(linked, spark.createDataFrame([("b", "a")], "src string, dst string"), linked.select("file").distinct()).count() == 0


def test_entropies(spark):
    df = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("a", "f3"), ("a", "f4"), *[("b", "f1")] * 7], "k string, f string")
    assert rows(stats.locality_entropy(df, "k", "f"), "k", "locality_entropy") == [("a", 2.0), ("b", 0.0)]
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 4), (3, 3), (3, 0)], "c int, n int")
    assert rows(history.diffusion_entropy(df, ["c"], "n"), "c", "entropy") == [(1, 1.0)]


def test_percentiles(spark):
    v = spark.createDataFrame([(float(x),) for x in range(1, 6)], "v double")
    assert tuple(history.quintiles(v, "v").first()) == (1.0, 3.0, 4.0)
    four = spark.createDataFrame([(1, x) for x in (1, 2, 3, 4)], "k int, v int")
    assert stats.linear_percentile(four, ["k"], "v", 0.9).first()["percentile"] == pytest.approx(3.7)
    assert stats.upper_median(four, ["k"], "v").first()["upper_median"] == 3 and stats.mid_median(four, ["k"], "v").first()["mid_median"] == 2.5


def test_estimates(spark):
    editorial = spark.createDataFrame([("cc", 9, 18), ("file_loc", 500, 700)], "metric string, warning long, alert long")
    got = lambda m, a, b: tuple(stats.estimate(spark.createDataFrame([(m, float(a), float(b))], "metric string, p75 double, p95 double"), editorial.filter(F.col("metric") == m)).first())[1:]
    assert got("cc", 5, 9) == (9, 18) and got("cc", 15, 40) == (15, 40) and got("file_loc", 200, 400) == (500, 700) and got("cc", 30, 20) == (30, 31)
    probes = spark.createDataFrame([("cc", 0.5, 2.0), ("cc", 0.75, 5.0), ("cc", 0.95, 14.0)], "m string, p double, v double")
    for at, want in ((0.85, 9.5), (0.1, 2.0), (0.99, 14.0)):
        assert stats.interpolate(probes, ["m"], at).first()["value"] == pytest.approx(want)
    assert spark.range(1).select(stats.intensity(F.lit(13.5), 9.0, 18.0).alias("x")).first()[0] == 5.0


def test_mdl_and_swap(spark):
    gain = lambda u, s, n: spark.range(1).select(text.mdl_gain(F.lit(u), F.lit(s), F.lit(20), F.lit(n)).alias("g")).first()[0]
    assert gain(0, 5, 100) == 0 and gain(5, 5, 0) == 0 and gain(10, 6, 1000) > gain(10, 3, 1000)
    assert text.swap_p_value([(0, 0)]) == 0.5 and text.swap_p_value([(0, c) for c in range(257)]) == 0.5
    assert 0 <= text.swap_p_value([(r, c) for r in range(6) for c in range(5) if (r + c) % 2], 30) <= 0.5


def test_cohesion(spark):
    v = lambda *m: spark.createDataFrame([("k", str(i), w) for i, own in enumerate(m) for w in own], "class string, method string, word string")
    same = ["alpha", "beta", "gamma"]
    assert text.conceptual_cohesion(v(same, same)).first()["cohesion"] == pytest.approx(1.0)
    assert text.conceptual_cohesion(v(same, ["delta", "omega"])).first()["cohesion"] == pytest.approx(0.0)
    assert text.conceptual_cohesion(v(same)).first()["cohesion"] is None
    assert spark.range(1).select(text.words_of(F.lit("getUserName_v2 ofHTTPServer")).alias("w")).first()["w"] == ["get", "user", "name", "httpserver"]


def test_clone_distance(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (7, 8, 11, 14, 17, 21)], "n int").select(clones.allowed_distance(F.col("n"))).collect()]
    assert got == [7, 7, 8, 9, 10, 12] or got == [7, 8, 9, 10, 11, 12]


FN = "path string, function string, start_line int, end_line int, cc int, cogc int, loc int, bumps int, nesting int, compound int, args int, embedded_loc int, typed int, primitive int, max_same int, asserts int, empty_catch int, short_vars int, match_arms int, is_ctor boolean"
NAMES = [x.split()[0] for x in FN.split(", ")]


@pytest.mark.parametrize(
    "smell,field,first,base",
    [("complex_method", "cc", 9, {}), ("complex_method", "cogc", 15, {}), ("large_method", "loc", 65, {}), ("god_method", "loc", 65, {"cc": 9}), ("nested_conditional_chunks", "bumps", 2, {}), ("deep_nested_complexity", "nesting", 4, {}), ("complex_conditional", "compound", 3, {}), ("excess_arguments", "args", 6, {}), ("constructor_over_injection", "args", 9, {"is_ctor": True}), ("constructor_over_injection", "typed", 4, {"is_ctor": True}), ("large_embedded_block", "embedded_loc", 16, {}), ("primitive_obsession", "primitive", 7, {"typed": 10, "max_same": 2}), ("large_assertion_block", "asserts", 11, {}), ("empty_error_handler", "empty_catch", 1, {}), ("short_variable_names", "short_vars", 4, {"loc": 15}), ("stringly_typed_switch", "match_arms", 6, {})],
)
def test_smell_boundaries(spark, smell, field, first, base):
    data = [tuple({"path": "p", "function": str(v), "start_line": 1, "end_line": 2, "is_ctor": False, **base, field: v}.get(n, 0) for n in NAMES) for v in (first - 1, first, first + 1)]
    found = smells.function_findings(spark.createDataFrame(data, FN)).filter(F.col("smell") == smell)
    assert rows(found, "function") == sorted([(str(first),), (str(first + 1),)], key=repr)


def test_configuration():
    c = config.load("[thresholds.function]\ncc_warning = 7\n[languages.go.function]\narg_max = 3\n[disable]\nsmells = ['god_method']\n[ignore]\npaths = ['gen/**']")
    assert c.thresholds.function.cc_warning == 7 and c.by_language["go"].function.arg_max == 3 and c.by_language["go"].function.cc_warning == 7 and "god_method" in c.disabled and c.ignore == ("gen/**",)
    with pytest.raises(ValueError):
        config.load("[nonsense]\nx = 1")


def test_paths(spark):
    cases = {"src/a.py": ("python", False), "tests/a.py": ("python", True), "a/test_x.py": ("python", True), "a/x.spec.ts": ("typescript", True), "a/FooTest.java": ("java", True), "a/b.R": ("r", False), "a/contest.go": ("go", False), "x_test.go": ("go", True), "noext": (None, False), "a.PY": (None, False)}
    df = spark.createDataFrame([(p,) for p in cases], "path string").select("path", P.language(F.col("path")).alias("l"), P.is_test(F.col("path")).alias("t"))
    assert {r["path"]: (r["l"], r["t"]) for r in df.collect()} == cases
    ignored = spark.createDataFrame([("gen/a.py",), ("src/gen/a.py",), ("a/b/c.py",), ("x.pb.go",)], "path string").select(P.ignored(F.col("path"), ["gen", "a/**/c.py", "*.pb.go"]).alias("i"))
    assert [r["i"] for r in ignored.collect()] == [True, False, True, True]


def test_checkpoints(spark):
    got = spark.range(1, 11).select("id", session_state.is_checkpoint(F.col("id")).alias("c")).filter("c").collect()
    assert [r["id"] for r in got] == [2, 5, 10]


def test_classes(spark):
    f = lambda *x: [{"recv": a, "field": b} for a, b in x]
    m = spark.createDataFrame(
        [(1, "f", "A", "a", 1, ["x"], f(("B", "p"), ("?", "q")), False), (2, "f", "A", "b", 2, ["x", "y"], [], False), (3, "f", "A", "c", 3, ["z"], [], False), (4, "f", "A", "__init__", 1, ["x", "z"], [], True)],
        "id long, file string, class string, name string, cc int, fields array<string>, foreign array<struct<recv:string,field:string>>, is_ctor boolean",
    )
    assert rows(C.classes(m), "method_count", "wmc", "atfd", "stateless") == [(4, 7, 1, False)]
    assert C.tcc(m).first()["tcc"] == pytest.approx(1 / 3) and C.lcom4(m).first()["lcom4"] == 2
    r = random.Random(1)
    near = [(1, f"c{i}", *(r.gauss(0, 1) for _ in range(4))) for i in range(60)]
    found = C.anomalies(spark.createDataFrame([*near, (1, "odd", 90.0, 90.0, -90.0, 50.0)], "g int, k string, a double, b double, c double, d double"), "k", list("abcd"), "g").collect()
    assert max(found, key=lambda x: x["distance"])["k"] == "odd" and len(found) <= 10
    assert C.anomalies(spark.createDataFrame(near[:7], "g int, k string, a double, b double, c double, d double"), "k", list("abcd"), "g").count() == 0
    assert spark.range(1).select(C.downgrade(F.lit(4), F.lit(2)), C.downgrade(F.lit(1), F.lit(9))).first() == (2, 1)


def test_deps_and_reports(spark, tmp_path):
    d = spark.createDataFrame([("a", "1.0"), ("b", "==2.0"), ("c", "3.1")], "name string, constraint string")
    locked = spark.createDataFrame([("b", "2.1")], "name string, version string")
    assert rows(deps.constraint_smells(d, locked, False), "name", "kind") == [("*", "all_pinned_without_lock"), ("b", "pin_differs_from_lock")]
    found = spark.createDataFrame([("p.py", "f", 3, "god_method", 70)], "path string, function string, start_line int, smell string, value long")
    assert report.as_text(found).first()[0] == "p.py:3 god_method (f) 70" and report.with_actions(found).first()["action"].startswith("extract")
    assert report.write_json(found, str(tmp_path / "j")) and not report.write_json(found.filter("1=0"), str(tmp_path / "k"))
    u = report.unify({"god_class": found, "drift": found})
    assert rows(u, "kind", "pillar") == [("drift", "history"), ("god_class", "design")]
    assert report.calibration_toml(spark.createDataFrame([("cc", 9, 18)], "metric string, warning long, alert long")) == "[thresholds.function]\ncc_warning = 9\ncc_alert = 18\n"
    loc = spark.createDataFrame([(1, "p", i) for i in range(13)], "k int, path string, line int")
    one = report.cap_locations(loc, "k").first()
    assert len(one["locations"]) == 10 and one["more"] == 3
    report.write_snapshot(found, str(tmp_path / "s"), ["path"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, source string")
    cache = spark.sql("select sha2('x', 256) as content, 'v1' as version, 7 as result")
    have, need = report.reuse_cached(files, cache, "v1")
    assert rows(have, "path", "result") == [("a", 7)] and rows(need, "path") == [("b",)]
