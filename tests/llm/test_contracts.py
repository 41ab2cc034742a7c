"""The registered queries themselves, on a directory of small odd tables, against plain computations of what each has to return."""

import collections
import hashlib
import itertools
import re
import struct
import zlib

import pytest
import test_llm as t
import xxhash

from plumbline.llm import registry
from plumbline.llm.tokenizing import Encoder, tokenizer_path

COPIES = [(40 + i, "one text of several rows " * 3) for i in range(5)]
DOCS = t.ODD + COPIES + [(60, " ".join(f"near{i}" for i in range(400))), (61, " ".join(f"near{i}" if i != 200 else "other" for i in range(400)))]
#: Ids are needed where a result is by id alone.
IDS = [(i, x) for i, x in DOCS if i is not None]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    langs = itertools.cycle(["en", "de", None])
    spark.createDataFrame([(i, x, next(langs), "s", len(x or "")) for i, x in DOCS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "http://a.example.com/en/7", ""), (2, None, None), (3, "no scheme", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(7, " ".join(f"near{i}" for i in range(50, 90)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    made = {}

    def of(start):
        name = next(n for n in registry.queries() if n.startswith(start))
        if name not in made:
            made[name] = [r.asDict() for r in registry.queries()[name](spark, d).collect()]
        return made[name]

    return of


def counted(rows, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in rows)


def ids_of(text, file, end):
    return [*Encoder(tokenizer_path(file)).library.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_op1(rows):
    want = collections.Counter((i, len(x), crc(x)) for i, x in ((i, ids_of(x, "byte_bpe_50k.json", 0)) for i, x in DOCS))
    got = sorted(rows("op1_"), key=lambda r: r["start"])
    assert counted(got, "doc_id", "n_tokens", "ids_crc32") == want
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known)


def test_op2(rows):
    want = t.brute_lines(DOCS)
    assert counted(rows("op2_"), "doc_id", "text") == collections.Counter(want)
    assert all(r["removed_lines"] >= 0 for r in rows("op2_"))


def test_op3(rows):
    got, want = rows("op3_"), collections.Counter()
    for i, x in DOCS:
        ids = ids_of(x, "word_bpe_49k.json", 1)
        want.update((i, k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for k, at in enumerate(range(0, len(ids), 4096)))
    assert counted(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        own.sort()
        assert [a for a, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= 4096
    assert len(held) == -(-sum(r["length"] for r in got) // 4096)


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_op4(rows):
    words = {x: fingerprint(x) for _, x in DOCS}
    root = {i: i for i, _ in IDS}
    for _ in root:
        for (i, x), (j, y) in itertools.combinations(IDS, 2):
            if (words[x] ^ words[y]).bit_count() <= 4:
                root[i] = root[j] = min(root[i], root[j])
    got = [r for r in rows("op4_") if r["doc_id"] is not None]
    assert counted(got, "doc_id", "fingerprint") == collections.Counter((i, f"{words[x]:016x}") for i, x in IDS)
    # a document of id 8 has two texts, and each of them its component
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] != 8} == {(i, c) for i, c in root.items() if i != 8}


def test_op5(rows):
    assert {r["doc_id"] for r in rows("op5_") if r["contaminated"]} == {60, 61}
    assert counted(rows("op5_"), "doc_id") == collections.Counter((i,) for i, _ in DOCS)


def test_op6(rows):
    want = collections.Counter()
    for i, x in DOCS:
        data = (x or "").encode()
        p = data + b" " * (-len(data) % 192 or (0 if data else 192))
        want[i, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    got = rows("op6_")
    assert counted(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    assert len({r["media_sha256"] for r in got}) == len({r["feature"] + r["payload_sha256"] for r in got})


def test_op7(rows):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows("op7_")}
    assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[2][:3] == ("", "", None) == got[3][:3]


def test_op8(rows):
    got = rows("op8_")
    assert counted(got, "doc_id") == collections.Counter((i,) for i, _ in DOCS)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4, 7)} == {"und"} and {r["lang_pred"] for r in got} <= {"en", "de", "und"}
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op9(rows):
    want = collections.Counter()
    for i, x in DOCS:
        n, base, first, last, labels = t.brute_base(x)
        found = {d[0] for d in t.brute_rules(x)}
        want[i, n, base, first, last, ",".join(labels), ",".join(sorted(found | set(labels)))] += 1
    assert counted(rows("op9_"), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels") == want


def test_op10(rows):
    got = rows("op10_")
    data = lambda x: (x or "").encode()
    assert counted(got, "doc_id", "size", "text_crc32") == collections.Counter((i, len(data(x)) + 1, zlib.crc32(data(x))) for i, x in DOCS)
    assert {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None and 0 <= r["shard"] < 8 for r in got)
    for own in (list(g) for _, g in itertools.groupby(sorted(got, key=lambda r: r["shard"]), key=lambda r: r["shard"])):
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert len({r["shard"] for r in got if r["doc_id"] in dict(COPIES)}) == 1


def test_pipeline(rows):
    got = rows("pipeline")
    assert {r["doc_id"] for r in got} == {1, 5, 8, 40, None} and sum(r["doc_id"] == 40 for r in got) == 1
