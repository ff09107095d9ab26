import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_fixtures import none, odd, odd_rows  # noqa: F401

from pricelens.llm import hash_tree, periodic_runs, prefix_trie
from pricelens.llm.tables import read

_WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Hash tree


def spark_xxhash(*values):
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def descend(key, node, prefix=""):
    """The shard by brute force: every level's draws in plain Python."""
    weight = lambda x: sum(map(weight, x.values())) if isinstance(x, dict) else x
    if not isinstance(node, dict):
        return int(prefix.split("/")[-2])
    draws = []
    for name, below in node.items():
        if weight(below) > 0:
            u = ((spark_xxhash(key, spark_xxhash(f"{prefix}{name}")) % (1 << 64) >> 11) + 1) * 2.0**-53
            draws.append((-math.log(u) / weight(below), name))
    name = min(draws)[1]
    return descend(key, node[name], f"{prefix}{name}/")


TREES = [
    hash_tree.tree_of(8),
    hash_tree.tree_of(5),
    {"a": {"r": {0: 1.0, 1: 3.0}, "s": {2: 0.5}}, "b": {"r": {3: 2.0, 4: 0.0}}, "c": {"r": {5: 0.0}}},
]


@pytest.mark.parametrize("tree", TREES)
def test_tree_equals_plain_descent(spark, tree):
    rows = spark.range(-50, 400).select("id", hash_tree.shard_of(F.col("id"), tree).alias("shard")).collect()
    assert all(r.shard == descend(r.id, tree) for r in rows)


@pytest.mark.parametrize("tree", TREES)
def test_one_more_shard_takes_keys_only_into_itself(spark, tree):
    after = hash_tree.grown(hash_tree.grown(tree, 2.0))
    new = max(s for racks in after.values() for r in racks.values() for s in r)
    before = hash_tree.grown(tree, 2.0)
    moved = spark.range(20_000).select(hash_tree.shard_of(F.col("id"), before).alias("a"), hash_tree.shard_of(F.col("id"), after).alias("b")).where("a <> b")
    rows = moved.groupBy("b").count().collect()
    assert [r.b for r in rows] == [new] and rows[0]["count"] > 0


def test_movement_stays_in_the_changed_subtree(spark):
    tree = hash_tree.tree_of(8)
    lighter = {**tree, "region1": {**tree["region1"], "rack2": {4: 0.25, 5: 1.75}}}
    rows = spark.range(20_000).select(hash_tree.shard_of(F.col("id"), tree).alias("a"), hash_tree.shard_of(F.col("id"), lighter).alias("b")).where("a <> b").distinct().collect()
    assert {(r.a, r.b) for r in rows} == {(4, 5)}


def test_shards_follow_weights(spark):
    rows = spark.range(60_000).select(hash_tree.shard_of(F.col("id"), TREES[2]).alias("s")).groupBy("s").count().collect()
    got = {r.s: r["count"] / 60_000 for r in rows}
    assert set(got) == {0, 1, 2, 3}
    for shard, weight in {0: 1, 1: 3, 2: 0.5, 3: 2}.items():
        assert abs(got[shard] - weight / 6.5) < 0.01


def test_trees_that_say_nothing_are_refused():
    with pytest.raises(ValueError):
        hash_tree.shard_of(F.lit(1), {"a": {"r": {0: 1.0}}, "b": {"r": {0: 1.0}}})
    with pytest.raises(ValueError):
        hash_tree.shard_of(F.lit(1), {"a": {"r": {0: 0.0}}})


def check_shards(rows, texts, tree, after):
    slots = defaultdict(list)
    got = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        got[r.doc_id].append((r["size"], r.text_crc32))
        assert r.law == "key"
        if r.doc_id is not None:
            assert (r.shard, r.grown_shard) == (descend(r.doc_id, tree), descend(r.doc_id, after))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = defaultdict(list)
    for doc_id, text in texts:
        data = (text or "").encode()
        want[doc_id].append((len(data) + 1, zlib.crc32(data)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_shards_of_documents(spark, sf_dir, odd, odd_rows, none):
    tree = hash_tree.tree_of(8)
    docs = read(spark, sf_dir, "documents")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_shards(hash_tree.shards_and_growth(docs).collect(), texts, tree, hash_tree.grown(tree))
    check_shards(hash_tree.shards_and_growth(odd).collect(), odd_rows, tree, hash_tree.grown(tree))
    assert hash_tree.shards_and_growth(none).collect() == []


def test_one_hot_id_is_numbered_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(hash_tree, "buckets_for", lambda df, mb: 16)
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    rows = hash_tree.placed(docs, hash_tree.tree_of(4))
    slots = defaultdict(list)
    for r in rows.collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 3000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# Periodic runs


def plain_runs(words, periods=4, least=6):
    """Every (start, length, period) by trying all periods at all places."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < len(words) and words[e] == words[e + q]:
                e += 1
            length = e - i + q
            if length >= max(least, periods * q) and not any(s <= i and i + length <= s + n for s, n, p in found.values() if q % p == 0):
                found[(i, q)] = (i, length, q)
            i = e + 1
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


def recurred(doc_id, words):
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected_row(doc_id, text):
    words = recurred(doc_id, _WORD.findall(text or ""))
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, listed, sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(12):
        words = []
        while len(words) < rng.randint(0, 120):
            root = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 9))]
            words += (root * rng.randint(1, 9))[: rng.randint(1, 60)]
        docs.append(words)
    offsets = np.cumsum([0, *map(len, docs)])
    numbers = np.array([ord(w) for d in docs for w in d], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    runs = periodic_runs.runs_of(numbers, offsets)
    got = [list() for _ in docs]
    for s, n, q in zip(*(x.tolist() for x in runs)):
        k = int(np.searchsorted(offsets, s, side="right")) - 1
        got[k].append((s - int(offsets[k]), n, q))
    assert got == [plain_runs(d) for d in docs]


def test_long_recurring_words():
    for words, want in (
        (["a"] * 100_000, [(0, 100_000, 1)]),
        (list("abcdefghijk") * 9000 + ["z"], [(0, 99_000, 11)]),
        ([str(k % 5000) for k in range(40_000)], [(0, 40_000, 5000)]),
        ([str(k) for k in range(40_000)], []),
    ):
        codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
        runs = periodic_runs.runs_of(np.array([codes[w] for w in words], np.uint64), np.array([0, len(words)]))
        assert list(zip(*(x.tolist() for x in runs))) == want


def test_digests_equal_brute_force(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("length(text) < 4000 OR text IS NULL")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert by_id(periodic_runs.digests(docs).collect()) == by_id(expected_row(*x) for x in texts)


@pytest.fixture(scope="module")
def odd_runs(odd_rows):
    return [(d, t) for d, t in odd_rows if len(t or "") < 6000] + [
        (60, "Ha ha " * 9),
        (61, "ha " * 9 + "\x0b\r\n" + "ho ho " * 9),
        (62, "a " * 5),
        (63, "x y x y x y x y"),
        (64, "ö ü ö ü ö ü ö ü ö"),
        (None, "no id " * 7),
        *[(k, "one two three four five six seven eight nine ten eleven") for k in range(100, 140)],
    ]


def test_odd_texts_and_small_blocks(spark, odd_runs, none, monkeypatch):
    df = spark.createDataFrame([(d, t, 5, "s") for d, t in odd_runs], "doc_id long, text string, start long, runs_sha256 string")
    want = by_id(expected_row(*x) for x in odd_runs)
    assert by_id(periodic_runs.digests(df).collect()) == want
    monkeypatch.setattr(periodic_runs, "BLOCK", 40)
    monkeypatch.setattr(periodic_runs, "WORDS_AT_ONCE", 3)
    rows = periodic_runs._analysed([d for d, _ in odd_runs], [t or "" for _, t in odd_runs])
    assert by_id(rows) == want
    assert periodic_runs.digests(none).collect() == []


def test_runs_and_texts_as_they_are(spark, odd_runs):
    df = spark.createDataFrame(odd_runs, "doc_id long, text string")
    got = periodic_runs.with_runs(df).collect()
    want = [(d, plain_runs(_WORD.findall(t or ""))) for d, t in odd_runs]
    assert by_id((r.doc_id, [tuple(x) for x in r.runs]) for r in got) == by_id(want)
    left = {r.doc_id: r.text for r in periodic_runs.without_runs(df).collect()}
    assert left[60] == "Ha ha" and left[62] == "a a a a a" and left[63] == "x y"


# Prefix trie


def plain_trie(rows, rebuild):
    """All nodes by plain dictionaries over whole prefixes."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in turns.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - int(math.fmod(c, 5))
        paths[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: ",".join(str(c) for c in m if len(paths[c]) == len(p)) for p, m in members.items()}
    return [
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p]))
        for p, m in members.items()
    ]


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(-7, 23), 40, 41, 44, 97]:
        for turn in range(rng.choice([0, 1, 2, 3, 9, 12, 20])):
            rows.append((conv, turn, rng.choice(["user", "bot"]) if turn else "user", "t" * rng.choice([0, 1, 1, 1, 2])))
    rows += [(50, None, "user", "t"), (50, None, None, None), (50, 3, "user", None), (50, 3, "user", None), (50, 3, "a", "ü")]
    rows += [(None, 1, "user", "t"), (None, None, None, None)]
    rows += [(60, k % 7, "user", "same") for k in range(40)] + [(c, 0, "user", "x") for c in range(70, 95)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def trie_rows(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return by_id(df.select(columns).collect())


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_equals_brute_force(spark, rebuild):
    rows = conversations(3)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit(1), "n": F.lit(2), "turns": F.lit("z"), "block": F.lit(0)}).repartition(5)
    assert trie_rows(prefix_trie.trie(df, rebuild)) == by_id(plain_trie(rows, rebuild))


def test_blocks_stretches_chunks_and_ranges_of_any_size(spark, monkeypatch):
    rows = conversations(5) + [(200, k, "user", str(k % 3)) for k in range(90)] + [(201, k, "user", str(k % 3)) for k in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 60)
    monkeypatch.setattr(prefix_trie, "HOT_PARENTS", 2)
    monkeypatch.setattr(prefix_trie, "buckets_for", lambda df, mb: 9)
    assert trie_rows(prefix_trie.trie(df, True, width=2, stretch=3)) == by_id(plain_trie(rows, True))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.rebuilt_nodes(none).collect() == []
    only = spark.createDataFrame([(None, 1, "user", "t")], SCHEMA)
    assert prefix_trie.rebuilt_nodes(only).collect() == []


def test_turn_texts_read_the_nodes(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "ho"), (2, 0, "user", "hi"), (2, 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = prefix_trie.trie(df).where("depth > 0").join(prefix_trie.turn_texts(df), "turn")
    assert sorted((r.depth, r.role, r.text, r.n_convs) for r in nodes.collect()) == [(1, "user", "hi", 2), (2, "", "", 1), (2, "bot", "ho", 1)]
