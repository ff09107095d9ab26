import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import none, odd, odd_rows, texts  # noqa: F401
from llm_words import words_of
import corpus_pipeline
from pricelens.llm import components, queries, shingle_join, suffix_dedup, weighted_fingerprints
from pricelens.llm.words import word_hashes


def test_word_hashes_tell_words_apart(monkeypatch):
    batch = ["The  quick\tBrown fox", "", "the x" * 3, "é É ÀB", " a ", "\x0b\x1c b", "the" * 4000 + " z"]
    monkeypatch.setattr("pricelens.llm.words.SLICE", 7)
    hashes, offsets = word_hashes(batch)
    names = {}
    for k, text in enumerate(batch):
        own = words_of(text)
        assert len(own) == offsets[k + 1] - offsets[k]
        for j, word in enumerate(own):
            assert names.setdefault(word, hashes[offsets[k] + j]) == hashes[offsets[k] + j]
    assert len(set(names.values())) == len(names)


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()


def components_by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    name = {i: min((rows[k][0] for k in g if rows[k][0] is not None), default=None) for g in groups.values() for i in g}
    return Counter((rows[i][0], len(sets[i]), name[i]) for i in range(len(rows))), groups


def near_family(seed, n, words=60, edits=4):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits)):
            own[at] = f"e{rng.integers(0, 100000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("chunk", [512, 5])
def test_links_of_all_pairs(spark, sf_dir, texts, odd, odd_rows, monkeypatch, chunk):
    monkeypatch.setattr(shingle_join, "CHUNK", chunk)
    families = [(100 * f + k, t) for f in range(3) for k, t in enumerate(near_family(f, 30))]
    own = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    inputs = [(own, families)]
    if chunk > 5:
        inputs += [(odd, odd_rows), (spark.read.parquet(f"{sf_dir}/documents.parquet"), list(texts.items()))]
    for docs, rows in inputs:
        got = Counter(tuple(r) for r in shingle_join.linked_documents(docs).select("doc_id", "n_shingles", "component_id").collect())
        assert got == components_by_hand(rows)[0]


def test_one_of_each_component_stays(odd, odd_rows, none):
    kept = shingle_join.one_of_each(odd)
    assert kept.columns == odd.columns
    _, groups = components_by_hand(odd_rows)
    rows = kept.collect()
    assert len(rows) == len(groups)
    want = Counter(min((odd_rows[k][0] is None, odd_rows[k][0] or 0) for k in g) for g in groups.values())
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in rows) == want
    assert shingle_join.one_of_each(none).count() == 0 and shingle_join.linked_documents(none).count() == 0


def test_prefix_asked_for_more_matches_is_longer_and_never_misses():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        df = np.sort(rng.integers(2, 500, rng.integers(shingle_join.least_common(n), n + 1)))
        asked, inside = shingle_join.matches_asked(n, df)
        assert 1 <= asked <= shingle_join.MOST_MATCHES and inside >= asked - (n - len(df))
        assert inside == min(len(df), max(0, n - shingle_join.least_common(n) + asked - (n - len(df))))


def test_components_of_a_long_chain(spark, monkeypatch):
    nodes = spark.range(200).select("id")
    monkeypatch.setattr("pricelens.operators.lookup.HOT_ROWS", 20)
    star = spark.range(1, 150).selectExpr("id AS a", "199 AS b")
    assert {r.id: r.label for r in components.components(nodes, star).collect()} == {k: 1 if 0 < k < 150 or k == 199 else k for k in range(200)}
    chain = spark.range(150).selectExpr("id AS a", "id + 1 AS b")
    labels = {r.id: r.label for r in components.components(nodes, chain).collect()}
    assert all(labels[k] == (0 if k <= 150 else k) for k in range(200))


def removed_by_hand(rows, length=400):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[k : k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for (doc_id, _), r in zip(rows, raw, strict=True):
        mark = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                mark[k : k + length] = True
        runs = int((mark[1:] & ~mark[:-1]).sum() + mark[0])
        kept = np.frombuffer(r, np.uint8)[~mark[:-1]].tobytes()
        out.append((doc_id, len(r), int(mark.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def word_runs_by_hand(rows, least=50):
    words = [words_of(t) for _, t in rows]
    seen = Counter(tuple(w[k : k + least]) for w in words for k in range(len(w) - least + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        mark = np.zeros(len(w) + 1, bool)
        for k in range(len(w) - least + 1):
            if seen[tuple(w[k : k + least])] > 1:
                mark[k : k + least] = True
        out.append((doc_id, int((mark[1:] & ~mark[:-1]).sum() + mark[0]), int(mark.sum())))
    return Counter(out)


def test_repeated_runs_of_words_in_all_windows(spark, sf_dir, texts, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 9000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 60_000)
    rows = [(d, t) for d, t in odd_rows if len(t or "") < 30_000]
    small = odd.where("text IS NULL OR length(text) < 30000")
    for docs, rows in ((small, rows), (spark.read.parquet(f"{sf_dir}/documents.parquet"), list(texts.items()))):
        got = suffix_dedup.digests(docs).select("doc_id", "n_word_runs", "n_repeated_words").collect()
        want = word_runs_by_hand(rows)
        assert Counter(tuple(r) for r in got) == want
        assert any(runs for _, runs, _ in want) and any(not runs for _, runs, _ in want)


def test_near_copies_travel_together(spark, monkeypatch):
    """Copies that differ in a word share a block, whatever partition they come from, so their strings go once."""
    rng = np.random.default_rng(5)
    text = [" ".join(bytes(rng.integers(97, 123, 7).astype(np.uint8)).decode() for _ in range(400)) for _ in range(6)]
    rows = [(k, f"{text[k % 6]} {k}") for k in range(48)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sent = []
    real = suffix_dedup.repeated_spans

    def seen(texts, *args):
        sent.append([tuple(r) for r in texts.select(F.spark_partition_id(), "near").collect()])
        return real(texts, *args)

    monkeypatch.setattr(suffix_dedup, "repeated_spans", seen)
    assert suffix_dedup.digests(docs).where("n_removed > 0").count() == 48
    near = {n for _, n in sent[0]}
    assert len(near) == 6 and len(set(sent[0])) <= 6 + 4  # a range may be cut in two


def test_segments_of_near_copies_are_sent_once_over():
    parts = [bytes(np.random.default_rng(k % 50).integers(0, 256, 600, np.uint8)) for k in range(400)]
    near = [part[: 40 + k % 300] + b"!" + part[41 + k % 300 :] for k, part in enumerate(parts)]
    for own in ([], [b"a"], near):
        sent = suffix_dedup.packed(own)
        assert suffix_dedup.unpacked(sent, sum(map(len, own))) == b"".join(own)
    assert len(sent) < sum(map(len, near)) / 4


def test_columns_of_the_caller_stay_as_they_are(spark):
    rows = [(1, "a b " * 300, "mine", "r", 5), (2, "a b " * 300, "too", None, 6), (3, None, None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, row string, t1 long")
    cut = sorted(map(tuple, suffix_dedup.without_repeats(docs, words=True).collect()))
    assert cut == [(1, "", "mine", "r", 5), (2, "", "too", None, 6), (3, None, None, "x", 7)]


def test_repeated_strings_of_all_windows(spark, sf_dir, texts, odd, none, odd_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 9000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 30_000)
    rows = [(d, t) for d, t in odd_rows if len(t or "") < 30_000]
    small = odd.where("text IS NULL OR length(text) < 30000")
    for docs, rows in ((small, rows), (spark.read.parquet(f"{sf_dir}/documents.parquet"), list(texts.items()))):
        got = suffix_dedup.digests(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert Counter(tuple(r) for r in got) == removed_by_hand(rows)
    assert suffix_dedup.digests(none).count() == 0
    cut = suffix_dedup.without_repeats(odd)
    assert sorted(cut.columns) == sorted(odd.columns) and cut.count() == len(odd_rows)
    by_id = {r.doc_id: r.text for r in cut.where("doc_id IN (1, 20, 30, 4)").collect()}
    assert by_id[1] is None and by_id[20] == "" and by_id[4] == "a" and 0 < len(by_id[30]) < len(dict(odd_rows)[30])


def test_pipeline_cuts_a_short_passage_of_51_words(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1500)
    rng = np.random.default_rng(8)
    words = lambda n, size: [bytes(rng.integers(97, 123, size).astype(np.uint8)).decode() for _ in range(n)]
    passage, short, own = " ".join(words(51, 5)), " ".join(words(49, 5)), [words(300, 6) for _ in range(4)]
    assert len(passage.encode()) < 320
    mixed = lambda k, part: " ".join([*own[k][:150], part, *own[k][150:]])
    rows = [(1, mixed(0, passage)), (2, mixed(1, passage.upper().replace(" ", "\n"))), (3, mixed(2, short)), (4, mixed(3, short)), (5, None), (6, passage)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    cut = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()}
    assert cut == {1: mixed(0, ""), 2: mixed(1, ""), 3: rows[2][1], 4: rows[3][1], 5: None, 6: ""}
    by_bytes = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs).collect()}
    assert by_bytes == dict(rows)


def test_suffix_sort_orders_by_content():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    at, group = rng.integers(40, 3900, 600), rng.integers(0, 9, 600).astype(np.uint64)
    for back in (False, True):
        lengths = rng.integers(0, 40, 600)
        order, common = suffix_dedup.order_with_extensions(data, at, lengths, group, back)
        text = [data[a - n : a][::-1].tobytes() if back else data[a : a + n].tobytes() for a, n in zip(at, lengths, strict=True)]
        keys = [(group[k], text[k]) for k in order]
        assert keys == sorted(keys) and sorted(order) == list(range(600))
        for k in range(1, 600):
            (g, a), (h, b) = keys[k - 1], keys[k]
            same = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[k] == (same if g == h else -1)


def test_a_collision_of_hashes_is_found_and_sorted_again(monkeypatch):
    real = suffix_dedup._numbers
    monkeypatch.setattr(suffix_dedup, "_numbers", lambda seed: np.full(256, 5, np.uint64) if seed == 11 else real(seed))
    data = np.frombuffer(b"abcabdabe", np.uint8)
    order, common = suffix_dedup.order_with_extensions(data, np.array([6, 3, 0]), np.array([3, 3, 3]), np.zeros(3, np.uint64), False)
    assert order.tolist() == [2, 1, 0] and common.tolist() == [-1, 2, 2]


def weighted_jaccard(a, b):
    x, y = Counter(words_of(a)), Counter(words_of(b))
    return sum((x & y).values()) / max(sum((x | y).values()), 1)


def test_fingerprints_estimate_weighted_jaccard(spark, sf_dir, texts):
    rows = queries.op10_weighted_fingerprints(spark, sf_dir).collect()
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    errors, prints = [], {}
    for r in rows:
        text, following = texts[r.doc_id] or "", texts[after[r.doc_id]] or ""
        changed = weighted_fingerprints.edited(text, following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        errors += [r.near_edited - weighted_jaccard(text, changed), r.near_next - weighted_jaccard(text, following)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_fingerprints_of_odd_rows(spark, odd, none, odd_rows):
    rows = weighted_fingerprints.compared_with_edits(odd).collect()
    hashed = odd.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS t").collect()
    order = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.t), reverse=True)]
    want = Counter()
    for (d, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        changed = weighted_fingerprints.edited(t or "", following or "")
        want[d, len(t or ""), hashlib.sha256(changed.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert all(r.fingerprint == "" for r in rows if r.doc_id in (1, 2, 3))
    assert weighted_fingerprints.compared_with_edits(none).count() == 0
    alone = weighted_fingerprints.compared_with_edits(spark.createDataFrame([(1, "one two")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert weighted_fingerprints.fingerprinted(odd).count() == len(odd_rows)
