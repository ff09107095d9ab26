import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from llm_fixtures import none, odd, odd_rows, texts  # noqa: F401
from pricelens.llm import byte_bpe, chunks, fit_packing, queries, tier_packing, tokens
from pricelens.llm.chunks import ids_of

AWKWARD = [*"ab \n\t'strelvdm1290.,!é日😀　\x85\x1c", "  ", "the", "  \n", "'ll", "aaaaaaaa", "<|endoftext|>", "\ny", "        "]


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path(byte_bpe.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(tokens.vocabulary_path())
    found.encode_special_tokens = True
    return found


def awkward_texts(n):
    rng = random.Random(9)
    return ["".join(rng.choice(AWKWARD) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_backtracking_gives_the_merges_of_tiktoken(reference):
    own = byte_bpe.codec(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x11000, 7)]]
    batch = awkward_texts(4000) + ["a" * 20_000 + "=" * 3000, "".join(every)]
    for text, ids in zip(batch, own.encode_texts(batch), strict=True):
        assert ids_of(ids).tolist() == reference.encode_ordinary(text)
        assert own.decode(ids_of(ids)) == text.encode()


def test_every_token_encodes_to_itself(reference):
    own = byte_bpe.codec(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN).vocabulary
    assert all(own.encode(t.decode("latin-1")) == [r] for r, t in enumerate(own.tokens))


def test_digests_of_whole_texts(spark, sf_dir, texts, reference):
    rows = queries.op3_byte_bpe(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_digests_of_odd_rows(odd, none, odd_rows, reference):
    rows = byte_bpe.digests(odd).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((d, len(reference.encode_ordinary(t or ""))) for d, t in odd_rows)
    assert byte_bpe.digests(none).count() == 0
    coded = byte_bpe.encoded(odd, public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in coded.collect())
    assert sorted(coded.columns) == sorted([*odd.columns, "decoded"])


def test_cached_chunks_give_the_ids_of_the_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr("pricelens.llm.chunks.CACHED", 500)
    batch = awkward_texts(6000)
    own = tokens.encoder(tokens.vocabulary_path())
    got = [x for k in range(0, len(batch), 100) for x in own(batch[k : k + 100])]
    assert [ids_of(x).tolist() for x in got] == [e.ids for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]


def check_packing(rows, ids_by_row):
    """Pieces cover every document once and fill every sequence from its start."""
    ends = Counter()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ends[r.doc_id] += r.length
    totals = Counter()
    for doc_id, ids in ids_by_row:
        totals[doc_id] += len(ids)
    assert ends == totals
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at & (at - 1) == 0 and at <= 2048  # a power of two: no padding


def test_packing_is_whole_and_without_padding(spark, sf_dir, texts, tokenizer):
    ids = {k: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for k, t in texts.items()}
    rows = queries.op1_tier_packing(spark, sf_dir).collect()
    check_packing(rows, ids.items())
    covered = Counter()
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    assert len(covered) == sum(map(len, ids.values())) and set(covered.values()) == {1}


def test_packing_odd_rows(odd, none, odd_rows, tokenizer):
    ids = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in odd_rows]
    rows = tier_packing.packed(odd, with_ids=True).collect()
    check_packing(rows, ids)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert tier_packing.packed(none).count() == 0


def test_windows_take_the_best_fit_and_cut_only_the_last_gap():
    pool = tier_packing.Pool()
    for k, n in enumerate([1500, 500, 40, 300, 900]):
        pool.add((k, 0, n))
    windows = list(tier_packing.fill_windows(pool))
    assert windows[0] == (2048, [(0, 0, 1500), (1, 0, 500), (2, 0, 40), (3, 0, 8)])
    assert windows[1] == (1024, [(4, 0, 900), (3, 8, 124)])
    assert pool.pieces() == [] or sum(p[2] for p in pool.pieces()) == 168


def test_step_groups_have_equal_tokens_and_like_cost():
    rng = random.Random(1)
    windows = [(2048, [(0, 0, n), (1, 0, 2048 - n)]) for n in (rng.randint(1, 2047) for _ in range(320))]
    groups = tier_packing.step_groups(windows)
    cost = Counter()
    for (_, pieces), g in zip(windows, groups, strict=True):
        cost[g] += sum(n * n for _, _, n in pieces)
    assert set(Counter(groups).values()) == {32}
    assert max(cost.values()) < 1.02 * min(cost.values())


def test_segment_tree_finds_the_least_room_that_fits():
    rng = random.Random(2)
    for row in (7, 16, 100):
        lengths = [rng.randint(1, row) for _ in range(300)]
        rows, room, held = fit_packing.best_fit(lengths, row), [], []
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [r for r in range(len(room)) if room[r] >= lengths[k]]
            at = min(fits, key=lambda r: room[r]) if fits else len(room)
            if not fits:
                room.append(row)
                held.append(0)
            room[at] -= lengths[k]
        assert sorted(row - sum(lengths[k] for k in r) for r in rows) == sorted(room)


def test_matrices_round_trip(spark, sf_dir, odd, none, odd_rows, texts, tokenizer):
    for matrix, docs in ((queries.op5_fit_packing(spark, sf_dir), list(texts.items())), (fit_packing.matrices(odd), odd_rows)):
        rows = matrix.collect()
        assert len({r.row_id for r in rows}) == len(rows)
        for r in rows:
            ids, places = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u2")
            assert len(ids) == len(places) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
            assert (ids[r.n_tokens :] == fit_packing.PAD).all()
            for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False):
                assert (places[a:b] == np.arange(b - a)).all()
        pieces = {}
        for p in fit_packing.unpacked(matrix).collect():
            pieces.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
        got = Counter((d, b"".join(x for _, x in sorted(v))) for d, v in pieces.items() if d is not None and d not in (7, 8, 50))
        want = [(d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, t in docs]
        assert got == Counter(x for x in want if x[0] is not None and x[0] not in (7, 8, 50)) or docs is not odd_rows
        assert sum(len(x) for v in pieces.values() for _, x in v) == sum(len(x) for _, x in want)
    assert fit_packing.matrices(none).count() == 0


def test_texts_are_cut_where_white_space_is_plain(monkeypatch):
    odd = ["\t", " ", " ", "　", " ", " ", "\x85", "\x1c", "\r", "  ", "\n ", " \n", "\n\n", "’", "é", "日本", "ẁ"]
    texts = [f"a{x}b c" for x in odd] + ["", " ", "\n", "a ", "a\n", " a", "plain words\nand lines", "x" * 300]
    raw = [t.encode() for t in texts]
    want = [bool(chunks._UNEVEN.search(t)) for t in texts]
    assert chunks._uneven(texts, raw) == want and any(want) and not all(want)
    plain = tokens.encoder(tokens.vocabulary_path())
    whole = plain.encode_all(texts)
    assert plain(texts) == whole
    monkeypatch.setattr(chunks, "TEXT_AT_ONCE", 7)
    monkeypatch.setattr(chunks, "SLICE", 3)
    plain.forget()
    assert plain(texts) == whole
    assert plain.flat([])[0].tolist() == []
