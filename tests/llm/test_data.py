import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strandloom.llm import mixing as M
from strandloom.llm import packing as K
from strandloom.llm.common import identified
from strandloom.llm.topk import build_tree, exact_topk, quantised, search_tree, usable

# ---- mixing


def test_targets():
    assert M.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    t = M.targets([10, 1000, 0, 50], [5, 2, 1, 5])
    assert sum(t) == pytest.approx(1590) and t[0] == 20 and t[2] == 0 and all(a <= 2 * b + 1e-9 for a, b in zip(t, [10, 1000, 0, 50], strict=True))
    assert M.targets([], []) == []


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        j = np.arange(n)
        p = M.permute(j, np.full(n, n), np.full(n, 99))
        assert sorted(p) == list(j)
    assert (M.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)) != M.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 2))).mean() > 0.9


def test_shard_counts():
    want = [5000, 1700, 3, 0, 900]
    c = M.shard_counts(want, 512, 1)
    assert c.sum(axis=0).tolist() == want and (c.sum(axis=1)[:-1] == 512).all() and (c >= 0).all()
    assert M.shard_counts([0], 10, 1).shape == (0, 1)


def _words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("block", [16, 128])
def test_mix(sample, edge, empty, block):
    for df in (sample, edge):
        mix = M.mix_sources(df, block_words=block, shard_slots=64)
        rows = M.taken_words(mix).collect()
        text = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            text[r.doc_id].append(_words(r.text))
        assert len(rows) == df.count()
        for r in rows:
            assert r["size"] in text[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        again = M.taken_words(M.mix_sources(df, block_words=block, shard_slots=64)).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
    assert M.taken_words(M.mix_sources(empty)).count() == 0


def test_mix_takes_the_words_of_its_slots(sample):
    """Blocks, slots and words once more, one after another."""
    block = 16
    mix = M.mix_sources(sample, block_words=block, shard_slots=100, seed=3)
    rows = {r.s: [] for r in mix.sources.collect()}
    for r in mix.sizes.collect():
        rows[r.s].append(r)
    sizes = [sum(r["size"] for r in rows[s]) for s in sorted(rows)]
    want = M.targets(sizes, [(5, 2, 1)[s % 3] for s in sorted(rows)])
    taken = defaultdict(int)
    for s, (n, t) in enumerate(zip(sizes, want, strict=True)):
        words = [None] * n
        for r in rows[s]:
            assert words[r["at"] : r["at"] + r["size"]] == [None] * r["size"]
            words[r["at"] : r["at"] + r["size"]] = [r.row_id] * r["size"]
        assert None not in words
        blocks = -(-n // block)
        full = 2 * blocks if t >= 2 * n - 1e-6 else int(t * blocks / n)
        rest = round(t - full * n / blocks) if full < 2 * blocks else 0
        j = np.arange(full + (rest > 0))
        at = M.permute(j % blocks, np.full(len(j), blocks), s * 1000003 + j // blocks + 3 * 7919)
        for k, b in zip(j.tolist(), at.tolist(), strict=True):
            size = rest if rest and k == len(j) - 1 else block
            for w in words[b * block : b * block + size][: block if size == block else size]:
                taken[w] += 1
    got = {r.row_id: r.taken for r in M.taken_words(mix).collect()}
    assert got == {r.row_id: taken[r.row_id] for own in rows.values() for r in own}
    slots = mix.pieces.select("shard", "slot").distinct().groupBy("shard").count().collect()
    assert len(slots) > 5 and max(r["count"] for r in slots) <= 100


def test_mix_near_target(sample):
    rows = M.taken_words(M.mix_sources(sample)).join(sample.select("doc_id", "source"), "doc_id").collect()
    got, want = defaultdict(int), {}
    for r in rows:
        got[r.source] += r.taken
        want[r.source] = r.target
    assert all(abs(got[s] - want[s]) <= 2 * M.BLOCK_WORDS for s in want)


def test_mixed_documents_have_the_taken_words(sample, edge):
    for df in (sample, edge):
        numbered, row = identified(df)
        mix = M.mix_sources(numbered, row=row)
        out = M.mixed_documents(numbered, mix, row)
        assert out.columns == df.columns
        taken = defaultdict(int)
        for r in M.taken_words(mix).collect():
            taken[r.doc_id] += r.taken
        got = defaultdict(int)
        for r in out.collect():
            got[r.doc_id] += _words(r.text)
            assert r.n_chars == len(r.text)
        assert {k: v for k, v in taken.items() if v} == dict(got)


# ---- packing


def test_piece_lengths():
    assert K.piece_lengths(13, 8) == [8, 4, 1] and K.piece_lengths(16, 8) == [8, 8] and K.piece_lengths(0) == []


def test_tokens_equal_the_tokenizer(sample):
    w = K.WordTokens(K.default_tokenizer())
    rng = random.Random(4)
    odd = ["Ünï ÇÖDE", "don't we'RE 's", "a <|endoftext|> b<|startoftext|>", "a\x0bb\x0cc\x1cd", "ΑΣ ΣΊΣΥΦΟΣ İstanbul", "été", "１２３ ½ ²", "  x　y", "\U0001f44d\U0001f3fd ok", "ß ẞ ÿ Ÿ × ÷ µ ª º", "", " \n"]
    odd += ["".join(rng.choice("aé ß'<|>.\n\tÅ9ñ½Σ́") for _ in range(30)) for _ in range(1500)]
    for text in odd + [r.text for r in sample.select("text").collect()]:
        want = w.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(w.ids(text), "<u4").tolist() == want, text


def test_pack_round_trip(sample, edge, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(K.default_tokenizer())
    for df in (sample, edge):
        rows = K.pack_pow2(df, keep_ids=True).collect()
        text = {r.rid: r.text for r in df.select(K.row_id().alias("rid"), "text").collect()}
        docs = defaultdict(list)
        for r in sorted(rows, key=lambda r: (r.row_id, r.start)):
            assert r.length <= 4096 and r.length & (r.length - 1) == 0 and r.offset == 0
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
            assert r.start == sum(p.length for p in docs[r.row_id])
            docs[r.row_id].append(r)
        assert set(docs) == set(text)
        for rid, pieces in docs.items():
            ids = np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist()
            assert ids == [*tok.encode(text[rid] or "", add_special_tokens=False).ids, 2] and pieces[0].doc_tokens == len(ids)
        order = sorted(rows, key=lambda r: r.sequence_id)
        assert [r.sequence_id for r in order] == list(range(len(rows))) and [r.length for r in order] == sorted(r.length for r in rows)
    assert K.pack_pow2(empty).count() == 0


# ---- top-k


def _brute(ids, x, queries, k):
    out = []
    for q, v in queries:
        s = sorted(((-int(np.dot(v.astype(object), row.astype(object))), i) for i, row in zip(ids, x, strict=True) if i != q))[:k]
        out += [(q, n + 1, i, -sc) for n, (sc, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("scale", [3, 1000, 1 << 27])
def test_ball_tree_is_exact(scale):
    rng = np.random.default_rng(scale)
    x = rng.integers(-scale, scale, (300, 6))
    ids = rng.permutation(300)
    q = rng.integers(-scale, scale, (20, 6))
    got = defaultdict(list)
    for qid, vid, s in search_tree(build_tree(ids, x, 8), np.arange(20), q, [None] * 20, 7):
        got[qid].append((-s, vid))
    want = _brute(ids.tolist(), x, list(enumerate(q)), 7)
    assert sorted((a, n + 1, v, -s) for a, r in got.items() for n, (s, v) in enumerate(sorted(r))) == want


def test_topk_shards_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(v) for v in rng.integers(-3, 4, 4) / 4]) for i in range(230)]
    bad = [(300, None), (400, [1.0, None, 2.0, 0.0]), (500, [1.0, float("nan"), 0.0, 0.0]), (600, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (700, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1, "x") for r in [*rows, *bad]], "vec_id long, embedding array<float>, score int, shard string")
    use = df.where(usable("embedding")).select("vec_id", quantised("embedding").alias("vector"))
    got = exact_topk(use, use.where("vec_id % 10 = 0"), k=5, shard_rows=40, block_rows=7)
    full = [*rows, (700, [0.5, 0.5, 0.0, 0.0])]
    ids, x = [r[0] for r in full], np.array([[math.floor(1024 * np.float32(v)) for v in r[1]] for r in full])
    assert sorted(map(tuple, got.collect())) == _brute(ids, x, [(i, v) for i, v in zip(ids, x, strict=True) if i % 10 == 0], 5)
    assert exact_topk(use.where("false"), use).count() == 0 and exact_topk(use, use.where("false")).count() == 0


def test_topk_cells_and_repeated_ids(spark):
    rng = np.random.default_rng(11)
    centres = rng.integers(-40, 40, (12, 5))
    x = centres[rng.integers(0, 12, 400)] + rng.integers(-2, 3, (400, 5))
    ids = np.concatenate((np.arange(380), rng.integers(0, 380, 20)))  # some candidates twice
    rows = [(int(i), [int(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    ask = df.where("vec_id % 7 = 0")
    queries = {}
    for i, v in rows:
        if i % 7 == 0:
            queries[i] = max(queries.get(i, v), v)
    want = _brute([i for i, _ in rows], x, [(i, np.array(v)) for i, v in queries.items()], 6)
    for cells, shard in ((16, 25), (1, 1000), (3, 60)):
        got = exact_topk(df, ask, k=6, shard_rows=shard, block_rows=5, cells=cells)
        assert sorted(map(tuple, got.collect())) == want


def test_topk_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id long, vector array<long>")
    assert [tuple(r) for r in exact_topk(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 11)]
