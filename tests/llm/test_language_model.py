import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import log_bilinear as L
from strandloom.llm import queries as Q
from tests.llm.conftest import EDGE


def _tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def _base(rows):
    """Brute force of all but the model's score."""
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter(t for i, text in rows if not held(i) for t in _tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text in rows:
        own = _tokens(text)
        out.append((i, held(i), len(own), sum(c[t] > 0 for t in own), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own)))
    return out


def _same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 3))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


@pytest.mark.parametrize("common", [2, 64, L.COMMON])
def test_base_equals_brute_force(edge, common):
    rows = L.language_model(edge, common=common).collect()
    _same([tuple(r)[:6] for r in rows], _base([r[:2] for r in EDGE]))
    assert all(r.score < 0 for r in rows)


def test_query_equals_brute_force_and_beats_the_base(spark, data, sample):
    got = Q.op12_language_model(spark, f"{data}/sf0.001")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    _same([tuple(r)[:6] for r in rows], _base([(r.doc_id, r.text) for r in sample.collect()]))
    held = [r for r in rows if r.held_out]
    assert len(held) > 15 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_and_untrained(spark, empty, edge):
    assert L.language_model(empty).collect() == []
    held = edge.where(L.is_held_out())
    rows = L.language_model(held).collect()
    assert len(rows) == held.count() and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)


def test_probabilities_add_up(spark, sample):
    """All known words and one unknown of each kind, after some contexts, have probability one."""
    docs = sample.limit(20)
    counts = L.count_words(docs)
    voc = L.Vocabulary.of(counts, shortlist=30, common=500)
    net = L.train(L.encode(docs, voc), voc)
    normal = L.Normaliser(net)
    words = [(r.word.encode(), r.n) for r in counts.collect() if r.word is not None]
    place, out, _ = voc.encode([w for w, _ in words])
    share = np.zeros(len(words))
    kinds = out - voc.end - 1
    own = kinds >= 0
    n = np.array([n for _, n in words])
    share[own] = np.log((n[own] + 1) / (voc.kind_tokens + voc.kind_words + 1)[kinds[own]])
    for one, two in ((voc.outputs, voc.outputs), (3, voc.end), (voc.end + 5, 7)):
        at = lambda w: (np.full(len(w), one), np.full(len(w), two), w)
        known = np.exp(normal.log_probabilities(*at(out)) + share).sum()
        unknown = np.exp(normal.log_probabilities(*at(np.arange(L.KINDS) + voc.end + 1)) - np.log(voc.kind_tokens + voc.kind_words + 1)).sum()
        end = np.exp(normal.log_probabilities(*at(np.array([voc.end]))))[0]
        assert known + unknown + end == pytest.approx(1, abs=1e-4)


def test_score_is_the_sum_of_token_probabilities(spark, sample):
    docs = sample.limit(12)
    counts = L.count_words(docs)
    voc = L.Vocabulary.of(counts, shortlist=40, common=100)  # words beyond the common ones are joined
    encoded = L.encode(docs, voc)
    net = L.train(encoded, voc)
    c = {r.word: r.n for r in counts.collect()}
    got = {r.doc_id: r.score for r in L.score(encoded, counts, voc, net).collect()}
    normal = L.Normaliser(net)
    for r in docs.collect():
        words = [w for part in L.words_of(r.text.encode()) for w in part]
        _, out, _ = voc.encode(words)
        lp = normal.log_probabilities(*L.contexts([np.append(out, voc.end)], voc.outputs))
        want = lp.sum() / math.log(10)
        for w, o in zip(words, out, strict=True):
            if o > voc.end:
                k = o - voc.end - 1
                want += math.log10((c.get(w.decode(), 0) + 1) / (voc.kind_tokens[k] + voc.kind_words[k] + 1))
        assert got[r.doc_id] == pytest.approx(want, rel=1e-6)


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    unigram = rng.random(9) + 0.1
    net = L.LogBilinear.fresh(unigram / unigram.sum(), width=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    one, two, w, noise = rng.integers(0, 10, 20), rng.integers(0, 10, 20), rng.integers(0, 9, 20), np.array([1, 4, 7])
    g = net.gradients(one, two, w, noise)
    for k, (at, rows) in g.items():
        for i, row in zip(at[:4], rows[:4], strict=True):
            for j in range(np.size(row)):
                where = (i, j) if np.ndim(row) else (i,)
                keep, losses = net.p[k][where], []
                for e in (1e-6, -1e-6):
                    net.p[k][where] = keep + e
                    losses.append(net.loss(one, two, w, noise))
                net.p[k][where] = keep
                assert (losses[0] - losses[1]) / 2e-6 == pytest.approx(np.ravel(row)[j], rel=1e-4, abs=1e-8)


def test_words_are_whole_at_any_size():
    raw = "The  QUICK\tbrown Éclair\n\x0bfox ".encode() * 50
    want = [w for part in L.words_of(raw, 1 << 30) for w in part]
    assert [w for part in L.words_of(raw, 7) for w in part] == want and want[1] == b"quick" and want[3] == "Éclair".encode()
    assert L.words_of(b"x" * 100, 10).__next__() == [b"x" * 100]
    kinds = L.kinds_of([b"a", "é".encode(), b"xa"])
    assert kinds[0] == kinds[2] == 1 and kinds[1] >= 16
