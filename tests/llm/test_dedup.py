import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import simhash as S
from strandloom.llm import suffix_dedup as X
from strandloom.llm.common import row_id
from strandloom.llm.components import connected_components
from strandloom.llm.exact_dedup import exact_dedup, misra_gries
from strandloom.llm.substring_dedup import substring_dedup, units
from strandloom.llm.suffix_dedup import bare_windows, parse, remove_repeats, windows
from tests.llm.conftest import EDGE, LONG


# ---- exact


def _exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    best = {t: max(g, key=lambda d: (d is not None, d or 0)) for t, g in groups.items()}
    return sorted(((str(d), str(best[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode("utf-8")).hexdigest()) for d, t in rows))


def test_exact_edge(edge):
    got = exact_dedup(edge, counters=2).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == _exact([(r[0], r[1]) for r in EDGE])
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r[1] or "" for r in EDGE})


def test_exact_sample_and_empty(sample, empty):
    rows = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    got = exact_dedup(sample).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == _exact(rows)
    assert exact_dedup(empty).count() == 0


def test_misra_gries_finds_every_frequent_key(spark):
    rng = random.Random(1)
    keys = [rng.choice(["hot"] * 5 + ["warm"] * 2 + [f"k{i}" for i in range(400)]) if rng.random() < 0.3 else rng.choice(["hot", "warm", f"x{rng.random()}"]) for _ in range(4000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5).withColumn("row_id", row_id())
    found = {r.k: r.estimate for r in misra_gries(df, "k", counters=9, block_rows=256).collect()}
    true = Counter(keys)
    assert len(found) <= 9 and all(k in found for k, n in true.items() if n > len(keys) / 10)
    assert all(found[k] <= true[k] for k in found)


# ---- substring


def test_units_cover_the_text_and_resync():
    text = "One two. Three four five six seven eight nine ten. Short.\nLine two is here and it has some more words. Tail"
    u = list(units(text))
    assert [i for i, _ in u] == [0, *[j for _, j in u[:-1]]] and u[-1][1] == len(text)
    shared = "This is a sentence with at least eight words in it. And one more long sentence that is the same everywhere."
    a, b = ({f"{p}{shared}"[i:j].strip() for i, j in units(f"{p}{shared}")} for p in ("Hi. ", "Some other beginning that is long enough to be alone. No. "))
    assert len(a & b) >= 1


def test_substring_against_brute_force(sample, edge, empty):
    for df in (sample, edge):
        rows = df.select("doc_id", "text").collect()
        got = substring_dedup(df).collect()
        first = {}
        for doc, rid, text in sorted(((r.doc_id, r.row_id, None) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            first.setdefault((doc, rid), text)
        texts = {r.row_id: None for r in got}
        with_id = df.select(row_id().alias("rid"), "doc_id", "text").collect()  # as written: no task splits a file here
        texts = {r.rid: (r.doc_id, r.text or "") for r in with_id}
        seen, want = set(), {}
        for rid, (doc, text) in sorted(texts.items(), key=lambda kv: (kv[1][0] is None, kv[1][0] or 0, kv[0])):
            spans = []
            for i, j in units(text):
                words = text[i:j].casefold().split()
                if len(words) >= 8:
                    if tuple(words) in seen:
                        spans.append((i, j))
                    seen.add(tuple(words))
            want[rid] = spans
        assert len(got) == len(rows)
        for r in got:
            assert [(s.i, s.j) for s in r.spans or []] == want[r.row_id]
            text, at, kept = texts[r.row_id][1], 0, ""
            for i, j in want[r.row_id]:
                kept, at = kept + text[at:i], j
            assert r.kept_text == kept + text[at:]
    assert substring_dedup(empty).count() == 0


def test_substring_runs_inside_long_lines(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: " ".join(word() for _ in range(n))
    texts = []
    for _ in range(40):
        passage = some(50)
        texts += [f"{some(30)} {passage} {some(30)}", f"{some(41)} {passage} {some(22)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in substring_dedup(df, whole=True).collect()}
    for k in range(0, len(texts), 2):
        shared = set(texts[k].split()) & set(texts[k + 1].split())
        gone = [texts[k + 1][s.i : s.j].split() for s in got[k + 1].spans]
        assert got[k].spans is None and len(gone) == 1 and len(gone[0]) >= 16 and set(gone[0]) <= shared
        assert got[k + 1].kept_text.split() == [w for w in texts[k + 1].split() if w not in gone[0]]


def test_substring_removes_short_lines_again(spark):
    line = "Released under the MIT license.\n"
    df = spark.createDataFrame([(i, f"{line}text {i}\n\nlast {i} {line}") for i in range(4)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in substring_dedup(df, whole=True).collect()}
    assert got[0].spans is None and all([(s.i, s.j) for s in got[i].spans] == [(0, len(line))] for i in (1, 2, 3))


# ---- suffix


def _brute(texts, least):
    count = Counter(t[p : p + least] for t in texts for p in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - least + 1):
            if count[t[p : p + least]] > 1:
                gone[p : p + least] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def _check_suffix(spark, texts, tmp, **more):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.mode("overwrite").parquet(str(tmp))
    got = remove_repeats(spark.read.parquet(str(tmp)), **more).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == _brute([(t or "").encode() for t in texts], 400)


def _hard_texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    passage = [" ".join(word() for _ in range(n)) for n in (70, 90, 130, 260)]
    texts = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 120)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage).split()
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = word()
            parts += [" ".join(p), " ".join(word() for _ in range(rng.randint(0, 30)))]
        texts.append(" ".join(parts))
    # low entropy, periods, exact limits, same text twice, overlaps inside one text
    block = "".join(rng.choice("xyz") for _ in range(400))
    return texts + ["a" * 399, "a" * 400, "a" * 1000, "ab" * 500, "abc" * 300 + "q", texts[0], None, "", block, "0" + block, block + block[:200], "a" * 401 + "b"]


def test_suffix_against_brute_force(spark, tmp_path):
    texts = _hard_texts()
    _check_suffix(spark, texts, tmp_path / "t")


def test_suffix_hot_symbols_are_dealt_by_more_symbols(spark, tmp_path):
    for hot in (1, 2, 7):
        _check_suffix(spark, _hard_texts(), tmp_path / "t", hot_rows=hot)


def test_suffix_sample_against_brute_force(sample):
    got = remove_repeats(sample).orderBy("doc_id").collect()
    texts = [(r.text or "").encode() for r in sample.orderBy("doc_id").collect()]
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == _brute(texts, 400)


def test_interleave_of_sorted_runs():
    rng = np.random.default_rng(3)
    for _ in range(50):
        m, width = int(rng.integers(1, 60)), 4
        rows = sorted((int(rng.integers(0, 4)), tuple(rng.integers(0, 3, width).tolist())) for _ in range(m))
        shard, table = np.array([s for s, _ in rows]), np.zeros((m, width, 2), np.uint64)
        table[:, :, 0] = [t for _, t in rows]
        order, block = np.arange(m), np.zeros(m, np.int64)
        for d in range(width):
            order, block = X._refine(order, block, shard, table[:, d])
            want = sorted(range(m), key=lambda i: (rows[i][1][: d + 1], i))
            assert order.tolist() == want
            assert [len({block[i] for i in range(m) if rows[order[i]][1][: d + 1] == p}) for p in {t[: d + 1] for _, t in rows}] == [1] * (block[-1] + 1)


def test_distinct_keys_with_equal_halves():
    wide, small = np.array([5, 5, 1, 5, 1], np.uint64), np.array([2, 1, 0, 2, 0], np.uint32)
    a, b, n, place = X.distinct_keys(wide, small)
    assert a.tolist() == [1, 5, 5] and b.tolist() == [0, 1, 2] and n.tolist() == [2, 1, 2] and place.tolist() == [2, 1, 0, 2, 0]
    assert [len(x) for x in X.distinct_keys(wide[:0], small[:0])] == [0] * 4


def test_suffix_edge_and_empty(edge, empty):
    got = {(r.doc_id, r.n_bytes): r for r in remove_repeats(edge).collect()}
    assert got[(6, len(LONG))].n_removed == got[(7, len(LONG))].n_removed == len(LONG)
    assert got[(1, 0)].n_removed == 0 and got[(1, 0)].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert len(remove_repeats(edge).collect()) == len(EDGE) and remove_repeats(empty).count() == 0


def test_every_window_is_in_exactly_one_class():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (400, 401, 900, 5000)] + [b"a" * 900]
    for text, anchors in zip(texts, parse(texts), strict=True):
        seen = Counter()
        for i, j in bare_windows(len(text), anchors, 400):
            seen.update(range(i, j + 1))
        for f in range(len(anchors)):
            for _, i, j in windows(len(text), anchors.tolist(), f, 400):
                seen.update(range(i, j + 1))
        assert seen == Counter(range(len(text) - 399))


# ---- near


def _fingerprint(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(words, len(w))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def _components(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_simhash_against_brute_force(sample, edge, empty):
    for df in (sample, edge):
        got = S.simhash_components(df, words=4).collect()
        text = {r.rid: r.text for r in df.select(row_id().alias("rid"), "text").collect()}
        rows = sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.row_id))
        fps = [_fingerprint(text[r.row_id], 4) for r in rows]
        assert [r.fp & (1 << 64) - 1 for r in rows] == fps
        root = _components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
        assert [r.component_id for r in rows] == [rows[k].doc_id for k in root]
        assert sum(r.first for r in rows) == len(set(root))
    assert S.simhash_components(empty).count() == 0


def test_fingerprint_equals_sparks_hash(spark):
    text = "Ünï One two\tthree four five"
    h = spark.range(1).select(F.xxhash64(F.lit("Ünï one two three"))).first()[0] & (1 << 64) - 1
    assert S.fingerprint("Ünï One two\tthree", 4) == h
    assert S.fingerprint(text, 4) == _fingerprint(text, 4)


def test_bk_tree_and_blocks(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(8)})
    tree = S.BKTree()
    for x in fps:
        tree.add(x)
    for x in fps[:80]:
        assert sorted(tree.within(x, 4)) == sorted(y for y in fps if (x ^ y).bit_count() <= 4)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").withColumn("view", F.lit(0))
    want = _components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for bands, rows in ((5, 4096), (5, 3), (6, 5)):
        links = S.near_links(df, 4, shard_rows=rows, bands=bands).collect()
        at = {x: i for i, x in enumerate(fps)}
        got = [(at[r.a & (1 << 64) - 1], at[r.b & (1 << 64) - 1]) for r in links]
        assert all((fps[i] ^ fps[j]).bit_count() <= 4 for i, j in got)
        assert _components(len(fps), got) == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    want = _components(400, edges)
    for small in (0, 60, 100_000):  # shuffled, shuffled until few are left, in one task
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "x long, y long"), small=small).collect()}
        assert got == {i: want[i] for e in edges for i in e if e[0] != e[1]}
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_near_duplicates_by_shingles(spark, edge, empty, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(300)]
        close, far = base[:], base[:]
        close[150] = word()  # five of about 300 shingles
        for k in range(0, 300, 12):
            far[k] = word()
        texts += [" ".join(base), " ".join(close), " ".join(far)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = {r.doc_id: r for r in S.near_duplicates(spark.read.parquet(str(tmp_path / "t"))).collect()}
    for i in range(0, 75, 3):
        assert got[i].component_id == got[i + 1].component_id == i and got[i].first and not got[i + 1].first
        assert got[i + 2].component_id == i + 2 and got[i + 2].first
    rows = S.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE) and {r.component_id for r in rows if r.doc_id in (4, 5)} == {4} and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert S.near_duplicates(empty).count() == 0


def test_histograms_never_drop_a_near_pair():
    rng = np.random.default_rng(9)
    dropped = 0
    for _ in range(400):
        n = int(rng.integers(1, 900))
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        sets = [np.unique(np.concatenate((both, rng.integers(0, 1 << 63, int(rng.integers(0, n // 2 + 2)), dtype=np.uint64)))) for _ in range(2)]
        near = S.jaccard(*sets) >= 0.8
        may = S.may_be_near(*map(S.histogram, sets), *map(len, sets), 0.8)
        assert may or not near
        dropped += not may
    assert dropped > 100 and S.may_be_near(b"", b"", 0, 0, 0.8) and not S.may_be_near(b"", b"\1\0", 0, 1, 0.8)


def _near_roots(spark, texts, path):
    """Near-copy groups as found, and by comparing all shingle sets with all."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(path))
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.read.parquet(str(path))).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    want = _components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    return [got[i] for i in range(len(texts))], want


def test_near_copies_behind_a_far_text_of_equal_words(spark, tmp_path):
    rng = random.Random(21)
    texts = []
    for g in range(8):  # one set of words in every group, so one fingerprint in every view
        words = [f"g{g}w{i}" for i in range(80)]
        first, second = rng.sample(words, 80), rng.sample(words, 80)
        third = second[:]
        third[-1], third[-2] = third[-2], third[-1]
        texts += [" ".join(first), " ".join(second), " ".join(third)]
    got, want = _near_roots(spark, texts, tmp_path / "t")
    assert got == want and want[2] == want[1] == 1


def _block_edits():
    """Pairs of a text and its copy with a block of new words more, or a tail less, at 0.8 to 0.84."""
    texts = []
    for g, n in enumerate([20, 60, 200, 1000] * 12):
        base = [f"t{g}w{i}" for i in range(n)]
        shingles = n - 4
        if g // 4 % 3 == 0:
            copy = [*base, *(f"t{g}n{i}" for i in range(int(shingles * 0.23)))]
        elif g // 4 % 3 == 1:
            copy = [*(f"t{g}n{i}" for i in range(int(shingles * 0.23))), *base]
        else:
            copy = base[: n - int(shingles * 0.18)]
        texts += [" ".join(base), " ".join(copy)]
    return texts


def test_near_copies_with_a_block_more_or_less(spark, tmp_path):
    got, want = _near_roots(spark, _block_edits(), tmp_path / "t")
    assert got == want == [i - i % 2 for i in range(len(got))]


def test_near_copies_at_exactly_the_similarity(spark, tmp_path):
    texts = []
    for g, shingles in enumerate([10, 100, 240, 300, 1000, 5000]):
        words = [f"s{g}w{i}" for i in range(shingles + 4)]
        cut = shingles // 5 * 4 + 4
        texts += [" ".join(words), " ".join(words[:cut]), " ".join(f"far{w}" for w in words), " ".join(f"far{w}" for w in words[: cut - 1])]
    got, want = _near_roots(spark, texts, tmp_path / "t")
    assert got == want == [i - (i % 4 == 1) for i in range(len(texts))]


def _far_edits():
    """Two texts with many edited copies each, most of them further than 0.8 from each other, some within it."""
    rng = random.Random(31)
    texts = []
    for g in range(2):
        base = [f"e{g}w{i}" for i in range(120)]
        for c in range(150):
            copy = base[:]
            for k in range(rng.randint(1, 5)):
                copy[rng.randrange(40, 120)] = f"e{g}c{c}n{k}"
            texts.append(" ".join(copy))
    return texts


def test_large_groups_of_far_copies_write_no_pairs(spark, tmp_path, monkeypatch):
    texts, tables = _far_edits(), []
    save = S.save
    monkeypatch.setattr(S, "save", lambda df, tag: tables.append((tag, save(df, tag))) or tables[-1][1])
    monkeypatch.setattr(S, "discard", lambda *tables: None)
    got, want = _near_roots(spark, texts, tmp_path / "t")
    assert got == want and 10 < len(set(want)) < 200
    # 150 rows a group: the pairs of open rows with all are thousands, what is written stays by the rows
    assert [t.count() for tag, t in tables if tag == "near-candidates"][1] < len(texts)


def test_blocks_of_a_large_group_lose_no_link(spark, tmp_path):
    texts = _far_edits()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    runs = [{"group_rows": 4, "block_rows": 16}, {"group_rows": 10**9}]
    blocks, joined = ({r.doc_id: r.component_id for r in S.near_duplicates(docs, **k).collect()} for k in runs)
    assert blocks == joined


def test_passes_find_what_one_pass_finds(spark, tmp_path, monkeypatch):
    texts, made = _far_edits() + _block_edits(), {}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs, parts = spark.read.parquet(str(tmp_path / "t")), S.save_parts

    def counted(dfs, tag):
        dfs = list(dfs) if tag not in ("near-links", "near-pairs") else dfs
        made[tag] = max(made.get(tag, 0), len(dfs)) if isinstance(dfs, list) else 0
        return parts(dfs, tag)

    monkeypatch.setattr(S, "save_parts", counted)
    got = []
    for k in ({}, {"pass_rows": 3000, "pass_bytes": 1 << 19, "group_rows": 40, "block_rows": 32}):
        monkeypatch.setattr(S, "PASS_SHARE", 1 << 20)
        made.clear()
        got.append({r.doc_id: r.component_id for r in S.near_duplicates(docs, **k).collect()})
    assert got[0] == got[1] and made["near-found"] > 1 and made["near-prefixes"] > 1 and made["near-state"] > 1


def test_shards_hang_on_the_size_of_one_view(spark, monkeypatch):
    asked, bands = [], S.band_count
    monkeypatch.setattr(S, "band_count", lambda n, radius: asked.append(n) or bands(n, radius))
    fps = spark.range(300).select((F.col("id") % 3).cast("int").alias("view"), F.xxhash64("id").alias("fp"))
    S.near_links(fps, pass_rows=200)
    assert asked == [100]  # three views of 100 fingerprints: 15 rows each, not 45 as at three times that size


def test_overlaps_count_what_sets_share():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 9000, int(n)).astype(np.uint64)) for n in rng.integers(0, 7000, 12)] + [np.zeros(0, np.uint64)]
    got = S.overlaps(sets, sets[3:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets]
    assert S.overlaps([], sets).shape == (0, 13) and not S.overlaps(sets[-1:], sets).any()
