"""Operators without an SQL form against brute force, held-out accuracy and fixtures."""

from __future__ import annotations

import hashlib
import os.path
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from struklake.llm import bktree, catalogue, decontaminate, fingerprints, html, quality, simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_fingerprint(text, words=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    counts, n = [0] * 64, 0
    for j in range(max(1, len(w) - words + 1)) if w else []:
        h = xxhash.xxh64_intdigest(" ".join(w[j : j + words]).encode(), 42)
        n += 1
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > n)


def brute_groups(codes: dict) -> dict:
    ids = sorted(codes)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (codes[a] ^ codes[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_bk_trees_find_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    code = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]]))
    rng.shuffle(code)
    shard = np.sort(rng.integers(0, 3, len(code)))
    expected = {(i, j) for i in range(len(code)) for j in range(i) if shard[i] == shard[j] and int(code[i] ^ code[j]).bit_count() <= 2}
    got = {(int(a), int(b)) for x, y, _ in bktree.links(shard, code, 2) for a, b in zip(x, y, strict=True)}
    assert got == expected
    a, b = bktree.spanning(shard, code, 2)
    assert {(int(x), int(y)) for x, y in zip(a, b, strict=True)} <= expected and len(a) < len(code)


def test_simhash_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = catalogue.op4_simhash(spark, sf_dir).collect()
    codes = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{c:016x}" for i, c in codes.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_groups(codes)


def test_simhash_chain_of_links(spark, monkeypatch):
    """A chain of codes, each one bit from the next, is one group however long."""
    codes = [sum(1 << b for b in range(i)) for i in range(40)]
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    got = simhash.components(simhash.code_links(df)).collect()
    assert len(got) == 40 and len({r["root"] for r in got}) == 1


def test_simhash_awkward(awkward, no_docs, clashing):
    rows = simhash.near_groups(awkward).collect()
    assert len(rows) == awkward.count()
    empty = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert empty == {2}
    assert simhash.near_groups(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0
    kept = simhash.one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect())
    assert ids == [1, 2, 4]  # 3 and 6 are empty like 2, 5 and 7 and 8 are near copies


def test_roots_go_on_from_known_ones(spark):
    rng = np.random.default_rng(11)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (90, 2))] + [(-7, -7), (500, 501), (501, 500)]
    near = [bool(x) for x in rng.random(len(pairs)) < 0.8]
    rounds = [list(zip(pairs, near, strict=True))[i::3] for i in range(3)] + [[]]
    roots, seen = None, []
    for rows in rounds:
        seen += [p for p, x in rows if x and p[0] != p[1]]
        df = spark.createDataFrame([(min(p), max(p), x) for p, x in rows], "a long, b long, near boolean")
        roots = simhash.roots_with(roots, df)
        want = {n: n for p in seen for n in p}
        for _ in want:
            for a, b in seen:
                want[a] = want[b] = min(want[a], want[b])
        got = [(r["node"], r["root"]) for r in roots.collect()]
        assert sorted(got) == sorted(want.items())


def test_near_copies_by_similarity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    group = {r["doc_id"]: r["group_id"] for r in simhash.near_copies(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    close = [p for p, j in alike.items() if j >= 0.85]
    assert close and all(group[a] == group[b] for a, b in close)
    members = Counter(group.values())
    for i, g in group.items():  # whoever was grouped has a partner of at least nearly the similarity
        if members[g] > 1:
            assert max(j for p, j in alike.items() if i in p) >= 0.7


def brute_windows(text, items):
    w = (text or "").encode().lower().split()
    shingles = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    found = {}
    for item, words in items:
        own = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        if own.keys().isdisjoint(shingles):
            continue  # without a shared shingle every window's similarity is 0
        m = len(words) - 4
        for k in range(-m + 1, len(shingles)):
            window = Counter(shingles[max(0, k) : k + m])
            common = sum((own & window).values())
            score = common / (own.total() + window.total() - common)
            found[item] = max(found.get(item, 0), score)
    return {i for i, s in found.items() if s >= 0.8}


def test_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r["item_id"], r["text"].encode().lower().split()) for r in bench.collect()]
    long = max(items, key=lambda x: len(x[1]))
    words = [w.decode() for w in long[1]]
    changed = words[:7] + ["changed"] + words[8:]
    planted = spark.createDataFrame([
        (9001, "before it " + " ".join(words).upper() + " after"), (9002, " ".join(changed)), (9003, " ".join(words[:-1])),
        (9004, " ".join(words[: len(words) // 2])), (9005, None), (9006, ""), (None, " ".join(words)),
    ], "doc_id long, text string")
    docs = docs.unionByName(planted)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    expected = {(r["doc_id"], i) for r in docs.collect() for i in brute_windows(r["text"], items)}
    assert got == expected and (9001, long[0]) in got and (9004, long[0]) not in got
    clean = {r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()}
    assert clean == {r["doc_id"] for r in docs.collect()} - {i for i, _ in expected}


def test_windows_that_hold_a_shingle():
    rng = np.random.default_rng(1)
    for _ in range(100):
        index = decontaminate.ItemIndex([], 0.8)
        n, sizes = int(rng.integers(1, 40)), set(rng.integers(1, 12, 2).tolist())
        shingles, hit = rng.integers(0, 2**64, n, dtype=np.uint64), rng.random(n) < 0.2
        for h in shingles[hit]:
            index.bitmap[h >> np.uint64(64 - decontaminate.BITMAP)] = True
            index.sizes[5, int(h)] = sizes
        got = {size: list(zip(a.tolist(), b.tolist(), strict=True)) for size, a, b in index.windows(shingles, 5)}
        for size in sizes if hit.any() else ():
            windows = {(max(0, k), min(n, k + size)) for k in range(-size + 1, n)}
            assert set(got[size]) == {(a, b) for a, b in windows if hit[a:b].any()} and got[size] == sorted(got[size])


def test_multi_index_finds_all_codes_within_the_radius(monkeypatch):
    rng = np.random.default_rng(2)
    index = decontaminate.ItemIndex([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(50)], 0.8)
    codes = np.concatenate([index.codes[rng.integers(0, 50, 400)], rng.integers(0, 256, (400, 32)).astype(np.uint8)])
    for row in codes[:400]:  # up to 90 bits changed, near and beyond the radius
        bits = rng.choice(decontaminate.BITS, int(rng.integers(0, 90)), replace=False)
        np.bitwise_xor.at(row, bits // 8, (1 << (bits % 8)).astype(np.uint8))
    far = np.bitwise_count(codes[:, None] ^ index.codes[None]).sum(2)
    expected = set(map(tuple, np.argwhere(far <= decontaminate.RADIUS).tolist()))
    assert set(zip(*(x.tolist() for x in index.lookup(codes, (5, 26))), strict=True)) == expected and len(expected) > 300
    monkeypatch.setattr(decontaminate, "LOOKUP", 60)
    assert set(zip(*(x.tolist() for x in index.lookup(codes, (5, 26))), strict=True)) == expected


def test_fingerprints_find_the_candidates(monkeypatch):
    """Nothing but the index of fingerprints proposes an item: without it there is no match."""
    words = [f"w{i}" for i in range(40)]
    index = decontaminate.ItemIndex([(7, " ".join(words)), (8, " ".join(words[:25]))], 0.8)
    text = " ".join(["before"] * 30 + words + ["after"] * 9)
    assert [(i, first, n) for i, first, n, _ in index.matches(text)] == [(7, 30, 40), (8, 30, 25)]
    monkeypatch.setattr(index, "lookup", lambda codes, kind: (np.zeros(0, dtype=int), np.zeros(0, dtype=int)))
    assert index.matches(text) == []


def test_items_of_one_size_only_are_looked_up():
    index = decontaminate.ItemIndex([(i, " ".join(f"w{i}x{k}" for k in range(10 + i % 50))) for i in range(500)], 0.8)
    assert sorted(i for t in index.tables.values() for i in t.items.tolist()) == list(range(500))
    assert all(index.kinds[i] == kind for kind, t in index.tables.items() for i in t.items.tolist())
    assert len(index.tables) == 50 and max(len(t.items) for t in index.tables.values()) == 10


def test_running_window_sums(monkeypatch):
    """Sums of windows do not depend on pieces, spans or gaps."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        monkeypatch.setattr(decontaminate, "PIECE", int(rng.integers(1, 40)))
        monkeypatch.setattr(decontaminate, "SPAN", int(rng.integers(1, 9)))
        n, size = int(rng.integers(1, 120)), int(rng.integers(1, 30))
        shingles = rng.integers(0, 2**64, n, dtype=np.uint64)
        start = np.flatnonzero(rng.random(n + size) < rng.choice([0.05, 0.3, 0.9])) - size + 1
        first, end = np.maximum(start, 0), np.minimum(start + size, n)
        first, end = first[first < end], end[first < end]
        signs = decontaminate.stretch(shingles).astype(int)
        expected = [signs[a:b].sum(0).tolist() for a, b in zip(first, end, strict=True)]
        got = [(at + i, row) for at, sums in decontaminate.window_sums(shingles, first, end) for i, row in enumerate(sums.tolist())]
        assert got == list(enumerate(expected))


def test_similarity_slides():
    rng = np.random.default_rng(4)
    for _ in range(60):
        shingles, item = rng.integers(0, 9, 80).astype(np.uint64), rng.integers(0, 12, int(rng.integers(1, 20))).astype(np.uint64)
        overlap, size, counts = decontaminate.Overlap(Counter(item.tolist()), shingles), len(item), Counter(item.tolist())
        for start in np.flatnonzero(rng.random(80 + size) < 0.4) - size + 1:
            low, high = max(0, int(start)), min(80, int(start) + size)
            if low < high:
                window = Counter(shingles[low:high].tolist())
                assert overlap.similarity(low, high) == (window & counts).total() / (window | counts).total()


def test_decontamination_with_a_very_long_item():
    """200,000 words: whole with words changed, a part of nine tenths, and a half, which is too little."""
    words = [f"w{i}" for i in range(200_000)]
    index = decontaminate.ItemIndex([(1, " ".join(words)), (2, "x1 x2 x3")], 0.8)
    changed = ["other" if i % 100 == 50 else w for i, w in enumerate(words)]
    [(item, first, n, score)] = index.matches(" ".join(["before"] * 5000 + changed + ["after"] * 5000))
    assert (item, first, n) == (1, 5000, 200_000) and score == pytest.approx((199_996 - 10_000) / (199_996 + 10_000), abs=1e-4)
    [(_, first, n, score)] = index.matches(" ".join(words[:180_000]))
    assert (first, n) == (0, 180_000) and score == 179_996 / 199_996
    assert index.matches(" ".join(["before"] * 3 + words[:100_000])) == []


def test_recall_at_the_threshold():
    """Windows with words changed here and there: all that reach the similarity are found."""
    rng = np.random.default_rng(7)
    reach = found = 0
    for k in range(400):
        words = [f"w{k}x{i}" for i in range(int(rng.integers(15, 60)))]
        changed = list(words)
        for i in rng.choice(len(words), int(rng.integers(0, 3)), replace=False):
            changed[i] = "other"
        cut = int(rng.integers(0, 4))
        text = " ".join(["a"] * int(rng.integers(0, 9)) + changed[cut:] + ["b"] * int(rng.integers(0, 9)))
        if brute_windows(text, [(1, [w.encode() for w in words])]):
            reach += 1
            found += bool(decontaminate.ItemIndex([(1, " ".join(words))], 0.8).matches(text))
    assert reach > 100 and found == reach


def test_decontamination_of_a_very_long_text():
    words = [f"w{i}" for i in range(30)]
    text = " ".join([f"x{i % 997}" for i in range(300_000)] + words * 500)
    got = decontaminate.ItemIndex([(1, " ".join(words)), (2, "x1 x2 x3")], 0.8).matches(text)
    assert [(i, s) for i, _, _, s in got] == [(1, 1.0), (2, 1.0)]


def test_decontamination_awkward(spark, awkward, no_docs, clashing, monkeypatch):
    bench = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(awkward, bench).collect()}
    assert got == {(1, 1), (5, 1), (None, None)}
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.contaminated(awkward, bench.filter("item_id > 5")).count() == 0
    assert decontaminate.clean_documents(clashing, bench).columns == clashing.columns
    monkeypatch.setattr(decontaminate, "ITEMS", 1)  # many blocks give the same
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(awkward, bench).collect()} == got


def test_quality_held_out(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = catalogue.op1_quality(spark, folder).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 1000 and held and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in held)
    assert right / len(held) > 0.95
    again = {r["doc_id"]: r["score"] for r in catalogue.op1_quality(spark, folder).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}


def brute_contexts(texts):
    """Sums of index vectors of neighbours within the window, pair by pair."""
    places, signs = quality.index_vectors()
    matrix = np.zeros((quality.BUCKETS, quality.DIM), dtype=np.int64)
    for text in texts:
        words = quality.Buckets()(text)
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                if i != j:
                    np.add.at(matrix[w], places[words[j]], signs[words[j]])
    return matrix


@pytest.mark.parametrize("most", [1, 2, 7, 50, 10_000])
def test_contexts_do_not_depend_on_cuts(most):
    texts = ["one two three four five " * 9, None, "", "a", "a b", "b a c! 12 " * 6]
    got = np.zeros((quality.BUCKETS, quality.DIM), dtype=np.int64)
    for batch in quality._count_contexts(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]), most):
        for part, counts in zip(batch["part"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            got[part * quality.ROWS : (part + 1) * quality.ROWS] = np.frombuffer(counts, dtype=np.int64).reshape(quality.ROWS, quality.DIM)
    assert (got == brute_contexts(texts)).all()


def test_pooling_in_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    words, vectors = rng.integers(0, 100, 1000), rng.normal(size=(100, quality.DIM)).astype(np.float32)
    v = vectors[words].astype(np.float64)
    expected = np.concatenate([v.mean(0), v.std(0), np.abs(np.diff(v, axis=0)).mean(0), [np.log1p(1000)]])
    for size in (1, 3, 999, 1000, 1 << 16):
        monkeypatch.setattr(quality, "POOL", size)
        assert np.allclose(quality.pooled(words, vectors), expected, atol=1e-5)


def test_quality_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    long = spark.createDataFrame([(10_000, "word and other " * 250_000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(long)
    one, many = ({r["doc_id"]: r["score"] for r in quality.quality_scores(docs.repartition(n), labels).collect()} for n in (1, 8))
    assert one == many and len(one) == docs.count()


def test_quality_awkward(spark, awkward, no_docs, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_sided = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (2, None, None), (None, 0, 0)], none.schema)
    for labels in (none, one_sided):
        rows = quality.quality_scores(awkward, labels).collect()
        assert len(rows) == awkward.count() and all(0 < r["score"] < 1 for r in rows)
        assert quality.quality_scores(no_docs, labels).count() == 0
    assert quality.good_documents(clashing, none).columns == clashing.columns


def spark_hash(*values) -> int:
    """Spark's xxhash64 of strings and numbers: each value's hash seeds the next."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(4, "little") if isinstance(v, np.int32) else (v % 2**64).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_sketch(text):
    """(hash, place) of the fingerprint's entries, written out from the definition."""
    words = WORD.findall(text or "")
    t = [0] * (fingerprints.K - 1) + [spark_hash(w) for w in words] if words else []
    found, seen = [], Counter()
    for i in range(len(t) - fingerprints.K + 1):
        k = t[i : i + fingerprints.K]
        if min(k) in (k[0], k[-1]):
            short = spark_hash(*k) & 0xFFFFFFFF
            found.append((spark_hash(short, np.int32(seen[short])) & 0x7FFFFFFF, i))
            seen[short] += 1
    return [x for i, x in enumerate(sorted(found)) if i < fingerprints.SIZE or x[0] < 2**31 // fingerprints.SHARE]


def brute_match(a, b):
    """Likeness from the hashes below the bound to which both are complete, and the likeliest shift."""
    def full(x):
        return 2**31 if len(x) < fingerprints.SIZE else max(2**31 // fingerprints.SHARE, x[-1][0] + 1)

    m = min(full(a), full(b))
    a, b = ({h: p for h, p in x if h < m} for x in (a, b))
    shared = a.keys() & b.keys()
    moves = Counter(b[h] - a[h] for h in shared)
    union = len(a.keys() | b.keys())
    return len(shared) / union if union else 1.0, max(moves, key=lambda d: (moves[d], -abs(d), d)) if moves else None


def brute_text(entries):
    return "".join(f"{h:08x}" for h, _ in entries)


def test_syncmers_by_hand(spark):
    text = "one two three four five six seven eight nine ten eleven twelve " * 2 + "x" * 400
    df = spark.createDataFrame([(text,), (None,), ("",), ("word",)], "text string")
    got = [[(x >> 32, x & 0x7FFFFFFF) for x in r[0]] for r in df.select(fingerprints.sketch("text")).collect()]
    assert got == [brute_sketch(t) for t in (text, None, "", "word")]
    assert got[1] == got[2] == [] and got[3]


def test_anchors_are_free_of_context(spark):
    """Words put before a text leave its anchors as they are: likeness stays, and the shift is their number."""
    words = [f"w{i}" for i in range(1000)]
    rows = [(n, " ".join(words), " ".join([f"new{i}" for i in range(n)] + words)) for n in (0, 1, 20, 64, 130, 300)]
    df = spark.createDataFrame(rows, "n long, a string, b string")
    got = df.select("n", fingerprints.sketch("a").alias("x"), fingerprints.sketch("b").alias("y")).select("n", fingerprints.match("x", "y").alias("m")).collect()
    for r in got:
        assert r["m"]["shift"] == r["n"] and abs(r["m"]["likeness"] - 1000 / (1000 + r["n"])) < 0.1
    assert next(r["m"]["likeness"] for r in got if r["n"] == 130) >= 0.8


def test_no_step_with_the_length(spark):
    """A little more text is a little less alike, at every length."""
    word = lambda i: f"{i * 7919 % 1000:03d}x"
    rows = [(n, " ".join(map(word, range(n))), " ".join(map(word, range(n + 2)))) for n in range(20, 400, 20)]
    df = spark.createDataFrame(rows, "n long, a string, b string")
    got = df.select(fingerprints.sketch("a").alias("x"), fingerprints.sketch("b").alias("y")).select(fingerprints.match("x", "y")["likeness"]).collect()
    assert all(r[0] >= 0.85 for r in got)


def test_very_long_text(spark):
    """300,000 words, and one word repeated as often, in one fingerprint each."""
    texts = [" ".join(f"w{i % 7001}" for i in range(300_000)), "same " * 300_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [[(x >> 32, x & 0x7FFFFFFF) for x in r[0]] for r in df.select(fingerprints.sketch("text")).collect()]
    assert got == [brute_sketch(t) for t in texts]


def test_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in catalogue.op5_fingerprints(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    by_text = {}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        x, r = texts[i], rows[i]
        m = len(x) // 4
        edited = x[: len(x) - m] + texts[j][:m]
        assert (r["n_chars"], r["edited_sha256"]) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(x, r["fingerprint"]) == r["fingerprint"]
        own, changed, following = brute_sketch(x), brute_sketch(edited), brute_sketch(texts[j])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (brute_text(own), brute_text(changed))
        assert (r["near_edited"], r["edited_shift"]) == brute_match(own, changed)
        assert r["near_next"] == brute_match(own, following)[0]
        if x == edited:
            assert r["near_edited"] == 1.0
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.5 > 0.1 > np.mean([r["near_next"] for r in rows.values()])


def test_fingerprints_over_ranges(spark, sf_dir, monkeypatch):
    """Many small ranges give the same next document as one."""
    one = {tuple(r) for r in catalogue.op5_fingerprints(spark, sf_dir).collect()}
    monkeypatch.setattr(fingerprints, "RANGE", 7)
    assert {tuple(r) for r in catalogue.op5_fingerprints(spark, sf_dir).collect()} == one


def test_fingerprints_awkward(awkward, no_docs, clashing):
    rows = fingerprints.fingerprint_digest(awkward).collect()
    assert len(rows) == awkward.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    empty = next(r for r in rows if r["doc_id"] == 2)
    assert (empty["fingerprint"], empty["n_chars"], empty["near_edited"]) == ("", 0, 1.0)
    assert fingerprints.fingerprint_digest(no_docs).count() == 0
    assert fingerprints.fingerprint_digest(clashing).count() == awkward.count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div><div class="ad">Buy &amp; win</div>
<article><h1>Title {0} &lt;1&gt;</h1><p><b>First  part<br>second.<p>Text &eacute;&#233; {0}</p>
<form><input name=x><button>Go</button></form><ul><li>one<li>two {0}</ul><section id="comments"><p>nice!</p></section></article>
<aside>Related</aside><footer>&copy; host</footer></body></html>"""
TEXT = "Title {0} <1>\nFirst part second.\nText éé {0}\none\ntwo {0}"


def test_html(spark):
    plain = "<div>Top bar</div><p>Own words {0}</p><p>Made with care</p>"
    rows = [(i, f"http://h{i % 2}/a/{i}", PAGE.format(i)) for i in range(6)]
    rows += [(10 + i, f"http://plain/x/{i}", plain.format(i)) for i in range(4)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://one/", plain.format(9)), (None, "http://two/", "a &lt; b < c"), (0, "http://h0/a/0", PAGE.format(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = html.extracted(df).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    for i in range(6):
        assert by_id[i]["text"] == TEXT.format(i) and by_id[i]["n_chars"] == len(TEXT.format(i))
    assert by_id[20]["text"] == by_id[21]["text"] == ""
    assert by_id[22]["text"] == "Top bar\nOwn words 9\nMade with care" and by_id[None]["text"] == "a < b < c"
    assert html.extracted(df.limit(0)).count() == 0


def brute_templates(pages):
    """Text of (page_id, url, html) rows without marked articles, pairing written out per host."""
    rows = []
    for i, url, page in pages:
        m = re.match("[^:]*://([^/?#]*)([^?#]*)", url or "")
        rows.append((i, m[1] if m else "", m[2] if m else "", html.candidates(page)[1]))
    out = {}
    for i, host, path, lines in rows:
        ways = {}
        for _, h, p, l in rows:
            if h == host and l:
                ways[tuple(l)] = min(p, ways.get(tuple(l), p))
        order = sorted(ways, key=lambda l: ways[l])
        gone = set()
        if host and lines:
            k = order.index(tuple(lines))
            near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order)]
            if near:
                start = lambda l: len(os.path.commonprefix([ways[l], ways[tuple(lines)]]))
                gone = html.common_lines(lines, max(near, key=start))
        out[i] = "\n".join(t for j, t in enumerate(lines) if j not in gone)
    return out


def plain_site(n):
    """Pages of three hosts with a template in plain blocks, copies among them, in no order."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        host, k = f"h{i % 3}.org", int(rng.integers(0, n))
        body = "".join(f"<p>{'line of' if rng.random() < 0.1 else 'own'} {host if rng.random() < 0.5 else k} {j}</p>" for j in range(int(rng.integers(1, 6))))
        rows.append((i, f"http://{host}/a/{k:03d}", f"<div>top of {host}</div><p>menu</p>{body}<p>end of {host}</p>"))
    rows += [(n + i, u + "?again", p) for i, (_, u, p) in enumerate(rows[::7])]
    rows += [(n + 50, None, "<p>top</p>"), (n + 51, "http://alone.org/", "<p>top</p><p>mine</p>"), (n + 52, "http://h0.org/", ""), (n + 53, "http://h1.org/x", None)]
    return rows


def test_html_differencing(spark):
    """Pairs do not depend on how many ranges the pages are dealt into, nor on copies."""
    rows = plain_site(90)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("host", "path", "lines", "code", "range", "text")})
    expected = brute_templates(rows)
    assert sum("menu" in t for t in expected.values()) < 5 and any("own" in t for t in expected.values())
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for ranges in ("1", "4", "8", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            got = html.extracted(df).collect()
            assert {r["page_id"]: r["text"] for r in got} == expected and len(got) == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_html_copies_are_no_template(spark):
    """Copies count once: the template goes from all of them if a sibling shows it, else nothing does."""
    page = "<body><div>top</div><p>{}</p><div>end</div></body>"
    rows = [(1, "http://h.org/a/1", page.format("mine")), (2, "http://h.org/a/1?x", page.format("mine")),
            (6, "http://h.org/a/1?y", page.format("mine")), (3, "http://h.org/a/2", page.format("yours")),
            (4, "http://i.org/a", page.format("same")), (5, "http://i.org/a", page.format("same"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extracted(df).collect()}
    assert got == {1: "mine", 2: "mine", 6: "mine", 3: "yours", 4: "top\nsame\nend", 5: "top\nsame\nend"}


def test_html_without_article_marks(spark, sf_dir):
    """With the article tags taken out, differencing and the other rules still leave the articles: what goes
    beside the boilerplate is a line that the neighbour has too."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    marked = {r["page_id"]: r["text"].split("\n") for r in html.extracted(pages).collect()}
    got = {r["page_id"]: r["text"].split("\n") for r in html.extracted(bare).collect()}
    assert all(not Counter(got[i]) - Counter(marked[i]) for i in marked)
    assert sum(got[i] == marked[i] for i in marked) >= 0.97 * len(marked)
    rows = [(r["page_id"], r["url"], r["html"]) for r in bare.collect()]
    assert {i: "\n".join(t) for i, t in got.items()} == brute_templates(rows)


def test_html_of_very_long_pages():
    """20,000 lines against 20,000 others: memory grows with the lines, not with their product."""
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 5000, 20_000).tolist() for _ in range(2))
    found = sorted(html.common_lines(a, b))
    at = 0
    for i in found:  # a subsequence of both
        at = b.index(a[i], at) + 1
    assert len(found) > 100
    page = "".join(f"<p>line {i}</p>" for i in range(20_000))
    assert len(html.candidates(page)[1]) == 20_000


@pytest.mark.parametrize("seed", range(5))
def test_common_lines_are_longest(seed):
    rng = np.random.default_rng(seed)
    a, b = (["abcd"[i] for i in rng.integers(0, 4, n)] for n in (13, 11))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert len(html.common_lines(a, b)) == table[-1][-1]


def test_html_of_given_pages(spark, sf_dir):
    """Every given page has one article: its blocks are what remains."""
    import html as entities

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in catalogue.op6_html(spark, sf_dir).collect()}
    for p in pages:
        body = p["html"][p["html"].index("<article>") + 9 : p["html"].rindex("</article>")]
        blocks = re.split("</?p>|</?h1>", body.replace("<br>", " "))
        clean = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
        assert got[p["page_id"]] == "\n".join(b for b in clean if b)


def brute_near_groups(texts: dict, at_least: float) -> dict:
    """Smallest id of every id's component of pairs with this similarity of five-word shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    often = [x for x, n in Counter(x for s in sets.values() for x in s).items() if n > 1]
    place = {x: k for k, x in enumerate(often)}
    ids = sorted(sets)
    table = np.zeros((len(ids), len(often)), dtype=np.float32)
    for k, i in enumerate(ids):
        table[k, [place[x] for x in sets[i] if x in place]] = 1
    size = np.array([len(sets[i]) for i in ids])
    common = table @ table.T
    alike = (common >= at_least * (size[:, None] + size - common) - 1e-6) & (common > 0)
    links = [(ids[a], ids[b]) for a, b in np.argwhere(alike) if a < b]
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    empty = [i for i in sorted(sets) if not sets[i]]
    for a, b in [*links, *zip(empty, empty[1:], strict=False)]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_copies_in_a_large_family(spark):
    """Among 2,000 variants of one text at 0.7 or so, every true pair at 0.8 is found."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(2000):
        words = list(base)
        for at in rng.choice(24, 2, replace=False):  # 10 of 116 shingles are the text's own
            words[at * 5 + 2] = f"own{i}x{at}"
        texts[i] = " ".join(words)
    for k in range(60):  # partners of some variants with one more change
        words = texts[k * 30].split()
        words[int(rng.integers(0, 120))] = f"late{k}"
        texts[5000 + k] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_copies(df).collect()}
    expected = brute_near_groups(texts, 0.8)
    assert got == expected and 100 < len(set(expected.values())) < 2000


def test_partners_of_other_roots():
    """With roots given, exactly the partners of different roots come."""
    rng = np.random.default_rng(4)
    run = np.sort(rng.integers(0, 6, 200))
    n = np.concatenate([np.sort(rng.integers(20, 30, (run == r).sum())) for r in range(6)])
    at, root = rng.integers(0, 8, 200), np.where(rng.random(200) < 0.8, run, rng.integers(10, 13, 200))
    for low, high in ((0, 1), (1, 16), (16, 1 << 62), (0, 1 << 62)):
        every = {(int(x), int(y)) for a, b in simhash.partners(run, n, at, 0.8, low, high) for x, y in zip(a, b, strict=True)}
        got = [(int(x), int(y)) for a, b in simhash.partners(run, n, at, 0.8, low, high, root) for x, y in zip(a, b, strict=True)]
        assert set(got) == {(x, y) for x, y in every if root[x] != root[y]} and len(set(got)) == len(got) > 0


def test_simhash_links_are_verified(spark):
    """The BK-trees alone join near copies that differ in few bits; the sets decide what they link."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[::-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = simhash.set_codes(df, 5)[0].select("code", "print", F.col("doc_id").alias("first_id"))
    names = {r["code"]: r["first_id"] for r in first.collect()}
    pairs = {frozenset((names[r["a"]], names[r["b"]])) for r in simhash._print_pairs(first).collect()}
    assert pairs == {frozenset((0, 1))}
    assert {r["doc_id"]: r["group_id"] for r in simhash.near_copies(df).collect()} == {0: 0, 1: 0, 2: 2}


def test_near_copies_at_the_threshold(spark):
    """Exactly 0.8 links, a little less does not, for long and short texts."""
    def pair(k, n, changed):  # a text of n shingles, and one without its last `changed` shingles
        words = [f"t{k}w{i}" for i in range(n + 4)]
        return [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: n + 4 - changed]))]

    cases = [(n, c) for n in (5, 10, 100, 250) for c in (n // 5, n // 5 + 1)] + [(200, 41 + c) for c in range(8)]
    rows = [r for k, (n, c) in enumerate(cases) for r in pair(k, n, c)]
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * k] == got[2 * k + 1] for k in range(len(cases))] == [c * 5 <= n for n, c in cases]


def test_html_keeps_marked_text_of_an_article():
    """Slugs, headings, paragraphs and ambiguous words inside an article are text; whole marks of containers are not."""
    page = """<article><section id="discussion"><h2 id="side-effects">a</h2><p class="alert">b</p></section>
<h2 id="social-history">c</h2><h3 id="related-work">d</h3><div class="responses">e</div><p id="comments">f</p>
<div id="menu-engineering">g</div><div class="x share-buttons">no</div><ul class="comments"><li>no</ul><div class="ad">no</div></article>"""
    assert "\n".join(html.candidates(page)[1]) == "a\nb\nc\nd\ne\nf\ng"


BLOG = """<html><body><header><h1>Site</h1></header><nav><a>Home</a></nav>
<main><article><h1>Title</h1><p>First.</p>{inside}<p>Last.</p></article></main>
{outside}<footer><article>Imprint</article></footer></body></html>"""


@pytest.mark.parametrize("extra", [
    '<section id="comments"><article class="comment-body"><p>I say</p></article></section>',
    '<aside><article class="card">Read on</article></aside>', '<footer><article>Legal</article></footer>',
    '<div class="ad"><article>Buy</article></div>', '<div class="sidebar"><main>Links</main></div>',
    '<div id="disqus_thread"></div><ol class="commentlist"><li class="comment"><article>No</article></li></ol>',
])
def test_html_articles_that_are_no_main_text(extra):
    """Comments, sidebars, footers and adverts stay out, though they are marked as articles."""
    assert html.candidates(BLOG.format(inside="", outside=extra)) == (True, ["Title", "First.", "Last."])
    assert html.candidates(f"<p>Own text, and a lot of it here</p>{extra}") == (False, ["Own text, and a lot of it here"])


@pytest.mark.parametrize("extra", [
    '<ul><li class="comment">I say</li></ul>', '<div class="ad-slot">Buy</div>', '<div id="comment-42">I say</div>',
    '<div class="post-comments"><p>I say</p></div>', '<div class="user-comments">I say</div>',
    '<section class="comments"><article class="comment-body">I say</article></section>', '<div class="comment-author">Me</div>',
])
def test_html_comments_inside_an_article(extra):
    assert html.candidates(BLOG.format(inside=extra, outside="")) == (True, ["Title", "First.", "Last."])


@pytest.mark.parametrize("before", ["<nav><ul><li>menu", '<div class="menu">menu', "<aside>side", '<div class="sidebar">side'])
def test_html_forgotten_end_tags(before):
    """A region that is never closed does not swallow the article."""
    assert html.candidates(f"<body>{before}<article><p>The text of the page.</p></article>") == (True, ["The text of the page."])


def test_sketches_rule_out_no_near_pair(spark):
    """A family at similarity about 0.7: no pair of 0.8 is ruled out, and few others are left to the sets."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(160):
        words = list(base)
        for at in rng.choice(400, 7 if i % 4 else 4, replace=False):
            words[at] = f"v{rng.integers(10**9)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    arrays = [simhash.shingle_set(t, 5) for t in texts]
    codes = [simhash.set_code(a) for a in arrays]
    first = spark.createDataFrame(list(zip(codes, range(160))), "code long, first_id long")
    pairs = [(min(codes[i], codes[j]), max(codes[i], codes[j])) for i in range(160) for j in range(i)]
    sets = simhash._sets(docs, first, 5)
    tried = {(r["a"], r["b"]): r["possible"] for r in simhash.tried_pairs(spark.createDataFrame(pairs, "a long, b long"), sets, 0.8).collect()}
    by_code = {c: set(a.tolist()) for c, a in zip(codes, arrays)}
    near = {p for p in pairs if len(by_code[p[0]] & by_code[p[1]]) / len(by_code[p[0]] | by_code[p[1]]) >= 0.8}
    assert near and all(tried[p] for p in near) and len(tried) == len(pairs)
    assert sum(tried.values()) <= 20 * len(near) and sum(tried.values()) < 0.5 * len(pairs)
    crowded = np.arange(400, dtype=np.uint64) << np.uint64(32)  # all in one bucket
    assert simhash.count_sketch(crowded) is None
    x, y = rng.integers(0, 2**64, 100, dtype=np.uint64), rng.integers(0, 2**64, 900, dtype=np.uint64)
    common, sizes = simhash.most_common(simhash.count_sketch(x), simhash.count_sketch(np.concatenate([x, y])))
    assert common == 100 and sizes == 1100


def marked_site():
    """(page_id, url, html, text) of pages that mark articles with a template inside, and of such that only look like it."""
    rows = []

    def add(url, body, text):
        rows.append((len(rows), url, f"<nav>Menu</nav><article>{body}</article><footer>End</footer>", "\n".join(text)))

    for i in range(12):  # a template in the article: a line before the text, an advert in it, a line after it
        body = f"<h1>Title {i}</h1><p>By our staff</p><p>First {i}.</p><p>More {i}.</p><div>Advert</div><h2>Method</h2><ul><li>Step {i}<li>End {i}</ul><div>Advert</div><p>Join us</p>"
        add(f"http://t.org/a/{i:02d}", body, [f"Title {i}", f"First {i}.", f"More {i}.", "Method", f"Step {i}", f"End {i}"])
    add(*rows[3][1:2], rows[3][2][len("<nav>Menu</nav><article>"):-len("</article><footer>End</footer>")], rows[3][3].split("\n"))  # a copy
    add("http://t.org/b", "<p>Other words</p><p>Join us</p>", ["Other words"])  # its nearest page is that of the next line
    add("http://t.org/b/1", "<p>Own</p><p>words</p>", ["Own", "words"])
    for i in range(6):  # versions of one text
        lines = [f"Sentence {j}." if j != i else "Changed." for j in range(6)]
        add(f"http://v.org/{i}", "".join(f"<p>{t}</p>" for t in lines), lines)
    for i in range(9):  # a phrase on four of nine pages, one after the other
        lines = [f"Mine {i}.", "A phrase."] if i < 4 else [f"Mine {i}.", f"More {i}."]
        add(f"http://p.org/{i}", "".join(f"<p>{t}</p>" for t in lines), lines)
    for i in range(2):  # two pages show no template
        add(f"http://two.org/{i}", f"<p>Text {i}</p><p>Join us</p>", [f"Text {i}", "Join us"])
    for i in range(5):  # headings, terms and cells of like articles
        body = f"<h2>Facts</h2><table><tr><td>Height</td><td>{i} m</td></tr></table><dl><dt>Name</dt><dd>N{i}</dd></dl><p>About {i}.</p>"
        add(f"http://f.org/{i}", body, ["Facts", "Height", f"{i} m", "Name", f"N{i}", f"About {i}."])
    return rows


def test_html_differencing_inside_articles(spark):
    """A marked article loses what differencing shows on most pages of its host, and nothing else."""
    rows = marked_site()
    open_pages = [(100 + i, f"http://t.org/a/{i:02d}x", f"<p>top</p><p>open {i}</p>", f"open {i}") for i in range(4)]
    rows += open_pages  # open pages of the same host are paired with each other
    rows += [(200, None, "<article><p>Join us</p></article>", "Join us")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, expected string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for ranges in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            got = html.extracted(df).collect()
            assert {r["page_id"]: r["text"] for r in got} == {r[0]: r[3] for r in rows} and len(got) == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
