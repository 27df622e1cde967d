"""Operators that SQL expresses: whole tables against DuckDB, and the awkward cases."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from struklake.llm import catalogue, linededup, mixing, repeats, sharding, urls


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_duckdb(spark, sf_dir, same_rows, name):
    assert same_rows(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLES[name]) > 0


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_shards(awkward, no_docs, clashing):
    rows = sharding.shard_digest(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        name = "" if r["doc_id"] is None else str(r["doc_id"])
        seed = int(hashlib.md5(name.encode()).hexdigest()[:16], 16)
        assert (r["shard"], r["grown_shard"]) == (jump(seed, 16), jump(seed, 17))
        assert r["grown_shard"] in (r["shard"], 16)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    null = next(r for r in rows if r["doc_id"] == 3)
    assert (null["size"], null["text_crc32"]) == (1, 0)
    assert next(r for r in rows if r["doc_id"] == 1)["text_crc32"] == zlib.crc32(b"a b c d e f g h")
    assert sharding.shard_digest(no_docs).count() == 0
    wide = sharding.shard_by_key(clashing)
    assert wide.count() == awkward.count() and "own size" in {r["size"] for r in wide.collect()}


def targets_by_rounds(sizes: list[int]) -> list[float]:
    """Excess over the cap dealt anew by weight until none is above."""
    weights = [1 + i % 3 for i in range(len(sizes))]
    total, out, capped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        share = sum(weights[i] for i in free)
        for i in free:
            out[i] = left * weights[i] / share
        over = {i for i in free if out[i] > 3 * sizes[i]}
        if not over:
            return [3.0 * s if i in capped else out[i] for i, s in enumerate(sizes)]
        capped |= over


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 1, 1000], [5, 0, 7, 1, 300, 2], [100], [7, 7, 7, 7, 7, 7, 7]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = [r["target"] for r in mixing.source_targets(df).orderBy("source").collect()]
    assert got == pytest.approx(targets_by_rounds(sizes))


def test_mix(spark, sf_dir, awkward, no_docs, clashing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix_digest(docs).collect()
    taken = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken.setdefault((r["target"], r["source_size"]), []).append(r["taken"])
    for (target, size), words in taken.items():
        assert abs(sum(words) - target) <= mixing.BLOCK * 1.01, (target, size)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.select("doc_id", mixing.n_words(F.col("text")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    assert {r["doc_id"]: r["n"] for r in words.collect()} == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}
    assert mixing.mix_digest(awkward).count() == awkward.count()
    assert mixing.mix_digest(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0
    assert mixing.mix_documents(clashing).columns == clashing.columns


def test_mixed_blocks_and_the_draw(spark, awkward, no_docs):
    """Blocks of every slot are slices of the source's stream; shard counts are those of the blocks, near
    their expectation; the digest counts the same words."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(int(rng.integers(0, 90)))), "en", f"s{i % 5}", 0) for i in range(400)]
    rows += [(900, "long " * 200_000, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, awkward.schema)
    blocks = mixing.mixed_blocks(docs).collect()
    digest = {r["doc_id"]: r for r in mixing.mix_digest(docs).collect()}
    streams = {}
    for name in {r[3] for r in rows}:  # the stream's documents in the order of the digest of doc_id
        of_source = sorted((r for r in rows if r[3] == name), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest()[:3], r[0]))
        streams[name] = [w for r in of_source for w in r[1].split()]
    by_shard, taken = {}, {}
    for b in blocks:
        words = streams[b["source"]][b["block"] * mixing.BLOCK : (b["block"] + 1) * mixing.BLOCK]
        assert b["text"].split(" ") == words and b["n_words"] == len(words)
        by_shard[b["out_shard"], b["source"]] = by_shard.get((b["out_shard"], b["source"]), 0) + 1
        for w in words:
            key = (900 if w == "long" else int(w[1 : w.index("w")]), b["out_shard"])
            taken[key] = taken.get(key, 0) + 1
    for i, r in digest.items():
        assert r["shard_words"] == ",".join(str(taken.get((i, k), 0)) for k in range(16))
        assert r["taken"] == sum(map(int, r["shard_words"].split(",")))
    sources = mixing.source_table(docs)[1]
    rank = {r["rank"]: r["source"] for r in sources.collect()}
    drawn = {(r["out_shard"], rank[r["rank"]]): r["n"] for r in mixing.shard_counts(sources).collect()}
    assert drawn == by_shard
    for name in streams:  # multinomial: 15 degrees of freedom, 60 has a chance below one in a million
        counts = np.array([by_shard.get((k, name), 0) for k in range(16)])
        assert ((counts - counts.mean()) ** 2 / counts.mean()).sum() < 60
        places = sorted(b["slot"] for b in blocks if b["source"] == name)
        assert places == list(range(len(places)))
    assert mixing.mixed_blocks(no_docs).count() == 0 and mixing.mixed_blocks(awkward).count() > 0


def test_mix_settles_ties(spark, awkward):
    """Rows that share a doc_id and a size: the order of the input has no bearing."""
    rows = [(i % 3, " ".join(f"t{i}w{k}" for k in range(70)), "en", "s", 0) for i in range(30)]
    runs = []
    for part, some in ((1, rows), (4, rows[::-1]), (2, rows[7:] + rows[:7])):
        df = spark.createDataFrame(some, awkward.schema).repartition(part)
        runs.append(sorted(map(tuple, mixing.mix_documents(df, cap=1).collect())))
        assert sorted(map(tuple, mixing.mix_digest(df).collect())) == sorted(map(tuple, mixing.mix_digest(spark.createDataFrame(rows, awkward.schema)).collect()))
    assert runs[0] == runs[1] == runs[2]


#: url, host, path, rule, verdict of the rule.
JUDGED = [
    ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://org", "org", "", None, None), ("https://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("https://com/de/1", "com", "/de/1", "com/de/", "block"), ("https://xcom/de/1", "xcom", "/de/1", None, None),
    ("no scheme", "", "", None, None), (None, "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None),
    ("", "", "", None, None), ("http://h?://x/fr/", "h", "", None, None),
]


def test_rules(spark):
    rows = [(i, case[0]) for i, case in enumerate(JUDGED)]
    df = spark.createDataFrame([*rows, *rows, (None, "http://b.net/x")], "page_id long, url string")
    got = urls.verdict_digest(df).collect()
    assert len(got) == 2 * len(rows) + 1
    for i, (_, host, path, rule, verdict) in enumerate(JUDGED):
        mine = [r for r in got if r["page_id"] == i]
        assert len(mine) == 2
        for r in mine:
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_very_long_urls(spark):
    """A url of a million characters costs no more than as many characters in short ones."""
    rows = [(1, "https://a.org/" + "x" * 1_000_000), (2, "https://b.com/de/" + "yz" * 40_000), (3, "q" * 300_000), (4, None), (5, "https://c.org/s/ö🙂" * 50)]
    rows += [(i, f"https://h{i % 7}.{'org' if i % 2 else 'com/de'}/{i}") for i in range(6, 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.verdict_digest(pages).collect()}
    assert len(got) == len(rows) and got[1]["verdict"] == "allow" and got[2]["verdict"] == "block"
    assert len(got[1]["path"]) == 1_000_001 and {got[3]["host"], got[4]["path"]} == {""}


def test_pieces_of_strings(spark):
    """Every character comes once with what is before it, at the edges of pieces too."""
    text = "\x01" * urls.ORDER + "".join(chr(97 + i % 26) + ("é" if i % 7 == 0 else "") for i in range(3 * urls.PIECE)) + "\x03"
    for n in (urls.ORDER + 1, urls.ORDER + urls.PIECE, urls.ORDER + urls.PIECE + 1, len(text)):
        s = text[:n]
        got = urls.grams(spark.createDataFrame([(s, 1)], "s string, k int"), "k").collect()
        assert [(r["context"], r["c"]) for r in got] == [(s[i - urls.ORDER : i], s[i]) for i in range(urls.ORDER, n)]


def test_url_models_learn(spark):
    """Examples of the rules decide urls without a rule: spam words stand in blocked ones only."""
    rows = [(i, f"http://good{i % 7}.org/news/{i}") for i in range(200)]
    rows += [(1000 + i, f"http://casino{i % 7}.com/de/{i}") for i in range(200)]
    rows += [(1, "http://casino3.net/de/7"), (2, "http://good4.net/news/7")]
    got = {r["page_id"]: r["verdict"] for r in urls.verdict_digest(spark.createDataFrame(rows, "page_id long, url string")).collect()
           if r["rule"] is None}
    assert got == {1: "block", 2: "allow"}


def test_empty_pages(spark):
    assert urls.verdict_digest(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_line_spread(spark, awkward, no_docs, clashing):
    rows = [(i, f"shared line\nown {i}\n\nshared line", "en", f"s{i % 12}", 1) for i in range(24)]
    rows += [(100 + i, f"few\n{i}", "en", f"s{i % 9}", 1) for i in range(40)]
    df = spark.createDataFrame(rows, awkward.schema)
    got = {r["doc_id"]: r for r in linededup.without_boilerplate(df).collect()}
    assert all(got[i]["text"] == f"own {i}\n" and got[i]["n_removed"] == 2 for i in range(24))
    assert all(got[100 + i]["text"] == f"few\n{i}" for i in range(40))
    assert linededup.line_digest(awkward).count() == awkward.count()
    assert linededup.line_digest(no_docs).count() == 0
    assert linededup.without_boilerplate(clashing).count() == awkward.count()


def test_lines_of_a_very_long_text(spark):
    """Half of 20,000 lines stand on ten sites."""
    own = "\n".join(f"shared {i}" if i % 2 else f"own {i}" for i in range(20_000))
    other = "\n".join(f"shared {i}" for i in range(1, 20_000, 2))
    rows = [(0, own, "s0"), *[(k, other, f"s{k}") for k in range(1, 10)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in linededup.without_boilerplate(df).collect()}
    assert (got[0]["n_lines"], got[0]["n_removed"]) == (20_000, 10_000)
    assert got[0]["text"] == "\n".join(f"own {i}" for i in range(0, 20_000, 2)) and got[3]["text"] == ""


def test_urls_replace_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", "own"), (2, None, None)], "page_id long, url string, host string")
    got = urls.judged(df.withColumns({n: F.lit("own") for n in ("path", "rule", "score", "named", "fold", "s", "ratio")}))
    assert {r["host"] for r in got.collect()} == {"a.org", ""} and got.columns.count("host") == 1


def brute_repeats(texts: list[str | None]) -> list[bytes]:
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    out = []
    for b in data:
        keep = bytearray(b"\1" * len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                keep[i : i + 200] = bytes(200)
        out.append(bytes(c for c, k in zip(b, keep, strict=True) if k))
    return out


def test_repeats(spark, awkward, no_docs, clashing):
    import random

    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passage, other = noise(450), noise(230)
    texts = [
        noise(300) + passage + noise(100), noise(37) + passage + noise(250), passage[:199] + noise(90),
        noise(90) + passage[100:320] + noise(5), other + noise(40) + other, "ab" * 400, "c" * 500, "", None, noise(150),
        noise(250) + passage[3:207] + other[5:229] + noise(60), noise(400), passage,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.without_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)
    rows = awkward.collect()
    kept = sorted((str(r["doc_id"]), bytes(r["kept"])) for r in repeats.without_repeats(awkward).collect())
    expected = brute_repeats([r["text"] for r in rows])
    assert kept == sorted((str(r["doc_id"]), k) for r, k in zip(rows, expected, strict=True))
    assert repeats.removal_digest(no_docs).count() == 0
    assert repeats.removal_digest(clashing).count() == awkward.count()


def crowded_texts(rng) -> list[str]:
    """One passage in most texts, another at the end of many, copies, periods, and long runs."""
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage, tail, copied = noise(260), noise(207), noise(700)
    texts = [noise(rng.randint(0, 90)) + passage + noise(rng.randint(0, 90)) for _ in range(40)]
    texts += [noise(rng.randint(150, 250)) + tail for _ in range(20)]
    texts += [copied] * 9 + [copied[:500] + noise(100), noise(30) + copied[30:]]
    texts += ["c" * 900, "c" * 150 + noise(200), "ab" * 300 + noise(10), noise(137) * 6, (passage + "x") * 3, "c" * 199]
    return texts


@pytest.mark.parametrize("held, chunk", [(1, 300), (50, 301), (700, 1000), (300_000, 1 << 19)])
def test_repeats_do_not_depend_on_parcels(spark, held, chunk):
    """What a task combines and where it cuts long texts has no bearing on the result."""
    import random

    texts = crowded_texts(random.Random(11))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.without_repeats(df, held, chunk).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_repeats_in_very_long_texts(spark):
    """Texts beyond a chunk: a repeated character, a period, and a passage over the seam of two chunks."""
    import random

    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    long = noise(1_300_000)
    seam = repeats.CHUNK
    texts = ["x" * 1_200_000, "abcdefg" * 100_000, long, noise(50) + long[seam - 300 : seam + 260] + noise(50), noise(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["starts"], r["ends"]) for r in repeats.without_repeats(df).collect()}
    assert got[0] == ([0], [1_200_000]) and got[1] == ([0], [700_000])
    assert got[2] == ([seam - 300], [seam + 260]) and got[3] == ([50], [610]) and got[4] == ([], [])


def test_no_anchor_gathers(spark):
    """A passage in every text: no more rows of an anchor go out than there are parcels."""
    import random

    rng = random.Random(4)
    noise = lambda n: "".join(rng.choices("abcdefghij", k=n))
    passage = noise(90)
    hashes = repeats.Polynomials()
    rows = [repeats.segments(np.frombuffer((noise(180) + passage + noise(180)).encode(), np.uint8), hashes) for _ in range(500)]
    parts = [(i, *p) for i, r in enumerate(rows) for p in r]
    columns = [np.concatenate([np.broadcast_to(p[k], p[1].shape) for p in parts]) for k in range(6)]
    anchor, sig = (c.view(np.int64) for c in columns[4:])
    most = np.unique(anchor, return_counts=True)[1].max()
    sent = np.concatenate([key for *_, key, _ in repeats._combined(columns[0].astype(np.int64), *columns[1:4], anchor, sig)])
    assert most >= 400 and np.unique(sent, return_counts=True)[1].max() <= 2


def test_xxh64_in_sql(duck):
    """The hash that op4's counterpart spells out, for texts of 0 to 120 bytes and more."""
    import random

    import xxhash

    from struklake.llm.xxh64_sql import xxh64

    rng = random.Random(2)
    texts = ["", "a", "é", "x" * 31, "x" * 32, "x" * 33] + ["".join(rng.choices("abc é✓", k=rng.randint(0, 120))) for _ in range(200)]
    listed = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    rows = duck.execute(f"WITH t AS (SELECT i, hex(encode(s)) AS x FROM (VALUES {listed}) v(i, s)), {xxh64('t', 42)} SELECT i, h FROM hashed").fetchall()
    assert dict(rows) == {i: xxhash.xxh64_intdigest(t.encode(), 42) for i, t in enumerate(texts)}
