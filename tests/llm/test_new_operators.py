"""Personal data, hard negatives and lexical search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from struklake.llm import catalogue, lexical, negatives, personal

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def is_base(kind: str, span: str) -> bool:
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        sums = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in sums) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute_spans(text) -> list[tuple]:
    return [(k, m.start(), m.end()) for k, r in BASE.items() for m in re.finditer(r, text or "") if is_base(k, m.group())]


def check_digest(rows, texts: dict) -> dict:
    added = {}
    for r in rows:
        want = [f"{k}:{a}:{b}" for k, a, b in brute_spans(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
        got = [s for s in r["spans"].split(",") if s]
        assert set(want) <= set(got) and len(got) == len(set(got))
        order = [(list(BASE).index(k), int(a)) for k, a, _ in (s.split(":") for s in got)]
        assert order == sorted(order)
        added[r["doc_id"]] = sorted(set(got) - set(want))
    return added


ODD = [
    "a@b.com_x@y.zz rest 1.2.3.4.5.6.7.8 x", "+1 (017) 555-7713 4111 1111 1111 1111 1000.2.3.4 é🙂 q@é.x.com n@m.co", None, "",
    "1.2.3.4" * 5, "+1+1+123456789012 001.002.003.004 4111-1111-1111-1111-", "a@b@c.d.e@f.g @x.y 256.1.1.1 00255.0.0.1",
    "x" * 200_000 + "@ " + "1 " * 20_000 + " a@b.c" * 1500 + "." * 5000 + "0" * 30_000,
]


def test_personal_data(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = personal.personal_digest(docs).collect()
    assert len(rows) == len(texts)
    assert all(i >= 10**6 for i, more in check_digest(rows, texts).items() if more)


def test_personal_data_of_random_texts(spark):
    rng = random.Random(3)
    parts = ["a", "@", ".", "b.c", "+", "1", "23", "255", " ", "-", "(", ")", "é", "4111111111111111", "x@y.zz", "\n", "_", "%"]
    texts = {i: "".join(rng.choices(parts, k=rng.randint(1, 60))) for i in range(400)}
    rows = personal.personal_digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    check_digest(rows, texts)


def test_loose_spans(spark):
    """What votes and classifier accept is added; what only looks alike is not."""
    plain = [(i, f"text {i} with user{i}@host{i}.com and 10.1.{i % 200}.7 at +1 (212) 555-{1000 + i} here") for i in range(300)]
    odd = [(1001, "mail: jane [at] site [dot] com thanks"), (1002, "host 2001:db8:0:0:8:800:200c:417a is up"),
           (1003, "at 10:30:45 on 12.05.2024 in order 1234 5678 9012 3456"), (1004, "pages 100-200-3000 of 12.34.567")]
    docs = spark.createDataFrame(plain + odd, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal.personal_digest(docs).collect()}
    assert got[1001] == "email:6:30" and got[1002] == "ip:5:33" and got[1003] == got[1004] == ""
    masked = personal.personal_spans(docs, "doc_id", "text").select("doc_id", personal.masked(F.col("text"), F.col("spans")).alias("t"))
    texts = {r["doc_id"]: r["t"] for r in masked.collect()}
    assert texts[1001] == "mail: <email> thanks" and texts[5] == "text 5 with <email> and <ip> at <phone> here"
    assert texts[1004] == odd[3][1]


def test_estimated_reliabilities():
    """Labelers that agree are believed; one that votes at random is not."""
    patterns = {(0, 1, 1, 1, 0, 1): 500, (0, 1, 1, 1, 0, -1): 500, (0, -1, -1, -1, 0, 1): 400, (0, -1, -1, -1, 0, -1): 400}
    found = personal.estimate(patterns)
    assert all((p > 0.99) == (v[1] == 1) and (p < 0.01) == (v[1] == -1) for v, p in found.items())


def test_personal_awkward(awkward, no_docs, clashing):
    for docs in (awkward, clashing):
        rows = personal.personal_digest(docs).collect()
        assert len(rows) == docs.count() and all(r["spans"] == "" for r in rows)
    assert personal.personal_digest(no_docs).count() == 0


def brute_negatives(rows: list[tuple]) -> list[tuple]:
    usable = []
    for n, (i, v, label) in enumerate(rows):
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v):
            usable.append((n, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for n, i, label, v in usable:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, k) for m, j, k, w in usable if m != n)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            near = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(near, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int"
NEGATIVE = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e6])
def test_hard_negatives(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=6) + 1.2).round(1).tolist(), int(rng.integers(0, 4))) for i in range(0, 900, 5)]
    rows = [(i, [x * scale for x in v], k) for i, v, k in rows]
    rows += rows[:40:8] + [rows[20]] * 30  # repeated rows, anchors among them
    rows += [(3, None, 1), (None, [1.0] * 6, 1), (5, [1.0, None], 1), (8, [math.nan] * 6, 2), (9, [math.inf] * 6, 2), (11, [1.0], None),
             (12, [], 1), (13, [2.0 * scale, 1.0], 2), (1000, [1.0 * scale] * 9, 3), (1100, [], 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("own")).repartition(3)
    got = sorted(tuple(r[c] for c in NEGATIVE) for r in negatives.hard_negatives(df).collect())
    assert got == brute_negatives(rows) and got


def test_no_anchors(spark):
    empty = negatives.hard_negatives(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and tuple(empty.columns) == NEGATIVE
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], VECTORS)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(100, [1.0], 1)], VECTORS)).count() == 0


@pytest.mark.parametrize("largest", [5, 10**6, 10**9, 10**17])
def test_packed_products_are_exact(largest):
    """Fields of 32 and 64 bits and wider ones give the products of plain integers."""
    rng = random.Random(largest)
    small = min(largest, 10**9)
    rows = [[rng.randint(-small, small) for _ in range(7)] for _ in range(50)]
    anchor = [rng.randint(-largest, largest) // 10**9 if largest > 10**9 else rng.randint(-small, small) for _ in range(7)]
    packed = negatives.Packed(np.array(rows), largest)
    assert packed.scores(anchor).tolist() == [sum(a * b for a, b in zip(anchor, r)) for r in rows]
    with pytest.raises(OverflowError):
        negatives.Packed(np.array([[1 << 62, 1 << 62]], dtype=object), 1 << 62).scores([1 << 62, 1 << 62])


def test_anchor_blocks(spark, sf_dir, monkeypatch, same_rows):
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    same_rows(catalogue.op12_hard_negatives(spark, sf_dir), negatives.ORACLE)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text) -> list[str]:
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    held = [(i, Counter(t), len(t)) for i, t in ((i, brute_terms(x)) for i, x in docs) if t]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // length
            score = 0
            for t in brute_terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item_id, r, i, -s) for r, (s, _, i) in enumerate(scored[:10], 1)]
    return sorted(out, key=repr)


def random_corpus(rng, docs: int, items: int) -> tuple[list, list]:
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(docs)]
    texts += [(docs + i, texts[i % 7][1]) for i in range(docs // 4)]  # copies
    return texts, [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 12)))) for i in range(items)]


def searched(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.ranked_documents(d, i).collect()), key=repr)


def test_lexical_search(spark):
    rng = random.Random(2)
    docs, items = random_corpus(rng, 900, 40)
    docs += [(None, "w1 w50"), (None, "w1 w50"), (7, "w50 W50"), (5001, None), (5002, ""), (5003, "ÉÉ Éé w59\x00w59"), (5004, "w3 " * 30_000)]
    items += [(100, None), (101, ""), (102, "unheard of"), (5, items[5][1]), (None, "w50 w59 w59"), (103, "Éé"), (104, "w59 " * 3000)]
    assert searched(spark, docs, items) == brute_search(docs, items)
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == []


def test_query_blocks(spark, monkeypatch):
    docs, items = random_corpus(random.Random(4), 60, 12)
    expected = brute_search(docs, items)
    monkeypatch.setattr(lexical, "ITEMS", 5)
    assert searched(spark, docs, items) == expected


def test_skipped_blocks_change_nothing(monkeypatch):
    """Small blocks and shards: most blocks are skipped, and the results are those of a full scan."""
    docs, items = random_corpus(random.Random(6), 3000, 30)
    block = lexical.Queries([], {}, [])
    for item_id, text in items:
        block.item_ids.append(item_id)
        block.terms.append({block.vocabulary.setdefault(t, len(block.vocabulary)): n for t, n in Counter(lexical.split_terms(text)).items()})
    counted = [(i, Counter(lexical.split_terms(t)), len(lexical.split_terms(t))) for i, t in docs]
    held = [[(block.vocabulary[t], n) for t, n in c.items() if t in block.vocabulary] for _, c, _ in counted]
    df = Counter(t for c in held for t, _ in c)
    weights = np.array([lexical.term_weight(len(docs), df[t]) for t in range(len(block.vocabulary))])
    corpus = lexical.Corpus(len(docs), sum(n for *_, n in counted), weights)
    batch = pa.RecordBatch.from_arrays([
        pa.array([i for i, *_ in counted]), pa.array([n for *_, n in counted]), pa.array([[t for t, _ in c] for c in held], pa.list_(pa.int32())),
        pa.array([[n for _, n in c] for c in held], pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "counts"])
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 500)
    scored = []
    keep = lexical.Search.keep
    monkeypatch.setattr(lexical.Search, "keep", lambda self, q, shard, rows: (scored.append(len(rows)), keep(self, q, shard, rows)))
    search = lexical.Search(block, corpus)
    for shard in lexical.shards([batch], corpus):
        search.add(shard)
    got = [(items[q][0], rank, i, -s) for q, best in enumerate(search.best) for rank, (s, _, i) in enumerate(best, 1)]
    assert sorted(got, key=repr) == brute_search(docs, items)
    assert sum(scored) < 0.5 * len(docs) * len(items)
