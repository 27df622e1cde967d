"""Ranked lexical search: an inverted index whose posting lists are blocked geometrically.

Documents are a term and count list each, restricted to the terms of the queries. A task indexes its
documents shard by shard. The posting list of a term is clustered by the similarity of its documents
(sketches of their weighted terms, nearest of some centres taken from the list), and each cluster, a
block, stores the coordinatewise maximum of its documents' impacts as its summary. The inner product
of a query with a summary is a bound that no document of the block exceeds. For each query term, rare
terms first, a query opens the blocks whose bound reaches the score of its tenth best document so far,
and skips the others; documents of opened blocks are scored exactly, once. What a list has settled needs no
later one, so bounds count only the terms whose lists are still to come, and a query ends when the
maxima of these lists cannot reach its tenth best score. A list of one block is opened without a
summary. So results are those of a full scan, ties included, and the tenth best score carries over
from shard to shard.

An impact is a whole number, w * ((1000000000 * tf) div (1000 * tf + 8 * m)), scores are summed in 64-bit
integers, and bounds, which doubles hold, are raised by more than their rounding. Number, length and term frequencies of all
documents are counted before the search, over the whole table. Queries are held in blocks of bounded
size, one pass over the postings each; every task sends its best few for each query, and no posting list, frequent term
or group of copies meets in one task.

Terms are lower-cased (A-Z) runs of ASCII letters, digits and all characters beyond ASCII. Defined
results: null texts have no term and are not counted; items without terms, or whose terms no document
holds, give no rows; repeated items and repeated documents rank each; documents without doc_id come last
among equals; other columns are not carried; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from struklake.llm.common import materialise

#: Documents returned for an item.
TOP = 10
#: Bounds of one block of queries: items, and items times terms.
ITEMS, CELLS = 2_000, 4_000_000
#: More than the rounding of a bound in doubles, as a share of it.
SLACK = 1e-9
#: Documents, and postings, that a task indexes at a time.
SHARD_DOCS, SHARD_POSTINGS = 10_000, 2_000_000
#: Documents a block of a posting list holds on average, and blocks of a list at most.
BLOCK, MOST_BLOCKS = 32, 128
#: Numbers of a document's sketch.
SKETCH = 24
#: Fixed values of the ranking function, as the contract states them.
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 75

#: Every byte that ends a term becomes a space, A-Z become a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))

POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
BEST = "item int, doc_id long, score long"
RESULT = "item_id long, rank int, doc_id long, score long"


def split_terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """Impact of a term of this weight that a document of n terms holds tf times, in 64-bit integers."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // max(1, length)
    return weight * ((SCALE * tf) // (1000 * tf + SATURATION * m))


@dataclass
class Queries:
    """A block of queries over numbered terms: for each, its terms and how often it has them."""

    item_ids: list[int | None]
    vocabulary: dict[bytes, int]
    terms: list[dict[int, int]]


@dataclass
class Corpus:
    """Counts over all documents: documents with terms, their terms, and the weight of each query term."""

    n_docs: int
    length: int
    weights: np.ndarray


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """The items in blocks of bounded size, read block by block."""
    block = Queries([], {}, [])
    for row in items.select("item_id", "text").toLocalIterator():
        counts = Counter(split_terms(row["text"]))
        if not counts:
            continue
        cells = (len(block.terms) + 1) * (len(block.vocabulary) + len(counts))
        if block.terms and (len(block.terms) >= ITEMS or cells > CELLS):
            yield block
            block = Queries([], {}, [])
        block.item_ids.append(row["item_id"])
        block.terms.append({block.vocabulary.setdefault(t, len(block.vocabulary)): n for t, n in counts.items()})
    if block.terms:
        yield block


def postings(docs: DataFrame, queries: Queries) -> DataFrame:
    """POSTINGS of every document with terms: its length, and the query terms it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = split_terms(text)
                if words:
                    found = Counter(map(known, words))
                    found.pop(None, None)
                    ids.append(doc_id)
                    sizes.append(len(words))
                    terms.append(list(found))
                    counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())),
            ], names=["doc_id", "n", "terms", "counts"])

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, POSTINGS))


def corpus_counts(found: DataFrame, n_terms: int) -> Corpus:
    """Counts over all documents; a number for each term of a block of queries comes to the driver."""
    n_docs, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(n_terms, dtype=np.int64)
    for term, df in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect():
        weights[term] = term_weight(n_docs, df)
    return Corpus(n_docs, length, weights)


class Shard:
    """The documents of a task at hand, as rows of (term, impact) sorted by row."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, corpus: Corpus):
        self.ids, self.starts, self.terms = ids, starts, terms
        lengths = np.repeat(sizes, np.diff(starts))
        self.impacts = impacts(corpus.weights[terms], counts, lengths, corpus.n_docs, corpus.length)
        rows = np.repeat(np.arange(len(ids)), np.diff(starts))
        order = np.argsort(terms, kind="stable")
        self.list_starts = np.searchsorted(terms[order], np.arange(len(corpus.weights) + 1, dtype=terms.dtype))
        self.list_rows = rows[order]
        self.list_maxima = np.zeros(len(corpus.weights), dtype=np.int64)
        np.maximum.at(self.list_maxima, terms, self.impacts)
        # pseudorandom signs of a term spread its impact over the sketch: likely equal for like documents
        signs = np.random.default_rng(1).choice(np.array([-1.0, 1.0]), (len(corpus.weights), SKETCH))
        self.sketches = np.zeros((len(ids), SKETCH))
        for k in range(SKETCH):
            self.sketches[:, k] = np.bincount(rows, self.impacts * signs[terms, k], len(ids))
        self.sketches /= np.maximum(np.linalg.norm(self.sketches, axis=1, keepdims=True), 1e-12)

    def posting_list(self, term: int) -> np.ndarray:
        return self.list_rows[self.list_starts[term] : self.list_starts[term + 1]]

    def blocks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block of each row, number of blocks): the rows by their nearest centre."""
        k = min(MOST_BLOCKS, -(-len(rows) // BLOCK))
        if k <= 1:
            return np.zeros(len(rows), dtype=np.int64), 1
        centres = self.sketches[rows[np.linspace(0, len(rows) - 1, k).astype(np.int64)]]
        return (self.sketches[rows] @ centres.T).argmax(axis=1), k

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of the rows, and for each the number of its row among `rows`."""
        width = self.starts[rows + 1] - self.starts[rows]
        number = np.repeat(np.arange(len(rows)), width)
        return self.starts[rows][number] + np.arange(len(number)) - np.repeat(np.cumsum(width) - width, width), number


class Search:
    """The best documents of every query over the shards it has seen."""

    def __init__(self, queries: Queries, corpus: Corpus):
        self.corpus = corpus
        self.best: list[list[tuple]] = [[] for _ in queries.terms]  # (-score, doc_id is null, doc_id)
        self.least = np.ones(len(queries.terms), dtype=np.int64)
        self.counts = np.zeros((len(queries.terms), len(corpus.weights)), dtype=np.int64)
        self.asked: dict[int, list[int]] = {}
        for q, terms in enumerate(queries.terms):
            for term, n in terms.items():
                self.counts[q, term] = n
                self.asked.setdefault(term, []).append(q)
        self.order = sorted((t for t in self.asked if corpus.weights[t] > 0), key=lambda t: (-corpus.weights[t], t))

    def add(self, shard: Shard) -> None:
        seen = np.zeros((len(self.best), len(shard.ids)), dtype=bool)
        rest = self.counts @ shard.list_maxima  # what the lists still to come can add
        ahead = np.ones(len(self.corpus.weights), dtype=bool)
        for term in self.order:
            rows = shard.posting_list(term)
            if not len(rows):
                continue
            every = np.array(self.asked[term])
            asked = every[rest[every] >= self.least[every]]
            if len(asked):
                self.search_list(shard, rows, asked, ahead, seen)
            rest[every] -= self.counts[every, term] * shard.list_maxima[term]
            ahead[term] = False

    def search_list(self, shard: Shard, rows: np.ndarray, asked: np.ndarray, ahead: np.ndarray, seen: np.ndarray) -> None:
        """Open the blocks of a posting list that the bounds of these queries do not rule out."""
        block, k = shard.blocks(rows)
        is_open = np.ones((k, len(asked)), dtype=bool)
        if k > 1:
            columns = np.flatnonzero((self.counts[asked] > 0).any(axis=0) & ahead)
            counts = self.counts[np.ix_(asked, columns)].astype(np.float64)
            is_open = (self.summaries(shard, rows, block, k, columns) @ counts.T) * (1 + SLACK) >= self.least[asked]
        for q, open_blocks in zip(asked.tolist(), is_open.T, strict=True):
            open_rows = rows[open_blocks[block] & ~seen[q, rows]]
            if len(open_rows):
                seen[q, open_rows] = True
                self.keep(q, shard, open_rows)

    def summaries(self, shard: Shard, rows: np.ndarray, block: np.ndarray, k: int, columns: np.ndarray) -> np.ndarray:
        """Coordinatewise maximum of every block's impacts, over the terms that queries of this list have."""
        column = np.full(len(self.corpus.weights), -1)
        column[columns] = np.arange(len(columns))
        places, number = shard.entries(rows)
        at = column[shard.terms[places]]
        wanted = at >= 0
        top = np.zeros(k * len(columns))
        np.maximum.at(top, block[number[wanted]] * len(columns) + at[wanted], shard.impacts[places[wanted]])
        return top.reshape(k, len(columns))

    def keep(self, q: int, shard: Shard, rows: np.ndarray) -> None:
        """Score the rows for query q, and keep the best."""
        places, number = shard.entries(rows)
        scores = np.zeros(len(rows), dtype=np.int64)
        np.add.at(scores, number, shard.impacts[places] * self.counts[q, shard.terms[places]])
        good = np.flatnonzero(scores >= self.least[q])
        if len(good) > TOP:
            cut = np.partition(scores[good], len(good) - TOP)[len(good) - TOP]
            good = good[scores[good] >= cut]
        found = [(-int(scores[i]), shard.ids[rows[i]] is None, shard.ids[rows[i]] or 0) for i in good.tolist()]
        self.best[q] = sorted([*self.best[q], *found])[:TOP]
        if len(self.best[q]) == TOP:
            self.least[q] = max(1, -self.best[q][-1][0])

    def batch(self) -> pa.RecordBatch:
        rows = [(q, None if none else doc_id, -score) for q, best in enumerate(self.best) for score, none, doc_id in best]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([
            pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
        ], names=["item", "doc_id", "score"])


def shards(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[Shard]:
    """The rows of a task in shards of bounded size; one document is never cut."""
    for batch in batches:
        sizes = batch["n"].to_numpy()
        terms, counts = batch["terms"], batch["counts"]
        flat_terms, flat_counts = terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
        starts = np.r_[0, np.cumsum(terms.value_lengths().to_numpy())].astype(np.int64)
        ids = np.array(batch["doc_id"].to_pylist(), dtype=object)
        at = 0
        while at < len(sizes):
            stop = min(at + SHARD_DOCS, max(at + 1, int(np.searchsorted(starts, starts[at] + SHARD_POSTINGS, "right")) - 1))
            low, high = starts[at], starts[stop]
            yield Shard(ids[at:stop], sizes[at:stop], starts[at : stop + 1] - low, flat_terms[low:high], flat_counts[low:high], corpus)
            at = stop


def best_documents(found: DataFrame, queries: Queries, corpus: Corpus) -> DataFrame:
    """BEST of every task, then the first TOP of every query over all tasks, with their rank."""
    shared = found.sparkSession.sparkContext.broadcast((queries, corpus))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, corpus = shared.value
        state = Search(queries, corpus)
        for shard in shards(batches, corpus):
            state.add(shard)
        yield state.batch()

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.mapInArrow(search, BEST).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= TOP)


def ranked_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """RESULT: the TOP documents of the highest score above 0 for every item."""
    spark = docs.sparkSession
    out = None
    for queries in query_blocks(items):
        found = postings(docs, queries)
        best = best_documents(found, queries, corpus_counts(found, len(queries.vocabulary)))
        named = spark.createDataFrame(list(enumerate(queries.item_ids)), "item int, item_id long")
        part = best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # ITEMS rows at most
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], RESULT) if out is None else out


_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
)

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, t, len(t) AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS length FROM d),
i AS (
    SELECT q, item_id, term, count(*) AS times
    FROM (SELECT q, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark)) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs),
scores AS (
    SELECT q, item_id, d.r, d.doc_id,
           sum(times * w * (({SCALE} * tf) // (1000 * tf + {SATURATION} * (100 - {LENGTH_SHARE} + ({LENGTH_SHARE} * n * n_docs) // length))))::BIGINT AS score
    FROM i JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), totals GROUP BY ALL)
SELECT item_id, row_number() OVER v::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW v AS (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER v <= {TOP}"""
