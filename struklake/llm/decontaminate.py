"""Benchmark decontamination: find passages of benchmark items in documents.

Windows of an item's own size slide over a document's words. SimHash codes of item and window
are compared through multi-index blocks: codes of BITS bits are cut into BLOCKS blocks, and two codes
within RADIUS bits have at least NEAR_BLOCKS blocks within REACH bits, so tables that list the items
near every block value miss no fingerprint within the radius. A window has the size of the items that it
can match, so items of each size have tables of their own and a code is held against those of its size
only. What the tables find is verified exactly: weighted Jaccard similarity (weights are counts) of the
five-word shingles, SIMILARITY or more, counted on from window to window.

Texts and items may be of any length: the signs of their shingles are summed in pieces of PIECE, and sums of
overlapping windows follow from one another, so work is linear in a text and memory does not grow with an item
but for its shingles and their counts.

A window can only reach the similarity to an item of its size if it holds a shingle of one; windows
that do not are left out before any code is computed, in one pass with a hashed bitmap. That is an
exact filter, not a sample; it names sizes, not items.

Items are a query set: they are broadcast in blocks of at most ITEMS items and WORDS_LIMIT words
each (an item that is longer by itself has a block of its own), one after the other, and larger
benchmarks take more passes.

Words are lower-cased (A-Z) runs without ASCII white space. Defined results: items of fewer than
five words have their whole word sequence as the one shingle; null or wordless items and documents
match nothing; repeated rows each give their matches; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from struklake.llm.common import materialise

WORDS, SIMILARITY = 5, 0.8
#: Code length and blocks; a code at SIMILARITY differs in 39 bits on average, sd 6.
BITS, BLOCKS = 256, 32
RADIUS = 74
#: Bits of a block that may differ in a table, and the blocks that then must be near: of RADIUS
#: differing bits no more than RADIUS // (REACH + 1) blocks can have over REACH.
REACH = RADIUS // BLOCKS
NEAR_BLOCKS = BLOCKS - RADIUS // (REACH + 1)
#: Pairs of a code and an item that are counted at a time, windows that share running sums, and shingles
#: whose signs are held at a time.
LOOKUP, SPAN, PIECE = 1_000_000, 2048, 8192
#: Bounds of one broadcast block of items.
ITEMS, WORDS_LIMIT = 5_000, 1_000_000
#: log2 of the bits of the shingle bitmap.
BITMAP = 22

MATCH = "doc_id long, item_id long, first_word int, n_words int, similarity double"


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    """64-bit hash of every word; frequent words are looked up."""
    out = []
    for w in words:
        h = memo.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(memo) < 500_000:
                memo[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_hashes(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hash of every run of `words` word hashes; of all of them if there are fewer."""
    n = min(words, len(hashes))
    if not n:
        return hashes
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : len(hashes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def stretch(shingles: np.ndarray) -> np.ndarray:
    """Signs of BITS bits for every shingle hash, as -1 and 1."""
    x = shingles[:, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def running_sums(shingles: np.ndarray, start: int, places: np.ndarray) -> np.ndarray:
    """Sums of the shingles' signs from `start` up to every place, in pieces."""
    out = np.zeros((len(places), BITS), dtype=np.int32)
    total = np.zeros(BITS, dtype=np.int32)
    last = int(places.max(initial=start))
    for low in range(start, last, PIECE):
        high = min(low + PIECE, last)
        sums = np.cumsum(stretch(shingles[low:high]), axis=0, dtype=np.int32)
        here = (places > low) & (places <= high)
        out[here] = total + sums[places[here] - low - 1]
        total = total + sums[-1]
    return out


def window_sums(shingles: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first window, sums of signs of it and those after it), SPAN windows at most that overlap.
    `first` and `end` ascend; sums go on from the window before as long as windows overlap."""
    at = low = high = 0
    while at < len(first):
        stop = at + 1
        while stop < len(first) and first[stop] < end[stop - 1] and stop - at < SPAN:
            stop += 1
        if first[at] >= high:
            both = running_sums(shingles, int(first[at]), np.concatenate([end[at:stop], first[at:stop]]))
            sums = both[: stop - at] - both[stop - at :]
        else:
            sums = sums[-1] + running_sums(shingles, high, end[at:stop]) - running_sums(shingles, low, first[at:stop])
        yield at, sums
        low, high, at = int(first[stop - 1]), int(end[stop - 1]), stop


def simhash_codes(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


class Overlap:
    """Weighted Jaccard similarity of an item and windows of a text, whose places must ascend: shingles that
    leave and enter are counted, so windows that overlap cost what they do not share."""

    def __init__(self, item: Counter, shingles: np.ndarray):
        self.item, self.size, self.shingles = item, item.total(), shingles
        self.low = self.high = self.common = 0
        self.window = Counter()

    def similarity(self, low: int, high: int) -> float:
        if low >= self.high:
            self.window.clear()
            self.low = self.high = low
            self.common = 0
        for h in self.shingles[self.high : high].tolist():
            self.common += self.window[h] < self.item.get(h, 0)
            self.window[h] += 1
        for h in self.shingles[self.low : low].tolist():
            self.window[h] -= 1
            self.common -= self.window[h] < self.item.get(h, 0)
            if not self.window[h]:
                del self.window[h]
        self.low, self.high = low, high
        return self.common / (self.size + high - low - self.common)


class CodeTables:
    """Codes of the items of one size, and for every block and value the items whose block is near it."""

    def __init__(self, items: np.ndarray, codes: np.ndarray):
        self.items, self.codes = items, codes
        values = np.arange(256, dtype=np.uint8)
        self.near = [np.bitwise_count(values[:, None] ^ codes[:, b]) <= REACH for b in range(BLOCKS)]

    def lookup(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of all codes and items within RADIUS bits: such a pair has at least NEAR_BLOCKS
        blocks within REACH bits, which the tables count; then the whole distance decides."""
        rows, items = [], []
        step = max(1, LOOKUP // len(self.items))
        for at in range(0, len(codes), step):
            part = codes[at : at + step]
            count = np.zeros((len(part), len(self.items)), dtype=np.uint8)
            for b in range(BLOCKS):
                count += self.near[b][part[:, b]]
            row, item = np.nonzero(count >= NEAR_BLOCKS)
            close = np.bitwise_count(part[row] ^ self.codes[item]).sum(axis=1) <= RADIUS
            rows.append(row[close] + at)
            items.append(self.items[item[close]])
        return np.concatenate(rows), np.concatenate(items)


class ItemIndex:
    """Codes, block tables and shingles of one block of items; built once per task."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        self.memo: dict[bytes, int] = {}
        self.similarity = similarity
        self.ids, self.shingles, widths = [], [], []
        for item_id, text in items:
            hashes = word_hashes(split_words(text), self.memo)
            if len(hashes):
                self.ids.append(item_id)
                self.shingles.append(shingle_hashes(hashes))
                widths.append(min(WORDS, len(hashes)))
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        self.kinds = [(w, len(s)) for w, s in zip(widths, self.shingles, strict=True)]
        # a window without any shingle of an item of its size has similarity 0 to all of them
        self.sizes = defaultdict(set)  # (words, shingle) -> sizes of the items that hold it
        self.bitmap = np.zeros(1 << BITMAP, dtype=bool)
        for (width, size), s in zip(self.kinds, self.shingles, strict=True):
            for h in s.tolist():
                self.sizes[width, h].add(size)
            self.bitmap[s >> np.uint64(64 - BITMAP)] = True
        sums = [running_sums(s, 0, np.array([len(s)]))[0] for s in self.shingles]
        self.codes = simhash_codes(np.array(sums).reshape(-1, BITS))
        members = defaultdict(list)  # (width, size) -> its items
        for item, kind in enumerate(self.kinds):
            members[kind].append(item)
        self.tables = {kind: CodeTables(np.array(at), self.codes[at]) for kind, at in members.items()}

    def lookup(self, codes: np.ndarray, kind: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of codes of windows of a kind and all items of that kind within RADIUS bits."""
        return self.tables[kind].lookup(codes)

    def windows(self, shingles: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, first, end): windows of the sizes of items, cut at the text's ends, that hold a
        shingle of an item of their size."""
        hits = defaultdict(list)
        for i in np.flatnonzero(self.bitmap[shingles >> np.uint64(64 - BITMAP)]).tolist():
            for size in self.sizes.get((width, int(shingles[i])), ()):
                hits[size].append(i)
        for size, places in hits.items():
            ends = np.array(places)
            new = np.diff(ends, prepend=-1)
            back = np.minimum(size, new)  # starts that no hit before has given
            start = np.repeat(ends, back) - (np.arange(back.sum()) - np.repeat(np.cumsum(back) - back, back))
            start = np.sort(np.concatenate([start, np.arange(min(0, places[0] - size + 1), 0)]))
            yield size, np.maximum(start, 0), np.minimum(start + size, len(shingles))

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity): the best window of every item in the text."""
        hashes = word_hashes(split_words(text), self.memo)
        found: dict[int, tuple] = {}
        for width in {w for w, _ in self.kinds} if len(hashes) else ():
            if len(hashes) < width:
                continue
            shingles = shingle_hashes(hashes, width)
            for size, first, end in self.windows(shingles, width):
                overlaps: dict[int, Overlap] = {}
                for row, item in self._near(shingles, first, end, (width, size)):
                    if item not in overlaps:
                        overlaps[item] = Overlap(self.counts[item], shingles)
                    low, high = int(first[row]), int(end[row])
                    score = overlaps[item].similarity(low, high)
                    if score >= self.similarity and (item not in found or (-score, low) < found[item][:2]):
                        found[item] = (-score, low, high - low + width - 1)
        return [(self.ids[i], low, n, -score) for i, (score, low, n) in sorted(found.items())]

    def _near(
        self, shingles: np.ndarray, first: np.ndarray, end: np.ndarray, kind: tuple[int, int]
    ) -> Iterator[tuple[int, int]]:
        """(window, item) pairs whose codes are within the radius, for windows in ascending order."""
        for at, sums in window_sums(shingles, first, end):
            rows, items = self.lookup(simhash_codes(sums), kind)
            yield from zip((rows + at).tolist(), items.tolist(), strict=True)


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, read block by block in the order of item_id and text."""
    block, words = [], 0
    rows = benchmark.filter("text is not null").select("item_id", "text").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        n = len(row["text"].split())
        if block and (len(block) >= ITEMS or words + n > WORDS_LIMIT):
            yield block
            block, words = [], 0
        block.append((row["item_id"], row["text"]))
        words += n
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item found in it, with the place of the best window; items that are
    listed twice give their rows twice."""
    sc = docs.sparkSession.sparkContext
    found = None
    for block in item_blocks(benchmark):
        items = sc.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items.value, similarity)
            for batch in batches:
                rows = [
                    (doc_id, *match)
                    for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
                    for match in index.matches(text)
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()),
                    pa.array(columns[4], pa.float64()),
                ], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        part = materialise(docs.select("doc_id", "text").mapInArrow(scan, MATCH))
        items.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _leaks(items: Broadcast) -> Callable[[Column], Column]:
    """Whether a text holds one of the broadcast items."""

    @F.pandas_udf("boolean")
    def leaks(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = ItemIndex(items.value, SIMILARITY)
        for texts in series:
            yield pd.Series([bool(index.matches(t)) for t in texts], dtype=bool)

    return leaks


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found."""
    sc = docs.sparkSession.sparkContext
    for block in item_blocks(benchmark):
        docs = docs.filter(~_leaks(sc.broadcast(block))(F.col("text")))
    return docs


_WORD_LIST = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
)

#: All windows that share a shingle with an item of their size, counted shingle by shingle.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORD_LIST} AS w FROM documents),
i AS (
    SELECT row_number() OVER () AS q, item_id, w, least(len(w), {WORDS}) AS k, len(w) - least(len(w), {WORDS}) + 1 AS size
    FROM (SELECT item_id, {_WORD_LIST} AS w FROM benchmark) WHERE len(w) > 0),
item_shingles AS (
    SELECT q, k, size, array_to_string(w[p + 1:p + k], ' ') AS s, count(*) AS item_n
    FROM (SELECT *, unnest(range(size)) AS p FROM i) GROUP BY ALL),
doc_shingles AS (
    SELECT r, k, n, p, array_to_string(w[p + 1:p + k], ' ') AS s
    FROM (SELECT r, w, k, len(w) - k + 1 AS n, unnest(range(len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i))),
starts AS (
    SELECT DISTINCT r, q, k, size, n, unnest(range(p - size + 1, p + 1)) AS start
    FROM doc_shingles JOIN item_shingles USING (k, s)),
windows AS (SELECT DISTINCT r, q, k, size, greatest(start, 0) AS low, least(start + size, n) AS high FROM starts),
counted AS (
    SELECT v.r, q, v.k, size, low, high, s, count(*) AS n
    FROM windows v JOIN doc_shingles g ON g.r = v.r AND g.k = v.k AND g.p >= low AND g.p < high GROUP BY ALL),
scored AS (
    SELECT r, q, c.k, c.size, low, high, sum(least(n, coalesce(item_n, 0))) AS common
    FROM counted c LEFT JOIN item_shingles x USING (q, s) GROUP BY ALL),
best AS (
    SELECT *, common / (size + high - low - common) AS similarity,
           row_number() OVER (PARTITION BY r, q ORDER BY common / (size + high - low - common) DESC, low, high) AS nth
    FROM scored)
SELECT doc_id, item_id, low::INTEGER AS first_word, (high - low + best.k - 1)::INTEGER AS n_words, similarity::DOUBLE AS similarity
FROM best JOIN d USING (r) JOIN i USING (q) WHERE nth = 1 AND similarity >= {SIMILARITY}"""
