"""SimHash near-duplicate groups.

Two linked texts differ in at most `radius` bits. Codes are cut into blocks; with BLOCKS blocks,
`radius` differing bits leave BLOCKS - radius blocks untouched, so every link meets in one of the
shards that such a choice of blocks spells out. Each shard is searched with a BK-tree inside one
task, and gives a spanning forest of its links instead of all pairs. Components come from
large-star and small-star rounds (Kiveris et al., 2014), which are joins and minima in Spark.

Near-duplicate documents for the pipeline follow the house rule of five words and a similarity of
0.8, and are decided by the shingle sets themselves. `near_copies` first takes what the codes and
their BK-trees link and keeps the links whose sets have the similarity; that joins most near copies
cheaply. At 0.8, though, 64 bits differ in ten places on average, far beyond a radius that blocks can
carry, so a set join finds the rest. Two sets of similarity 0.8 share one of the first shingles of
both, a fifth of each set in any fixed order (prefix filter; Chaudhuri et al., 2006), and from the
first one that they share enough must be left on both sides (positional filter; Xiao et al., 2008).
The order is rare shingles first, so members of a large family of lesser similarity spend their first
shingles on what is their own. Every pair that passes is decided, unless links already connect it: first
by sketches of the sets, which bound what the two have in common and rule out most pairs of a family of
lesser similarity, then by the sets themselves.

Defined results: null and empty texts have no shingle and fingerprint zero, linked like any other;
repeated rows share a fingerprint and so a group; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from struklake.llm import bktree
from struklake.llm.common import materialise
from struklake.llm.xxh64_sql import xxh64

#: Seed of the shingle hash.
SEED = 42
#: Differing bits of linked 64-bit fingerprints.
RADIUS = 3
#: Blocks a 64-bit fingerprint is cut into; BLOCKS - RADIUS of them are equal in linked ones.
BLOCKS = 5
#: House rule for stages on word shingles.
WORDS, SIMILARITY = 5, 0.8
#: Counted buckets of shingle hashes (a power of 2), and the pieces in which counts are summed.
BUCKETS, PIECES = 1 << 20, 64
#: Rounds of decisions: each takes the partners that stand so many rows before, at most, in a shard.
REACHES = (1, 16, 1 << 62)
#: Codes a task remembers, so that copies are dealt once.
SEEN = 1_000_000
#: Rows gathered before the trees of the complete shards among them are built.
ROWS = 200_000


def shingle_digests(text: str | None, words: int) -> bytes:
    """The 8-byte XXH64 digests of the word shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) <= words:
        return xxhash.xxh64_digest(b" ".join(tokens), SEED) if tokens else b""
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_digest
    return b"".join([
        digest(line[i:j], SEED) for i, j in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)
    ])


def column_sums(rows: np.ndarray) -> np.ndarray:
    """Bit counts per column of a matrix of packed bytes."""
    total = np.zeros(rows.shape[1] * 8, dtype=np.int64)
    for i in range(0, len(rows), 255):  # 255 ones fit a byte
        total += np.add.reduce(np.unpackbits(rows[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    return total


def simhash(digests: bytes) -> int:
    """64-bit fingerprint as a signed number: a bit is 1 if set in over half the shingle hashes."""
    rows = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8)
    bits = column_sums(rows) * 2 > len(rows)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def fingerprint(text: str | None, words: int = 3) -> int:
    return simhash(shingle_digests(text, words))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return distinct_hashes(shingle_digests(text, words))


def distinct_hashes(digests: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(digests, dtype=">u8").astype(np.uint64))


def set_code(hashes: np.ndarray) -> int:
    """64-bit code of a set as a signed number: equal sets have equal codes."""
    return int.from_bytes(xxhash.xxh64_digest(hashes.tobytes(), SEED), "big", signed=True)


def fingerprints(text: Column, words: int) -> Column:
    @F.pandas_udf("long")
    def code(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return code(text)


def whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted batches, regrouped so that a shard (`part`, `key`) is never cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        part, key = table["part"].to_numpy(), table["key"].to_numpy()
        last = np.flatnonzero((part != part[-1]) | (key != key[-1]))
        whole = int(last[-1]) + 1 if len(last) else 0
        if whole:
            yield {c: table[c].to_numpy()[:whole] for c in table.column_names}
        held, rows = table.slice(whole).to_batches(), len(table) - whole
    if rows:
        table = pa.Table.from_batches(held)
        yield {c: table[c].to_numpy() for c in table.column_names}


def shard_numbers(part: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[False, (part[1:] != part[:-1]) | (key[1:] != key[:-1])])


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask for each choice of blocks - radius of the blocks, as signed numbers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(one, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def code_links(codes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(src, dst) links that connect all distinct `code` values within the radius."""
    masks = block_masks(blocks, radius)
    shards = codes.select(
        F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "key"),
        "code",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_shards(batches):
            code = group["code"].view(np.uint64)
            a, b = bktree.spanning(shard_numbers(group["part"], group["key"]), code, radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group["code"][a]), pa.array(group["code"][b])], names=["src", "dst"]
            )

    return (
        shards.repartition("part", "key")
        .sortWithinPartitions("part", "key", "code")
        .mapInArrow(search, "src long, dst long")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with a link.

    Every round writes its edges to the shared folder; minima are combined before they are
    shuffled, and joins on busy nodes are plain sort-merge joins, which Spark splits if skewed."""
    edges = materialise(
        links.filter("src != dst").select(
            F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
        ).distinct()
    )
    last = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(
                edges.select("dst", "dst")
            ).distinct()
        last = state
        both = edges.union(edges.select("dst", "src"))
        low = both.groupBy("src").agg(F.min("dst").alias("low"))
        large = (
            both.filter("dst > src").join(low, "src")
            .select(F.col("dst").alias("src"), F.least("low", "src").alias("dst")).distinct()
        )
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(
            F.explode(F.array(
                F.struct(F.col("src").alias("src"), F.col("low").alias("dst")),
                F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")),
            )).alias("e")
        ).select("e.src", "e.dst")
        edges = materialise(small.filter("src != dst").distinct())


def near_groups(docs: DataFrame, words: int = 3, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, fingerprint and component_id, the smallest doc_id that links
    of at most `radius` differing bits reach."""
    coded = materialise(docs.select("doc_id", fingerprints(F.col("text"), words).alias("code")))
    codes = materialise(coded.groupBy("code").agg(F.min("doc_id").alias("first_id")))
    roots = components(code_links(codes, radius, blocks))
    rooted = materialise(
        codes.join(roots, codes["code"] == roots["node"], "left").select(
            "code", "first_id", F.coalesce("root", "code").alias("root")
        )
    )
    owner = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = rooted.join(owner, "root").select("code", "component_id")
    return coded.join(groups, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )


def set_codes(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, code, print) of every document, the code of its shingle set and its fingerprint, and the
    shingles of the table counted in BUCKETS."""
    size = BUCKETS // PIECES
    schema = "doc_id long, code long, print long, piece int, counts binary"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        names = ["doc_id", "code", "print", "piece", "counts"]
        for batch in batches:
            codes, prints = [], []
            for text in batch["text"].to_pylist():
                digests = shingle_digests(text, words)
                hashes = distinct_hashes(digests)
                np.add.at(counts, _bucket(hashes), 1)
                codes.append(set_code(hashes))
                prints.append(simhash(digests))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(codes, pa.int64()), pa.array(prints, pa.int64()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if counts.any():
            none = pa.nulls(PIECES, pa.int64())
            yield pa.RecordBatch.from_arrays([
                none, none, none, pa.array(range(PIECES), pa.int32()),
                pa.array([c.tobytes() for c in counts.reshape(PIECES, size)], pa.binary()),
            ], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch["piece"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(counts, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary()),
        ], names=["piece", "counts"])

    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        code, schema))
    total = np.zeros((PIECES, size), dtype=np.int64)
    summed = rows.filter("piece is not null").select("piece", "counts").repartition("piece")
    for piece, counts in summed.mapInArrow(add, "piece int, counts binary").collect():  # BUCKETS numbers in all
        total[piece] = np.frombuffer(counts, dtype=np.int64)
    return rows.filter("piece is null").select("doc_id", "code", "print"), total.ravel()


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def first_shingles(docs: DataFrame, counts: np.ndarray, words: int, similarity: float) -> DataFrame:
    """(part, key, n, code, at): the shingles of every set, rare ones first, of which a set of at
    least this similarity has one among its own; n is the set's size."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held, rows = [], 0
            for text in batch["text"].to_pylist():
                hashes = shingle_set(text, words)
                n, code = len(hashes), set_code(hashes)
                if not n or code in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(code)
                first = np.lexsort((hashes, shared.value[_bucket(hashes)]))[: n - math.ceil(similarity * n - 1e-9) + 1]
                held.append((hashes[first], n, code))
                rows += len(first)
                if rows > ROWS:
                    yield _dealt(held)
                    held, rows = [], 0
            if held:
                yield _dealt(held)

    return docs.select("text").mapInArrow(deal, "part int, key long, n int, code long, at int")


def _dealt(sets: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
    sizes = [len(s) for s, _, _ in sets]
    return pa.RecordBatch.from_arrays([
        pa.array(np.zeros(sum(sizes), dtype=np.int32)), pa.array(np.concatenate([s for s, _, _ in sets]).view(np.int64)),
        pa.array(np.repeat(np.array([n for _, n, _ in sets], dtype=np.int32), sizes)),
        pa.array(np.repeat(np.array([c for _, _, c in sets], dtype=np.int64), sizes)),
        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])),
    ], names=["part", "key", "n", "code", "at"])


def partners(
    run: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float, low: int = 0, high: int = 1 << 62,
    root: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and partners, `low` < row - partner <= `high`, of runs sorted by n, that sizes and
    places leave a chance of the similarity, and that have different roots if these are given."""
    share = similarity / (1 + similarity)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(run)]))
    depth = np.arange(len(run)) - starts[number]
    row = np.flatnonzero(depth > low)
    first_other = None if root is None else _first_other(run, root)
    step = low + 1
    while len(row) and step <= high:
        row = row[(depth[row] >= step) & (n[row - step] >= similarity * n[row] - 1e-6)]  # all before are smaller
        if root is not None:  # a row goes on only while some row further before has another root
            row = row[first_other[row] <= row - step]
        other = row - step
        left = np.minimum(n[row] - at[row], n[other] - at[other])
        good = left >= share * (n[row] + n[other]) - 1e-6
        if root is not None:
            good &= root[row] != root[other]
        if good.any():
            yield row[good], other[good]
        step += 1


def _first_other(run: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For every row the first row of its run that has another root; its own place if there is none before."""
    if not len(run):
        return np.zeros(0, dtype=np.int64)
    place = np.arange(len(run))
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    first = np.repeat(start, np.diff(np.r_[start, len(run)]))
    change = np.where(root != root[first], place, len(run))
    # the run's first row serves all of another root; rows of its root have the first change
    later = np.minimum.reduceat(change, start)
    later = np.repeat(later, np.diff(np.r_[start, len(run)]))
    return np.where(root != root[first], first, np.minimum(later, place))


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, group_id) of every document: groups of texts linked by a Jaccard similarity of at
    least `similarity` of their sets of word shingles."""
    coded, counts = set_codes(docs, words)
    first = materialise(coded.groupBy("code").agg(F.min("doc_id").alias("first_id"), F.min("print").alias("print")))

    def with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_shards(batches):
            new = np.r_[True, (group["key"][1:] != group["key"][:-1]) | (group["code"][1:] != group["code"][:-1])]
            group = {c: v[new] for c, v in group.items()}  # copies from other tasks
            keep = np.zeros(len(group["key"]), dtype=bool)
            for a, b in partners(shard_numbers(group["part"], group["key"]), group["n"], group["at"], similarity):
                keep[a] = keep[b] = True
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in group.values()], names=list(group))

    kind = "part int, key long, n int, code long, at int"
    shards = materialise(
        first_shingles(docs, counts, words, similarity)
        .repartition("part", "key").sortWithinPartitions("part", "key", "n", "code")
        .mapInArrow(with_partner, kind)
    )
    sets = materialise(_sets(docs, first.join(shards.select("code").distinct(), "code"), words))
    tested = materialise(_decided(_print_pairs(first), sets, similarity))
    roots = roots_with(None, tested)
    for low, high in zip((0, *REACHES), REACHES, strict=False):
        found = shards.join(roots, shards["code"] == roots["node"], "left").select(
            *shards.columns, F.coalesce("root", "code").alias("root"))
        # nothing is left to decide where one root holds all, or where no row is as far from another as this round looks
        mixed = materialise(
            found.groupBy("part", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"))
            .filter(f"low != high AND rows > {low + 1}").select("part", "key")
        )
        if mixed.isEmpty():  # nor can later rounds find any: roots only merge, and they look further back
            break
        pairs = _apart(found.join(mixed, ["part", "key"], "left_semi"), similarity, low, high)
        checked = materialise(_decided(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), sets, similarity))
        tested = tested.unionByName(checked)
        roots = roots_with(roots, checked)
    rooted = materialise(first.join(roots, first["code"] == roots["node"], "left").select(
        "code", "first_id", F.coalesce("root", "code").alias("root")))
    owner = rooted.groupBy("root").agg(F.min("first_id").alias("group_id"))
    return coded.join(rooted.join(owner, "root").select("code", "group_id"), "code").select("doc_id", "group_id")


def _print_pairs(first: DataFrame) -> DataFrame:
    """(a, b) codes whose fingerprints are equal or linked by the BK-trees."""
    by_print = first.groupBy("print").agg(F.min("code").alias("one"))
    links = code_links(by_print.select(F.col("print").alias("code")))
    linked = (
        links.join(by_print.toDF("src", "x"), "src").join(by_print.toDF("dst", "y"), "dst").select("x", "y")
        .unionByName(first.join(by_print, "print").select(F.col("code").alias("x"), F.col("one").alias("y")))
    )
    return linked.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def roots_with(known: DataFrame | None, decided: DataFrame) -> DataFrame:
    """(node, root) of all linked nodes once the near pairs of `decided` (a, b, near) join the `known` (node, root).
    Only roots that a new link joins to another take part in the search; what is connected already is not searched again."""
    links = decided.filter("near").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if known is None:
        return materialise(components(links))
    ends = (
        links.join(known.toDF("src", "x"), "src", "left").join(known.toDF("dst", "y"), "dst", "left")
        .select(F.coalesce("x", "src").alias("src"), F.coalesce("y", "dst").alias("dst"))
    )
    merged = materialise(components(ends))
    moved = known.join(merged.toDF("root", "lower"), "root", "left").select("node", F.coalesce("lower", "root").alias("root"))
    return materialise(moved.unionByName(merged.join(known, "node", "left_anti")))


def count_sketch(hashes: np.ndarray) -> bytes | None:
    """Counts of a set's hashes by their low bits, a byte for each of about as many buckets as there are hashes; None if one
    does not fit."""
    buckets = 1 << max(4, (len(hashes) - 1).bit_length() if len(hashes) else 0)
    counts = np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def most_common(x: bytes, y: bytes) -> tuple[int, int]:
    """What two sets can have in common at most, and their sizes together, from their sketches: no bucket has more in
    common than the smaller of its counts. The finer sketch is folded to the coarser one."""
    a, b = (np.frombuffer(v, dtype=np.uint8).astype(np.int64) for v in (x, y))
    sizes = int(a.sum() + b.sum())
    if len(a) < len(b):
        a, b = b, a
    a = a.reshape(-1, len(b)).sum(axis=0)
    return int(np.minimum(a, b).sum()), sizes


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(code, hashes, sketch) of the wanted (code, first_id), one row each."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, shingle_set(t, words)) for c, t in zip(batch["code"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            rows = [(c, s) for c, s in rows if set_code(s) == c]  # rows may share a doc_id
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in rows], pa.int64()), pa.array([s.tobytes() for _, s in rows], pa.binary()),
                 pa.array([count_sketch(s) for _, s in rows], pa.binary())], names=["code", "hashes", "sketch"])

    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("first_id")).select("code", "text")
    return texts.mapInArrow(hashed, "code long, hashes binary, sketch binary").dropDuplicates(["code"])


def _apart(shards: DataFrame, similarity: float, low: int, high: int) -> DataFrame:
    """(a, b) codes of partners in a shard that are not connected yet."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_shards(batches):
            run, root, code = shard_numbers(group["part"], group["key"]), group["root"], group["code"]
            for a, b in partners(run, group["n"], group["at"], similarity, low, high, root):
                x, y = code[a], code[b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return (
        shards.repartition("part", "key").sortWithinPartitions("part", "key", "n", "code")
        .mapInArrow(search, "a long, b long").distinct()
    )


def tried_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, possible): whether the sketches of both sets leave a chance of the similarity."""
    def try_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            possible = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                if x is None or y is None:
                    possible.append(True)
                else:
                    common, sizes = most_common(x, y)
                    possible.append(common * (1 + similarity) >= similarity * sizes - 1e-6)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(possible, pa.bool_())], names=["a", "b", "possible"])

    sketches = sets.select("code", "sketch")
    return (
        pairs.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b")
        .select("a", "b", "x", "y").mapInArrow(try_all, "a long, b long, possible boolean")
    )


def _decided(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, near): whether the sets of both codes have at least the similarity. Sets travel only for pairs that their
    sketches do not rule out."""
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                near.append(common / (len(both) - common) >= similarity)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(near, pa.bool_())], names=["a", "b", "near"])

    tried = materialise(tried_pairs(pairs, sets, similarity))
    hashes = sets.select("code", "hashes")
    decided = (
        tried.filter("possible").join(hashes.toDF("a", "x"), "a").join(hashes.toDF("b", "y"), "b")
        .select("a", "b", "x", "y").mapInArrow(decide, "a long, b long, near boolean")
    )
    return decided.unionByName(tried.filter("not possible").select("a", "b", F.lit(False).alias("near")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of which no smaller doc_id is a near copy; of rows that share a doc_id one
    stays. Rows without a doc_id all stay, for nothing can name the one to keep."""
    groups = near_copies(docs.filter("doc_id is not null"))
    kept = groups.filter("doc_id = group_id").select("doc_id")
    one = docs.join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


_WORDS_OF = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
)
_BITS = " + ".join(
    f"CASE WHEN 2 * count(*) FILTER (h // {1 << b}::UBIGINT % 2 = 1) > count(*) THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64)
)

ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_OF} AS w FROM documents),
shingles AS (
    SELECT r, hex(encode(array_to_string(w[p + 1:p + 3], ' '))) AS x
    FROM (SELECT r, w, unnest(range(greatest(len(w) - 2, 1))) AS p FROM d WHERE len(w) > 0)),
apart AS MATERIALIZED (SELECT DISTINCT x FROM shingles),
{xxh64('apart', SEED)},
known AS MATERIALIZED (SELECT x, h FROM hashed),
codes AS (SELECT r, ({_BITS})::UBIGINT AS code FROM shingles JOIN known USING (x) GROUP BY r),
coded AS (SELECT doc_id, coalesce(code, 0::UBIGINT) AS code FROM d LEFT JOIN codes USING (r)),
kinds AS (SELECT code, min(doc_id) AS first_id FROM coded GROUP BY code),
links AS (SELECT a.code AS a, b.code AS b, b.first_id FROM kinds a JOIN kinds b ON bit_count(xor(a.code, b.code)::HUGEINT) <= {RADIUS}),
reached AS (
    SELECT a, b, first_id FROM links
    UNION
    SELECT r.a, l.b, l.first_id FROM reached r JOIN links l ON r.b = l.a),
groups AS (SELECT a AS code, min(first_id) AS component_id FROM reached GROUP BY a)
SELECT doc_id, lower(lpad(hex(code), 16, '0')) AS fingerprint, component_id FROM coded JOIN groups USING (code)"""
