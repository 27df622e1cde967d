"""Removal of byte strings that occur more than once anywhere in the corpus.

A byte goes if a LENGTH-byte string that covers it also starts anywhere else. The suffix
structure is sampled, as in induced sorting: of every LENGTH-byte window only the K-byte substring
with the smallest hash is an anchor, and all windows that share an anchor form one segment. Equal
windows have equal anchors at equal places, so everything is induced from the sample:

1. anchors and segment hashes are shuffled once by anchor (Spark sorts and spills them);
2. an anchor that occurs once settles all its windows as unique;
3. segments that are equal as a whole are repeated as a whole;
4. only where equal anchors stand in different segments (the ends of a repeat) are the windows
   compared, one representative for each group of equal segments: in strips of STRIP windows, which
   are unique as a whole unless the bytes that all of them cover (the core) occur again, and
   otherwise differ only in the few bytes before and after the core, which travel with it.

Frequent anchors and cores never gather in one task. A task combines HELD segments or strips before
it sends them: of equal ones one goes out for all; an anchor that stands there in several segments is
open without any other task's rows, so these are dealt by segment and only one mark goes to the
anchor's own task; windows of a core that stands there in several strips are compared at once, and
dealt by window. So of any anchor, core or window a task receives no more rows than there are such
parcels of HELD, and runs of one repeated character or phrase are one row.

Hashes are two independent 64-bit polynomials. Two segments count as equal if their anchors' 64 bits
and the 64 bits of all their bytes are; strips if the core's 128 bits and the bytes around it are;
windows if two hashes of these are.

External induced sorting with disk-backed queues, the method named for this operator, is not what is
built; the README gives the figures.

Defined results: a null text counts as empty; texts under LENGTH bytes lose nothing; repeated rows
lose all their LENGTH-byte strings; an empty table gives an empty result. Matches never cross
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from struklake.llm.common import materialise

#: Bytes of a repeated string, and of an anchor inside it.
LENGTH, K = 200, 64
#: Windows of a strip.
STRIP = 16
#: Windows handled at a time, and segments or strips that a task combines before it sends them.
CHUNK = 1 << 19
HELD = 300_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Polynomials:
    """Two rolling hashes of bytes modulo 2^64 with random digits and odd bases."""

    def __init__(self, size: int = CHUNK + 3 * LENGTH):
        rng = np.random.default_rng(20)
        self.digit = [rng.integers(0, 2**64, 256, dtype=np.uint64) for _ in range(2)]
        bases = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
        self.up = [_powers(b, size) for b in bases]
        self.down = [_powers(pow(b, -1, 2**64), size) for b in bases]

    def sums(self, which: int, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.digit[which][data] * self.up[which][: len(data)], out=out[1:])
        return out

    def between(self, which: int, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[which][start])

    def runs(self, which: int, sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - width
        return mixed((sums[width:] - sums[:n]) * self.down[which][:n])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row, from prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, hashes: Polynomials, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """(lo, hi, anchor place, anchor hash, segment hash): windows lo to hi share an anchor."""
    for at in range(0, len(data) - LENGTH + 1, chunk):
        part = data[at : at + chunk + LENGTH - 1]
        sums = hashes.sums(0, part)
        anchors = hashes.runs(0, sums, K)
        place = np.arange(len(anchors), dtype=np.uint64)
        # the smallest hash wins, the leftmost of equal ones
        ranked = (mixed(anchors) & ~np.uint64(2**20 - 1)) | place
        chosen = (sliding_min(ranked, LENGTH - K + 1) & np.uint64(2**20 - 1)).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        hi = np.r_[lo[1:], len(chosen)] - 1
        sig = hashes.between(1, hashes.sums(1, part), lo, hi + LENGTH)
        # what stands before the anchor is part of the segment's identity
        sig = mixed(sig ^ ((chosen[lo] - lo).astype(np.uint64) << np.uint64(32)) ^ (hi - lo).astype(np.uint64))
        yield lo + at, hi + at, chosen[lo] + at, anchors[chosen[lo]], sig


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


#: Kinds of rows that tasks send out: runs that are known to repeat, rows that stand alone in their
#: task, rows whose anchor (or core) stands there in other company too, and marks of such anchors.
DONE, LONE, MIXED, MARK = range(4)


def _spread(*numbers: np.ndarray) -> np.ndarray:
    """A hash of several numbers, by which rows are dealt evenly."""
    out = np.zeros(len(numbers[0]), dtype=np.uint64)
    for n in numbers:
        out = mixed(mixed(out ^ n.astype(np.int64).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _merged(document: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining runs of a document as one: (row of the first, lo, hi); rows come in order."""
    if not len(lo):
        return lo, lo, hi
    first = np.flatnonzero(np.r_[True, (document[1:] != document[:-1]) | (lo[1:] > hi[:-1] + 1)])
    return first, lo[first], hi[np.r_[first[1:], len(lo)] - 1]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of the keys, and the number of the group that each of these belongs to."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new)


def _combined(document, lo, hi, place, anchor, sig) -> Iterator[tuple[np.ndarray, ...]]:
    """(kind, row, lo, hi, place, key, sig) of a task's segments: of equal ones the first stands for
    all, and anchors that are frequent here are dealt by segment, so no anchor gathers in one task."""
    order, segment = _groups(anchor, sig)
    first = np.flatnonzero(np.diff(segment, prepend=-1))
    one = order[first]
    often = np.bincount(segment)[segment] > 1
    done = np.sort(order[often])
    at, run_lo, run_hi = _merged(document[done], lo[done], hi[done])
    zero = np.zeros(len(at), dtype=np.int64)
    row = done[at]
    yield np.full(len(at), DONE), row, run_lo, run_hi, zero, _spread(row, run_lo, anchor[row]), zero
    new = np.diff(anchor[one], prepend=anchor[one][:1] - 1) != 0
    company = np.bincount(np.cumsum(new) - 1)
    several = company[np.cumsum(new) - 1] > 1
    key = np.where(several, _spread(anchor[one], sig[one]), anchor[one])
    yield np.where(several, MIXED, LONE), one, lo[one], hi[one], place[one], key, sig[one]
    marked = one[new & several]
    zero = np.zeros(len(marked), dtype=np.int64)
    yield np.full(len(marked), MARK), marked, zero, zero, zero, anchor[marked], zero


def _find_segments(batches: Iterator[pa.RecordBatch], most: int, chunk: int) -> Iterator[pa.RecordBatch]:
    hashes = Polynomials()
    held: list[list[np.ndarray]] = []
    ids: list[tuple[int, int]] = []
    n = 0

    def sent() -> Iterator[pa.RecordBatch]:
        row_id, text_key = (np.array(c, dtype=np.int64) for c in zip(*ids, strict=True))
        document, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
        for kind, row, lo, hi, place, key, sig in _combined(document, *columns):
            of = document[row]
            yield pa.RecordBatch.from_arrays([
                pa.array(row_id[of]), pa.array(text_key[of]), *[pa.array(c).cast(pa.int32()) for c in (lo, hi, place)],
                pa.array(key), pa.array(sig), pa.array(kind.astype(np.int8)),
            ], names=["row_id", "text_key", "lo", "hi", "place", "key", "sig", "kind"])

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("row_id", "text_key", "text")]
        for row_id, key, text in zip(*columns, strict=True):
            data = _bytes(text)
            if len(data) < LENGTH:
                continue
            for lo, hi, place, anchor, sig in segments(data, hashes, chunk):
                held.append([np.full(len(lo), len(ids)), lo, hi, place, anchor.view(np.int64), sig.view(np.int64)])
                n += len(lo)
            ids.append((row_id, key))
            if n > most:
                yield from sent()
                held, ids, n = [], [], 0
    if n:
        yield from sent()


STRIPS = ["row_id", "text_key", "lo", "hi", "place", "core", "core2", "before", "after", "key", "key2", "kind"]


def _find_strips(batches: Iterator[pa.RecordBatch], most: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """The listed segments in strips: windows lo to hi, the place of the core (the last start that the
    strip can have), two hashes of the core, and the bytes around it."""
    hashes = Polynomials()
    held: list[list[np.ndarray]] = []
    around: list[tuple[bytes, bytes]] = []
    n = 0
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("row_id", "text_key", "text", "los", "his", "places")]
        for row_id, key, text, *lists in zip(*columns, strict=True):
            data = _bytes(text)
            lo, hi, place = (np.array(x, dtype=np.int64) for x in lists)
            low, high = (place - hi) // STRIP, (place - lo) // STRIP
            size = high - low + 1
            seg = np.repeat(np.arange(len(lo)), size)
            strip = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size) + low[seg]
            core = place[seg] - STRIP * strip
            first, last = np.maximum(lo[seg], core - STRIP + 1), np.minimum(hi[seg], core)
            end = core - STRIP + 1 + LENGTH
            two = np.zeros((2, len(seg)), dtype=np.uint64)
            for at in range(0, len(data), chunk):
                here = np.flatnonzero((core >= at) & (core < at + chunk))
                if len(here):
                    part = data[at : at + chunk + LENGTH]
                    for k in range(2):
                        two[k, here] = hashes.between(k, hashes.sums(k, part), core[here] - at, end[here] - at)
            held.append([np.full(len(seg), row_id), np.full(len(seg), key), first, last, core, *two.view(np.int64)])
            raw = data.tobytes()
            around += [
                (raw[f:c], raw[e : t + LENGTH])
                for f, t, c, e in zip(first.tolist(), last.tolist(), core.tolist(), end.tolist(), strict=True)
            ]
            n += len(seg)
            if n > most:
                yield from _sent_strips([np.concatenate(c) for c in zip(*held, strict=True)], around)
                held, around, n = [], [], 0
    if n:
        yield from _sent_strips([np.concatenate(c) for c in zip(*held, strict=True)], around)


def _sent_strips(columns: list[np.ndarray], around: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """A task's strips. Where a core stands in several of them, their windows are compared here: equal
    ones are done and the first stands for all; what is left is dealt by window, not by core."""
    row_id, text_key, lo, hi, place, core, core2 = columns
    order, group = _groups(core, core2)
    often = np.bincount(group)[group] > 1
    alone = np.sort(order[~often])
    yield from _strip_rows(LONE, columns, around, alone, lo[alone], hi[alone], core[alone], core2[alone])
    marked = order[np.flatnonzero(np.diff(group, prepend=-1))]
    marked = marked[np.isin(marked, order[often])]
    yield from _strip_rows(MARK, columns, around, marked, lo[marked], lo[marked] - 1, core[marked], core2[marked])
    number = np.zeros(len(order), dtype=np.int64)
    number[order] = group
    seen: dict[tuple[int, bytes, bytes], list] = {}  # window: [its first (strip, start), how often]
    listed = []
    for i in np.sort(order[often]).tolist():
        before, after = around[i]
        first, last, at = int(lo[i]), int(hi[i]), int(place[i])
        for start in range(first, last + 1):
            window = (int(number[i]), before[start - first :], after[: start - (at - STRIP + 1)])
            entry = seen.setdefault(window, [(i, start), 0])
            entry[1] += 1
            listed.append((i, start, entry))
    for kind, some in (
        (MIXED, [(i, start) for i, start, entry in listed if entry[0] == (i, start)]),
        (DONE, [(i, start) for i, start, entry in listed if entry[1] > 1]),
    ):
        if some:
            strip, start = (np.array(c, dtype=np.int64) for c in zip(*some, strict=True))
            at, run_lo, run_hi = _merged(strip, start, start)
            strip = strip[at]
            keys = _spread(row_id[strip], text_key[strip], run_lo), np.zeros(len(strip), dtype=np.int64)
            yield from _strip_rows(kind, columns, around, strip, run_lo, run_hi, *keys)


def _strip_rows(kind, columns, around, strip, lo, hi, key, key2) -> Iterator[pa.RecordBatch]:
    row_id, text_key, first, last, place, core, core2 = columns
    for at in range(0, len(strip), 50_000):
        s, a, z = strip[at : at + 50_000], lo[at : at + 50_000], hi[at : at + 50_000]
        pieces = [(b"", b"")] * len(s)
        if kind in (LONE, MIXED):
            pieces = [
                (around[i][0][x - f :], around[i][1][: max(0, y - (p - STRIP + 1))])
                for i, x, y, f, p in zip(s.tolist(), a.tolist(), z.tolist(), first[s].tolist(), place[s].tolist(), strict=True)
            ]
        before, after = zip(*pieces, strict=True)
        yield pa.RecordBatch.from_arrays([
            pa.array(row_id[s]), pa.array(text_key[s]), *[pa.array(c).cast(pa.int32()) for c in (a, z, place[s])],
            pa.array(core[s]), pa.array(core2[s]), pa.array(before, pa.binary()), pa.array(after, pa.binary()),
            pa.array(key[at : at + 50_000]), pa.array(key2[at : at + 50_000]), pa.array(np.full(len(s), kind, dtype=np.int8)),
        ], names=STRIPS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that stay, and the removed runs as start and end lists."""
    for batch in batches:
        los, his = batch["los"], batch["his"]
        kept, starts, ends, sizes = [], [], [], []
        for i, text in enumerate(batch["text"].to_pylist()):
            data = _bytes(text)
            first = np.array(los[i].as_py() or [], dtype=np.int64)
            last = np.array(his[i].as_py() or [], dtype=np.int64) + LENGTH
            change = np.zeros(len(data) + 2, dtype=np.int64)
            np.add.at(change, first + 1, 1)
            np.add.at(change, last + 1, -1)
            inside = np.cumsum(change) > 0  # shifted by one, so that edges show at both ends
            edge = np.diff(inside.astype(np.int8))
            starts.append(np.flatnonzero(edge == 1))
            ends.append(np.flatnonzero(edge == -1))
            kept.append(data[~inside[1:-1]].tobytes())
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays([
            batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()),
            pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
        ], names=["doc_id", "n_bytes", "kept", "starts", "ends"])


def without_repeats(docs: DataFrame, held: int = HELD, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay) and the removed runs [starts, ends)."""
    # Null ids travel as -1: together with the text's hash they still name the rows. Both joins
    # below read the same columns of `keyed`, so its texts are shuffled once.
    keyed = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("row_id"),
        F.xxhash64("text").alias("text_key"), "text",
    )
    found = keyed.select("row_id", "text_key", "text").mapInArrow(
        partial(_find_segments, most=held, chunk=chunk), "row_id long, text_key long, lo int, hi int, place int, key long, sig long, kind byte"
    )
    by_key, by_segment = Window.partitionBy("key"), Window.partitionBy("key", "sig")
    repeated = materialise(
        found.withColumns({
            "n": F.count(F.lit(1)).over(by_key),
            "mixed": (F.min("sig").over(by_key) != F.max("sig").over(by_key)) | (F.max("kind").over(by_key) == MARK),
        })
        .filter(f"kind in ({DONE}, {MIXED}) or (kind = {LONE} and n > 1)")
        .withColumns({
            "whole": (F.count(F.lit(1)).over(by_segment) > 1) | (F.col("kind") == DONE),
            "nth": F.row_number().over(by_segment.orderBy("row_id", "text_key", "lo")),
        })
        .withColumn("open", ((F.col("kind") == MIXED) | ((F.col("kind") == LONE) & F.col("mixed"))) & (F.col("nth") == 1))
        .filter("whole or open")
        .select("row_id", "text_key", "lo", "hi", "place", "whole", "open")
    )
    unsettled = repeated.filter("open").groupBy("row_id", "text_key").agg(
        F.collect_list(F.struct("lo", "hi", "place")).alias("open_segments")
    ).withColumnsRenamed({"row_id": "__row", "text_key": "__key"})
    same = (F.col("row_id") == F.col("__row")) & (F.col("text_key") == F.col("__key"))
    strips = (
        keyed.join(unsettled.hint("merge"), same)
        .select("doc_id", "row_id", "text_key", "text", F.col("open_segments.lo").alias("los"),
                F.col("open_segments.hi").alias("his"), F.col("open_segments.place").alias("places"))
        .mapInArrow(partial(_find_strips, most=held, chunk=chunk),
                    "row_id long, text_key long, lo int, hi int, place int, core long, core2 long, "
                    "before binary, after binary, key long, key2 long, kind byte")
    )
    # Of equal strips the first stands for all when single windows are compared; a null start is the
    # strip as a whole, which is repeated if it has an equal.
    by_core = Window.partitionBy("key", "key2")
    by_strip = Window.partitionBy("key", "key2", "before", "after", F.expr("place - lo"), F.expr("place - hi"))
    checked = (
        strips.withColumns({
            "n": F.count(F.lit(1)).over(by_core), "marked": F.max("kind").over(by_core) == MARK})
        .filter(f"kind in ({DONE}, {MIXED}) or (kind = {LONE} and n > 1)")
        .withColumns({
            "whole": (F.count(F.lit(1)).over(by_strip) > 1) & (F.col("kind") == LONE),
            "nth": F.row_number().over(by_strip.orderBy("row_id", "text_key", "lo")),
        })
    )
    back, left = F.expr("place - start"), F.expr("substring(before, start - lo + 1)")
    right = F.expr(f"substring(after, 1, start - (place - {STRIP - 1}))")
    single = F.col("start").isNotNull()
    windows = (
        checked.withColumn("start", F.explode(F.expr(
            f"if(kind = {DONE}, array(null), if(nth > 1, array(null), "
            "if(whole, concat(array(null), sequence(lo, hi)), sequence(lo, hi))))")))
        .select(
            "row_id", "text_key", "key", "key2", "start", ((F.col("kind") == MIXED) | F.col("marked")).alias("elsewhere"),
            F.coalesce("start", "lo").alias("lo"), F.coalesce("start", "hi").alias("hi"),
            # 128 bits of the window; rows without a start are dealt by their place
            F.when(single, F.xxhash64("core", back, left, right)).otherwise(F.xxhash64("row_id", "lo")).alias("w"),
            F.when(single, F.xxhash64("core2", right, left, back)).alias("w2"),
        )
        .withColumn("n", F.count("start").over(Window.partitionBy("key", "key2", "w", "w2")))
        # only windows whose core stands in several strips of a task can have equals under another key
        .filter("start is null or n > 1 or elsewhere")
        .select("row_id", "text_key", "start", "lo", "hi", "w", "w2", "n")
        .withColumn("all", F.count("start").over(Window.partitionBy("w", "w2")))
        .filter('start is null or n > 1 or `all` > 1')
    )
    runs = (
        repeated.filter("whole").select("row_id", "text_key", "lo", "hi")
        .unionByName(windows.select("row_id", "text_key", "lo", "hi"))
        .groupBy("row_id", "text_key")
        .agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
        .withColumnsRenamed({"row_id": "__row", "text_key": "__key"})
    )
    return (
        keyed.join(runs.hint("merge"), same, "left")
        .select("doc_id", "row_id", "text_key", "text",
                F.col("runs.lo").alias("los"), F.col("runs.hi").alias("his"))
        .mapInArrow(_cut, "doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>")
    )


def removal_digest(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, and the SHA-256 of what stays."""
    return without_repeats(docs).select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = f"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, h, unnest(range(length(h) // 2 - {LENGTH - 1})) AS p FROM d),
k AS (SELECT r, p, md5(substr(h, 2 * p + 1, {2 * LENGTH})) AS m FROM w),
q AS (SELECT r, p FROM (SELECT *, count(*) OVER (PARTITION BY m) AS n FROM k) WHERE n > 1),
g AS (SELECT *, p > {LENGTH} + lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM q),
s AS (SELECT *, sum(coalesce(gap, false)::INT) OVER (PARTITION BY r ORDER BY p) AS run FROM g),
u AS (SELECT r, min(p) AS a, max(p) + {LENGTH} AS b FROM s GROUP BY r, run),
v AS (
    SELECT d.r, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY d.r ORDER BY a), 0) + 1,
                             2 * (a - coalesce(lag(b) OVER (PARTITION BY d.r ORDER BY a), 0))) AS before
    FROM u JOIN d USING (r)),
x AS (SELECT r, string_agg(before, '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS removed, count(*) AS spans
      FROM v GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
       coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN x USING (r)"""
