"""Document fingerprints from closed syncmers (Edgar, 2021), in column expressions.

A text is a sequence of words, hashed once each, behind K - 1 marks for its start. Of every K words in
a row the hashes of the runs of S words inside are compared; the K words are an anchor if the smallest
stands at either edge. Whether they are depends on these K words alone, so equal passages have equal
anchors wherever they stand, and texts of every length have anchors by the same rule. Equal anchors of
one text are told apart by their number in it, so a phrase that is repeated counts each time.

The fingerprint holds the hashes of the anchors in ascending order: the SIZE smallest, and all that are
below one SHARE-th of the range, so it grows with the text. Every hash travels with its anchor's place.
Two fingerprints are compared over the hashes below the bound down to which both are complete: their
likeness is the shared part of these, an estimate of the Jaccard similarity of both texts' anchors,
and exact if both hold all of theirs. Matching is positional: the places of shared anchors differ by
the same number along a passage, and the most common difference is where the passage moved.

The next document comes from a window over ranges of doc_id with about RANGE documents each; the first
document of a range is dealt to the range before as well, so no window spans the table.

Defined results: null and empty texts have an empty fingerprint, and two such are alike (1.0); texts
without a shared anchor have no shift (null); rows that share a doc_id are ordered by a hash of the
text; null ids come first; a single document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from struklake.llm.common import WORD_CLASS

#: Words of a k-mer and of its inner runs.
K, S = 3, 1
#: Hashes that every fingerprint holds if it has as many, and the share of the range it holds beyond.
SIZE, SHARE = 64, 8
#: Bits of a hash and of a place; both fit a long with one bit to spare for the side of a match.
BITS = 31
#: Documents in a range, and the most ranges: their first ids are broadcast.
RANGE, RANGES = 2000, 100_000

_MASK = (1 << BITS) - 1


def _let(name: str, value: str, body: str) -> str:
    """SQL: `body` with `name` bound to `value`, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _hash(entry: str) -> str:
    """SQL: the hash of a fingerprint's entry."""
    return f"shiftright({entry}, {BITS + 1})"


def _anchors(text: str) -> str:
    words = f"transform(regexp_extract_all(coalesce({text}, ''), r'{WORD_CLASS}', 0), w -> xxhash64(w))"
    marks = ", ".join(["0L"] * (K - 1))
    inner = [", ".join(f"t[i + {j + k}]" for k in range(S)) for j in range(K - S + 1)]
    inner = inner if S == 1 else [f"xxhash64({x})" for x in inner]
    whole = ", ".join(f"t[i + {j}]" for j in range(K))
    picked = (
        f"filter(transform(sequence(0, size(t) - {K}), i -> if(least({', '.join(inner)}) in ({inner[0]}, {inner[-1]}), "
        f"named_struct('place', i, 'hash', xxhash64({whole})), null)), a -> a is not null)"
    )
    none = "cast(array() as array<struct<place:int,hash:bigint>>)"
    return _let("t", f"concat(array({marks}), {words})", f"if(size(t) < {K}, {none}, {picked})")


def anchors(text: str) -> Column:
    """Array of (place, hash) of a column's anchors; places count from the first mark."""
    return F.expr(_anchors(text))


def sketch(text: str) -> Column:
    """Fingerprint as an ascending array of longs: BITS bits of hash, a spare bit, BITS of place."""
    # 32 bits of the hash and the place, sorted, so that equal anchors stand together
    placed = f"sort_array(transform({_anchors(text)}, a -> shiftleft(a.hash & 4294967295L, {BITS}) | a.place))"
    heads = f"filter(sequence(0, size(s) - 1), i -> i = 0 or shiftright(s[i], {BITS}) != shiftright(s[i - 1], {BITS}))"
    numbered = (
        "flatten(transform(h, (f, j) -> transform(sequence(f, if(j + 1 < size(h), h[j + 1], size(s)) - 1), "
        f"i -> shiftleft(xxhash64(shiftright(s[i], {BITS}), i - f) & {_MASK}L, {BITS + 1}) | (s[i] & {_MASK}L))))"
    )
    kept = f"filter(sort_array({numbered}), (x, i) -> i < {SIZE} or {_hash('x')} < {(1 << BITS) // SHARE}L)"
    return F.expr(_let("s", placed, f"if(size(s) = 0, cast(array() as array<bigint>), {_let('h', heads, kept)})"))


def as_text(entries: Column) -> Column:
    """The hashes of a fingerprint as one string of hexadecimal digits."""
    return F.array_join(F.transform(entries, lambda x: F.lower(F.lpad(F.hex(F.shiftright(x, BITS + 1)), 8, "0"))), "")


def match(a: str, b: str) -> Column:
    """(likeness, shift) of two fingerprints; shift is how much further on in b shared anchors stand."""
    full = lambda x: f"if(size({x}) < {SIZE}, {1 << BITS}L, greatest({(1 << BITS) // SHARE}L, {_hash(f'{x}[size({x}) - 1]')} + 1))"
    side = 1 << BITS
    both = (
        f"sort_array(concat(filter({a}, x -> {_hash('x')} < m), "
        f"transform(filter({b}, x -> {_hash('x')} < m), x -> x | {side}L)))"
    )
    # neighbours of one hash, first a's, then b's
    shared = (
        f"filter(sequence(1, size(s) - 1), i -> {_hash('s[i]')} = {_hash('s[i - 1]')} "
        f"and (s[i - 1] & {side}L) = 0 and (s[i] & {side}L) != 0)"
    )
    moves = f"sort_array(transform(p, i -> (s[i] & {_MASK}L) - (s[i - 1] & {_MASK}L)))"
    ends = "filter(sequence(0, size(v) - 1), i -> i = size(v) - 1 or v[i] != v[i + 1])"
    runs = "transform(e, (x, j) -> named_struct('n', x - if(j = 0, -1, e[j - 1]), 'near', -abs(v[x]), 'move', v[x]))"
    shift = f"if(size(p) = 0, null, {_let('v', moves, _let('e', ends, f'array_max({runs}).move'))})"
    some = _let("p", shared, f"named_struct('likeness', size(p) / (size(s) - size(p)), 'shift', {shift})")
    one = "named_struct('likeness', if(size(s) = 0, 1D, 0D), 'shift', cast(null as bigint))"
    found = _let("s", both, f"if(size(s) < 2, {one}, {some})")
    return F.expr(_let("m", f"least({full(a)}, {full(b)})", found))


def ranges_of(docs: DataFrame) -> tuple[float | None, list[float]]:
    """The least id, and the first ids of the ranges that follow the first: RANGES at most."""
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    n, least = docs.select(F.count(F.lit(1)), F.min(key)).first()
    ranges = max(1, min(RANGES, n // RANGE))
    if ranges == 1:
        return least, []
    shares = [i / ranges for i in range(1, ranges)]
    edges = docs.select(F.percentile_approx(key, shares, 10 * ranges)).first()[0]
    return least, sorted({e for e in edges if e > least})


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """`docs` with next_<column> of the document that follows in the order of doc_id; after the
    last comes the first."""
    least, edges = ranges_of(docs)
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    splits = [float("-inf"), *edges, float("inf")]
    keyed = docs.withColumn("__key", key)
    if edges:
        keyed = Bucketizer(splits=splits, inputCol="__key", outputCol="__range").transform(keyed)
        keyed = keyed.withColumn("__range", F.col("__range").cast("int"))
    else:
        keyed = keyed.withColumn("__range", F.lit(0))
    # The edges are ids of documents; at most RANGES of them are broadcast.
    first = docs.sparkSession.createDataFrame([(e,) for e in edges], "__edge double")
    place = lambda number, kind: F.struct(number.alias("range"), F.lit(kind).alias("kind"))
    dealt = keyed.join(F.broadcast(first), F.col("__key") == F.col("__edge"), "left").withColumn(
        "__at", F.explode(F.filter(F.array(
            place(F.col("__range"), 0),
            F.when(F.col("__edge").isNotNull(), place(F.col("__range") - 1, 1)),
            F.when(F.col("__key") == F.lit(least), place(F.lit(len(edges)), 2)),
        ), lambda x: x.isNotNull())))
    order = Window.partitionBy("__at.range").orderBy(
        F.col("__at.kind") == 2, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "__at.kind")
    return (
        dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
        .filter("__at.kind = 0").drop("__at", "__key", "__range", "__edge")
    )


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of the text with its last quarter replaced by
    the start of the next one, the likeness to it and to the next document, and where the edited
    text's shared passages moved."""
    sketched = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sketch", sketch("text"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = (
        with_next(sketched, "text", "sketch")
        .withColumn("edited", F.concat(F.left("text", n - quarter), F.left("next_text", quarter)))
        .withColumn("edited_sketch", sketch("edited"))
    )
    return edited.withColumn("__edited", match("sketch", "edited_sketch")).select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.col("__edited.likeness").alias("near_edited"), match("sketch", "next_sketch")["likeness"].alias("near_next"),
        F.col("__edited.shift").alias("edited_shift"),
    )
