"""Hard negatives for contrastive training: rows that score near an anchor's positives, other label.

Scores are integer inner products. Several candidates' components are biased to be non-negative and
packed into separated fields of one wide integer, a component each; every anchor component multiplies
that integer once, the products add up, and the fields of the sum are the exact scores of all packed
candidates, less the bias (Kronecker substitution). A field is wide enough for the largest sum that
the packed components allow, so no field runs over into the next.

Anchors are a stated query set. They are broadcast in blocks of at most ANCHORS rows and COMPONENTS
components, one block after the other, and every block meets all rows where these stand: first rows of
the anchor's label for its positives, then rows of other labels for the negatives under each positive.
A task keeps the best few of each and sends no others, so what is shuffled does not depend on the
size of a label or of a group of equal vectors. A label may hold any share of the rows.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component, take
no part; an empty vector and components beyond the shorter of two vectors count as zero; repeated rows
count each, as anchors, positives and negatives, and an anchor is no positive of itself only; scores that
do not fit 64 bits raise an error; other columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from struklake.llm.common import materialise

#: A component becomes floor(SCALE * x).
SCALE = 256
#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least this many hundredths of the positive.
LOW_PERCENT = 80
#: Bounds of one broadcast block of anchors.
ANCHORS, COMPONENTS = 4096, 1 << 22
#: Candidates that are packed into one integer.
FIELDS = 2048

FOUND = "anchor int, positive int, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Anchor:
    """A row of the query set; `positives` holds (vec_id, score) once they are known."""

    vec_id: int
    label: int
    components: list[int]
    positives: list[tuple[int, int]]


def taking_part(vectors: DataFrame, shift: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; every `shift`-th vec_id has the next label."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.col("label").cast("long")
    return vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % shift == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label).alias("label"), v.alias("v"),
    )


def whole_components(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles, as 64-bit or, where these do not do, unbounded integers."""
    scaled = np.floor(values * float(SCALE))
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        return np.array([int(x) for x in scaled.ravel()], dtype=object).reshape(scaled.shape)
    return scaled.astype(np.int64)


class Packed:
    """Components of up to FIELDS candidates, one wide integer for each place of the vectors."""

    def __init__(self, rows: np.ndarray, largest: int):
        """`rows`: candidates x places; `largest`: bound of an anchor's absolute component."""
        self.n, self.places = rows.shape
        self.bias = max(0, -int(rows.min())) if rows.size else 0
        self.anchor_bias = largest
        biased = rows + self.bias
        bound = self.places * 2 * largest * int(biased.max(initial=0))
        self.width = next((w for w in (4, 8) if bound < 1 << 8 * w), (bound.bit_length() + 8) // 8)
        kind = {4: "<u4", 8: "<u8"}.get(self.width)
        if kind:
            pack = lambda column: column.astype(kind).tobytes()
        else:
            pack = lambda column: b"".join(int(x).to_bytes(self.width, "little") for x in column)
        self.kind = kind
        self.wide = [int.from_bytes(pack(biased[:, d]), "little") for d in range(self.places)]
        self.sums = rows.sum(axis=1)

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products of all candidates with the anchor, in 64 bits."""
        total = 0
        for component, wide in zip(anchor, self.wide, strict=False):
            total += (component + self.anchor_bias) * wide
        used = min(len(anchor), self.places)
        # the places beyond the anchor's own are multiplied by the bias alone
        for wide in self.wide[used:]:
            total += self.anchor_bias * wide
        packed = total.to_bytes(self.n * self.width, "little")
        ahead = self.bias * (sum(anchor[:used]) + self.places * self.anchor_bias)
        if self.kind and self.sums.dtype != object:
            fields = np.frombuffer(packed, dtype=self.kind).astype(np.uint64)
            # modulo 2^64, in which the products fit
            mask = (1 << 64) - 1
            out = fields - np.uint64(ahead & mask) - self.sums.astype(np.uint64) * np.uint64(self.anchor_bias & mask)
            return out.view(np.int64)
        w = self.width
        exact = [
            int.from_bytes(packed[i * w : (i + 1) * w], "little") - ahead - int(s) * self.anchor_bias
            for i, s in enumerate(self.sums)
        ]
        if any(abs(x) >= 1 << 63 for x in exact):
            raise OverflowError("a score does not fit 64 bits")
        return np.array(exact, dtype=np.int64)


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equal ones the smallest ids; `ids` is ascending."""
    if len(scores) > k:
        cut = -np.partition(-scores, k - 1)[k - 1]
        above = np.flatnonzero(scores > cut)
        places = np.concatenate([above, np.flatnonzero(scores == cut)[: k - len(above)]])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))]


def by_label(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(label, ids, components): the rows of a batch by label and ascending vec_id, in parts of FIELDS."""
    ids, labels = batch["vec_id"].to_numpy(), batch["label"].to_numpy()
    vectors = batch["v"]
    lengths = vectors.value_lengths().to_numpy()
    flat = whole_components(vectors.flatten().to_numpy())
    ends = np.cumsum(lengths)
    order = np.lexsort((ids, labels))
    for part in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if len(order) else ():
        for at in range(0, len(part), FIELDS):
            some = part[at : at + FIELDS]
            rows = np.zeros((len(some), int(lengths[some].max())), dtype=flat.dtype)
            for i, r in enumerate(some.tolist()):
                rows[i, : lengths[r]] = flat[ends[r] - lengths[r] : ends[r]]
            yield int(labels[some[0]]), ids[some], rows


class Best:
    """The best few candidates so far of every question (anchor, positive)."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def add(self, question: tuple[int, int], scores: np.ndarray, ids: np.ndarray) -> None:
        places = first_of(scores, ids, self.k)
        if not len(places):
            return
        rows = [*self.found.get(question, ()), *zip((-scores[places]).tolist(), ids[places].tolist(), strict=True)]
        self.found[question] = sorted(rows)[: self.k]

    def batch(self) -> pa.RecordBatch:
        rows = [(a, p, vec_id, -score) for (a, p), some in self.found.items() for score, vec_id in some]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "positive", "vec_id", "score"])


def best_candidates(rows: DataFrame, anchors: list[Anchor], negatives: bool) -> DataFrame:
    """FOUND: for every anchor the best rows of its label (one more than POSITIVES, as the anchor is among
    them), or for every positive the best rows of other labels; each task sends its own best."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        largest = max((abs(c) for a in anchors for c in a.components), default=0)
        best = Best(NEGATIVES if negatives else POSITIVES + 1)
        for batch in batches:
            for label, ids, components in by_label(batch):
                packed = Packed(components, largest)
                for number, anchor in enumerate(anchors):
                    if (anchor.label == label) == negatives or (negatives and not anchor.positives):
                        continue
                    scores = packed.scores(anchor.components)
                    if not negatives:
                        best.add((number, 0), scores, ids)
                        continue
                    for p, (_, high) in enumerate(anchor.positives):
                        within = np.flatnonzero((scores <= high) & (scores >= least_score(high)))
                        best.add((number, p), scores[within], ids[within])
        yield best.batch()

    return rows.mapInArrow(search, FOUND)


def least_score(positive: int) -> int:
    """The smallest n with LOW_PERCENT * positive <= 100 * n, within 64 bits."""
    return max(-(-LOW_PERCENT * positive // 100), -(1 << 63))


def merged(found: DataFrame, k: int) -> DataFrame:
    """FOUND with rank: the first k of every question over all tasks, written to the shared folder."""
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id")
    return materialise(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


def with_positives(anchors: list[Anchor], found: DataFrame) -> list[Anchor]:
    """The anchors with their positives: of the first rows of the label the anchor itself is left out,
    once. A block's positives are a few numbers for each of its anchors."""
    first: dict[int, list] = {}
    for row in found.orderBy("anchor", "rank").collect():
        first.setdefault(row["anchor"], []).append((row["vec_id"], row["score"]))
    out = []
    for number, anchor in enumerate(anchors):
        some = first.get(number, [])
        itself = (anchor.vec_id, sum(c * c for c in anchor.components))
        if itself in some:
            some.remove(itself)
        out.append(Anchor(anchor.vec_id, anchor.label, anchor.components, some[:POSITIVES]))
    return out


def anchor_blocks(rows: DataFrame, is_anchor: Column) -> Iterator[list[Anchor]]:
    """The anchors in blocks of bounded size, fetched block by block."""
    block, size = [], 0
    for row in rows.filter(is_anchor).toLocalIterator():
        if block and (len(block) >= ANCHORS or size + len(row["v"]) > COMPONENTS):
            yield block
            block, size = [], 0
        components = whole_components(np.array(row["v"], dtype=np.float64)).tolist()
        block.append(Anchor(row["vec_id"], row["label"], components, []))
        size += len(components)
    if block:
        yield block


def hard_negatives(vectors: DataFrame, every: int = 100, shift: int = 7, labels: int = 10) -> DataFrame:
    """RESULT for anchors whose vec_id is divisible by `every`: up to NEGATIVES rows of another label for
    each of an anchor's POSITIVES nearest rows of its own, from LOW_PERCENT to 100 hundredths of the
    positive's score. `shift` and `labels` move the label of every `shift`-th row to the next."""
    rows = taking_part(vectors, shift, labels)
    spark = vectors.sparkSession
    out = None
    for block in anchor_blocks(rows, F.col("vec_id") % every == 0):
        block = with_positives(block, merged(best_candidates(rows, block, negatives=False), POSITIVES + 1))
        found = merged(best_candidates(rows, block, negatives=True), NEGATIVES)
        known = spark.createDataFrame(
            [(n, p, a.vec_id, vec_id, score) for n, a in enumerate(block) for p, (vec_id, score) in enumerate(a.positives)],
            "anchor int, positive int, anchor_id long, positive_id long, positive_score long",
        )
        part = found.join(F.broadcast(known), ["anchor", "positive"]).select(  # POSITIVES rows for each anchor of a block
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], RESULT) if out is None else out


ORACLE = f"""
WITH r AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS d FROM r),
scores AS (
    SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, any_value(a.label) = any_value(b.label) AS same,
           sum(a.x * b.x)::BIGINT AS score
    FROM parts a JOIN parts b ON a.d = b.d AND a.r <> b.r WHERE a.vec_id % 100 = 0 GROUP BY ALL),
positives AS (
    SELECT a, anchor_id, b AS p, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s USING (a, anchor_id)
WHERE NOT same AND {LOW_PERCENT} * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY a, p ORDER BY score DESC, s.vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}"""
