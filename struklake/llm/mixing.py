"""Mixing sources to target weights.

Each source's documents, in the order of a digest, form one stream of words that is cut into
blocks of BLOCK words. The number of slots of a source follows from its target, so taken words
stay within one block of it. The source counts of the output shards are a multinomial draw given
these totals: every slot falls into one of the shards with equal chances, by a seeded hash, and a
shard's counts are those of the slots that fell into it (`shard_counts`). Slot t of a source takes
block perm(t mod n) of its n blocks, where perm is a pseudorandom affine permutation of the block
numbers that changes with every round t div n. Slots and blocks are joined by block number.

`mixed_blocks` gives the mix as it is trained on, blocks of words in output shards; `mix_documents`
the same words gathered by document; `mix_digest` the numbers of words, in all and by output shard.

Weights go 1, 2, 3, repeating, over the sources in code point order, null last. Shares of all
words are capped at CAP times the source's size; the excess is dealt anew by weight. With
sources in the order of cap / weight, the level below which none is cut has a closed form.

Hot sources: the stream position of a document comes from sizes per (source, cell); only a cell
is ever ordered in one task. Only the table of sources (names and sums) is ordered as a whole.

Defined results: null or wordless texts have size 0 and are never taken; null sources form one
source; repeated rows are documents of their own, and rows that share a doc_id are ordered by size and
text, so reruns agree; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from struklake.llm.common import WORD_CLASS, drop_clashing, materialise

#: Words in a block.
BLOCK = 64
#: No source or document is taken more often than this.
CAP = 3
#: Weights of the sources, repeated in their order.
WEIGHTS = (1, 2, 3)
#: Output shards of the mix.
SHARDS = 16
CELL_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, size) rows, one per source, with rank, weight and target words.

    The windows over all rows hold one row per source name, never documents. In the order of
    cap / weight a source is full if its cap is below its share of what the sources before it
    leave; all that follow the first that is not full share one level."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("__ratio", "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    return (
        sizes.withColumn("rank", (F.row_number().over(by_name) - 1).cast("int"))
        .withColumn(
            "weight",
            F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights) + 1).cast("long"),
        )
        .withColumn("__ratio", F.col("size").cast("double") / F.col("weight"))
        .withColumns({
            "__rest": F.sum("size").over(total)
            - F.coalesce(F.sum(F.col("size") * cap).over(before), F.lit(0)),
            "__weights": F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)),
        })
        .withColumn("__full", F.col("size") * cap * F.col("__weights") < F.col("__rest") * F.col("weight"))
        .withColumn(
            "__level",
            F.first(F.when(~F.col("__full"), F.struct("__rest", "__weights")), ignorenulls=True).over(
                by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        )
        .select(
            "source", "size", "rank", "weight",
            F.when(F.col("__full"), (F.col("size") * cap).cast("double"))
            .otherwise(
                F.col("__level.__rest").cast("double") * F.col("weight") / F.col("__level.__weights")
            )
            .alias("target"),
        )
    )


def source_table(docs: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """Sizes per (source, cell) and the table of sources, from one pass over the texts."""
    cells = materialise(
        docs.select("source", n_words(F.col("text")).alias("size"), _cell().alias("cell"))
        .groupBy("source", "cell")
        .agg(F.sum("size").alias("size"))
    )
    sources = source_targets(cells.groupBy("source").agg(F.sum("size").alias("size")), cap=cap)
    return cells, materialise(sources)


def _cell() -> Column:
    return F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, CELL_DIGITS)


def _name(source: Column) -> Column:
    """Sources as join keys that keep null apart from every name."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def located(docs: DataFrame, cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with size, their source's rank, target and size, and at: the place of their
    first word in the source's stream. (rank, at) identifies a document that has words."""
    docs = drop_clashing(docs, "size", "rank", "target", "source_size", "at")
    before = Window.partitionBy("rank", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "size", "__text")
    facts = sources.select(
        _name(F.col("source")).alias("__name"), "rank", "target", F.col("size").alias("source_size")
    )
    first = (
        cells.withColumn("__name", _name(F.col("source")))
        .join(facts.select("__name", "rank"), "__name")
        .select("rank", "cell", F.coalesce(
            F.sum("size").over(
                Window.partitionBy("rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
            ), F.lit(0)).alias("__first"))
    )
    return (
        docs.withColumns({"size": n_words(F.col("text")), "cell": _cell(), "__name": _name(F.col("source")),
                          "__text": F.md5(F.coalesce("text", F.lit("")))})
        .join(facts, "__name")
        .withColumn("__at", F.coalesce(
            F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(first, ["rank", "cell"])
        .withColumn("at", F.col("__first") + F.col("__at"))
        .drop("cell", "__name", "__first", "__at", "__text")
    )


def block_slots(
    sources: DataFrame, block: int = BLOCK, cap: int = CAP, shards: int = SHARDS, seed: int = 0
) -> DataFrame:
    """One row per slot of the mix: rank of the source, slot, turn, block and output shard.

    Slots come from one row per source by explode; spans spread a large source over tasks, as
    many as the session's shuffles have."""
    span = 1 << 14
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = (
        sources.filter("size > 0")
        .withColumn("n_blocks", F.expr(f"(size + {block - 1}) div {block}"))
        .withColumn("n_slots", F.expr(
            f"least(cast(round(target * n_blocks / size) as bigint), n_blocks * {cap})"))
        .filter("n_slots > 0")
    )
    spans = counted.select(
        "rank", "n_blocks", "n_slots",
        F.explode(F.expr(f"sequence(0L, (n_slots - 1) div {span})")).alias("span"),
    ).repartition(tasks, "rank", "span")
    slots = spans.withColumn("slot", F.explode(F.expr(
        f"sequence(span * {span}, least(n_slots, (span + 1) * {span}) - 1)")))
    return slots.withColumn("turn", F.expr("slot div n_blocks")).select(
        "rank", "slot", "turn", _permuted(seed).alias("block"),
        (_drawn("concat_ws('|', 'shard', {seed}, rank, slot)", seed) % shards).cast("int").alias("out_shard"),
    )


def _drawn(text: str, seed: int) -> Column:
    """A pseudorandom 32-bit number from a digest."""
    return F.expr(f"cast(conv(substr(md5({text.format(seed=seed)}), 1, 8), 16, 10) as bigint)")


def _permuted(seed: int) -> Column:
    """Affine permutation of block numbers: a * i + b mod n, with a prime a that does not divide
    n; a and b change with source and turn. The product is a decimal, so it cannot overflow."""
    draw = _drawn("concat_ws('|', 'perm', {seed}, rank, turn)", seed)
    usable = F.filter(F.array(*[F.lit(p).cast("long") for p in PRIMES]), lambda p: F.col("n_blocks") % p != 0)
    a = F.element_at(usable, (draw % F.size(usable) + 1).cast("int"))
    wide = (F.col("slot") % F.col("n_blocks")).cast("decimal(19,0)") * a.cast("decimal(18,0)")
    return ((wide + draw.cast("decimal(19,0)")) % F.col("n_blocks").cast("decimal(19,0)")).cast("long")


def _primes(low: int, count: int) -> list[int]:
    """The first `count` primes above `low`."""
    found, x = [], low
    while len(found) < count:
        x += 1
        if all(x % d for d in range(2, int(x**0.5) + 1)):
            found.append(x)
    return found


#: Multipliers; no number below 2^63 is divisible by more than two of them.
PRIMES = _primes(1_000_000_000, 8)


def block_pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents of every block: rank, block, at, skip (words of the document before the
    piece) and n (words in the piece)."""
    return (
        placed.filter("size > 0")
        .select("rank", "at", "size", F.explode(
            F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
        .select(
            "rank", "block", "at",
            F.expr(f"greatest(at, block * {block}) - at").alias("skip"),
            F.expr(f"least(at + size, (block + 1) * {block}) - greatest(at, block * {block})").alias("n"),
        )
    )


def mixed_pieces(placed: DataFrame, sources: DataFrame, **options) -> DataFrame:
    """The mix: every slot with the pieces of its block, joined by block number. Slots are far
    more than the few source rows they come from, so the join is told not to broadcast them."""
    return block_pieces(placed, options.get("block", BLOCK)).join(
        block_slots(sources, **options).hint("merge"), ["rank", "block"]
    )


def shard_counts(sources: DataFrame, **options) -> DataFrame:
    """(out_shard, rank, n): the multinomial draw, how many blocks of a source each output shard takes."""
    return block_slots(sources, **options).groupBy("out_shard", "rank").agg(F.count(F.lit(1)).alias("n"))


def mixed_blocks(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus in blocks: out_shard, source, slot, block, n_words and text, the block's words
    joined by single spaces. A source's last block may be shorter than the others."""
    block = options.get("block", BLOCK)
    packed = docs.select("doc_id", "text", "source")
    cells, sources = source_table(packed, options.get("cap", CAP))
    placed = located(packed, cells, sources).filter("size > 0")
    words = F.regexp_extract_all("text", F.lit(WORD_CLASS), F.lit(0))
    # the words between two block bounds of the source's stream, for all blocks a document reaches into
    cut = F.transform(F.array(words), lambda w: F.transform(
        F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}")),
        lambda k: F.struct(k.alias("block"), F.slice(
            w, (F.greatest(k * block - F.col("at"), F.lit(0)) + 1).cast("int"),
            (F.least((k + 1) * block, F.col("at") + F.col("size")) - F.greatest(k * block, F.col("at"))).cast("int"),
        ).alias("words"))))[0]
    pieces = placed.select("rank", "at", F.explode(cut).alias("p")).select("rank", "at", "p.block", "p.words")
    blocks = pieces.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("parts")).select(
        "rank", "block", F.flatten("parts.words").alias("words"))
    named = sources.select("rank", "source")
    return (
        block_slots(sources, **options).hint("merge").join(blocks, ["rank", "block"]).join(named, "rank")
        .select("out_shard", "source", "slot", "block", F.size("words").alias("n_words"), F.array_join("words", " ").alias("text"))
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of `docs`: per document and turn one row, whose text is
    what the mix takes of it in that turn: the text itself where all of it is taken, else the
    taken words joined by single spaces."""
    # Columns of the caller's own travel in a struct, so that no name can clash.
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    packed = docs.select("doc_id", "text", "source", F.struct(F.lit(0).alias("_"), *others).alias("__own"))
    cells, sources = source_table(packed, options.get("cap", CAP))
    placed = located(packed, cells, sources)
    taken = (
        mixed_pieces(placed.select("rank", "at", "size"), sources, **options)
        .groupBy("rank", "at", "turn")
        .agg(F.sum("n").alias("__n"), F.sort_array(F.collect_list(F.struct("skip", "n"))).alias("__pieces"))
    )
    words = F.regexp_extract_all("text", F.lit(WORD_CLASS), F.lit(0))
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(
        "__pieces", lambda p: F.slice(w, (p["skip"] + 1).cast("int"), p["n"].cast("int")))), " "))[0]
    whole = F.col("__n") == F.col("size")
    mixed = placed.join(taken, ["rank", "at"]).filter("size > 0").withColumn(
        "text", F.when(whole, F.col("text")).otherwise(cut))
    own = lambda c: F.col("__own").getField(c)
    n_chars = F.when(whole, own("n_chars")).otherwise(F.char_length("text")).cast("long")
    return mixed.select(*[
        F.col(c) if c not in others else n_chars.alias(c) if c == "n_chars" else own(c).alias(c) for c in docs.columns
    ])


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: size, its source's size and target, the words taken of it, and
    shard_words, how many of these each output shard takes, as numbers with commas between."""
    docs = docs.select("doc_id", "text", "source")
    shards = options.get("shards", SHARDS)
    cells, sources = source_table(docs, options.get("cap", CAP))
    placed = materialise(located(docs, cells, sources).drop("text", "source"))
    by_shard = [F.coalesce(F.sum(F.when(F.col("out_shard") == k, F.col("n"))), F.lit(0)) for k in range(shards)]
    taken = mixed_pieces(placed, sources, **options).groupBy("rank", "at").agg(
        F.sum("n").alias("__taken"), F.concat_ws(",", *[c.cast("string") for c in by_shard]).alias("__shards"))
    worded = placed.filter("size > 0").join(taken, ["rank", "at"], "left")
    none = placed.filter("size = 0").withColumns({"__taken": F.lit(None).cast("long"), "__shards": F.lit(None).cast("string")})
    return worded.unionByName(none).select(
        "doc_id", "size", "source_size", "target", F.coalesce("__taken", F.lit(0)).alias("taken"),
        F.coalesce("__shards", F.lit(",".join(["0"] * shards))).alias("shard_words"),
    )


_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_PERM = _DRAW.format("concat_ws('|', 'perm', 0, rank, turn)")
_SHARD = _DRAW.format("concat_ws('|', 'shard', 0, rank, slot)")
_WORDS = "times * (least(pos + size, (block + 1) * %d) - greatest(pos, block * %d))" % (BLOCK, BLOCK)
_BY_SHARD = ", ".join(f"coalesce(sum({_WORDS}) FILTER (WHERE shard = {k}), 0)::BIGINT" for k in range(SHARDS))

ORACLE = f"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {CELL_DIGITS}) AS cell, md5(coalesce(text, '')) AS digest
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
    FROM d GROUP BY source),
w AS (SELECT *, 1 + rank % 3 AS weight FROM s),
f AS (
    SELECT *, (sum(size) OVER () - coalesce(sum(size * {CAP}) OVER (ORDER BY size::DOUBLE / weight, rank
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
           (sum(weight) OVER (ORDER BY size::DOUBLE / weight, rank
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights
    FROM w),
l AS (
    SELECT rest, weights FROM f WHERE size * {CAP} * weights >= rest * weight
    ORDER BY size::DOUBLE / weight, rank LIMIT 1),
t AS (
    SELECT source, f.size AS source_size, rank,
           CASE WHEN f.size * {CAP} * f.weights < f.rest * weight THEN (f.size * {CAP})::DOUBLE
                ELSE l.rest::DOUBLE * weight / l.weights END AS target,
           (f.size + {BLOCK - 1}) // {BLOCK} AS n_blocks
    FROM f LEFT JOIN l ON true),
c AS (
    SELECT *, least(round(target * n_blocks / source_size)::BIGINT, n_blocks * {CAP}) AS n_slots
    FROM t WHERE source_size > 0),
k AS (
    SELECT rank, n_blocks, slot, slot // n_blocks AS turn
    FROM (SELECT rank, n_blocks, unnest(range(n_slots)) AS slot FROM c)),
u AS (
    SELECT *, {_PERM} AS draw, list_filter({PRIMES}, lambda p: n_blocks % p != 0) AS usable FROM k),
taken_blocks AS (
    SELECT rank, (((slot % n_blocks)::HUGEINT * usable[(draw % len(usable))::INT + 1] + draw) % n_blocks)::BIGINT AS block,
           {_SHARD} % {SHARDS} AS shard, count(*) AS times
    FROM u GROUP BY ALL),
p AS (
    SELECT d.*, t.source_size, t.target, t.rank,
           (sum(d.size) OVER (PARTITION BY t.rank ORDER BY cell, doc_id NULLS FIRST, d.size, digest
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS pos
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (
    SELECT rank, pos, size, unnest(range(pos // {BLOCK}, (pos + size - 1) // {BLOCK} + 1)) AS block
    FROM p WHERE size > 0),
x AS (
    SELECT rank, pos, sum({_WORDS})::BIGINT AS taken, concat_ws(',', {_BY_SHARD}) AS shard_words
    FROM b JOIN taken_blocks USING (rank, block) GROUP BY rank, pos)
SELECT doc_id, p.size, source_size, target,
       CASE WHEN p.size > 0 THEN coalesce(taken, 0) ELSE 0 END::BIGINT AS taken,
       coalesce(shard_words, '{','.join(['0'] * SHARDS)}') AS shard_words
FROM p LEFT JOIN x ON p.rank = x.rank AND p.pos = x.pos AND p.size > 0"""
