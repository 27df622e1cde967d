"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in column expressions.

The law is `key`: the key and the number of shards alone decide the shard, without a ring
table. When a shard is appended, a row either stays or moves into the new shard.

Slots number the rows of a shard from 0 without gaps. Rows are dealt into (shard, cell)
groups by a digest of key and text; cell sizes give each cell its first slot, and only a cell
is ever sorted in one task. The table of cell sizes has at most n_shards * CELLS rows, which
is the proven bound of what is broadcast.

Defined results: a null key hashes as the empty string; a null text has size 1 and checksum 0;
repeated rows get slots of their own; an empty table gives an empty result. Input columns named
like an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from struklake.llm.common import drop_clashing

#: Cells a shard is cut into, as hexadecimal digits of the digest.
CELL_DIGITS = 3
#: Most shards whose cells are broadcast.
BROADCAST_SHARDS = 256
CELLS = 16**CELL_DIGITS
#: Multiplier of the 64-bit linear congruential generator in the paper.
LCG = 2862933555777941757


def key_seed(key: Column) -> Column:
    """Unsigned 64-bit seed: the first 16 hexadecimal digits of the MD5 of the key as text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def jump_shard(seed: str, n_shards: int) -> Column:
    """Shard from 0 to n_shards - 1 of the unsigned 64-bit column `seed`.

    The generator works on decimals, which hold the full product, so nothing overflows."""
    after = f"cast((s.k * {LCG}BD + 1BD) % 18446744073709551616BD as decimal(20,0))"
    jump = (
        "cast(floor(cast(s.j + 1 as double) * (2147483648D / "
        f"cast(({after} div 8589934592BD) + 1 as double))) as bigint)"
    )
    return F.expr(f"""
        cast(aggregate(
            sequence(1, {n_shards}),
            named_struct('k', {seed}, 'b', -1L, 'j', 0L),
            (s, i) -> if(s.j >= {n_shards}, s, named_struct('k', {after}, 'b', s.j, 'j', {jump}))
        ).b as int)""")


def shard_by_key(
    df: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All rows and columns of `df` with shard, grown_shard (the shard if there were one more)
    and slot (gapless from 0 within the shard)."""
    df = drop_clashing(df, "shard", "grown_shard", "slot")
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = (
        df.withColumns({"__seed": key_seed(F.col(key)), "__sum": F.md5(body)})
        .withColumns({
            "shard": jump_shard("__seed", n_shards),
            "grown_shard": jump_shard("__seed", n_shards + 1),
            "__cell": F.substring(F.md5(F.concat_ws("|", name, F.col("__sum"))), 1, CELL_DIGITS),
        })
        .drop("__seed")
    )
    # The sizes come from the same expressions, so both reads of the input agree.
    cells = placed.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select(
        "shard", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")
    )
    # 16 ** CELL_DIGITS rows a shard: few shards are broadcast, for many Spark chooses by size
    first = F.broadcast(first) if n_shards <= BROADCAST_SHARDS else first
    within = Window.partitionBy("shard", "__cell").orderBy(F.col(key).asc_nulls_first(), "__sum")
    return (
        placed.withColumn("__row", F.row_number().over(within))
        .join(first, ["shard", "__cell"])
        .withColumn("slot", (F.col("__first") + F.col("__row") - 1).cast("long"))
        .drop("__cell", "__first", "__row", "__sum")
    )


def shard_digest(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per document: size, checksum, law, shard, slot and grown shard."""
    body = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        "text",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    return shard_by_key(sized, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _oracle_jump(n: int) -> str:
    after = f"(((s.k * {LCG}::HUGEINT) + 1) % 18446744073709551616::HUGEINT)"
    jump = f"floor((s.j + 1)::DOUBLE * (2147483648::DOUBLE / (({after} // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT"
    return f"""(list_reduce(
        list_transform(range({n}), lambda i: {{'k': seed, 'b': (-1)::BIGINT, 'j': 0::BIGINT}}),
        lambda s, x: CASE WHEN s.j >= {n} THEN s ELSE {{'k': {after}, 'b': s.j, 'j': {jump}}} END,
        {{'k': seed, 'b': (-1)::BIGINT, 'j': 0::BIGINT}})).b::INTEGER"""


ORACLE = f"""
WITH RECURSIVE steps(n, bit, v) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL
    SELECT n, bit + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
    FROM steps WHERE bit < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM steps WHERE bit = 8),
d AS (
    SELECT doc_id, coalesce(text, '') AS body, coalesce(doc_id::VARCHAR, '') AS name,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::HUGEINT AS seed
    FROM documents),
p AS (
    SELECT doc_id, name, md5(body) AS h, (octet_length(encode(body)) + 1)::BIGINT AS size,
           xor(list_reduce(
               list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT),
               lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32,
           {_oracle_jump(16)} AS shard, {_oracle_jump(17)} AS grown_shard
    FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard
            ORDER BY substr(md5(name || '|' || h), 1, {CELL_DIGITS}), doc_id NULLS FIRST, h) - 1)::BIGINT AS slot,
       grown_shard
FROM p"""
