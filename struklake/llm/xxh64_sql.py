"""XXH64 in DuckDB SQL, for the counterparts of queries that are bound to this hash.

Numbers are 128-bit and taken modulo 2^64, as DuckDB checks 64-bit products for overflow."""

from __future__ import annotations

#: The five primes of XXH64.
PRIMES = (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261,
)
_P1, _P2, _P3, _P4, _P5 = (f"{p}::UHUGEINT" for p in PRIMES)
_MOD = "18446744073709551616::UHUGEINT"


def _times(a: str, b: str) -> str:
    return f"(({a}) * {b} % {_MOD})"


def _plus(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {_MOD})"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"


def _rotated(x: str, bits: int) -> str:
    return f"list_transform([{x}], lambda z: (z * {1 << bits}::UHUGEINT % {_MOD}) + z // {1 << (64 - bits)}::UHUGEINT)[1]"


def _folded(x: str, bits: int) -> str:
    return _xor(x, f"{x} // {1 << bits}::UHUGEINT")


def _number(at: str, size: int) -> str:
    """Little-endian number of `size` bytes at a byte place of the hexadecimal text x."""
    parts = " || ".join(f"substr(x, 2 * ({at} + {k}) + 1, 2)" for k in reversed(range(size)))
    return f"('0x' || {parts})::UBIGINT::UHUGEINT"


def _round(state: str, lane: str) -> str:
    return _times(_rotated(_plus(state, _times(lane, _P2)), 31), _P1)


def xxh64(source: str, seed: int) -> str:
    """CTEs that end in `hashed`: the rows of `source` with h, the unsigned hash of x, the bytes as
    hexadecimal text."""
    p1, p2, _, _, p5 = PRIMES
    starts = [(s + seed) % 2**64 for s in (p1 + p2, p2, 0, -p1)]
    lanes = [
        f"list_reduce([{s}::UHUGEINT] || list_transform(range(n // 32), lambda j: {_number(f'32 * j + {8 * i}', 8)}), "
        f"lambda a, l: {_round('a', 'l')})" for i, s in enumerate(starts)
    ]
    joined = _plus(_plus(_rotated("v[1]", 1), _rotated("v[2]", 7)), _plus(_rotated("v[3]", 12), _rotated("v[4]", 18)))
    for i in range(1, 5):
        joined = _plus(_times(_xor(joined, _round("0::UHUGEINT", f"v[{i}]")), _P1), _P4)
    begun = f"CASE WHEN n >= 32 THEN list_transform([[{', '.join(lanes)}]], lambda v: {joined})[1] ELSE {(seed + p5) % 2**64}::UHUGEINT END"
    mixed = _plus(_times(_rotated(_xor("a", _round("0::UHUGEINT", "l")), 27), _P1), _P4)
    eights = f"list_reduce([h] || list_transform(range((n % 32) // 8), lambda j: {_number('n // 32 * 32 + 8 * j', 8)}), lambda a, l: {mixed})"
    four = _plus(_times(_rotated(_xor("h", _times(_number("n // 8 * 8", 4), _P1)), 23), _P2), _P3)
    ones = (
        f"list_reduce([h] || list_transform(range(n % 4), lambda j: {_number('n // 4 * 4 + j', 1)}), "
        f"lambda a, l: {_times(_rotated(_xor('a', _times('l', _P5)), 11), _P1)})"
    )
    return f"""
xx0 AS (SELECT *, length(x) // 2 AS n FROM {source}),
xx1 AS (SELECT *, {_plus(begun, 'n::UHUGEINT')} AS h FROM xx0),
xx2 AS (SELECT * REPLACE ({eights} AS h) FROM xx1),
xx3 AS (SELECT * REPLACE (CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h) FROM xx2),
xx4 AS (SELECT * REPLACE ({ones} AS h) FROM xx3),
xx5 AS (SELECT * REPLACE ({_times(_folded('h', 33), _P2)} AS h) FROM xx4),
xx6 AS (SELECT * REPLACE ({_times(_folded('h', 29), _P3)} AS h) FROM xx5),
hashed AS (SELECT * REPLACE (({_folded('h', 32)})::UBIGINT AS h) FROM xx6)"""
