"""Keyed draws: the same number for the same (seed, id, rep, feature), whatever the partitioning.

Integer arithmetic alone, below 2**62, so any engine gives the same values.  The fifth
power modulo the prime is a permutation that isn't linear: without it, draws of
neighbouring seeds or features would be shifted copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

MODULUS = 2147483647  # fixed values: a Mersenne prime and two multipliers of full period
MULTIPLIERS = (48271, 69621)


def _whole(x) -> Column:
    return x.cast("bigint") if isinstance(x, Column) else F.lit(int(x)).cast("bigint")


def bound(x: Column, of: Callable[[Column], Column]) -> Column:
    """``of(x)``, with x worked out once: elsewhere an expression is worked out as often as it is named."""
    return F.transform(F.array(x), of)[0]


def draw_code(seed, key, rep=0, feature=0) -> Column:
    m = F.lit(MODULUS).cast("bigint")
    mixed = F.pmod(_whole(key), m) * 16807 + F.pmod(_whole(rep), m) * 7919 + F.pmod(_whole(feature), m) * 104729 + _whole(seed) * 31 + 1
    square = lambda x: F.pmod(x * x, m)
    # one level of binding: Spark takes functions within functions for each other when it looks for equal expressions
    mixed = bound(F.pmod(mixed, m), lambda x: F.pmod(F.pmod(square(x) * square(x), m) * x, m))
    for a in MULTIPLIERS:
        mixed = F.pmod(mixed * a + 12345, m)
    return mixed


def _uniforms(seeds: tuple[tuple[int, int], ...]):
    """Of keys and repeats, a struct with the uniforms of each (seed, feature)."""
    kind = StructType([StructField(f"u{j}", DoubleType()) for j in range(len(seeds))])

    @F.arrow_udf(kind)
    def of(key: pa.Array, rep: pa.Array) -> pa.Array:
        unknown = pc.or_(pc.is_null(key), pc.is_null(rep)).to_numpy(zero_copy_only=False)
        k, r = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False) % MODULUS for x in (key, rep))
        mixed = k * 16807 + r * 7919
        u = [(codes_of(mixed + (feature * 104729 + seed * 31 + 1)) + 0.5) / float(MODULUS) for seed, feature in seeds]
        return pa.StructArray.from_arrays([pa.array(x, mask=unknown if unknown.any() else None) for x in u], [f.name for f in kind])

    return of


def with_students(df: DataFrame, seed: int, key: Column, rep: Column, names: list[str], df_of: int = 3) -> DataFrame:
    """``df`` with a column for each name: what ``student_t`` gives for the features 0, 1, ...

    Such a draw takes ``2 * (df_of + 1)`` uniforms, which are worked out for a batch of rows at
    once: as expressions they aren't compiled.
    """
    seeds = [s + more for s in (seed, *(seed + 100 + 2 * i for i in range(df_of))) for more in (0, 1)]
    of = _uniforms(tuple((s, i) for i in range(len(names)) for s in seeds))
    u = [[F.col(f"r_u.u{i * len(seeds) + j}") for j in range(len(seeds))] for i in range(len(names))]
    z = [[_normal(*x[j : j + 2]) for j in range(0, len(x), 2)] for x in u]
    found = {n: x[0] / F.sqrt(sum((F.pow(s, 2) for s in x[1:]), F.lit(0.0)) / df_of) for n, x in zip(names, z, strict=True)}
    return df.withColumn("r_u", of(_whole(key), _whole(rep))).withColumns(found).drop("r_u")


def codes_of(mixed: np.ndarray) -> np.ndarray:
    """The codes of ``draw_code`` from its sum of key, rep, feature and seed, below 2**62."""
    x = mixed % MODULUS
    square = x * x % MODULUS
    mixed = square * square % MODULUS * x % MODULUS
    for a in MULTIPLIERS:
        mixed = (mixed * a + 12345) % MODULUS
    return mixed


def uniform(seed, key, rep=0, feature=0) -> Column:
    """In (0, 1)."""
    return (draw_code(seed, key, rep, feature) + 0.5) / float(MODULUS)


def _normal(u: Column, v: Column) -> Column:
    return F.sqrt(-2 * F.log(u)) * F.cos(v * (2 * math.pi))


def normal(seed, key, rep=0, feature=0) -> Column:
    """Box-Muller."""
    return _normal(uniform(seed, key, rep, feature), uniform(int(seed) + 1, key, rep, feature))


def cauchy(seed, key, rep=0, feature=0) -> Column:
    return F.tan((uniform(seed, key, rep, feature) - 0.5) * math.pi)


def student_t(seed, key, rep=0, feature=0, df: int = 3) -> Column:
    """A normal over the root of a mean of ``df`` squared normals."""
    squares = sum((F.pow(normal(int(seed) + 100 + 2 * i, key, rep, feature), 2) for i in range(df)), F.lit(0.0))
    return normal(seed, key, rep, feature) / F.sqrt(squares / df)


# The same in SQL text, for use inside expressions.
def permuted_sql(mixed: str) -> str:
    m = f"CAST({MODULUS} AS BIGINT)"
    x = f"({mixed} % {m})"
    code = f"((({x} * {x} % {m}) * ({x} * {x} % {m}) % {m}) * {x} % {m})"
    for a in MULTIPLIERS:
        code = f"(({code} * CAST({a} AS BIGINT) + CAST(12345 AS BIGINT)) % {m})"
    return code


def draw_sql(seed: int, key: str, rep: str = "0", feature: int = 0) -> str:
    m = f"CAST({MODULUS} AS BIGINT)"
    mixed = f"((CAST({key} AS BIGINT) % {m}) * CAST(16807 AS BIGINT) + (CAST({rep} AS BIGINT) % {m}) * CAST(7919 AS BIGINT) + CAST({feature * 104729 + seed * 31 + 1} AS BIGINT))"
    return f"(({permuted_sql(mixed)} + CAST(0.5 AS DOUBLE)) / CAST({MODULUS} AS DOUBLE))"


def normal_sql(seed: int, key: str, rep: str = "0", feature: int = 0) -> str:
    return f"(sqrt(-2 * ln({draw_sql(seed, key, rep, feature)})) * cos({draw_sql(seed + 1, key, rep, feature)} * {2 * math.pi!r}))"
