"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_ROWS = 1_000_000
MOST_HEAVY_KEYS = 10_000


def join_per_key(big: DataFrame, per_key: DataFrame, keys: list[str], n: str, heavy_rows: int = HEAVY_ROWS, at_most: int | None = None, how: str = "inner") -> DataFrame:
    """``big`` joined (``how``: inner or left) with the one row that ``per_key`` has for each key; ``n`` there counts the key's rows in ``big`` and drops out.

    A key with more rows than max(``heavy_rows``, all rows / 10 000) is dealt to as many tasks as it has times that number, its row in
    ``per_key`` repeated for each.  There are at most 10 000 such keys, which every task gets.  ``per_key`` is read three times and should be a
    written table or a cheap aggregate.  ``at_most``: a bound of all rows that is known already; if it is not above ``heavy_rows``, no key can be heavy.
    """
    if at_most is not None and at_most <= heavy_rows:
        return big.join(per_key.drop(n), keys, how)
    total = per_key.agg(F.sum(n)).first()[0] or 0
    limit = max(heavy_rows, -(-total // MOST_HEAVY_KEYS))
    if total <= limit:
        return big.join(per_key.drop(n), keys, how)
    parts = F.ceil(F.col(n) / F.lit(float(limit))).cast("int")
    heavy = per_key.filter(F.col(n) > limit).select(*keys, parts.alias("_parts"))
    rest = [c for c in big.columns if c not in keys]
    dealt = big.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*rest), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(n)
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def join_pairs(left: DataFrame, right: DataFrame, keys: list[str], pairs_per_task: int = 10_000_000) -> DataFrame:
    """Inner join in which a key may stand in very many rows of both sides, as where copies meet copies.

    A key that gives more than ``pairs_per_task`` pairs is laid out as a square grid of tasks: each of its rows goes to one line of the grid and is
    repeated along it, so that no task gets more than about that many pairs and n rows are repeated as often as the root of the tasks.
    Both sides are read twice and should be written tables or cheap.  Null keys match nothing.
    """
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    sides = count(left, "_l").join(count(right, "_r"), keys)
    grid = sides.filter(F.col("_l").cast("double") * F.col("_r") > pairs_per_task).select(*keys, F.ceil(F.sqrt(F.col("_l").cast("double") * F.col("_r") / F.lit(float(pairs_per_task)))).cast("int").alias("_grid"))
    most = grid.agg(F.count("*"), F.max("_grid")).first()
    if not most[0]:
        return left.join(right, keys)
    if most[0] <= MOST_HEAVY_KEYS:
        grid = F.broadcast(grid)

    def laid(df: DataFrame, mine: str, other: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        dealt = df.join(grid, keys, "left").withColumn("_grid", F.coalesce("_grid", F.lit(1)))
        line = F.pmod(F.xxhash64(*rest), F.col("_grid")).cast("int") if rest else F.lit(0)
        return dealt.withColumn(mine, line).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_grid") - 1))).drop("_grid")

    return laid(left, "_a", "_b").join(laid(right, "_b", "_a"), [*keys, "_a", "_b"]).drop("_a", "_b")
