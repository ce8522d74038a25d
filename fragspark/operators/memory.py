"""Replay memory over tables: n-step returns, priorities, and draws in proportion to them, without a key's rows or all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .ranges import numbered, ranged

#: Steps that one window takes together, and what a priority of 1 counts in draws.
BLOCK = 65_536
UNITS = 1_000_000
SPREAD = 1 << 32


def n_step(steps: DataFrame, episode: str, order: list[str], reward: str, state: str, n: int = 5, gamma: float = 1.0) -> DataFrame:
    """The steps with n_return (the next n rewards of the episode, this one's first, the j-th by gamma ** j), next_state (the
    state n steps on, null beyond the episode's end) and terminal (nothing follows n steps on).

    All steps stand in one order of episode, then `order`, whose ties must not matter; blocks of them by their places,
    each with the n first steps of the next one, are what a task sees: an episode may be as long as it likes. A null
    episode is one like any other, a null reward counts as 0. Columns `place`, `block` and `own` must not be there.
    """
    placed = written(numbered(steps, [episode, *order]), "steps")
    own = F.col("place") - F.pmod("place", F.lit(BLOCK))
    first = F.pmod("place", F.lit(BLOCK)) < n
    blocks = placed.withColumn("block", F.explode(F.when(first & (own > 0), F.array(own, own - BLOCK)).otherwise(F.array(own)))).withColumn("own", F.col("block") == own)
    window = Window.partitionBy("block").orderBy("place")
    here = lambda j: F.lead(F.struct(F.col(episode).alias("episode"), F.col(reward).alias("reward"), F.col(state).alias("state")), j).over(window)
    ahead = blocks.withColumns({f"_step{j}": here(j) for j in range(1, n + 1)})
    same = lambda j: F.col(f"_step{j}").isNotNull() & F.col(f"_step{j}.episode").eqNullSafe(F.col(episode))
    total = F.coalesce(F.col(reward), F.lit(0))
    for j in range(1, n):
        one = F.when(same(j), F.coalesce(F.col(f"_step{j}.reward"), F.lit(0))).otherwise(F.lit(0))
        total = total + (one if gamma == 1 else one * F.lit(float(gamma) ** j))
    out = ahead.where("own").withColumns({"n_return": total, "next_state": F.when(same(n), F.col(f"_step{n}.state")), "terminal": ~same(n)})
    return out.select(*steps.columns, "n_return", "next_state", "terminal")


def newest(rows: DataFrame, order: list[str], capacity: int) -> DataFrame:
    """The `capacity` last rows of an order: what a memory of that size still holds."""
    placed = written(numbered(rows, order), "stored")
    return placed.where(F.col("place") >= placed.count() - capacity).drop("place")


def priority(error: Column, epsilon: float = 1e-7, alpha: float = 0.6, upper: float = 1.0) -> Column:
    """(|error| + epsilon, at most upper) ** alpha; null where no error is known yet."""
    return F.pow(F.least(F.abs(error) + F.lit(epsilon), F.lit(float(upper))), F.lit(float(alpha)))


def with_priorities(rows: DataFrame, error: str, epsilon: float = 1e-7, alpha: float = 0.6, upper: float = 1.0) -> DataFrame:
    """The rows with their `priority`; a step without an error (new in the memory) has the largest of all, or upper ** alpha where none has one."""
    one = rows.withColumn("priority", priority(F.col(error), epsilon, alpha, upper))
    most = one.agg(F.max("priority")).first()[0]
    return one.fillna(float(upper) ** alpha if most is None else most, ["priority"])


def re_priced(rows: DataFrame, errors: DataFrame, keys: list[str], error: str) -> DataFrame:
    """The rows with the errors that a table (keys, error) of the last draws' steps has for some of them; the others keep theirs."""
    new = errors.select(*keys, F.col(error).alias("_new")).dropDuplicates(keys)
    return rows.join(new, keys, "left").withColumn(error, F.coalesce("_new", error)).select(*rows.columns)


def uniform(seed: int, number: Column) -> Column:
    """A whole number below 2 ** 32 from a seed and a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), number.cast("string"))), 1, 8), 16, 10).cast("long")


def drawn(rows: DataFrame, order: list[str], size: int, seed: int = 0, beta: float = 0.4) -> DataFrame:
    """`size` draws from rows with a `priority`, one from each of as many equal shares of their sum: draw (from 0), the row, weight.

    The rows stand in an order without ties; priorities, in whole millionths (at least one), fill an interval there, and
    draw j falls at a random place of share j. A row of a large priority is drawn by several shares. weight is
    (priority / the least one) ** -beta. Sums are exact, so every draw meets one row. Ranges of rows know their sums, as
    the inner nodes of a sum tree do; what a row must know for its draws is the sum before it. No rows: no draws.
    """
    units = F.greatest(F.lit(1), F.round(F.col("priority") * UNITS)).cast("long")
    cut = ranged(rows.withColumn("_units", units), *order)
    sums = written(cut.groupBy("range").agg(F.sum("_units").alias("sum"), F.min("_units").alias("low")), "sums")
    total, least = sums.agg(F.sum("sum"), F.min("low")).first()
    if not total:
        return cut.select(F.lit(0).cast("long").alias("draw"), *rows.columns, F.lit(1.0).alias("weight")).where("false")
    before = sums.withColumn("base", F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range", "base")  # one row per range
    upto = F.sum("_units").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = cut.withColumn("_upto", upto).join(F.broadcast(before), "range").withColumn("_high", F.col("base") + F.col("_upto")).withColumn("_low", F.col("_high") - F.col("_units"))
    wide = "decimal(20,0)"
    share = lambda c: F.expr(f"CAST(CAST({c} AS {wide}) * {size} div {total} AS BIGINT)")
    draws = placed.withColumn("draw", F.explode(F.sequence(share("_low"), share("(_high - 1)"))))
    at = draws.withColumn("_u", uniform(seed, F.col("draw"))).withColumn("_at", F.expr(f"CAST((CAST(draw AS {wide}) * {SPREAD} + _u) * CAST({total} AS {wide}) div CAST({size * SPREAD} AS {wide}) AS BIGINT)"))
    return at.where("_at >= _low and _at < _high").select("draw", *rows.columns, F.pow(F.col("_units") / F.lit(least), F.lit(-float(beta))).alias("weight"))


def drawn_once(rows: DataFrame, keys: list[str], size: int, seed: int = 0) -> DataFrame:
    """`size` different rows (all, if fewer), one after another in proportion to the priorities of what is left: the least of exponential keys, -ln(u) / priority."""
    u = (uniform(seed, F.concat_ws(":", *keys)) + F.lit(0.5)) / F.lit(float(SPREAD))
    return rows.withColumn("_key", -F.ln(u) / F.col("priority")).orderBy("_key", *keys).limit(size).drop("_key")
