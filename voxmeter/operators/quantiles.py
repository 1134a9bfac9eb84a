"""Exact order statistics without a group in one buffer: mergeable sketches guess, counts of ranges decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxmeter.sources.scratch import cut

#: Values between a rank's bounds that are sorted at last, by one task for a group and rank.
SORTED = 200_000
#: A sketch's size, the shares of ranks whose quantiles are taken from it, and by how much of all ranks they are taken to be off.
SKETCH, GRID, OFF = 1024, 256, 0.01


def at_ranks(df: DataFrame, value: Column, ranks: dict[str, Callable[[Column], Column]], by: list[str]) -> DataFrame:
    """Per group of ``by``: n, the number of its values, and for each name the value at the rank (from 0) that its function gives for n.

    Each pass counts, by group and rank, the values below and within the bounds known, and
    sketches those within; the sketch's quantiles beside the rank are the next bounds. Bounds
    that turn out to miss the rank are dropped for those before, and the next ones are wider.
    When few values are left, or all are equal, they are counted by value. Null values don't
    count; groups without values have no row. NaN is the largest value.
    """
    names, keys = list(ranks), lambda right: [F.col(c).eqNullSafe(F.col(f"{right}{c}")) for c in by]
    rows = df.select(*by, value.cast("double").alias("v")).where("v IS NOT NULL")
    numbers = rows.where(~F.isnan("v"))
    rank = lambda k: ranks[k](F.col("n")).cast("long")
    within = lambda k: F.coalesce(F.col("v") >= F.col(f"lo_{k}"), F.lit(True)) & F.coalesce(F.col("v") <= F.col(f"hi_{k}"), F.lit(True))
    sketch = lambda x: F.kll_sketch_agg_double(x, F.lit(SKETCH))
    is_open = lambda k: ~F.coalesce(F.col(f"lo_{k}") == F.col(f"hi_{k}"), F.lit(False)) & (F.col(f"in_{k}") > SORTED) & (rank(k) < F.col("real"))
    left = F.max(F.greatest(F.lit(0), *[F.when(is_open(k), F.col(f"in_{k}")).otherwise(0) for k in names]))

    def with_bounds(small: DataFrame) -> DataFrame:
        """The numbers with the bounds of their group."""
        renamed = small.withColumnsRenamed({c: f"g_{c}" for c in by})
        return numbers.join(renamed, keys("g_")) if by else numbers.crossJoin(F.broadcast(renamed))

    # The first pass: no bounds, one sketch for all ranks.
    none = F.lit(None).cast("double")
    first = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.isnan("v")).alias("real"), sketch(F.when(~F.isnan("v"), F.col("v"))).alias("s"))
    state = cut(first.select(*by, "n", "real", *[c for k in names for c in (none.alias(f"lo_{k}"), none.alias(f"hi_{k}"), F.lit(0).cast("long").alias(f"below_{k}"), F.col("real").alias(f"in_{k}"), F.col("s").alias(f"sketch_{k}"))]))
    most, off = state.agg(left).first()[0], OFF
    while (most or 0) > SORTED and off < 1:
        share = lambda k: (rank(k) - F.col(f"below_{k}")) / F.col(f"in_{k}")
        place = {"lo": lambda k: F.floor(F.greatest(F.lit(0.0), share(k) - off) * GRID), "hi": lambda k: F.ceil(F.least(F.lit(1.0), share(k) + off) * GRID)}
        grid = lambda k: F.kll_sketch_get_quantile_double(F.col(f"sketch_{k}"), F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
        guess = state.withColumns({f"grid_{k}": F.when(is_open(k), grid(k)) for k in names})
        guess = guess.withColumns({f"new_{side}_{k}": F.when(is_open(k), F.get(f"grid_{k}", f(k).cast("int"))).otherwise(F.col(f"{side}_{k}")) for k in names for side, f in place.items()})
        joined = with_bounds(guess.select(*by, *[F.col(f"new_{side}_{k}").alias(f"{side}_{k}") for k in names for side in ("lo", "hi")]))
        seen = joined.groupBy(*by).agg(*[c for k in names for c in (F.count_if(F.coalesce(F.col("v") < F.col(f"lo_{k}"), F.lit(False))).alias(f"b_{k}"), F.count_if(within(k)).alias(f"i_{k}"), sketch(F.when(within(k), F.col("v"))).alias(f"s_{k}"))])
        seen = seen.withColumnsRenamed({c: f"t_{c}" for c in by})
        both = guess.join(seen, keys("t_")) if by else guess.crossJoin(F.broadcast(seen))
        hit = {k: (F.col(f"b_{k}") <= rank(k)) & (rank(k) < F.col(f"b_{k}") + F.col(f"i_{k}")) for k in names}
        now = [F.when(hit[k], F.col(new)).otherwise(F.col(f"{old}_{k}")).alias(f"{old}_{k}") for k in names for new, old in ((f"new_lo_{k}", "lo"), (f"new_hi_{k}", "hi"), (f"b_{k}", "below"), (f"i_{k}", "in"), (f"s_{k}", "sketch"))]
        state = cut(both.select(*by, "n", "real", *now))
        before, most = most, state.agg(left).first()[0]
        off = off * 2 if most >= before else off

    bounds = state.select(*by, "n", "real", *[f"{x}_{k}" for k in names for x in ("lo", "hi", "below")])
    hits = F.filter(F.array(*[F.when(within(k) & (rank(k) < F.col("real")), F.struct(F.lit(k).alias("k"), F.col(f"below_{k}").alias("below"), rank(k).alias("rank"))) for k in names]), lambda x: x.isNotNull())
    counted = with_bounds(bounds).select(*by, "v", F.explode(hits).alias("t")).groupBy(*by, "t", "v").agg(F.count("*").alias("c"))
    counted = counted.withColumn("upto", F.col("t.below") + F.sum("c").over(W.partitionBy(*by, "t.k").orderBy("v")))
    found = counted.where((F.col("upto") > F.col("t.rank")) & (F.col("upto") - F.col("c") <= F.col("t.rank")))
    found = found.groupBy(*by).agg(*[F.max(F.when(F.col("t.k") == k, F.col("v"))).alias(k) for k in names]).withColumnsRenamed({c: f"f_{c}" for c in by})
    # A rank beyond all numbers is among the NaN.
    out = bounds.join(found, keys("f_"), "left") if by else bounds.crossJoin(F.broadcast(found))
    return out.select(*by, "n", *[F.when((rank(k) >= F.col("real")) & (F.col("n") > 0), F.lit(float("nan"))).otherwise(F.col(k)).alias(k) for k in names])


def percentiles(df: DataFrame, value: Column, shares: dict[str, float], by: list[str]) -> DataFrame:
    """Per group that has a value: each named percentile, linear between the two nearest ranks."""
    at = lambda p: lambda n: (n - 1) * p
    ranks = {}
    for k, p in shares.items():
        ranks |= {f"{k}_low": lambda n, p=p: F.floor(at(p)(n)), f"{k}_high": lambda n, p=p: F.ceil(at(p)(n))}
    got = at_ranks(df, value, ranks, by)

    def between(k: str, p: float) -> Column:
        low, high, place = F.col(f"{k}_low"), F.col(f"{k}_high"), at(p)(F.col("n"))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return got.select(*by, *[between(k, p).alias(k) for k, p in shares.items()])
