"""Aggregations over run logs, and the minima that calibration picks.

Logs are one table for all systems (schemas.ANY_LOG and system_id): adaptive runs fill reparse columns, single passes
leave them null. The figures of a system come from one grouped pass, its quantile from two more; systems without rows
keep a row by a left join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept_tokens() -> Column:
    """Tokens of the output that is kept: the second pass's if there was one and it has a count, else the first's; a
    single pass's own.
    """
    second = F.col("reparse_triggered") & F.col("reparse_output_tokens").isNotNull()
    return F.when(second, F.col("reparse_output_tokens")).otherwise(F.coalesce("first_pass_output_tokens", "output_token_count"))


def kept_runtime() -> Column:
    return F.coalesce("total_runtime_ms", "runtime_ms")


def mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


PARTS = 1 << 14  # buckets of values that differ by a factor of e


def quantiles(rows: DataFrame, key: str, value: Column, q: float) -> DataFrame:
    """key and quantile of the values that aren't null, exact and interpolated at q * (n - 1); null keys and keys
    without values have no row.

    Values are counted in buckets by their logarithm first: their number hangs on the values' range alone, not on how
    many there are. Only values of the buckets that hold the two ranks are looked at one by one, counted before they are
    dealt. So no task holds a key's values, however many there are.
    """
    v = rows.select(key, value.cast("double").alias("v")).where("v is not null").withColumn("at", bucket_of(F.col("v")))
    order = Window.partitionBy(key).orderBy("at")
    counts = v.groupBy(key, "at").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(key)))
    place = F.lit(float(q)) * (F.col("all") - 1)
    ranks = F.array_distinct(F.array(F.floor(place), F.ceil(place)))
    wanted = counts.withColumn("place", place).withColumn("rank", F.explode(ranks))
    wanted = wanted.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    wanted = wanted.select(key, "at", "place", "rank", (F.col("upto") - F.col("n")).alias("before"))
    # At most two rows a key.
    inside = v.join(F.broadcast(wanted), [key, "at"]).groupBy(key, "rank", "place", "before", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(key, "rank").orderBy("v"))
    found = inside.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    ends = found.groupBy(key, "place").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    low, high = F.floor("place"), F.ceil("place")
    mixed = (high - F.col("place")) * F.col("a") + (F.col("place") - low) * F.col("b")
    return ends.select(key, F.when((low == high) | (F.col("a") == F.col("b")), F.col("a")).otherwise(mixed).alias("quantile"))


def bucket_of(v: Column) -> Column:
    """A whole number that never falls as the value rises; NaN is above all others."""
    return F.when(F.isnan(v), F.lit((1 << 63) - 1)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * PARTS))


def adaptive_cost(low: Column, high: Column) -> Column:
    """Mean tiles: the first pass's, and the second's where it ran; a missing flag means it didn't."""
    return mean(low + F.when(F.coalesce(F.col("reparse_triggered"), F.lit(False)), high).otherwise(F.lit(0)))


def positive(n: float) -> float:
    if n <= 0:
        raise ValueError("tiles must be positive")
    return float(n)


def summaries(log: DataFrame, systems: DataFrame, p95: bool = True) -> DataFrame:
    """A row for each of systems (system_id, adaptive, low, high, tiles): sample_size, mean_runtime_ms, p95_runtime_ms,
    mean_output_tokens, reparse_count, reparse_rate, cost_tiles.

    Reparse figures are null for single passes; their cost is their tiles even without rows. The systems are few and
    broadcast. Without p95 that column is left out, and so are the two further passes over the log that it takes.
    """
    own = log.join(F.broadcast(systems.select("system_id", "low", "high")), "system_id")
    flag = F.coalesce(F.col("reparse_triggered"), F.lit(False))
    tiles = F.col("low") + F.when(flag, F.col("high")).otherwise(F.lit(0))
    grouped = own.groupBy("system_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(kept_runtime()).alias("rt"),
        F.avg(kept_tokens()).alias("tok"),
        F.count_if(flag).alias("rp"),
        F.avg(tiles).alias("cost"),
    )
    out = systems.join(grouped, "system_id", "left")
    if p95:
        out = out.join(quantiles(own, "system_id", kept_runtime(), 0.95).withColumnRenamed("quantile", "p"), "system_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return out.select(
        *systems.columns,
        n.alias("sample_size"),
        zero("rt").alias("mean_runtime_ms"),
        *([zero("p").alias("p95_runtime_ms")] if p95 else []),
        zero("tok").alias("mean_output_tokens"),
        F.when(F.col("adaptive"), F.coalesce("rp", F.lit(0)).cast("long")).alias("reparse_count"),
        F.when(F.col("adaptive"), F.coalesce(F.try_divide("rp", "n"), F.lit(0.0))).alias("reparse_rate"),
        F.when(F.col("adaptive"), zero("cost")).otherwise(F.col("tiles").cast("double")).alias("cost_tiles"),
    )


def histogram(log: DataFrame, value: Column, name: str) -> DataFrame:
    """system_id, value, n; arrays are taken apart."""
    return log.select("system_id", value.alias(name)).where(F.col(name).isNotNull()).groupBy("system_id", name).agg(F.count(F.lit(1)).alias("n"))


def as_maps(counts: DataFrame, name: str, to: str) -> DataFrame:
    """A map for each system, keys ascending."""
    return counts.groupBy("system_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "n")))).alias(to))


def code_histogram(log: DataFrame) -> DataFrame:
    return histogram(log, F.explode("verifier_failure_codes"), "code")


def deltas(measured: Column, target: Column) -> tuple[Column, Column]:
    """Absolute and relative deviation; null without a target."""
    return measured - target, F.try_divide(measured - target, target)


@dataclass(frozen=True)
class Targets:
    """Budget names and what they were selected to cost."""

    names: dict[str, float]

    def column(self, budget: Column) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for p in self.names.items() for x in p)), budget) if self.names else F.lit(None).cast("double")


def cost_summary(results: DataFrame, targets: Targets) -> DataFrame:
    """measured, target, delta, relative_delta and label of each system; adaptive ones have budgets low and high, others
    one name.
    """
    target = F.when(F.col("adaptive"), F.lit(None).cast("double")).otherwise(targets.column(F.col("budget_name")))
    label = F.when(
        F.col("adaptive"), F.concat(F.lit("low="), F.col("low").cast("string"), F.lit(" / high="), F.col("high").cast("string"))
    ).otherwise(F.coalesce(F.concat("budget_name", F.lit("="), F.col("tiles").cast("string")), F.lit("(no budget)")))
    out = results.withColumn("target", target)
    d, r = deltas(F.col("cost_tiles"), F.col("target"))
    return out.select("system_id", F.col("cost_tiles").alias("measured"), "target", d.alias("delta"), r.alias("relative_delta"), label.alias("label"))


def budget_grid(lows: DataFrame, highs: DataFrame) -> DataFrame:
    """low and high of all pairs with high not below low. Both are short lists of settings."""
    return lows.join(F.broadcast(highs), F.col("high") >= F.col("low"))


def select_pair(points: DataFrame, target: float) -> DataFrame:
    """The point (low, high, cost_tiles) with the least distance from the target, then the least low, then high. No rows
    if there are none.
    """
    best = points.agg(F.min(F.struct(F.abs(F.col("cost_tiles") - target).alias("distance"), "low", "high", "cost_tiles")).alias("b")).where("b is not null")
    return best.select("b.low", "b.high", F.lit(float(target)).alias("target"), F.col("b.cost_tiles").alias("measured"))


def select_fixed(points: DataFrame, target: float, tolerance: float) -> DataFrame:
    """The point (max_tiles, cost_tiles) nearest the target, those within the relative tolerance before all others, then
    the least tiles.
    """
    positive(target)
    outside = F.abs(F.col("cost_tiles") - target) / target > tolerance
    best = points.agg(F.min(F.struct(outside.alias("outside"), F.abs(F.col("cost_tiles") - target).alias("distance"), "max_tiles", "cost_tiles")).alias("b")).where("b is not null")
    return best.select("b.max_tiles", F.lit(float(target)).alias("target"), F.col("b.cost_tiles").alias("measured"), (~F.col("b.outside")).alias("within_tolerance"))


def one_row(df: DataFrame, what: str):
    """The row of a selection; ValueError if there is none."""
    if not (rows := df.take(1)):
        raise ValueError(f"no {what} to choose from")
    return rows[0]


def reparse_probability(measured: float, low: float, high: float) -> tuple[float, bool]:
    """What share of pages a second pass must have had for the measured cost, and whether that is none; ValueError
    outside 0 to 1.
    """
    positive(high)
    p = (measured - low) / high
    if not 0 <= p <= 1:
        raise ValueError(f"implied reparse probability {p} is outside [0, 1]")
    return p, p == 0


def tile_choice(sizes: DataFrame, most: int) -> DataFrame:
    """cols and rows of the tiling of each size (width, height): up to `most` tiles, ratio nearest the image's, then
    fewest tiles, then fewest columns.
    """
    grid = F.expr(f"filter(flatten(transform(sequence(1, {most}), n -> transform(filter(sequence(1, n), c -> n % c = 0), c -> struct(c as cols, n div c as rows)))), x -> true)")
    keyed = F.transform(
        grid,
        lambda g: F.struct(
            F.abs(g["cols"] / g["rows"] - F.col("width") / F.col("height")).alias("off"), (g["cols"] * g["rows"]).alias("tiles"),
            g["cols"].cast("long").alias("cols"), g["rows"].cast("long").alias("rows")
        )
    )
    return sizes.withColumn("best", F.array_min(keyed)).select(*sizes.columns, "best.cols", "best.rows")


def last_rows(log: DataFrame, order: str, *keys: str) -> DataFrame:
    """The last row of each key, by the order column."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, "last.*")


def page_matrix(pages: DataFrame, log: DataFrame, systems: DataFrame) -> DataFrame:
    """page_id and systems, an array of each system's view of the page in the systems' order (ord). Of rows that repeat
    a page in a log the last (line_no) counts; pages without rows keep an empty array.
    """
    views = last_rows(log, "line_no", "system_id", "page_id").join(F.broadcast(systems.select("system_id", "ord")), "system_id")
    view = F.struct("ord", "system_id", kept_tokens().alias("output_tokens"), kept_runtime().alias("runtime_ms"), "reparse_triggered", "verifier_decision", "verifier_failure_codes")
    nested = views.groupBy("page_id").agg(F.sort_array(F.collect_list(view)).alias("systems"))
    return pages.select("page_id").join(nested, "page_id", "left").withColumn("systems", F.coalesce("systems", F.array().cast(nested.schema["systems"].dataType)))


def decision_hash() -> list[Column]:
    """n and decisions of a log's reparse decisions in their order: counted, and hashes by place put together, so no
    sequence is gathered.
    """
    flag = F.coalesce(F.col("reparse_triggered"), F.lit(False))
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("line_no", flag)).alias("decisions")]
