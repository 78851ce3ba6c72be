"""Running totals, ranks and exact percentiles over sorted values without a global window.

A window ordered over a whole table puts it in one task, and one over a hot group puts that
group in one task. Here the sorted order is cut into buckets by splitter values:

1. rows that share a key and a value are collapsed by a partial and a final aggregate;
2. the splitters are the values of the rows with the smallest hash in each of many slots: a
   uniform sample that is a pure function of the data, so it is the same wherever and however
   often it is evaluated. It only balances buckets; no result depends on it;
3. totals per (key, bucket) are few; their running sums come back as one *carry row* per bucket;
4. a window per (key, bucket) adds up the carry row and the bucket's own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SUM, ALL = "cum_", "all_"
MAX_SPLITTERS = 1 << 15


def splitter_count(df: DataFrame) -> int:
    """Two buckets per shuffle partition, the cluster's own statement of its parallelism."""
    return min(MAX_SPLITTERS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _splitters(df: DataFrame, value: str, count: int) -> Column:
    """A scalar subquery holding at most ``count`` sorted, distinct values.

    Rows fall into ``count`` slots by hash and each slot keeps its smallest. Tasks combine their
    slots before the shuffle and slots merge in parallel, so no task sees more than its share.
    """
    hashable = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    drawn = df.select(F.col(value).alias("_value"), F.xxhash64(*hashable).alias("_draw"))
    sample = drawn.groupBy(F.pmod("_draw", F.lit(count)).alias("_slot")).agg(F.min_by("_value", "_draw").alias("_value"))
    return sample.agg(F.array_sort(F.collect_set("_value")).alias("_values")).select("_values").scalar()


def with_bucket(df: DataFrame, value: str, splitters: Column, count: int) -> DataFrame:
    """Add ``_bucket``: how many splitters are at or below the value, by binary search.

    Each halving is a projection of its own, so the whole search is generated code; as one nested
    lambda it would be interpreted, about ten times slower.
    """
    rows = df.withColumn("_splitters", splitters).withColumn("_bucket", F.lit(0))
    at = F.col("_bucket")
    for step in (1 << k for k in reversed(range(count.bit_length()))):
        reached = F.get("_splitters", at + (step - 1)) <= F.col(value)
        rows = rows.withColumn("_bucket", F.when(reached, at + step).otherwise(at))
    return rows.drop("_splitters")


def running_totals(
    df: DataFrame,
    keys: list[str],
    value: str,
    sums: dict[str, Column],
    descending: bool = False,
    collapse: bool = True,
) -> DataFrame:
    """One row per (keys, value) with each sum, its inclusive running total ``cum_<sum>`` and its
    total over the key ``all_<sum>``.

    Rows whose value is null or NaN are left out. ``collapse=False`` is for values that are already
    unique within their key (``sums`` then are plain per-row expressions).
    """
    rows = df.filter(F.col(value).isNotNull())
    if df.schema[value].dataType.typeName() in ("double", "float"):
        rows = rows.filter(~F.isnan(value))
    names = list(sums)
    count = splitter_count(df)
    splitters = _splitters(rows, value, count)
    if collapse:
        rows = rows.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    else:
        rows = rows.select(*keys, value, *[c.alias(n) for n, c in sums.items()])
    rows = with_bucket(rows, value, splitters, count).select(*keys, "_bucket", value, *names)

    before = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc() if descending else F.col("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = (
        rows.groupBy(*keys, "_bucket")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            *keys,
            "_bucket",
            F.lit(None).cast(rows.schema[value].dataType).alias(value),
            *[F.sum(n).over(before).alias(n) for n in names],
            *[F.sum(n).over(Window.partitionBy(*keys)).alias(ALL + n) for n in names],
        )
    )
    order = F.col(value).desc_nulls_first() if descending else F.col(value).asc_nulls_first()
    within = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.unionByName(carry, allowMissingColumns=True)
        .select(
            *keys,
            value,
            *names,
            *[F.sum(n).over(within).alias(SUM + n) for n in names],
            *[F.first(ALL + n).over(within).alias(ALL + n) for n in names],
        )
        .filter(F.col(value).isNotNull())
    )


def row_ranks(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``row_number`` per key over a unique order, with hot keys spread over many tasks.

    Buckets are cut by the first order column, which should have many values.
    """
    kept = [c for c in df.columns if c not in keys]
    count = splitter_count(df)
    splitters = _splitters(df.select(*keys, *order), order[0], count)
    rows = with_bucket(df, order[0], splitters, count).select(
        *keys,
        "_bucket",
        F.struct(*order).alias("_order"),
        F.struct(*kept).alias("_row"),
        F.lit(1).cast("bigint").alias("_n"),
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_n"))
        .select(
            *keys,
            "_bucket",
            F.lit(None).cast(rows.schema["_order"].dataType).alias("_order"),
            F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"),
            F.sum("_n").over(before).alias("_n"),
        )
    )
    within = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(F.col("_order").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.unionByName(carry)
        .withColumn(name, F.sum("_n").over(within))
        .filter(F.col("_row").isNotNull())
        .select(*keys, *[F.col("_row")[c].alias(c) for c in kept], name)
    )


def _nearby(at: Column, probs: list[float]) -> Column:
    """The percentiles that can fall on this row's positions, by arithmetic where they are evenly spaced.

    Nearly every row gets an empty list, so the exact test runs on a handful of rows.
    """
    k = len(probs)
    step = (probs[-1] - probs[0]) / (k - 1) if k > 1 else 1.0
    if any(abs(probs[0] + i * step - p) > 1e-9 for i, p in enumerate(probs)):
        return at
    span = (F.col("all_n") - 1).cast("double")
    index = lambda pos: (F.try_divide(pos.cast("double"), span) - probs[0]) / step
    low = F.greatest(F.ceil(index(F.col("cum_n") - F.col("n") - 1) - 1e-6), F.lit(0)).cast("int")
    high = F.least(F.floor(index(F.col("cum_n")) + 1e-6), F.lit(k - 1)).cast("int")
    return F.when(span == 0, at).when(high >= low, F.slice(at, low + 1, high - low + 1))


def percentile_rows(
    df: DataFrame, keys: list[str], value: str, probs: list[float], sums: dict[str, Column] | None = None
) -> DataFrame:
    """Exact interpolated percentiles, one row per (keys, prob).

    Columns: keys, ``prob_index``, ``prob``, ``n``, ``edge`` (the percentile), and for every
    extra sum ``below_<sum>`` (over values strictly below the edge), ``upto_<sum>`` (over values
    at or below it) and ``all_<sum>``.
    Position (n-1)*p is interpolated linearly between its two neighbours.
    """
    sums = {f"sum_{n}": c for n, c in (sums or {}).items()}
    extra = list(sums)
    totals = running_totals(df, keys, value, {"n": F.lit(1).cast("bigint"), **sums})
    # Which percentiles have their lower or upper neighbour in this row's range of positions?
    at = F.array(*[F.struct(F.lit(i).alias("prob_index"), F.lit(float(p)).alias("prob")) for i, p in enumerate(probs)])
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1

    def hit(p: Column) -> Column:
        pos = (F.col("all_n") - 1) * p["prob"]
        low, high = F.floor(pos), F.ceil(pos)
        return F.struct(
            p["prob_index"].alias("prob_index"),
            p["prob"].alias("prob"),
            (pos - low).alias("frac"),
            ((low >= first) & (low <= last)).alias("is_low"),
            ((high >= first) & (high <= last)).alias("is_high"),
        )

    hits = F.filter(F.transform(_nearby(at, probs), hit), lambda h: h["is_low"] | h["is_high"])
    found = totals.withColumn("_hit", F.explode(hits))
    kept = lambda cond, c: F.max(F.when(F.col(f"_hit.{cond}"), c))
    # The two neighbours are next to each other in the order, so nothing lies between them.
    edges = found.groupBy(*keys, F.col("_hit.prob_index").alias("prob_index")).agg(
        F.max("_hit.prob").alias("prob"),
        F.max("all_n").alias("n"),
        F.max("_hit.frac").alias("_frac"),
        kept("is_low", F.col(value)).alias("_low"),
        kept("is_high", F.col(value)).alias("_high"),
        *[F.max(f"all_{n}").alias(f"all_{n}") for n in extra],
        *[kept("is_low", F.col(SUM + n) - F.col(n)).alias(f"_before_{n}") for n in extra],
        *[kept("is_low", F.col(SUM + n)).alias(f"_upto_{n}") for n in extra],
        *[kept("is_high", F.col(SUM + n)).alias(f"_upto_high_{n}") for n in extra],
    )
    edge = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_frac")
    return edges.withColumn("edge", edge).select(
        *keys,
        "prob_index",
        "prob",
        "n",
        "edge",
        *[F.col(f"all_{n}").alias(f"all_{n[4:]}") for n in extra],
        *[
            F.when(F.col("edge") > F.col("_low"), F.col(f"_upto_{n}")).otherwise(F.col(f"_before_{n}")).alias(f"below_{n[4:]}")
            for n in extra
        ],
        *[
            F.when(F.col("edge") >= F.col("_high"), F.col(f"_upto_high_{n}"))
            .otherwise(F.col(f"_upto_{n}"))
            .alias(f"upto_{n[4:]}")
            for n in extra
        ],
    )


def percentile_table(df: DataFrame, keys: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """Exact percentiles as columns, one row per key."""
    rows = percentile_rows(df, keys, value, list(names.values()))
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob_index") == i, F.col("edge"))).alias(n) for i, n in enumerate(names)]
    )
