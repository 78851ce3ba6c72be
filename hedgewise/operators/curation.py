"""Building evaluation sets: fingerprints, deduplication, sampling, splits, health checks, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hedgewise.functions.common import draw_key, let, strip
from hedgewise.functions.text import is_blank, question_fingerprint
from hedgewise.operators.ranks import row_ranks
from hedgewise.session import join_small


def with_fingerprint(df: DataFrame, head_chars: int | None = None) -> DataFrame:
    return df.withColumn("fingerprint", question_fingerprint(F.col("question"), head_chars))


def dedup_against_pool(new: DataFrame, pool: DataFrame, head_chars: int | None = None) -> DataFrame:
    """Rows whose fingerprint the pool does not hold. ``head_chars=200`` compares beginnings only.

    The pool is reduced to distinct fingerprints before the join, so a question copied many
    times in it is one row, and a pool of counted, small size is broadcast, so that the new rows
    stay where they are. Repeats inside ``new`` stay (see ``drop_repeats``).
    """
    known = with_fingerprint(pool.select("question"), head_chars).select("fingerprint").distinct()
    return join_small(with_fingerprint(new, head_chars), known, ["fingerprint"], "left_anti")


def dedup_report(new: DataFrame, pool: DataFrame) -> DataFrame:
    """How many new rows are available and excluded.

    Both sides are counted per fingerprint first, so a question copied a billion times is one
    row by the time fingerprints meet.
    """
    mine = with_fingerprint(new.select("question")).groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("copies")
    )
    known = with_fingerprint(pool.select("question")).select("fingerprint", F.lit(True).alias("known"))
    met = mine.join(known.distinct(), "fingerprint", "left")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("copies"))), F.lit(0))
    return met.agg(
        n(F.col("known").isNull()).alias("available"),
        n(F.col("known").isNotNull()).alias("excluded"),
        F.count(F.when(F.col("known").isNull(), F.lit(1))).alias("available_distinct"),
    )


def drop_repeats(df: DataFrame) -> DataFrame:
    """One row per fingerprint, the one with the smallest row_id.

    Only (fingerprint, row_id) is aggregated; copies combine in each task before the shuffle.
    """
    rows = with_fingerprint(df)
    first = rows.groupBy("fingerprint").agg(F.min("row_id").alias("row_id")).select("row_id")
    return rows.join(first, "row_id", "left_semi")


SAMPLE_SALTS = 256


def sample_n_per_source(df: DataFrame, n: int, seed: int = 42, source: str = "source") -> DataFrame:
    """min(n, available) rows per source, the same for a seed however the data is partitioned.

    Only (source, row_id, draw) is ranked: first within salted parts of each source, then among
    the parts' best, so that a source with most of the rows never meets in one task.
    """
    drawn = df.select(source, "row_id", draw_key(seed, "row_id").alias("_draw"))
    drawn = drawn.withColumn("_salt", F.pmod("_draw", F.lit(SAMPLE_SALTS)))
    for part in ([source, "_salt"], [source]):
        order = Window.partitionBy(*part).orderBy("_draw", "row_id")
        drawn = drawn.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).drop("_k")
    return join_small(df, drawn.select("row_id"), ["row_id"], "left_semi")


def _beside(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``few`` has one row per key, or one row in all; its columns come beside every row."""
    if keys:
        return join_small(rows, few, keys, "inner")
    return rows.withColumns({c: few.select(c).scalar() for c in few.columns})


def _quotas(sizes: DataFrame, stratum: str, share: Column, wanted: Column, name: str, keys: list[str]) -> DataFrame:
    """Largest-remainder share of ``wanted`` over the strata of a key, one row per stratum.

    Remainders are ranked in buckets, ties by stratum, so any number of strata is spread over tasks.
    """
    totals = sizes.groupBy(*keys).agg(F.sum(share).alias("_total"), F.max(wanted).alias("_wanted"))
    rows = _beside(sizes, totals, keys).withColumn("_exact", F.col("_wanted") * share / F.col("_total"))
    left = rows.groupBy(*keys).agg((F.max("_wanted") - F.sum(F.floor("_exact"))).alias("_left"))
    rest = F.struct((F.floor("_exact") - F.col("_exact")).alias("r"), F.col(stratum).alias("s"))
    ranked = row_ranks(rows.withColumn("_rest", rest), keys, ["_rest"], "_place")
    bonus = (F.col("_place") <= F.col("_left")).cast("int")
    quota = (F.floor("_exact") + bonus).cast("bigint")
    return _beside(ranked, left, keys).withColumn(name, quota).select(*sizes.columns, name)


def _ranked_in_stratum(df: DataFrame, strata: list[str], seed: int) -> DataFrame:
    """Rank of each row_id within its stratum by draw; only (stratum, draw, row_id) is moved."""
    keyed = df.select(*strata, "row_id", draw_key(seed, "row_id").alias("_draw"))
    return row_ranks(keyed, strata, ["_draw", "row_id"], "_rank").drop("_draw")


def stratified_split3(
    df: DataFrame, stratum: str = "source", held_out: int = 600, test: int = 300, seed: int = 42
) -> DataFrame:
    """train / validation / test with ``held_out`` rows set aside by stratum and ``test`` of them tested.

    The result is (row_id, stratum, split): join it to the rows by ``row_id``.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    sizes = _quotas(sizes, stratum, F.col("_n"), F.lit(held_out), "_held", [])
    sizes = _quotas(sizes, stratum, F.col("_held"), F.lit(test), "_test", []).select(stratum, "_held", "_test")
    ranked = join_small(_ranked_in_stratum(df, [stratum], seed), sizes, [stratum], "inner")
    split = (
        F.when(F.col("_rank") <= F.col("_test"), F.lit("test"))
        .when(F.col("_rank") <= F.col("_held"), F.lit("validation"))
        .otherwise(F.lit("train"))
    )
    return ranked.select("row_id", stratum, split.alias("split"))


def stratified_holdout(df: DataFrame, label: str, share: float = 0.2, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """80/20 by label, within each of the keys; two labels never mean two tasks (see ``row_ranks``).

    Result: keys, row_id, label, split.
    """
    keys = keys or []
    sizes = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    wanted = sizes.groupBy(*keys).agg(F.ceil(F.sum("_n") * F.lit(share)).alias("_want"))
    sizes = _quotas(_beside(sizes, wanted, keys), label, F.col("_n"), F.col("_want"), "_held", keys)
    ranked = join_small(_ranked_in_stratum(df, [*keys, label], seed), sizes.select(*keys, label, "_held"), [*keys, label], "inner")
    split = F.when(F.col("_rank") <= F.col("_held"), F.lit("test")).otherwise(F.lit("train"))
    return ranked.select(*keys, "row_id", label, split.alias("split"))


def stratified_folds(df: DataFrame, label: str, folds: int = 5, seed: int | None = 42, keys: list[str] | None = None) -> DataFrame:
    """A fold number per row, even within every label of a key. Without a seed rows keep their row_id order."""
    strata = [*(keys or []), label]
    if seed is None:
        ranked = row_ranks(df.select(*strata, "row_id"), strata, ["row_id"], "_rank")
    else:
        ranked = _ranked_in_stratum(df, strata, seed)
    return ranked.select(*(keys or []), "row_id", label, ((F.col("_rank") - 1) % folds).cast("int").alias("fold"))


def hash_folds(df: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """Folds straight from the key: even in expectation, and no shuffle at all."""
    return df.withColumn("fold", (draw_key(seed, "row_id") % folds).cast("int"))


def check_choices(labels: Column, texts: Column) -> Column:
    """Both lists present, equally long, at least two entries."""
    return F.coalesce((F.size(labels) == F.size(texts)) & (F.size(labels) >= 2), F.lit(False))


def check_gold(labels: Column, texts: Column, gold_label: Column, gold_index: Column, gold_text: Column) -> Column:
    """Index in range and pointing at the gold text; a known label pointing at it too."""
    by_index = gold_index.isNull() | (
        (gold_index < F.size(texts)) & F.get(texts, gold_index).eqNullSafe(gold_text)
    )
    by_label = let(
        F.array_position(labels, gold_label).cast("int"),
        lambda at: at.isNull()
        | (at == 0)
        | ((at <= F.size(texts)) & F.get(texts, at - 1).eqNullSafe(gold_text)),
    )
    readable = labels.isNotNull() & texts.isNotNull()
    return F.coalesce(readable & by_index & by_label, F.lit(False))


def with_checks(df: DataFrame) -> DataFrame:
    """Canonical rows with ``valid_choices``, ``valid_gold``, ``bad_question`` and ``any_issue``."""
    c = F.col
    checked = df.withColumns(
        {
            "valid_choices": check_choices(c("choice_labels"), c("choice_texts")),
            "valid_gold": check_gold(
                c("choice_labels"), c("choice_texts"), c("gold_label"), c("gold_index"), c("gold_text")
            ),
            "bad_question": is_blank(c("question")),
        }
    )
    return checked.withColumn("any_issue", ~(c("valid_choices") & c("valid_gold") & ~c("bad_question")))


def health_summary(df: DataFrame) -> DataFrame:
    """Totals of every issue and the first bad row, in one aggregate."""
    rows = with_checks(df)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("valid_choices")).alias("invalid_choices"),
        F.count_if(~F.col("valid_gold")).alias("invalid_gold"),
        F.count_if(F.col("bad_question")).alias("empty_questions"),
        F.count_if(F.col("any_issue")).alias("any_issue"),
        F.min(F.when(F.col("any_issue"), F.col("row_id"))).alias("sample_bad_row"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """Nulls per column: one aggregate over the data, then one row per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "n_missing")


def _as_text(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    return F.to_json(column) if kind in ("array", "map", "struct") else F.col(column).cast("string")


def _cells(df: DataFrame, value: bool) -> DataFrame:
    """Long form: one row per cell with its column, a key of its content, and its length."""
    cells = []
    for c in df.columns:
        kind = df.schema[c].dataType.typeName()
        length = F.char_length(c) if kind == "string" else F.size(c) if kind in ("array", "map") else F.lit(None)
        text = _as_text(df, c)
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"),
                (text if value else F.md5(text)).alias("value" if value else "key"),
                length.cast("bigint").alias("length"),
            )
        )
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _distinct_cells(df: DataFrame) -> DataFrame:
    """Distinct contents per column by their 128-bit digest, so whole texts are never shuffled."""
    return _cells(df, value=False).groupBy("column_name", "key").agg(
        F.count(F.lit(1)).alias("n"), F.max("length").alias("length")
    )


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, distinct values, smallest value, shortest and longest value."""
    counted = _distinct_cells(df).groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("key").alias("n_unique"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
    )
    samples = df.agg(*[F.min(_as_text(df, c)).alias(c) for c in df.columns]).unpivot(
        [], df.columns, "column_name", "sample_value"
    )
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return counted.join(samples, "column_name").withColumn("dtype", F.element_at(kinds, F.col("column_name")))


def profile_values(df: DataFrame, max_distinct: int = 20) -> DataFrame:
    """Value counts of the columns with few distinct values; other columns are left out before the shuffle."""
    few = (
        _distinct_cells(df)
        .filter(F.col("key").isNotNull())
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("k"))
        .filter(F.col("k") <= max_distinct)
        .select("column_name")
    )
    cells = join_small(_cells(df, value=True), few, ["column_name"], "left_semi")
    return cells.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_lengths(df: DataFrame) -> DataFrame:
    """Distribution of text lengths and list sizes per column."""
    sized = _cells(df, value=False).filter(F.col("length").isNotNull())
    return sized.groupBy("column_name", "length").agg(F.count(F.lit(1)).alias("n"))


def group_count_stats(df: DataFrame, group: str) -> DataFrame:
    """Number of groups with their smallest, largest and mean size."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min("n").alias("min_size"),
        F.max("n").alias("max_size"),
        F.avg("n").alias("mean_size"),
    )


def group_extremes(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """The k largest and k smallest groups."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.orderBy(F.desc("n"), group).limit(k).withColumn("extreme", F.lit("largest"))
    smallest = sizes.orderBy("n", group).limit(k).withColumn("extreme", F.lit("smallest"))
    return largest.unionByName(smallest)


def value_counts(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Counts per value, missing ones included, most frequent first."""
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)


def select_split(df: DataFrame, split: str | None = None) -> DataFrame:
    """Rows of one split. Without a request several splits are an error, as is a split with no rows."""
    if "split" not in df.columns:
        if split is not None:
            raise ValueError("the table has no 'split' column but a split was requested")
        return df
    normal = F.lower(strip(F.col("split").cast("string")))
    rows = df.withColumn("split", normal)
    if split is None:
        ends = rows.agg(F.min("split").alias("low"), F.max("split").alias("high")).first()
        if ends["low"] != ends["high"]:
            raise ValueError(f"several splits present, from {ends['low']!r} to {ends['high']!r}; choose one")
        return rows
    chosen = rows.filter(F.col("split") == split.strip().lower())
    if chosen.isEmpty():
        some = sorted(r[0] for r in rows.select("split").filter("split is not null").distinct().limit(20).collect())
        raise ValueError(f"no rows with split {split!r}; present are, among others: {some}")
    return chosen
