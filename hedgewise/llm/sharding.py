"""Sharding by sampled splitters: near equal bytes per shard over one total order of the records.

Records are ordered by (hash of the text, tie). The tie is constant for ordinary groups of equal texts,
so such a group is never cut; for a group that is larger than ``max(fair share / 10, largest record)``
it is the record's id, so a hot group is spread over as many ranges and shards as its bytes need.

1. a size-weighted sample of (hash, tie) keys is drawn by hashing the ids;
2. its weighted quantiles cut the order into ``ranges`` ranges; a range that came out overfull is sampled
   again, more densely, and subdivided;
3. range totals (a few numbers per range) give each range its offset, and a window per range adds the
   running bytes inside it. A unit (group or record) goes to the shard that holds its middle byte.

The sample only balances the tasks: shards and slots are a pure function of the rows, because the sums are
exact. Everything is DataFrame work in the JVM, and texts are not shuffled unless they are carried along.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from hedgewise.llm.common import draw
from hedgewise.operators.ranks import with_bucket
from hedgewise.session import materialise

OVERHEAD_BYTES = 8
RANGES = 1024
DRAWS_PER_RANGE = 16
ROUNDS = 8


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD_BYTES).cast("bigint")


def _constant(value: list, kind: str) -> Column:
    """A literal of any nesting, folded once when the plan is made."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def _quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """The keys at which the sample's running weight passes a multiple of ``total / parts``."""
    sample = sorted(sample)
    total, run, found = sum(w for *_, w in sample), 0.0, []
    for key, tie, weight in sample:
        if int(run * parts / total) != int((run + weight) * parts / total):
            found.append((key, tie))
        run += weight
    return found


def _draws(rows: DataFrame, share: Column, seed: int) -> list[tuple[int, int, float]]:
    """Keys drawn with probability min(1, size * share), each standing for the bytes it represents."""
    chosen = rows.withColumn("_p", F.col("_size") * share).filter(draw(seed, "_id", "_key") < F.col("_p"))
    return [
        (r["_key"], r["_tie"], r["_w"])
        for r in chosen.select("_key", "_tie", (F.col("_size") / F.least(F.col("_p"), F.lit(1.0))).alias("_w")).collect()
    ]


def _ranged(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """Add ``_bucket``, the number of cuts at or below the record's (key, tie)."""
    at = _constant([{"key": k, "tie": t} for k, t in cuts], "array<struct<key:bigint,tie:bigint>>")
    # As a subquery the list stays one value; as a literal the optimizer would unfold every step of the search.
    at = rows.sparkSession.range(1).select(at.alias("cuts")).scalar()
    placed = rows.withColumn("_place", F.struct(F.col("_key").alias("key"), F.col("_tie").alias("tie")))
    return with_bucket(placed, "_place", at, len(cuts)).drop("_place")


def _cuts(rows: DataFrame, total: int, largest_unit: int, ranges: int) -> tuple[list[tuple[int, int]], list]:
    """Splitters, and per range its number, bytes and rows. Overfull ranges are subdivided."""
    cuts = sorted(set(_quantiles(_draws(rows, F.lit(ranges * DRAWS_PER_RANGE / total), 0), ranges)))
    target = total / ranges
    for again in range(1, ROUNDS + 1):
        totals = (
            _ranged(rows, cuts)
            .groupBy("_bucket")
            .agg(
                F.sum("_size").alias("bytes"),
                F.count("*").alias("rows"),
                (F.min(F.struct("_key", "_tie")) != F.max(F.struct("_key", "_tie"))).alias("divisible"),
            )
            .collect()
        )
        overfull = {r["_bucket"]: r["bytes"] for r in totals if r["bytes"] > 2 * target + largest_unit and r["divisible"]}
        if not overfull or again == ROUNDS:
            return cuts, totals
        shares = [DRAWS_PER_RANGE / target if b in overfull else 0.0 for b in range(len(cuts) + 1)]
        # Written first: a filter on the searched range would otherwise be pushed below the search and unfold it.
        ranged = materialise(_ranged(rows, cuts), "shard-ranges")
        denser = _draws(ranged, F.get(_constant(shares, "array<double>"), F.col("_bucket")), again)
        before = len(cuts)
        cuts = sorted({*cuts, *_quantiles(denser, max(2, round(sum(overfull.values()) / target)))}) if denser else cuts
        if len(cuts) == before:
            return cuts, totals
    return cuts, totals


def shard_by_bytes(
    df: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, ranges: int = RANGES
) -> DataFrame:
    """Put every record into one of ``shards`` shards of near equal bytes.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard and the columns in ``carry``.
    Equal texts lie next to each other, in one shard unless their group outgrows the limit above. A null
    text has the size of the overhead and the checksum of the empty text; null texts are one group. Repeated
    rows keep a slot each. An empty table gives an empty result.
    """
    carry = list(carry or [])
    base = df.select(
        F.col(doc_id).alias("_id"),
        record_size(text).alias("_size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("_crc"),
        F.xxhash64(text).alias("_key"),
        F.struct(*[F.col(c) for c in carry], F.lit(0).alias("_")).alias("_row"),
    )
    narrow = materialise(base.select("_id", "_size", "_key"), "shard-keys")
    whole = narrow.agg(F.sum("_size").alias("bytes"), F.max("_size").alias("largest"), F.count("*").alias("rows")).first()
    total = whole["bytes"] or 0
    if not total:
        return _named(base.select("*", F.lit(0).alias("_shard"), F.lit(0).alias("_slot")).limit(0), doc_id, carry)
    # Groups that outgrow the limit are fewer than total / limit, whatever the table holds.
    limit = max(total // (10 * shards), whole["largest"])
    hot = [
        r["_key"] for r in narrow.groupBy("_key").agg(F.sum("_size").alias("b")).filter(F.col("b") > limit).select("_key").collect()
    ]
    tie = F.when(F.array_contains(_constant(hot, "array<bigint>"), F.col("_key")), F.coalesce("_id", F.lit(0)).cast("bigint")) if hot else None
    add_tie = lambda rows: rows.withColumn("_tie", F.coalesce(tie, F.lit(0)) if hot else F.lit(0).cast("bigint"))
    keyed = add_tie(narrow)
    cuts, totals = _cuts(keyed, total, limit, ranges)

    bytes_before, rows_before, run_bytes, run_rows = [], [], 0, 0
    size_of = {r["_bucket"]: (r["bytes"], r["rows"]) for r in totals}
    for b in range(len(cuts) + 1):
        bytes_before.append(run_bytes)
        rows_before.append(run_rows)
        run_bytes, run_rows = run_bytes + size_of.get(b, (0, 0))[0], run_rows + size_of.get(b, (0, 0))[1]

    def placed(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("_bucket").orderBy("_key", "_tie", "_id", "_size")
        unit = Window.partitionBy("_bucket", "_key", "_tie")
        return (
            _ranged(rows, cuts)
            .withColumn("_upto", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_rank", F.row_number().over(order))
            .withColumn("_unit", F.sum("_size").over(unit))
            .withColumn("_from", F.min(F.col("_upto") - F.col("_size")).over(unit))
            .withColumn("_from", F.col("_from") + F.get(_constant(bytes_before, "array<bigint>"), F.col("_bucket")))
            .withColumn("_rank", F.col("_rank") + F.get(_constant(rows_before, "array<bigint>"), F.col("_bucket")))
            .withColumn("_shard", F.expr(f"least({shards - 1}, (2 * _from + _unit) * {shards} div (2 * {total}))").cast("int"))
        )

    starts = placed(keyed).groupBy("_shard").agg(F.min("_rank").alias("r")).collect()
    start = {r["_shard"]: r["r"] for r in starts}
    first = _constant([start.get(s, 0) for s in range(shards)], "array<bigint>")
    slotted = placed(add_tie(base)).withColumn("_slot", F.col("_rank") - F.get(first, F.col("_shard")))
    return _named(slotted, doc_id, carry)


def _named(rows: DataFrame, doc_id: str, carry: list[str]) -> DataFrame:
    return rows.select(
        F.col("_id").alias(doc_id),
        *[F.col("_row")[c].alias(c) for c in carry if c != doc_id],
        F.col("_size").alias("size"),
        F.col("_crc").cast("bigint").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
