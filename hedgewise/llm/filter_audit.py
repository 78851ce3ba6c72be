"""Filter interaction audit: what every order of a set of filters keeps and removes.

1. Every row gets its failure mask, one bit per filter, from native expressions. A row repeats a text when the
   same text stands under a smaller id anywhere in the table. The smallest id of a text is found by combining
   aggregates on (text digest, id, part), so a text that holds a third of the rows shrinks before it is shuffled.
2. Rows are counted by (part, mask): at most 32 cells per part for five filters.
3. Per part, a walk in Gray-code order switches one filter at a time. A cell keeps the number of active filters
   it fails; when that number leaves or reaches zero the cell's rows leave or join the running survivors. Each of
   the 32 states is stored, and a step of an order is the difference of two of them.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 100, 80, 10, "[#$%&*|]"
FILTERS = "ABCDE"
NULL_SALTS = 1024
COUNTS = ["rows", "good", "toxic"]
RESULT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_conditions(text: Column) -> list[Column]:
    """Failure conditions A to D: few words, repeated words, many capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * capitals > UPPER_PERCENT * F.length(text),
        text.rlike(MARKS),
    ]


def mask_cells(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, rows, good, toxic: the rows of every part by failure mask (bit i: filter i of ABCDE).

    A null text is empty, a null part the empty string. Rows that share id and text repeat each other but no
    smaller id, so none of them fails E for the others; a row without an id neither repeats nor is repeated,
    and has no label. A row is good or toxic if any label row of its id says so. An empty table has no cells.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    failing = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_conditions(F.col("text")))), F.lit(0))
    described = rows.select("doc_id", "part", failing.alias("own"), F.sha2("text", 256).alias("digest"))
    # Equal rows are counted before anything moves; rows without an id are dealt over many keys.
    some = described.groupBy("doc_id", "digest", "part", "own").agg(F.count("*").alias("n"))
    some = some.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(NULL_SALTS))).otherwise(F.lit(0)).cast("bigint"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    marked = some.join(marks.withColumn("salt", F.lit(0).cast("bigint")), ["doc_id", "salt"], "left")
    marked = marked.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # Of a text's rows in one (part, good, toxic) only those with the smallest id can be its first.
    named = F.col("doc_id").isNotNull()
    groups = marked.groupBy("digest", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("anonymous"),
        F.min("doc_id").alias("least"),
        F.min_by(F.when(named, F.col("n")), F.col("doc_id")).alias("n_least"),
    )
    first = groups.groupBy("digest").agg(F.min("least").alias("first"), F.collect_list(F.struct("part", "own", "good", "toxic", "n", "anonymous", "least", "n_least")).alias("g"))
    each = first.select("first", F.explode("g").alias("g")).select("first", "g.*")
    passing = F.col("anonymous") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0))
    kinds = F.array(F.struct(F.col("own").alias("mask"), passing.alias("rows")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - passing).alias("rows")))
    cells = each.select("part", "good", "toxic", F.explode(kinds).alias("k")).select("part", "good", "toxic", "k.*").filter("rows > 0")
    counted = lambda c: F.sum(F.when(F.col(c), F.col("rows")).otherwise(F.lit(0)))
    return cells.groupBy("part", "mask").agg(F.sum("rows").alias("rows"), counted("good").alias("good"), counted("toxic").alias("toxic"))


def gray_survivors(masks: np.ndarray, counts: np.ndarray, filters: int) -> np.ndarray:
    """The summed counts of the cells that pass, for every subset of filters; one filter changes per state.

    ``masks`` says which filters a cell fails, ``counts`` has one row per cell.
    """
    active = np.zeros(len(masks), np.int64)
    running = counts.sum(axis=0)
    states = np.zeros((1 << filters, counts.shape[1]), np.int64)
    states[0], subset = running, 0
    for turn in range(1, 1 << filters):
        bit = (turn & -turn).bit_length() - 1
        failing = (masks >> bit) & 1 == 1
        subset ^= 1 << bit
        if subset >> bit & 1:
            running = running - counts[failing & (active == 0)].sum(axis=0)
            active[failing] += 1
        else:
            active[failing] -= 1
            running = running + counts[failing & (active == 0)].sum(axis=0)
        states[subset] = running
    return states


def interactions(masks: np.ndarray, counts: np.ndarray, letters: str = FILTERS) -> pd.DataFrame:
    """One row per order and step with what the step keeps and removes, from the stored states."""
    k = len(letters)
    states = gray_survivors(masks, counts, k)
    everything = (1 << k) - 1
    fails = states[0][0] - states[[1 << i for i in range(k)], 0]
    alone = states[[everything ^ (1 << i) for i in range(k)], 0] - states[everything][0]
    shapley = np.zeros(k, np.int64)
    for i in range(k):
        for before in range(1 << k):
            if not before >> i & 1:
                size = before.bit_count()
                shapley[i] += factorial(size) * factorial(k - 1 - size) * (states[before][0] - states[before | 1 << i][0])
    out = []
    for order in permutations(range(k)):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            lost = states[before] - states[after]
            out.append((name, step, states[after][0], lost[0], fails[i] - lost[0], alone[i], lost[1], lost[2], shapley[i]))
            before = after
    return pd.DataFrame(out, columns=["filter_order", "step", *RESULT])


def _walk(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    found = interactions(cells["mask"].to_numpy(np.int64), cells[COUNTS].to_numpy(np.int64))
    found.insert(0, "part", key[0])
    return found


def audit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step and the counts of that step, one row per part, order and step, zeros included.

    kept, removed: rows after and by the step; redundant: rows that fail its filter but went earlier;
    unique_fails: rows that fail its filter only; good_lost, toxic_lost: labelled rows among the removed;
    shapley: the filter's removed rows summed over all orders. See ``mask_cells`` for nulls, ties and repeats;
    further columns of the tables are not looked at; a text of any length is used whole.
    """
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in RESULT)
    return mask_cells(df, labels, doc_id, text, part).groupBy("part").applyInPandas(_walk, schema)


_LETTERS = ", ".join(f"({1 << i}, '{c}')" for i, c in enumerate(FILTERS))
ORACLE_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
words AS (SELECT doc_id, text, part, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM words LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY ALL),
f(bit, c) AS (VALUES {_LETTERS}),
orders AS (
  SELECT a.c || b.c || x.c || d.c || e.c AS filter_order, [a.bit, b.bit, x.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f x, f d, f e
  WHERE a.bit | b.bit | x.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, bits[step]::INT AS own, list_sum(bits[1:step - 1])::INT AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
found AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (mask & (own | coalesce(earlier, 0)) = 0) AS kept,
    sum(n) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & own > 0) AS removed,
    sum(n) FILTER (mask & coalesce(earlier, 0) > 0 AND mask & own > 0) AS redundant,
    sum(n) FILTER (mask = own) AS unique_fails,
    sum(good) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & own > 0) AS good_lost,
    sum(toxic) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & own > 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM found"""
