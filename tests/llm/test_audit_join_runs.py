"""The filter audit, the n-gram join and the run detection against brute force and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from hedgewise.llm import filter_audit, near_dedup, ngram_join, periodic_runs, queries, recompression, set_links
from hedgewise.llm.common import table

LABELS = "doc_id bigint, quality int, toxic int"


def raw_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- 11 filter audit


def audit_by_hand(docs, labels):
    quality, toxic = defaultdict(bool), defaultdict(bool)
    for d, q, t in labels:
        quality[d] |= q == 1
        toxic[d] |= t == 1
    rows = []
    for d, text, part in docs:
        t, w = text or "", raw_words(text)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and any(o is not None and o < d and (u or "") == t for o, u, _ in docs),
        }
        rows.append((part or "", {f for f, x in fails.items() if x}, d is not None and quality[d], d is not None and toxic[d]))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_by = Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                removed_by[f] += len(gone)
                redundant = sum(f in r[1] for r in mine) - len(gone)
                left = [r for r in left if f not in r[1]]
                alone = sum(r[1] == {f} for r in mine)
                steps.append((order, step, f, (len(left), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone))))
        for order, step, f, counts in steps:
            out[part, "".join(order), step] = (*counts, removed_by[f])
    return out


def audited(docs, labels):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in filter_audit.audit(docs, labels).collect()}


@pytest.fixture(scope="module")
def audit_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 1, None), (6, None, 1), (10, 1, 1), (None, 1, 1), (99, 1, 1)], LABELS)


def test_audit_equals_every_order_walked_by_hand(spark, edge, audit_labels):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in edge.collect()]
    docs += [(100 + i, "A B # " * (i % 40) + "Word " * (i % 7), ["en", None, "de"][i % 3]) for i in range(60)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(4)
    labels = [tuple(r) for r in audit_labels.collect()]
    assert audited(rows, audit_labels) == audit_by_hand(docs, labels)


def test_audit_of_nothing_and_with_clashing_columns(spark, nothing, edge, clashing, audit_labels):
    assert filter_audit.audit(nothing, audit_labels).count() == 0
    assert audited(clashing, audit_labels) == audited(edge, audit_labels)
    empty = spark.createDataFrame([], LABELS)
    assert all(c[4] == c[5] == 0 for c in audited(edge, empty).values())


def test_gray_walk_equals_direct_sums():
    rng = np.random.default_rng(1)
    masks, counts = np.arange(64), rng.integers(0, 100, (64, 3))
    states = filter_audit.gray_survivors(masks, counts, 6)
    for subset in range(64):
        assert (states[subset] == counts[masks & subset == 0].sum(axis=0)).all()


# ---------------------------------------------------------------- 12 n-gram join


def grams(text, size=4):
    w = raw_words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()


def components_by_hand(rows):
    sets = defaultdict(list)
    for d, text in rows:
        sets[d].append(grams(text))
    ids = sorted(d for d in sets if d is not None)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= 85 * len(x | y):
                        lo, hi = sorted((root(a), root(b)))
                        parent[hi] = lo
    return Counter((d, len(grams(text)), None if d is None else root(d)) for d, text in rows)


def varied(seed, groups, members, words=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(words)}" for _ in range(rng.choice([6, 8, 12, 30, 60, 120, 260]))]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(words)}"
            rows.append((len(rows), " ".join(w[: len(w) - rng.choice([0, 0, 1, 2])])))
    return rows


def joined(df, **how):
    return Counter(tuple(r) for r in ngram_join.ngram_join(df, **how).select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("how", [{}, {"least": 2}, {"least": 2, "table": 40}])
def test_join_equals_all_pairs(spark, how):
    """With few rare tokens, sets are indexed by pairs and triples of frequent ones."""
    rows = varied(5, 9, 18)
    assert joined(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), **how) == components_by_hand(rows)


def test_join_on_awkward_rows(edge, clashing, nothing):
    want = components_by_hand([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert joined(edge) == joined(clashing) == want
    assert ngram_join.ngram_join(nothing).count() == 0


def test_prefixes_never_miss_a_link():
    rng = np.random.default_rng(3)
    frequent = {}
    for trial in range(400):
        n = int(rng.integers(6, 150))
        x = rng.choice(10**6, n, replace=False).astype(np.uint64)
        gone = rng.integers(0, max(1, n // 8) + 1)
        y = np.unique(np.append(x[gone:], rng.choice(10**6, int(rng.integers(0, n // 10 + 1))).astype(np.uint64)))
        if not set_links.linked(np.sort(x), y, 85, 100):
            continue
        for t in np.append(x, y):
            frequent.setdefault(int(t), int(rng.choice([0, 20, 5000], p=[0.05, 0.5, 0.45])))
        entries = [ngram_join.signatures(np.sort(s), np.array([frequent[int(t)] for t in np.sort(s)]), 16) for s in (x, y)]
        assert len(np.intersect1d(*entries)), trial


def test_near_misses_give_links_at_most_once_per_member():
    rng = np.random.default_rng(4)
    base = rng.choice(1 << 40, 100, replace=False).astype(np.uint64)
    for size in (100, 400):
        sets = []
        for _ in range(size):
            s = base.copy()
            s[rng.choice(100, 6, replace=False)] = rng.choice(1 << 40, 6).astype(np.uint64)
            sets.append(np.unique(s))
        found = set_links.spanning_links(np.arange(size), np.arange(size), np.zeros(size, np.int64), sets, 85, 100)
        assert len(found) < size and all(set_links.linked(sets[a], sets[b], 85, 100) for a, b in found)


# ---------------------------------------------------------------- 13 runs


def runs_by_hand(w):
    best = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(24, 3 * q):
                best[s, length] = min(q, best.get((s, length), q))
            i += i == s
    return sorted((s, q, length) for (s, length), q in best.items())


def repetitive(seed, texts):
    rng = random.Random(seed)
    out = []
    for _ in range(texts):
        w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(0, 160))]
        for _ in range(rng.randrange(0, 4)):
            a, p = rng.randrange(len(w) + 1), rng.randrange(1, 20)
            w = w[:a] + w[a : a + p] * rng.randrange(1, 12) + w[a:]
        out.append(w)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_runs_equal_brute_force(seed):
    texts = repetitive(seed, 8)
    found = periodic_runs.find_runs(np.array([x for w in texts for x in w], np.int64), np.array([len(w) for w in texts], np.int64))
    got = [[] for _ in texts]
    for t, s, length, q in zip(*found, strict=True):
        got[t].append((s, q, length))
    assert got == [runs_by_hand(w) for w in texts]


@pytest.mark.parametrize("seed", range(5))
def test_grammar_extensions_equal_direct_comparison(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 2, 600)
    words[200:500] = words[200:230].tolist() * 10
    ends = np.zeros(602, bool)
    ends[[0, 601]] = True
    symbols = np.concatenate([[100], words, [101]])
    grammar = recompression.build(symbols, ends)
    assert len(grammar) > 4 and len(grammar[-1].symbols) < 20
    i = rng.integers(1, 601, 2000)
    j = rng.integers(1, 601, 2000)
    i, j = i[i != j], j[i != j]

    def direct(a, b, step):
        k = 0
        while symbols[a + step * k] == symbols[b + step * k] and not ends[a + step * k]:
            k += 1
        return k

    assert recompression.extensions(grammar, i, j).tolist() == [direct(a, b, 1) for a, b in zip(i, j, strict=True)]
    back = recompression.extensions(recompression.mirrored(grammar), 601 - i, 601 - j)
    assert back.tolist() == [direct(a, b, -1) for a, b in zip(i, j, strict=True)]


def digest_by_hand(doc_id, text):
    w = raw_words(text)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
    runs = runs_by_hand(w)
    dropped = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = min(((-Fraction(length, q), s, q, length) for s, q, length in runs), default=None)
    first = (None,) * 4 if best is None else (best[1], best[3], best[2], 1000 * best[3] // best[2])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *first, sha("".join(f"{s},{length},{q}\n" for s, q, length in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_of_awkward_rows_equal_brute_force(spark, edge, clashing):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect() if len(r["text"] or "") < 50_000]
    rows += [(1000 + i, " ".join(f"x{x}" for x in w)) for i, w in enumerate(repetitive(9, 60))]
    rows += [(2000 + i, " \n ") for i in range(40)] + [(None, "a b " * 30), (3, "a b é " * 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(df)))
    assert Counter(tuple(r) for r in found.collect()) == Counter(digest_by_hand(*r) for r in rows)
    assert periodic_runs.periodic_runs(clashing).columns == ["doc_id", "n_words", "runs", "strongest", "collapsed"]


def test_runs_of_a_very_long_text_and_of_nothing(spark, edge, nothing):
    long = periodic_runs.periodic_runs(edge.filter("doc_id = 10")).collect()
    assert [[tuple(x) for x in r["runs"]] for r in long] == [[(0, 20_000, 997)]] * 2 and all(len(raw_words(r["collapsed"])) == 997 for r in long)
    assert periodic_runs.periodic_runs(nothing).count() == 0


def test_registered_runs_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    short = {d for d, t in docs if len(t or "") < 6000}
    got = Counter(tuple(r) for r in queries.op13_periodic_runs(spark, SMALL).collect() if r["doc_id"] in short)
    assert got == Counter(digest_by_hand(*r) for r in docs if r[0] in short)


# ---------------------------------------------------------------- near misses in near-duplicate search


@pytest.mark.parametrize("size", [150, 300])
def test_near_misses_of_one_base_leave_a_task_once_each(size):
    """Three words changed in 120: similarity around 0.6, which passes the estimate but makes few links."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(size):
        w = list(base)
        for at in rng.sample(range(120), 3):
            w[at] = f"x{i}_{at}"
        texts.append(" ".join(w))
    sets = near_dedup.shingle_sets(pa.array(texts, pa.large_string()))
    codes, _ = near_dedup.signatures(sets)
    n = np.array([len(s) for s in sets])
    likely = list(near_dedup.likely_pairs(np.arange(size), np.zeros(size, int), n, list(codes)))
    assert sum(len(j) for _, j in likely) > 20 * size  # the pairs that used to become rows
    groups = set_links.alike_groups(size, iter(likely))
    assert sum(map(len, groups)) <= size
    found = set_links.spanning_links(np.arange(size), np.arange(size), np.zeros(size, int), sets, 75, 100)
    assert len(found) < size and all(set_links.linked(sets[a], sets[b], 75, 100) for a, b in found)
