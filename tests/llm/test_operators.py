"""Every operator on awkward rows, an empty table and clashing columns, and against a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from hedgewise.llm import decontamination, fingerprints, language_id, lm_scoring, mixing, near_dedup, queries, set_links, sharding, token_counts, token_files, toxicity
from hedgewise.llm.common import held_out, table
from hedgewise.llm.components import connected

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def words_of(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size=5):
    w = words_of(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents").cache()


# ---------------------------------------------------------------- 1 token counts


@pytest.mark.parametrize("chunk, overlap", [(64, 4), (200, 1), (16_384, 128)])
def test_token_counts_equal_the_library(spark, edge, chunk, overlap):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = edge.filter("doc_id <> 12 OR doc_id IS NULL") if chunk < 1000 else edge
    got = token_counts.count_tokens(rows, PIECES, 4096, chunk=chunk, overlap=overlap).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in rows.collect())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)


def test_overlaps_are_widened_until_they_align():
    counter = token_counts.Resynchroniser(PIECES, 50, 2)
    text = "a" * 400 + " b c " + "=" * 300
    n, chunks, widened = counter.count(text)
    assert n == len(counter.model.encode(text)) and widened > 0


def test_token_counts_of_nothing(nothing, clashing):
    assert token_counts.count_tokens(nothing, PIECES, 10).count() == 0
    assert token_counts.count_tokens(clashing, PIECES, 10).count() == clashing.count()


# ---------------------------------------------------------------- 2 sharding


def check_shards(rows, shards):
    assert {r["law"] for r in rows} == {"bytes"} and all(r["grown_shard"] is None for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for group in by.values():
        assert sorted(r["slot"] for r in group) == list(range(len(group)))
    return {s: sum(r["size"] for r in by.get(s, [])) for s in range(shards)}


def test_shards_are_near_equal_and_keep_copies_together(spark, docs):
    rows = sharding.shard_by_bytes(docs, 24).collect()
    sizes = check_shards(rows, 24)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    fair, largest = sum(sizes.values()) / 24, max(r["size"] for r in rows)
    assert all(abs(v - fair) <= largest + fair / 10 for v in sizes.values())
    homes = {}
    for r in rows:
        homes.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_a_hot_text_is_spread_and_ranges_are_subdivided(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, F.repeat(F.lit("x"), 500)).otherwise(F.repeat(F.col("id").cast("string"), 125)).alias("text"))
    rows = sharding.shard_by_bytes(hot, 6, ranges=16).collect()
    sizes = check_shards(rows, 6)
    fair = sum(sizes.values()) / 6
    assert all(abs(v - fair) <= 0.02 * fair for v in sizes.values())


def test_shards_do_not_depend_on_partitions(docs):
    a = sharding.shard_by_bytes(docs, 5).select("doc_id", "shard", "slot").orderBy("doc_id").collect()
    b = sharding.shard_by_bytes(docs.repartition(7), 5, ranges=64).select("doc_id", "shard", "slot").orderBy("doc_id").collect()
    assert a == b


def test_sharding_edge_rows(edge, nothing, clashing):
    check_shards(sharding.shard_by_bytes(edge, 3).collect(), 3)
    assert sharding.shard_by_bytes(nothing, 3).count() == 0
    carried = sharding.shard_by_bytes(clashing.drop("size", "shard"), 3, carry=["text", "row", "_key", "_bucket"])
    assert carried.count() == clashing.count() and carried.filter("row <> 'mine'").count() == 0


def test_sharding_runs_without_python(docs):
    plan = sharding.shard_by_bytes(docs, 24)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# ---------------------------------------------------------------- 3 decontamination


def brute_contamination(docs, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = []
    for item, text in items:
        w = words_of(text, pattern)
        windows += [(item, tuple(w[i : i + 13])) for i in range(max(1, len(w) - 12))] if w else []
    out = {}
    for key, text in docs:
        w = words_of(text, pattern)
        hit, found = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[key] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("per_block", [200_000, 2])
def test_contamination_equals_brute_force(spark, monkeypatch, per_block):
    monkeypatch.setattr(decontamination, "WINDOWS_PER_BLOCK", per_block)
    long = " ".join(f"v{i}" for i in range(20))
    items = [(1, long), (10, "Red, GREEN blue"), (2, "..."), (3, None), (4, " ".join(f"v{i}" for i in range(5, 18))), (5, "é à ö")]
    rows = [(1, f"x {long} y"), (2, "red green.blue red GREEN blue"), (3, None), (4, ""), (5, "q " * 200 + "red green blue"), (6, "v5 v6 v7"),
            (7, "É à ö é à ö"), (8, "green blue red green"), (9, f"{long} {long}"), (9, "red-green-blue")]
    keyed = [((i, k), t) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame([(i, t, k) for (i, k), t in keyed], "doc_id long, text string, k int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(df, bench, carry=["k"]).collect()
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert {(r["doc_id"], r["k"]): tuple(r[n] for n in names) for r in got} == brute_contamination(keyed, items)


def test_contamination_edge_rows(spark, edge, nothing, clashing):
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    found = decontamination.decontaminate(clashing, bench, carry=["row", "spans", "items"][:1])
    assert found.count() == clashing.count()
    assert decontamination.decontaminate(nothing, bench).count() == 0
    assert decontamination.decontaminate(edge, bench.limit(0)).filter("n_hit > 0 OR contaminated").count() == 0


# ---------------------------------------------------------------- 4 language-model scoring


def test_lm_scores(spark, docs):
    apart = held_out(7, 2)
    counts = lm_scoring.word_counts(docs, ~apart)
    model = lm_scoring.fit(docs, ~apart, counts)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, model, counts).collect()}
    tokens = {r["doc_id"]: [*words_of(r["text"]), None] for r in docs.collect()}
    taught = {d for d in tokens if zlib.crc32(str(d).encode()) % 7 != 2}
    c = Counter(w for d in taught for w in tokens[d])
    total, distinct = sum(c.values()), len(c)
    for d, ws in tokens.items():
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws)
        assert got[d]["base_score"] == pytest.approx(base, rel=1e-9)
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), total)
    # Probabilities of all symbols sum to one in every context.
    log_z = lm_scoring.normalisers(spark, model)
    x = model.context[3] * model.mix[0] + model.context[5] * model.mix[1]
    assert np.exp(x @ model.target.T + model.bias - log_z[3, 5]).sum() == pytest.approx(1.0, rel=1e-4)
    # A text of words that are symbols of their own, followed by its end, by hand.
    head = model.vocabulary.head
    row = spark.createDataFrame([(1, f"{head[0]} {head[1]}")], "doc_id long, text string")
    seq, want = [lm_scoring.START, lm_scoring.START, 0, 1, lm_scoring.END], 0.0
    for a, b, w in zip(seq, seq[1:], seq[2:]):
        s = (model.context[a] * model.mix[0] + model.context[b] * model.mix[1]) @ model.target[w] + model.bias[w]
        want += (s - log_z[a, b]) / math.log(10)
    assert lm_scoring.score(row, model, counts).first()["score"] == pytest.approx(want, rel=1e-4)


def test_lm_rare_words_are_joined(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "DICTIONARY", 50)
    monkeypatch.setattr(lm_scoring, "EPOCHS", 1)
    some = docs.filter("doc_id < 30")
    counts = lm_scoring.word_counts(some, F.lit(True))
    got = lm_scoring.score(some, lm_scoring.fit(some, F.lit(True), counts), counts).collect()
    assert all(r["n_known"] == r["n_tokens"] for r in got) and len(got) == some.count()


def test_lm_edge_rows(edge, nothing, clashing, monkeypatch):
    monkeypatch.setattr(lm_scoring, "EPOCHS", 1)
    taught = F.col("doc_id").isNotNull()
    counts = lm_scoring.word_counts(clashing, taught)
    model = lm_scoring.fit(clashing, taught, counts)
    got = lm_scoring.score(clashing, model, counts).collect()
    assert len(got) == clashing.count() and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    none = lm_scoring.word_counts(nothing, taught)
    untaught = lm_scoring.fit(nothing, taught, none)
    assert lm_scoring.score(nothing, untaught, none).count() == 0
    assert all(np.isfinite(r["score"]) for r in lm_scoring.score(edge, untaught, none).collect())


# ---------------------------------------------------------------- 5 language identification


def test_code_lengths_are_exact():
    rng = np.random.default_rng(2)
    text = bytes(rng.choice(list(b"abcab "), 400)).decode()
    raw = np.concatenate([np.full(language_id.ORDER, 256), np.frombuffer(text.encode(), np.uint8)]).astype(np.int64)
    key = np.zeros(len(raw) - language_id.ORDER, np.int64)
    for k in range(language_id.ORDER + 1):
        key = key * 257 + raw[k : k + len(key)]
    grams, n = np.unique(key, return_counts=True)
    trees = language_id.build_trees({"xx": (grams, n.astype(float))})
    # Each context's code words fill the code space: own symbols, and symbol 0 for all other bytes.
    others = 256 - int((trees.symbol > 0).sum())
    weight = np.where(np.arange(language_id.SYMBOLS) == 0, others, 1) * (np.isin(np.arange(language_id.SYMBOLS), [0, *trees.symbol[trees.symbol > 0]]))
    assert np.allclose((np.exp2(-trees.bits[0].astype(float)) * weight).sum(axis=1), 1.0, atol=1e-3)

    def cost(context, symbol, excluded=frozenset()):  # the definition, by recursion
        seen = Counter()
        for g, c in zip(grams, n):
            ctx = [int(trees.symbol[g // 257**k % 257]) if g // 257**k % 257 < 256 else language_id.SYMBOLS for k in range(language_id.ORDER, 0, -1)]
            if ctx[language_id.ORDER - len(context) :] == context:
                seen[int(trees.symbol[g % 257])] += int(c)
        if context and sum(seen.values()) < language_id.LEAST:
            return cost(context[1:], symbol, excluded)
        left = {s: c for s, c in seen.items() if s not in excluded}
        total, kinds = sum(left.values()), len(left)
        if symbol in left:
            return math.log2((total + kinds) / left[symbol])
        escape = math.log2((total + kinds) / kinds) if kinds else 0.0
        if context:
            return escape + cost(context[1:], symbol, excluded | set(seen))
        return escape + math.log2(sum(others if s == 0 else 1 for s in range(language_id.SYMBOLS) if s not in excluded | set(seen)))

    for sample in ("abca", "b", "cabz", "zzz a"):
        got = language_id.code_lengths(trees, trees.lookups(), pa.array(["", sample, "q"], pa.large_string()))
        codes = [language_id.SYMBOLS] * language_id.ORDER + [int(trees.symbol[b]) for b in sample.encode()]
        want = sum(cost(codes[i : i + language_id.ORDER], codes[i + language_id.ORDER]) for i in range(len(sample)))
        assert got[1, 0] == pytest.approx(want, abs=0.05) and got[0, 0] == 0


def test_blocks_do_not_change_code_lengths(monkeypatch):
    text = "the quick brown fox " * 40
    key = np.array([ord(c) for c in text], np.int64)
    trees = language_id.build_trees({"en": (np.unique(((256 * 257 + 256) * 257 + key[:-1]) * 257 + key[1:]), np.full(len(np.unique(key[:-1] * 257 + key[1:])), 5.0))})
    batch = pa.array(["", text, "fox", text * 2, ""], pa.large_string())
    whole = language_id.code_lengths(trees, trees.lookups(), batch)
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert np.allclose(whole, language_id.code_lengths(trees, trees.lookups(), batch))


def test_languages_of_held_out_texts(spark):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents"), "doc_id")
    held = got.filter("held_out")
    assert held.filter("lang_pred = lang").count() >= 0.97 * held.count()
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_language_edge_rows(docs, edge, nothing, clashing):
    trees = language_id.fit(docs, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(clashing, trees).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[7] == "fr"
    assert language_id.predict(nothing, trees).count() == 0
    untaught = language_id.fit(nothing, F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(edge, untaught).collect()} == {"und"}


# ---------------------------------------------------------------- 6 fingerprints


def test_fingerprints_of_edited_and_next_texts(docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(docs).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    errors = []
    for k, (d, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[d]["n_chars"] == len(text) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[d]["near_edited"] - like(shingles(text), shingles(edited)), got[d]["near_next"] - like(shingles(text), shingles(after))]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05 and np.abs(errors).max() < 0.25


def test_equal_sets_have_equal_fingerprints_and_bins_are_filled():
    texts = pa.array(["a b c d e f", "A B c d e f", "a", "", "x y z"], pa.large_string())
    codes, empty = fingerprints.codes_of(texts)
    assert (codes[0] == codes[1]).all() and empty.tolist() == [False, False, False, True, False]
    minima, _ = fingerprints.bin_minima(np.arange(3, dtype=np.uint64) << np.uint64(60), np.array([3]))
    assert len(np.unique(minima)) <= 3 and (minima != fingerprints._NONE).all()


def test_fingerprint_edge_rows(edge, nothing, clashing):
    got = fingerprints.fingerprint_pairs(clashing, buckets=3).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in edge.collect())
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {fingerprints.EMPTY}
    assert fingerprints.fingerprint_pairs(nothing).count() == 0


# ---------------------------------------------------------------- 7 token files


def test_token_files_round_trip(spark, edge, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = edge.withColumn("text", F.when(F.col("doc_id") == 9, "<|endoftext|> A'S it's!!").otherwise(F.col("text")))
    folder = f"file://{tmp_path}"
    manifest = token_files.write_token_files(rows, WORDS, 1, folder, length=64)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest, folder).collect())
    ordered = sorted(rows.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    want, start, stream = [], 0, []
    for r in ordered:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((start, r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
        start, stream = start + len(ids), stream + ids.tolist()
    assert got == want
    files = manifest.orderBy("part").collect()
    for f in files:  # any sequence of any file, by its number
        reader = token_files.open_sequences(f["path"], folder)
        own = stream[f["start"] : f["start"] + f["n_ids"]]
        for k in (0, (f["n_ids"] - 1) // 64):
            ids, mask = token_files.sequence(reader, k)
            assert len(ids) == 64 and ids[mask].tolist() == own[k * 64 : (k + 1) * 64]


def test_token_files_of_nothing(nothing, clashing):
    assert token_files.round_trip(nothing, WORDS, 1).count() == 0
    assert token_files.round_trip(clashing, WORDS, 1).count() == clashing.count()


# ---------------------------------------------------------------- 8 near duplicates


def brute_groups(rows):
    sets = {d: shingles(t) for d, t in rows}
    group = {d: d for d in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("block, stars", [(1 << 20, 8), (300, 1), (1 << 20, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, stars):
    monkeypatch.setattr(set_links, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "STAR_BANDS", stars)
    rng = np.random.default_rng(block + stars)
    rows = [(1, None), (2, ""), (3, "x y"), (4, "X  y"), (5, "x y z")]
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(30, 120)))]
        for _ in range(int(rng.integers(1, 14))):
            own = list(base)
            for at in rng.integers(0, len(own), int(rng.integers(0, 5))):
                own[at] = f"r{rng.integers(1 << 30)}"
            rows.append((len(rows) + 1, " ".join(own)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_groups(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(1)
    order = rng.permutation(300).tolist()
    edges = list(zip(order, order[1:])) + [(1000, 1001), (1001, 1002), (7, 7)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(300)} == {0} and got[1002] == 1000
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicate_edge_rows(edge, nothing, clashing):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(clashing).collect()}
    assert got[6]["component_id"] == 4 and got[5]["component_id"] == 4 and got[4]["kept"] and not got[6]["kept"]
    assert all(got[d]["n_shingles"] == 0 and got[d]["kept"] for d in (1, 2, 3)) and got[9]["n_shingles"] == 1
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert near_dedup.near_duplicates(nothing).count() == 0


# ---------------------------------------------------------------- 9 toxicity


def test_kernel_equals_its_definition():
    from itertools import combinations

    def phi(word):
        w, out = toxicity.FIRST + word + toxicity.LAST, Counter()
        for i, j, k in combinations(range(len(w)), 3):
            out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
        norm = math.sqrt(sum(v * v for v in out.values()))
        return {u: v / norm for u, v in out.items()}

    names = ["idiot", "id-iot", "idxiot", "clown", "aaaa", "abab"]
    symbols = toxicity.FIRST + toxicity.LAST + "-abcdiklnotwx"
    got = toxicity.kernel_sums(names, symbols, toxicity._features(names, symbols))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert got[i, j] == pytest.approx(sum(v * phi(b).get(u, 0.0) for u, v in phi(a).items()), abs=1e-5)
    assert got[0, 1] > 0.5 and got[0, 2] > 0.5 and got[0, 3] < 0.2


def test_gapped_and_spaced_insults_are_caught():
    rng = np.random.default_rng(0)
    usual = ["".join(rng.choice(list("aeioulnrst"), int(rng.integers(3, 8)))) for _ in range(300)]
    some = lambda: sorted(set(rng.choice(usual, 12).tolist()))
    machine = toxicity.train([(True, sorted({*some(), str(rng.choice(["idiot", "moron"]))})) for _ in range(120)] + [(False, some()) for _ in range(240)])
    texts = ["you idiot", "you id-iot!", "an idxiot here", "i d i o t", " ".join(some()), ""]
    names, at, owners = toxicity.windows_of(pa.array(texts, pa.large_string()))
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owners, machine.value(names)[at])
    assert (machine.score(best[:4]) >= 0.5).all() and machine.score(best[4:5])[0] < 0.5 and not np.isfinite(best[5])


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    marks = table(spark, sf, "labels").select("doc_id", "toxic")
    rows = queries.op9_toxicity(spark, sf).join(marks, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.05 * (n[0, 0] + n.get((0, 1), 0))


def test_toxicity_edge_rows(spark, edge, nothing, clashing):
    labels = spark.createDataFrame([(4, 1), (5, 1), (7, 0), (9, 0), (10, None), (None, 1)], "doc_id long, toxic int")
    machine = toxicity.fit(edge, labels, F.lit(True))
    got = toxicity.score(clashing, machine, carry=["row", "lang"]).collect()
    assert len(got) == clashing.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["row"] == "mine" for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (1, 2, 3)} == {0.0}
    untaught = toxicity.fit(nothing, labels, F.lit(True))
    assert toxicity.score(edge, untaught).filter("predicted = 1").count() == 0 and toxicity.score(nothing, machine).count() == 0


# ---------------------------------------------------------------- 10 mixing


def test_rates_meet_the_targets(spark, docs):
    mix = queries.fitted_mix(spark, docs, SMALL)
    out = mixing.apply(docs, mix).collect()
    p = {}
    reached = Counter()
    for r in out:
        assert r["rate"] >= 0 and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1)
        reached[r["domain"]] += r["n_tokens"] * r["rate"]
        p[r["doc_id"]] = r["n_tokens"]
    assert p == {r["doc_id"]: len(words_of(r["text"])) for r in docs.collect()}
    for d, target in mix.targets.items():
        assert mix.totals[d] == pytest.approx(target, abs=0.01 * sum(mix.targets.values()))


def test_rates_stay_nonnegative_when_a_domain_must_vanish():
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.2, 0.2, 0.2], 400)
    t = rng.integers(10, 500, 400).astype(float)
    target = p.T @ (t * np.where(p[:, 2] < 0.3, 1.4, 0.0))  # what rates of zero and above can reach
    scale, steps = np.linalg.pinv((p * t[:, None]).T @ p), np.zeros((0, 3))
    errors = []
    for _ in range(mixing.STEPS):
        r = mixing.rates_after(p, steps)
        errors.append(np.abs(p.T @ (t * r) - target).max())
        steps = np.concatenate([steps, (scale @ (p.T @ (t * r) - target))[None]])
    assert (r >= 0).all() and (r == 0).any() and errors[-1] < 0.02 * errors[0]


def test_mixing_edge_rows(spark, edge, nothing, clashing):
    labelled = spark.createDataFrame([(4, "a"), (7, "b"), (9, None)], "doc_id long, domain string")
    classifier = mixing.fit_classifier(edge, labelled)
    mix = mixing.fit(clashing, classifier, {"a": 1.0, "b": 1.0})
    got = mixing.apply(clashing, mix, carry=["row", "lang"])
    assert got.count() == clashing.count() and got.filter("row <> 'mine' OR rate < 0").count() == 0
    assert mixing.apply(nothing, mixing.fit(nothing, classifier, {"a": 1.0})).count() == 0
    untaught = mixing.fit_classifier(edge, labelled.limit(0))
    assert {r["rate"] for r in mixing.apply(edge, mixing.fit(edge, untaught, {})).collect()} == {1.0}
