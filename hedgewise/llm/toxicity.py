"""Toxicity by a support vector machine with a gap-weighted subsequence string kernel.

A sentence is looked at through its windows: white-space separated words without surrounding punctuation
(long ones in overlapping pieces), and runs of single letters joined into one word. Two windows are alike as
far as they share subsequences of three characters, each weighted by ``DECAY`` to the power of the stretch
it spans; so ``idiot``, ``id-iot`` and ``idxiot`` stay close. The kernel is approximated by Nystroem features
over landmark windows. A sentence's value, and a document's, is the largest over its windows.

Labels belong to whole documents, so training alternates: the windows that score highest in toxic documents
stand for them, the windows of clean documents are the negatives, and the hardest ones are added in each
round. The fitted machine is linear in the kernel's own (three-character) features, so all landmarks fold
into one table and scoring a window costs one lookup per subsequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hedgewise.llm.common import draw, slices, texts_of

DECAY = 0.6
WINDOW, STRIDE = 16, 8
FIRST, LAST = "\x02", "\x03"  # a window's ends count as characters of it, so that a beginning differs from a middle
PADDED = WINDOW + 2
SYMBOLS = 48  # characters with a symbol of their own; symbol 0 matches no landmark
LANDMARKS = 128
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000  # expected labelled documents of each kind the machine is trained on
ROUNDS, EPOCHS, HARD = 4, 250, 4000
RARE, CAUTION = 0.02, 2.0  # share of clean documents a telling window may occur in; weight of clean windows
EDGES = " .,;:!?*&%$#|()[]{}<>\"'`~_-+=/\\@^"


def windows_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct windows, the window of every occurrence, and the text of every occurrence."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    words, owners = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    at = words.indices.to_numpy().astype(np.int64)
    trimmed = pc.utf8_trim(words.dictionary, characters=EDGES).dictionary_encode()
    distinct, at = trimmed.dictionary.to_pylist(), trimmed.indices.to_numpy().astype(np.int64)[at]
    length = np.fromiter(map(len, distinct), np.int64, len(distinct))
    extra_at, extra_owner, names = [], [], list(distinct)
    number = {}
    for i in np.flatnonzero(length > WINDOW):  # long words: overlapping pieces instead of the whole
        pieces = [distinct[i][k : k + WINDOW] for k in range(0, max(length[i] - STRIDE, 1), STRIDE)]
        numbers = []
        for p in pieces:
            if p not in number:
                number[p] = len(names)
                names.append(p)
            numbers.append(number[p])
        where = owners[at == i]
        extra_at += [np.repeat(numbers, len(where))]
        extra_owner += [np.tile(where, len(numbers))]
    single = length[at] == 1
    if single.any():  # runs of three and more single characters within one text
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        for start, end in zip(edge[::2], edge[1::2], strict=True):
            for a, b in _same(owners, start, end):
                for k in range(a, max(b - 2, a), STRIDE):
                    run = "".join(distinct[j] for j in at[k : min(k + WINDOW, b)])
                    if len(run) >= 3:
                        number.setdefault(run, len(names))
                        if number[run] == len(names):
                            names.append(run)
                        extra_at.append(np.array([number[run]]))
                        extra_owner.append(owners[a : a + 1])
    keep = (length[at] > 2) & (length[at] <= WINDOW)
    return names, np.concatenate([at[keep], *extra_at]).astype(np.int64), np.concatenate([owners[keep], *extra_owner]).astype(np.int64)


def _same(owners: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    """The run cut where the text changes."""
    cuts = [start, *(start + 1 + np.flatnonzero(np.diff(owners[start:end]))), end]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b - a >= 3]


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def _self_kernel(codes: np.ndarray) -> np.ndarray:
    """The kernel of every window (all of one length) with itself."""
    n = codes.shape[1]
    gap = np.arange(n)[:, None] - np.arange(n)
    step = np.where(gap > 0, DECAY ** np.maximum(gap, 0), 0.0)
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float64)
    inner = same * (step @ same @ step.T)
    return DECAY**2 * (same * (step @ inner @ step.T)).sum(axis=(1, 2))


@dataclass
class Machine:
    """``symbols``: the characters by number from 1; ``table``: the weight of every three symbols."""

    symbols: str
    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def value(self, windows: list[str]) -> np.ndarray:
        return kernel_sums(windows, self.symbols, self.table[:, None])[:, 0] + self.bias

    def score(self, largest: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * largest + self.shift, -500, 500)))


def encode(windows: list[str], symbols: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbol numbers of up to ``WINDOW`` characters between the end marks, and lengths with the marks."""
    marked = [f"{FIRST}{w}{LAST}" for w in windows]
    points = np.array(marked, f"U{PADDED}").view(np.uint32).reshape(len(marked), PADDED) if marked else np.zeros((0, PADDED), np.uint32)
    number = np.zeros(0x3000, np.uint8)
    for i, c in enumerate(symbols, 1):
        if ord(c) < len(number):
            number[ord(c)] = i
    return number[np.minimum(points, len(number) - 1)], np.minimum([len(w) for w in marked], PADDED).astype(np.int64)


def kernel_sums(windows: list[str], symbols: str, tables: np.ndarray) -> np.ndarray:
    """Normalised windows times each column of ``tables`` (rows: three symbols); 0 for windows under three characters."""
    codes, lengths = encode(windows, symbols)
    base, out = SYMBOLS + 1, np.zeros((len(windows), tables.shape[1]))
    for n in range(5, PADDED + 1):
        at, weight = _triples(n)
        chosen = np.flatnonzero(lengths == n)
        step = max(1, (1 << 19) // (len(at) * tables.shape[1]))
        for k in range(0, len(chosen), step):
            part = codes[chosen[k : k + step], :n].astype(np.int64)
            index = (part[:, at[:, 0]] * base + part[:, at[:, 1]]) * base + part[:, at[:, 2]]
            sums = np.einsum("bcm,c->bm", tables[index], weight.astype(tables.dtype)) if tables.shape[1] > 1 else (tables[index, 0] @ weight)[:, None]
            out[chosen[k : k + step]] = sums / np.sqrt(_self_kernel(part))[:, None]
    return out


def _features(windows: list[str], symbols: str) -> np.ndarray:
    """Normalised feature vectors, one column per window."""
    base = SYMBOLS + 1
    codes, lengths = encode(windows, symbols)
    out = np.zeros((base**3, len(windows)), np.float32)
    for j, (code, n) in enumerate(zip(codes.astype(np.int64), lengths, strict=True)):
        if n >= 5:
            at, weight = _triples(n)
            known = (code[at] > 0).all(axis=1)
            index = (code[at[:, 0]] * base + code[at[:, 1]]) * base + code[at[:, 2]]
            np.add.at(out[:, j], index[known], weight[known])
            out[:, j] /= np.sqrt(_self_kernel(code[None, :n]))[0]
    return out


def train(documents: list[tuple[bool, list[str]]]) -> Machine:
    """Fit on (toxic, windows) of labelled documents; deterministic. Without both kinds every score is (nearly) 0."""
    windows = pa.array([w for _, ws in documents for w in ws], pa.string())
    sizes = [len(ws) for _, ws in documents]
    return train_arrays(np.array([bool(t) for t, _ in documents], bool), windows, np.repeat(np.arange(len(documents)), sizes).astype(np.int64))


def train_arrays(toxic: np.ndarray, windows: pa.Array, owners: np.ndarray) -> Machine:
    """The same from arrays: the label of each document, all windows (once per document) and their documents."""
    coded = windows.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(order)).to_pylist()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[coded.indices.to_numpy()] if len(owners) else np.zeros(0, np.int64)
    del windows, coded, place, order  # their names and places are all that is needed, and they are the largest arrays
    in_toxic = toxic[owners]
    n_toxic, n_clean = len(np.unique(owners[in_toxic])), len(np.unique(owners[~in_toxic]))
    if not n_toxic or not n_clean:
        return Machine("", np.zeros((SYMBOLS + 1) ** 3, np.float32), 0.0, 0.0, -20.0)
    p = np.bincount(at[in_toxic], minlength=len(names)).astype(float)
    n = np.bincount(at[~in_toxic], minlength=len(names)).astype(float)
    chars: dict[str, float] = {}
    for w, times in zip(names, (p + n).tolist(), strict=True):
        for c in w:
            chars[c] = chars.get(c, 0) + times
    symbols = FIRST + LAST + "".join(sorted(sorted(chars, key=lambda c: (-chars[c], c))[: SYMBOLS - 2]))
    odds = np.log((p + 0.1) / (n_toxic + 0.2)) - np.log((n + 0.1) / (n_clean + 0.2))
    gain = p * np.maximum(odds, 0)
    telling = np.argsort(-gain, kind="stable")[: LANDMARKS // 2]
    usual = [i for i in np.argsort(-n, kind="stable") if len(names[i]) >= 4][: LANDMARKS // 4]
    landmarks = list(dict.fromkeys([*telling, *usual]))

    # Only windows that are rare in clean documents can stand for a toxic one; a document without any is left aside.
    rare = (n <= max(1.0, RARE * n_clean))[at] & in_toxic
    told = np.zeros(len(toxic), bool)
    told[owners[rare & (odds[at] > 1.0)]] = True
    told = rare & told[owners]  # the windows that can stand for their documents
    clean = np.flatnonzero(n > 0)
    rank = odds  # round one: the window most typical of toxic documents stands for its document
    chosen = np.union1d(clean[np.argsort(-n[clean], kind="stable")[:HARD]], clean[:: max(1, len(clean) // HARD)])
    machine = Machine("", np.zeros((SYMBOLS + 1) ** 3, np.float32), 0.0, 0.0, -20.0)
    for _ in range(ROUNDS if told.any() else 0):
        feats = _features([names[i] for i in landmarks], symbols)
        gram = kernel_sums([names[i] for i in landmarks], symbols, feats)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        ok = values > 1e-5 * values.max()
        whiten = vectors[:, ok] / np.sqrt(values[ok])  # K(landmarks, x) -> Nystroem features
        witness, weight = np.unique(_best(owners[told], at[told], rank)[1], return_counts=True)
        x = kernel_sums([names[i] for i in np.concatenate([witness, chosen])], symbols, feats) @ whiten
        y = np.concatenate([np.ones(len(witness)), -np.ones(len(chosen))])
        often = np.sqrt(n[chosen])
        share = np.concatenate([weight / weight.sum(), CAUTION * often / often.sum()])
        w, b = _svm(x, y, share)
        machine = Machine(symbols, feats @ (whiten @ w).astype(np.float32), float(b), 1.0, 0.0)
        rank = machine.value(names)
        hardest = clean[np.argsort(-(rank[clean] + 1) * np.sqrt(n[clean]), kind="stable")]
        chosen = np.union1d(chosen, hardest[:HARD])
        landmarks = list(dict.fromkeys([*landmarks, *hardest[: LANDMARKS // 8], *witness[np.argsort(rank[witness])[: LANDMARKS // 8]]]))
        del feats, gram, x  # before the next round makes its own
    value = lambda kind: _best(owners[kind], at[kind], rank)[0]
    machine.slope, machine.shift = _platt(value(in_toxic), value(~in_toxic))
    return machine


def _best(owners: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest rank of each document's windows, and the window that has it (the first by name of several)."""
    order = np.lexsort((at, -rank[at], owners))
    first = order[np.concatenate([[True], np.diff(owners[order]) > 0])]
    return rank[at[first]], at[first]


def _svm(x: np.ndarray, y: np.ndarray, share: np.ndarray, strength: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient steps."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = look = np.zeros(z.shape[1])
    rate = 1.0 / (2 * np.linalg.norm((z * share[:, None]).T @ z, 2) + strength)
    for k in range(EPOCHS):
        slack = np.maximum(0.0, 1.0 - y * (z @ look))
        grad = -2 * z.T @ (share * slack * y) + strength * np.append(look[:-1], 0.0)
        new = look - rate * grad
        look, w = new + k / (k + 3) * (new - w), new
    return w[:-1], w[-1]


def _platt(toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that turns values into probabilities."""
    f = np.concatenate([toxic, clean])
    t = np.concatenate([np.full(len(toxic), (len(toxic) + 1) / (len(toxic) + 2)), np.full(len(clean), 1 / (len(clean) + 2))])
    share = np.full(len(f), 1.0 / len(f))
    z, w = np.stack([f, np.ones(len(f))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        prob = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (share * prob * (1 - prob) + 1e-9)[:, None]).T @ z + 1e-6 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, z.T @ (share * (prob - t)) + 1e-6 * w), -2, 2)
    return float(w[0]), float(w[1])


def fit(df: DataFrame, labels: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """Train on a bounded sample (see SAMPLE_TOXIC, SAMPLE_CLEAN) of labelled rows for which ``training`` holds.

    Rows with a null label or text teach nothing. The sample depends on ids only.
    """
    marks = labels.filter(F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    marks = marks.filter(training).select(F.col(doc_id).alias("_id"), "_toxic")
    sizes = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("_toxic") == 1, SAMPLE_TOXIC / max(1, sizes.get(1, 0))).otherwise(SAMPLE_CLEAN / max(1, sizes.get(0, 0)))
    picked = marks.filter(draw(9, "_id") < share)
    # The sample's ids, at most a few thousand by its parameters, go to the texts instead of the texts to them.
    texts = df.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(picked), "_id").select("_id", "_toxic", "text")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            names, at, owners = windows_of(texts_of(batch))
            found = np.unique(owners * len(names) + at) if len(at) else np.zeros(0, np.int64)
            lists = [[] for _ in range(batch.num_rows)]
            for k in found:
                lists[k // len(names)].append(names[k % len(names)])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_toxic"), pa.array(lists, pa.list_(pa.string()))], ["_id", "toxic", "windows"])

    found = rows.mapInArrow(windows, "_id bigint, toxic int, windows array<string>").toArrow().sort_by("_id").combine_chunks()
    lists = found.column("windows").combine_chunks()
    toxic, owners = found.column("toxic").to_numpy() == 1, pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    flat = [lists.flatten()]
    del found, lists
    pa.default_memory_pool().release_unused()
    return train_arrays(toxic, flat.pop(), owners)


def score(df: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, score, predicted (score >= 0.5) and the columns in ``carry`` per row. A null or empty text, or one without windows, has no evidence: score 0.

    Repeated rows are scored each; an empty table gives an empty result; a machine trained on one kind of
    document only scores 0 everywhere. Carried columns must not be called like a result column.
    """
    shared = df.sparkSession.sparkContext.broadcast(machine)  # SYMBOLS ** 3 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, 4096):
            names, at, owners = windows_of(texts_of(batch))
            largest = np.full(batch.num_rows, -np.inf)
            if len(at):
                np.maximum.at(largest, owners, known.value(names)[at])
            value = np.where(np.isfinite(largest), known.score(np.where(np.isfinite(largest), largest, 0.0)), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))],
                ["doc_id", "row", "score", "predicted"],
            )

    carry = list(carry or [])
    packed = F.struct(*[F.col(c) for c in carry], F.lit(0).alias("_")).alias("row")
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), packed)
    out = rows.mapInArrow(run, f"doc_id bigint, row {rows.schema['row'].dataType.simpleString()}, score double, predicted int")
    return out.select("doc_id", *[F.col("row")[c].alias(c) for c in carry if c != "doc_id"], "score", "predicted")
