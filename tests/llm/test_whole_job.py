"""What once was cut short: training samples and unfinished iterations."""

import logging

import numpy as np
import pytest

from hedgewise.llm import mixing, toxicity
from hedgewise.llm.common import held_out, table


def test_toxicity_learns_from_the_documented_sample(spark, monkeypatch):
    """sf0.1 has between 2400 and 3000 clean training documents, so all of them teach."""
    seen = []
    monkeypatch.setattr(toxicity, "train_arrays", lambda toxic, windows, owners: seen.append(toxic))
    sf = "/root/testdata/sf0.1"
    marks = table(spark, sf, "labels")
    toxicity.fit(table(spark, sf, "documents"), marks, ~held_out(5, 0))
    clean = marks.filter(~held_out(5, 0) & (marks.toxic == 0)).count()
    assert 2400 < clean < 3000 and (seen[0] == 0).sum() == clean
    assert (toxicity.SAMPLE_TOXIC, toxicity.SAMPLE_CLEAN, toxicity.HARD) == (1500, 3000, 4000)


def uncertain(n, low, high):
    """Tokens and posteriors of four languages (60/15/15/10%) by two qualities, the latter near ``low`` or ``high``."""
    rng = np.random.default_rng(0)
    spoken = np.full((n, 4), 0.01)
    spoken[np.arange(n), rng.choice(4, n, p=[0.6, 0.15, 0.15, 0.1])] = 0.97
    good = np.clip(np.where(rng.random(n) < 0.5, high, low) + rng.normal(0, 0.03, n), 0.01, 0.99)[:, None]
    p = np.concatenate([spoken * good, spoken * (1 - good)], axis=1)
    return rng.integers(20, 800, n), p


def mixed(spark, monkeypatch, tokens, p, wanted, total=None):
    rows = spark.createDataFrame([(int(t), q.tolist()) for t, q in zip(tokens, p)], "tokens bigint, p array<double>")
    monkeypatch.setattr(mixing, "_posterior_table", lambda *_: rows)
    names = [f"d{k}" for k in range(p.shape[1])]
    return mixing.fit(rows, mixing.Classifier(names, None), dict(zip(names, wanted.tolist())), total=total)


def test_reachable_targets_are_met_by_uncertain_posteriors(spark, monkeypatch):
    tokens, p = uncertain(3000, 0.25, 0.75)
    rates = np.where(p[:, :4].sum(axis=1) > 0.77, 6.0, 0.0) / p[:, :4].sum(axis=1) * (1 - p[:, :4].max(axis=1))
    wanted = p.T @ (tokens * rates)
    mix = mixed(spark, monkeypatch, tokens, p, wanted, wanted.sum())
    for d, target in mix.targets.items():
        assert mix.totals[d] == pytest.approx(target, rel=0.01), d
    assert mix.settled and (mix.rates(p) >= 0).all()


def test_unreachable_targets_end_at_the_optimum_and_are_told(spark, monkeypatch, caplog):
    tokens, p = uncertain(1000, 0.45, 0.55)
    with caplog.at_level(logging.WARNING, logger=mixing.__name__):
        mix = mixed(spark, monkeypatch, tokens, p, np.repeat([0.9, 0.1], 4))
    assert mix.settled and "cannot all be met" in caplog.text
    reached, targets, rates = (np.array(list(v.values())) if isinstance(v, dict) else v for v in (mix.totals, mix.targets, mix.rates(p)))
    slope = p @ np.linalg.solve((p * tokens[:, None]).T @ p, reached - targets)
    assert slope.min() > -1e-3 and tokens @ (rates * np.abs(slope)) < 1e-3 * tokens.sum()  # no rate can lessen the miss
