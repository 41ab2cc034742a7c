"""The configuration program: its bound, its rounding, and plain best-fit beside it."""

from collections import Counter

import numpy as np
import pytest

from plumbline.llm.packing import FRACTION, best_fit_decreasing, cover, plan_sequences, price


def histogram(lengths):
    kinds, times = np.unique(lengths, return_counts=True)
    return dict(zip(kinds.tolist(), times.tolist()))


def thirds(seed):
    r = np.random.default_rng(seed)
    return histogram(np.concatenate([r.integers(1100, 2100, 900), r.integers(30, 400, 450)]))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_most_sequences_come_from_configurations_and_fewer_than_plain_best_fit_needs(seed):
    counts, figures = thirds(seed), {}
    plan = plan_sequences(counts, 4096, figures)
    held = Counter()
    for pieces, many in plan:
        assert sum(pieces) <= 4096 and many > 0
        for x in pieces:
            held[x] += many
    assert held == counts
    assert figures["sequences"] == sum(m for _, m in plan) < figures["plain"]
    assert figures["from_configurations"] > 0.9 * figures["sequences"]
    assert figures["bound"] <= figures["fractional"] + 1 and figures["fractional"] <= 1.02 * figures["bound"]


def test_the_bound_is_below_the_best_packing_and_a_program_alone_can_prove_it():
    # three to a sequence, though by their tokens 2.1 sequences would do
    counts = {1400: 6, 1: 3}
    _, _, bound = cover({k: n * FRACTION for k, n in counts.items()}, 4096, 2.0, 0.0, bounded=True)
    assert 8400 / 4096 < bound / FRACTION <= 3
    figures = {}
    plan_sequences(counts, 4096, figures)
    assert figures["sequences"] == 3


def test_the_pricing_equals_a_plain_dynamic_program():
    r = np.random.default_rng(5)
    lengths = np.unique(r.integers(3, 90, 20))
    values = r.random(len(lengths))
    plain = [0.0]
    for c in range(1, 301):
        plain.append(max([plain[-1]] + [plain[c - x] + v for x, v in zip(lengths.tolist(), values.tolist()) if x <= c]))
    assert np.allclose(price(values, lengths, 300), plain)


def test_plain_best_fit_fills_opened_sequences_first():
    plan = best_fit_decreasing({10: 3, 6: 1}, 16, [((6,), 2)])
    assert sorted(plan) == [((6, 10), 2), ((10, 6), 1)]
