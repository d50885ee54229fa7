"""The draw decides what an output shard holds."""

from collections import Counter

import numpy as np
from llm_rows import prose

from auctionstream.llm import mixing


def test_counts_are_drawn_by_weight_under_fixed_totals():
    slots = [40_000, 9_000, 7, 0, 1]
    tables = [mixing.shard_counts(slots, 50, seed) for seed in range(30)]
    for counts in tables:
        assert counts.sum(axis=0).tolist() == slots and counts.min() >= 0
        sizes = counts.sum(axis=1)
        assert sizes.max() - sizes.min() <= 1
    first = np.array([c[:, 0] for c in tables])
    assert abs(first.mean() - 800) < 2  # by weight
    share = 40_000 / 49_008
    spread = 980 * share * (1 - share)  # a multinomial count's variance
    assert 0.8 * spread < first.var() < 1.2 * spread  # an even deal would have none
    assert (mixing.shard_counts(slots, 50, 3) == tables[3]).all()


def test_very_many_slots():
    slots = [3 * 10**11, 10**10, 5]
    counts = mixing.shard_counts(slots, 64, 1)
    assert counts.sum(axis=0).tolist() == slots and counts.min() >= 0
    assert counts[:, 0].std() > 1_000 and counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 1


def test_shards_hold_what_they_drew(frame):
    rows = [(i, prose(i, 200 + i), f"s{i % 3}") for i in range(60)]
    held = Counter((r.shard, r.group) for r in mixing.shard_blocks(frame(rows), shards=8).collect())
    groups = sorted({g for _, g in held})
    totals = [sum(n for (_, g), n in held.items() if g == group) for group in groups]
    drawn = mixing.shard_counts(totals, 8, 11)
    assert all(held[k, g] == drawn[k, i] for k in range(8) for i, g in enumerate(groups))
    assert len({held[k, groups[0]] for k in range(8)}) > 1
