"""Totals across units against plain counts."""

import numpy as np
import pandas as pd
import pytest

from profilerec.llm import exchange


@pytest.mark.parametrize("buckets, width", [(1, 64), (3, 64), (7, 40)])
def test_totals_and_first_units(buckets, width):
    rng = np.random.default_rng(0)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) >> np.uint64(64 - width)
    common = draw(50)
    units = {u: np.concatenate([draw(40), rng.choice(common, 60)]) for u in (4, 1 << 32, 2 << 32)}
    units[5] = draw(0)
    rows = [r for u, k in units.items() for r in exchange.requests(u, 1, k, np.ones(len(k)), buckets, width)]
    asked = pd.DataFrame(rows, columns=["bucket", "unit", "tag", "keys", "weights"])
    answers = pd.concat([exchange._answer(part) for _, part in asked.groupby("bucket")])
    for unit, keys in units.items():
        total, first = exchange.read_answer(answers[answers["unit"] == unit], 1, keys)
        assert total.tolist() == [sum(int((k == x).sum()) for k in units.values()) for x in keys]
        assert first.tolist() == [min(u for u, k in units.items() if (k == x).any()) for x in keys]
