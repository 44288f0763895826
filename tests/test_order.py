"""Positions in a global order, and co-activation over it, however the rows crowd."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from recallgrid.operators import dynamics

START = datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, event_id long, mem_id long"


def rows_of(n, hot, seed):
    """So many recalls, a share of them in one moment, in no order."""
    rng = random.Random(seed)
    rows = [(START if rng.random() < hot else START + timedelta(seconds=rng.randrange(-500, 500)), i, rng.randrange(40)) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("parts", [1, 7, None])
def test_positions(spark, hot, parts):
    rows = rows_of(3000, hot, 1)
    got = dynamics.ordered_index(spark.createDataFrame(rows, SCHEMA), ("ts", "event_id"), parts=parts).collect()
    assert {r.event_id: r.idx for r in got} == {r[1]: i for i, r in enumerate(sorted(rows), 1)}


def test_parts_are_even_in_one_moment(spark):
    df = spark.createDataFrame(rows_of(4000, 1.0, 2), SCHEMA)
    seen = []
    real = dynamics._part

    def spy(cols, bounds, first=0):
        seen.append(len(bounds))
        return real(cols, bounds, first)

    dynamics._part = spy
    try:
        dynamics.ordered_index(df, ("ts", "event_id"), parts=8)
    finally:
        dynamics._part = real
    assert seen[0] == 7
    keys = sorted(df.select("ts", "event_id").orderBy(dynamics.F.xxhash64("ts", "event_id")).limit(160).collect())
    sizes = [r["count"] for r in df.groupBy(dynamics._part(("ts", "event_id"), [keys[i * 20] for i in range(1, 8)])).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8


def test_missing_and_few(spark):
    rows = [(None, 1, 1), (START, None, 2), (START, 5, 3), (START, 4, 4)]
    got = {r.mem_id: r.idx for r in dynamics.ordered_index(spark.createDataFrame(rows, SCHEMA), ("ts", "event_id")).collect()}
    assert got == {2: 1, 4: 2, 3: 3}
    assert dynamics.hebbian(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("window,block", [(5, 5), (5, 7), (2, 100), (5, 1 << 16)])
def test_co_activation_is_a_fold(spark, window, block):
    """Against a list that is walked in order, with blocks of any size."""
    rows = rows_of(600, 0.6, window + block)
    last, want = [], Counter()
    for _, _, mem in sorted(rows):
        for other in last:
            if other != mem:
                want[mem, other] += 1
                want[other, mem] += 1
        last = [*last, mem][-window:]
    got = dynamics.hebbian(spark.createDataFrame(rows, SCHEMA), window=window, block=block).collect()
    assert {(r.from_id, r.to_id): r.co_activation_count + 1 for r in got} == want
    assert all(abs(r.weight - min(1.0, 0.1 * want[r.from_id, r.to_id])) < 1e-9 for r in got)
