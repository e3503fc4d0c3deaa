"""Sketches by time bucket."""

import datetime
import random

import pytest

from cairn.operators.sketches import DISTINCT_ERROR, RANK_ERROR, SketchTable

SCHEMA = "ts timestamp, value double, who long, kind string"


def test_sketches(spark, tmp_path):
    rng, start = random.Random(1), datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=rng.randrange(600)), rng.gauss(10, 3) if rng.random() > 0.05 else None, int(rng.paretovariate(0.5)) % 3000, rng.choice("ab")) for _ in range(8000)]
    t = SketchTable(spark, str(tmp_path), 3600, ["kind"])
    with pytest.raises(ValueError, match="no bucket"):
        t.summary()
    df = lambda r: spark.createDataFrame(r, SCHEMA)
    assert t.add(df(rows[:7000])) == 10 and t.add(df([(None, 1.0, 1, "a")])) == 0
    before = t.snap.read()["buckets"]
    late = [r for r in rows[7000:] if r[0].hour == 3]
    assert t.add(df(late)) == 1
    after = t.snap.read()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    base = int(start.replace(tzinfo=datetime.timezone.utc).timestamp())
    for begin, end, hours in ((None, None, range(10)), (base + 7200, base + 14400, range(2, 4))):
        for r in SketchTable(spark, str(tmp_path)).summary(begin, end, (0.5, 0.95, 0.995)).collect():
            own = [x for x in rows[:7000] + late if x[3] == r.kind and x[0].hour in hours]
            values = sorted(x[1] for x in own if x[1] is not None)
            assert r.n == len(own) and r.least == values[0] and r.most == values[-1] and abs(r["mean"] - sum(values) / len(values)) < 1e-9
            assert abs(r.distinct - len({x[2] for x in own})) <= DISTINCT_ERROR * len({x[2] for x in own})
            for p, q in ((0.5, r.q50), (0.95, r.q95), (0.995, r.q99_5)):
                assert sum(v < q for v in values) / len(values) <= p + RANK_ERROR and sum(v <= q for v in values) / len(values) >= p - RANK_ERROR


def test_a_key_without_values(spark, tmp_path):
    t = SketchTable(spark, str(tmp_path), 60, ["kind"])
    t.add(spark.createDataFrame([(datetime.datetime(2024, 1, 1), None, 5, None)] * 3, SCHEMA))
    r = t.summary().first()
    assert (r.kind, r.n, r["mean"], r.q50, r.distinct) == (None, 3, None, None, 1)
