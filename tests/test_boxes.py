"""Range and nearest-neighbour search between blocks, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seawake.operators import boxes, retrieval
from tests.test_cells import at, frame

HOUR = 3_600_000_000


def part_of(trips, asked, number):
    rows = [(m, None, 0, *b) for m, b in trips] + [(None, i, 1, *b) for i, b in asked]
    types = [("mmsi", pa.int64()), (number, pa.int64()), ("side", pa.int32()), *((c, pa.float64() if c[0] != "t" else pa.int64()) for c in boxes.SIDES)]
    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)]
    return iter([pa.RecordBatch.from_arrays(columns, names=[n for n, _ in types])])


def some(seed, n, ids, size):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y, t = r.gauss(0, 2), r.gauss(0, 2), r.randint(0, 10 * HOUR)
        out.append((i % ids, (x, x + r.random() * size, y, y + r.random() * size, t, t + r.randint(0, HOUR))))
    return out


@pytest.mark.parametrize("run", [1, 3000, 8_000_000])
def test_hits_of_runs(monkeypatch, run):
    """Vessels of several trips and numbers of several boxes give a hit once, whatever the runs."""
    monkeypatch.setattr(boxes, "RUN", run)
    monkeypatch.setattr(boxes, "ROWS", 50)
    trips, asked = some(1, 700, 250, 1.0), some(2, 90, 60, 2.0)
    got = [tuple(r.values()) for b in boxes.hits("box_id")(part_of(trips, asked, "box_id")) for r in b.to_pylist()]
    want = {(i, m) for i, a in asked for m, b in trips if all(a[k] <= b[k + 1] and b[k] <= a[k + 1] for k in (0, 2, 4))}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("run", [1, 3000, 8_000_000])
@pytest.mark.parametrize("vessels", [4, 250])
def test_nearest_of_runs(monkeypatch, run, vessels):
    """What is given holds the narrower rings whole and the nearest of the last one."""
    monkeypatch.setattr(boxes, "RUN", run)
    k, widest = 6, 10
    trips = some(3, 700, vessels, 0.3)
    asked = [(i, (b[0], b[0], b[2], b[2], b[4], b[4])) for i, b in some(4, 60, 60, 0)]
    got = {}
    for b in boxes.nearest(k, 0.1, widest)(part_of(trips, asked, "query_id")):
        for r in b.to_pylist():
            got.setdefault(r["query_id"], []).append((r["level"], round(r["distance"], 9), r["mmsi"]))
    for i, (x, _, y, _, t, _) in asked:
        best = {}
        for m, b in trips:
            gap = max(b[4] - t, 0, t - b[5])
            if gap <= HOUR:
                dx, dy = max(b[0] - x, 0, x - b[1]), max(b[2] - y, 0, y - b[3])
                level = next((n for n in range(widest + 1) if max(dx, dy) <= 0.1 * 2**n), 99)
                old = best.get(m, (99, 9e9))
                best[m] = (min(old[0], level), min(old[1], np.sqrt(dx * dx + dy * dy + (gap / HOUR) ** 2)))
        held = sorted(v[0] for v in best.values())
        stop = held[k - 1] if len(held) >= k else widest
        of_stop = sorted((round(d, 9), m) for m, (n, d) in best.items() if n == stop)
        want = {(n, round(d, 9), m) for m, (n, d) in best.items() if n < stop} | {(stop, d, m) for d, m in (of_stop[:k])}
        assert set(got.get(i, [])) == want and len(got.get(i, [])) == len(want) < 2 * k


def test_hits_are_not_shuffled(spark):
    """300 boxes that all meet 200 vessels: no shuffle takes the 60 000 hits."""
    s = frame(spark, [(m, (0.0, 1.0, 0.0, 1.0, 0.0, 60.0)) for m in range(200)], "mmsi").withColumnRenamed("b", "mbb")
    b = frame(spark, [(i, (0.5, 1.5, 0.5, 1.5, 30.0, 90.0)) for i in range(300)], "box_id").withColumnRenamed("b", "box")
    hits = retrieval.range_query(s, b)
    assert hits.count() == 60_000
    exchanges = [x for x in hits._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert exchanges and all("box_id" not in x.split("[plan_id")[0] for x in exchanges)


def test_no_candidates_are_written(spark, monkeypatch):
    """Of 300 vessels around 20 queries, a block gives less than twice ``k`` to a query and nothing else is kept."""
    s = frame(spark, [(m, (0.0, 1.0 + m / 1e4, 0.0, 1.0, 0.0, 60.0)) for m in range(300)], "mmsi").withColumnRenamed("b", "mbb")
    q = spark.createDataFrame([(i, 0.5, 0.5, at(10)) for i in range(20)], "query_id long, lon double, lat double, ts timestamp")
    seen, real = [], retrieval.reliable_checkpoint

    def counted(df):
        out = real(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(retrieval, "reliable_checkpoint", counted)
    got = retrieval.knn_query(s, q, k=3)
    first = got.groupBy("query_id").agg(F.sort_array(F.collect_list("mmsi")).alias("m")).collect()
    assert max(seen) <= 300 and len(first) == 20 and all(r["m"] == [0, 1, 2] for r in first)
