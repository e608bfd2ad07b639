"""Similar-track search by descent in the trie of codes, and space-time parts by a tree of cuts."""

import numpy as np
from pyspark.sql import functions as F

from seawake.operators import retrieval, similarity, trips


def _codes(spark, values):
    return spark.createDataFrame([(int(c),) for c in values], "_code long").groupBy("_code").agg(F.count("*").alias("n"))


def test_a_rare_code_meets_few_of_a_full_sibling(spark):
    """2 codes share the query's first byte, 5000 others the sibling branch; 4 are wanted, 4 are joined."""
    rng = np.random.default_rng(11)
    crowd = (1 << 24) + rng.choice(1 << 24, 5000, replace=False)
    codes = [7, 1 << 20, *crowd.tolist()]
    asked = spark.createDataFrame([(5,)], "q long")
    got = sorted(r["_code"] for r in similarity._nearest_codes(_codes(spark, codes), asked, 4).collect())
    assert got == sorted(sorted(codes, key=lambda c: c ^ 5)[:4])


def test_fewer_codes_than_wanted_and_none(spark):
    asked = spark.createDataFrame([((1 << 32) - 1,), (0,)], "q long")
    got = similarity._nearest_codes(_codes(spark, [3, (1 << 32) - 5]), asked, 6)
    assert sorted(map(tuple, got.collect())) == [(q, c) for q in (0, (1 << 32) - 1) for c in (3, (1 << 32) - 5)]
    assert similarity._nearest_codes(_codes(spark, [3]).where("false"), asked, 6).isEmpty()


def test_names_of_samples_do_not_matter(spark):
    """The id may be named like the columns used inside."""
    s = spark.createDataFrame([(i, 10 * i) for i in range(6)], "q long, code long")
    asked = spark.createDataFrame([(0, 21)], "query_id long, code long")
    assert [tuple(r) for r in similarity.similar_tracks(s, asked, k=2, id_col="q").collect()] == [(0, 1, 2, 20 ^ 21), (0, 2, 3, 30 ^ 21)]


def test_parts_do_not_grow_the_plan(fixture_points):
    s = trips.trip_summary(trips.build_trips(fixture_points, numbered=False))
    few, many = (retrieval.st_partition(s, n) for n in (4, 32))
    size = [len(d._jdf.queryExecution().analyzed().toString()) for d in (few, many)]
    assert abs(size[0] - size[1]) < 100
    # each finer part lies in one coarser part
    a, b = few.select("mmsi", "trip_key", F.col("part").alias("p")), many.select("mmsi", "trip_key", "part")
    assert a.join(b, ["mmsi", "trip_key"]).groupBy("part").agg(F.countDistinct("p").alias("n")).where("n > 1").isEmpty()


def test_cut_tree_equals_descending_by_hand(spark):
    tree = retrieval.CutTree()
    tree.split(0, 0, 5.0, 1)
    tree.split(1, 2, 0.0, 2)
    tree.split(0, 1, 1.0, 3)
    d = spark.createDataFrame([(5.0, 1.0, 9.0), (5.0, 1.5, 9.0), (6.0, 0.0, 0.0), (6.0, 0.0, 0.5)], "x double, y double, t double")
    assert [r[0] for r in d.select(tree.part("x", "y", "t")).collect()] == [0, 3, 1, 2]
