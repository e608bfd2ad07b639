import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from seawake.session import local_session

    session = local_session("8", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fixture_points(spark):
    from seawake.fixture import points_from_events

    return points_from_events(spark, SF)


@pytest.fixture(scope="session")
def make_points(spark):
    """Points from ``(mmsi, seconds, lon, lat[, sog[, cog]])`` rows; seconds count from a fixed midnight."""
    import datetime as dt

    from pyspark.sql import functions as F

    from seawake.schema import POINT_SCHEMA

    midnight = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)

    def make(rows):
        full = [(r[0], midnight + dt.timedelta(seconds=r[1]), *r[2:4], *(r[4:] + (None,) * (6 - len(r)))) for r in rows]
        df = spark.createDataFrame(
            [(*r, i) for i, r in enumerate(full)],
            "mmsi long, base_date_time timestamp, longitude double, latitude double, sog double, cog double, src_id long",
        )
        for field in POINT_SCHEMA.fields:
            if field.name not in df.columns:
                df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
        return df.withColumn("vessel_name", F.lit("X"))

    return make


def at(seconds):
    import datetime as dt

    return dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)
