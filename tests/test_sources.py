"""Files in and out."""

import os

from pyspark.sql import functions as F

from seawake.schema import POINT_COLUMNS
from seawake.sources import positions, sinks

HEAD = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,IMO,CallSign,VesselType,Status,Length,Width,Draft,Cargo,TranscieverClass"
LINE = "200000001,2025-01-01 00:00:00,30.5,121.5,1.5,90, ,EVER GIVEN ,IMO1,C1,70,0,200,30,10,70,A"


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return str(path)


def test_header_spellings_and_blank_cells(spark, tmp_path):
    p = positions.read_positions_csv(spark, write(tmp_path / "a.csv", f"{HEAD}\n{LINE}\n"))
    r = p.first()
    assert p.columns == POINT_COLUMNS
    assert (r["mmsi"], r["latitude"], r["vessel_name"], r["heading"], r["transceiver"]) == (200000001, 30.5, "EVER GIVEN", None, "A")
    snake = "mmsi,base_date_time,latitude,longitude,vessel_name\n200000002,2025-01-01 00:00:00,1,2,X\n"
    r = positions.read_positions_csv(spark, write(tmp_path / "b.csv", snake)).first()
    assert (r["longitude"], r["vessel_name"], r["cargo"]) == (2.0, "X", None)


def test_bom_gbk_and_bad_numbers(spark, tmp_path):
    bom = positions.read_positions_csv(spark, write(tmp_path / "bom.csv", f"{HEAD}\n{LINE}\n", "utf-8-sig"))
    assert bom.first()["mmsi"] == 200000001
    gbk = write(tmp_path / "gbk.csv", "mmsi,timestamp,lat,lon,name\n200000001,2025-01-01 00:00:00,1,2,长江\n", "gbk")
    assert positions.read_positions_csv(spark, gbk, encoding="GBK").first()["vessel_name"] == "长江"
    bad = write(tmp_path / "bad.csv", "mmsi,timestamp,lat,lon\n200000001,2025-01-01 00:00:00,x,2\n200000002,2025-01-01 00:00:00,1,2\n")
    raw = positions.read_text_columns(spark, bad)
    assert positions.type_positions(raw).where("latitude is null").count() == 1
    assert positions.rejected_rows(raw).count() == 1


def test_clean_drops_incomplete_and_skips_files_without_position(spark):
    df = spark.createDataFrame(
        [("1", "2025-01-01 00:00:00", "91", "1"), ("2", "01/01/2025", "1", "1"), ("3", "2025-01-01 00:00:00", "1", "1")],
        "mmsi string, BaseDateTime string, lat string, lon string",
    )
    assert [r["mmsi"] for r in positions.clean_points(df).collect()] == [3]
    assert positions.clean_points(df.drop("lat")).isEmpty()


def test_folder_of_files(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"{i}.csv", f"{HEAD}\n{LINE}\n")
    write(tmp_path / "note.txt", "nothing")
    assert positions.read_positions_csv(spark, str(tmp_path), glob="*.csv").count() == 3


def test_append_keeps_stored_rows(make_points):
    old = make_points([(200000001, 0, 1.0, 1.0)])
    new = make_points([(200000001, 0, 2.0, 2.0), (200000001, 60, 3.0, 3.0), (200000001, 60, 4.0, 4.0)])
    assert [r["longitude"] for r in sinks.append_points(new, old).collect()] == [3.0]
    assert [r["longitude"] for r in sinks.dedupe_points(new).orderBy("base_date_time").collect()] == [2.0, 4.0]


def test_overwrite_and_layout(spark, tmp_path, fixture_points):
    path = str(tmp_path / "points")
    sinks.write_points(fixture_points, path)
    sinks.write_points(fixture_points.limit(10), path, mode="overwrite")
    assert spark.read.parquet(path).count() == 10
    assert any(d.startswith("event_date=") for d in os.listdir(path))


def test_geojson(make_points):
    p = make_points([(200000001, 7200, 3.0, 4.5), (200000001, 0, 1.0, 2.5)])
    flat = p.select("mmsi", F.col("base_date_time").alias("ts"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    assert sinks.to_geojson(flat).first()["geojson"] == '{"type":"LineString","coordinates":[[1.0,2.5],[3.0,4.5]]}'


def test_streamed_import_is_idempotent(spark, tmp_path):
    from seawake.streaming.ingest import start_import, stream_positions

    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    for i in range(2):
        write(folder / f"{i}.csv", f"{HEAD}\n{LINE}\n")
        raw = stream_positions(spark, str(folder), HEAD.split(","))
        start_import(raw, table, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert spark.read.parquet(table).count() == 1


def test_headers_and_encodings_file_by_file(spark, tmp_path):
    """Two column orders, a file without position, a GBK one, an empty one and one with a mark."""
    when = "2025-01-01 00:00:00"
    write(tmp_path / "a.csv", f"MMSI,BaseDateTime,LAT,LON\n200000001,{when},30.5,121.5\n")
    write(tmp_path / "b.csv", f"MMSI,BaseDateTime,LON,LAT\n200000002,{when},121.5,30.5\n")
    write(tmp_path / "c.csv", f"MMSI,BaseDateTime,SOG\n200000003,{when},5\n")
    write(tmp_path / "d.csv", f"MMSI,BaseDateTime,LAT,LON,VesselName\n200000004,{when},30.5,121.5,长江\n", "gbk")
    write(tmp_path / "e.csv", "")
    write(tmp_path / "f.csv", f"MMSI,BaseDateTime,LAT,LON\r\n200000006,{when},30.5,121.5\r\n", "utf-8-sig")
    rows = {r.mmsi: r for r in positions.read_positions_csv(spark, str(tmp_path), glob="*.csv").collect()}
    assert sorted(rows) == [200000001, 200000002, 200000004, 200000006]
    assert {(r.longitude, r.latitude) for r in rows.values()} == {(121.5, 30.5)}
    assert rows[200000004].vessel_name == "长江"
    assert positions.read_positions_csv(spark, str(tmp_path / "c.csv")).count() == 0


def test_whole_files_tell_their_encoding(spark, tmp_path):
    """More than a MiB of ASCII before the first GBK name, CR line ends, blank lines before the header."""
    head, line = "mmsi,timestamp,lat,lon,name", "200000001,2025-01-01 00:00:00,1,2,X"
    rows = "\n".join([line] * 40_000)
    assert len(rows) > 1 << 20
    write(tmp_path / "late.csv", f"{head}\n{rows}\n200000002,2025-01-01 00:00:00,1,2,长江\n", "gbk")
    with open(tmp_path / "cr.csv", "wb") as f:
        f.write("\r".join([head, *["200000003,2025-01-01 00:00:00,1,2,黄河"] * 30_000, ""]).encode())
    write(tmp_path / "blank.csv", f"\n  \n{head}\n200000004,2025-01-01 00:00:00,1,2,Y\n")
    groups = positions.header_groups(spark, str(tmp_path), glob="*.csv")
    assert {(e, h, tuple(sorted(os.path.basename(p) for p in files))) for (e, h), files in groups.items()} == {
        ("GBK", head, ("late.csv",)),
        ("UTF-8", head, ("blank.csv", "cr.csv")),
    }
    got = positions.read_positions_csv(spark, str(tmp_path), glob="*.csv").groupBy("mmsi", "vessel_name").count().collect()
    assert sorted(map(tuple, got)) == [
        (200000001, "X", 40_000), (200000002, "长江", 1), (200000003, "黄河", 30_000), (200000004, "Y", 1),
    ]
