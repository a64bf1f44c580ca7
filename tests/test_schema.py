from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from breezeframe.core import schema as S
from breezeframe.operators import report_text, schema_ops
from breezeframe.sources import readers


def test_required_and_optional_columns(spark):
    df = spark.createDataFrame([("2023-01-01", "a", "12")], "datetime string, Station string, AQI string")
    ok = schema_ops.validate(df)
    assert set(ok.columns) == {s.name for s in S.SPECS}
    row = ok.first()
    assert (row["date"], row["aqi"], row["pm25"]) == (dt.datetime(2023, 1, 1), 12.0, None)
    with pytest.raises(schema_ops.SchemaError, match="pm25"):
        schema_ops.validate(df, strict=True)
    with pytest.raises(schema_ops.SchemaError, match="aqi"):
        schema_ops.validate(df.drop("AQI"))


def test_two_headers_for_one_column_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "PM25 double, `PM2.5` double")
    with pytest.raises(schema_ops.SchemaError):
        schema_ops.rename_aliases(df)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2023-02-01 03:04:05", dt.datetime(2023, 2, 1, 3, 4, 5)),
        ("01-02-2023 03:04", dt.datetime(2023, 2, 1, 3, 4)),
        ("01/02/2023 03:04", dt.datetime(2023, 2, 1, 3, 4)),
        ("2023-02-01T03:04:05", dt.datetime(2023, 2, 1, 3, 4, 5)),
        ("01-02-2023 03:04:05", dt.datetime(2023, 2, 1, 3, 4, 5)),
        ("2023-02-01 03:04", dt.datetime(2023, 2, 1, 3, 4)),
        ("01/02/2023 03:04:05", dt.datetime(2023, 2, 1, 3, 4, 5)),
        (" 2023-02-01 ", dt.datetime(2023, 2, 1)),
        ("01-02-2023", dt.datetime(2023, 2, 1)),
        ("soon", None),
        (None, None),
    ],
)
def test_timestamp_formats(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(schema_ops.parse_timestamp(F.col("t"))).first()[0] == expected


def test_report_rows(spark):
    lines = [
        "2026-05-10 May 251 100 265 35 12 0.8 53 23 0.07",
        "  2026-05-11\t180 90 200 ",
        "2026-05-12 180",
        "Average 1 2 3 4",
        "",
    ]
    df = spark.createDataFrame([(x, "f") for x in lines], "value string, source string")
    parsed = report_text.parse_lines(df)
    assert [len(r["cells"]) for r in parsed.collect()] == [10, 4, 2]
    good = report_text.recover_rows(df).collect()
    assert {r["date"] for r in good} == {"2026-05-10", "2026-05-11"}


def test_station_files(spark, tmp_path):
    (tmp_path / "north_1.csv").write_text("Date, AQI ,PM2.5\n2023-01-01,10,1\n2023-01-02,20,2\n")
    (tmp_path / "north_2.csv").write_text("PM10;Date;AQI\n5;2023-01-02;99\n6;2023-01-03;30\n")
    (tmp_path / "south.csv").write_bytes("Date,Station,AQI\n2023-01-01,Süd,7\n".encode("latin-1"))
    north = readers.scan_station_files(spark, str(tmp_path), "north")
    rows = {r["date"].day: r for r in north.collect()}
    assert {k: r["aqi"] for k, r in rows.items()} == {1: "10", 2: "20", 3: "30"}
    assert rows[3]["pm10"] == "6" and rows[1]["pm10"] is None
    assert {r["station"] for r in rows.values()} == {"north"}
    south = readers.scan_station_files(spark, str(tmp_path), "south")
    assert south.first()["station"] == "Süd"
    everything = readers.scan_station_files(spark, str(tmp_path), "elsewhere")
    assert everything.count() == 4
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        readers.scan_station_files(spark, str(empty), "north")
