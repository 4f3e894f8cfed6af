"""Readers and writers on temporary folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cadastre.operators import maintain as T, reports as R
from cadastre.sources import derived as D, store as S
from cadastre.catalog.audit import report_lines


def test_read_store_types_and_missing_collections(spark, tmp_path):
    doc = {
        "projects": [{"id": "p1", "name": "North", "coordinates": [18.5, 73.9], "is_demo": False}],
        "parcels": [{"parcel_id": "PM-1", "project_id": "p1", "confidence": 0.8, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}],
        "imagery": [{"id": "i1", "project_id": "p1", "metadata": {"crs": "EPSG:4326"}}],
    }
    (tmp_path / "store.json").write_text(json.dumps(doc))
    tables = S.read_store(spark, str(tmp_path))
    assert set(tables) == set(S.COLLECTIONS)
    assert tables["projects"].first().project_id == "p1"
    assert tables["imagery"].first().metadata["crs"] == "EPSG:4326"
    assert tables["activities"].count() == 0
    pts = S.parse_geometry(tables["parcels"], "geometry").first().pts
    assert [(p.x, p.y) for p in pts] == [(0, 0), (1, 0), (1, 1), (0, 0)]


@pytest.mark.parametrize("text,n", [
    ('{"type":"LineString","coordinates":[[1,2],[3,4]]}', 2), ('{"type":"Polygon","coordinates":[[[1,2],[3,4],[5,6]]]}', 3), ('{"coordinates":"x"}', 0), ("not json", 0), (None, 0),
])
def test_geometry_forms(spark, text, n):
    df = spark.createDataFrame([(text,)], "g string")
    assert len(S.parse_geometry(df, "g").first().pts) == n


def test_reference_cadastre_swaps_axes(spark, tmp_path):
    doc = {"plots": [{"id": "a", "plotNo": "1", "areaAcre": 1.5, "coordinates": [[18.5, 73.9], [18.6, 73.8], [18.4, 73.7]]}], "pois": [{"id": "x", "lat": 18.0, "lng": 73.0}], "places": [{"state": "S", "center": [18.1, 73.2]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    c = S.read_reference_cadastre(spark, str(tmp_path))
    assert c["plots"].first().pts[0] == (73.9, 18.5)
    assert (c["pois"].first().x, c["pois"].first().y) == (73.0, 18.0)
    assert c["places"].first().x == 73.2 and c["roads"].count() == 0


def test_imagery_files(spark, tmp_path):
    (tmp_path / "A.TIF").write_bytes(b"x" * 3_000_000)
    (tmp_path / "b.jpg").write_bytes(b"x" * 2048)
    rows = {r.file_name: r for r in S.read_imagery_files(spark, str(tmp_path)).collect()}
    assert rows["A.TIF"].is_georeferenced and rows["A.TIF"].file_size == "2.9 MB"
    assert not rows["b.jpg"].is_georeferenced and rows["b.jpg"].file_size == "2 KB"


def test_partition_overwrite_keeps_the_rest(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "project_id int, imagery_id int, v string").write.partitionBy("project_id", "imagery_id").parquet(path)
    T.overwrite_partitions(spark.createDataFrame([(1, 2, "new")], "project_id int, imagery_id int, v string"), path, ["project_id", "imagery_id"])
    assert sorted((r.imagery_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "new"), (3, "c")]


def test_csv_quotes_every_field(spark, tmp_path):
    rows = spark.createDataFrame([('a"b', "x,y", None)], "p string, q string, r string")
    R.write_csv(rows, str(tmp_path / "csv"))
    parts = [(tmp_path / "csv" / f).read_text().splitlines() for f in os.listdir(tmp_path / "csv") if f.endswith(".csv")]
    assert parts and all(lines[0] == '"p","q","r"' for lines in parts)
    data = [line for lines in parts for line in lines[1:]]
    assert len(data) == 1 and data[0].startswith('"a""b","x,y"')


def test_export_package(spark, small, tmp_path):
    joined = report_lines(spark, small)
    R.export_package(joined, D.projects(spark, small), str(tmp_path / "out"))
    verified = joined.where("status = 'accepted'").count()
    features = spark.read.text(str(tmp_path / "out/geojson/features"))
    assert features.count() == verified
    first = json.loads(features.select("value").first().value)
    assert first["type"] == "Feature" and first["geometry"]["type"] == "Polygon"
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).count() == verified
    assert spark.read.text(str(tmp_path / "out/manifest")).where(F.col("value").startswith("Project:")).count() == 5


def test_export_layers(spark, small, tmp_path):
    f = D.features(spark, small).select("feature_id", "detection_type")
    R.write_layers(f, str(tmp_path / "layers"))
    assert len([d for d in os.listdir(tmp_path / "layers") if d.startswith("layer=")]) == f.select("detection_type").distinct().count()
    assert spark.read.json(str(tmp_path / "layers")).count() == f.count()
