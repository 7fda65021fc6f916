"""Detectors on the phantom tile, whose lane covers rows 140 to 159, and the files beside the tables."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from corridor.functions import labels
from corridor.operators import detect, dissolve
from corridor.plans import detectors as D
from corridor.sources import formats, store


def test_texture_finds_the_lane(spark):
    rows = {r["win_row"]: r["score"] for r in D.texture_scores(spark, SF).collect()}
    assert rows[145] > -0.1 and max(rows, key=rows.get) in (140, 145, 150) and rows[130] < rows[145]
    hit = D.texture_hits(spark, SF).first()
    assert hit["label"] == "bikelane" and hit["top"] <= 145 and hit["bottom"] >= 155
    road = {r["win_row"]: r["score"] for r in D.road_scores(spark, SF).collect()}
    assert road[50] > road[145]


def test_lane_is_traced(spark):
    rows = D.lane_bands(spark, SF).collect()
    assert len(rows) == 1 and 135 <= rows[0]["top"] <= 141 and 158 <= rows[0]["bottom"] <= 164


def test_centerline_runs_in_the_middle(spark):
    rows = D.lane_centerlines(spark, SF).collect()
    assert len({r["lane_id"] for r in rows}) == 1 and all(abs(r["y"] - (20 - 14.95)) < 1e-6 for r in rows)
    measured = D.lanes_measured(spark, SF).collect()
    assert measured and all(abs(float(r["gap"]) - 1.25) < 0.06 for r in measured)


def test_surface_parts(spark):
    sizes = sorted(r["size"] for r in D.road_surface(spark, SF).collect())
    assert len(sizes) == 2 and all(18_000 < s <= 120 * 190 + 4000 for s in sizes)


def test_widths_of_a_class(spark):
    rows = D.detect_roads(spark, SF).collect()
    assert [r["way_id"] for r in rows] == [1] and abs(rows[0]["width_median_m"] - 5.5) < 0.2


def test_resize():
    x = np.zeros((4, 4, 3), np.uint8)
    x[:, 2:] = 255
    out = detect.resize(x, 8)
    assert out.shape == (8, 8, 3) and out[0, 0, 0] == 0 and out[0, 7, 0] == 1 and (np.diff(out[0, :, 0]) >= 0).all()
    assert np.allclose(detect.resize(np.full((3, 5, 3), 51, np.uint8)), 0.2)


def test_own_model(spark):
    px = D.phantom(spark, SF).where("prow < 20 and pcol < 30")

    def load():
        return lambda images: images.mean(axis=(1, 2))

    rows = detect.model_embedder(load, 3)(px, 10, 10).collect()
    assert len(rows) == 6 and all(np.allclose(r["embedding"], [100 / 255] * 3) for r in rows)


def test_centerlines_of_two_tiles(spark):
    """Component numbers repeat from tile to tile; their lanes do not merge."""
    px = D.phantom(spark, SF).where("lane").select("prow", "pcol")
    both = px.selectExpr("'a' AS tile", "prow", "pcol").unionByName(px.selectExpr("'b' AS tile", "prow + 20 AS prow", "pcol"))
    rows = detect.centerlines(both, (0.1, -0.1, 0.0, 20.0), 0.1, 800).collect()
    assert len({r["lane_id"] for r in rows}) == 2 and {round(r["y"], 6) for r in rows if r["tile"] == "a"} == {5.05} and {round(r["y"], 6) for r in rows if r["tile"] == "b"} == {3.05}


def test_paths_and_masks(spark, tmp_path):
    stems = spark.createDataFrame([("t1",), ("t2",)], "stem string")
    assert {r["stem"]: r["path"] for r in store.raw_path(stems, "/in/t1.jp2", "/archive").collect()} == {"t1": "/in/t1.jp2", "t2": "/archive/t2.jp2"}
    masks = spark.createDataFrame([("t2", "/m/t2")], "stem string, mask_path string")
    assert {r["stem"]: r["mask_path"] for r in store.mask_paths(stems, masks).collect()} == {"t1": None, "t2": "/m/t2"}
    spark.createDataFrame([("t", 0, 0, 0.5), ("t", 0, 1, 0.6), ("t", 1, 0, 1.0)], "tile string, prow int, pcol int, value double").write.parquet(str(tmp_path / "mask"))
    assert {(r["prow"], r["pcol"]) for r in store.lane_mask(spark, str(tmp_path / "mask")).collect()} == {(0, 1), (1, 0)}
    roads = spark.createDataFrame([(1, 3, 5.0)], "way_id long, n_samples long, width_median_m double")
    store.save_vectors(roads, "roads", str(tmp_path / "roads"))
    assert spark.read.parquet(str(tmp_path / "roads")).count() == 1
    with pytest.raises(ValueError, match="lane_id"):
        store.save_vectors(roads, "lanes", str(tmp_path / "lanes"))
    left = spark.range(1).select(labels.remaining(F.lit(4.0), F.lit(10.0), F.lit(6.0)).alias("a"), labels.remaining(F.lit(0.0), F.lit(10.0), F.lit(6.0)).alias("b"), dissolve.growth(F.lit(50.0), F.lit(60.0)).alias("c"), dissolve.growth(F.lit(0.0), F.lit(3.0)).alias("d")).first()
    assert left["a"] == 9 and left["b"] is None and abs(left["c"] - 20) < 1e-9 and left["d"] == 200


def test_files(spark, tmp_path):
    (tmp_path / "a.jp2.aux.xml").write_text(
        '<PAMDataset><PAMRasterBand band="1"><Metadata><MDI key="STATISTICS_MAXIMUM">255</MDI><MDI key="STATISTICS_MEAN">99.5</MDI></Metadata></PAMRasterBand>'
        '<PAMRasterBand band="2"><Metadata><MDI key="STATISTICS_MAXIMUM">254</MDI></Metadata></PAMRasterBand></PAMDataset>'
    )
    got = {(r["band"], r["key"], r["value"]) for r in formats.sidecar(spark, str(tmp_path / "*.xml")).collect()}
    assert got == {(1, "MAXIMUM", 255.0), (1, "MEAN", 99.5), (2, "MAXIMUM", 254.0)}
    (tmp_path / "t2.jp2").write_bytes(b"x")
    (tmp_path / "t1.jp2").write_bytes(b"x")
    assert [r["stem"] for r in formats.tile_paths(spark, str(tmp_path)).collect()] == ["t1", "t2"]
    labels = tmp_path / "labels"
    labels.mkdir()
    (labels / "t1.txt").write_text("0 0.1 0.1 0.5 0.1 0.5 0.9\n\n1 0 0")
    assert [(r["stem"], r["line_no"], r["line"][:1]) for r in formats.annotations(spark, str(labels)).orderBy("line_no").collect()] == [("t1", 0, "0"), ("t1", 1, ""), ("t1", 2, "1")]
    (tmp_path / "data.yaml").write_text("path: .\nnames:\n  0: Bikelane\n  1: bikeoverroad\ntrain: x\n")
    assert {(r["class_id"], r["name"]) for r in formats.class_names(spark, str(tmp_path / "data.yaml")).collect()} == {(0, "Bikelane"), (1, "bikeoverroad")}
    refs = spark.createDataFrame([("road", "a", [1.0])], "label string, stem string, embedding array<double>")
    refs.write.partitionBy("label").parquet(str(tmp_path / "refs"))
    assert formats.references(spark, str(tmp_path / "refs")).first()["label"] == "road"
