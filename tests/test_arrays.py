"""Array files read and written by ranges of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import arrays


def pixels_of(rows):
    return {(r.scene, r.band, r.row, r.col): r.value for r in rows}


@pytest.mark.parametrize("partition_bytes", [1, 200, 32 << 20])
def test_every_layout(spark, tmp_path, partition_bytes):
    rng = np.random.default_rng(1)
    flat, first, last = rng.normal(size=(7, 5)).astype("f4"), rng.integers(0, 900, (2, 6, 9)).astype("u2"), rng.normal(size=(8, 4, 2))
    (tmp_path / "in ner").mkdir()
    (tmp_path / "_hidden").mkdir()
    np.save(tmp_path / "flat.npy", flat)
    np.save(tmp_path / "in ner" / "first.npy", first)
    np.save(tmp_path / "last.npy", np.asfortranarray(last))
    np.save(tmp_path / "turned.npy", np.asfortranarray(first))
    np.save(tmp_path / "plain.npy", last)
    np.save(tmp_path / "_hidden" / "x.npy", flat)
    (tmp_path / "note.txt").write_text("x")
    df = arrays.read_arrays(spark, str(tmp_path), partition_bytes=partition_bytes)
    got = pixels_of(df.collect())
    want = {("flat", "VV", r, c): float(flat[r, c]) for r in range(7) for c in range(5)}
    for b, band in enumerate(arrays.BANDS):
        want |= {(s, band, r, c): float(first[b, r, c]) for s in ("in ner/first", "turned") for r in range(6) for c in range(9)}
        want |= {(s, band, r, c): float(last[r, c, b]) for s in ("last", "plain") for r in range(8) for c in range(4)}
    assert got == want
    some = df.filter("band = 'VH' AND row >= 2 AND row < 4 AND col <> 1")
    assert pixels_of(some.collect()) == {k: v for k, v in want.items() if k[1] == "VH" and 2 <= k[2] < 4 and k[3] != 1}
    assert df.filter("scene = 'plain' AND scene = 'last'").count() == 0 and df.filter("row = 7 AND scene = 'plain'").count() == 8


def test_filters_choose_what_is_read(tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((2, 100, 10), "f4"))
    np.save(tmp_path / "b.npy", np.zeros((100, 10), "f4"))
    reader = arrays.RasterReader({"path": str(tmp_path), "partitionbytes": "400"})
    assert len(reader.partitions()) == 30
    left = list(reader.pushFilters([arrays.EqualTo(("scene",), "a"), arrays.EqualTo(("band",), "VH"), arrays.GreaterThan(("row",), 14), arrays.LessThanOrEqual(("row",), 30),
                                    arrays.EqualTo(("col",), 3)]))
    assert [f.attribute for f in left] == [("col",)]
    assert [(p.scene, p.band, p.first, p.last) for p in reader.partitions()] == [("a", 1, 15, 25), ("a", 1, 25, 31)]


def test_a_file_over_two_gigabytes(spark, tmp_path):
    """The file has holes and takes no room; its last rows are read alone."""
    shape, tail = (3_000_000, 200), np.arange(400, dtype="f4").reshape(2, 200)
    with open(tmp_path / "large.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": shape})
        f.seek(f.tell() + (shape[0] - 2) * shape[1] * 4)
        f.write(tail.tobytes())
    assert (tmp_path / "large.npy").stat().st_size > 2**31
    got = arrays.read_arrays(spark, str(tmp_path)).filter(f"row >= {shape[0] - 2}").orderBy("row", "col").collect()
    assert [r.value for r in got] == tail.ravel().tolist() and got[0].row == shape[0] - 2


def test_written_and_read_back(spark, tmp_path):
    pixels = spark.range(6 * 40 * 30).select((F.col("id") % 6).alias("scene"), (F.floor(F.col("id") / 6) % 40).alias("row"), F.floor(F.col("id") / 240).alias("col"),
                                             (F.col("id") * 0.5).alias("value"))
    arrays.write_arrays(pixels, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{i}.npy" for i in range(6)]
    assert np.load(tmp_path / "out" / "3.npy").shape == (40, 30)
    back = arrays.read_arrays(spark, str(tmp_path / "out"), partition_bytes=1000)
    assert back.join(pixels.withColumn("scene", F.col("scene").cast("string")), ["scene", "row", "col", "value"]).count() == 7200 == back.count()


def test_missing_pixels_are_an_error(spark, tmp_path):
    holes = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 2, 0, 1.0)], "scene string, row bigint, col bigint, value double")
    with pytest.raises(Exception, match="row 1 of"):
        arrays.write_arrays(holes, str(tmp_path / "out"))
    assert not (tmp_path / "out" / "a.npy").exists()
