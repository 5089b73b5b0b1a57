"""Array files: round trips, byte ranges, headers that lie, and matrices with their attributes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.sources import arrays, contracts


def values(df):
    return {(r["row"], r["column"]): r["value"] for r in df.collect()}


def as_cells(a):
    a = a[:, None] if a.ndim == 1 else a
    return {(i, j): a[i, j].item() for i in range(a.shape[0]) for j in range(a.shape[1])}


@pytest.mark.parametrize("a", [
    np.arange(91, dtype=np.int8).reshape(13, 7), np.asfortranarray(np.arange(91, dtype=">i4").reshape(13, 7)),
    np.linspace(-1, 1, 30).astype(np.float32).reshape(5, 6), np.array([True, False, True]), np.array(["a", "ünï", ""]),
    np.zeros((0, 4), np.int16), np.zeros((4, 0), np.int16), np.array([2**63 - 1], np.uint64)], ids=lambda a: f"{a.dtype}{a.shape}")
def test_arrays_are_read_whole_by_ranges(spark, tmp_path, a):
    path = str(tmp_path / "a.npy")
    np.save(path, a)
    df = arrays.read_npy(spark, path, partition_bytes=40)
    assert values(df) == as_cells(a) and df.count() == a.size
    if a.size > 50:
        assert df.rdd.getNumPartitions() > 2
        kept = arrays.read_npy(spark, path, columns=[5, 1], partition_bytes=40)
        assert values(kept) == {k: v for k, v in as_cells(a).items() if k[1] in (1, 5)}


def test_steps_cut_long_lines(spark, tmp_path, monkeypatch):
    a = np.random.default_rng(0).integers(0, 100, (3, 5000)).astype(np.int16)
    path = str(tmp_path / "a.npy")
    np.save(path, a)
    reader = arrays.NpyReader(arrays.layouts(path), {"partition_bytes": "20000"})
    monkeypatch.setattr(arrays, "STEP_BYTES", 16 * 700)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.num_rows for b in batches) == 700
    got = {(r, c): v for b in batches for r, c, v in zip(*(x.to_pylist() for x in b.columns))}
    assert got == as_cells(a)


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives(spark, tmp_path, save):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, (20, 6)).astype(np.int8)
    path = str(tmp_path / "b.npz")
    about = {"model_id": np.array([f"m{k}" for k in range(6)]), "family": np.array(list("ababab")), "owner": np.array([1, 2, 3, 4, 5, 6]),
             "item_group": np.array([f"g{k % 3}" for k in range(20)])}
    save(path, responses=y, **about)
    cells = arrays.load_benchmark(spark, path, partition_bytes=30)
    got = {(r["item_id"], r["model_id"]): r for r in cells.collect()}
    assert len(got) == 120
    for (i, m), r in got.items():
        j = int(m[1:])
        assert (r["y"], r["family"], r["owner"], r["item_group"]) == (y[i, j], "ab"[j % 2], str(j + 1), f"g{i % 3}")
    models, items = cells.select("model_id", "family", "owner").distinct(), cells.select("item_id", "item_group").distinct()
    assert contracts.validate_responses(cells, models, items).where("violations <> 0").count() == 0
    with pytest.raises(ValueError, match="own attributes"):
        arrays.load_benchmark(spark, path, models="x.csv")
    save(path, responses=y, **{**about, "owner": np.arange(5)})
    with pytest.raises(ValueError, match="owner must be a vector of length 6"):
        arrays.load_benchmark(spark, path)
    save(path, responses=y)
    with pytest.raises(ValueError, match="has no array model_id"):
        arrays.load_benchmark(spark, path)


def test_matrix_with_attribute_files(spark, tmp_path):
    y = np.array([[0, 1, 0.5], [1, 1, 0]])
    np.save(tmp_path / "y.npy", y)
    (tmp_path / "m.csv").write_text("family,model_id,owner\nf,z,1\ng,a,2\nf,b,3\n")
    (tmp_path / "i.csv").write_text("item_group\nlast\nfirst\n")
    path, models, items = (str(tmp_path / n) for n in ("y.npy", "m.csv", "i.csv"))
    got = {(r["item_id"], r["model_id"]): (r["y"], r["item_group"], r["family"]) for r in arrays.load_benchmark(spark, path, models, items).collect()}
    assert got[0, "z"] == (0, "last", "f") and got[1, "a"] == (1, "first", "g") and got[0, "b"] == (None, "last", "f")
    with pytest.raises(ValueError, match="needs a file"):
        arrays.load_benchmark(spark, path)
    (tmp_path / "i.csv").write_text("item_group\nlast\n")
    with pytest.raises(ValueError, match="items must have 2 rows"):
        arrays.load_benchmark(spark, path, models, items)


def test_headers_are_checked(tmp_path):
    path = tmp_path / "a.npy"
    np.save(path, np.arange(10))
    whole = path.read_bytes()
    for broken, said in ((whole[:-1], "bytes, but"), (whole + b"x", "bytes, but"), (b"\x93NUMPX" + whole[6:], "magic"), (b"", "")):
        path.write_bytes(broken)
        with pytest.raises(ValueError, match=said):
            arrays.locate(str(path))
    for a, said in ((np.zeros((2, 2, 2)), "3 dimensions"), (np.array([{}]), "object"), (np.zeros(2, complex), "complex"), (np.array(1), "0 dimensions")):
        np.save(path, a, allow_pickle=True)
        with pytest.raises(ValueError, match=said):
            arrays.locate(str(path))


def test_written_folders(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = spark.range(100).select(F.col("id").alias("row"), F.array((F.col("id") % 7).cast("int"), F.lit(1)).alias("values")).repartition(9)
    arrays.write_npy(rows, path)
    (tmp_path / "w" / "part-lost.npy").write_bytes(b"of a lost task")
    assert values(arrays.read_npy(spark, path)) == {**{(k, 0): k % 7 for k in range(100)}, **{(k, 1): 1 for k in range(100)}}
    assert sum(x.shape[0] for x in arrays.layouts(path)) == 100
    for bad in (F.when(F.col("id") != 5, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))), F.array(F.lit(300)), F.array(F.lit(None).cast("int"))):
        with pytest.raises(Exception, match="another length|do not fit|nulls"):
            arrays.write_npy(spark.range(10).select(F.col("id").alias("row"), bad.alias("values")), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="lacks row"):
        arrays.write_npy(spark.range(1, 10).select(F.col("id").alias("row"), F.array(F.lit(1)).alias("values")), str(tmp_path / "gap"))
        arrays.layouts(str(tmp_path / "gap"))
    empty = str(tmp_path / "empty")
    arrays.write_npy(rows.limit(0), empty)
    assert arrays.read_npy(spark, empty).count() == 0
