"""Binary matrices and paired CSV file sets against NumPy and the csv module."""

import csv
import gzip
import io

import numpy as np
import pytest

from curatrix.sources import files as FS
from curatrix.sources import tables as S


def vectors(spark, n=53, width=7):
    x = np.random.default_rng(2).normal(size=(n, width)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in np.random.default_rng(3).permutation(n).tolist()]
    return x, spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)


def test_matrix_is_written_in_order_and_read_in_byte_ranges(spark, tmp_path):
    x, df = vectors(spark)
    path = str(tmp_path / "m")
    assert FS.write_matrix(df, ["id"], "embedding", path) == 53
    stacked = np.concatenate([np.load(f) for f in FS.list_files(path)])
    assert stacked.dtype == np.float32 and np.array_equal(stacked, x)
    found = FS.read_matrix(spark, path, partition_bytes=100)
    assert found.rdd.getNumPartitions() >= 53 // 3
    assert {r["row"]: r["vector"] for r in found.collect()} == {i: v for i, v in enumerate(x.astype(float).tolist())}
    aligned = S.load_matrix(spark, path, df.select("id"), ["id"], kind="binary")
    assert {r["id"]: r["embedding"] for r in aligned.collect()} == {i: v for i, v in enumerate(x.astype(float).tolist())}
    with pytest.raises(ValueError):
        S.load_matrix(spark, path, df.select("id").filter("id < 50"), ["id"], kind="binary")


def test_matrix_files_of_other_writers(spark, tmp_path):
    for kind in ("<f8", "<f4", "<i8", ">f4"):
        x = (np.arange(30).reshape(10, 3) - 7).astype(kind)
        np.save(tmp_path / f"one{kind[1:]}.npy", x)
        found = FS.read_matrix(spark, str(tmp_path / f"one{kind[1:]}.npy")).orderBy("row").collect()
        assert [r["vector"] for r in found] == x.astype(float).tolist()


def test_broken_matrices_are_errors(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.ones((4, 3), np.float32))
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(whole[:-4])
    (tmp_path / "text.npy").write_bytes(b"vectors")
    np.save(tmp_path / "cube.npy", np.ones((2, 2, 2)))
    for name in ("short.npy", "text.npy", "cube.npy", "absent.npy"):
        with pytest.raises(Exception):
            FS.read_matrix(spark, str(tmp_path / name)).count()
    folder = tmp_path / "mixed"
    folder.mkdir()
    np.save(folder / "0.npy", np.ones((4, 3)))
    np.save(folder / "1.npy", np.ones((4, 2)))
    with pytest.raises(Exception):
        FS.read_matrix(spark, str(folder)).count()
    np.save(tmp_path / "none.npy", np.ones((0, 3)))
    assert FS.read_matrix(spark, str(tmp_path / "none.npy")).count() == 0
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<float>")
    for bad in (uneven, uneven.selectExpr("id", "cast(null AS array<float>) AS embedding")):
        with pytest.raises(ValueError):
            FS.write_matrix(bad, ["id"], "embedding", str(tmp_path / "bad"))


RECORDS = [["a", "q\nr", "x"], ["b", 'say "hi", ok', ""], ["", "ü" * 30_000, "two\r\nlines\n\n"], ["c", "", "z"]]


def written(folder, name, head, records, zipped, extra=()):
    text = io.StringIO(newline="")
    text.write("".join(line + "\n" for line in extra))
    writer = csv.writer(text, lineterminator="\n")
    writer.writerow(head)
    text.write("\n")
    writer.writerows(records)
    (folder / name).write_bytes(gzip.compress(text.getvalue().encode()) if zipped else text.getvalue().encode())
    return text.getvalue()


def test_paired_files(spark, tmp_path):
    head = ["name", "sequence_alignment_aa_heavy", "sequence_alignment_aa_light"]
    one = written(tmp_path, "one.csv.gz", head, RECORDS, True, ['{"Run": "x, y"}'])
    written(tmp_path, "two.csv", [" SEQUENCE_ALIGNMENT_AA_LIGHT ", "sequence_alignment_aa_heavy"], [["l", "h"], ["l only"], ["l", "h", "wide"]], False)
    written(tmp_path, "nohead.csv", ["x", "y"], [["1", "2"]], False)
    (tmp_path / "empty.csv.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "_hidden.csv").write_text("sequence_alignment_aa_heavy,sequence_alignment_aa_light\n1,2\n")
    heavy, light = ["sequence_alignment_aa_heavy"], ["sequence_alignment_aa_light"]
    rows = S.scan_paired_files(spark, [str(tmp_path)], heavy=heavy, light=light).collect()
    got = sorted((r["source_file"], r["line_no"], r["heavy_raw"], r["light_raw"]) for r in rows)
    # Line 1 is extra, 2 the header, 3 blank; then records of 2, 1, 4 and 1 lines.
    want = [("one.csv.gz", n, r[1], r[2]) for n, r in zip((4, 6, 7, 11), RECORDS)]
    want += [("two.csv", 3, "h", "l"), ("two.csv", 4, "", "l only")]
    assert one.count("\n") >= 10 and got == sorted(want)
    again = S.scan_paired_files(spark, [str(tmp_path / "one.csv.gz"), str(tmp_path / "one.csv.gz")], heavy=heavy, light=light)
    assert again.count() == 4
    assert S.scan_paired_files(spark, [str(tmp_path / "nohead.csv")], heavy=heavy, light=light).count() == 0
