from __future__ import annotations

import hashlib
import io
import json
import os
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keelson.sources import archives, committed
from keelson.sources.documents import register


@pytest.fixture(scope="module")
def spark_with_formats(spark):
    register(spark)
    return spark


def files_below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def test_a_large_matrix_is_read_by_several_tasks(spark_with_formats, tmp_path):
    spark = spark_with_formats
    x = np.arange(1_000_000 * 4, dtype=np.float32).reshape(-1, 4)
    np.save(tmp_path / "x.npy", x)
    df = spark.read.format("npy").option("partitionBytes", 1_500_000).load(str(tmp_path / "x.npy"))
    assert df.rdd.getNumPartitions() == 11
    got = df.agg(F.count(F.lit(1)), F.sum("row"), F.sum(F.col("vec")[3]), F.min(F.size("vec")), F.countDistinct("row")).first()
    assert tuple(got) == (1_000_000, sum(range(1_000_000)), float(x[:, 3].astype(float).sum()), 4, 1_000_000)
    assert list(df.where("row = 777777").first()["vec"]) == x[777_777].tolist()


def test_matrices_that_are_no_matrices(spark_with_formats, tmp_path):
    spark = spark_with_formats
    read = lambda: spark.read.format("npy").load(str(tmp_path / "a.npy")).collect()
    np.save(tmp_path / "a.npy", np.array([{"a": 1}, 2], dtype=object), allow_pickle=True)
    with pytest.raises(PySparkException, match="pickled"):
        read()
    np.save(tmp_path / "a.npy", np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(PySparkException, match="by rows"):
        read()
    np.save(tmp_path / "a.npy", np.arange(5, dtype=np.int16))
    assert [(r["row"], r["vec"]) for r in read()] == [(i, [float(i)]) for i in range(5)]
    np.save(tmp_path / "a.npy", np.zeros((0, 3)))
    assert read() == []
    raw = io.BytesIO()
    np.save(raw, np.ones((100, 3)))
    (tmp_path / "a.npy").write_bytes(raw.getvalue()[:-8])
    with pytest.raises(PySparkException, match="ends early"):
        read()


def test_matrix_sink_publishes_all_or_nothing(spark_with_formats, tmp_path):
    spark, path = spark_with_formats, str(tmp_path / "m")
    rows = spark.range(0, 1000, 1, 4).select(F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("vec"))
    rows.write.format("npy").mode("append").option("rowsPerFile", 100).save(path)
    names = files_below(path)
    told = committed.read_manifest(path)
    assert len(told) == 12 and names == sorted(["_manifest.json", *(w.name for w in told)]) and sum(w.rows for w in told) == 1000
    for w in told:
        raw = open(os.path.join(path, w.name), "rb").read()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (w.bytes, w.sha256) and np.load(io.BytesIO(raw)).dtype == np.float32
    assert sorted(r["vec"][0] for r in spark.read.format("npy").load(path).collect()) == list(map(float, range(1000)))
    assert committed.manifest(spark, path).count() == 12
    # one task of four fails: nothing of the job is left, and what was published before stands
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 39, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).cast("array<float>").alias("vec"))
    with pytest.raises(PySparkException, match="as many numbers"):
        bad.write.format("npy").mode("append").save(path)
    assert files_below(path) == names and not os.path.exists(os.path.join(path, "_temporary"))
    # a file that no manifest names isn't read
    np.save(os.path.join(path, "stray.npy"), np.ones((5, 2)))
    rows.limit(10).write.format("npy").mode("append").save(path)
    assert spark.read.format("npy").load(path).count() == 1010
    rows.limit(3).write.format("npy").mode("overwrite").save(path)
    assert spark.read.format("npy").load(path).count() == 3 and len(files_below(path)) == 1 + len(committed.read_manifest(path)) + 1


def test_npz_both_ways(spark_with_formats, tmp_path):
    spark = spark_with_formats
    arrays = {"a": np.arange(12.0).reshape(4, 3), "b": np.arange(7.0)}
    np.savez(tmp_path / "plain.npz", **arrays)
    np.savez_compressed(tmp_path / "packed.npz", **arrays)
    for name in ("plain", "packed"):
        df = spark.read.format("npz").option("partitionBytes", 24).load(str(tmp_path / f"{name}.npz"))
        got = {(r["array"], r["row"]): r["vec"] for r in df.collect()}
        assert got == {(k, i): np.atleast_1d(v).tolist() for k, x in arrays.items() for i, v in enumerate(x)}
        assert df.rdd.getNumPartitions() == {"plain": 4 + 3, "packed": 2}[name]
    rows = [(k, list(x.shape), x.ravel().tolist()) for k, x in arrays.items()]
    table = spark.createDataFrame(rows, "name string, shape array<long>, values array<double>").coalesce(1)
    table.write.format("npz").mode("append").save(str(tmp_path / "out"))
    with np.load(tmp_path / "out" / committed.read_manifest(str(tmp_path / "out"))[0].name) as held:
        assert {k: held[k].tolist() for k in held.files} == {k: x.tolist() for k, x in arrays.items()}
    for bad in ([("a", [2], [1.0])], [("a", [1], [1.0])] * 2):
        with pytest.raises(PySparkException, match="shape|two arrays"):
            spark.createDataFrame(bad, table.schema).coalesce(1).write.format("npz").mode("append").save(str(tmp_path / "bad"))
    assert files_below(tmp_path / "bad") == []


def test_json_documents_are_published_whole(spark_with_formats, tmp_path):
    spark, path = spark_with_formats, str(tmp_path / "d")
    write = lambda rows: spark.createDataFrame(rows, "name string, json string").write.format("json_documents").mode("append").save(path)
    write([("a", '{"b": [1, 2.5, "é"], "a": null}'), ("b", "[]")])
    assert json.load(open(f"{path}/a.json")) == {"a": None, "b": [1, 2.5, "é"]}
    before = files_below(path)
    for bad in ('{"x": NaN}', '{"x": 1e999}', "{", '{"x": -Infinity}'):
        with pytest.raises(PySparkException):
            write([("c", "{}"), ("d", bad)])
    for name in ("../e", "x/y", "_manifest", "a"):
        with pytest.raises(PySparkException, match="unsafe|two files"):
            write([(name, "{}")])
    assert files_below(path) == before


def packed(path, contents, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for k, v in contents.items():
            z.writestr(k, v)


def contents(rng, n):
    return {f"d{i % 7}/m{i}.txt": bytes(rng.integers(0, 256 if i % 2 else 4, int(rng.integers(0, 30_000)), dtype=np.uint8)) for i in range(n)}


def digests(held, path):
    return sorted((path, k, len(v), hashlib.sha256(v).hexdigest()) for k, v in held.items())


def test_members_of_archives(spark_with_formats, tmp_path):
    spark, rng = spark_with_formats, np.random.default_rng(4)
    held = {"a.zip": contents(rng, 300), "b.zip": contents(rng, 20), "c.tar": contents(rng, 150), "d.tar.gz": contents(rng, 30), "e.zip": {}}
    packed(tmp_path / "a.zip", held["a.zip"] | {"folder/": b""})
    packed(tmp_path / "b.zip", held["b.zip"], zipfile.ZIP_STORED)
    packed(tmp_path / "e.zip", {})
    held["c.tar"]["x/" + "long" * 60 + "é.txt"] = b"pax"
    for name, mode in (("c.tar", "w"), ("d.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode, format=tarfile.PAX_FORMAT) as t:
            for k, v in held[name].items():
                (item := tarfile.TarInfo(k)).size = len(v)
                t.addfile(item, io.BytesIO(v))
    df = archives.members(spark, str(tmp_path), partitionBytes=400_000)
    want = sorted(x for name, c in held.items() for x in digests(c, str(tmp_path / name)))
    assert sorted(map(tuple, df.collect())) == want
    reader = archives.ArchiveReader({"path": str(tmp_path), "partitionBytes": 400_000}, False)
    kinds = [p.kind for p in reader.partitions()]
    assert kinds.count("zip") > 5 and kinds.count("tar") > 3 and kinds.count("stream") == 1
    assert archives.members(spark, str(tmp_path / "c.tar"), suffix="m3.txt").count() == 1
    blocks = spark.read.format("archive_blocks").option("blockBytes", 1000).load(str(tmp_path / "a.zip")).collect()
    found: dict = {}
    for r in sorted(blocks, key=lambda r: r["at"]):
        assert len(r["content"]) <= 1000
        found[r["member"]] = found.get(r["member"], b"") + bytes(r["content"])
    assert found == held["a.zip"]


def test_large_archives_by_their_records(tmp_path, monkeypatch):
    # an archive made as a large one: limits lowered, so that records of 64 bits are written
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    held = {f"m{i}": b"x" * (50 + 100 * i) for i in range(9)}
    packed(tmp_path / "z.zip", held, zipfile.ZIP_STORED)
    r = archives.ArchiveReader({"path": str(tmp_path / "z.zip"), "partitionBytes": 5_000}, False)
    parts = r.partitions()
    assert len(parts) > 2 and sorted(x for p in parts for x in r.read(p)) == digests(held, str(tmp_path / "z.zip"))


def test_unsafe_and_broken_archives(spark_with_formats, tmp_path):
    spark = spark_with_formats
    path = str(tmp_path / "a.zip")

    def fails(match, where=path):
        with pytest.raises(PySparkException, match=match):
            archives.members(spark, where).collect()

    for name in ("../a", "/a", "x/../../a", "c:\\a", "..\\a"):
        packed(path, {"ok": b"1", name: b"2"})
        fails("unsafe")
    link = zipfile.ZipInfo("l")
    link.create_system, link.external_attr = 3, 0o120777 << 16
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(link, "/etc/passwd")
    fails("unsafe")
    packed(path, {"a": b"hello world" * 100}, zipfile.ZIP_STORED)
    raw = bytearray(open(path, "rb").read())
    raw[60] ^= 1
    open(path, "wb").write(raw)
    fails("other content")
    packed(path, {"a": b"1"})
    with pytest.warns(UserWarning), zipfile.ZipFile(path, "a") as z:
        z.writestr("a", b"2")
    fails("two members")
    packed(path, {"a": b"1"}, zipfile.ZIP_BZIP2)
    fails("unknown way")
    open(path, "wb").write(b"PK nothing")
    fails("not a ZIP")
    for kind in (tarfile.SYMTYPE, tarfile.LNKTYPE, tarfile.CHRTYPE):
        with tarfile.open(tmp_path / "t.tar", "w") as t:
            item = tarfile.TarInfo("l")
            item.type, item.linkname = kind, "x"
            t.addfile(item)
        fails("unsafe", str(tmp_path / "t.tar"))


def test_zip_sink(spark_with_formats, tmp_path):
    spark, path = spark_with_formats, str(tmp_path / "z")
    held = contents(np.random.default_rng(8), 60) | {"empty": b""}
    df = spark.createDataFrame([(k, v or None) for k, v in held.items()], "member string, content binary").repartition(3)
    df.write.format("zip").mode("append").option("archiveBytes", 100_000).save(path)
    assert len(committed.read_manifest(path)) > 3
    assert sorted(r[1:] for r in map(tuple, archives.members(spark, path).collect())) == sorted(x[1:] for x in digests(held, ""))
    with pytest.raises(PySparkException, match="unsafe"):
        spark.createDataFrame([("../x", b"1")], df.schema).write.format("zip").mode("append").save(path)
