"""PLY files in many splits give what a plain reader gives."""

import random

import pytest

from siftwell.sources import catalog as C
from siftwell.sources.files import ply_header, read_ply


def write(path, points, names, before=0, after=0, end="\n"):
    head = ["ply", "format ascii 1.0", "comment made here", *([f"element camera {before}", "property float f"] if before else []), f"element vertex {len(points)}", *(f"property float {n}" for n in names), *([f"element face {after}", "property list uchar int vertex_indices"] if after else []), "end_header"]
    body = [*("0.5" for _ in range(before)), *(" ".join(map(repr, p)) for p in points), *("3 0 1 2" for _ in range(after))]
    path.write_bytes(end.join([*head, *body, ""]).encode())


@pytest.mark.parametrize("split", ["1k", "64m"])
def test_large_files_come_in_splits(spark, tmp_path, split):
    rng = random.Random(6)
    folder = tmp_path / "in" / "a_deep"
    folder.mkdir(parents=True)
    a = [(rng.uniform(-9, 9), float(i), 1e-7 * i) for i in range(2000)]
    b = [(float(i), -float(i)) for i in range(300)]
    write(folder / "a.ply", a, ["x", "y", "z"], before=40, after=500)
    write(tmp_path / "in" / "b.PLY", b, ["y", "x"], end="\r\n")
    write(tmp_path / "in" / "c.ply", [], ["x", "y", "z"])
    (tmp_path / "in" / "other.txt").write_text("not this\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = read_ply(spark, [str(tmp_path / "in")])
        assert split != "1k" or df.rdd.getNumPartitions() > 20
        got = sorted(tuple(r) for r in df.select("file", "y", "x", "z").collect() if r.z is not None)
        assert got == sorted(("a.ply", y, x, z) for x, y, z in a)
        rest = sorted((r.x, r.y) for r in df.where("file = 'b.PLY'").collect())
        assert rest == sorted((x, y) for y, x in b)
        assert df.count() == len(a) + len(b)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    one = C.read(spark, str(folder / "a.ply"))
    assert one.columns == ["file", "x", "y", "z"] and one.count() == len(a)


def test_headers():
    assert ply_header(["ply", "format ascii 1.0", "element face 2", "property list uchar int i", "element vertex 3", "property double q", "end_header"]) == (["q"], 9, 3)
    for bad in (["plx"], [], ["ply", "format binary_little_endian 1.0", "end_header"], ["ply", "element vertex 1"]):
        with pytest.raises(ValueError):
            ply_header(bad)


def test_written_files_replace_the_folder_at_once(spark, tmp_path):
    from siftwell.sources.files import write_ply

    path = tmp_path / "points"
    for n in (300, 20):
        points = spark.range(n).selectExpr("cast(id as double) as x", "-id * 0.5D as y", "cast(id % 7 as int) as class_id").repartition(4)
        write_ply(points, str(path))
        got = sorted((r.x, r.y, r.class_id) for r in read_ply(spark, [str(path)]).collect())
        assert got == [(float(i), -i * 0.5, float(i % 7)) for i in range(n)]
    assert [p.name for p in tmp_path.iterdir() if p.name != "points"] == []
    write_ply(spark.createDataFrame([], "x double, y double"), str(path))
    assert not list(path.glob("*.ply"))
