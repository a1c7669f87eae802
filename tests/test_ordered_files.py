"""Text in part files whose order a manifest fixes."""

import hashlib
import json
import os

import pytest

from pyspark.sql import functions as F

from rillgraph.sources import files


def parts(at) -> list[str]:
    return sorted(f for f in os.listdir(at) if f.startswith("part-"))


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_lines_keep_their_order_over_part_files(spark, tmp_path, compression):
    at = str(tmp_path / "log")
    lines = spark.range(3000).selectExpr("id", "if(id % 50 = 7, '# a comment', concat_ws(',', id, id * 7 % 31, 3000 - id)) AS value")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    files.write_ordered(lines.repartition(7, "value"), ["id"], at, compression)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts(at)) > 1
    kept = [k for k in range(3000) if k % 50 != 7]
    assert sorted(tuple(r) for r in files.read_temporal(spark, at, strict=True).collect()) == [(p, k, k * 7 % 31, 3000 - k) for p, k in enumerate(kept)]


def test_a_file_that_is_split_keeps_its_order(spark, tmp_path):
    at = str(tmp_path / "log")
    files.write_ordered(spark.range(20_000).selectExpr("id", "concat_ws(' ', id, id, id) AS value").coalesce(1), ["id"], at)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        found = files.numbered_lines(spark, at)
        assert spark.read.text(at).rdd.getNumPartitions() > 1
        assert [int(r["line"].split()[0]) for r in found.orderBy("pos").collect()] == list(range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_that_are_not_the_manifests_are_refused(spark, tmp_path):
    at = str(tmp_path / "log")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    files.write_ordered(spark.range(100).selectExpr("id", "concat(id, ' 1 1') AS value"), ["id"], at)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    with open(f"{at}/part-99999-more.txt", "w") as f:
        f.write("1 1 1\n")
    with pytest.raises(ValueError, match="not those of the manifest"):
        files.read_temporal(spark, at)
    os.remove(f"{at}/{files.MANIFEST}")
    with pytest.raises(ValueError, match="no order"):
        files.read_temporal(spark, at)


def test_a_slice_of_many_files_is_that_of_one(spark, tmp_path):
    """Metadata first, records in canonical order, the bytes' hash of all files in their order."""
    rows = spark.createDataFrame([(k % 40, k % 7, 1 + k % 5, -1 if k % 3 else 1) for k in range(400)], "src long, dst long, weight int, diff int")
    at = str(tmp_path / "s")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    files.write_slice(rows, at, case="many", vertices=40)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    order = [r["file"] for r in json.load(open(f"{at}/{files.MANIFEST}"))]
    assert len(order) > 1 and set(order) <= set(parts(at))
    raw = b"".join(open(f"{at}/{f}", "rb").read() for f in order)
    text = raw.decode().splitlines()
    want = sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0], r[1], r[3] > 0, r[2]))
    assert text == ["# case=many", "# vertices=40", *(" ".join(map(str, r)) for r in want)]
    r = files.slice_summary(spark, at).first()
    assert (r["case"], r["vertices"], r["records"], r["unique_sources"], r["size_bytes"], r["sha256"]) == ("many", 40, 400, 40, len(raw), hashlib.sha256(raw).hexdigest())
    tree = files.slice_summary(spark, at, whole=False).first()
    assert tree["size_bytes"] == len(raw) and tree["sha256"] == hashlib.sha256(hashlib.sha256("\n".join(text).encode()).hexdigest().encode()).hexdigest() or tree["sha256"] == hashlib.sha256("\n".join(text).encode()).hexdigest()


def test_the_tree_hash_depends_on_lines_and_order_only(spark):
    lines = spark.range(1000).selectExpr("id AS pos", "concat('line ', id) AS line")
    first = files.tree_sha256(lines, 10)
    level = [f"line {k}" for k in range(1000)]
    while len(level) > 1:
        level = [hashlib.sha256("\n".join(level[k : k + 10]).encode()).hexdigest() for k in range(0, len(level), 10)]
    assert first == level[0] == files.tree_sha256(lines.repartition(9), 10)
    assert files.tree_sha256(lines.selectExpr("999 - pos AS pos", "line"), 10) != first
    assert files.tree_sha256(lines.limit(0)) == hashlib.sha256(b"").hexdigest()


def test_an_empty_text(spark, tmp_path):
    at = str(tmp_path / "none")
    files.write_ordered(spark.range(0).selectExpr("id", "'' AS value"), ["id"], at)
    assert files.read_temporal(spark, at).collect() == []


def test_numbering_lines_moves_none_of_them(spark, tmp_path):
    """Only the counts of splits are joined to the lines, by broadcast, however large the text is told to be."""
    at = str(tmp_path / "text")
    files.write_ordered(spark.range(5_000).selectExpr("id", "concat_ws(' ', id, id, id) AS value").repartition(5), ["id"], at)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = files.numbered_lines(spark, at)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == [(i, f"{i} {i} {i}") for i in range(5_000)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_in_their_order_are_hashed_where_they_are_read(spark):
    lines = spark.range(0, 10_000, 1, 3).selectExpr("id AS pos", "concat('line ', id) AS line")
    runs = lines.mapInArrow(files._runs(100), "pos long, first long, text string, h string").collect()
    # 98 whole blocks, and the two that a partition's end cuts in two.
    assert len(runs) == 102 and sum(r["h"] is not None for r in runs) == 98
    whole = hashlib.sha256("\n".join(hashlib.sha256("\n".join(f"line {i}" for i in range(a, a + 100)).encode()).hexdigest() for a in range(0, 10_000, 100)).encode()).hexdigest()
    assert files.tree_sha256(lines, 100) == whole == files.tree_sha256(lines.repartition(5), 100)
    assert files.tree_sha256(lines.limit(3)) == hashlib.sha256(b"line 0\nline 1\nline 2").hexdigest()


def test_numbers_of_every_base_are_read(spark):
    words = ["17", "-17", "+17", "0x1f", "-0X1F", "+0x1F", "0", "1.5", "abc", "", None]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(files._number(F.col("w"))).collect()]
    assert got == [17, -17, 17, 31, -31, 31, 0, None, None, None, None]
