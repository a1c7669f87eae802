import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from rillgraph.operators import workloads as K
from rillgraph.sources import files
from rillgraph.sources import generators as G


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight long")


def test_archives(spark, tmp_path):
    text = "% head\n1 2\n3 4\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/edges.txt", text)
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("in/edges.txt")
        info.size = len(text)
        t.addfile(info, io.BytesIO(text.encode()))
    for name in ("a.zip", "a.tar.gz"):
        assert rows_of(files.read_archive_lines(spark, str(tmp_path / name), "in/edges.txt")) == [(0, "% head"), (1, "1 2"), (2, "3 4")]


def test_loose_edges(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n% c\n\n5 6 900\n1 2\n3\t4 1.5\nx y\n7 8 2\n9\n1 2 3 4\n")
    assert rows_of(files.read_loose_edges(spark, str(tmp_path / "e.txt"))) == [(1, 2), (1, 2), (7, 8)]


def test_update_graph(spark, tmp_path):
    path = tmp_path / "g.graph"
    path.write_text("# c\n4 2 2\n0 1\n1 2 9\n0 1 0\n2 3 7 1\n")
    n, static, updates = files.read_update_graph(spark, str(path))
    assert n == 4 and rows_of(static) == [(0, 0, 1, 1, 1), (1, 1, 2, 9, 1)] and rows_of(updates) == [(2, 0, 1, 1, -1), (3, 2, 3, 7, 1)]
    path.write_text("4 2 2\n0 1\n1 2 9\n0 1 0\n")
    with pytest.raises(ValueError):
        files.read_update_graph(spark, str(path))
    path.write_text("4 1 0\n0 4\n")
    with pytest.raises(Exception, match="bad record"):
        files.read_update_graph(spark, str(path))[1].collect()


def test_specifications_that_do_not_fit(spark):
    for work in ({0: [0]}, {0: [-1]}, {0: [65536]}, {16: [1]}):
        with pytest.raises(ValueError):
            G.partition_tiles(spark, work)
    with pytest.raises(ValueError):
        G.duplicate_heavy(spark, 6)


def test_dense_updates_skip_live_edges(spark):
    got = G.dense_updates(spark, 5, 9, scattered=False).select("src", "dst").collect()
    assert [tuple(r) for r in got] == [(s, d) for s in range(5) for d in range(5) if s != d and d != (s + 1) % 5][:9]
    seen = []
    for k in range(100):
        seen += [(s, (s + 2 + k * 131) % 5) for s in range(5) if (s + 2 + k * 131) % 5 not in (s, (s + 1) % 5)]
    assert [tuple(r) for r in G.dense_updates(spark, 5, 40, scattered=True).select("src", "dst").collect()] == seen[:40]


def test_batches_are_nested_and_whole(spark):
    e = edges(spark, [(0, d, 1) for d in range(1, 6)])
    got = K.derive_batches(e, edges(spark, [(1, d, 1) for d in range(2, 5)] + [(0, 1, 1)]), [2, 4])
    by = {}
    for size, scenario, s, d, _, _ in got.collect():
        by.setdefault((size, scenario), set()).add((s, d))
    assert set(by) == {(2, "insert"), (2, "delete"), (2, "weight_change"), (2, "mixed"), (4, "delete"), (4, "weight_change"), (4, "mixed")}
    assert by[2, "delete"] < by[4, "delete"] and (0, 1) not in by[2, "insert"] and len(by[4, "mixed"]) == 4
    assert K.derive_batches(e.limit(0), e.limit(0), [2]).count() == 0


def test_small_batches(spark):
    e = edges(spark, [(0, d, d) for d in range(1, 13)] + [(1, 130, 5)])
    got = K.small_batches(e, 200)
    assert rows_of(got.filter("scenario = 'insert'").select("dst", "weight")) == [(128 + k, 1 + k * 7 % 31) for k in range(8)]
    assert rows_of(got.filter("scenario = 'delete'").select("dst")) == [(d,) for d in range(1, 9)]
    changed = rows_of(got.filter("scenario = 'weight_change' and diff = 1").select("dst", "weight"))
    assert changed == [(2, 1), (3, 1), (4, 2), (5, 2), (9, 26), (10, 27), (11, 28), (12, 29)]


def test_bridges_skip_linked_components(spark):
    labels = spark.createDataFrame([(0,), (0,), (3,), (5,), (5,), (7,), (7,)], "label long")
    got = K.bridges(labels, edges(spark, [(5, 0, 1)]), 2).select("src", "dst")
    assert rows_of(got) == [(0, 3), (0, 7), (3, 0), (7, 0)]


def test_failed_checks_and_pairs(spark):
    row = spark.range(1).select(K.failed(a=F.lit(True), b=F.lit(False), c=F.lit(None).cast("boolean")).alias("x")).first()
    assert row["x"] == ["b", "c"]
    rows = spark.createDataFrame([(1, "p", 6.0), (1, "q", 2.0), (1, "r", 3.0), (2, "p", 1.0), (2, "q", 1.0), (3, "q", 1.0), (3, "r", 1.0)], "g long, s string, v double")
    assert rows_of(K.paired_with(rows, "g", "s", "v", "p", ["q", "r"])) == [(1, "q", 3.0), (1, "r", 2.0)]


def test_ready_rounds(spark):
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job string")
    needs = lambda *rows: spark.createDataFrame(list(rows), "job string, needed string")
    assert rows_of(K.ready_rounds(jobs, needs(("b", "a"), ("c", "a"), ("c", "b")))) == [("a", 0), ("b", 1), ("c", 2)]
    for bad in [("a", "a")], [("a", "z")], [("a", "b"), ("b", "a")]:
        with pytest.raises(ValueError):
            K.ready_rounds(jobs, needs(*bad))
