"""Line numbers over splits, and published versions."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.sources import lines, versions


@pytest.mark.parametrize("split", [1, 3, 64, 1 << 20])
def test_lines_have_the_numbers_of_their_file(spark, tmp_path, split):
    r = random.Random(split)
    texts = {"a.log": "one\ntwo\n\n\nlast", "b.log": "\n", "empty.log": "", "sub/c.log": "no end", "_hidden": "x\n", "d.log": "é漢\r\n" * 5}
    texts["e.log"] = "".join(r.choice(["x", "\n", "yy", "\n\n"]) for _ in range(60))
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    got = sorted((x["file"].removeprefix(f"{tmp_path}/"), x["line_no"], x["line"]) for x in lines.numbered_lines(spark, str(tmp_path), split).collect())
    split_up = {n: (t.removesuffix("\n").split("\n") if t else []) for n, t in texts.items() if n != "_hidden"}
    assert got == sorted((n, i + 1, line) for n, ls in split_up.items() for i, line in enumerate(ls))


def test_long_lines_and_buffers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "_READ_BYTES", 7)
    data = b"a" * 50 + b"\n" + b"b\n" * 20 + b"\xff\n" + b"c" * 33
    (tmp_path / "f").write_bytes(data)
    want = data.split(b"\n")
    for split in (1, 2, 10, 49, 50, 51, 52, 1000):
        counts, found = [], []
        for start in range(0, len(data), split):
            part = lines.Range("f", start, min(len(data), start + split), 1)
            with open(tmp_path / "f", "rb") as file:
                counts.append(lines._count(file, part))
                found.append(list(lines._lines(file, part)))
        assert [x for part in found for x in part] == want and counts == [len(x) for x in found]


@pytest.mark.parametrize("split", [5, 40, 10_000])
def test_values_are_carried_over_splits(spark, tmp_path, split):
    text = "x\n@1\na\nb\n" + "c\n" * 30 + "@2\n@3\nd\n" + "e\n" * 10
    (tmp_path / "f.txt").write_text(text)
    read = lines.numbered_lines(spark, str(tmp_path), split)
    given = F.when(F.col("line").startswith("@"), F.substring("line", 2, 9).cast("int"))
    got = {x["line_no"]: x["n"] for x in lines.carried_lines(read, given, "n").collect()}
    want, last = {}, None
    for i, line in enumerate(text.splitlines()):
        last = int(line[1:]) if line.startswith("@") else last
        want[i + 1] = last
    assert got == want


def test_integer_samples(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,h\n1, 2\n3,x\n4,5,6\n 7,8\n")
    (tmp_path / "b.csv").write_text("1,2\nnothing else\n")
    read = lines.numbered_lines(spark, str(tmp_path), 6)
    assert sorted((x["line_no"], x["values"]) for x in lines.integer_samples(read, 2).collect()) == [(2, [1, 2]), (5, [7, 8])]


def test_versions(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(LookupError):
        table.read()
    rows = spark.range(10)
    assert table.publish(rows) == 1 and table.publish(rows.where("id < 3")) == 2
    opened = table.read()
    assert table.restore(1) == 3 and table.read().count() == 10 and opened.count() == 3 and table.read(2).count() == 3
    assert table.manifest(3)["folder"] == table.manifest(1)["folder"] and table.versions() == [1, 2, 3]


def test_a_killed_writer_leaves_nothing_to_be_seen(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    table.publish(spark.range(4))
    with pytest.raises(Exception, match="killed"):
        table.publish(spark.range(100).select(F.when(F.col("id") > 50, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).alias("id")))
    spark.range(7).write.parquet(str(tmp_path / "t/data/written-but-not-committed"))
    assert table.versions() == [1] and table.read().count() == 4 and table.publish(spark.range(2)) == 2


def test_of_two_writers_one_gets_a_conflict(spark, tmp_path):
    one, other = (versions.VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    base = one.publish(spark.range(4))
    assert one.publish(spark.range(5), expected=base) == 2
    with pytest.raises(versions.VersionConflict):
        other.publish(spark.range(6), expected=base)
    with pytest.raises(versions.VersionConflict):
        other.restore(1, expected=base)
    assert other.versions() == [1, 2] and other.read().count() == 5 and other.publish(spark.range(6)) == 3


def test_ranges_are_dealt_over_tasks_that_grow_with_the_bytes(spark, tmp_path):
    """A task was one range, so small ranges of a large folder were as many tasks; now neighbours share one."""
    for k in range(5):
        (tmp_path / f"f{k}").write_text("".join(f"{i} {'x' * (i % 50)}\n" for i in range(2000)))
    read = lines.numbered_lines(spark, str(tmp_path), 100)
    assert read.rdd.getNumPartitions() < 200 < read.select("file", "start").distinct().count()
    assert {(x["f"], x["n"], x["last"]) for x in read.groupBy(F.right("file", F.lit(2)).alias("f")).agg(F.count("*").alias("n"), F.max("line_no").alias("last")).collect()} == {(f"f{k}", 2000, 2000) for k in range(5)}
