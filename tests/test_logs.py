"""Log files: listings, last lines of several, and a tail over growth, cuts and new files."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import logs


def lines(frame):
    return [r.line for r in frame.orderBy("place").collect()]


def test_listing_and_last_lines(spark, tmp_path):
    (tmp_path / "x.log").write_text("".join(f"now {k}\r\n" for k in range(60)))
    (tmp_path / "x.log.1").write_text("".join(f"one {k}\n" for k in range(50)) + "\nhalf")
    (tmp_path / "x.log.3").write_bytes(b"three \xff\n")
    (tmp_path / "x.log.9").write_text("too old\n")
    (tmp_path / "other.log").write_text("no\n")
    (tmp_path / "x.log.2").write_text("")
    got = {r.target: r.size for r in logs.log_files(spark, str(tmp_path), "x.log").collect()}
    assert got.keys() - {"backup:2"} == {"current", "backup:1", "backup:3"} and got["backup:3"] == 8
    one, now = [*(f"one {k}" for k in range(50)), "", "half"], [f"now {k}" for k in range(60)]
    every = lines(logs.last_lines(spark, str(tmp_path), "x.log", most=5000))
    assert every[1:] == one + now and len(every) == 113
    assert lines(logs.last_lines(spark, str(tmp_path), "x.log", most=1)) == (one + now)[-100:]
    assert lines(logs.last_lines(spark, str(tmp_path), "x.log", "current")) == now and lines(logs.last_lines(spark, str(tmp_path), "x.log", "backup:1")) == one
    for target in ("backup:0", "backup:4", "backup:9", "backup:x"):
        assert lines(logs.last_lines(spark, str(tmp_path), "x.log", target)) == []
    with pytest.raises(ValueError, match="no target"):
        logs.last_lines(spark, str(tmp_path), "x.log", "all")


def test_columns(spark):
    rows = spark.createDataFrame([("2024-01-02 03:04:05.678 [INFO] [core::x] it [y] is",), ("2024-01-02 03:04:05 [INFO] [x] no millis",), ("",), (None,)], "v string")
    got = [tuple(r.c) for r in rows.select(logs.log_columns(F.col("v")).alias("c")).collect()]
    assert got[0] == ("2024-01-02 03:04:05.678", "INFO", "core::x", "it [y] is", "2024-01-02 03:04:05.678 [INFO] [core::x] it [y] is")
    assert got[1:3] == [("", "", "", "2024-01-02 03:04:05 [INFO] [x] no millis", "2024-01-02 03:04:05 [INFO] [x] no millis"), ("", "", "", "", "")] and got[3][4] is None


def test_tail(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    a, b = folder / "a.log", folder / "b.log"
    a.write_text("old 1\nold 2\n")
    tail = logs.LogTail(spark, f"file://{tmp_path}/state")
    poll = lambda: sorted((r.path.rsplit("/", 1)[1], r.n, r.kind, r.line) for r in tail.poll(str(folder)).collect())
    assert poll() == []  # from the end on
    with a.open("a") as f:
        f.write("new é\r\n\nhalf")
    b.write_text("unseen\n")
    assert poll() == [("a.log", 1, "append", "new é"), ("a.log", 2, "append", "half")]
    with a.open("a") as f:
        f.write(" rest\n")
    with b.open("a") as f:
        f.write("b 2\n")
    assert poll() == [("a.log", 1, "append", " rest"), ("b.log", 1, "append", "b 2")]
    assert poll() == []
    a.write_text("again\n")
    b.unlink()
    assert poll() == [("a.log", 0, "reset", None), ("a.log", 1, "append", "again")]
    b.write_text("unseen\nb 2\nb 3\n")
    assert logs.LogTail(spark, f"file://{tmp_path}/state").poll(str(folder)).collect()[0].line == "b 3"  # another process goes on
