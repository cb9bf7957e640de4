"""Growing files: nothing lost, nothing twice, whatever is cut where."""

import random

import pytest

from millrace.sources import growing, readers
from millrace.streaming import operators as streaming


def grow(path, data: bytes):
    with open(path, "ab") as f:
        f.write(data)


def test_stream_over_growing_files(spark, tmp_path):
    """Files grow between runs, by pieces that end inside lines and characters; a run may find nothing new."""
    r = random.Random(4)
    whole = {name: "".join(f"{name} {i} é日😀{'x' * r.randint(0, 30)}\n" for i in range(60)).encode() for name in ("a.log", "b.log", "c.log")}
    folder, state = tmp_path / "logs", str(tmp_path / "run")
    folder.mkdir()
    grow(folder / "_hidden", b"no\n")
    at = dict.fromkeys(whole, 0)
    for step in range(6):
        for name in whole:
            to = len(whole[name]) if step == 4 else min(len(whole[name]), at[name] + r.randint(0, 900)) if step < 4 and (name != "c.log" or step > 1) else at[name]
            grow(folder / name, whole[name][at[name] : to])
            at[name] = to
        got = streaming.run_resumed(growing.growing_lines(spark, str(folder), range_bytes=137), state).collect()
        want = [(n, whole[n][: at[n]][: whole[n][: at[n]].rfind(b"\n") + 1]) for n in whole]
        assert sorted((x["path"].rsplit("/", 1)[1], x["begin"], x["value"]) for x in got) == sorted(
            (n, sum(map(len, lines[:k])) + k, line.decode()) for n, text in want for lines in [text.split(b"\n")[:-1]] for k, line in enumerate(lines)
        )


def test_line_appended_while_a_batch_runs(spark, tmp_path):
    """The bounds of a batch are fixed before its lines are read."""
    path = tmp_path / "log"
    grow(path, b"a\nb\nhal")
    reader = growing.GrowingStream({"path": str(path)})
    first = reader.latestOffset()
    grow(path, b"f\nc\n")
    rows = lambda start, end: [v for p in reader.partitions(start, end) for b in reader.read(p) for v in b.column("value").to_pylist()]
    assert rows({}, first) == ["a", "b"]
    assert rows(first, reader.latestOffset()) == ["half", "c"]
    path.write_bytes(b"a\n")
    with pytest.raises(ValueError, match="shorter"):
        reader.latestOffset()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_ranges_give_each_line_once(tmp_path, size):
    text = b"one\n\ntwo three\nx\n\n\nfour\nlast is cut"
    (tmp_path / "f").write_bytes(text)
    table = growing.GrowingTable({"path": str(tmp_path / "f"), "rangebytes": str(size)})
    got = [(b, v) for p in table.partitions() for batch in table.read(p) for b, v in zip(batch.column("begin").to_pylist(), batch.column("value").to_pylist(), strict=True)]
    assert [v for _, v in got] == ["one", "", "two three", "x", "", "", "four"] and [b for b, _ in got] == [0, 4, 5, 15, 17, 18, 19]


def test_lines_longer_than_a_block(tmp_path):
    long = b"y" * (3 * growing.BLOCK + 5)
    (tmp_path / "f").write_bytes(long + b"\nz\n" + long)
    table = growing.GrowingTable({"path": str(tmp_path / "f"), "rangebytes": "1000000"})
    assert [len(v) for p in table.partitions() for b in table.read(p) for v in b.column("value").to_pylist()] == [len(long), 1]


def test_table_of_lines(spark, tmp_path):
    assert growing.lines_now(spark, str(tmp_path)).count() == 0
    grow(tmp_path / "a", "é\n日".encode()[:-1])
    assert [r["value"] for r in growing.lines_now(spark, str(tmp_path)).collect()] == ["é"]
    grow(tmp_path / "b", b"\xff\n")
    with pytest.raises(Exception, match="(?i)utf-?8"):
        growing.lines_now(spark, str(tmp_path)).collect()


def test_complete_lines(spark, tmp_path):
    """The batch reader: a tail inside a character, no line at all, and files of many blocks."""
    lines = [f"{i} é日😀" for i in range(300)]
    grow(tmp_path / "cut", "\n".join(lines).encode()[:-1])
    grow(tmp_path / "none", b"abc")
    grow(tmp_path / "done", b"x\n\ny\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = {}
        for r in readers.complete_lines(spark, str(tmp_path)).orderBy("path", "line").collect():
            got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["line"], r["value"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {"cut": list(enumerate(lines[:-1])), "done": [(0, "x"), (2, "y")]}
