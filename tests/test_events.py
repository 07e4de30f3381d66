"""Event logs and manifests as data sources: ranges, offsets, restarts."""

import json
import random

import pytest

from sparkloom.plans import catalogue
from sparkloom.sources import blocks, events


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    events.register(spark)


def lines_of(folder):
    """Every line of a folder that has its new line, by plain Python."""
    out = []
    for path in sorted(folder.iterdir()):
        at = 0
        for line in path.read_bytes().split(b"\n")[:-1]:
            out.append((path.name, at, line.decode("utf-8", "replace")))
            at += len(line) + 1
    return out


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_ranges_hold_each_line_once(spark, tmp_path, step):
    rng = random.Random(step)
    for name in ("a.log", "b.log", "c.log"):
        body = b"\n".join(rng.choice([b"", b"x", b"data: {}", "äß€".encode(), b"\xff\xfe", b"y" * rng.randrange(40)]) for _ in range(12 if step == 1 else 60))
        (tmp_path / name).write_bytes(body + rng.choice([b"", b"\n", b"\nunfinished"]))
    (tmp_path / "empty.log").touch()
    want = lines_of(tmp_path)
    (tmp_path / "_hidden").write_text("no\n")
    got = spark.read.format("event_lines").option("partitionBytes", step).load(str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_folders_without_files(spark, tmp_path):
    for path in (tmp_path, tmp_path / "none"):
        assert spark.read.format("event_lines").load(str(path)).count() == 0
        assert spark.read.format("file_manifests").load(str(path)).count() == 0


def caught_up(stream, out, checkpoint):
    """One run of a stream over what is there."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.processAllAvailable()
    query.stop()


def test_a_stream_of_lines_starts_again_where_it_was(spark, tmp_path):
    """Lines that grow, a line in two halves, a rolled log and a run without news: each line is there once."""
    folder, out, checkpoint = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()

    def run():
        caught_up(spark.readStream.format("event_lines").option("partitionBytes", 16).load(str(folder)), out, checkpoint)
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    (folder / "1.log").write_text("data: {\"a\": 1}\ndata: {\"a\"")
    assert run() == lines_of(folder) == [("1.log", 0, 'data: {"a": 1}')]
    assert run() == lines_of(folder)
    with (folder / "1.log").open("a") as f:
        f.write(": 2}\n: comment\n")
    assert run() == lines_of(folder) and len(lines_of(folder)) == 3
    with (folder / "1.log").open("a") as f:
        f.write("".join(f'data: {{"a": {k}}}\n' for k in range(3, 9)))
    (folder / "2.log").write_text("un")
    assert run() == lines_of(folder) and len(lines_of(folder)) == 9
    (folder / "2.log").write_text('until now\ndata: {"a": 9}\n')
    got = run()
    assert got == lines_of(folder) and len(got) == 11
    parsed = blocks.server_events(spark.read.parquet(out).select("value"), "a int")
    assert sorted(r["a"] for r in parsed.collect()) == list(range(1, 10))


def test_a_stream_of_manifests(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "manifests", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()

    def run():
        caught_up(spark.readStream.format("file_manifests").load(str(folder)), out, checkpoint)
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    first = {"docs": [{"filename": "f", "sha256": "s", "url": "u"}, {"filename": "g", "size": 3}, "odd"], "version": 1}
    (folder / "1.json").write_text(json.dumps(first))
    want = [("1.json", "f", "s", "u"), ("1.json", "g", None, None)]
    assert run() == want and run() == want
    (folder / "2.json").write_text("{no json")
    (folder / "3.json").write_text('{"docs": {"filename": "x"}}')
    (folder / "4.json").write_text('{"docs": [{"filename": 7, "sha256": "t"}]}')
    want.append(("4.json", "7", "t", None))
    assert run() == want
    assert sorted(tuple(r) for r in spark.read.format("file_manifests").load(str(folder)).collect()) == want


def test_server_events_leave_out_what_is_no_object(spark):
    """Malformed lines go; whole objects stay, whatever their fields."""
    values = ['data: {"a": 1}', "data: {", "data: ", "data:  {\"a\": 2} \r", "event: x", 'data: {"b": 5}', "data: 7", "data: null", "data: [1]", 'data: {"a": 3} x', 'data: {"a": 3}, {}', 'data: {"a": 3}] [', 'data: {"a": 3}} {', 'data: {"b": {"c": [}}', 'data: {"b": 1, "b": 2}', None, "", ' data: {"a": 4}']
    lines = spark.createDataFrame([(v,) for v in values], "value string")
    assert sorted((r["a"] for r in blocks.server_events(lines, "a int").collect()), key=str) == [1, 2, None, None]


def test_event_log_query_reads_the_whole_table(spark, small):
    got = catalogue.queries()["event_log"](spark, small)
    want = spark.read.parquet(f"{small}/events.parquet").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0
