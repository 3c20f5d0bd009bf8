"""Files read by ranges that cut anything: quoted records, charsets, loads that stop and go on, logs and streams of lines."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators.loading import ENTRY
from factloom.sources import files
from factloom.sources.files import Load, TextLines, append_log, listing, parsed_log, read_csv, read_lines

RUSSIAN = "Температура раствора никеля растёт, а плотность падает\nвторая строка отчёта о плавке\n"
GERMAN = "Der Prüfkörper wurde geätzt\nund die Maße überprüft\n"


def lines(spark, root, step):
    return sorted((r["path"].split("/")[-1], r["at"], r["line"]) for r in read_lines(listing(spark, str(root)), step).collect())


@pytest.mark.parametrize("step", [2, 64])
def test_charsets(spark, tmp_path, step):
    texts = {"mark.txt": ("utf-8-sig", RUSSIAN), "plain.txt": ("utf-8", RUSSIAN + "ende ohne Zeilenende"), "win.txt": ("windows-1251", RUSSIAN), "koi.txt": ("koi8-r", RUSSIAN), "dos.txt": ("cp866", RUSSIAN),
             "west.txt": ("windows-1252", GERMAN), "wide.txt": ("utf-16", RUSSIAN), "ends.txt": ("utf-8", "a\r\n\r\nb"), "empty.txt": ("utf-8", "")}
    for name, (charset, text) in texts.items():
        (tmp_path / name).write_bytes(text.encode(charset))
    got = lines(spark, tmp_path, step)
    for name, (_, text) in texts.items():
        assert [x for n, _, x in got if n == name] == [x.removesuffix("\r") for x in text.split("\n")[: None if text and not text.endswith("\n") else -1]], name


@pytest.mark.parametrize("step", [6, 100])
def test_quoted_tables(spark, tmp_path, step):
    rng = random.Random(step)
    want = []
    for n, delimiter in enumerate(files.DELIMITERS):
        rows = [[str(i), "".join(rng.choice(['"', "\n", delimiter, "ä", "x", "\r\n", " "]) for _ in range(rng.randrange(12))), ""] for i in range(40)]
        out = io.StringIO(newline="")
        csv.writer(out, delimiter=delimiter, quoting=csv.QUOTE_ALL, lineterminator="\r\n" if n % 2 else "\n").writerows(rows)
        (tmp_path / f"{n}.csv").write_bytes(out.getvalue().encode("utf-16" if n == 3 else "utf-8"))
        want += [(f"{n}.csv", tuple(r)) for r in rows]
    got = [(r["path"].split("/")[-1], tuple(r["cells"])) for r in read_csv(listing(spark, str(tmp_path)), step).collect()]
    assert sorted(got) == sorted(want)


def test_an_open_quote_fails(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_RECORD", 10)
    with (tmp_path / "x").open("wb+") as f:
        f.write(b'"' + b"a\n" * 20)
    with files.opened(str(tmp_path / "x")) as f, pytest.raises(ValueError, match="quote left open"):
        list(files.records(f, 0, 41, 41, True, False))


def test_load_goes_on(spark, tmp_path):
    root = tmp_path / "tree"
    for at, text in {"a": "1\n2", "b": "3\n"}.items():
        (root / at).mkdir(parents=True)
        (root / at / "f.txt").write_text(text)
    load = Load(spark, str(root), str(tmp_path / "store"))
    assert load.lines().isEmpty() and load.run() == 2 and load.run() == 0
    (root / "a" / "g.txt").write_text("4")
    # a run that stopped between its part and the log
    spark.createDataFrame([("lost", 0, "x", "a")], "path string, at long, line string, source_location string").write.parquet(str(tmp_path / "store/lines/run=1"))
    assert load.lines().count() == 3
    assert load.run() == 1
    got = sorted((r["line"], r["source_location"], r["run"]) for r in load.lines().collect())
    assert got == [("1", "a", 0), ("2", "a", 0), ("3", "b", 0), ("4", "a", 1)]


def test_log(spark, tmp_path):
    at = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a", "x" * 4001), (2, None, "y")], "event_id long, event_type string, props string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    append_log(rows, at)
    append_log(rows.withColumn("event_id", F.col("event_id") + 2), at)
    (tmp_path / "log" / "cut.json").write_text('{"event_id": 9, "ev\n\n{"event_id": "no number"}\n')
    spark.dataSource.register(TextLines)
    got = parsed_log(spark.read.format("text_lines").option("rangeBytes", 50).load(at), ENTRY)
    good = {r["event_id"]: r for r in got.where("corrupt IS NULL").collect()}
    assert set(good) == {1, 2, 3, 4} and good[1]["props"] == "x" * 4000 + "\n… (+1 симв.)" and good[2]["event_type"] is None
    bad = got.where("corrupt IS NOT NULL").collect()
    assert len(bad) == 2 and all(r["event_id"] is None for r in bad)


def test_stream_of_lines(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    spark.dataSource.register(TextLines)

    def drain():
        s = spark.readStream.format("text_lines").option("rangeBytes", 8).load(str(root))
        q = s.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out), format="parquet")
        q.awaitTermination()
        return sorted(r["line"] for r in spark.read.schema("line string").parquet(str(out)).collect())

    (root / "a.log").write_text("one\ntwo and more\nhal")
    assert drain() == ["one", "two and more"]
    with (root / "a.log").open("a") as f:
        f.write("f\nthree\n")
    (root / "b.log").write_text("four\n")
    want = ["four", "half", "one", "three", "two and more"]
    assert drain() == want
    assert drain() == want  # nothing new
