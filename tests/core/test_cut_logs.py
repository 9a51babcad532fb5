"""Readers give the same on a file that several tasks read as on a whole one."""

import json
import os

import pytest
from pyspark.sql import functions as F

from metergrid import log_queries
from metergrid.sources import logs

READERS = {
    "claude": (log_queries.claude_lines, logs.claude, logs.CLAUDE),
    "codex": (log_queries.codex_lines, lambda lines: logs.codex(lines)[0], logs.CODEX),
    "pi": (log_queries.pi_lines, logs.pi, logs.PI),
    "muse": (log_queries.muse_lines, logs.muse, None),
}


def _files(lines, folder, ending="\n"):
    """The lines as files of that name, in their order."""
    by_file = {}
    for r in sorted(lines.collect(), key=lambda r: r["line"]):
        by_file.setdefault(r["file"], []).append(r["value"])
    for name, values in by_file.items():
        path = f"{folder}{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write("\n".join(values) + ending)
    return by_file


def _rows(df):
    return sorted(map(repr, df.withColumn("file", F.regexp_extract("file", "[^/]+$", 0)).collect()))


@pytest.mark.parametrize("name", READERS)
def test_readers_on_cut_files(spark, sf_dir, tmp_path, monkeypatch, name):
    make, read, fields = READERS[name]
    written = _files(make(spark, sf_dir), tmp_path)
    size = max(os.path.getsize(f"{tmp_path}{f}") for f in written)
    whole = logs.read_lines(spark, str(tmp_path), fields)
    want = _rows(read(whole))
    assert want
    monkeypatch.setattr(logs, "SEGMENT", 7)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size // 10)
    try:
        cut = logs.read_lines(spark, str(tmp_path), fields)
        assert _rows(read(cut)) == want
        numbers = {(r["file"].split(str(tmp_path))[1], r["line"]) for r in cut.collect()}
        assert numbers == {(f, i + 1) for f, values in written.items() for i in range(len(values))}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_message_texts_are_not_stored(spark, tmp_path):
    secret = "never-in-any-table"
    record = {"type": "assistant", "timestamp": "2026-01-01T00:00:00Z", "ordinal": "x1", "message": {"id": "m", "content": secret, "usage": {"input_tokens": 2}}}
    (tmp_path / "a.jsonl").write_text(json.dumps(record) + f"\n{secret} no json\n" + json.dumps(record | {"ordinal": 7}) + "\n")
    lines = logs.read_lines(spark, str(tmp_path), logs.CLAUDE)
    assert not [r for r in lines.collect() if secret in r["value"]]
    assert [(r["lines"], r["malformed"]) for r in logs.malformed(lines).collect()] == [(3, 1)]
    assert [json.loads(r["value"])["ordinal"] for r in lines.orderBy("line").collect() if r["value"] != logs.MALFORMED] == ["x1", 7]


@pytest.mark.parametrize("part", [1 << 20, 8])
def test_last_lines_and_long_records(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(logs, "MOST_BYTES", 40)
    accents = '{"a":"' + "é" * 16 + '"}'  # 40 bytes, 24 characters
    texts = {"open": '{"a":1}\n{"b"', "whole": '{"a":1}\n{"b":2}', "ended": '{"a":1}\n{"b"\n', "empty": "", "blank": "\n\n  \n", "long": "\n".join([accents, accents.replace("é", "éé"), '{"z":1}']) + "\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.jsonl").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = logs.read_lines(spark, str(tmp_path))
        found = {r["file"].split("/")[-1].split(".")[0]: (r["lines"], r["malformed"]) for r in logs.malformed(lines).collect()}
        assert found == {"open": (1, 0), "whole": (2, 0), "ended": (2, 1), "long": (3, 1)}
        assert sorted(r["line"] for r in lines.where("file LIKE '%/long.jsonl'").collect()) == [1, 2, 3]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_carried_values_equal_a_window_over_the_whole_log(spark, monkeypatch):
    from pyspark.sql import Window

    monkeypatch.setattr(logs, "SEGMENT", 5)
    rows = spark.range(200).selectExpr("concat('f', id % 3) AS file", "id AS line", "if(id % 11 < 2, id, NULL) AS x", "if(id > 90 AND id % 29 = 0, struct(id, 'y' AS y), NULL) AS z")
    for strictly in (False, True):
        over = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
        want = rows.withColumns({c: F.last(c, ignorenulls=True).over(over) for c in ("x", "z")})
        got = logs.carried_over(rows, {"x": F.col("x"), "z": F.col("z")}, ["file"], ["line"], strictly)
        assert sorted(map(repr, got.select(*rows.columns).collect())) == sorted(map(repr, want.collect()))
    numbered = logs.numbered(rows.where("x IS NOT NULL"), ["file"], "line", "n")
    want = rows.where("x IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line")).cast("long"))
    assert sorted(map(repr, numbered.collect())) == sorted(map(repr, want.collect()))
