"""The JSON source: splits, exact positions of bad rows, layouts told apart file by file."""

import json

import pyarrow as pa
import pytest

from tarnfold.sources import files, positions


class Bytes:
    """A file of bytes, for Lines."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        got = self.data[self.at : self.at + n]
        self.at += len(got)
        return got


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("data", [b"", b"a", b"a\n", b"\n\nabc\n\nde\r\n" * 3, b"x" * 50 + b"\n" + b"y" * 30, b"\n" * 9])
def test_every_line_is_in_one_split(monkeypatch, chunk, data):
    monkeypatch.setattr(positions, "CHUNK", chunk)
    for size in (1, 2, 5, 13, 100):
        got = []
        for start in range(0, len(data), size):
            blocks = list(positions.Lines(Bytes(data), start, min(start + size, len(data))).blocks())
            assert [n for _, n in blocks] == [sum(b.count(b"\n") for b, _ in blocks[:i]) for i in range(len(blocks))]
            got += [b for b, _ in blocks]
        assert b"".join(got) == data


def test_a_bad_line_of_a_split_file_is_named_exactly(spark, tmp_path):
    schema = spark.createDataFrame([], "a long, b string").schema
    lines = [json.dumps({"a": i, "b": "x" * (i % 40)}) for i in range(60_000)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n")
    path = f"file://{tmp_path}/big.jsonl"
    t = positions.read(spark, path, schema, split=100_000)
    assert t.rdd.getNumPartitions() > 10
    assert t.count() == 60_000 and t.selectExpr("sum(a)").first()[0] == sum(range(60_000))
    for bad, place in ((7, 8), (41_234, 41_235), (59_999, 60_000)):
        broken = [*lines]
        broken[bad] = '{"a": "no number", "b": 1}'
        (tmp_path / "bad.jsonl").write_text("\n".join(broken))
        with pytest.raises(Exception, match=rf"bad\.jsonl:{place}: str where bigint is wanted"):
            positions.read(spark, f"file://{tmp_path}/bad.jsonl", schema, split=100_000).count()


def test_mixed_folder(spark, tmp_path):
    schema = spark.createDataFrame([], "a long, b struct<c:array<string>>, d string").schema
    rows = [{"a": i, "b": {"c": ["]", "}\n", None]}, "d": "é\u2028"} for i in range(12)]
    (tmp_path / "lines.json").write_text("\n \n" + "\n".join(json.dumps(r) for r in rows[:4]) + "\n\n")
    (tmp_path / "array.json").write_text(json.dumps(rows[4:8]))
    (tmp_path / "pretty.json").write_text("  " + json.dumps(rows[8:9], indent=2, ensure_ascii=False))
    (tmp_path / "object.json").write_text(json.dumps(rows[9], indent=4))
    (tmp_path / "brace.json").write_text("{\n" + json.dumps(rows[10])[1:] + "\n")
    (tmp_path / "one.json").write_text(json.dumps(rows[11]))
    (tmp_path / "_hidden.json").write_text("nonsense")
    (tmp_path / "empty.json").write_text("")
    got = files.read_json_any(spark, f"file://{tmp_path}", schema).collect()
    assert sorted(r.a for r in got) == list(range(12)) and all(r.b.c == ["]", "}\n", None] and r.d == "é\u2028" for r in got)


@pytest.mark.parametrize(
    ("text", "line"),
    [("[{\"a\": 1},\n {\"a\": 2}\n {\"a\": 3}]", 3), ("[\n{\"a\": 1},\n7]", 3), ("{\n\"a\": 1\n}\nmore", 4), ("[\n{\"a\": 1}", 2), ("{\"a\": 1} {\"a\": 2}", 1), ("\n[1, 2]\n{\"a\": 1}", 2), ("{\"a\": 1}\n[{\"a\": 2}]\n", 2), ("x", 1), ("{\"a\": 1.5}", 1), ("{\"a\": true}", 1)],
)
def test_malformed(spark, tmp_path, text, line):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match=rf"x\.json:{line}: "):
        files.read_json_any(spark, f"file://{tmp_path}/x.json", spark.createDataFrame([], "a long").schema).collect()


def test_arrow_and_line_by_line_agree(spark):
    """What Arrow takes at once is what the closer look takes."""
    schema = spark.createDataFrame([], "a long, b double, c string, d array<long>, e boolean, f struct<g:string>").schema
    rows = positions.Rows(schema)
    values = [{"a": 1, "b": 2.5, "c": "x", "d": [1, None], "e": True, "f": {"g": "y", "h": 1}, "z": [{}]}, {}, {"a": None, "b": 3, "d": [], "f": {}}, {"f": None, "c": "\u00e9\\"}]
    block = "\n".join(map(json.dumps, values)).encode()
    fast = rows.fast(block, len(values))
    assert fast is not None
    assert fast.to_pylist() == rows.table([rows.row(v) for v in values]).to_pylist()
    assert rows.fast(b'{"a": 1} {"a": 2}\n', 1) is None or pa.__version__ is None
    assert rows.row({"c": {"k": [1]}})["c"] == '{"k":[1]}'


def test_optional_and_hidden(spark, tmp_path):
    schema = spark.createDataFrame([], "a long").schema
    assert files.read_optional(spark, f"file://{tmp_path}/none", schema).count() == 0
    with pytest.raises(Exception, match="none"):
        files.read_jsonl(spark, f"file://{tmp_path}/none", schema).count()
