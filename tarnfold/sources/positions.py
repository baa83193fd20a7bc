"""A JSON source with positions: byte-range splits, errors that name `path:line`, and each file's layout found from its own head.

A file holds JSON lines, one JSON array, or one object over several lines. Files of lines are read in splits; a split begins at the first line that
starts within its bytes. Clean blocks are parsed by Arrow; a block that Arrow refuses is parsed line by line, and only when a line is
really bad are the line ends before it counted, in the part of that file before the split. Arrays and objects over several lines have no
place to be cut, so their file is one split, decoded an element at a time.

Blank lines are skipped. A bad row is one that isn't an object, or whose value doesn't fit its field's type; missing fields are null.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
import pyarrow.json as pj
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

SPLIT, CHUNK, ROWS = 1 << 26, 1 << 22, 10_000
SPACE = b" \t\r\n"


class BadRow(ValueError):
    """A row that doesn't fit, at path:line."""


class Split(InputPartition):
    def __init__(self, path: str, start: int, stop: int, size: int) -> None:
        self.path, self.start, self.stop, self.size = path, start, stop, size


class Place(NamedTuple):
    file: pyarrow.fs.FileInfo
    fs: pyarrow.fs.FileSystem


def readable(path: str) -> bool:
    """Whether this source can open the path's kind of store."""
    try:
        pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return False
    return True


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def list_files(path: str) -> list[tuple[str, int]]:
    """(path within its store, bytes) of the data files at or under a path."""
    fs, inner = _open(path)
    info = fs.get_file_info(inner)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True))
    hidden = lambda p: any(x[:1] in ("_", ".") for x in p[len(inner) :].split("/") if x)
    return sorted((f.path, f.size) for f in found if f.is_file and f.size and not hidden(f.path))


class Lines:
    """Whole lines of a byte range, in blocks; each block with the number of lines before it in this range."""

    def __init__(self, file: pa.NativeFile, start: int, stop: int) -> None:
        self.file, self.start, self.stop = file, start, stop

    def blocks(self) -> Iterator[tuple[bytes, int]]:
        at, rest, before = self.start, b"", 0
        skipping = self.start > 0
        if skipping:  # a line belongs to the range that its first byte is in
            at -= 1
        self.file.seek(at)
        while True:
            data = self.file.read(CHUNK)
            if not data:
                break
            if skipping:
                end = data.find(b"\n")
                if end < 0:
                    at += len(data)
                    if at >= self.stop:
                        return
                    continue
                at, data, skipping = at + end + 1, data[end + 1 :], False
                if at >= self.stop:
                    return
            held = rest + data
            first = at - len(rest)  # place of held[0]
            at += len(data)
            over = self.stop - 1 - first  # the last byte that may begin a line
            if over < len(held):
                end = held.find(b"\n", max(0, over))
                if end >= 0:
                    yield held[: end + 1], before
                    return
            cut = held.rfind(b"\n") + 1
            if cut:
                yield held[:cut], before
                before += held.count(b"\n", 0, cut)
            rest = held[cut:]
        if rest and not skipping:
            yield rest, before


class Rows:
    """Texts to Arrow rows of a schema."""

    def __init__(self, schema: T.StructType) -> None:
        self.schema, self.arrow = schema, to_arrow_schema(schema)
        self.parse = pj.ParseOptions(explicit_schema=self.arrow, unexpected_field_behavior="ignore")

    def fast(self, block: bytes, lines: int) -> pa.Table | None:
        """A clean block of so many lines; None where it needs a closer look."""
        try:
            table = pj.read_json(io.BytesIO(block), parse_options=self.parse, read_options=pj.ReadOptions(block_size=len(block) + 1, use_threads=False))
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            return None
        return table.select(self.arrow.names).cast(self.arrow) if table.num_rows == lines else None

    def fit(self, value: object, kind: T.DataType) -> object:
        """A JSON value as a type's Python value, as the JSON reader of the JVM takes it."""
        if value is None:
            return None
        match kind:
            case T.StringType():
                return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
            case T.BooleanType() if isinstance(value, bool):
                return value
            case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType() if isinstance(value, int) and not isinstance(value, bool):
                return value
            case T.FloatType() | T.DoubleType() if isinstance(value, int | float) and not isinstance(value, bool):
                return float(value)
            case T.ArrayType() if isinstance(value, list):
                return [self.fit(x, kind.elementType) for x in value]
            case T.MapType() if isinstance(value, dict):
                return [(k, self.fit(x, kind.valueType)) for k, x in value.items()]
            case T.StructType() if isinstance(value, dict):
                return {f.name: self.fit(value.get(f.name), f.dataType) for f in kind.fields}
        raise ValueError(f"{type(value).__name__} where {kind.simpleString()} is wanted")

    def row(self, value: object) -> dict:
        if not isinstance(value, dict):
            raise ValueError(f"{type(value).__name__} instead of an object")
        return self.fit(value, self.schema)

    def table(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=self.arrow)


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.rows_schema, self.path, self.split = schema, options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Split]:
        out = [Split(p, at, min(at + self.split, size), size) for p, size in list_files(self.path) for at in range(0, size, self.split)]
        return out or [Split("", 0, 0, 0)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = _open(self.path)
        rows = Rows(self.rows_schema)
        with fs.open_input_file(part.path) as file:
            layout = self._layout(file)
            if layout == "lines":
                yield from self._lines(file, part, rows)
            elif part.start == 0:
                yield from self._whole(file, part, rows, layout)

    @staticmethod
    def _layout(file: pa.NativeFile) -> str:
        """lines, array or object, from the first line that isn't blank: a line that is a whole value of its own begins a file of lines."""
        head, blank = b"", True
        file.seek(0)
        while data := file.read(CHUNK):
            head = (head + data).lstrip(SPACE) if blank else head + data
            blank = not head
            if not blank and b"\n" in head:
                break
        if head[:1] not in (b"[", b"{"):
            return "lines"
        line = head.split(b"\n", 1)[0]
        try:
            json.loads(line)
        except ValueError:
            try:
                json.JSONDecoder().raw_decode(line.decode())
            except json.JSONDecodeError as e:
                # the text ended within a value: it goes on in the next line
                if e.pos >= len(line.decode(errors="replace").rstrip()) - 1 or line.rstrip() in (b"[", b"{"):
                    return "array" if head[:1] == b"[" else "object"
            except ValueError:
                pass
            return "lines"
        return "array" if head[:1] == b"[" else "lines"

    def _lines(self, file: pa.NativeFile, part: Split, rows: Rows) -> Iterator[pa.RecordBatch]:
        for block, before in Lines(file, part.start, part.stop).blocks():
            lines = block.split(b"\n")
            solid = sum(1 for x in lines if x.strip(SPACE))
            if not solid:
                continue
            table = rows.fast(block, solid)
            if table is not None:
                yield from table.to_batches(max_chunksize=ROWS)
                continue
            out = []
            for i, line in enumerate(lines):
                if line.strip(SPACE):
                    try:
                        out.append(rows.row(json.loads(line)))
                    except (ValueError, RecursionError) as e:
                        raise BadRow(f"Malformed line at {part.path}:{self._before(file, part) + before + i + 1}: {e}: {line[:200].decode(errors='replace')}") from None
            for at in range(0, len(out), ROWS):
                yield rows.table(out[at : at + ROWS])

    @staticmethod
    def _before(file: pa.NativeFile, part: Split) -> int:
        """Lines that end before the first line of a split."""
        file.seek(0)
        at, n = 0, 0
        while at < part.start:
            data = file.read(min(CHUNK, part.start - at))
            n += data.count(b"\n")
            at += len(data)
        # the line that a split begins in is an earlier split's, unless it begins there
        file.seek(max(0, part.start - 1))
        return n if part.start == 0 or file.read(1) == b"\n" else n + 1

    def _whole(self, file: pa.NativeFile, part: Split, rows: Rows, layout: str) -> Iterator[pa.RecordBatch]:
        file.seek(0)
        text = file.read().decode()
        decode, out = json.JSONDecoder().raw_decode, []

        def skip(at: int) -> int:
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
            return at

        def fail(at: int, why: object) -> BadRow:
            return BadRow(f"Malformed value at {part.path}:{text.count(chr(10), 0, at) + 1}: {why}")

        at = skip(0) + (layout == "array")
        at = skip(at)
        while layout == "object" or text[at : at + 1] != "]":
            try:
                value, end = decode(text, at)
                out.append(rows.row(value))
            except (ValueError, RecursionError) as e:
                raise fail(getattr(e, "pos", at), e) from None
            at = skip(end)
            if len(out) == ROWS:
                yield rows.table(out)
                out = []
            if layout == "object":
                break
            if text[at : at + 1] == ",":
                at = skip(at + 1)
            elif text[at : at + 1] != "]":
                raise fail(at, "neither comma nor bracket after an element")
        if layout == "array":
            at = skip(at + 1)
        if at < len(text):
            raise fail(at, "text after the value")
        if out:
            yield rows.table(out)


class Positions(DataSource):
    """format("json_positions"): options path and split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "json_positions"

    def schema(self) -> T.StructType:
        raise ValueError("json_positions needs a schema")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, self.options)


def read(spark: SparkSession, path: str, schema: T.StructType, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(Positions)
    return spark.read.format("json_positions").schema(schema).option("split", split).load(path)
