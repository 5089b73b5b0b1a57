"""NumPy array files as a Spark data source, and outcome matrices kept in them.

`spark.read.format("npy")` gives a row per value: `row`, `column` (0 for vectors) and
`value` (bigint, double or string by the array's type). A partition reads a byte range of
whole rows (whole columns of an array in column order) in steps of 8 MB, so no task holds
a file. Members that a compressed archive deflates have no byte ranges: one task streams
each of them in the same steps. `write_npy` is the inverse: a folder with an array file
per task, listed in a manifest that is written last, so that files of lost tasks don't count.

Headers are checked when the plan is made: wrong marks, object arrays (they would need
unpickling), more than two dimensions, and files shorter or longer than the shape says
raise ValueError. Empty arrays give no rows.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .tables import file_rows

PARTITION_BYTES = 64 << 20
STEP_BYTES = 8 << 20
MANIFEST = "_parts.json"
VECTORS = ("model_id", "family", "owner", "item_group")


def filesystem(path: str) -> tuple[files.FileSystem, str]:
    """File system and path of a local path or URI; file:/x, as Spark writes it, is local too."""
    if path.startswith("file:"):
        return files.LocalFileSystem(), path[5:] if not path.startswith("file://") else path[7:]
    return files.FileSystem.from_uri(path) if "://" in path else (files.LocalFileSystem(), path)


@dataclass
class Layout:
    """Where an array lies: a file, or a member of an archive."""

    path: str
    member: str | None
    deflated: bool
    start: int  # of the values, in the file or, if deflated, in the member
    dtype: str
    shape: tuple[int, int]
    by_column: bool
    first_row: int = 0

    @property
    def lines(self) -> int:
        """Rows, or columns where those are contiguous."""
        return self.shape[1] if self.by_column else self.shape[0]

    @property
    def line_length(self) -> int:
        return self.shape[0] if self.by_column else self.shape[1]

    @property
    def line_bytes(self) -> int:
        return self.line_length * np.dtype(self.dtype).itemsize


def read_header(stream) -> tuple[np.dtype, tuple[int, ...], bool]:
    version = np.lib.format.read_magic(stream)
    if version == (1, 0):
        shape, by_column, dtype = np.lib.format.read_array_header_1_0(stream)
    elif version == (2, 0):
        shape, by_column, dtype = np.lib.format.read_array_header_2_0(stream)
    else:
        raise ValueError(f"array format {version} is not supported")
    if dtype.kind not in "biufUS":
        raise ValueError(f"arrays of {dtype} are not supported")
    if len(shape) not in (1, 2):
        raise ValueError(f"arrays of {len(shape)} dimensions are not supported")
    return dtype, shape, by_column


def check_size(name: str, found: int, start: int, dtype: np.dtype, shape: tuple[int, ...]) -> None:
    wanted = start + int(np.prod(shape, dtype=object)) * dtype.itemsize
    if found != wanted:
        raise ValueError(f"{name} has {found} bytes, but its header asks for {wanted}")


def locate(path: str, member: str | None = None) -> Layout:
    """Layout of one array, from its header alone."""
    system, place = filesystem(path)
    with system.open_input_file(place) as stream:
        size, begin, deflated = stream.size(), 0, False
        if member is None:
            dtype, shape, by_column = read_header(stream)
            start = stream.tell()
            check_size(path, size, start, dtype, shape)
        else:
            with zipfile.ZipFile(stream) as archive:
                if member + ".npy" not in archive.namelist():
                    raise ValueError(f"{path} has no array {member}")
                info = archive.getinfo(member + ".npy")
                with archive.open(info) as inner:
                    dtype, shape, by_column = read_header(inner)
                    start = inner.tell()
                check_size(f"{path}:{member}", info.file_size, start, dtype, shape)
                deflated = info.compress_type != zipfile.ZIP_STORED
            if not deflated:
                # the local header repeats the name and has extra fields of its own length
                stream.seek(info.header_offset + 26)
                lengths = np.frombuffer(stream.read(4), "<u2")
                begin = info.header_offset + 30 + int(lengths.sum())
    flat = (shape[0], 1) if len(shape) == 1 else (shape[0], shape[1])
    return Layout(path, member, deflated, begin + start, dtype.str, flat, by_column and len(shape) == 2)


def layouts(path: str, member: str | None = None) -> list[Layout]:
    """Layouts of a file, or of all the files that the manifest of a written folder lists."""
    system, place = filesystem(path)
    if system.get_file_info(place).type != files.FileType.Directory:
        return [locate(path, member)]
    with system.open_input_stream(f"{place}/{MANIFEST}") as stream:
        parts = json.loads(stream.read())
    out, row = [], 0
    for part in sorted(parts, key=lambda p: p["first"]):
        if part["first"] != row:
            raise ValueError(f"{path} lacks row {row} or has it twice")
        found = locate(f"{path}/{part['file']}")
        found.first_row = row
        if found.shape[0] != part["rows"] or out and found.shape[1] != out[0].shape[1]:
            raise ValueError(f"{part['file']} has another shape than its manifest says")
        row += part["rows"]
        out.append(found)
    return out


@dataclass
class Lines(InputPartition):
    layout: Layout
    first: int
    stop: int


def value_type(dtype: str) -> str:
    return {"b": "bigint", "i": "bigint", "u": "bigint", "f": "double"}.get(np.dtype(dtype).kind, "string")


ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


class NpySource(DataSource):
    """Options: `path`; `member` of an archive; `columns`, positions to keep, joined by commas; `partition_bytes`."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def found(self) -> list[Layout]:
        return layouts(self.options["path"], self.options.get("member"))

    def schema(self) -> str:
        kinds = {value_type(x.dtype) for x in self.found()} or {"bigint"}
        if len(kinds) > 1:
            raise ValueError("the parts have values of several types")
        return f"row bigint, column int, value {kinds.pop()}"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.found(), self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("written arrays are not overwritten")
        return NpyWriter(self.options["path"], self.options.get("dtype", "int8"))


class NpyReader(DataSourceReader):
    def __init__(self, found: list[Layout], options):
        self.found = found
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        columns = options.get("columns")
        self.columns = None if columns is None else sorted({int(c) for c in columns.split(",") if c})
        width = found[0].shape[1] if found else 0
        if self.columns and not 0 <= self.columns[0] <= self.columns[-1] < width:
            raise ValueError(f"columns must lie in 0 to {width - 1}")

    def partitions(self) -> Sequence[Lines]:
        out = []
        for x in self.found:
            step = max(1, x.lines if x.deflated else self.bytes // max(1, x.line_bytes))
            out += [Lines(x, at, min(x.lines, at + step)) for at in range(0, x.lines, step)]
        # a source without partitions would be asked for one of None
        return out or [Lines(Layout("", None, False, 0, "|i1", (0, 0), False), 0, 0)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        x = partition.layout
        if partition.first == partition.stop or not x.line_length:
            return
        system, place = filesystem(x.path)
        with system.open_input_file(place) as stream:
            if x.deflated:
                with zipfile.ZipFile(stream) as archive, archive.open(x.member + ".npy") as inner:
                    inner.read(x.start)
                    yield from self.batches(inner, x, partition)
            else:
                stream.seek(x.start + partition.first * x.line_bytes)
                yield from self.batches(stream, x, partition)

    def batches(self, stream, x: Layout, partition: Lines) -> Iterator[pa.RecordBatch]:
        """A line longer than a step is read in parts; otherwise a step is some whole lines."""
        item = np.dtype(x.dtype).itemsize
        total = (partition.stop - partition.first) * x.line_length
        step = max(1, STEP_BYTES // max(16, item))
        for at in range(0, total, step):
            n = min(step, total - at)
            raw = stream.read(n * item)
            if len(raw) != n * item:
                raise ValueError(f"{x.path} ends before its last value")
            line, place = np.divmod(np.arange(at, at + n, dtype=np.int64), x.line_length)
            row, column = (place, line + partition.first) if x.by_column else (line + partition.first, place)
            values = np.frombuffer(raw, x.dtype)
            if self.columns is not None:
                keep = np.isin(column, self.columns)
                row, column, values = row[keep], column[keep], values[keep]
            kind = value_type(x.dtype)
            if values.dtype.kind == "S":
                values = np.char.decode(values, "utf-8")
            if kind == "bigint":
                if values.dtype.kind == "u" and len(values) and values.max() > np.iinfo(np.int64).max:
                    raise ValueError("values beyond 2^63 are not supported")
                values = values.astype(np.int64)
            elif kind == "double":
                values = values.astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + x.first_row), pa.array(column.astype(np.int32)),
                 pa.array(values.tolist() if kind == "string" else values, ARROW[kind])], ["row", "column", "value"])


@dataclass
class Part(WriterCommitMessage):
    file: str | None
    first: int
    rows: int


class NpyWriter(DataSourceWriter):
    """Rows of (row, values), each task's sorted and without gaps, to one array file per task."""

    def __init__(self, path: str, dtype: str):
        self.path, self.dtype = path, np.dtype(dtype).str

    def write(self, iterator) -> Part:
        system, place = filesystem(self.path)
        system.create_dir(place, recursive=True)
        name, first, rows, width = f"part-{uuid.uuid4().hex}.npy", 0, 0, 0
        # the count of rows is known at the end: values go to a file beside, and the header before them
        body = f"{place}/{name}.values"
        with system.open_output_stream(body) as stream:
            for r in iterator:
                if rows == 0:
                    first, width = r[0], len(r[1])
                if r[0] != first + rows or len(r[1]) != width or None in r[1]:
                    raise ValueError(f"row {r[0]} is out of order, of another length or holds nulls")
                values = np.array(r[1])
                stored = values.astype(self.dtype)
                if not np.array_equal(values, stored, equal_nan=values.dtype.kind == "f"):
                    raise ValueError(f"values of row {r[0]} do not fit {self.dtype}")
                stream.write(stored.tobytes())
                rows += 1
        if rows:
            with system.open_output_stream(f"{place}/{name}") as stream, system.open_input_stream(body) as values:
                np.lib.format.write_array_header_1_0(stream, {"descr": self.dtype, "fortran_order": False, "shape": (rows, width)})
                while chunk := values.read(STEP_BYTES):
                    stream.write(chunk)
        system.delete_file(body)
        return Part(name if rows else None, first, rows)

    def commit(self, messages) -> None:
        system, place = filesystem(self.path)
        parts = [{"file": m.file, "first": m.first, "rows": m.rows} for m in messages if m is not None and m.file]
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/{MANIFEST}") as stream:
            stream.write(json.dumps(parts).encode())

    def abort(self, messages) -> None:
        """Without a manifest the files are not an array."""


def read_npy(spark: SparkSession, path: str, member: str | None = None, columns: Sequence[int] | None = None,
             partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """row, column, value of an array file, an archive's member or a written folder."""
    spark.dataSource.register(NpySource)
    reader = spark.read.format("npy").option("partition_bytes", str(partition_bytes))
    if member is not None:
        reader = reader.option("member", member)
    if columns is not None:
        reader = reader.option("columns", ",".join(map(str, columns)))
    return reader.load(path)


def write_npy(rows: DataFrame, path: str, dtype: str = "int8") -> None:
    """Write (row, values), rows numbered from 0 without gaps, as array files of row ranges."""
    rows.sparkSession.dataSource.register(NpySource)
    ordered = rows.select(F.col("row").cast("bigint").alias("row"), "values").repartitionByRange("row").sortWithinPartitions("row")
    ordered.write.format("npy").mode("append").option("dtype", dtype).save(path)


def load_benchmark(spark: SparkSession, path: str, models: str | None = None, items: str | None = None,
                   partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Cells (item_id, item_group, model_id, family, owner, y) of an archive, or of a matrix with two CSV files.

    The archive holds `responses` and the vectors of `VECTORS`; a matrix (file or written folder) takes model and
    item attributes from CSV files whose rows stand in the order of its columns and rows. Shapes are compared before
    anything is read; what the values must satisfy is the business of `contracts.validate_responses`.
    """
    if path.lower().endswith(".npz"):
        if models is not None or items is not None:
            raise ValueError("an archive brings its own attributes")
        n_items, n_models = locate(path, "responses").shape
        for name in VECTORS:
            length = n_items if name == "item_group" else n_models
            if locate(path, name).shape != (length, 1):
                raise ValueError(f"{name} must be a vector of length {length}")

        def vector(name: str, key: str) -> DataFrame:
            return read_npy(spark, path, name).select(F.col("row").alias(key), F.col("value").cast("string").alias(name))
        about = vector("model_id", "position").join(vector("family", "position"), "position").join(vector("owner", "position"), "position")
        groups = vector("item_group", "item_id")
        cells = read_npy(spark, path, "responses", partition_bytes=partition_bytes)
    else:
        if models is None or items is None:
            raise ValueError("a matrix needs a file of models and one of items")
        parts = layouts(path)
        n_items, n_models = sum(x.shape[0] for x in parts), parts[0].shape[1] if parts else 0
        about = file_rows(spark, models, "position", ("model_id", "family", "owner"))
        groups = file_rows(spark, items, "item_id", ("item_group",))
        for name, df, length in (("models", about, n_models), ("items", groups, n_items)):
            if df.count() != length:
                raise ValueError(f"{name} must have {length} rows")
        cells = read_npy(spark, path, partition_bytes=partition_bytes)
    # a value that is no whole number becomes null, which the contract reports
    whole = F.col("value").try_cast("int")
    y = F.when(F.col("value").try_cast("double") == whole, whole)
    return (cells.select(F.col("row").alias("item_id"), F.col("column").cast("bigint").alias("position"), y.alias("y"))
            .join(about, "position").join(groups, "item_id").select("item_id", "item_group", "model_id", "family", "owner", "y"))
