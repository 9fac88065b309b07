"""NPZ archives and NPY files as a Spark data source: members are columns, partitions are ranges of rows.

``spark.read.format("arrays").load(path)`` reads the files of a folder, or one file. All members of an archive have
one row each for each of their common first dimension; a further dimension makes a column of arrays. Only the members
that the schema names are opened, so ``.schema("vec_id long")`` reads one member. Stored members are read at their
rows' offset, ``rows`` of them a partition; a compressed archive is one partition, which is read in batches. Files are
opened through pyarrow's file systems, so a path may be local or in a store that these know.

Options: ``rows`` (a partition's, and a written file's, most), ``positions`` (adds the columns _file and _row, by which
arrays are joined with other arrays or with a list of keys), ``compressed`` for writing. What doesn't keep to the rules
stops the job and is named: a file cut short, members of different length, objects, Fortran order, more than two
dimensions, files of different columns; in writing, nulls and arrays of different length.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

ROWS = 1 << 16
_BATCH = 1 << 13
_SUFFIXES = (".npz", ".npy")
_TYPES = {"b1": BooleanType(), "i1": ByteType(), "i2": ShortType(), "i4": IntegerType(), "i8": LongType(), "u1": ShortType(), "u2": IntegerType(), "u4": LongType(), "f2": FloatType(), "f4": FloatType(), "f8": DoubleType()}
_ARROW = {BooleanType: pa.bool_(), ByteType: pa.int8(), ShortType: pa.int16(), IntegerType: pa.int32(), LongType: pa.int64(), FloatType: pa.float32(), DoubleType: pa.float64(), StringType: pa.string(), BinaryType: pa.binary()}


class ArrayFileError(ValueError):
    """A file that doesn't keep to the rules of the source."""


@dataclass(frozen=True)
class Member:
    """Header of one array: where its data begin, if they can be sought, and its form."""

    name: str
    entry: str
    dtype: np.dtype
    shape: tuple[int, ...]
    start: int
    stored: bool

    @property
    def width(self) -> int:
        """Entries of a row."""
        return self.shape[1] if len(self.shape) == 2 else 1

    @property
    def row_bytes(self) -> int:
        return self.width * self.dtype.itemsize


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """Paths, as ``_opened`` takes them, of the array files at or below a path, in order."""
    system, place = _opened(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise ArrayFileError(f"{path}: not found")
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(place, recursive=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(place) :].strip("/").split("/"))
    return sorted(path.rstrip("/") + "/" + x.path[len(place) :].strip("/") for x in found if x.type == fs.FileType.File and x.path.endswith(_SUFFIXES) and not hidden(x.path))


def _array_header(handle) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(handle)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(handle)


def _header(handle, name: str, entry: str, start: int, size: int, stored: bool, path: str) -> Member:
    try:
        shape, fortran, dtype = _array_header(handle)
    except ValueError as e:
        raise ArrayFileError(f"{path}: member {name}: {e}") from e
    if dtype.hasobject:
        raise ArrayFileError(f"{path}: member {name} holds objects")
    if fortran and len(shape) > 1:
        raise ArrayFileError(f"{path}: member {name} is in Fortran order")
    if len(shape) not in (1, 2):
        raise ArrayFileError(f"{path}: member {name} has {len(shape)} dimensions")
    member = Member(name, entry, dtype, shape, start + handle.tell(), stored)
    if handle.tell() + shape[0] * member.row_bytes != size:
        raise ArrayFileError(f"{path}: member {name} has {size - handle.tell()} bytes of {shape[0] * member.row_bytes}")
    return member


def members_of(path: str) -> list[Member]:
    """The headers of a file's arrays; the archive's directory and the lengths are checked, data aren't read."""
    system, place = _opened(path)
    with system.open_input_file(place) as raw:
        if path.endswith(".npy"):
            return [_header(raw, "array", "", 0, raw.size(), True, path)]
        try:
            with zipfile.ZipFile(raw) as archive:
                found = []
                for info in archive.infolist():
                    stored = info.compress_type == zipfile.ZIP_STORED
                    # the local header's name and extra fields may differ in length from the directory's
                    raw.seek(info.header_offset + 26)
                    lengths = np.frombuffer(raw.read(4), "<u2")
                    start = info.header_offset + 30 + int(lengths.sum())
                    with archive.open(info) as handle:
                        found.append(_header(handle, info.filename.removesuffix(".npy"), info.filename, start, info.file_size, stored, path))
        except (zipfile.BadZipFile, EOFError) as e:
            raise ArrayFileError(f"{path}: {e}") from e
    if len({m.shape[0] for m in found}) > 1:
        raise ArrayFileError(f"{path}: members of different length: " + ", ".join(f"{m.name} {m.shape[0]}" for m in found))
    return found


def _spark_type(member: Member) -> DataType:
    if member.dtype.kind in "US":
        own: DataType = StringType() if member.dtype.kind == "U" else BinaryType()
    elif (code := member.dtype.str[1:]) in _TYPES:
        own = _TYPES[code]
    else:
        raise ArrayFileError(f"member {member.name}: no column for {member.dtype}")
    return ArrayType(own, False) if len(member.shape) == 2 else own


def _arrow(kind: DataType) -> pa.DataType:
    return pa.list_(_arrow(kind.elementType)) if isinstance(kind, ArrayType) else _ARROW[type(kind)]


def _column(values: np.ndarray, kind: DataType) -> pa.Array:
    flat = pa.array(values.ravel().astype(values.dtype.newbyteorder("=")), _arrow(kind.elementType if isinstance(kind, ArrayType) else kind))
    if not isinstance(kind, ArrayType):
        return flat
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat).cast(_arrow(kind))


@dataclass
class RowRange(InputPartition):
    path: str
    number: int
    start: int
    end: int


class ArrayReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.rows = schema, options["path"], int(options.get("rows", ROWS))

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for number, path in enumerate(files_of(self.path)):
            members = members_of(path)
            n = members[0].shape[0] if members else 0
            step = self.rows if all(m.stored for m in members) else max(n, 1)
            out += [RowRange(path, number, at, min(at + step, n)) for at in range(0, n, step)]
        return out

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        members = {m.name: m for m in members_of(partition.path)}
        wanted = [f for f in self.schema.fields if f.name not in ("_file", "_row")]
        for f in wanted:
            if f.name not in members:
                raise ArrayFileError(f"{partition.path}: no member {f.name}")
            if _spark_type(members[f.name]) != f.dataType and _arrow(_spark_type(members[f.name])) != _arrow(f.dataType):
                raise ArrayFileError(f"{partition.path}: member {f.name} is {_spark_type(members[f.name]).simpleString()}, not {f.dataType.simpleString()}")
        system, place = _opened(partition.path)
        streams = {}
        archives: list = []
        for f in wanted:
            m = members[f.name]
            raw = system.open_input_file(place)
            if m.stored:
                raw.seek(m.start + partition.start * m.row_bytes)
                streams[f.name] = raw
            else:
                archives.append(zipfile.ZipFile(raw))
                streams[f.name] = archives[-1].open(m.entry)
                _array_header(streams[f.name])
        for at in range(partition.start, partition.end, _BATCH):
            n = min(_BATCH, partition.end - at)
            columns = []
            for f in self.schema.fields:
                if f.name == "_file":
                    columns.append(pa.array([partition.path] * n, pa.string()))
                elif f.name == "_row":
                    columns.append(pa.array(np.arange(at, at + n, dtype=np.int64)))
                else:
                    m = members[f.name]
                    data = streams[f.name].read(n * m.row_bytes)
                    if len(data) != n * m.row_bytes:
                        raise ArrayFileError(f"{partition.path}: member {f.name} ends early")
                    values = np.frombuffer(data, m.dtype)
                    columns.append(_column(values.reshape(n, m.width) if len(m.shape) == 2 else values, f.dataType))
            yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class ArrayWriter(DataSourceArrowWriter):
    """Each task writes archives of ``rows`` rows to a temporary folder, from where the driver moves them in."""

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.schema, self.path, self.overwrite = schema, options["path"].rstrip("/"), overwrite
        self.rows, self.compressed = int(options.get("rows", ROWS)), options.get("compressed", "false") == "true"
        self.temporary = f"{self.path}/_temporary/{uuid.uuid4().hex}"

    def _save(self, table: pa.Table, path: str) -> None:
        members = {}
        for f in self.schema.fields:
            column = table.column(f.name).combine_chunks()
            if column.null_count:
                raise ArrayFileError(f"column {f.name} has nulls")
            if isinstance(f.dataType, ArrayType):
                sizes = np.unique(np.asarray(column.value_lengths()))
                flat = column.flatten()
                if len(sizes) > 1 or flat.null_count:
                    raise ArrayFileError(f"column {f.name} has arrays of different length or with nulls")
                members[f.name] = flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)
            else:
                members[f.name] = np.array(column.to_pylist(), dtype=np.str_) if isinstance(f.dataType, StringType) else column.to_numpy(zero_copy_only=False)
        held = io.BytesIO()
        (np.savez_compressed if self.compressed else np.savez)(held, **members)
        system, place = _opened(path)
        with system.open_output_stream(place) as out:
            out.write(held.getbuffer())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, place = _opened(self.temporary)
        system.create_dir(place, recursive=True)
        task = TaskContext.get()
        held: list[pa.RecordBatch] = []
        files, rows = [], 0

        def flush() -> None:
            name = f"part-{task.partitionId():05d}-{len(files):05d}-{task.taskAttemptId()}.npz"
            self._save(pa.Table.from_batches(held), f"{self.temporary}/{name}")
            files.append(name)
            held.clear()

        for batch in iterator:
            while batch.num_rows:
                room = self.rows - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                rows += held[-1].num_rows
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) >= self.rows:
                    flush()
        if held:
            flush()
        return Written(files, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite:
            for old in files_of(self.path):
                system, place = _opened(old)
                system.delete_file(place)
        for message in messages:
            for name in message.files if message else []:
                system, place = _opened(f"{self.temporary}/{name}")
                system.move(place, _opened(f"{self.path}/{name}")[1])
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for folder in (self.temporary, f"{self.path}/_temporary"):
            system, place = _opened(folder)
            # another write's files may be there too
            if system.get_file_info(place).type == fs.FileType.Directory and (folder == self.temporary or not system.get_file_info(fs.FileSelector(place))):
                system.delete_dir(place)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> StructType:
        files = files_of(self.options["path"])
        if not files:
            raise ArrayFileError(f"{self.options['path']}: no array files")
        fields = [StructField(m.name, _spark_type(m), False) for m in members_of(files[0])]
        if self.options.get("positions", "false") == "true":
            fields += [StructField("_file", StringType(), False), StructField("_row", LongType(), False)]
        return StructType(fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrayWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known; its classes travel by value, so that planning workers needn't have the package."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(ArraySource)
