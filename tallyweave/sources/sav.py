"""SPSS system files (.sav) as a Spark data source, from the published description of the format.

    spark.dataSource.register(SavDataSource)
    spark.read.format("sav").load(path)

Numbers are doubles (system-missing is null), text is string. The dictionary alone gives the schema, so
metadata costs no data scan; it is read once and goes to the tasks. A path is a file or a folder of files that have one dictionary. Cases of
an uncompressed file have one length: ranges of ``rowsPerPartition`` of them are partitions, read as Arrow batches of the wanted columns
(option ``columns``). Byte-compressed and zlib-compressed files are streams whose cases begin anywhere: a partition each, in batches.

    df.write.format("sav").mode("append").save(folder)

writes an uncompressed file per partition; texts take ``textWidth`` bytes (a longer one is an error).
Paths with a scheme are opened by Arrow's file systems, others as local files.
"""

from __future__ import annotations

import os
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_ROWS, PARTITION_ROWS, TEXT_WIDTH = 10_000, 200_000, 64


@dataclass
class Dictionary:
    n_cases: int = -1
    compression: int = 0
    bias: float = 100.0
    order: str = "<"
    encoding: str = "utf-8"
    #: (short name, width in bytes: 0 for a number, label), a variable each
    variables: list[list] = field(default_factory=list)
    #: cells of 8 bytes per case, and each variable's first cell and number of cells
    cells: int = 0
    slots: list[tuple[int, int]] = field(default_factory=list)
    value_labels: dict[str, dict] = field(default_factory=dict)
    data_at: int = 0

    def names(self) -> list[str]:
        return [v[0] for v in self.variables]


def read_dictionary(f) -> Dictionary:
    """The dictionary at the start of a system file; the file stands at the data afterwards."""
    head = f.read(176)
    if len(head) < 176 or head[:4] not in (b"$FL2", b"$FL3"):
        raise ValueError("not an SPSS system file")
    d = Dictionary()
    d.order = "<" if struct.unpack("<i", head[64:68])[0] in (2, 3) else ">"
    o = d.order
    _, _, d.compression, _, d.n_cases = struct.unpack(o + "5i", head[64:84])
    d.bias = struct.unpack(o + "d", head[84:92])[0]
    if d.compression not in (0, 1, 2):
        raise ValueError(f"unknown compression {d.compression}")
    integer = lambda: struct.unpack(o + "i", f.read(4))[0]
    cell_owner: list[int] = []
    labels: list = []
    pending: dict = {}
    long_names, wide = {}, {}
    while True:
        kind = integer()
        if kind == 2:
            width, has_label, n_missing, _, _ = struct.unpack(o + "5i", f.read(20))
            name = f.read(8)
            label = b""
            if has_label:
                n = integer()
                label = f.read((n + 3) // 4 * 4)[:n]
            f.read(8 * abs(n_missing))
            if width >= 0:
                cell_owner.append(len(d.variables))
                d.slots.append((len(cell_owner) - 1, 1))
                d.variables.append([name, width, label])
            else:  # goes on from the cell before
                cell_owner.append(len(d.variables) - 1)
                at, k = d.slots[-1]
                d.slots[-1] = (at, k + 1)
        elif kind == 3:
            pending = {}
            for _ in range(integer()):
                value = f.read(8)
                n = f.read(1)[0]
                pending[value] = f.read((n + 8) // 8 * 8 - 1)[:n]
        elif kind == 4:
            at = [integer() for _ in range(integer())]
            labels.append(([cell_owner[i - 1] for i in at], pending))
        elif kind == 6:
            f.read(80 * integer())
        elif kind == 7:
            sub, size, count = struct.unpack(o + "3i", f.read(12))
            raw = f.read(size * count)
            if sub == 13:
                long_names = dict(x.split(b"=", 1) for x in raw.split(b"\t") if b"=" in x)
            elif sub == 14:
                wide = {a: int(b.strip(b"\0\t ")) for a, _, b in (x.partition(b"=") for x in raw.split(b"\t")) if a.strip(b"\0")}
            elif sub == 20:
                d.encoding = raw.decode("ascii", "replace").strip() or d.encoding
        elif kind == 999:
            integer()
            break
        else:
            raise ValueError(f"unknown record {kind} in the dictionary")
    d.cells, d.data_at = len(cell_owner), f.tell()
    text = lambda b: b.decode(d.encoding, "replace")
    for owners, table in labels:
        for i in owners:
            short, width, _ = d.variables[i]
            key = (lambda b: text(b).rstrip()) if width else (lambda b: struct.unpack(o + "d", b)[0])
            d.value_labels[i] = {key(k): text(v).rstrip() for k, v in table.items()}  # type: ignore[index]
    # texts of more than 255 bytes are several variables in the dictionary
    variables, slots, by_name, i = [], [], {}, 0
    while i < len(d.variables):
        short, width, label = d.variables[i]
        short = short.strip()
        name = text(long_names.get(short, short)).strip("\0 ")
        parts = -(-wide[short] // 252) if short in wide else 1
        slots.append([d.slots[j] + (d.variables[j][1],) for j in range(i, i + parts)])
        if i in d.value_labels:
            by_name[name] = d.value_labels[i]  # type: ignore[index]
        variables.append([name, wide.get(short, width), text(label)])
        i += parts
    d.variables, d.slots, d.value_labels = variables, slots, by_name
    return d


class Inflated:
    """The data of a zlib-compressed file as a stream: its blocks, found by the index at its end, one at a time."""

    def __init__(self, f, order: str):
        _, index, _ = struct.unpack(order + "3q", f.read(24))
        f.seek(index + 20)
        n = struct.unpack(order + "i", f.read(4))[0]
        self.blocks = [struct.unpack(order + "2q2i", f.read(24)) for _ in range(n)]
        self.f, self.held = f, b""

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self.blocks:
            _, at, _, size = self.blocks.pop(0)
            self.f.seek(at)
            self.held += zlib.decompress(self.f.read(size))
        out, self.held = self.held[:n], self.held[n:]
        return out


def _cells(f, d: Dictionary) -> Iterator[bytes | None]:
    """The 8-byte cells of the data, None for system-missing."""
    if not d.compression:
        while len(raw := f.read(8)) == 8:
            yield raw
        return
    if d.compression == 2:
        f = Inflated(f, d.order)
    while len(codes := f.read(8)) == 8:
        for c in codes:
            if c == 0:
                continue
            if c == 252:
                return
            if c == 253:
                raw = f.read(8)
                if len(raw) < 8:
                    return
                yield raw
            elif c == 254:
                yield b" " * 8
            elif c == 255:
                yield None
            else:
                yield struct.pack(d.order + "d", c - d.bias)


_MISSING = -sys.float_info.max


def read_cases(f, d: Dictionary) -> Iterator[tuple]:
    row: list = []
    for cell in _cells(f, d):
        row.append(cell)
        if len(row) < d.cells:
            continue
        out = []
        for (_, width, _), parts in zip(d.variables, d.slots):
            if not width:
                raw = row[parts[0][0]]
                v = None if raw is None else struct.unpack(d.order + "d", raw)[0]
                out.append(None if v is None or v == _MISSING or v != v else v)
            else:
                raw = b"".join(b"".join(x or b" " * 8 for x in row[a : a + n])[: 255 if len(parts) > 1 else w] for a, n, w in parts)
                out.append(raw[:width].decode(d.encoding, "replace").rstrip())
        yield tuple(out)
        row = []


def table_of(raw: bytes, d: Dictionary, names: list[str]) -> pa.RecordBatch:
    """Uncompressed cases as columns."""
    cells = np.frombuffer(raw, np.uint8).reshape(-1, d.cells * 8)
    out = []
    for name in names:
        k = d.names().index(name)
        width, parts = d.variables[k][1], d.slots[k]
        if not width:
            at = parts[0][0] * 8
            v = np.ascontiguousarray(cells[:, at : at + 8]).view(d.order + "f8").ravel().astype(np.float64)
            out.append(pa.array(v, mask=(v == _MISSING) | np.isnan(v)))
        else:
            text = np.concatenate([cells[:, a * 8 : (a + n) * 8][:, : 255 if len(parts) > 1 else w] for a, n, w in parts], 1)[:, :width]
            rows, size = np.ascontiguousarray(text).tobytes(), text.shape[1]
            out.append(pa.array([rows[i * size : (i + 1) * size].decode(d.encoding, "replace").rstrip() for i in range(len(cells))], pa.string()))
    return pa.RecordBatch.from_arrays(out, names=names)


def opened(path: str):
    """(file to read, its size)."""
    if "://" in path and not path.startswith("file://"):
        where, at = fs.FileSystem.from_uri(path)
        return where.open_input_file(at), where.get_file_info(at).size
    local = path.removeprefix("file://")
    return open(local, "rb"), os.path.getsize(local)


def files_of(path: str) -> list[str]:
    """The files of a folder in order of name, or the file itself."""
    if "://" in path and not path.startswith("file://"):
        where, at = fs.FileSystem.from_uri(path)
        if where.get_file_info(at).type != fs.FileType.Directory:
            return [path]
        prefix = path.rstrip("/").removesuffix(at.rstrip("/"))
        return sorted(prefix + i.path for i in where.get_file_info(fs.FileSelector(at)) if i.is_file and i.base_name.endswith(".sav"))
    local = path.removeprefix("file://")
    if not os.path.isdir(local):
        return [path]
    return sorted(os.path.join(local, n) for n in os.listdir(local) if n.endswith(".sav"))


class SavDataSource(DataSource):
    """``spark.read.format("sav").load(path)``; options ``columns`` (comma-separated), ``rowsPerPartition``, and ``textWidth`` to write."""

    @classmethod
    def name(cls) -> str:
        return "sav"

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("sav: no path given")
        return path

    def schema(self) -> StructType:
        files = files_of(self._path())
        if not files:
            raise ValueError(f"sav: no .sav file in {self._path()}")
        f, _ = opened(files[0])
        with f:
            self.dictionary = d = read_dictionary(f)
        wanted = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else d.names()
        if missing := [c for c in wanted if c not in d.names()]:
            raise ValueError(f"sav: no variable {', '.join(missing)}")
        width = {n: w for n, w, _ in d.variables}
        return StructType([StructField(n, StringType() if width[n] else DoubleType(), True) for n in wanted])

    def reader(self, schema: StructType) -> "SavReader":
        return SavReader(self._path(), schema.names, int(self.options.get("rowsPerPartition", PARTITION_ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> "SavWriter":
        if overwrite:
            raise ValueError("sav: only appending to a folder is supported")
        return SavWriter(self._path(), schema, int(self.options.get("textWidth", TEXT_WIDTH)))


class Rows(InputPartition):
    """Cases ``first`` to ``last`` of a file; all of a stream if ``last`` is None."""

    def __init__(self, path: str, dictionary: Dictionary, first: int = 0, last: int | None = None):
        self.path, self.dictionary, self.first, self.last = path, dictionary, first, last


class SavReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], rows: int):
        self.path, self.columns, self.rows = path, columns, max(1, rows)

    def partitions(self):
        out = []
        for path in files_of(self.path):
            f, size = opened(path)
            with f:
                d = read_dictionary(f)
            if d.compression:
                out.append(Rows(path, d))
            else:
                n = (size - d.data_at) // (8 * d.cells)
                out += [Rows(path, d, k, min(n, k + self.rows)) for k in range(0, n, self.rows)]
        return out or [InputPartition(None)]

    def read(self, partition):
        if not isinstance(partition, Rows):
            return
        d = partition.dictionary
        f, _ = opened(partition.path)
        with f:
            if partition.last is not None:
                f.seek(d.data_at + partition.first * 8 * d.cells)
                for k in range(partition.first, partition.last, BATCH_ROWS):
                    yield table_of(f.read(8 * d.cells * min(BATCH_ROWS, partition.last - k)), d, self.columns)
                return
            f.seek(d.data_at)
            at = [d.names().index(c) for c in self.columns]
            held = []
            for case in read_cases(f, d):
                held.append(case)
                if len(held) == BATCH_ROWS:
                    yield self.batch(held, at, d)
                    held = []
            if held:
                yield self.batch(held, at, d)

    def batch(self, cases: list[tuple], at: list[int], d: Dictionary) -> pa.RecordBatch:
        kinds = [pa.string() if d.variables[k][1] else pa.float64() for k in at]
        return pa.RecordBatch.from_arrays([pa.array([c[k] for c in cases], kind) for k, kind in zip(at, kinds)], names=self.columns)


def header(schema: StructType, width: int) -> bytes:
    """The dictionary of an uncompressed file: numbers, and texts of ``width`` bytes; names of any length."""
    cells = -(-width // 8)
    text = [isinstance(f.dataType, StringType) for f in schema]
    out = [b"$FL2", b"tallyweave".ljust(60), struct.pack("<5i", 2, sum(cells if t else 1 for t in text), 0, 0, -1), struct.pack("<d", 100.0), b"01 Jan 2400:00:00".ljust(81) + b"\0" * 3]
    for k, t in enumerate(text):
        kind = width if t else 0
        form = (1 << 16 | min(width, 255) << 8) if t else (5 << 16 | 12 << 8 | 4)
        out.append(struct.pack("<6i", 2, kind, 0, 0, form, form) + f"V{k}".encode().ljust(8))
        out += [struct.pack("<6i", 2, -1, 0, 0, 0, 0) + b" " * 8] * (cells - 1 if t else 0)
    names = "\t".join(f"V{k}={f.name}" for k, f in enumerate(schema)).encode()
    for sub, raw in ((13, names), (20, b"UTF-8")):
        out.append(struct.pack("<4i", 7, sub, 1, len(raw)) + raw)
    return b"".join([*out, struct.pack("<2i", 999, 0)])


class SavWriter(DataSourceArrowWriter):
    """A file per partition, under a name of its own; a failed job's files go."""

    def __init__(self, path: str, schema: StructType, width: int):
        if not 1 <= width <= 255:
            raise ValueError("sav: textWidth is 1 to 255")
        self.path, self.schema, self.width = path.rstrip("/"), schema, width

    def write(self, iterator) -> WriterCommitMessage:
        path, size = f"{self.path}/part-{uuid.uuid4().hex}.sav", -(-self.width // 8) * 8
        if "://" in path and not path.startswith("file://"):
            where, at = fs.FileSystem.from_uri(path)
            f = where.open_output_stream(at)
        else:
            os.makedirs(os.path.dirname(path.removeprefix("file://")), exist_ok=True)
            f = open(path.removeprefix("file://"), "wb")
        with f:
            f.write(header(self.schema, self.width))
            for b in iterator:
                parts = []
                for field_, column in zip(self.schema, b.columns):
                    if isinstance(field_.dataType, StringType):
                        raw = [(v or "").encode() for v in column.to_pylist()]
                        if any(len(v) > self.width for v in raw):
                            raise ValueError(f"sav: a text of {field_.name} has more than {self.width} bytes")
                        parts.append(np.frombuffer(b"".join(v.ljust(size) for v in raw), np.uint8).reshape(-1, size))
                    else:
                        v = column.cast(pa.float64()).fill_null(_MISSING).to_numpy(zero_copy_only=False).astype("<f8")
                        parts.append(v.view(np.uint8).reshape(-1, 8))
                f.write(np.concatenate(parts, 1).tobytes())
        return Written(path)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                where, at = fs.FileSystem.from_uri(m.path) if "://" in m.path else (fs.LocalFileSystem(), m.path)
                where.delete_file(at)


@dataclass
class Written(WriterCommitMessage):
    path: str


def read_sav(spark, path: str, metadata_only: bool = False):
    """(frame or None, dictionary). A missing file says what is expected."""
    import os

    local = path.removeprefix("file://")
    if not os.path.exists(local):
        from .readers import DataMissing

        raise DataMissing(f"{path} is not there: download the survey's SPSS file and put it at this path")
    with open(local, "rb") as f:
        d = read_dictionary(f)
    if metadata_only:
        return None, d
    from .readers import with_labels

    spark.dataSource.register(SavDataSource)
    df = spark.read.format("sav").load(local)
    return with_labels(df, {n: label for n, _, label in d.variables if label}), d
