"""FITS binary tables as a data source: `spark.read.format("fits_table")` and `df.write.format("fits_table")`.

Options for reading: `path`, one file or a folder of `.fits` files; `hdu` (default 1); `columns`, a comma-separated list to read;
`rows_per_partition`. The driver lists files and reads the first header; each task reads its file's own header, seeks to its share of the
rows and turns big-endian records into Arrow batches. Comparisons of single numbers with constants are made on the records, before any row
becomes an Arrow value. Paths are local ones or whatever `pyarrow.fs` opens by its scheme (hdfs, s3, gs), and must be open to every executor.

Options for writing: `path`, a folder; `rows_per_file` (default 100,000), which bounds what a task holds. A task writes whole files under
names of their own attempt; the commit removes what the write replaces, and a failed write removes its own files.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

# Fixed values of the format: block and card sizes, and the type letters.
BLOCK = 2880
CARD = 80
LETTERS = {
    "L": ("S1", T.BooleanType()),
    "B": ("u1", T.ShortType()),
    "I": (">i2", T.ShortType()),
    "J": (">i4", T.IntegerType()),
    "K": (">i8", T.LongType()),
    "E": (">f4", T.FloatType()),
    "D": (">f8", T.DoubleType()),
}
BATCH = 65_536
FORMS = {"boolean": "L", "smallint": "I", "int": "J", "bigint": "K", "float": "E", "double": "D", "string": "A"}
COMPARISONS = {ds.EqualTo: np.equal, ds.GreaterThan: np.greater, ds.GreaterThanOrEqual: np.greater_equal, ds.LessThan: np.less, ds.LessThanOrEqual: np.less_equal}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; a path without a scheme is a local one."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def table_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file at a path, or of the `.fits` files of the folder there, by name."""
    path = path.rstrip("/")
    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type != fs.FileType.Directory:
        return [(path, info.size or 0)]
    found = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and f.base_name.endswith(".fits") and not f.base_name.startswith("_")]
    return sorted((path.removesuffix(inner) + f.path, f.size) for f in found)


@dataclass(frozen=True)
class TableLayout:
    """Where the rows of a table lie, and how one row is laid out."""

    start: int
    rows: int
    row_bytes: int
    fields: tuple[tuple[str, str, int, int], ...]  # name, letter, repeat, byte offset


def _cards(handle) -> dict[str, str]:
    found: dict[str, str] = {}
    while True:
        block = handle.read(BLOCK)
        if len(block) < BLOCK:
            raise EOFError("the file ends inside a header")
        for at in range(0, BLOCK, CARD):
            card = block[at:at + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return found
            if card[8:10] == "= ":
                body = card[10:].strip()
                text = re.match(r"'((?:[^']|'')*)'", body)
                found[key] = text.group(1).strip() if text else body.split("/")[0].strip()


def _data_bytes(cards: dict[str, str]) -> int:
    axes = [int(cards[f"NAXIS{i + 1}"]) for i in range(int(cards.get("NAXIS", 0)))]
    if not axes:
        return 0
    size = abs(int(cards["BITPIX"])) // 8 * int(cards.get("GCOUNT", 1)) * (int(cards.get("PCOUNT", 0)) + int(np.prod(axes)))
    return -(-size // BLOCK) * BLOCK


def read_layout(path: str, hdu: int) -> TableLayout:
    system, inner = file_system(path)
    with system.open_input_file(inner) as handle:
        for number in range(hdu + 1):
            cards = _cards(handle)
            if number < hdu:
                handle.seek(_data_bytes(cards), os.SEEK_CUR)
        if cards.get("XTENSION") != "BINTABLE":
            raise ValueError(f"{path}: extension {hdu} is not a binary table")
        fields, offset = [], 0
        for i in range(1, int(cards["TFIELDS"]) + 1):
            form = re.match(r"(\d*)([A-Z])", cards[f"TFORM{i}"])
            repeat, letter = int(form.group(1) or 1), form.group(2)
            if letter != "A" and letter not in LETTERS:
                raise ValueError(f"{path}: column {cards[f'TTYPE{i}']} has unsupported form {cards[f'TFORM{i}']}")
            fields.append((cards[f"TTYPE{i}"], letter, repeat, offset))
            offset += repeat * (1 if letter == "A" else np.dtype(LETTERS[letter][0]).itemsize)
        return TableLayout(handle.tell(), int(cards["NAXIS2"]), int(cards["NAXIS1"]), tuple(fields))


def _chosen(layout: TableLayout, columns: str | None) -> list[tuple[str, str, int, int]]:
    names = [c.strip() for c in columns.split(",")] if columns else [f[0] for f in layout.fields]
    known = {f[0]: f for f in layout.fields}
    absent = [n for n in names if n not in known]
    if absent:
        raise KeyError(f"no columns {absent}; the table has {list(known)}")
    return [known[n] for n in names]


def _spark_type(letter: str, repeat: int) -> T.DataType:
    if letter == "A":
        return T.StringType()
    return LETTERS[letter][1] if repeat == 1 else T.ArrayType(LETTERS[letter][1])


def _arrow(values: np.ndarray, letter: str, repeat: int) -> pa.Array:
    if letter == "A":
        return pa.array(np.char.strip(np.char.decode(values, "ascii", "replace")).tolist(), pa.string())
    if letter == "L":
        flat = pa.array((values == b"T").ravel())
    else:
        kind = np.dtype("i2") if letter == "B" else values.dtype.newbyteorder("=")
        flat = pa.array(np.ascontiguousarray(values.ravel().astype(kind)))
    if repeat == 1:
        return flat
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype="i4") * repeat), flat)


@dataclass
class Share(ds.InputPartition):
    """One of `parts` even shares of a file's rows."""

    path: str
    part: int
    parts: int


class FitsReader(ds.DataSourceReader):
    def __init__(self, path: str, layout: TableLayout, hdu: int, columns: str | None, per_partition: int):
        self.path, self.hdu, self.columns = path, hdu, columns
        self.names = {f[0]: f for f in layout.fields}
        self.head, self.share_bytes = layout.start, max(1, per_partition * layout.row_bytes)
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Take comparisons of a single number with a constant; Spark keeps the others."""
        for f in filters:
            field = self.names.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            single = field is not None and field[1] in "BIJKED" and field[2] == 1
            if single and isinstance(f, ds.IsNotNull):
                continue  # the records hold no NULL
            number = isinstance(getattr(f, "value", None), (int, float)) and not math.isnan(f.value)
            if single and number and type(f) in COMPARISONS:
                self.tests.append((field[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Share]:
        out = []
        for path, size in table_files(self.path):
            parts = max(1, -(-max(0, size - self.head) // self.share_bytes))
            out += [Share(path, i, parts) for i in range(parts)]
        return out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        layout = read_layout(partition.path, self.hdu)
        columns, tested = _chosen(layout, self.columns), {t[0] for t in self.tests}
        held = columns + [f for f in layout.fields if f[0] in tested - {c[0] for c in columns}]
        record = np.dtype({
            "names": [c[0] for c in held], "offsets": [c[3] for c in held], "itemsize": layout.row_bytes,
            "formats": [f"S{r}" if k == "A" else (LETTERS[k][0] if r == 1 else (LETTERS[k][0], (r,))) for _, k, r, _ in held]})
        first, end = (layout.rows * i // partition.parts for i in (partition.part, partition.part + 1))
        system, inner = file_system(partition.path)
        with system.open_input_file(inner) as handle:
            handle.seek(layout.start + first * layout.row_bytes)
            for at in range(first, end, BATCH):
                rows = np.frombuffer(handle.read(min(BATCH, end - at) * layout.row_bytes), record)
                keep = np.ones(len(rows), bool)
                for name, kind, value in self.tests:
                    x = rows[name]
                    with np.errstate(invalid="ignore"):
                        passed = COMPARISONS[kind](x, value)
                    if x.dtype.kind == "f" and kind in (ds.GreaterThan, ds.GreaterThanOrEqual):
                        passed |= np.isnan(x)  # NaN is the largest number in Spark
                    keep &= passed
                rows = rows[keep]
                yield pa.RecordBatch.from_arrays([_arrow(rows[n], k, r) for n, k, r, _ in columns], names=[c[0] for c in columns])


# ---- writing

def _card(key: str, value) -> str:
    text = f"'{value:<8}'" if isinstance(value, str) else ("T" if value is True else str(value))
    return f"{key:<8}= {text:>20}".ljust(CARD)


def _header(cards: list[tuple[str, object]]) -> bytes:
    text = "".join(_card(k, v) for k, v in cards) + "END".ljust(CARD)
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii")


def _records(table: pa.Table, letters: dict[str, str]) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Rows as big-endian records, and each column's form. Missing floats become NaN and missing texts empty; other columns take no NULL."""
    values, forms = {}, []
    for name, letter in letters.items():
        column = table.column(name).combine_chunks()
        if letter == "A":
            raw = np.array([(x or "").encode("ascii") for x in column.to_pylist()], dtype=bytes)
            values[name] = raw.astype(f"S{max(1, raw.dtype.itemsize)}")
            forms.append((name, f"{values[name].dtype.itemsize}A"))
            continue
        if letter not in "ED" and column.null_count:
            raise ValueError(f"column {name} holds NULL, which form {letter} can't express")
        raw = np.asarray(column.to_numpy(zero_copy_only=False))
        values[name] = np.where(raw, b"T", b"F") if letter == "L" else raw.astype(LETTERS[letter][0])
        forms.append((name, f"1{letter}"))
    out = np.zeros(table.num_rows, np.dtype([(n, v.dtype) for n, v in values.items()]))
    for name, v in values.items():
        out[name] = v
    return out, forms


def table_bytes(table: pa.Table, letters: dict[str, str]) -> bytes:
    """A whole file: an empty primary unit and one binary table."""
    rows, forms = _records(table, letters)
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1),
             ("TFIELDS", len(forms))]
    for i, (name, form) in enumerate(forms, 1):
        cards += [(f"TTYPE{i}", name), (f"TFORM{i}", form)]
    body = rows.tobytes()
    return _header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)]) + _header(cards) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


class FitsWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, per_file: int):
        unknown = [f"{f.name} {f.dataType.simpleString()}" for f in schema if f.dataType.simpleString() not in FORMS]
        if unknown:
            raise ValueError(f"no form for columns {unknown}")
        self.path, self.overwrite, self.per_file, self.attempt = path, overwrite, per_file, uuid.uuid4().hex
        self.letters = {f.name: FORMS[f.dataType.simpleString()] for f in schema}
        system, inner = file_system(path)
        system.create_dir(inner)

    def _files(self) -> tuple[fs.FileSystem, list[str]]:
        system, inner = file_system(self.path)
        return system, [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = file_system(self.path)
        held, count, names = [], 0, []

        def flush(rows: pa.Table) -> None:
            # hidden from readers until the commit; a retried task writes new names
            name = f"_{self.attempt}-{uuid.uuid4().hex}.fits"
            with system.open_output_stream(f"{inner}/{name}") as out:
                out.write(table_bytes(rows, self.letters))
            names.append(name)

        for batch in iterator:
            held.append(batch)
            count += batch.num_rows
            while count >= self.per_file:
                table = pa.Table.from_batches(held)
                flush(table.slice(0, self.per_file))
                held = table.slice(self.per_file).to_batches()
                count -= self.per_file
        if count:
            flush(pa.Table.from_batches(held))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        """Show the files of the tasks that count; what is replaced goes first, and what lost attempts left goes last."""
        system, present = self._files()
        inner = file_system(self.path)[1]
        for path in present if self.overwrite else []:
            if not os.path.basename(path).startswith("_"):
                system.delete_file(path)
        for name in (n for m in messages if m is not None for n in m.names):
            system.move(f"{inner}/{name}", f"{inner}/{name[1:]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, present = self._files()
        for path in present:
            if os.path.basename(path).startswith(f"_{self.attempt}-"):
                system.delete_file(path)


class FitsTable(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def _layout(self) -> TableLayout:
        path = self.options["path"]
        files = table_files(path)
        if not files:
            raise FileNotFoundError(f"no .fits files at {path}")
        return read_layout(files[0][0], self._hdu())

    def _hdu(self) -> int:
        return int(self.options.get("hdu", 1))

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, _spark_type(k, r)) for n, k, r, _ in _chosen(self._layout(), self.options.get("columns"))])

    def reader(self, schema: T.StructType) -> FitsReader:
        return FitsReader(self.options["path"], self._layout(), self._hdu(), self.options.get("columns"), int(self.options.get("rows_per_partition", 500_000)))

    def writer(self, schema: T.StructType, overwrite: bool) -> FitsWriter:
        return FitsWriter(self.options["path"], schema, overwrite, int(self.options.get("rows_per_file", 100_000)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsTable)
