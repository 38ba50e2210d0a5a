"""Sparse triplets as a Spark data source: spark.read.format("triplets").load(path), read in byte ranges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, gene_row int, barcode int, value double"
_PACKED = (".gz", ".bz2", ".zst")
_BATCH = 4 << 20


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin in [start, end); a packed file is one piece, of which `skip` bytes come before the body."""

    path: str
    start: int
    end: int
    skip: int
    fields: int


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str) -> tuple[fs.FileSystem, list[str]]:
    system, at = _located(path)
    found = system.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [found] if found.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
    return system, sorted(f.path for f in files if f.is_file and not f.base_name.startswith((".", "_")))


def _body(stream) -> tuple[int, int]:
    """(bytes before the first triplet, fields a line): comment and blank lines and the line of sizes come first, however long they are."""
    buffer, at, fields = b"", 0, 3
    while True:
        cut = buffer.find(b"\n")
        if cut < 0:
            more = stream.read(1 << 16)
            if not more:
                return at + len(buffer), fields
            buffer += more
            continue
        line, buffer, at = buffer[:cut].strip(), buffer[cut + 1 :], at + cut + 1
        if line.startswith(b"%%") and b"pattern" in line.lower():
            fields = 2
        if line and not line.startswith(b"%"):
            return at, fields


class TripletReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("triplets need a path")
        self.path, self.split = options["path"], int(options.get("splitbytes") or options.get("splitBytes") or 64 << 20)

    def partitions(self) -> list[Piece]:
        """Only the head of each file is read here; a file's body is cut each `splitBytes` bytes."""
        system, files = _listed(self.path)
        pieces = []
        for f in files:
            with system.open_input_stream(f) as stream:
                body, fields = _body(stream)
            size = system.get_file_info(f).size
            if f.endswith(_PACKED):
                pieces.append(Piece(f, 0, -1, body, fields))
            else:
                pieces += [Piece(f, s, min(s + self.split, size), 0, fields) for s in range(body, size, self.split)]
        return pieces or [Piece("", 0, 0, 0, 3)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.path:
            system, _ = _located(self.path)
            for lines in _lines(system, piece):
                yield _parsed(lines, piece)


def _lines(system: fs.FileSystem, piece: Piece) -> Iterator[bytes]:
    """Whole lines in batches of about 4 MB. A line belongs to the piece in which it begins."""
    if piece.end < 0:
        with system.open_input_stream(piece.path) as stream:  # unpacked by its suffix
            left = piece.skip
            while left:
                left -= len(stream.read(min(left, _BATCH)))
            rest = b""
            while more := stream.read(_BATCH):
                cut = (rest + more).rfind(b"\n") + 1
                whole, rest = (rest + more)[:cut], (rest + more)[cut:]
                yield whole
            yield rest
        return
    with system.open_input_file(piece.path) as file:
        # from one byte before, so that a line that begins at the start is not taken for the tail of another
        at = piece.start - 1
        file.seek(at)
        rest, first = b"", True
        while at < piece.end:
            more = file.read(min(_BATCH, piece.end - at))
            if not more:
                break
            at += len(more)
            data = rest + more
            if first:
                cut = data.find(b"\n")
                if cut < 0:
                    continue  # within a line of another piece, which is dropped
                data, first = data[cut + 1 :], False
            cut = data.rfind(b"\n") + 1
            yield data[:cut]
            rest = data[cut:]
        if rest:  # the last line goes on behind the piece
            while b"\n" not in rest and (more := file.read(1 << 12)):
                rest += more
            yield rest.split(b"\n", 1)[0]


def _parsed(lines: bytes, piece: Piece) -> pa.RecordBatch:
    if b"%" in lines:
        lines = b"\n".join(x for x in lines.split(b"\n") if not x.lstrip().startswith(b"%"))
    words = lines.split()
    if len(words) % piece.fields:
        raise ValueError(f"{piece.path}: lines that are not of {piece.fields} fields")
    cells = np.asarray(words, dtype=np.float64).reshape(-1, piece.fields)
    value = cells[:, 2] if piece.fields == 3 else np.ones(len(cells))
    columns = [pa.array([piece.path] * len(cells), pa.string()), pa.array(cells[:, 0].astype(np.int32)), pa.array(cells[:, 1].astype(np.int32)), pa.array(value)]
    return pa.RecordBatch.from_arrays(columns, ["file", "gene_row", "barcode", "value"])


class Triplets(DataSource):
    """Options: path (a file, or a folder, of any file system that pyarrow knows) and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "triplets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TripletReader:
        return TripletReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Triplets)


def read_triplets(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """file, gene_row, barcode, value of 1-based triplets; repeated coordinates add up. Files of two fields a line (pattern) have the value 1.

    A file without triplets gives no rows; a line with other fields than the header names is an error.
    """
    register(spark)
    rows = spark.read.format("triplets").option("splitBytes", str(split_bytes)).load(path)
    return rows.groupBy("file", "gene_row", "barcode").agg(F.sum("value").alias("value"))
