"""Recordings as Spark tables: the scan, its pushdown, segments and integrity.

One table holds all that a scan yields, a row for each field of each record, in file order
by (path, chain_idx, seq, pos). Rows of kind ``error`` say where a segment's structure
ended; records without fields have one row of kind ``empty``.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from ..errors import RecordingError
from ..functions import low_first
from . import wire

FIELDS = (
    "path string, chain_idx int, seq long, starts_new_chain boolean, mesg_num int, pos int, kind string, fdn int, ddi int, base_type string, "
    "tag string, i long, u decimal(20,0), f double, s string, b binary, ai array<long>, af array<double>, wire binary"
)
NAMES = [c.split()[0] for c in FIELDS.replace("decimal(20,0)", "decimal").split(", ")]


def rows_of(path: str, chain_idx: int, data: bytes, start: int, wanted: frozenset[int] | None = None, corrected: bool = True) -> Iterator[tuple]:
    """The rows of one segment, all numbers as Python's."""
    first = True
    seq = -1
    try:
        for record in wire.scan(data, start, wanted, corrected):
            head = (path, chain_idx, record.seq, first and chain_idx > 0, record.mesg_num)
            first, seq, pos = False, record.seq, 0
            for fdn, base, (tag, i, f, s, b, ai, af), raw in record.fields:
                u = i if tag == "uint" else None
                small = i if i is not None and i < 1 << 63 else None
                if ai is not None and any(x >= 1 << 63 for x in ai):  # 64-bit unsigned arrays beyond the signed range
                    ai, af = None, [float(x) for x in ai]
                yield (*head, pos, "field", fdn, None, base, tag, small, u, f, s, b, ai, af, raw)
                pos += 1
            for fdn, ddi, raw in record.dev_fields:
                yield (*head, pos, "dev", fdn, ddi, None, "bytes", None, None, None, None, raw, None, None, raw)
                pos += 1
            if not pos:
                yield (*head, 0, "empty", *[None] * 12)
    except RecordingError as e:
        yield _error(path, chain_idx, seq + 1, e.code, str(e.detail))


def segments(files: DataFrame) -> DataFrame:
    """Segments of files (path, content): path, chain_idx, segment (its bytes), error.

    Headers are hopped, records not read. Dealing the result out by (path, chain_idx)
    decodes one file's segments in parallel.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                data, starts, error = bytes(data or b""), [], None
                try:
                    starts += (start for _, start, _ in wire.segments(data))
                except RecordingError as e:
                    error = e
                # Each segment travels alone, up to the next segment's start.
                for k, (start, end) in enumerate(zip(starts, [*starts[1:], len(data)], strict=False)):
                    out.append((path, k, data[start:end], None, None))
                if error:
                    out.append((path, len(starts), None, error.code, str(error.detail)))
            yield pd.DataFrame(out, columns=["path", "chain_idx", "segment", "code", "detail"])

    return files.select("path", "content").mapInPandas(split, "path string, chain_idx int, segment binary, code string, detail string")


def dealt(parts: DataFrame, partitions: int | None = None) -> DataFrame:
    """Segments dealt out evenly: decoding costs far more than its bytes suggest, so few bytes should not meet in few tasks."""
    n = partitions or int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "path", "chain_idx")


def decoded(parts: DataFrame, wanted: frozenset[int] | None = None, corrected: bool = True) -> DataFrame:
    """The field table of ``segments``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[tuple] = []
            for path, k, segment, code, detail in zip(*[batch.column(c).to_pylist() for c in ("path", "chain_idx", "segment", "code", "detail")], strict=True):
                if segment is None:
                    kept.append(_error(path, k, 0, code, detail))
                    continue
                for row in rows_of(path, k, segment, 0, wanted, corrected):
                    kept.append(row)
                    if len(kept) >= 20_000:
                        yield _batch(kept)
                        kept = []
            if kept:
                yield _batch(kept)

    return parts.mapInArrow(decode, FIELDS)


def _error(path: str, chain_idx: int, seq: int, code: str, detail: str) -> tuple:
    return (path, chain_idx, seq, False, None, 0, "error", None, None, None, code, None, None, None, detail, None, None, None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _arrow_types(), strict=True)], names=NAMES)


def _arrow_types() -> list[pa.DataType]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "decimal": pa.decimal128(20, 0), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return [kinds[c.split()[1]] for c in FIELDS.replace("decimal(20,0)", "decimal").split(", ")]


def _as_row(row: tuple) -> tuple:
    """A row as Spark takes it from Python: unsigned numbers as decimals."""
    u = NAMES.index("u")
    return row if row[u] is None else (*row[:u], Decimal(row[u]), *row[u + 1 :])


def read_fields(spark: SparkSession, path: str, wanted: frozenset[int] | None = None, corrected: bool = True, partitions: int | None = None) -> DataFrame:
    """The field table of all files under ``path``: segments are dealt out, then decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return decoded(dealt(segments(files), partitions), wanted, corrected)


def is_recording(content: Column) -> Column:
    """Whether bytes look like a recording: sizes and signature, as a predicate for any engine stage."""
    size = F.conv(F.hex(F.substring(content, 1, 1)), 16, 10).cast("int")
    return F.coalesce((F.octet_length(content) >= 12) & size.isin(12, 14) & (F.substring(content, 9, 4) == F.lit(wire.SIGNATURE)) & (F.octet_length(content) >= size + 2), F.lit(False))


def header(content: Column) -> Column:
    """The header's fields as a struct, by byte arithmetic; null where the bytes are none."""
    number = lambda at, n: low_first(F.substring(content, at, n))
    size = number(1, 1)
    body = F.struct(
        size.alias("header_size"), number(2, 1).alias("protocol_version"), number(3, 2).alias("profile_version"), number(5, 4).alias("data_size"),
        F.when(size == 14, number(13, 2)).alias("header_crc"), (size + number(5, 4) + 2).alias("total_size"), (size + number(5, 4)).alias("crc_offset"),
    )
    return F.when(is_recording(content), body)


def integrity(content: Column | str) -> Column:
    """code (null: sound) and checksums of the first segment."""
    return F.pandas_udf(_integrity, "code string, stored long, calculated long")(content)


def _integrity(content: pd.Series) -> pd.DataFrame:
    out = []
    for data in content:
        try:
            wire.check_integrity(bytes(data or b""))
            out.append((None, None, None))
        except RecordingError as e:
            out.append((e.code, *(int(e.detail[k]) if k in e.detail else None for k in ("stored", "calculated"))))
    return pd.DataFrame(out, columns=["code", "stored", "calculated"]).astype({"stored": "Int64", "calculated": "Int64"})


class RecordingSource(DataSource):
    """``spark.read.format("recording").load(path)``: the field table, one partition a segment.

    Options: path (comma-separated files, folders and patterns), messages (numbers, comma-separated), semantics
    ("corrected" or "reference"), mode ("PERMISSIVE": errors are rows; "FAILFAST": they
    raise). Filters on mesg_num reach the scan where the session allows it. Files are
    opened by the executors; for paths that only Spark can open, use ``read_fields``.
    """

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordingReader(self.options)


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", options.get("paths", "")).split(",") if p]
        chosen = options.get("messages", "")
        self.wanted = frozenset(int(x) for x in chosen.split(",")) if chosen else None
        self.corrected = options.get("semantics", "corrected") == "corrected"
        self.failfast = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("mesg_num",):
                only = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted = only if self.wanted is None else self.wanted & only
            yield f  # Spark filters again: error rows have no number

    def files(self) -> list[str]:
        out = []
        for path in (p.removeprefix("file://") for p in self.paths):
            if os.path.isdir(path):
                out += sorted(os.path.join(d, name) for d, _, names in os.walk(path) for name in names if not name.startswith(("_", ".")))
            else:
                out += sorted(glob.glob(path)) or [path]
        return out

    def partitions(self) -> list[InputPartition]:
        """One for each segment of each file; headers are hopped, nothing else is read."""
        return [InputPartition((path, *hop)) for path in self.files() for hop in hops(path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, k, start, stop = partition.value
        with open(path, "rb") as f:
            f.seek(start)
            data = f.read(None if stop is None else stop - start)
        try:
            wire.parse_header(data)
        except RecordingError as e:
            if self.failfast:
                raise
            yield _error(path, k, 0, e.code, str(e.detail))
            return
        for row in rows_of(path, k, data, 0, self.wanted, self.corrected):
            if self.failfast and row[6] == "error":
                raise RecordingError(row[10])
            yield _as_row(row)


def hops(path: str) -> Iterator[tuple[int, int, int | None]]:
    """(chain_idx, start, end) of a file's segments; the end is open where the next header is none or there is no more."""
    size, at, k = os.path.getsize(path), 0, 0
    with open(path, "rb") as f:
        while at < size or not k:
            f.seek(at)
            try:
                stop = at + wire.parse_header(f.read(14)).total_size
            except RecordingError:
                stop = None
            yield k, at, stop if stop is not None and stop < size else None
            if stop is None:
                return
            at, k = stop, k + 1


class SegmentTable:
    """Rows of ``rec_segments(content)``: chain_idx, start, stop, and the error code that ended the hops."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        k = -1
        try:
            for k, start, stop in wire.segments(bytes(content or b"")):
                yield k, start, stop, None
        except RecordingError as e:
            yield k + 1, None, None, e.code


class FieldTable:
    """Rows of ``rec_fields(path, content)``: the field table of one file's bytes."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        data, k = bytes(content or b""), -1
        try:
            for k, start, _ in wire.segments(data):
                yield from map(_as_row, rows_of(path, k, data, start))
        except RecordingError as e:
            yield _error(path, k + 1, 0, e.code, str(e.detail))


def register(spark: SparkSession) -> None:
    """Make the source and the SQL table functions known to a session, and let filters reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)
    spark.udtf.register("rec_segments", F.udtf(SegmentTable, returnType="chain_idx int, start long, stop long, code string"))
    spark.udtf.register("rec_fields", F.udtf(FieldTable, returnType=FIELDS))


def raw_messages(fields: DataFrame) -> DataFrame:
    """The field table by record: one row each, its fields in wire order."""
    item = F.struct("pos", "kind", "fdn", "ddi", "base_type", "tag", "i", "u", "f", "s", "b", "ai", "af")
    grouped = fields.where("kind <> 'error'").groupBy("path", "chain_idx", "seq").agg(
        F.first("mesg_num").alias("mesg_num"), F.first("starts_new_chain").alias("starts_new_chain"),
        F.array_sort(F.collect_list(F.when(F.col("kind") != "empty", item))).alias("fields"),
    )
    return grouped


def errors(fields: DataFrame) -> DataFrame:
    """path, chain_idx, seq, code, detail of what ended segments early."""
    return fields.where("kind = 'error'").select("path", "chain_idx", "seq", F.col("tag").alias("code"), F.col("s").alias("detail"))
