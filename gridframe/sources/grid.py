"""The grid source: n-dimensional variables as rows, one for each cell.

Dimensions become key columns, variables value columns.  A cell's row number
follows from its indices in the declared order of dimensions, so a slice of a
scan reads only its range.  A whole scan goes through the file in the order in
which it is stored, by ranges or by chunks, so that it reads every byte once,
whatever the declared order; its rows carry their number.

Options: ``variables`` (comma-separated, read no others), ``start`` and ``stop``
(rows to read), ``dim_order`` ("variable": each variable is read in its own
order of dimensions; "declared": values are taken in file order whatever their
dimensions), ``partition_rows``.

The range is an option rather than a pushed filter, since a scan keeps the
filters that one query has pushed into a Python source for later queries too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ByteType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from ..operators.frame import Frame
from ..operators.positional import ROW_ID
from . import formats

#: fixed values: column types of raw values
KINDS = {"i1": ByteType, "i2": ShortType, "i4": IntegerType, "i8": LongType, "u1": ShortType, "u2": IntegerType, "u4": LongType, "f4": FloatType, "f8": DoubleType, "S1": StringType}
#: signed types that hold the values of unsigned ones
WIDER = {"u1": "i2", "u2": "i4", "u4": "i8"}
BATCH_ROWS = 65_536
#: a variable of one dimension up to this length is read whole, once for each partition
AXIS = 1 << 20


def _origin(attrs: dict) -> np.datetime64 | None:
    """First day of a calendar variable counted in days."""
    m = re.match(r"\s*days\s+since\s+(\d{4})-(\d{1,2})-(\d{1,2})", str(attrs.get("units", "")), re.I)
    return np.datetime64(f"{int(m[1]):04d}-{int(m[2]):02d}-{int(m[3]):02d}", "D") if m and "calendar" in attrs else None


def column_type(v: formats.Variable) -> DataType:
    if _origin(v.attrs) is not None:
        return DateType()
    if "scale_factor" in v.attrs:
        return FloatType()
    if v.kind.str[1:] not in KINDS:
        raise ValueError(f"variable {v.name} has a type that no column has ({v.kind})")
    return KINDS[v.kind.str[1:]]()


def decoded(v: formats.Variable, raw: np.ndarray) -> np.ndarray:
    """Values as the column has them: dates, scaled single precision, or as they are."""
    raw = raw.astype(raw.dtype.newbyteorder("="))
    origin = _origin(v.attrs)
    if origin is not None:
        return origin + raw.astype("timedelta64[D]")
    if "scale_factor" in v.attrs:
        return raw.astype(np.float32) * np.float32(v.attrs["scale_factor"]) + np.float32(v.attrs.get("add_offset", 0))
    return raw.astype(WIDER.get(raw.dtype.str[1:], raw.dtype))


class GridPartition(InputPartition):
    """Rows [start, stop); ``unit`` says of what: rows in order, stored cells, or chunks."""

    def __init__(self, start: int, stop: int, unit: str = "row"):
        self.start, self.stop, self.unit = start, stop, unit


class GridReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.schema = options["path"], schema
        self.declared = options.get("dim_order", "variable") == "declared"
        self.rows = int(options.get("partition_rows", 1_000_000))
        header = formats.read_header(self.path)[1]
        self.cells = header.cells
        self.low = min(int(options.get("start", 0)), self.cells)
        self.high = min(int(options.get("stop", self.cells)), self.cells)
        self.order, self.chunks = self._stored(header)

    def _stored(self, header: formats.Header) -> tuple[list[str], tuple[int, ...] | None]:
        """Dimensions in the stored order of the variable that has most of them, and the chunks it is stored in."""
        names = [f.name for f in self.schema.fields if f.name in header.variables and f.name not in header.dims]
        if self.declared or not names:
            return list(header.dims), None
        dims, chunks = formats.stored_blocks(header, max(names, key=lambda n: len(header.variables[n].dims)))
        rest = [d for d in header.dims if d not in dims]
        return [*dims, *rest], chunks and (*chunks, *[header.dims[d] for d in rest])

    def partitions(self) -> Sequence[InputPartition]:
        if (self.low, self.high) != (0, self.cells):
            cuts, unit = [(a, min(a + self.rows, self.high)) for a in range(self.low, self.high, self.rows)], "row"
        elif self.chunks:
            sizes = formats.read_header(self.path)[1].dims
            n = int(np.prod([-(-sizes[d] // c) for d, c in zip(self.order, self.chunks, strict=True)], dtype=np.int64))
            step = max(1, self.rows // int(np.prod(self.chunks, dtype=np.int64)))
            cuts, unit = [(a, min(a + step, n)) for a in range(0, n, step)], "chunk"
        else:
            cuts, unit = [(a, min(a + self.rows, self.cells)) for a in range(0, self.cells, self.rows)], "stored"
        return [GridPartition(a, b, unit) for a, b in cuts] or [GridPartition(0, 0)]

    def _cells(self, part: GridPartition, dims: dict[str, int]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
        """(row numbers, place in each dimension) of batches of a partition, as they are best read."""
        names, sizes = list(dims), list(dims.values())
        shape = [dims[d] for d in self.order]
        if part.unit == "chunk":
            grid = [-(-n // c) for n, c in zip(shape, self.chunks, strict=True)]
            for k in range(part.start, part.stop):
                low = [int(i) * c for i, c in zip(np.unravel_index(k, grid), self.chunks, strict=True)]
                axes = [np.arange(a, min(a + c, n)) for a, c, n in zip(low, self.chunks, shape, strict=True)]
                box = [len(x) for x in axes]
                for a in range(0, int(np.prod(box, dtype=np.int64)), BATCH_ROWS):
                    inside = np.unravel_index(np.arange(a, min(a + BATCH_ROWS, int(np.prod(box, dtype=np.int64)))), box)
                    place = {d: x[i] for d, x, i in zip(self.order, axes, inside, strict=True)}
                    yield np.ravel_multi_index([place[d] for d in names], sizes), place
            return
        if part.unit == "stored":
            for a in range(part.start, part.stop, BATCH_ROWS):
                place = dict(zip(self.order, np.unravel_index(np.arange(a, min(a + BATCH_ROWS, part.stop)), shape), strict=True))
                yield np.ravel_multi_index([place[d] for d in names], sizes), place
            return
        row = np.arange(part.start, part.stop)
        place = dict(zip(names, np.unravel_index(row, sizes), strict=True)) if len(row) else {}
        if not len(row):
            return
        keys = [place[d] for d in reversed(self.order)]
        if self.chunks:  # a chunk's cells together
            keys += [place[d] // c for d, c in zip(reversed(self.order), reversed(self.chunks), strict=True)]
        by = np.lexsort(keys)
        for a in range(0, len(by), BATCH_ROWS):
            some = by[a : a + BATCH_ROWS]
            yield row[some], {d: x[some] for d, x in place.items()}

    def read(self, partition: GridPartition) -> Iterator[pa.RecordBatch]:
        store = formats.Store(self.path)
        form, header = formats.read_header(self.path, store)
        names, axes = list(header.dims), {}
        for cell, place in self._cells(partition, header.dims):
            arrays = []
            for f in self.schema.fields:
                if f.name == ROW_ID:
                    arrays.append(pa.array(cell, pa.int64()))
                    continue
                if f.name in names and f.name not in header.variables:
                    arrays.append(pa.array(place[f.name].astype(np.int32)))
                    continue
                v = header.variables[f.name]
                if f.name in names:
                    at = place[f.name]
                elif self.declared and len(v.dims) == len(names):
                    at = cell
                else:
                    at = np.ravel_multi_index([place[d] for d in v.dims], [header.dims[d] for d in v.dims]) if v.dims else np.zeros(len(cell), np.int64)
                if len(v.dims) < 2 and (not v.dims or header.dims[v.dims[0]] <= AXIS):
                    if f.name not in axes:
                        axes[f.name] = formats.read_values(self.path, form, header, f.name, np.arange(header.dims[v.dims[0]] if v.dims else 1), store)
                    raw = axes[f.name][at]
                else:
                    raw = formats.read_values(self.path, form, header, f.name, at, store)
                values = decoded(v, raw)
                arrays.append(pa.array(np.char.decode(values, "latin1")) if values.dtype.kind == "S" else pa.array(values))
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in self.schema.fields])


class GridDataSource(DataSource):
    """``spark.read.format("grid").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> StructType:
        _, header = formats.read_header(self.options["path"])
        wanted = [v.strip() for v in self.options["variables"].split(",")] if self.options.get("variables") else header.data_variables
        unknown = [v for v in wanted if v not in header.variables]
        if unknown:
            raise ValueError(f"no variable {', '.join(unknown)}")
        out = [StructField(ROW_ID, LongType(), False)]
        for d in header.dims:
            out.append(StructField(d, column_type(header.variables[d]) if d in header.variables else IntegerType()))
        return StructType(out + [StructField(v, column_type(header.variables[v])) for v in wanted])

    def reader(self, schema: StructType) -> DataSourceReader:
        return GridReader(schema, dict(self.options))


def register_grid(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(GridDataSource)


def read_grid(spark: SparkSession, path: str, variables: Sequence[str] | None = None, dim_order: str = "variable", eager: bool = False, partition_rows: int = 1_000_000) -> Frame:
    """A grid file as a frame: dimensions are its index, and rows follow their declared order."""
    register_grid(spark)
    options = {"path": path, "dim_order": dim_order, "partition_rows": str(partition_rows)}
    if variables:
        options["variables"] = ",".join(variables)
    frame = GridFrame.scanned(spark, options)
    if eager:
        frame = frame.cache()
        frame.df.count()
    return frame


class GridFrame(Frame):
    """A frame whose rows carry their number.

    While it is a bare scan (``options``), slices and selections become options
    of a new scan; later ones are those of any frame.
    """

    options: dict | None = None

    @classmethod
    def scanned(cls, spark: SparkSession, options: dict, coerce: str = "column") -> GridFrame:
        df = spark.read.format("grid").options(**options).load()
        out = cls(df, list(formats.read_header(options["path"])[1].dims), (ROW_ID,), coerce)
        out.options = options
        return out

    @property
    def columns(self) -> list[str]:
        return [c for c in super().columns if c != ROW_ID]

    @property
    def dtypes(self) -> dict[str, str]:
        return {c: k for c, k in super().dtypes.items() if c != ROW_ID}

    def slice(self, start: int | None, stop: int | None, step: int | None = None) -> Frame:
        if self.options is None or (start or 0) < 0 or (stop or 0) < 0 or (step or 1) < 1:
            return super().slice(start, stop, step)
        base = int(self.options.get("start", 0))
        bounds = {"start": str(base + (start or 0))}
        if stop is not None:
            bounds["stop"] = str(min(base + stop, int(self.options.get("stop", base + stop))))
        out = self.scanned(self.df.sparkSession, self.options | bounds, self.coerce)
        return out if (step or 1) == 1 else out._new(out.df.filter(f"pmod({ROW_ID} - {bounds['start']}, {int(step)}) = 0"))

    def head(self, n: int = 10) -> Frame:
        """The first n rows; of a bare scan only their cells are read."""
        return self.slice(0, n) if self.options is not None else super().head(n)

    def drop(self, columns: str | Sequence[str]) -> Frame:
        """Without the columns; a bare scan no longer reads them."""
        if self.options is not None and isinstance(columns, (str, list, tuple)):
            gone = [columns] if isinstance(columns, str) else columns
            left = [c for c in self.columns if c not in gone]
            if left and not set(gone) & set(self.index):
                return self.select(left)
        return super().drop(columns)

    def reading(self, columns: Sequence[str]) -> Frame:
        """A frame that reads no more variables than the columns; this one where it is no bare scan."""
        wanted = [c for c in columns if c in self.columns]
        return self.select(wanted) if self.options is not None and wanted and len(wanted) < len(self.columns) else self

    def subset(self, dimension: str, low, high) -> Frame:
        """The cells whose label in a dimension lies from ``low`` to ``high``, both included."""
        c = F.col(f"`{dimension}`")
        return self._new(self.df.where((c >= F.lit(low)) & (c <= F.lit(high))))

    def keyed(self, df=None) -> Frame:
        """The plain frame ordered by its dimensions, without row numbers."""
        df = self.df if df is None else df
        return Frame(df.drop(ROW_ID), self.index, self.index, self.coerce)

    def _new(self, df, index=None, order=None) -> Frame:
        out = super()._new(df, index, order)
        return out if ROW_ID not in df.columns else GridFrame(out.df, out.index, out.order, out.coerce)

    def select(self, columns: Sequence[str]) -> Frame:
        if self.options is not None and columns and all(c in self.columns for c in columns):
            return self.scanned(self.df.sparkSession, self.options | {"variables": ",".join(columns)}, self.coerce)
        return self._new(self.df.select(ROW_ID, *self.index, *[c for c in columns if c not in self.index]))

    def merge(self, right: Frame, *args, **options) -> Frame:
        other = right.keyed() if isinstance(right, GridFrame) else right
        return self.keyed().merge(other, *args, **options)

    def set_index(self, columns: Sequence[str]) -> Frame:
        return self.keyed().set_index(columns)

    def to_csv(self, path: str, *args, **options) -> None:
        self.keyed().to_csv(path, *args, **options)

    def to_grid(self, path: str, form: str = "classic") -> None:
        self.keyed().to_grid(path, form)

    def evaluate(self):
        return self._ordered(self.df).drop(ROW_ID).toPandas()
