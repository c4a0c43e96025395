"""A data source for gridded files in the classic netCDF format, which Spark has no reader for.

    spark.dataSource.register(ClassicNetCDF)
    spark.read.format("netcdf3").option("path", "folder/*.nc").schema("model string, ym int, cell int, tp double").load()

Rows are months and cells, numbered by rows of the grid. A partition is a slab of months of one file: it seeks to its
months and reads those alone. The schema names what is read: other variables' bytes are skipped. The options first,
last (months) and models (names with commas) leave out slabs and files before anything is read. With the option push and
spark.sql.python.filterPushdown.enabled set, filters on ym and model do the same. That is off by default: frames of one
load() share their reader in Spark, so what one pushes also holds for the others; load() anew for each then. Files lie
where every executor can open them.
"""

from __future__ import annotations

import glob
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import PurePath

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

# The format's tags and types.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
UNITS = {"day": "D", "days": "D", "hour": "h", "hours": "h", "minute": "m", "minutes": "m", "second": "s", "seconds": "s"}
LATITUDES, LONGITUDES = ("lat", "latitude", "y"), ("lon", "longitude", "x")
#: Months of a file that one task reads.
SLAB = 48


@dataclass(frozen=True)
class Variable:
    dims: tuple[int, ...]
    attributes: dict
    kind: str
    begin: int
    record: bool


class File:
    """The header of a file, and parts of its variables on demand."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            self._f = f
            magic = f.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2):
                raise ValueError(f"{path} is not a classic netCDF file")
            self._long = magic[3] == 2
            (records,) = struct.unpack(">i", f.read(4))
            self.dims = [(self._name(), self._int()) for _ in range(self._list(DIMENSION))]
            self.attributes = self._attributes()
            found = {}
            for _ in range(self._list(VARIABLE)):
                name = self._name()
                dims = tuple(self._int() for _ in range(self._int()))
                attributes, kind, size = self._attributes(), TYPES[self._int()], self._int()
                begin = struct.unpack(">q", f.read(8))[0] if self._long else self._int()
                found[name] = Variable(dims, attributes, kind, begin, bool(dims) and self.dims[dims[0]][1] == 0), size
        own = [(v, size) for v, size in found.values() if v.record]
        #: Bytes from one record to the next; a single variable of small numbers is not padded.
        self._stride = sum(size for _, size in own)
        if len(own) == 1:
            v = own[0][0]
            self._stride = int(np.prod([self.dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(v.kind).itemsize
        if records < 0:  # a stream's end: as many as the file holds
            first = min((v.begin for v, _ in own), default=0)
            records = (self._size() - first) // self._stride if own else 0
        self.records = records
        self.variables = {name: v for name, (v, _) in found.items()}
        del self._f

    def _size(self) -> int:
        with open(self.path, "rb") as f:
            return f.seek(0, 2)

    def _int(self) -> int:
        return struct.unpack(">i", self._f.read(4))[0]

    def _list(self, tag: int) -> int:
        found, n = self._int(), self._int()
        if found not in (tag, 0) or found == 0 and n:
            raise ValueError(f"{self.path}: tag {found} in place of {tag}")
        return n

    def _padded(self, n: int) -> bytes:
        return self._f.read(n + -n % 4)[:n]

    def _name(self) -> str:
        return self._padded(self._int()).decode()

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(ATTRIBUTE)):
            name, kind, n = self._name(), TYPES[self._int()], self._int()
            raw = self._padded(n * np.dtype(kind).itemsize)
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == "S1" else np.frombuffer(raw, kind)
        return out

    def shape(self, name: str) -> tuple[int, ...]:
        v = self.variables[name]
        return tuple(self.records if v.record and k == 0 else self.dims[d][1] for k, d in enumerate(v.dims))

    def read(self, name: str, first: int = 0, last: int | None = None) -> np.ndarray:
        """A variable from first to before last of its first dimension, as floats; fillings are nan, packed values unpacked."""
        v, shape = self.variables[name], self.shape(name)
        if not shape:
            first, last, shape = 0, 1, (1,)
        last = shape[0] if last is None else last
        each = int(np.prod(shape[1:], dtype=np.int64)) * np.dtype(v.kind).itemsize
        with open(self.path, "rb") as f:
            if v.record:
                parts = []
                for r in range(first, last):
                    f.seek(v.begin + r * self._stride)
                    parts.append(f.read(each))
                raw = b"".join(parts)
            else:
                f.seek(v.begin + first * each)
                raw = f.read((last - first) * each)
        x = np.frombuffer(raw, v.kind).reshape(last - first, *shape[1:]).astype(float)
        for key in ("_FillValue", "missing_value"):
            if key in v.attributes:
                x[x == float(v.attributes[key][0])] = np.nan
        return x * float(v.attributes.get("scale_factor", [1.0])[0]) + float(v.attributes.get("add_offset", [0.0])[0])

    def months(self, name: str) -> np.ndarray:
        """Months since year 0 of a time coordinate: `months since`, or days or shorter units from a date."""
        units, x = str(self.variables[name].attributes.get("units", "")), self.read(name)
        m = re.match(r"\s*(\w+)\s+since\s+(\d{1,4})-(\d{1,2})(?:-(\d{1,2}))?", units)
        if not m or m[1] not in UNITS and m[1] not in ("month", "months"):
            raise ValueError(f"{self.path}: {name} has units {units!r}")
        year, month = int(m[2]), int(m[3])
        if m[1] in ("month", "months"):
            return (year * 12 + month - 1 + np.floor(x)).astype(int)
        start = np.datetime64(f"{year:04d}-{month:02d}-{int(m[4] or 1):02d}", "s")
        size = int(np.timedelta64(1, UNITS[m[1]]) / np.timedelta64(1, "s"))
        return (start + np.round(x * size).astype("timedelta64[s]")).astype("datetime64[M]").astype(int) + 1970 * 12


def model_of(path: str) -> str:
    """The model that a file's name begins with, up to the first underscore."""
    return PurePath(path).name.split("_")[0]


@dataclass
class Slab(InputPartition):
    path: str
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: Sequence[str]):
        self.options, self.names = options, list(names)
        self.low, self.high, self.months = int(options.get("first", -(10**9))), int(options.get("last", 10**9)), None
        self.models = set(options["models"].split(",")) if "models" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Note what filters on ym and model rule out; all of them go back, as slabs hold more than they ask for."""
        for f in filters if self.options.get("push") == "true" else []:
            if getattr(f, "attribute", None) == ("ym",):
                if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
                if isinstance(f, In):
                    self.months = set(f.value) if self.months is None else self.months & set(f.value)
            if getattr(f, "attribute", None) == ("model",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.models = own if self.models is None else self.models & own
        return filters

    def _wanted(self, ym: np.ndarray) -> np.ndarray:
        ok = (ym >= self.low) & (ym <= self.high)
        return ok if self.months is None else ok & np.isin(ym, list(self.months))

    def partitions(self) -> list[Slab]:
        """Slabs that hold a month which the filters leave, of files of models which they leave. Only headers and times are read."""
        paths = sorted(glob.glob(self.options["path"].removeprefix("file://")))
        if not paths:
            raise FileNotFoundError(self.options["path"])
        size, out = int(self.options.get("slab", SLAB)), []
        for path in paths:
            if self.models is not None and model_of(path) not in self.models:
                continue
            own = File(path)
            ym = own.months(self._axes(own)[0])
            out += [Slab(path, a, min(a + size, len(ym))) for a in range(0, len(ym), size) if self._wanted(ym[a : a + size]).any()]
        return out

    def _variables(self, own: File) -> list[str]:
        fixed = {"model", "ym", "cell", "lat", "lon", "member"}
        return [n for n in self.names if n not in fixed]

    def _axes(self, own: File) -> tuple[str, str | None, str, str]:
        """Names of the time, member (or None), latitude and longitude dimensions, the same for all variables that are read."""
        names = self._variables(own) or [n for n, v in own.variables.items() if len(v.dims) >= 3][:1]
        if missing := [n for n in names if n not in own.variables]:
            raise ValueError(f"{own.path} has no {', '.join(missing)}")
        every = {tuple(own.dims[d][0] for d in own.variables[n].dims if own.dims[d][1] != 1 or d in own.variables[n].dims[:1]) for n in names}
        if len(every) != 1 or len(axes := every.pop()) not in (3, 4) or "time" not in axes[0] or axes[-2] not in LATITUDES or axes[-1] not in LONGITUDES:
            raise ValueError(f"{own.path}: variables must have the dimensions time, perhaps members, latitude and longitude")
        return axes[0], axes[1] if len(axes) == 4 else None, axes[-2], axes[-1]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        own = File(partition.path)
        time, member, lat, lon = self._axes(own)
        ym, y, x = own.months(time)[partition.first : partition.last], own.read(lat), own.read(lon)
        cells, members = len(y) * len(x), dict((d, n) for d, n in own.dims).get(member, 1)
        for i in np.flatnonzero(self._wanted(ym)):
            k = partition.first + int(i)
            n = members * cells
            every = {
                "model": lambda: pa.array([model_of(partition.path)] * n), "ym": lambda: pa.array(np.full(n, ym[i], np.int32)), "cell": lambda: pa.array(np.tile(np.arange(cells, dtype=np.int32), members)),
                "lat": lambda: pa.array(np.tile(np.repeat(y, len(x)), members)), "lon": lambda: pa.array(np.tile(np.tile(x, len(y)), members)), "member": lambda: pa.array(np.repeat(np.arange(members, dtype=np.int32), cells)),
            }
            cols = [every[c]() if c in every else pa.array(own.read(c, k, k + 1).ravel(), from_pandas=True) for c in self.names]
            yield pa.RecordBatch.from_arrays(cols, self.names)


class ClassicNetCDF(DataSource):
    """path: a file or a pattern. slab: months that a task reads. Without a schema: model, ym, cell, lat, lon and all variables over time, latitude and longitude."""

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> str:
        paths = sorted(glob.glob(self.options["path"].removeprefix("file://")))
        if not paths:
            raise FileNotFoundError(self.options["path"])
        own = File(paths[0])
        names = [n for n, v in own.variables.items() if len(v.dims) >= 3]
        return "model string, ym int, cell int, lat double, lon double" + "".join(f", `{n}` double" for n in names)

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options), schema.names)
