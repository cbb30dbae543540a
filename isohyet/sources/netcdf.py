"""Gridded fields in NetCDF's classic format (versions 1, 2 and 5): files are dealt out whole, one to a task."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Types of the format by number, units of time in seconds, names of coordinates.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
NAMES = {"time": ("time", "valid_time"), "lat": ("lat", "latitude"), "lon": ("lon", "longitude")}
#: Values of a frame that a task gives on at a time.
FRAME = 1 << 19


class Header:
    """Dimensions, attributes and variables of a file."""

    def __init__(self, data: bytes, name: str = "file") -> None:
        if data[:4] == b"\x89HDF":
            raise ValueError(f"{name}: NetCDF-4 files are HDF5 inside, which has no reader here; convert to the classic format (nccopy -k classic)")
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError(f"{name}: not a NetCDF file")
        self.data, self.at, self.version = data, 4, data[3]
        records = self.number()
        self.dims = [(self.text(), self.number()) for _ in range(self.entries())]
        self.attributes = self.read_attributes()
        self.variables = {}
        for _ in range(self.entries()):
            name_ = self.text()
            dims = [self.number() for _ in range(self.number())]
            attributes, kind, size = self.read_attributes(), TYPES[self.take(">i")], self.number()
            self.variables[name_] = (dims, attributes, kind, size, self.take(">i" if self.version == 1 else ">q"))
        stepped = [v for v in self.variables.values() if v[0] and self.dims[v[0][0]][1] == 0]
        # A single record variable is not padded between records.
        self.step = self.flat(stepped[0]) if len(stepped) == 1 else sum(v[3] for v in stepped)
        if records in (0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF):  # written as a stream, so the file's length tells
            records = (len(data) - min(v[4] for v in stepped)) // self.step if stepped else 0
        self.records = records

    def take(self, kind: str):
        out = struct.unpack_from(kind, self.data, self.at)[0]
        self.at += struct.calcsize(kind)
        return out

    def number(self) -> int:
        return self.take(">Q" if self.version == 5 else ">I")

    def entries(self) -> int:
        self.take(">i")
        return self.number()

    def text(self) -> str:
        n = self.number()
        out = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return out

    def read_attributes(self) -> dict:
        out = {}
        for _ in range(self.entries()):
            name, kind = self.text(), TYPES[self.take(">i")]
            n = self.number()
            values = np.frombuffer(self.data, kind, n, self.at)
            self.at += -(-n * values.itemsize // 4) * 4
            out[name] = values.tobytes().decode().rstrip("\0") if kind == "S1" else values[0].item() if n == 1 else values.tolist()
        return out

    def flat(self, variable: tuple) -> int:
        """Bytes of one record."""
        return int(np.prod([self.dims[d][1] for d in variable[0][1:]], dtype=np.int64)) * np.dtype(variable[2]).itemsize

    def values(self, name: str) -> np.ndarray:
        variable = self.variables[name]
        dims, _, kind, _, begin = variable
        shape = [self.dims[d][1] for d in dims]
        if not dims or shape[0]:
            return np.frombuffer(self.data, kind, int(np.prod(shape, dtype=np.int64)), begin).reshape(shape)
        one = np.dtype(kind).itemsize
        inner = np.cumprod([1, *shape[:0:-1]])[:-1][::-1] * one
        return np.ndarray((self.records, *shape[1:]), kind, self.data, begin, (self.step, *inner.tolist()))


def times(values: np.ndarray, units: str) -> np.ndarray:
    """Microseconds since 1970 of counts "<unit>s since <date> [<time>]"."""
    unit, _, since = units.partition(" since ")
    if unit.rstrip("s") not in SECONDS or not since:
        raise ValueError(f"unknown units of time: {units!r}")
    start = pd.Timestamp(since.strip().removesuffix("UTC").strip()).tz_localize(None)
    return start.value // 1000 + np.round(values.astype(float) * SECONDS[unit.rstrip("s")] * 1e6).astype(np.int64)


def frames(data: bytes, variable: str, name: str = "file") -> Iterator[pd.DataFrame]:
    """(time, lat, lon, value) of a variable over time, lat and lon, some times at a time. Missing values are NaN."""
    h = Header(data, name)
    if variable not in h.variables:
        raise ValueError(f"{name}: no variable {variable!r}; there are {', '.join(h.variables)}")
    dims, attributes, *_ = h.variables[variable]
    named = [h.dims[d][0] for d in dims]
    order = [next((i for i, n in enumerate(named) if n in names), None) for names in NAMES.values()]
    if None in order or len(named) != 3:
        raise ValueError(f"{name}: {variable} is over ({', '.join(named)}), not time, lat and lon")
    axes = [h.values(named[i]).astype(float) for i in order]
    at = times(axes[0], h.variables[named[order[0]]][1].get("units", ""))
    field = h.values(variable).transpose(order)
    lon, lat = np.tile(axes[2], len(axes[1])), np.repeat(axes[1], len(axes[2]))
    gone = [attributes[k] for k in ("_FillValue", "missing_value") if k in attributes]
    some = max(1, FRAME // max(1, len(lon)))
    for i in range(0, len(at), some):
        raw = field[i : i + some].reshape(-1)
        v = raw.astype(float) * attributes.get("scale_factor", 1.0) + attributes.get("add_offset", 0.0)
        v[np.isin(raw, np.array(gone, raw.dtype))] = np.nan
        n = len(at[i : i + some])
        yield pd.DataFrame({"time": pd.to_datetime(np.repeat(at[i : i + some], len(lon)), unit="us"), "lat": np.tile(lat, n), "lon": np.tile(lon, n), "value": v})


def read_netcdf(spark: SparkSession, path: str, variable: str = "tp") -> DataFrame:
    """A long cube (time, lat, lon, rainfall) of one file or a folder of them, in the variable's own units. NaN and fill values become null.

    A file is one row of Spark's binary reader, so it may have up to 2 GB; long series come as a file for each year or
    month, and those are the partitions.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            for r in t.itertuples():
                for f in frames(bytes(r.content), variable, r.path):
                    yield f.rename(columns={"value": "rainfall"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    long = files.mapInPandas(run, "time timestamp_ntz, lat double, lon double, rainfall double")
    return long.selectExpr("time", "lat", "lon", "CASE WHEN NOT isnan(rainfall) THEN rainfall END AS rainfall")
