"""Classic NetCDF files written byte by byte, against the field they hold."""

import struct

import numpy as np
import pandas as pd
import pytest

from isohyet.sources import netcdf

NUMBER = {"i2": 3, "i4": 4, "f4": 5, "f8": 6}


def text(s):
    b = s.encode()
    return struct.pack(">I", len(b)) + b + b"\0" * (-len(b) % 4)


def listed(tag, items):
    return struct.pack(">iI", tag, len(items)) + b"".join(items) if items else struct.pack(">iI", 0, 0)


def attribute(name, value):
    if isinstance(value, str):
        b = value.encode()
        return text(name) + struct.pack(">iI", 2, len(b)) + b + b"\0" * (-len(b) % 4)
    a = np.array([value]).astype(">" + value.dtype.str[1:])
    return text(name) + struct.pack(">iI", NUMBER[value.dtype.str[1:]], 1) + a.tobytes() + b"\0" * (-a.nbytes % 4)


def written(dims, variables, version=1, records=0, stream=False):
    """dims: name -> size (0: record); variables: name -> (dims, attributes, array)."""
    ids = list(dims)
    off = ">i" if version == 1 else ">q"
    pad = lambda n: -(-n // 4) * 4
    stepped = [n for n, (d, _, _) in variables.items() if dims[d[0]] == 0]
    size = {n: pad(v.nbytes if n not in stepped else v[0].nbytes) for n, (_, _, v) in variables.items()}

    def head(begin):
        vs = [text(n) + struct.pack(f">I{len(d)}I", len(d), *map(ids.index, d)) + listed(12, [attribute(*x) for x in a.items()]) + struct.pack(">iI", NUMBER[v.dtype.str[1:]], size[n]) + struct.pack(off, begin.get(n, 0)) for n, (d, a, v) in variables.items()]
        return b"CDF" + bytes([version]) + struct.pack(">I", 0xFFFFFFFF if stream else records) + listed(10, [text(n) + struct.pack(">I", k) for n, k in dims.items()]) + listed(12, [attribute("title", "x")]) + listed(11, vs)

    at, begin, body = len(head({})), {}, b""
    for n, (_, _, v) in variables.items():
        if n not in stepped:
            begin[n] = at + len(body)
            body += v.astype(">" + v.dtype.str[1:]).tobytes() + b"\0" * (size[n] - v.nbytes)
    start = at + len(body)
    for n in stepped:
        begin[n] = start
        start += size[n]
    for k in range(records):
        for n in stepped:
            one = np.asarray(variables[n][2][k : k + 1])
            body += one.astype(">" + one.dtype.str[1:]).tobytes() + (b"\0" * (size[n] - one.nbytes) if len(stepped) > 1 else b"")
    return head(begin) + body


LAT, LON = np.array([10.0, 10.25, 10.5], "f8"), np.array([75.0, 75.25], "f4")
DAYS = np.arange(4, dtype="i4")
FIELD = np.random.default_rng(1).random((4, 3, 2)).astype("f4")


def table(df):
    return {(str(r.time)[:16], r.lat, r.lon): r.rainfall for r in df.collect()}


def expected(field, start="2000-01-01", step="1D"):
    days = pd.date_range(start, periods=len(field), freq=step)
    return {(str(d)[:16], float(y), float(x)): float(field[k, i, j]) for k, d in enumerate(days) for i, y in enumerate(LAT) for j, x in enumerate(LON)}


@pytest.mark.parametrize("version, dims, records, stream", [(1, {"time": 4}, 0, False), (2, {"time": 0}, 4, False), (1, {"time": 0}, 4, True)])
def test_fixed_and_record_times(spark, tmp_path, version, dims, records, stream):
    variables = {"lat": (["lat"], {}, LAT), "lon": (["lon"], {}, LON), "time": (["time"], {"units": "days since 2000-01-01"}, DAYS), "tp": (["time", "lat", "lon"], {"units": "m"}, FIELD)}
    (tmp_path / "a.nc").write_bytes(written(dims | {"lat": 3, "lon": 2}, variables, version, records, stream))
    got = table(netcdf.read_netcdf(spark, str(tmp_path / "a.nc")))
    assert got == pytest.approx(expected(FIELD))


def test_packed_values_other_order_and_a_folder(spark, tmp_path):
    packed = np.round(FIELD * 1000).astype("i2")
    packed[1, 2, 0] = -999
    for k in range(2):
        variables = {
            "longitude": (["longitude"], {}, LON), "latitude": (["latitude"], {}, LAT), "valid_time": (["valid_time"], {"units": "hours since 2000-01-0%d 06:00:00" % (k + 1)}, np.array([0], "i4")),
            "tp": (["latitude", "valid_time", "longitude"], {"scale_factor": np.float64(0.001), "add_offset": np.float64(1.0), "_FillValue": np.int16(-999)}, packed[k : k + 1].transpose(1, 0, 2)),
        }
        (tmp_path / f"{k}.nc").write_bytes(written({"valid_time": 1, "latitude": 3, "longitude": 2}, variables))
    want = expected(packed[:2] * 0.001 + 1.0, "2000-01-01 06:00")
    want["2000-01-02 06:00", 10.5, 75.0] = None
    got = table(netcdf.read_netcdf(spark, str(tmp_path)))
    assert got.keys() == want.keys() and all(got[k] == (v if v is None else pytest.approx(v)) for k, v in want.items())


def test_other_files_are_errors():
    for data, says in ((b"\x89HDF\r\n\x1a\n", "HDF5"), (b"lat,lon", "not a NetCDF")):
        with pytest.raises(ValueError, match=says):
            netcdf.Header(data)
    one = written({"time": 4}, {"time": (["time"], {"units": "fortnights since 2000-01-01"}, DAYS)})
    with pytest.raises(ValueError, match="no variable"):
        next(netcdf.frames(one, "tp"))
    with pytest.raises(ValueError, match="units of time"):
        netcdf.times(DAYS, "fortnights since 2000-01-01")
