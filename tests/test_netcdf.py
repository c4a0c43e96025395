"""Classic netCDF files, written here byte by byte, read back by the data source."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from panelmill.sources import netcdf as N

CODES = {"b": 1, "c": 2, ">i2": 3, ">i4": 4, ">f4": 5, ">f8": 6}


def pad(raw):
    return raw + b"\0" * (-len(raw) % 4)


def name(x):
    return struct.pack(">i", len(x)) + pad(x.encode())


def attributes(own):
    if not own:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", 12, len(own))
    for k, v in own.items():
        if isinstance(v, str):
            out += name(k) + struct.pack(">ii", 2, len(v)) + pad(v.encode())
        else:
            a = np.array([v[1]], v[0])
            out += name(k) + struct.pack(">ii", CODES[v[0]], 1) + pad(a.tobytes())
    return out


def write(path, dims, variables, version=1, record=None, streaming=False):
    """dims: name -> length. variables: name -> (dims, type, attributes, values). record: the dimension that grows."""
    order = list(dims)
    header = struct.pack(">ii", 10, len(dims)) + b"".join(name(d) + struct.pack(">i", 0 if d == record else n) for d, n in dims.items()) + attributes({"title": "made here"})
    own = {n: np.ascontiguousarray(v[3], v[1]) for n, v in variables.items()}
    grows = [n for n, v in variables.items() if v[0] and v[0][0] == record]
    size = {n: len(pad(a[0].tobytes() if n in grows else a.tobytes())) for n, a in own.items()}
    if len(grows) == 1:
        size[grows[0]] = own[grows[0]][0].nbytes + (-own[grows[0]][0].nbytes % 4)
    wide = 8 if version == 2 else 4

    def listed(at):
        out = struct.pack(">ii", 11, len(variables))
        for n, (d, kind, atts, _) in variables.items():
            out += name(n) + struct.pack(">i", len(d)) + b"".join(struct.pack(">i", order.index(x)) for x in d) + attributes(atts)
            out += struct.pack(">ii", CODES[kind], size[n]) + struct.pack(">q" if wide == 8 else ">i", at[n])
        return out

    start, at = 8 + len(header) + len(listed(dict.fromkeys(variables, 0))), {}
    for n in sorted(variables, key=lambda n: n in grows):
        at[n] = start
        start += size[n]
    body = b"".join(pad(own[n].tobytes()) for n in variables if n not in grows)
    for r in range(dims[record] if record else 0):
        body += b"".join(own[n][r : r + 1].tobytes() if len(grows) == 1 else pad(own[n][r : r + 1].tobytes()) for n in variables if n in grows)
    path.write_bytes(b"CDF" + bytes([version]) + struct.pack(">i", -1 if streaming else dims[record] if record else 0) + header + listed(at) + body)


def made(seed, months=30, first=1990 * 12 + 5):
    rng = np.random.default_rng(seed)
    tp, t2 = rng.normal(size=(months, 3, 4)).astype(">f4"), rng.integers(-900, 900, (months, 3, 4)).astype(">i2")
    tp[3, 1, 2], t2[5, 0, 0] = -999, -32768
    ym = first + np.arange(months)
    days = [(np.datetime64(f"{m // 12}-{m % 12 + 1:02d}-01") - np.datetime64("1900-01-01")).astype(int) for m in ym]
    return ym, tp, t2, {
        "time": (("time",), ">i4", {"units": "days since 1900-01-01"}, days), "latitude": (("latitude",), ">f4", {}, [0.0, 0.25, 0.5]), "longitude": (("longitude",), ">f8", {}, [-90, -89.75, -89.5, -89.25]),
        "tp": (("time", "latitude", "longitude"), ">f4", {"_FillValue": (">f4", -999)}, tp), "t2": (("time", "latitude", "longitude"), ">i2", {"scale_factor": (">f8", 0.5), "add_offset": (">f8", 280.0), "missing_value": (">i2", -32768)}, t2),
    }


DIMS = {"time": 30, "latitude": 3, "longitude": 4}


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(N.ClassicNetCDF)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda: spark.read.format("netcdf3").option("slab", 7)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize(("version", "record", "streaming", "only"), [(1, None, False, None), (2, "time", False, None), (1, "time", True, None), (1, "time", False, "tp"), (2, "time", True, "t2")])
def test_files_come_back(source, tmp_path, version, record, streaming, only):
    ym, tp, t2, variables = made(1)
    variables = {n: v for n, v in variables.items() if n not in ("tp", "t2") or only in (None, n)}
    write(tmp_path / "ncep_lead1.nc", DIMS, variables, version, record, streaming)
    rows = source().option("path", str(tmp_path / "*.nc")).load()
    names = [n for n in ("tp", "t2") if only in (None, n)]
    assert rows.columns == ["model", "ym", "cell", "lat", "lon", *names]
    got = {(r.ym, r.cell): r for r in rows.collect()}
    assert len(got) == 30 * 12
    for i, m in enumerate(ym):
        for c in range(12):
            r, y, x = got[m, c], c // 4, c % 4
            assert r.model == "ncep" and (r.lat, r.lon) == (0.25 * y, -90 + 0.25 * x)
            if "tp" in names:
                assert r.tp is None if (i, y, x) == (3, 1, 2) else abs(r.tp - float(tp[i, y, x])) < 1e-12
            if "t2" in names:
                assert r.t2 is None if (i, y, x) == (5, 0, 0) else abs(r.t2 - (t2[i, y, x] * 0.5 + 280)) < 1e-9


def test_filters_leave_slabs_and_files_out(source, tmp_path):
    for k, model in enumerate(("ncep", "ecmwf")):
        write(tmp_path / f"{model}_lead1.nc", DIMS, made(k)[3], 1, "time")
    where, first = str(tmp_path / "*.nc"), 1990 * 12 + 5
    reader = N.Reader({"path": where, "slab": "7", "push": "true"}, ["model", "ym", "tp"])
    assert len(reader.partitions()) == 10
    kept = reader.pushFilters([GreaterThan(("ym",), first + 6), LessThanOrEqual(("ym",), first + 20), EqualTo(("model",), "ncep")])
    assert len(list(kept)) == 3 and [(s.first, s.last) for s in reader.partitions()] == [(7, 14), (14, 21)]
    reader.pushFilters([In(("ym",), (first + 8, first + 25))])
    assert [(s.first, s.last) for s in reader.partitions()] == [(7, 14)]
    load = lambda **options: source().option("path", where).options(**options).schema("ym int, tp double, model string").load()
    wanted = (F.col("ym") >= first + 7) & (F.col("ym") < first + 21) & (F.col("model") == "ecmwf")
    for own in (load(push="true").where(wanted), load(push="false", first=first + 7, last=first + 20, models="ecmwf")):
        assert own.count() == 14 * 12 and own.rdd.getNumPartitions() == 2 and own.columns == ["ym", "tp", "model"]
    rows = load(push="false", first=-1, last=10**8, models="ncep,ecmwf,none")
    assert rows.where(wanted).count() == 14 * 12 and rows.rdd.getNumPartitions() == 10 and rows.count() == 720  # one frame's filter isn't another's


def test_members_and_other_units(source, tmp_path):
    rng = np.random.default_rng(3)
    rate = rng.normal(size=(5, 2, 1, 3, 4))
    dims = {"forecast_time": 5, "number": 2, "forecastMonth": 1, "lat": 3, "lon": 4}
    write(tmp_path / "m_x.nc", dims, {
        "forecast_time": (("forecast_time",), ">f8", {"units": "months since 1999-11"}, np.arange(5)), "lat": (("lat",), ">f8", {}, [0, 1, 2]), "lon": (("lon",), ">f8", {}, [0, 1, 2, 3]),
        "rate": (("forecast_time", "number", "forecastMonth", "lat", "lon"), ">f8", {}, rate),
    })
    got = {(r.ym, r.member, r.cell): r.rate for r in source().option("path", str(tmp_path / "m_x.nc")).schema("ym int, member int, cell int, rate double").load().collect()}
    assert len(got) == 120 and all(abs(got[1999 * 12 + 10 + i, n, c] - rate[i, n, 0, c // 4, c % 4]) < 1e-12 for i in range(5) for n in range(2) for c in range(12))


def test_what_is_not_such_a_file(source, tmp_path):
    (tmp_path / "a.nc").write_bytes(b"\x89HDF\r\n")
    write(tmp_path / "b.nc", {"z": 3}, {"v": (("z",), ">f8", {}, [1, 2, 3])})
    for path, names in (("a.nc", "ym int, tp double"), ("b.nc", "ym int, v double"), ("b.nc", "ym int, w double"), ("none*.nc", "ym int, tp double")):
        with pytest.raises(PySparkException):
            source().option("path", str(tmp_path / path)).schema(names).load().collect()
