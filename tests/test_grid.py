import datetime

import numpy as np
import pytest

from gridframe.plans import convert, pipeline
from gridframe.sources import formats, hdf5, read_grid
from gridframe.sources.grid import GridReader
from hdf5_files import Writer, write_netcdf4

#: a fixed value: a small text grid
CDL = """netcdf small {
dimensions:
  longitude = 2 ;
  latitude = 3 ;
variables:
  float longitude(longitude) ;
    longitude:units = "degrees_east" ;
  float latitude(latitude) ;
  short tg(latitude, longitude) ;
    tg:_FillValue = -9999s ;
    tg:scale_factor = 0.01f ;
  int n(latitude, longitude) ;
data:
  longitude = 25.5, 26 ;
  latitude = 10, 11, 12 ;
  tg = _, 1000, 1010, _, _, 1020 ;
  n = 0, 1, 2, 3, 4, 5 ;
}
"""


@pytest.fixture
def cdl(tmp_path):
    path = tmp_path / "small.cdl"
    path.write_text(CDL)
    return str(path)


def test_cdl(spark, cdl):
    f = read_grid(spark, cdl)
    assert f.dtypes == {"tg": "float", "n": "int"} and f.index == ("longitude", "latitude")
    got = f.evaluate()
    assert got.n.tolist() == [0, 2, 4, 1, 3, 5]
    assert got.tg.tolist() == pytest.approx([-99.99, 10.1, -99.99, 10, -99.99, 10.2], rel=1e-6)
    assert got.longitude.tolist() == [25.5] * 3 + [26.0] * 3


def test_declared_order(spark, cdl):
    got = read_grid(spark, cdl, ["tg"], dim_order="declared").evaluate()
    assert got.tg.tolist() == pytest.approx([-99.99, 10, 10.1, -99.99, -99.99, 10.2], rel=1e-6)
    assert "n" not in got.columns


def test_head_slice_filter(spark, cdl):
    f = read_grid(spark, cdl, partition_rows=2)
    assert f[["n"]].head(2).evaluate().n.tolist() == [0, 2]
    assert f[1:4].evaluate().n.tolist() == [2, 4, 1]
    assert f[1:6:2].evaluate().n.tolist() == [2, 1, 5]
    assert f[f["tg"] != -99.99].evaluate().n.tolist() == [2, 1, 5]
    assert len(read_grid(spark, cdl, eager=True)) == 6


def test_operations_keep_the_grid(spark, cdl, tmp_path):
    f = read_grid(spark, f"file://{cdl}")
    assert (f[["n"]] + 1)[1:3].evaluate().n.tolist() == [3, 5]
    assert f["n"][2:4].to_frame("m").evaluate().m.tolist() == [4, 1]
    assert f["n"].head(2).evaluate().tolist() == [0, 2]
    assert f.drop("tg").rename({"n": "k"})[:2].evaluate().columns.tolist() == ["longitude", "latitude", "k"]
    assert f.groupby("longitude").sum().columns == ["tg", "n"]
    f.to_csv(f"file://{tmp_path}/g.csv")
    assert (tmp_path / "g.csv").read_text().splitlines()[0] == "longitude,latitude,tg,n"
    assert dict((r["column"], r["sum"]) for r in f[["n"]].sum().collect()) == {"n": 15.0}


def test_slices_read_their_range_only(spark, cdl):
    f = read_grid(spark, cdl)
    part = f[1:5][1:3]
    assert part.options["start"] == "2" and part.options["stop"] == "4" and part.evaluate().n.tolist() == [4, 1]
    reader = GridReader(f.df.schema, part.options)
    assert [(p.start, p.stop) for p in reader.partitions()] == [(2, 4)]
    assert f.evaluate().n.tolist() == [0, 2, 4, 1, 3, 5]  # as it was
    assert f[4:99].evaluate().n.tolist() == [3, 5] and f[9:].evaluate().n.tolist() == []


def test_slice_after_a_filter_is_of_the_result(spark, cdl):
    f = read_grid(spark, cdl)
    assert f[f["n"] > 1][1:3].evaluate().n.tolist() == [4, 3]


def grids(folder):
    """Two binary grids with sentinels and a shared shape."""
    dims = {"longitude": 3, "latitude": 4, "time": 70}
    r = np.random.default_rng(1)
    axes = [
        ("longitude", ["longitude"], np.arange(3, dtype="f4"), {}),
        ("latitude", ["latitude"], np.arange(4, dtype="f4") + 50, {}),
        ("time", ["time"], np.arange(70, dtype="i4"), {"units": "days since 1950-01-01 00:00", "calendar": "standard"}),
    ]

    def packed(name, factor, share):
        x = r.integers(-500, 500, (3, 4, 70)).astype("i2")
        x[r.random(x.shape) < share] = -9999
        return name, ["longitude", "latitude", "time"], x, {"scale_factor": np.array([factor], "f4"), "_FillValue": np.array([-9999], "i2")}

    formats.write_classic(f"{folder}/data1.nc", dims, [*axes, packed("tg", 0.01, 0.1), packed("pp", 0.1, 0.1), packed("pp_stderr", 0.1, 0), packed("rr", 0.1, 0.1), packed("rr_stderr", 0.1, 0)])
    formats.write_classic(f"{folder}/data2.nc", dims, [*axes, packed("tn", 0.01, 0), packed("tx", 0.01, 0)])


def test_binary_grid(spark, tmp_path):
    grids(tmp_path)
    f = read_grid(spark, f"{tmp_path}/data1.nc", partition_rows=100)
    assert len(f) == 3 * 4 * 70 and f.df.schema["time"].dataType.simpleString() == "date"
    raw = formats.read_values(f"{tmp_path}/data1.nc", *formats.read_header(f"{tmp_path}/data1.nc"), "tg", np.arange(840))
    assert f.evaluate().tg.to_numpy() == pytest.approx(raw.astype("f4") * np.float32(0.01))
    with pytest.raises(Exception, match="no variable"):
        read_grid(spark, f"{tmp_path}/data1.nc", ["absent"])


def test_hdf5_is_refused(tmp_path):
    (tmp_path / "x.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    with pytest.raises(ValueError, match="HDF5"):
        formats.read_header(str(tmp_path / "x.nc"))


def test_pipeline_against_pandas(spark, tmp_path, capsys):
    grids(tmp_path)
    pipeline.main(["-i", str(tmp_path), "-s", "100:700", "-o", str(tmp_path / "out")])
    marks = [line.split("-", 1)[1] for line in capsys.readouterr().out.splitlines() if line.startswith("#")]
    assert marks == ["done_read", "done_head", "done_agg", "done_groupby"]
    import pandas as pd

    a, b = (read_grid(spark, f"{tmp_path}/data{i}.nc").keyed().df.toPandas() for i in (1, 2))
    keys = ["longitude", "latitude", "time"]
    df = a.merge(b, on=keys).sort_values(keys).reset_index(drop=True)[100:700]
    head = pd.read_csv(tmp_path / "out/head.csv")
    assert len(head) == 10
    df = df[(df.tg != np.float32(-99.99)) & (df.pp != np.float32(-999.9)) & (df.rr != np.float32(-999.9))].drop(columns=["pp_stderr", "rr_stderr"])
    df["abs_diff"] = (df.tx - df.tn).abs()
    got = pd.read_csv(tmp_path / "out/agg.csv").set_index("agg")
    for c in ("tg", "pp", "rr", "tn", "tx", "abs_diff"):
        want = df[c].astype(float).agg(["min", "max", "mean", "std"])
        assert got[c].to_numpy() == pytest.approx(want.to_numpy(), rel=1e-5)
    df["ym"] = [f"{d:%Y%m}" for d in df.time]
    means = df.groupby(["latitude", "longitude", "ym"])[["tg", "tn", "tx", "pp", "rr"]].mean().astype(float).sum()
    grouped = pd.read_csv(tmp_path / "out/grouped.csv").set_index("column").grouped_sum
    assert grouped.to_dict() == pytest.approx({f"{k}_mean": v for k, v in means.items()}, rel=1e-4)
    assert isinstance(a.time[0], datetime.date)


def four_dims(old=False, dense=False, indirect=False, folder="", **storage):
    r = np.random.default_rng(3)
    dims = {"longitude": np.arange(5, dtype="<f4") / 2, "latitude": np.arange(4, dtype="<f4") + 50, "time": np.arange(7, dtype="<i4") + 30}
    values = {n: r.integers(-300, 300, (7, 4, 5)).astype(k) for n, k in (("tg", "<i2"), ("pp", ">i2"), ("n", "<u1"), ("big", "<i8"), ("x", "<f8"), ("y", "<f4"))}
    attrs = {"tg": {"scale_factor": np.float32(0.01), "_FillValue": np.int16(-9999), "units": "Celsius"}, "pp": {"scale_factor": np.array([0.1], "<f4"), "long_name": "pressure"}}
    path = f"{folder}/grid.nc"
    write_netcdf4(path, dims, {n: (v, attrs.get(n, {})) for n, v in values.items()}, old=old, dense=dense, indirect=indirect, **storage)
    return path, dims, values


STORED = [
    {},
    {"dense": True},
    {"dense": True, "indirect": True},
    {"old": True},
    {"chunks": (3, 2, 5)},
    {"chunks": (2, 3, 2), "filters": ("shuffle", "deflate")},
    {"chunks": (7, 4, 5), "filters": ("deflate", "fletcher"), "dense": True},
    {"chunks": (2, 2, 2), "filters": ("shuffle", "deflate"), "old": True},
]


@pytest.mark.parametrize("how", STORED)
def test_netcdf4(tmp_path, how):
    path, dims, values = four_dims(folder=tmp_path, **how)
    form, header = formats.read_header(path)
    assert form == "hdf5" and header.dims == {"longitude": 5, "latitude": 4, "time": 7}
    assert set(header.variables) == {*dims, *values} and header.variables["tg"].dims == ["time", "latitude", "longitude"]
    assert header.variables["tg"].attrs["units"] == "Celsius" and header.variables["tg"].attrs["_FillValue"] == -9999
    assert header.variables["time"].attrs["units"].startswith("days since 1950")
    for name, want in (dims | values).items():
        got = formats.read_values(path, form, header, name, np.arange(want.size))
        assert np.array_equal(got, want.ravel()), name
        some = np.random.default_rng(1).integers(0, want.size, 30)
        assert np.array_equal(formats.read_values(path, form, header, name, some), want.ravel()[some])


def test_netcdf4_frames(spark, tmp_path):
    path, dims, values = four_dims(folder=tmp_path, chunks=(2, 3, 2), filters=("shuffle", "deflate"))
    f = read_grid(spark, path, partition_rows=30)
    assert f.dtypes == {"tg": "float", "pp": "float", "n": "smallint", "big": "bigint", "x": "double", "y": "float"}
    got = f.evaluate()
    want = values["tg"].transpose(2, 1, 0).ravel().astype("f4") * np.float32(0.01)
    assert got.tg.to_numpy() == pytest.approx(want) and got.big.tolist() == values["big"].transpose(2, 1, 0).ravel().tolist()
    assert got.time[0] == datetime.date(1950, 1, 31)
    part = f[13:57].evaluate()
    assert part.x.tolist() == values["x"].transpose(2, 1, 0).ravel()[13:57].tolist()


def test_missing_chunks_are_filled(tmp_path):
    values = np.arange(24, dtype="<i4").reshape(6, 4)
    w = Writer()
    w.save(f"{tmp_path}/x.h5", [("v", w.dataset(values, {}, chunks=(2, 4), fill=-7, skip=(1,)))])
    form, header = formats.read_header(f"{tmp_path}/x.h5")
    assert header.dims == {"phony_6": 6, "phony_4": 4}
    want = values.copy()
    want[2:4] = -7
    assert formats.read_values(f"{tmp_path}/x.h5", form, header, "v", np.arange(24)).tolist() == want.ravel().tolist()


def test_unknown_filters_are_named(tmp_path):
    values = np.arange(24, dtype="<i4").reshape(6, 4)
    w = Writer()
    w.save(f"{tmp_path}/x.h5", [("v", w.dataset(values, {}, chunks=(2, 4), filters=("shuffle",)))])
    form, header = formats.read_header(f"{tmp_path}/x.h5")
    header.variables["v"].data.filters = [(32015, [])]
    with pytest.raises(ValueError, match="filter 32015"):
        formats.read_values(f"{tmp_path}/x.h5", form, header, "v", np.arange(24))


@pytest.mark.parametrize("form", ["classic", "netcdf4", "chunked"])
def test_a_scan_reads_each_byte_once(spark, tmp_path, monkeypatch, form):
    """The declared order of dimensions is the reverse of the stored one."""
    r = np.random.default_rng(5)
    shape = {"longitude": 40, "latitude": 30, "time": 300}
    dims = {d: np.arange(n, dtype="f4" if d != "time" else "i4") for d, n in shape.items()}
    values = r.integers(-300, 300, (300, 30, 40)).astype("i2")
    path = f"{tmp_path}/g.nc"
    if form == "classic":
        formats.write_classic(path, shape, [*[(d, [d], v, {}) for d, v in dims.items()], ("tg", ["time", "latitude", "longitude"], values, {})])
    else:
        write_netcdf4(path, dims, {"tg": (values, {})}, **({"chunks": (50, 15, 40), "filters": ("shuffle", "deflate")} if form == "chunked" else {}))
    f = read_grid(spark, path, partition_rows=60_000)
    read = []
    plain = formats.Store.read_at
    monkeypatch.setattr(formats.Store, "read_at", lambda self, at, n: read.append(n) or plain(self, at, n))

    def scan(options):
        reader = GridReader(f.df.schema, options)
        read.clear()
        batches = [b for p in reader.partitions() for b in reader.read(p)]
        return sum(read), batches

    n, batches = scan(f.options)
    assert len(batches) > 4 and n < 1.2 * values.nbytes + 300_000
    got = np.empty(values.size, "i2")
    for b in batches:
        got[b.column(0).to_numpy()] = b.column(b.schema.get_field_index("tg")).to_numpy()
    assert np.array_equal(got, values.transpose(2, 1, 0).ravel())
    n, batches = scan(f.options | {"start": "0", "stop": "10"})
    assert sum(b.num_rows for b in batches) == 10 and n < values.nbytes / 2 + 300_000
    assert f.head(10).options["stop"] == "10" and f.head(10).evaluate().tg.tolist() == got[:10].tolist()


def test_unread_variables(spark, cdl):
    f = read_grid(spark, cdl)
    assert f.drop("tg").options["variables"] == "n" and f.drop("tg").evaluate().n.tolist() == [0, 2, 4, 1, 3, 5]
    assert f["n"]._rows().columns == ["_row_id", "longitude", "latitude", "n"] and f["n"].sum().first()[0] == 15
    assert (f["n"] + 1)._rows().columns == f.df.columns  # an expression reads what the frame has
    assert f.drop(["tg", "n"]).columns == []
    assert f.subset("latitude", 10, 11).evaluate().n.tolist() == [0, 2, 1, 3]


def test_records_of_classic_files(tmp_path):
    """Record variables lie record by record; a single one is not padded; version 5 counts in 64 bits."""
    import struct

    def text(s, wide):
        return struct.pack(">q" if wide else ">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)

    for version, names in ((1, "ab"), (2, "ab"), (5, "ab"), (1, "a")):
        wide = version == 5
        count = ">q" if wide else ">i"
        head = b"CDF" + bytes([version]) + struct.pack(count, 3)
        head += struct.pack(">i", 10) + struct.pack(count, 2) + text("time", wide) + struct.pack(count, 0) + text("x", wide) + struct.pack(count, 5)
        head += struct.pack(">i", 0) + struct.pack(count, 0) + struct.pack(">i", 11) + struct.pack(count, len(names))
        tail = b""
        width = 10 if len(names) == 1 else 12
        length = len(head) + len(names) * (len(text("a", wide)) + 3 * struct.calcsize(count) + 4 + struct.calcsize(count) + 4 + struct.calcsize(count) + (4 if version == 1 else 8))
        for i, name in enumerate(names):
            head += text(name, wide) + struct.pack(count, 2) + struct.pack(count, 0) + struct.pack(count, 1) + struct.pack(">i", 0) + struct.pack(count, 0)
            head += struct.pack(">i", 3) + struct.pack(count, 12) + struct.pack(">i" if version == 1 else ">q", length + 12 * i)
        assert len(head) == length
        values = {n: (np.arange(15).reshape(3, 5) + 100 * i).astype(">i2") for i, n in enumerate(names)}
        for record in range(3):
            for n in names:
                tail += values[n][record].tobytes().ljust(width, b"\0")
        path = f"{tmp_path}/r{version}{names}.nc"
        with open(path, "wb") as f:
            f.write(head + tail)
        form, header = formats.read_header(path)
        assert form == "classic" and header.dims == {"time": 3, "x": 5}
        for n in names:
            assert formats.read_values(path, form, header, n, np.arange(15)).tolist() == values[n].ravel().tolist()


def test_pipeline_over_netcdf4(spark, tmp_path):
    """The command line gives the same results on compressed netCDF-4 files, stored by time, as on classic ones."""
    for folder in ("classic", "hdf5"):
        (tmp_path / folder).mkdir()
    grids(tmp_path / "classic")
    for i in (1, 2):
        source = str(tmp_path / f"classic/data{i}.nc")
        form, header = formats.read_header(source)
        dims, variables = {}, {}
        for name, v in header.variables.items():
            raw = formats.read_values(source, form, header, name, np.arange(int(np.prod([header.dims[d] for d in v.dims]))))
            raw = raw.astype(raw.dtype.newbyteorder("<"))
            if name in header.dims:
                dims[name] = raw
            else:
                factor = {k: np.asarray(x, "<f4" if k == "scale_factor" else "<i2") for k, x in v.attrs.items()}
                variables[name] = (raw.reshape([header.dims[d] for d in v.dims]).transpose(2, 1, 0), factor)
        write_netcdf4(str(tmp_path / f"hdf5/data{i}.nc"), dims, variables, dense=i == 1, chunks=(20, 4, 2), filters=("shuffle", "deflate"))
    for folder in ("classic", "hdf5"):
        pipeline.main(["-i", str(tmp_path / folder), "-s", "100:700", "-o", str(tmp_path / f"{folder}-out")])
    for name in ("head", "agg", "grouped"):
        assert (tmp_path / f"hdf5-out/{name}.csv").read_text() == (tmp_path / f"classic-out/{name}.csv").read_text()


@pytest.mark.parametrize("form", ["classic", "netcdf4"])
def test_written_grids(spark, cdl, tmp_path, form):
    """What is written is read again; cells without a row are filled."""
    f = read_grid(spark, cdl)
    f[f["n"] != 3].to_grid(f"{tmp_path}/deep/g.nc", form)
    back = read_grid(spark, f"{tmp_path}/deep/g.nc")
    got = back.evaluate()
    assert got.n.tolist() == [0, 2, 4, 1, -2147483647, 5] and back.index == ("longitude", "latitude")
    assert got.longitude.tolist() == [25.5] * 3 + [26.0] * 3 and got.latitude.tolist() == [10, 11, 12] * 2
    with pytest.raises(ValueError, match="no grid file has"):
        back.assign("t", "text").to_grid(f"{tmp_path}/x.nc", form)


def test_checksum():
    assert hdf5.lookup3(b"") == 0xDEADBEEF and hdf5.lookup3(b"Four score and seven years ago") == 0x17770551


def test_convert(spark, tmp_path):
    grids(tmp_path)
    source = f"{tmp_path}/data1.nc"
    convert.main(["-i", source, "-o", f"{tmp_path}/o.csv", "-v", "tg,rr", "-s", "time=1950-01-03:1950-01-04", "-s", "latitude=51:52"])
    import pandas as pd

    got = pd.read_csv(tmp_path / "o.csv")
    assert list(got.columns) == ["longitude", "latitude", "time", "tg", "rr"] and len(got) == 3 * 2 * 2
    assert set(got.time) == {"1950-01-03", "1950-01-04"}
    convert.main(["-i", source, "-o", f"{tmp_path}/o.nc", "-f", "netcdf4", "-s", "time=1950-01-03:1950-01-09"])
    again = read_grid(spark, f"{tmp_path}/o.nc").evaluate()
    want = read_grid(spark, source).subset("time", datetime.date(1950, 1, 3), datetime.date(1950, 1, 9)).evaluate()
    assert again.tg.tolist() == want.tg.tolist() and again.time.tolist() == want.time.tolist()
    convert.convert(spark, source, f"file://{tmp_path}/o.parquet", "parquet", rows=(100, 130))
    assert spark.read.parquet(f"file://{tmp_path}/o.parquet").count() == 30
