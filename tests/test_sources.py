"""Files read in part, in chunks and in splits: headers, checksums, telemetry of unlike files."""

import hashlib
import io
import math

import pandas as pd
import pytest

from blamegrid.sources import ingest, ranged

FILES = {
    "svc_cpu/1": 'time,"svc_cpu", b_mem ,"c,d"\n0,1,x,3\n\n15,"2",nan,"4"\ntime,svc_cpu,b_mem,"c,d"\n30,inf\n45,-1e3,.5,1d,\n',
    "svc_mem/2": "﻿a,time,a\r\n1,5,2\r\n3,,4\r\n",
    "b c+d_loss/1": "time,x\n1,2",
}


@pytest.fixture
def folder(tmp_path):
    for place, text in FILES.items():
        at = tmp_path / place
        at.mkdir(parents=True)
        (at / "simple_metrics.csv").write_bytes(text.encode())
    (tmp_path / "e_cpu" / "1").mkdir(parents=True)
    (tmp_path / "e_cpu" / "1" / "simple_metrics.csv").write_bytes(b"")
    return tmp_path


class Counting(io.BytesIO):
    taken = 0

    def read(self, size=-1):
        got = super().read(size)
        self.taken += len(got)
        return got


def test_first_line_reads_no_more_than_it_needs():
    stream = Counting(b"\n \na,b\n" + b"1,2\n" * 10_000_000)
    assert ranged.first_line(stream) == "a,b" and stream.taken == ranged.HEAD
    wide = ",".join(f"c{k}" for k in range(50_000))
    for size in (1, 7, 1 << 14):
        assert ranged.first_line(io.BytesIO(b"a,b\r\n1,2"), size) == "a,b"
    assert ranged.first_line(io.BytesIO(f"{wide}\n1".encode())) == wide
    assert ranged.first_line(io.BytesIO(b"a,b")) == "a,b"
    assert ranged.first_line(io.BytesIO(b"")) is None and ranged.first_line(io.BytesIO(b"\n \n\n")) is None
    assert ranged.cells('time, "a,b" ,"c""d"') == ["time", "a,b", 'c"d']


def test_stores():
    assert ranged.opens("/a/b") and ranged.opens("file:///a/*/*/c.csv") and not ranged.opens("viewfs://store/a")
    assert ranged._store("file:/a b/c")[1] == "/a b/c"


@pytest.mark.parametrize("direct", [True, False])
def test_headers(spark, folder, monkeypatch, direct):
    monkeypatch.setattr(ranged, "opens", lambda path: direct)
    got = {(r["condition"], r["replicate"]): r["indicators"] for r in ingest.read_headers(spark, str(folder)).collect()}
    assert got == {("svc_cpu", "1"): ["time", "svc_cpu", "b_mem", "c,d"], ("svc_mem", "2"): ["a", "time", "a"], ("b c+d_loss", "1"): ["time", "x"]}


def value(x):
    return None if x is None or math.isnan(x) else x


@pytest.mark.parametrize("sent", [1 << 20, 0])
@pytest.mark.parametrize("direct", [True, False])
def test_telemetry_of_unlike_files(spark, folder, monkeypatch, direct, sent):
    monkeypatch.setattr(ranged, "opens", lambda path: direct)
    rows = ingest.read_telemetry(spark, str(folder), broadcast_bytes=sent, files={"simple_metrics.csv": "metric"}).collect()
    got = sorted(((r["relative"], r["indicator"], r["ts"], r["value"]) for r in rows), key=repr)
    want = [("b c+d_loss/1", "x", 1.0, 2.0), *(("svc_mem/2", n, t, v) for n, t, v in (("a", 5.0, 1.0), ("a.1", 5.0, 2.0), ("a", None, 3.0), ("a.1", None, 4.0)))]
    cells = {0.0: (1.0, None, 3.0), 15.0: (2.0, None, 4.0), 30.0: (math.inf, None, None), 45.0: (-1000.0, 0.5, None)}
    want += [("svc_cpu/1", n, t, v) for t, own in cells.items() for n, v in zip(("svc_cpu", "b_mem", "c,d"), own)]
    assert got == sorted(want, key=repr)


def test_telemetry_agrees_with_pandas_over_many_splits(spark, tmp_path):
    at = tmp_path / "a_cpu" / "1"
    at.mkdir(parents=True)
    wide = pd.DataFrame({"time": range(20_000), "x": [k * 0.5 if k % 7 else None for k in range(20_000)], "y": ["no" if k % 5 == 0 else k for k in range(20_000)]})
    wide.to_csv(at / "logts.csv", index=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = ingest.read_telemetry(spark, str(tmp_path), files={"logts.csv": "log"})
        assert rows.rdd.getNumPartitions() > 10
        got = rows.toPandas().pivot(index="ts", columns="indicator", values="value").sort_index()
        heads = ingest.read_headers(spark, str(tmp_path), "logts.csv")
        assert heads.first()["indicators"] == ["time", "x", "y"] and heads.count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 20_000
    for name in "xy":
        pd.testing.assert_series_equal(got[name].reset_index(drop=True), pd.to_numeric(wide[name], errors="coerce"), check_names=False, check_dtype=False)


@pytest.mark.parametrize("text, why", [("a,b\n1,2\n", "a_cpu/1/logts.csv has no column time"), ("time,b\n1,2\n1,2,3\n", "more cells than its header")])
def test_telemetry_refuses(spark, tmp_path, text, why):
    at = tmp_path / "a_cpu" / "1"
    at.mkdir(parents=True)
    (at / "logts.csv").write_text(text)
    with pytest.raises(Exception, match=why):
        ingest.read_telemetry(spark, str(tmp_path), files={"logts.csv": "log"}).collect()


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    at = tmp_path / "big_cpu" / "1"
    at.mkdir(parents=True)
    size = (1 << 31) + 12345
    with open(at / "simple_metrics.csv", "wb") as stream:
        stream.write(b"time,a_cpu\n")
        stream.truncate(size)  # zeros that take no room
    assert ingest.read_headers(spark, str(tmp_path)).first()["indicators"] == ["time", "a_cpu"]
    row = ingest.checksums(spark, str(at)).first()
    want, zeros, left = hashlib.sha256(b"time,a_cpu\n"), bytes(1 << 24), size - 11
    while left:
        want.update(zeros[: min(left, len(zeros))])
        left -= min(left, len(zeros))
    assert row["length"] == size and row["sha256"] == want.hexdigest()


@pytest.mark.parametrize("direct", [True, False])
def test_checksums(spark, folder, monkeypatch, direct):
    monkeypatch.setattr(ranged, "opens", lambda path: direct)
    got = {r["path"].rsplit("/", 2)[1]: (r["length"], r["sha256"]) for r in ingest.checksums(spark, str(folder / "svc_cpu")).collect()}
    text = FILES["svc_cpu/1"].encode()
    assert got == {"1": (len(text), hashlib.sha256(text).hexdigest())}


def test_quoted_cells_of_wide_lines(spark):
    wide = ",".join(['"1,5"', *[f'"{k}"' for k in range(20_000)]])
    lines = ['"a,b",c', ',"",', 'a "b",c', '"a""b" , c', '"open,c', wide]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string").orderBy("k").select(ingest.F.transform(ingest._cells(ingest.F.col("line")), ingest._bare)).collect()]
    assert got[:5] == [["a,b", "c"], ["", "", ""], ["a \"b", "c"], ['a"b', "c"], ["open", "c"]]
    assert got[5] == ["1,5", *map(str, range(20_000))]
