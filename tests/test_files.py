"""Files read and written in ranges: against zlib, plain models of the format, and single-file ways of doing the same."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import api
from pointloom import constants as C
from pointloom.functions.arrays import pick_numbers, ranks_in
from pointloom.operators import in_order, many, problems
from pointloom.operators.ordering import global_index
from pointloom.scratch import materialize
from pointloom.sources import checksum, files, listing
from pointloom.sources.pos import POINT_BYTES
from pointloom.sources.preview import PreviewReader, PreviewWriter, Written
from pointloom.sources.ranges import Ranges

from .test_preview import SCHEMA, cloud, model, synthetic


def points_frame(spark, array, parts=5):
    rows = [(i, *map(float, p)) for i, p in enumerate(array)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """2,000 points as a folder of parts, with the points."""
    array = synthetic(2000)
    path = tmp_path_factory.mktemp("clouds") / "points"
    api.write_pos(points_frame(spark, array), str(path))
    return path, array


def test_crc_of_random_cuts():
    rng = random.Random(4)
    for _ in range(60):
        data = rng.randbytes(rng.randint(0, 3000))
        cuts = sorted(rng.randint(0, len(data)) for _ in range(rng.randint(0, 8)))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        assert checksum.joined((zlib.crc32(p), len(p)) for p in parts) == (zlib.crc32(data), len(data))
        after, whole = len(data), 0
        for p in parts:
            after -= len(p)
            whole ^= checksum.moved(zlib.crc32(p), after)
        assert whole == zlib.crc32(data)


def test_crc_of_four_gigabytes():
    block, crc = bytes(1 << 24), 0
    for _ in range(256):
        crc = zlib.crc32(block, crc)
    assert checksum.joined([(zlib.crc32(block), len(block))] * 256) == (crc, 1 << 32)


def test_ranks_and_picks_as_columns_say(spark):
    from pointloom.functions.expressions import pick_number

    rng = np.random.default_rng(2)
    bins, seen = rng.integers(0, 4, 500), np.array([3, 0, 7, 1])
    want, before = [], seen.copy()
    for b in bins:
        want.append(before[b])
        before[b] += 1
    assert ranks_in(bins, seen).tolist() == want and (seen == before).all()
    rows = [(r, n, t) for n in (1, 2, 7, 50) for t in (0, 1, 2, 5, 7, 50) if t <= n for r in range(n)]
    told = spark.createDataFrame(rows, "r long, n long, t long").select("r", "n", "t", pick_number(F.col("r"), F.col("n"), F.col("t")).alias("k")).collect()
    own = pick_numbers(*(np.array(x) for x in zip(*[(x["r"], x["n"], x["t"]) for x in told], strict=True)))
    assert own.tolist() == [-1 if x["k"] is None else x["k"] for x in told]


@pytest.mark.parametrize(("split", "limit"), [(160, 333), *((s, n) for s in (1600, 1 << 20) for n in (1, 333, 1999, 5000))])
def test_preview_of_files_is_the_models(spark, folder, tmp_path, split, limit):
    path, array = folder
    points = in_order.PointFiles(spark, str(path), split)
    spectra = materialize(points.spectra(), "spectra")
    found = in_order.summary_of(spectra)
    by = in_order.plan(found, limit)
    api._write_preview(points.pick(spectra, by), found, by, str(tmp_path / "p"), limit)
    assert (tmp_path / "p").read_bytes() == model(array, limit)


def test_points_are_not_shuffled(spark, folder):
    points = in_order.PointFiles(spark, str(folder[0]))
    spectra = materialize(points.spectra(), "spectra")
    picked = points.pick(spectra, in_order.plan(in_order.summary_of(spectra), 100))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    # all that is read below the exchanges is counts by bin; points come from the task above them
    assert plan.index("MapInArrow") < plan.index("Exchange") and "ReadSchema: struct<piece:bigint,bin:int,n:bigint>" in plan and plan.count("Scan") == 1
    assert "Exchange" not in points.sample(10)._jdf.queryExecution().executedPlan().toString()


def test_bad_point_files(spark, tmp_path):
    (tmp_path / "a.pos").write_bytes(b"x" * 17)
    with pytest.raises(ValueError, match="four 32-bit floats"):
        in_order.PointFiles(spark, str(tmp_path / "a.pos"))
    array = synthetic(50)
    array[31, 2] = np.nan
    array[44, 0] = np.inf
    (tmp_path / "b.pos").write_bytes(array.astype(">f4").tobytes())
    with pytest.raises(ValueError, match="first at point 31"):
        api.pick_pos(spark, str(tmp_path / "b.pos"), 5)
    (tmp_path / "c.pos").write_bytes(np.full((3, 4), np.nan, ">f4").tobytes())
    with pytest.raises(ValueError, match="first at point 0"):
        api.pick_pos(spark, str(tmp_path / "c.pos"), 5)


def test_strided_sample(spark, folder):
    path, array = folder
    for take in (1, 7, 1999, 2000, 9999):
        got = sorted(api.sample_pos(spark, str(path), take).collect())
        n = min(take, 2000)
        at = [int((i + 0.5) * 2000 / n) for i in range(n)]
        assert [(r["sample_index"], r["point_index"]) for r in got] == list(enumerate(at))
        assert np.array_equal(np.array([[r[c] for c in ("x", "y", "z", "mass")] for r in got], np.float32), array[at])


class Counting:
    """A file that tells how many bytes are read of it."""

    def __init__(self, inner, told):
        self.inner, self.told = inner, told

    def read_at(self, n, offset):
        self.told.append(n)
        return self.inner.read_at(n, offset)

    def close(self):
        self.inner.close()


def test_strided_reads_are_in_proportion(tmp_path, monkeypatch):
    array = np.arange(400_000, dtype=">f4").reshape(-1, 4)
    for name, part in (("a", array[:30_000]), ("b", array[30_000:])):
        (tmp_path / f"{name}.pos").write_bytes(part.tobytes())
    told, opened = [], files.opened

    def counted(path):
        store, inner = opened(path)

        class Store:
            def open_input_file(self, p):
                return Counting(store.open_input_file(p), told)

        return Store(), inner

    ranges = Ranges(files.listed(str(tmp_path), ".pos"), POINT_BYTES, 1 << 20)
    monkeypatch.setattr(files, "opened", counted)
    places = np.floor((np.arange(100) + 0.5) * 100_000 / 100).astype(np.int64)
    data = in_order.strided(ranges, places, 4096)
    assert np.frombuffer(data, ">f4").reshape(-1, 4)[:, 0].tolist() == (4.0 * places).tolist()
    assert sum(told) == 1600
    told.clear()
    close = np.arange(29_990, 30_010)
    assert np.frombuffer(in_order.strided(ranges, close, 4096), ">f4")[::4].tolist() == (4.0 * close).tolist()
    assert told == [160, 160]


def test_pieces_of_a_table(spark):
    array = synthetic(3000)
    rows = points_frame(spark, array, 7)
    whole = global_index(rows.select("point_index", "x", "y", "z", "mass").withColumnRenamed("point_index", "at"), ["at"], ["x", "y", "z", "mass"], piece="piece")
    spectra = materialize(in_order.spectra_of(whole), "spectra")
    by = in_order.plan(in_order.summary_of(spectra), 400)
    got = {(r["record_index"], r["point_index"]) for r in in_order.pick_pieces(whole, spectra, by).collect()}
    from pointloom.operators import sample, spectrum

    want = sample.pick(rows, sample.allocate(spectrum.histogram(rows), 400))
    assert got == {(r["record_index"], r["point_index"]) for r in want.collect()}
    shuffled = whole.repartition(3, "mass")
    with pytest.raises(Exception, match="don't come in order"):
        in_order.pick_pieces(shuffled, spectra, by).count()


def test_ranks_of_a_table_and_of_files(spark, folder):
    path, array = folder
    bins = np.clip(np.floor(array[:, 3].astype(float) / 0.05), 0, 5999).astype(int)
    seen, want = {}, {}
    for i, b in enumerate(bins.tolist()):
        want[i] = (b, seen.get(b, 0))
        seen[b] = want[i][1] + 1
    rows = global_index(points_frame(spark, array).withColumnRenamed("point_index", "at"), ["at"], ["x", "y", "z", "mass"], piece="piece")
    spectra = materialize(in_order.spectra_of(rows), "spectra")
    for got in (api.rank_pos(spark, str(path)), in_order.rank_pieces(rows, spectra)):
        assert {r["point_index"]: (r["bin"], r["rank"]) for r in got.collect()} == want


def test_tables_in_the_order_of_columns(spark, tmp_path):
    array = synthetic(1500)
    rows = points_frame(spark, array).withColumnRenamed("point_index", "name")
    api.encode_ordered(rows, ["name"], str(tmp_path / "a"), 200)
    assert (tmp_path / "a").read_bytes() == model(array, 200)


def test_many_counts_are_ranked_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(in_order, "MOST_COUNTS", 10)
    rows = points_frame(spark, synthetic(500)).withColumn("piece", F.lit(0).cast("long"))
    spectra = materialize(in_order.spectra_of(rows), "spectra")
    by = in_order.plan(in_order.summary_of(spectra), 90)
    assert sorted(r["record_index"] for r in in_order.pick_pieces(rows, spectra, by).collect()) == list(range(90))
    assert in_order.rank_pieces(rows, spectra).count() == 500


@pytest.fixture(scope="module")
def preview(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("preview") / "a.preview"
    api.encode(points_frame(spark, synthetic(2000)), str(path), 700)
    return path


def test_only_wanted_records_are_read(spark, preview):
    whole = api.decode(spark, str(preview), False).toPandas()
    for bins, span, kept in (
        ((0, 599), None, whole.bin <= 599),
        ((560, 2399), None, whole.bin.between(560, 2399)),
        ((559, 559), None, whole.bin == 559),
        (None, (651, 699), whole.record_index > 650),
        ((0, 600), (10, 12), whole.record_index.between(10, 12)),
        ((7, 3), None, whole.bin < 0),
        ((5999, 9000), (0, 10**12), whole.bin == 5999),
        ((-5, 0), None, whole.bin == 0),
    ):
        rows = api.decode(spark, str(preview), False, bins, span)
        assert sorted(r["record_index"] for r in rows.collect()) == sorted(whole[kept].record_index), (bins, span)
        options = {"path": str(preview), "verify_checksum": "false"} | {k: f"{v[0]}:{v[1]}" for k, v in (("bins", bins), ("records", span)) if v}
        # ranges of records, 8 bytes each, are all that tasks read
        assert sum(p.count for p in PreviewReader("points", options).partitions()) == kept.sum()
    low, high = 27.93, 56.01
    near = api.decode(spark, str(preview), False, api.bins_of(low, high)).toPandas()
    assert near.mass.between(low, high).sum() == whole.mass.between(low, high).sum() and len(near) < 600


def test_a_dataframe_gives_the_same_rows_again(spark, preview):
    """Filters must not stay with a DataFrame, as pushed ones do in Spark 4.1."""
    rows = api.decode(spark, str(preview), False)
    assert rows.where("bin < 0").count() == 0 and rows.count() == 700 and rows.where("bin < 0 or record_index < 3").count() == 3


def test_bins_are_those_of_the_points(spark, preview):
    true, stored = zip(*[(r["true_count"], r["stored_count"]) for r in sorted(api.spectrum_counts(spark, str(preview)).collect())], strict=True)
    found = {r["bin"]: r["count"] for r in api.records(spark, str(preview)).groupBy("bin").count().collect()}
    assert found == {b: n for b, n in enumerate(stored) if n} and sum(true) == 2000


def test_writer_places_records(tmp_path, monkeypatch):
    import pyarrow as pa

    from pointloom.sources import preview as P

    attempts = iter(range(99))

    class Task:
        partitionId = staticmethod(lambda: 3)
        taskAttemptId = staticmethod(lambda: next(attempts))

    monkeypatch.setattr(P.TaskContext, "get", classmethod(lambda cls: Task))
    spectra = np.zeros((2, C.SPECTRUM_BINS), "<u4")
    spectra[:, 0] = 6  # six points, all kept
    options = {"path": str(tmp_path / "out"), "spectra": zlib.compress(spectra.tobytes()).hex(), "n": "6", "low": "0x0p+0,0x0p+0,0x0p+0", "high": "0x1p+0,0x1p+0,0x1p+0", "max_points": "9"}
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), *[pa.array(range(10 * a, 10 * b, 10), pa.int32())] * 4], names=["record_index", "qx", "qy", "qz", "qm"])
    for placed in (True, False):
        writer = PreviewWriter(options)
        writer.target = writer.target if placed else None
        parts = [writer.write(iter([batch(4, 6)])), writer.write(iter([batch(0, 1), batch(1, 4)])), writer.write(iter([])), None]
        if placed:
            parts[1] = writer.write(iter([batch(0, 4)]))  # a task that runs again
        writer.commit(parts)
        header = api.inspect(str(tmp_path / "out"))
        assert header.stored_point_count == 6
        assert np.frombuffer((tmp_path / "out").read_bytes()[C.RECORDS_OFFSET :], "<u2").reshape(-1, 4)[:, 2].tolist() == [0, 10, 20, 30, 40, 50]
        assert os.listdir(tmp_path) == ["out"]
    writer = PreviewWriter(options)
    with pytest.raises(ValueError, match="don't follow"):
        writer.write(iter([batch(0, 2), batch(3, 4)]))
    with pytest.raises(ValueError, match="missing"):
        writer.commit([Written(0, 2, 0, ""), Written(3, 3, 0, "")])
    writer.abort([None])
    elsewhere = writer.write(iter([batch(2, 6)]))
    os.remove(writer.target)  # as if it had been written on another machine
    with pytest.raises(ValueError, match="share"):
        writer.commit([writer.write(iter([batch(0, 2)])), elsewhere])
    writer.abort([elsewhere])
    assert os.listdir(tmp_path) == ["out"]


@pytest.fixture(scope="module")
def many_previews(spark, tmp_path_factory):
    """A preview for each of nine clouds, one of them with most of the points, of a table."""
    rng = np.random.default_rng(6)
    array = synthetic(4000)
    key = np.where(rng.random(4000) < 0.6, 0, rng.integers(0, 9, 4000))
    rows = [(int(k), i, *map(float, p)) for i, (k, p) in enumerate(zip(key, array, strict=True))]
    table = spark.createDataFrame(rows, "cloud int, " + SCHEMA).repartition(6)
    folder = tmp_path_factory.mktemp("many") / "previews"
    written = api.encode_each(table, ["cloud"], str(folder), 150)
    return folder, written, {k: array[key == k] for k in range(9)}


def test_many_clouds_are_encoded_like_one(many_previews):
    folder, written, arrays = many_previews
    rows = written.collect()
    assert len(rows) == 9 == len(os.listdir(folder))
    for r in rows:
        data = open(r["path"], "rb").read()
        assert data == model(arrays[r["cloud"]], 150)
        assert (r["original_point_count"], r["stored_point_count"], r["file_size"]) == (len(arrays[r["cloud"]]), min(150, len(arrays[r["cloud"]])), len(data))


def test_null_keys_and_odd_clouds(spark, tmp_path):
    rows = [(None, "a/b", 0, 1.0, 2.0, 3.0, 4.0), (None, "a/b", 1, 1.0, 2.0, 3.0, 400.0), (1, None, 0, 0.0, 0.0, 0.0, -1.0)]
    table = spark.createDataFrame(rows, "k int, name string, " + SCHEMA)
    got = {(r["k"], r["name"]): r["stored_point_count"] for r in api.encode_each(table, ["k", "name"], str(tmp_path / "x"), 5).collect()}
    assert got == {(None, "a/b"): 2, (1, None): 1}
    assert api.encode_each(table.limit(0), ["k"], str(tmp_path / "y"), 5).count() == 0
    bad = table.withColumn("x", F.when(F.col("k") == 1, float("nan")).otherwise(F.col("x")))
    with pytest.raises(ValueError, match="first at point 0"):
        api.encode_each(bad, ["k"], str(tmp_path / "z"), 5)
    with pytest.raises(ValueError, match="other names"):
        api.encode_each(table.withColumnRenamed("name", "path"), ["path"], str(tmp_path / "z"), 5)
    with pytest.raises(ValueError, match="one by one"):
        api.encode_each(table, ["k"], str(tmp_path / "z"), many.MOST_TOGETHER + 1)


def test_listed_previews(spark, many_previews, tmp_path):
    import shutil

    folder, written, _ = many_previews
    copy = tmp_path / "copy"
    shutil.copytree(folder, copy)
    names = sorted(os.listdir(copy))
    spoil = {0: lambda d: d[:100], 1: lambda d: d[:-1] + bytes([d[-1] ^ 4]), 2: lambda d: b"XPOS" + d[4:], 3: lambda d: d[:128] + bytes(24000) + d[24128:], 4: lambda d: d + b"1"}
    for i, f in spoil.items():
        (copy / names[i]).write_bytes(f((copy / names[i]).read_bytes()))
    found = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in api.checked_previews(spark, str(copy)).collect()}
    wanted = {}
    for name in names:
        try:
            header = api.inspect(str(copy / name))
            from pointloom.sources.preview import read_spectra

            read_spectra(str(copy / name), header)
            wanted[name] = None
        except ValueError as e:
            wanted[name] = str(e)
    # the spectra are read before the CRC is taken
    assert wanted.pop(names[3]).startswith("checksum") and found.pop(names[3]).startswith("original spectrum")
    assert found == wanted and sum(v is not None for v in found.values()) == 4
    with pytest.raises(ValueError, match=names[0]):
        api.scan_previews(spark, str(copy))
    points = api.scan_previews(spark, str(folder), section="records").toPandas()
    assert len(points) == sum(r["stored_point_count"] for r in written.collect())
    low = api.scan_previews(spark, str(folder), bins=(0, 599)).toPandas()
    assert len(low) == (points.bin < 600).sum() and low.bin.max() < 600


def test_crc_before_any_row(spark, preview, tmp_path):
    assert api.decode(spark, str(preview), "first").count() == 700
    data = preview.read_bytes()
    (tmp_path / "bad").write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(ValueError, match="checksum mismatch"):
        api.records(spark, str(tmp_path / "bad"), "first")
    (tmp_path / "worse").write_bytes(data[:90])
    with pytest.raises(ValueError, match="bad: checksum mismatch"):  # the first by name
        api.decode(spark, str(tmp_path), "first")


def test_crc_by_small_splits(spark, many_previews):
    folder = many_previews[0]
    heads = materialize(listing.read_headers(listing.list_files(spark, str(folder)), files_each=2), "heads")
    assert {r["problem"] for r in listing.check_payloads(heads, step=999).collect()} == {None}


def test_paired_files(spark, folder, tmp_path):
    path, array = folder
    api.encode_pos(spark, str(path), str(tmp_path / "p.preview"), 300)
    api.write_pos(api.pick_pos(spark, str(path), 300), str(tmp_path / "behind"), order="record_index")
    both = api.paired(spark, str(tmp_path / "behind"), str(tmp_path / "p.preview"), split=640)
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    rows = sorted(both.collect())
    assert [r["record_index"] for r in rows] == list(range(300))
    box = array[:, :3].max(0) - array[:, :3].min(0)
    assert all(abs(r[a] - r[f"d{a}"]) <= e / 65535 for r in rows for a, e in zip("xyz", box, strict=True))
    assert all(r["bin"] == min(max(int(np.float64(np.float32(r["mass"])) / 0.05), 0), 5999) for r in rows)
    with pytest.raises(ValueError, match="doesn't hold"):
        api.paired(spark, str(path), str(tmp_path / "p.preview"))


def test_problem_columns_say_what_is_raised(spark):
    from pointloom.operators import sample

    limits = [0, -3, 1, C.UINT32_MAX, C.UINT32_MAX + 1]
    told = spark.createDataFrame([(x,) for x in limits], "v long").select("v", problems.limit_problem(F.col("v")).alias("limit"), problems.size_problem(F.col("v")).alias("size")).collect()
    for r in told:
        for check, said in ((sample.check_limit, r["limit"]), (sample.check_size, r["size"])):
            try:
                check(r["v"])
                assert said is None
            except ValueError as e:
                assert said == str(e)
    empty = problems.check_clouds(cloud(spark, []).withColumn("k", F.lit(1)), ["k"], spark.createDataFrame([(1, 5)], "k int, max_points long")).collect()
    assert [r["problem"] for r in empty] == ["an empty point cloud cannot be encoded"]
