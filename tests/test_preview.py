"""Previews against hand-worked goldens, round trips, mutated files, and a plain model of the format."""

import json
import math
import struct
import zlib

import numpy as np
import pytest

from pointloom import api
from pointloom import constants as C
from pointloom.operators import quality_metrics, sample, spectrum
from pointloom.sources.preview import inspect_file

TEN = [(0, 0, 5, 27.98), (1, -1, 5, 27.98), (2, 1, 5, 27.98), (3, 0.5, 5, 27.98), (4, -0.5, 5, 55.94), (0.5, 0.25, 5, 55.94), (1.5, 0.75, 5, 119), (2.5, -0.25, 5, 421.5), (3.5, 0, 5, 300), (0.25, 0, 5, -2)]
SCHEMA = "point_index long, x float, y float, z float, mass float"


def cloud(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], SCHEMA)


def encoded(spark, points, path, limit):
    api.encode(cloud(spark, points) if isinstance(points, list) else points, str(path), limit)
    return path.read_bytes()


def model(points, limit):
    """The format by plain numpy and whole-number arithmetic."""
    array = np.asarray(points, np.float32)
    low, high = array[:, :3].min(0).astype(float), array[:, :3].max(0).astype(float)
    bins = np.clip(np.floor(array[:, 3].astype(float) / 0.05), 0, 5999).astype(int)
    true = np.bincount(bins, minlength=6000)
    n = len(array)
    take = [int(c) for c in true]
    if n > limit:
        take = [int(c) * limit // n for c in true]
        order = sorted(np.flatnonzero(true), key=lambda b: (-(int(true[b]) * limit % n), b))
        for b in order[: limit - sum(take)]:
            take[b] += 1
    records = []
    for b in np.flatnonzero(take):
        rows = np.flatnonzero(bins == b)
        for k in range(take[b]):
            p = array[rows[math.floor((k + 0.5) * len(rows) / take[b])]].astype(float)
            lo, hi = [*low, 0.0], [*high, 300.0]
            records.append([min(max(math.floor((v - a) / (z - a if z > a else 1.0) * 65535.0 + 0.5), 0), 65535) for v, a, z in zip(p, lo, hi, strict=True)])
    body = true.astype("<u4").tobytes() + np.array(take, "<u4").tobytes() + np.array(records, "<u2").tobytes()
    head = struct.pack("<4s6H5I3f6f6I", b"CPOS", 1, 0, 1, 0, 0, 128, 0x01020304, 1, n, len(records), 6000, 0.0, 0.05, 300.0, *low, *high, 128, 24128, 48128, 128 + len(body), zlib.crc32(body), limit)
    return head.ljust(128, b"\0") + body


def synthetic(n, seed=7):
    rng = np.random.default_rng(seed)
    xyz = rng.normal(size=(n, 3)) * [12, 8, 35] + [4, 0, 80]
    mass = rng.choice([6, 27.98, 55.94, 119, 421.5], n, p=[0.54, 0.23, 0.12, 0.08, 0.03]) + rng.normal(0, 0.035, n)
    return np.column_stack([xyz, mass]).astype(np.float32)


def test_ten_points(spark, tmp_path):
    data = encoded(spark, TEN, tmp_path / "a" / "ten.preview", 4)
    assert data[:96].hex() == "43504f5301000000010000000000800004030201010000000a000000040000007017000000000000cdcc4c3d0000964300000000000080bf0000a040000080400000803f0000a04080000000405e000000bc000020bc0000a4034eb704000000"
    assert data[96:128] == bytes(32) and len(data) == 48160
    assert data[48128:].hex() == "004000000000e017ffbfffbf0000e0170020ff9f0000bc2fffdf00800000ffff"
    assert data == model(TEN, 4)
    points = [tuple(r)[1:5] for r in api.decode(spark, str(tmp_path / "a" / "ten.preview")).orderBy("record_index").collect()]
    assert points == [(1.0000152587890625, -1, 5, 27.97894287109375), (2.9999847412109375, 0.49999237060546875, 5, 27.97894287109375), (0.5000076293945312, 0.24998855590820312, 5, 55.9395751953125), (3.4999923706054688, 1.5259021893143654e-05, 5, 300)]
    counts = {r["bin"]: (r["true_count"], r["stored_count"]) for r in api.spectrum_counts(spark, str(tmp_path / "a" / "ten.preview")).where("true_count > 0").collect()}
    assert counts == {0: (1, 0), 559: (4, 2), 1118: (2, 1), 2380: (1, 0), 5999: (2, 1)}


@pytest.mark.parametrize("limit", [10, 499_000, 1])
def test_limits(spark, tmp_path, limit):
    assert encoded(spark, TEN, tmp_path / "x.preview", limit) == model(TEN, limit)


def test_single_point(spark, tmp_path):
    assert encoded(spark, [(1, 2, 3, 4)], tmp_path / "x.preview", 5) == model([(1, 2, 3, 4)], 5)


def test_synthetic_bytes_and_quality(spark, tmp_path):
    points = synthetic(30_000)
    frame = spark.createDataFrame(__import__("pandas").DataFrame(points, columns=["x", "y", "z", "mass"]).reset_index(names="point_index"), SCHEMA).repartition(7)
    data = encoded(spark, frame, tmp_path / "s.preview", 4999)
    assert data == model(points, 4999)
    header = inspect_file(str(tmp_path / "s.preview"))
    assert (header.original_point_count, header.stored_point_count, header.file_size) == (30_000, 4999, len(data))
    counts = api.spectrum_counts(spark, str(tmp_path / "s.preview"))
    assert quality_metrics.total_variation(counts).first()[0] < 0.01
    kept = sample.pick_by_spectrum(frame, counts)
    both = kept.join(api.decode(spark, str(tmp_path / "s.preview")).withColumnsRenamed({c: f"d{c}" for c in ("x", "y", "z", "mass")}), "record_index")
    error = quality_metrics.roundtrip_error(both).first()
    assert error["n"] == 4999 and max(error["x_error"], error["y_error"], error["z_error"], error["mass_error"]) < 0.01


def test_analytic_cloud(spark):
    i = np.arange(20_000)
    mass = np.where(i % 10 < 7, 27.98, np.where(i % 10 < 9, 55.94, 119.0)) + (i % 7 - 3) * 0.004
    points = np.column_stack([20 * np.sin(0.013 * i), 15 * np.cos(0.007 * i), 0.002 * i, mass]).astype(np.float32)
    frame = spark.createDataFrame(__import__("pandas").DataFrame(points, columns=["x", "y", "z", "mass"]).reset_index(names="point_index"), SCHEMA)
    got = {r["bin"]: (r["true_count"], r["take"]) for r in sample.allocate(spectrum.histogram(frame), 4999).collect()}
    assert got == {559: (14000, 3499), 1118: (3428, 857), 1119: (572, 143), 2379: (858, 215), 2380: (1142, 285)}


@pytest.mark.parametrize("counts, limit, takes", [([5, 3, 2], 4, [2, 1, 1]), ([1, 1, 1], 2, [1, 1, 0]), ([4, 0, 2], 9, [4, 0, 2])])
def test_allocation(spark, counts, limit, takes):
    frame = spark.createDataFrame(list(enumerate(counts)), "bin int, true_count long")
    assert [r["take"] for r in sample.allocate(frame, limit).orderBy("bin").collect()] == takes
    assert sample.allocate_counts(dict(enumerate(counts)), limit) == dict(enumerate(takes))


def test_midpoints(spark):
    frame = spark.createDataFrame([(0, 10, 4), (1, 7, 3), (2, 100, 7), (3, 3, 3)], "bin int, true_count long, take long")
    got = {}
    for r in sample.midpoints(frame).orderBy("bin", "k").collect():
        got.setdefault(r["bin"], []).append(r["rank"])
    assert got == {0: [1, 3, 6, 8], 1: [1, 3, 5], 2: [7, 21, 35, 50, 64, 78, 92], 3: [0, 1, 2]}


def test_pick_number_finds_every_midpoint(spark):
    from pyspark.sql import functions as F

    from pointloom.functions.expressions import midpoint, pick_number

    cases = [(c, t) for c in [*range(1, 40), 999, 12345] for t in {1, 2, c // 3, c // 2, c - 1, c} if 1 <= t <= c]
    frame = spark.createDataFrame(cases, "c long, t long")
    picks = frame.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1)))
    wrong = picks.withColumn("r", midpoint(F.col("k"), F.col("c"), F.col("t"))).where(~F.coalesce(pick_number(F.col("r"), F.col("c"), F.col("t")) == F.col("k"), F.lit(False)))
    assert wrong.count() == 0
    ranks = frame.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    assert ranks.where(pick_number(F.col("r"), F.col("c"), F.col("t")).isNotNull()).count() == sum(t for _, t in cases)


def test_rank_in_parts_equals_plain_rank(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    frame = spark.range(5000).select(F.col("id").alias("point_index"), *[F.lit(0.0).cast("float").alias(c) for c in "xyz"], F.when(F.col("id") % 10 < 7, 6.0).otherwise(F.col("id") % 50).cast("float").alias("mass"))
    got = sample.rank_in_bin(frame, part=64)
    plain = F.row_number().over(Window.partitionBy("bin").orderBy("point_index")) - 1
    assert got.withColumn("plain", plain).where("plain != rank").count() == 0 and got.count() == 5000


def test_pos_files(spark, tmp_path):
    points = synthetic(5000)
    (tmp_path / "b.POS").write_bytes(points.astype(">f4").tobytes())
    (tmp_path / "a.pos").write_bytes(points[:7].astype(">f4").tobytes())
    (tmp_path / "note.txt").write_text("not points")
    assert api.read_pos(spark, str(tmp_path / "b.POS")).count() == 5000
    both = api.read_pos(spark, str(tmp_path)).orderBy("point_index").collect()
    assert len(both) == 5007 and tuple(both[9])[1:] == tuple(map(float, points[2]))
    api.write_pos(api.read_pos(spark, str(tmp_path / "b.POS")).repartition(5), str(tmp_path / "new" / "c.pos"))
    assert (tmp_path / "new" / "c.pos").read_bytes() == points.astype(">f4").tobytes()
    assert [p.name for p in (tmp_path / "new").iterdir()] == ["c.pos"]


def test_pos_folder(spark, tmp_path):
    """A path without .pos is a folder of parts, in order, with nothing else in it."""
    points = synthetic(5000)
    (tmp_path / "b.pos").write_bytes(points.astype(">f4").tobytes())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        api.write_pos(api.read_pos(spark, str(tmp_path / "b.pos")).repartition(5), str(tmp_path / "new" / "parts"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(p.name for p in (tmp_path / "new" / "parts").iterdir())
    assert len(names) > 1 and all(n.startswith("part-") and n.endswith(".pos") for n in names)
    assert b"".join((tmp_path / "new" / "parts" / n).read_bytes() for n in names) == points.astype(">f4").tobytes()
    got = api.read_pos(spark, str(tmp_path / "new" / "parts")).orderBy("point_index").collect()
    assert len(got) == 5000 and tuple(got[4321])[1:] == tuple(map(float, points[4321]))
    with pytest.raises(Exception, match="has files already"):
        api.write_pos(api.read_pos(spark, str(tmp_path / "b.pos")), str(tmp_path / "new" / "parts"))


def test_clouds_as_bytes(spark):
    data = np.array(TEN, ">f4").tobytes()
    rows = spark.createDataFrame([(1, data), (2, None), (3, b""), (4, data[:32])], "cloud int, data binary")
    got = api.points_of(rows)
    assert sorted((r["cloud"], r["point_index"], r["mass"]) for r in got.collect()) == [(c, i, float(np.float32(TEN[i][3]))) for c, n in ((1, 10), (4, 2)) for i in range(n)]
    back = {r["cloud"]: bytes(r["data"]) for r in api.bytes_of(got.repartition(4), ["cloud"]).collect()}
    assert back == {1: data, 4: data[:32]}
    with pytest.raises(Exception, match="four 32-bit floats"):
        api.points_of(spark.createDataFrame([(1, data[:15])], "cloud int, data binary")).collect()


def test_digests_by_whole_path(spark, tmp_path):
    """Files of one name in two folders, one larger than what is read at once."""
    import hashlib

    want = {}
    for folder, data in (("a", b"x" * 3_000_001), ("b", b"y")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f").write_bytes(data)
        want[str(tmp_path / folder / "f")] = (len(data), hashlib.sha256(data).hexdigest(), hashlib.md5(data).hexdigest())
    assert {r["path"]: tuple(r)[1:] for r in api.digests(spark, list(want)).collect()} == want


def test_visible_bins(spark):
    """The last bin that a mass limit shows, by the quotient rounded up."""
    from pyspark.sql import functions as F

    from pointloom.operators import view

    rows = spark.range(100).select(F.col("id").cast("int").alias("bin"), F.lit(1).alias("true_count"), F.lit(1).alias("stored_count"))
    for limit in (1.1, 1.0, 0.3):
        seen = view.spectrum_view(rows, 100, limit).agg(F.max("true_peak")).first()[0]
        assert seen == 1 and view.spectrum_view(rows.where(F.col("bin") >= math.ceil(limit / 0.05)), 100, limit).agg(F.max("true_peak")).first()[0] == 0


@pytest.mark.parametrize("data", [b"", bytes(15), struct.pack(">4f", 1, 2, 3, math.nan), struct.pack(">4f", math.inf, 2, 3, 4)])
def test_bad_pos_files(spark, tmp_path, data):
    (tmp_path / "a.pos").write_bytes(data)
    with pytest.raises(Exception, match="non-empty|non-finite"):
        api.read_pos(spark, str(tmp_path / "a.pos")).collect()


@pytest.mark.parametrize("limit", [0, -1, 2**32, 5.0, True, "5"])
def test_bad_limits(spark, tmp_path, limit):
    with pytest.raises(ValueError, match="max_points"):
        api.encode(cloud(spark, TEN), str(tmp_path / "x"), limit)


def test_bad_clouds(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        api.encode(cloud(spark, []), str(tmp_path / "x"))
    with pytest.raises(ValueError, match="non-finite values, first at point 2"):
        api.encode(cloud(spark, [(1, 1, 1, 1), (2, 2, 2, 2), (3, math.nan, 3, 3)]), str(tmp_path / "x"))
    with pytest.raises(ValueError, match="columns"):
        api.encode(cloud(spark, TEN).drop("mass"), str(tmp_path / "x"))


def reseal(data):
    data = bytearray(data)
    data[88:92] = struct.pack("<I", zlib.crc32(data[128:]))
    return bytes(data)


def put(data, at, kind, value):
    data = bytearray(data)
    struct.pack_into(kind, data, at, value)
    return bytes(data)


MUTATIONS = [
    (lambda d: d[:100], "truncated"),
    (lambda d: b"XPOS" + d[4:], "not a preview"),
    (lambda d: put(d, 4, "<H", 2), "container version 2.0"),
    (lambda d: put(d, 6, "<H", 1), "container version 1.1"),
    (lambda d: put(d, 8, "<H", 2), "codec version 2.0.0"),
    (lambda d: put(d, 10, "<H", 1), "codec version 1.1.0"),
    (lambda d: put(d, 12, "<H", 1), "codec version 1.0.1"),
    (lambda d: put(d, 14, "<H", 96), "header size 96"),
    (lambda d: put(d, 16, "<I", 5), "endian"),
    (lambda d: put(d, 20, "<I", 3), "flags 0x00000003"),
    (lambda d: put(d, 24, "<I", 0), "non-zero"),
    (lambda d: put(d, 28, "<I", 0), "non-zero"),
    (lambda d: put(d, 28, "<I", 11), "retained point count"),
    (lambda d: put(d, 92, "<I", 3), "retained point count"),
    (lambda d: put(d, 32, "<I", 5999), "spectrum size 5999"),
    (lambda d: put(d, 72, "<I", 129), "offsets or file size"),
    (lambda d: d + b"\0", "offsets or file size"),
    (lambda d: d[:-1] + bytes([d[-1] ^ 0x80]), "checksum mismatch"),
    (lambda d: reseal(put(d, 128, "<I", 7)), "original spectrum counts"),
    (lambda d: reseal(put(d, 24128, "<I", 7)), "retained spectrum counts"),
    (lambda d: reseal(put(put(d, 24128, "<I", 2), 24128 + 4 * 559, "<I", 0)), "exceeds"),
]


@pytest.mark.parametrize("change, message", MUTATIONS)
def test_mutations(spark, tmp_path, change, message):
    path = tmp_path / "x.preview"
    path.write_bytes(change(model(TEN, 4)))
    expected = C.FormatVersionError if "version" in message else ValueError
    if "spectrum counts" in message or message == "exceeds":
        inspect_file(str(path))  # the header alone is fine
    else:
        with pytest.raises(expected, match=message):
            inspect_file(str(path))
    with pytest.raises(Exception, match=message):
        api.decode(spark, str(path)).collect()


def test_headers_in_a_column(spark):
    good = model(TEN, 4)
    told = [(f(good), message) for f, message in MUTATIONS if "checksum" not in message and "spectrum counts" not in message and message != "exceeds"]
    rows = [(i, d[:128], len(d), m) for i, (d, m) in enumerate([(good, None), *told, (b"", "truncated")])] + [(99, None, None, "truncated")]
    found = api.check_headers(spark.createDataFrame(rows, "id int, head binary, length long, problem string").repartition(3)).collect()
    assert len(found) == len(rows)
    expected = {r[0]: r[3] for r in rows}
    for r in found:
        assert (r["problem"] is None) == (expected[r["id"]] is None) and (expected[r["id"]] or "") in (r["problem"] or "")
    assert api.check_headers(spark.createDataFrame([], "head binary, length long")).count() == 0


def test_unchecked_crc_can_be_read(spark, tmp_path):
    data = model(TEN, 4)
    (tmp_path / "x").write_bytes(data[:-1] + bytes([data[-1] ^ 0x80]))
    assert api.decode(spark, str(tmp_path / "x"), verify_checksum=False).count() == 4
    assert inspect_file(str(tmp_path / "x"), False).stored_point_count == 4


def test_uniform_sample(spark):
    got = [(r["sample_index"], r["point_index"]) for r in sample.uniform_sample(cloud(spark, TEN), 4).orderBy("sample_index").collect()]
    assert got == [(0, 1), (1, 3), (2, 6), (3, 8)]
    assert sample.uniform_sample(cloud(spark, TEN), 50).count() == 10


def test_pick_by_spectrum_checks(spark):
    frame = cloud(spark, TEN)
    wrong = spark.createDataFrame([(559, 4, 5)], "bin int, true_count long, stored_count long")
    with pytest.raises(ValueError, match="exceeds"):
        sample.pick_by_spectrum(frame, wrong)
    with pytest.raises(ValueError, match="match"):
        sample.pick_by_spectrum(frame, spark.createDataFrame([(559, 4, 4)], "bin int, true_count long, stored_count long"))


def test_headers_of_a_folder(spark, tmp_path):
    for n in (4, 10):
        (tmp_path / f"{n}.preview").write_bytes(model(TEN, n))
    rows = api.headers(spark, str(tmp_path)).orderBy("max_points").collect()
    assert [(r["stored_point_count"], r["payload_crc32"]) for r in rows] == [(4, 0xB74E03A4), (10, 0xCAF7B191)]
    assert rows[0]["bounds"] == [[0.0, -1.0, 5.0], [4.0, 1.0, 5.0]]


def test_command_line(spark, tmp_path, capsys):
    from pointloom.cli import main

    (tmp_path / "a.pos").write_bytes(np.array(TEN, ">f4").tobytes())
    assert main(["encode", str(tmp_path / "a.pos"), str(tmp_path / "o" / "a.preview"), "--max-points", "4"]) == 0
    assert (tmp_path / "o" / "a.preview").read_bytes() == model(TEN, 4)
    assert main(["decode", str(tmp_path / "o" / "a.preview"), str(tmp_path / "b.pos")]) == 0
    assert np.fromfile(tmp_path / "b.pos", ">f4").reshape(-1, 4)[0].tolist() == [1.0000152587890625, -1, 5, 27.97894287109375]
    capsys.readouterr()
    assert main(["inspect", str(tmp_path / "o" / "a.preview")]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["payload_crc32"] == "b74e03a4" and shown["container_version"] == "1.0" and shown["algorithm_version"] == "1.0.0"
    assert main(["sample", str(tmp_path / "a.pos"), str(tmp_path / "c.pos"), "--max-points", "2"]) == 0
    assert np.fromfile(tmp_path / "c.pos", ">f4").reshape(-1, 4).tolist() == np.array([TEN[2], TEN[7]], np.float32).tolist()
    assert main(["check", str(tmp_path / "o")]) == 0 and capsys.readouterr().out == ""
    (tmp_path / "o" / "b.preview").write_bytes(model(TEN, 4)[:-1])
    assert main(["check", str(tmp_path / "o")]) == 1 and capsys.readouterr().out.endswith("b.preview: invalid section offsets or file size\n")
    with pytest.raises(SystemExit) as stopped:
        main(["encode", "only one"])
    assert stopped.value.code == 2


def test_sidecar_and_view_helpers(spark, tmp_path):
    import hashlib

    from pointloom.operators import view

    (tmp_path / "a.pos").write_bytes(np.array(TEN, ">f4").tobytes())
    (tmp_path / "a.preview").write_bytes(model(TEN, 4))
    got = api.sidecar(spark, str(tmp_path / "a.pos"), str(tmp_path / "a.preview"), title="ten points")
    assert (got["title"], got["original_size_bytes"], got["preview_size_bytes"], got["stored_point_count"]) == ("ten points", 160, 48160, 4)
    assert got["sha256"] == hashlib.sha256(model(TEN, 4)).hexdigest() and got["compression_ratio"] == round(160 / 48160, 3)
    assert [tuple(r) for r in view.axis_ticks(spark).limit(2).collect()] == [(0, 0.0), (20, 20 / 120)]
    assert view.moved_camera(1.4, 8.0, 0.5, -100) == (1.45, 8.0)


def test_global_index(spark):
    from pyspark.sql import functions as F

    from pointloom.operators.ordering import global_index

    rows = spark.range(5000, numPartitions=7).select(F.xxhash64("id").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("b"))
    got = global_index(rows, ["b", "a"]).orderBy("point_index").collect()
    assert [r["point_index"] for r in got] == list(range(5000))
    assert [(r["b"], r["a"]) for r in got] == sorted(((r["b"], r["a"]) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    ties = global_index(rows.withColumn("a", F.lit(1)), ["a"], ["b"], "n")
    assert ties.columns == ["b", "n"] and sorted(r["n"] for r in ties.collect()) == list(range(5000))
    assert global_index(rows.limit(0), ["a"]).count() == 0
