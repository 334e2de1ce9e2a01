"""Golden cases and properties of the raster operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.__main__ import main
from scanloom.functions import map_rows, PX_SCHEMA, to_px, to_rows
from scanloom.operators import geometry, joins, pointwise, scan, solvers, stats
from scanloom.plans import pipeline
from scanloom.sources import create, pnm
from scanloom.streaming import pages


def image(spark, *planes, img=1, pag=1, first=1):
    rows = []
    for c, plane in enumerate(planes, first):
        a = np.asarray(plane, float)
        rows += [(img, pag, a.shape[1], a.shape[0], c, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, PX_SCHEMA)


def plane(px, chan=1):
    rows = px.where(f"chan = {chan}").collect()
    out = np.full((rows[0].h, rows[0].w), np.nan)
    for r in rows:
        out[r.y, r.x] = np.nan if r.v is None else r.v
    return out


RNG = np.random.default_rng(5)
GRAY = RNG.integers(0, 256, (20, 24)).astype(float)


def test_golden(spark):
    assert plane(geometry.half_x(image(spark, [[0, 8, 16, 24]] * 2))).tolist() == [[0, 12, 24]] * 2
    assert plane(pointwise.contrast(image(spark, [[100]]), 50, 200)).tolist() == [[85]]
    assert (plane(scan.laplacian(image(spark, np.full((4, 5), 9)))) == 128).all()
    assert plane(geometry.rotate(image(spark, [[1, 2, 3], [4, 5, 6]]), 90)).tolist() == [[4, 1], [5, 2], [6, 3]]


def test_rows_and_pixels(spark):
    assert (plane(to_px(to_rows(image(spark, GRAY)))) == GRAY).all()


def test_scanlines_may_stand_for_pixels(spark):
    px = image(spark, GRAY)
    rows = to_rows(px)
    for operator in (scan.laplacian, geometry.half_x, lambda p: geometry.shear_x(p, 0.2), geometry.double, lambda p: solvers.floyd_dither(p, 51), lambda p: scan.convolve_3x3(p, 1, 2, 3, 4)):
        assert np.allclose(plane(operator(rows)), plane(operator(px)), equal_nan=True)
    assert sorted(stats.edge_histograms(rows).collect()) == sorted(stats.edge_histograms(px).collect())


def test_rotations_and_splits(spark):
    px = image(spark, GRAY)
    turned = px
    for _ in range(4):
        turned = geometry.rotate(turned, 90)
    assert (plane(turned) == GRAY).all()
    assert (plane(geometry.rotate(px, 360)) == GRAY).all()
    left, right = geometry.split_x(px, 0.25)
    assert (np.hstack([plane(left), plane(right)]) == GRAY).all()
    assert right.first().pag == 2


def test_constant_images_stay_constant(spark):
    px = image(spark, np.full((12, 13), 77))
    for out in (geometry.half(px), geometry.redouble(px, True, False), geometry.double(px, 0.3), geometry.skew(px, 2)):
        assert np.allclose(plane(out), 77)


def test_half_and_redouble_agree_with_numpy(spark):
    px = image(spark, GRAY[:19])
    assert np.allclose(plane(geometry.half(px)), solvers.half_plane(GRAY[:19]))
    assert np.allclose(plane(geometry.redouble(px, True, False)), solvers.redouble_plane(GRAY[:19], True, False))
    assert solvers.redouble_plane(solvers.half_plane(GRAY[:19]), False, True).shape == (19, 24)


def test_diff_patch_darker(spark):
    a, b = image(spark, GRAY), image(spark, GRAY[::-1])
    assert (plane(joins.patch(joins.diff(a, b), b)) == GRAY).all()
    assert (plane(joins.darker(a, b)) == np.minimum(GRAY, GRAY[::-1])).all()
    assert (plane(joins.darker(a, a)) == GRAY).all()
    assert (plane(joins.diff(a, image(spark, GRAY, first=2))) == GRAY).all()  # a plane that the other lacks


def test_dithers_and_quantize(spark):
    px = image(spark, GRAY)
    for out in (solvers.floyd_dither(px, 51), solvers.floyd_dither(px, 51, compat=True), pointwise.dither_blue_noise(px, 51), scan.dither_cumulative(px, 51)):
        assert np.allclose(plane(out) % 51, 0)
    cumulative = plane(scan.dither_cumulative(px, 51))
    assert (abs((cumulative - GRAY).cumsum(0).cumsum(1)) <= 51 / 2 + 1e-6).all()
    assert abs(plane(solvers.floyd_dither(px, 51)).mean() - GRAY.mean()) < 10
    ranks = pointwise.blue_noise_matrix()
    assert sorted(ranks) == list(range(256))


def test_background_bounds_the_image(spark):
    assert (plane(scan.background(image(spark, GRAY), 4)) >= GRAY - 0.5).all()


def test_histogram_sums_to_the_area(spark):
    assert stats.histogram(image(spark, GRAY)).agg({"n": "sum"}).first()[0] == GRAY.size


def test_skew_is_found_and_undone(spark):
    page = np.full((60, 80), 255.0)
    page[10::8] = 0
    tilted = geometry.skew(image(spark, page), 4)
    assert abs(abs(stats.detect_skew(tilted).first().angle) - 4) < 1.6


def test_deconvolutions(spark):
    px = image(spark, GRAY)
    back = solvers.deconvolve_3x3(scan.convolve_3x3(px, 4, -0.5, -0.25, 0.1), 4, -0.5, -0.25, 0.1, tol=1e-8)
    assert np.allclose(plane(back), GRAY, atol=1e-5)
    n = 9
    a, b, c = RNG.normal(size=(3, n))
    u = RNG.normal(size=(n, 2))
    y = b[:, None] * u
    y[1:] += a[1:, None] * u[:-1]
    y[:-1] += c[:-1, None] * u[1:]
    assert np.allclose(solvers.solve_bands(a, b, c, y), u)


def test_poisson_returns_to_the_image_up_to_its_corners(spark):
    px = image(spark, GRAY)
    solved = plane(solvers.poisson_solve(pointwise.fill(px, {1: 128}), scan.laplacian(px), tol=1e-9))
    corners = np.array([[128 - GRAY[0, 0], 128 - GRAY[0, -1]], [128 - GRAY[-1, 0], 128 - GRAY[-1, -1]]])
    y, x = np.linspace(0, 1, 20)[:, None], np.linspace(0, 1, 24)[None]
    plane_of_corners = (1 - y) * ((1 - x) * corners[0, 0] + x * corners[0, 1]) + y * ((1 - x) * corners[1, 0] + x * corners[1, 1])
    assert np.allclose(solved, GRAY + plane_of_corners, atol=1e-4)


def test_laplacians_agree(spark):
    alpha = np.where(RNG.random(GRAY.shape) < 0.1, 0.0, 255.0)
    px = image(spark, alpha, GRAY, first=0)
    ours = plane(scan.laplacian(px))
    assert np.allclose(ours, solvers.laplacian_plane(GRAY, -0.25, alpha), equal_nan=True)


def test_selection(spark):
    px = pointwise.select_rectangle(image(spark, GRAY), 1, 2, 3, -4, 0.5)
    sel = plane(px, 4)
    assert sel.sum() == (24 - 4 - 2) * (10 - 3) and sel[3, 2] == 1
    assert plane(pointwise.select_rectangle(px, -0.0, 0, 0, 5, 0), 4).sum() == 3 * 7
    filled = plane(pointwise.fill(px, {1: 7}))
    assert ((filled == 7) == ((sel == 1) | (GRAY == 7))).all()
    assert plane(geometry.rotate(px, 90), 4).sum() == sel.sum()  # selections follow the image


def test_codec(spark, tmp_path):
    planes = {c: RNG.integers(0, 256, (5, 7)).astype(float) for c in range(4)}
    for chans in ((1,), (0, 1), (1, 2, 3), (0, 1, 2, 3)):
        some = {c: planes[c] for c in chans}
        got = pnm.decode(pnm.encode(some))
        assert set(got) == set(some) and all((got[c] == some[c]).all() for c in some)
    assert pnm.decode(b"P5 # comment\n2 #w\n1\n255\nab")[1].tolist() == [[97, 98]]
    for bad in (b"P4\n1 1\n", b"P5\n1 1\n65535\n\0\0", b"P5\n2 2\n255\nabc", b"P5\n2"):
        with pytest.raises(ValueError):
            pnm.decode(bad)
    for chans in ((1,), (1, 2, 3), (0, 1, 2, 3)):
        (tmp_path / "p3.png").write_bytes(pnm.encode_png({c: planes[c] for c in chans}))
        got = to_px(pnm.load(spark, f"{tmp_path}/p3.png"))
        assert all((plane(got, c) == planes[c]).all() for c in chans)
    with pytest.raises(ValueError):
        pnm.write_images(image(spark, GRAY), "x.jpg")
    written = pnm.write_images(image(spark, [[-5, 300.7, 9.9]], pag=12), f"{tmp_path}/p%03d.pgm").collect()
    assert written[0].path.endswith("p012.pgm")
    back = pnm.load(spark, written[0].path)
    assert back.first().pag == 12 and back.first().row == [0, 255, 9]


def test_page_numbers(spark):
    names = {"page012.png": 12, "p000.v7.png": 7, "x00": 0, "scan9": 9, "none": 0}
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", pnm.page_number(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in got} == names


def test_stack_language(spark, tmp_path):
    source = f"{tmp_path}/in007.pgm"
    with open(source, "wb") as f:
        f.write(pnm.encode({1: GRAY}))
    m = pipeline.run(spark, [source, *f"fix-bg 5 bin auto w {tmp_path}/out%03d.pgm".split()])
    assert not m.stack
    assert set(np.unique(pnm.decode(open(f"{tmp_path}/out007.pgm", "rb").read())[1])) <= {0, 255}
    m = pipeline.run(spark, [source, *"copy diff histogram 1 w -".split()])
    assert m.output[0].splitlines()[128] == "128 480.000000"
    m = pipeline.run(spark, ["-", *"even con 0 10 all rot 90 unpop pop half w -".split()], stdin=pnm.encode({1: GRAY}))
    assert pnm.decode(m.output[0])[1].shape == (13, 11)
    m = pipeline.run(spark, [source, *"splitx 0.5 swap pop statistics".split()])
    assert len(m.output[0]) == 1
    for wrong in ("pop", "nonsense", "bin", "image 9 1 1", "unpop", "image 1 1 1 pag 10000", "ex 0"):
        with pytest.raises(ValueError):
            pipeline.run(spark, wrong.split())
    assert [pipeline.token_kind(t) for t in ("0.5", "a.png", "7", "-", "w", None, ".0")] == ["d", "f", "i", "-", "w", "0", "d"]


def test_new_images_and_vectors(spark):
    assert create.new_image(spark, 2, 3, 2).count() == 12
    assert create.clone_shape(image(spark, GRAY), 3, 5).count() == 3 * 5 * 20
    assert create.clear_vector(create.new_vector(spark, 4)).count() == 4


def test_page_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in (1, 2):
        (tmp_path / f"in/p{k}.pgm").write_bytes(pnm.encode({1: GRAY}))
    for _ in range(2):  # the second run finds nothing new
        stream = pages.page_stream(spark, f"{tmp_path}/in")
        pages.process_pages(stream, lambda px: pointwise.binarize(px, 128), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.schema(PX_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")
    assert got.count() == 2 * GRAY.size and got.select("pag").distinct().count() == 2


def test_map_rows(spark):
    px = image(spark, GRAY, GRAY[::-1])
    got = map_rows(px, lambda samples, keys: samples[:, :5] + keys["y"].to_numpy()[:, None], F.col("chan") == 2)
    assert (plane(got, 2) == GRAY[::-1][:, :5] + np.arange(20)[:, None]).all() and (plane(got, 1) == GRAY).all()
    assert got.where("chan = 2").first().w == 5


def test_unconverged_solvers_raise(monkeypatch):
    monkeypatch.setattr(solvers, "MOST_SWEEPS", 40)
    with pytest.raises(ArithmeticError):
        solvers.poisson_plane(np.full((9, 9), 128.0), RNG.normal(128, 40, (9, 9)), -0.25, 0, 1e-12)
    with pytest.raises(ArithmeticError):
        solvers.deconvolved_plane(RNG.normal(128, 40, (30, 30)), (1, -0.24, -0.24, 0), 0, 1e-12)
    assert np.isfinite(solvers.poisson_plane(np.full((9, 9), 128.0), RNG.normal(128, 40, (9, 9)), -0.25, 30, 1e-12)).all()


def test_files_are_written_by_scheme(spark, tmp_path):
    pnm.write_images(image(spark, GRAY, pag=5), f"file:{tmp_path}/p%02d.pgm").collect()
    assert (pnm.decode((tmp_path / "p05.pgm").read_bytes())[1] == GRAY).all() and [f.name for f in tmp_path.iterdir()] == ["p05.pgm"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p1.pgm").write_bytes(pnm.encode({1: GRAY}))
    assert main(["--help"]) == 0 and "splitx" in capsys.readouterr().out
    assert main([f"{tmp_path}/p1.pgm", "bin", "0.5", "w", f"{tmp_path}/q%d.pgm"]) == 0
    assert set(np.unique(pnm.decode((tmp_path / "q1.pgm").read_bytes())[1])) <= {0, 255}
    assert main(["nonsense"]) == 1 and "unknown command" in capsys.readouterr().err
