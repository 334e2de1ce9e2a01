"""The registered raster queries and their DuckDB SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import PIXEL, map_rows, to_px
from scanloom.operators import geometry, joins, pointwise, scan, solvers, stats
from scanloom.plans import fixtures as X
from scanloom.plans import pipeline
from scanloom.sources import create, pnm

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Decimals that results are rounded to, as the engines sum in different orders.
DIGITS = 6


def _shown(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Whole numbers as int or long, figures as rounded doubles without a negative zero."""
    types = dict(df.dtypes)
    return df.select(*((F.round(c, DIGITS) + 0.0).alias(c) if types[c] == "double" else F.col(c).cast("long").alias(c) if types[c] in ("int", "bigint", "smallint") else F.col(c) for c in columns))


def _register(name: str, columns: str, query: Query, sql: str | None = None, doubles: str = "v") -> None:
    """Register a query with the columns it shows, and its SQL: the body that follows the fixtures it names."""
    names = tuple(columns.split())
    QUERIES[name] = lambda spark, sf_dir: _shown(query(spark, sf_dir), names)
    if sql is None:
        return
    used, grown = set(), {k for k in X.SQL if k in sql}
    while used != grown:
        used = grown
        grown = used | {k for k in X.SQL if any(k in X.SQL[u] for u in used)}
    ctes = ", ".join(f"{k} as ({v})" for k, v in X.SQL.items() if k in used)
    text = {"line", "path"}
    shown = ", ".join(f"round({c}, {DIGITS}) + 0.0 as {c}" if c in doubles.split() else c if c in text else f"cast({c} as bigint) as {c}" for c in names)
    ORACLES[name] = f"{f'with {ctes} ' if ctes else ''}select {shown} from ({sql}) q"


def _f1(change: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: change(X.f1(spark, d))


PX = "chan y x v"
IMG = "img w h"


def _pointwise() -> None:
    _register("contrast", PX, _f1(lambda p: pointwise.contrast(p, 50, 200)), "select chan, y, x, case when v <= 50 then 0 when v >= 200 then 255 else (v - 50) * 255 / 150.0 end v from f1")
    _register("contrast_inverted", PX, _f1(lambda p: pointwise.contrast(p, 200, 50)), "select chan, y, x, case when v >= 200 then 0 when v <= 50 then 255 else (200 - v) * 255 / 150.0 end v from f1")
    _register("bin_fixed", PX, _f1(lambda p: pointwise.binarize(p, 0.5)), "select chan, y, x, case when v <= 127.5 then 0 else 255 end v from f1")
    _register("quantize", PX, lambda s, d: pointwise.quantize(X.f3(s, d), 0.25), "select chan, y, x, round((v - 128) * 0.25) / 0.25 + 128 v from f3")
    matrix = ", ".join(map(str, pointwise.blue_noise_matrix()))
    _register("blue_noise_dither", PX, _f1(lambda p: pointwise.dither_blue_noise(p, 64)), f"select chan, y, x, round(v / 64.0 + ([{matrix}])[16 * (y % 16) + x % 16 + 1] / 255.0 - 0.5) * 64 v from f1")
    _register("fill_constant", PX, lambda s, d: pointwise.fill(X.f3(s, d), {0: None, 1: 255, 2: 127.5, 3: 10}), "select chan, y, x, case chan when 0 then v when 1 then 255 when 2 then 127.5 else 10 end v from f3")
    _register("fill_selection_lerp", PX, lambda s, d: pointwise.fill(X.f1(s, d).unionByName(X.f7(s)), {1: 200}), "select f.chan, f.y, f.x, f.v + s.v * (200 - f.v) v from f1 f join f7 s on f.y = s.y and f.x = s.x union all select * from f7")

    def rect(v: float, box: tuple) -> Query:
        return lambda s, d: pointwise.select_rectangle(X.f1(s, d).unionByName(X.f7(s)), v, *box)

    box, inside = (20, 4, -10, 0.5), "x >= 20 and x < 54 and y >= 4 and y < 24"
    for name, v, case in (("add", 1.0, f"{inside} then 1.0"), ("subtract", 0.0, f"{inside} then 0.0"), ("intersect", -0.0, f"not ({inside}) then 0.0"), ("outside", -0.25, f"not ({inside}) then 0.25")):
        _register(f"select_rect_{name}", PX, rect(v, box), f"select chan, y, x, case when {case} else v end v from f7 union all select * from f1")
    _register("set_selection", PX, _f1(lambda p: pointwise.set_selection(p, 0.75)), "select * from f1 union all select 4, y, x, 0.75 from f1")
    _register("alpha_from_sel", PX, lambda s, d: pointwise.selection_to_alpha(X.f1(s, d).unionByName(X.f7(s))), "select * from f1 union all select * from f7 union all select 0, y, x, v from f7")
    _register("draw_grid", PX, _f1(lambda p: pointwise.grid(p, 4)), "select chan, y, x, case when y % 40 = 0 or x % 40 = 0 or (x % 4 = 0 and (y + 1) % 4 < 2) or (y % 4 = 0 and (x + 1) % 4 < 2) then case when v < 128 then 255 else 0 end else v end v from f1")
    _register("poke", PX, _f1(lambda p: pointwise.poke(p, 3, 5, 1, 77)), "select chan, y, x, case when x = 3 and y = 5 then 77 else v end v from f1")
    _register("channel_extract", PX, lambda s, d: pointwise.extract_channel(X.f3(s, d), 2), "select 1 chan, y, x, v from f3 where chan = 2")
    _register("add_alpha", PX, _f1(pointwise.add_alpha), "select * from f1 union all select 0, y, x, 255.0 from f1")
    _register("opaque", PX, lambda s, d: pointwise.opaque(X.f3(s, d)), "select * from f3 where chan <> 0")
    _register("image_depth", "img depth", lambda s, d: pointwise.depth(X.f3(s, d)), "select 1 img, count(distinct chan) depth from f3")
    _register("odd_pages", "pag y x v", lambda s, d: pointwise.by_parity(X.f4(s, d), True), "select * from f4 where pag % 2 = 1")
    _register("even_pages", "pag y x v", lambda s, d: pointwise.by_parity(X.f4(s, d), False), "select * from f4 where pag % 2 = 0")


def _page(spark: SparkSession, d: str, n: int) -> DataFrame:
    return joins.keyed(X.f4(spark, d).where(F.col("pag") == n), 1)


def _joined() -> None:
    pair = "(select a.chan, a.y, a.x, a.v v, b.v u from f4 a join f4 b on a.pag = 1 and b.pag = 2 and a.chan = b.chan and a.y = b.y and a.x = b.x)"
    _register("diff", PX, lambda s, d: joins.diff(_page(s, d, 1), _page(s, d, 2)), f"select chan, y, x, v - u + 128 v from {pair}")
    _register("patch_roundtrip", PX, lambda s, d: joins.patch(joins.diff(_page(s, d, 1), _page(s, d, 2)), _page(s, d, 2)), "select chan, y, x, v from f4 where pag = 1")
    _register("divide", PX, lambda s, d: joins.divide(_page(s, d, 1), _page(s, d, 2)), f"select chan, y, x, case when u = 0 then 255 else v / u * 255 end v from {pair}")
    _register("darker_two", PX, lambda s, d: joins.darker(_page(s, d, 1), _page(s, d, 2)), f"select chan, y, x, least(v, u) v from {pair}")
    _register("darker_many", PX, lambda s, d: joins.darkest(X.f4(s, d)), "select chan, y, x, min(v) v from f4 group by chan, y, x")
    _register("masked_add", PX, lambda s, d: joins.masked_add(pointwise.opaque(X.f3(s, d)), pointwise.opaque(X.f3(s, d)), X.f3(s, d)), "select f.chan, f.y, f.x, case when m.v >= 1 then f.v + f.v - 128 else f.v end v from f3 f join f3 m on m.chan = 0 and m.y = f.y and m.x = f.x where f.chan <> 0")
    _register("residual", PX, lambda s, d: joins.residual(pointwise.opaque(X.f3(s, d)), X.f3(s, d)), "select chan, y, x, 128 v from f3 where chan <> 0")


def _background(d: float) -> str:
    rate = 0.333 / d
    return f"""(with b0 as (select * from f1),
 bh as (select a.chan, a.y, a.x, max(b.v * exp(-{rate!r} * abs(a.x - b.x))) v from b0 a join b0 b on a.y = b.y group by a.chan, a.y, a.x),
 bd as (select a.chan, a.y, a.x, max(b.v * exp(-{rate!r} * (a.y - b.y))) v from bh a join bh b on a.x = b.x and b.y <= a.y group by a.chan, a.y, a.x),
 br as (select chan, y, x, case when y = {X.H - 1} then v else round(v) end v from bd)
 select a.chan, a.y, a.x, round(max(b.v * exp(-{rate!r} * (b.y - a.y)))) v from br a join br b on a.x = b.x and b.y >= a.y group by a.chan, a.y, a.x)"""


def _along(src: str, axis: str, size: object, cell: str) -> str:
    """SQL of new samples along an axis: ``cell`` of k, of the other coordinate and of the list a of old samples (from 1)."""
    other = "y" if axis == "x" else "x"
    return f"(select chan, {other}, cast(k as integer) {axis}, {cell} v from (select chan, {other}, a, unnest(range({size})) k from (select chan, {other}, list(v order by {axis}) a from {src} group by chan, {other})))"


def _half(src: str, axis: str, n: int) -> str:
    if n % 2:
        cell = f"case when k = 0 then a[1] when k = {(n - 1) // 2} then a[{n}] else (6 * a[2 * k + 1] + 4 * (a[2 * k] + a[2 * k + 2]) + a[2 * k - 1] + a[2 * k + 3]) / 16 end"
        return _along(src, axis, (n + 1) // 2, cell)
    return _along(src, axis, n // 2 + 1, f"case when k = 0 then a[1] when k = {n // 2} then a[{n}] else (3 * (a[2 * k] + a[2 * k + 1]) + a[2 * k - 1] + a[2 * k + 2]) / 8 end")


def _redouble(src: str, axis: str, n: int, odd: bool) -> str:
    size, j = 2 * n - 2 + odd, "(k // 2 + 1)"
    if odd:
        a = f"list_concat(list_concat([2 * a[1] - a[2]], a), [2 * a[{n}] - a[{n - 1}]])"
        on_odd = f"11 / 16.0 * (a[{j}] + a[{j} + 1]) - 3 / 16.0 * ({a}[{j}] + {a}[{j} + 3])"
        cell = f"case when k = 0 then a[1] when k = {size - 1} then a[{n}] when k % 2 = 1 then {on_odd} else 10 / 8.0 * a[{j}] - (a[{j} - 1] + a[{j} + 1]) / 8 end"
    else:
        cell = f"case when k = 0 then a[1] when k = {size - 1} then a[{n}] when k % 2 = 1 then a[{j}] / 16 + 18 / 16.0 * a[{j} + 1] - 3 / 16.0 * a[{j} + 2] else -3 / 16.0 * a[{j} - 1] + 18 / 16.0 * a[{j}] + a[{j} + 1] / 16 end"
    return _along(src, axis, size, cell)


def _shear_x(src: str, t: float | str, w: int, h: int) -> str:
    t = t if isinstance(t, str) else repr(t)
    d = f"cast(floor((y - {h // 2}) * {t}) as integer)"
    part = f"((y - {h // 2}) * {t} - floor((y - {h // 2}) * {t}))"
    start = f"(case when {d} > 0 then least(k, {w - 1} - {d}) else greatest(k, 1 - {d}) end)"
    at = f"least(greatest({start} + {d}, 0), {w - 1})"
    before = f"least(greatest({start} + {d} - 1, 0), {w - 1})"
    return _along(src, "x", w, f"{part} * a[{at} + 1] + (1 - {part}) * a[{before} + 1]")


def _shear_y(src: str, t: float | str, w: int, h: int) -> str:
    t = t if isinstance(t, str) else repr(t)
    d = f"cast(floor(({w // 2} - x) * {t}) as integer)"
    part = f"(({w // 2} - x) * {t} - floor(({w // 2} - x) * {t}))"
    at = f"least(greatest(k + {d}, 0), {h - 1})"
    after = f"least(greatest(k + {d} + 1, 0), {h - 1})"
    return _along(src, "y", h, f"(1 - {part}) * a[{at} + 1] + {part} * a[{after} + 1]")


def _skew_angle() -> str:
    """SQL of F1's angle: the bracket search over the scores of all slopes it can ask for."""
    scores = f"(with {_STEPS} select list(score order by d) from (select d, coalesce(sum(b * b), 0) score from (select d, y + case when d >= 0 then s else 64 - s end k, sum(t) b from (select y, t, d, cast(floor(((x + 1) * (abs(d) + 1) - 1) / 64.0) as integer) s from gz, (select unnest(range(-60, 61)) d)) group by 1, 2) group by d))"
    return f"""(with recursive sc as materialized (select {scores} q),
 br as (select 0 n, 6 a, -6 b union all select n + 1, case when q[a + 61] > q[b + 61] then a else cast(trunc((5 * b - 2 * a) / 3.0) as integer) end, case when q[a + 61] > q[b + 61] then cast(trunc((5 * a - 2 * b) / 3.0) as integer) else b end from br, sc where abs(a - b) > 1),
 en as (select case when q[b + 61] > q[a + 61] then b else a end d from br, sc order by n desc limit 1)
 select degrees(atan((d + sign(d)) / 64.0)) angle from en)"""


_STEPS = "gs as (select y, x, abs(v - lead(v) over (partition by x order by y)) t from f1), gr as (select sqrt(sum(t * t) / (64.0 * 47)) rms from gs), gz as (select y, x, t from gs, gr where t >= rms and t > 0)"


def _shaped() -> None:
    w, h = X.W, X.H
    whole = f"{IMG} {PX}"

    def rekeyed(x: str, y: str, nw: int, nh: int, keep: str = "true", src: str = "f1") -> str:
        return f"select 1 img, {nw} w, {nh} h, chan, {y} y, {x} x, v from {src} where {keep}"

    _register("crop", whole, _f1(lambda p: geometry.crop_y(geometry.crop_x(p, 10, 50), 0.25, 40)), rekeyed("x - 10", "y - 12", 40, 28, "x >= 10 and x < 50 and y >= 12 and y < 40"))
    _register("splitx_left", whole, _f1(lambda p: geometry.split_x(p, 3)[0]), rekeyed("x", "y", 21, h, "x < 21"))
    _register("splitx", f"pag {whole}", _f1(lambda p: geometry.split_x(p, 3)[1]), f"select 2 pag, q.* from ({rekeyed('x - 21', 'y', 43, h, 'x >= 21')}) q")
    _register("splity", f"pag {whole}", _f1(lambda p: geometry.split_y(p, 0.25)[1]), f"select 2 pag, q.* from ({rekeyed('x', 'y - 12', w, 36, 'y >= 12')}) q")
    _register("rotate_90", whole, _f1(lambda p: geometry.rotate(p, 90)), rekeyed(f"{h - 1} - y", "x", h, w))
    _register("rotate_180", whole, _f1(lambda p: geometry.rotate(p, 180)), rekeyed(f"{w - 1} - x", f"{h - 1} - y", w, h))
    _register("rotate_270", whole, _f1(lambda p: geometry.rotate(p, -90)), rekeyed("y", f"{w - 1} - x", h, w))
    k = 0.5
    a, b, c = (s + (t - s) * k for s, t in ((9 / 16, 8 / 15), (3 / 16, 2 / 15), (1 / 16, 3 / 15)))
    g = f"(select X, Y, cast(X // 2 as integer) x, cast(Y // 2 as integer) y, least(greatest(X // 2 + case when X % 2 = 1 then 1 else -1 end, 0), {w - 1}) nx, least(greatest(Y // 2 + case when Y % 2 = 1 then 1 else -1 end, 0), {h - 1}) ny from (select unnest(range({2 * w})) X) cross join (select unnest(range({2 * h})) Y))"
    g = g.replace("X,", "bx,").replace(" Y,", " by_,").replace("(X ", "(bx ").replace("X //", "bx //").replace("X %", "bx %").replace("Y //", "by_ //").replace("Y %", "by_ %").replace(")) X)", ")) bx)").replace(")) Y)", ")) by_)")
    _register("double", PX, _f1(lambda p: geometry.double(p, k)), f"select 1 chan, g.by_ y, g.bx x, {a!r} * p.v + {b!r} * (q.v + r.v) + {c!r} * s.v v from {g} g join f1 p on p.y = g.y and p.x = g.x join f1 q on q.y = g.y and q.x = g.nx join f1 r on r.y = g.ny and r.x = g.x join f1 s on s.y = g.ny and s.x = g.nx")
    odd = "(select * from f1 where x < 63 and y < 47)"

    def cut(p: DataFrame) -> DataFrame:
        return geometry.crop_y(geometry.crop_x(p, 0, 63), 0, 47)

    _register("half_even", PX, _f1(geometry.half), f"select * from {_half(_half('f1', 'x', w), 'y', h)}")
    _register("half_odd", PX, _f1(lambda p: geometry.half(cut(p))), f"select * from {_half(_half(odd, 'x', 63), 'y', 47)}")
    _register("half_tall", PX, lambda s, d: geometry.half_x(X.f2(s, d)), f"select * from {_half('f2', 'x', 64)}")
    _register("redouble_even", PX, _f1(lambda p: geometry.redouble(p, False, False)), f"select * from {_redouble(_redouble('f1', 'x', w, False), 'y', h, False)}")
    _register("redouble_odd", PX, _f1(lambda p: geometry.redouble(p, True, True)), f"select * from {_redouble(_redouble('f1', 'x', w, True), 'y', h, True)}")
    _register("shear_x", PX, _f1(lambda p: geometry.shear_x(p, 0.125)), f"select * from {_shear_x('f1', 0.125, w, h)}")
    _register("shear_y", PX, _f1(lambda p: geometry.shear_y(p, 0.125)), f"select * from {_shear_y('f1', 0.125, w, h)}")
    sin = math.sin(math.radians(3))
    tan = sin / (1 + math.cos(math.radians(3)))
    _register("skew_fixed", PX, _f1(lambda p: geometry.skew(p, 3)), f"select * from {_shear_x(_shear_y(_shear_x('f1', tan, w, h), sin, w, h), tan, w, h)}")
    angle = _skew_angle()
    _register("detect_skew", "img angle", _f1(stats.detect_skew), f"select 1 img, angle from {angle}", "angle")
    sin, tan = (f"(select {f} from {angle})" for f in ("sin(radians(angle))", "sin(radians(angle)) / (1 + cos(radians(angle)))"))
    _register("deskew", PX, _f1(geometry.deskew), f"select * from {_shear_x(_shear_y(_shear_x('f1', tan, w, h), sin, w, h), tan, w, h)}")


_X_LINE, _Y_LINE = "(partition by chan, y order by x)", "(partition by chan, x order by y)"


def _laplacian(src: str, masked: bool) -> str:
    v = f"(select f.chan, f.y, f.x, {'case when m.v >= 255 then f.v end' if masked else 'f.v'} v from {src} f {'join f3 m on m.chan = 0 and m.y = f.y and m.x = f.x where f.chan <> 0' if masked else ''})"
    near = f"(select *, lag(v) over {_X_LINE} + lead(v) over {_X_LINE} a, lag(v) over {_Y_LINE} + lead(v) over {_Y_LINE} b from {v})"
    return f"select chan, y, x, case when v is not null or (a is null and b is null) then 128 - 0.25 * (coalesce(a - 2 * v, 0) + coalesce(b - 2 * v, 0)) end v from {near}"


def _scanned() -> None:
    line = "(order by i)"
    _register("cumul", "i v", lambda s, d: scan.cumul(X.f5(s, d)), f"select i, sum(v) over {line} v from f5")
    _register("diff_vector", "i v", lambda s, d: scan.diff_vector(X.f5(s, d), 3), f"select i, case when i >= 3 then v - lag(v, 3) over {line} else v end v from f5")
    _register("diff_vector_compat", "i v", lambda s, d: scan.diff_vector(X.f5(s, d), 3, compat=True), f"select i, case when i >= 3 then v - lag(v) over {line} else v end v from f5")
    _register("conv3_vector", "i v", lambda s, d: scan.convolve_vector(X.f5(s, d), 0.25, 0.5, 0.75, True), f"select i, coalesce(0.25 * lag(v) over {line} + 0.5 * v + 0.75 * lead(v) over {line}, v * 1.5) v from f5")
    _register("mean_y", PX, lambda s, d: scan.mean_y(X.f2(s, d), 5), f"select chan, y, x, case when y + 2 between 5 and (select max(y) from f2) then avg(v) over (partition by chan, x order by y rows between 2 preceding and 2 following) else v end v from f2")
    _register("convolve_3x3", PX, _f1(lambda p: scan.convolve_3x3(p, 4, -1, -1, 0.5)), f"select chan, y, x, coalesce(4 * v - (lag(v) over {_X_LINE} + lead(v) over {_X_LINE}) - (lag(v) over {_Y_LINE} + lead(v) over {_Y_LINE}) + 0.5 * (lag(s) over {_Y_LINE} + lead(s) over {_Y_LINE}), v) v from (select *, lag(v) over {_X_LINE} + lead(v) over {_X_LINE} s from f1)")
    _register("laplacian", PX, _f1(scan.laplacian), _laplacian("f1", False))
    _register("laplacian_masked", PX, lambda s, d: pointwise.opaque(scan.laplacian(X.f3(s, d))), _laplacian("f3", True))
    prefix = f"(select chan, y, x, round(sum(p) over {_Y_LINE}) s from (select chan, y, x, sum(v / 64.0) over {_X_LINE} p from f1))"
    down = f"(select chan, y, x, s - coalesce(lag(s) over {_Y_LINE}, 0) s from {prefix})"
    _register("dither_cumulative", PX, _f1(lambda p: scan.dither_cumulative(p, 64)), f"select chan, y, x, (s - coalesce(lag(s) over {_X_LINE}, 0)) * 64 v from {down}")
    _register("background", PX, _f1(lambda p: scan.background(p, 5)), f"select * from {_background(5)}")
    _register("fix_background", PX, _f1(lambda p: joins.fix_background(p, 5)), f"select f.chan, f.y, f.x, case when b.v = 0 then 255 else f.v / b.v * 255 end v from f1 f join {_background(5)} b on f.y = b.y and f.x = b.x")
    marks = "m1 as (select i, ln(v + 1) p, count(*) over () n, avg(ln(v + 1)) over () mean from f5), m2 as (select *, (mean + (select avg(p) from m1 where p <= mean)) / 2 bound from m1), m3 as (select i, n, p > bound bad, coalesce(max(case when p > bound then i end) over (order by i), -1) lb, coalesce(min(case when p > bound then i end) over (order by i desc), n) nb from m2), m4 as (select i, n, bad, case when bad then n + 1 else (i - lb) - (nb - i) end worth from m3), m5 as (select *, case when not bad and not lead(bad, 4) over (order by i) then worth - lead(worth, 4) over (order by i) end score from m4), m6 as (select *, coalesce(score, worth) final from m5), m7 as (select i j, score t from m6 where score is not null order by score desc, i limit 1)"
    margin = f"select (j + coalesce((select min(i) from m6 where i > j and final <> t), (select max(i) + 1 from m6))) // 2 margin from m7"
    _register("find_margin", "vec_id margin", lambda s, d: scan.find_margin(X.f5(s, d), 3), f"select 1 vec_id, margin from (with {marks} {margin})")
    _register("poisson_vector", "i v", lambda s, d: scan.poisson_vector(X.f5(s, d), X.f5(s, d).where("i < 28").withColumn("v", F.col("v") - 300)), "select i, u + i * ((select v from f5 where i = 29) - max(case when i = 29 then u end) over ()) / 29.0 v from (select f.i, (select v from f5 where i = 0) - coalesce(c, 0) u from f5 f left join (select i + 2 i, sum(c) over (order by i) c from (select i, sum(v - 300) over (order by i) c from f5 where i < 28)) n on n.i = f.i)")


_LEVELS = "select cast(least(greatest(floor(v), 0), 255) as integer) l, count(*) n from f1 group by 1"
_BINS = "(select unnest(range(256)) l)"
_PAIRS = f"select v a, r b from nb where r is not null and d is not null union all select v a, d b from nb where r is not null and d is not null"
_EDGES = f"nb as (select y, x, v, lead(v) over (partition by y order by x) r, lead(v) over (partition by x order by y) d from f1), pr as ({_PAIRS}), dl as (select least(a, b) l, (b - a) * (b - a) e, 1 c from pr union all select greatest(a, b), -(b - a) * (b - a), -1 from pr), hs as (select b.l, coalesce(sum(e), 0) e, coalesce(sum(c), 0) c from {_BINS} b left join dl on dl.l = b.l group by b.l), cu as (select l, sum(e) over (order by l) e, sum(c) over (order by l) c from hs), th as (select l t, c edges from cu order by e desc, l limit 1)"


def _reduced() -> None:
    dense = f"select 1 img, b.l as level, coalesce(n, 0) n from {_BINS} b left join ({_LEVELS}) c on c.l = b.l"
    _register("histogram_area", "img level n", _f1(stats.histogram), dense)
    compat = "select case when v < 0 then 0 when v > 1 then 255 else cast(trunc(v) as integer) end l, count(*) n from f1 group by 1"
    _register("histogram_compat", "img level n", _f1(lambda p: stats.histogram(p, 1, True)), f"select 1 img, b.l as level, coalesce(n, 0) n from {_BINS} b left join ({compat}) c on c.l = b.l")
    _register("edge_count_hist", "img level edges", _f1(stats.edge_histograms), f"select 1 img, l as level, c edges from (with {_EDGES} select * from hs)")
    _register("edge_energy_hist", "img level energy", _f1(stats.edge_histograms), f"select 1 img, l as level, e energy from (with {_EDGES} select * from hs)")
    _register("cumulative_hist", "img level edges energy", _f1(lambda p: stats.cumulative(stats.edge_histograms(p), ["edges", "energy"])), f"select 1 img, l as level, c edges, e energy from (with {_EDGES} select * from cu)")
    _register("argmax_first", "img level n", _f1(lambda p: stats.argmax(stats.histogram(p), ["img"], "level", "n")), f"select 1 img, l as level, n from ({_LEVELS}) order by n desc, l limit 1")
    figures = f"with {_EDGES} select 1 img, t, any_value(edges) edges, sum(case when v <= t then 1 else 0 end) area, t / 255.0 graythr, sum(case when v <= t then 1 else 0 end) * 2.0 / nullif(any_value(edges) * 0.8, 0) thickness, avg(case when v <= t then v end) / 255.0 black, avg(case when v > t then v - 1 end) / 255.0 white from f1, th group by t"
    _register("image_statistics", "img t edges area graythr thickness black white", _f1(stats.statistics), figures, "graythr thickness black white")
    _register("bin_auto", PX, bin_auto, f"select chan, y, x, case when v <= t then 0.0 else 255.0 end v from f1, (with {_EDGES} select t from th)")
    stretched = f"select f.chan, f.y, f.x, case when f.v <= s.black * 255 then 0 when f.v >= s.white * 255 then 255 else (f.v - s.black * 255) * 255 / (s.white * 255 - s.black * 255) end v from f1 f, ({figures}) s"
    _register("contrast_auto", PX, _f1(lambda p: pointwise.contrast_auto(p, stats.statistics(p))), stretched)
    steps = _STEPS
    _register("gradient_rms", "img rms", _f1(stats.gradient_rms), f"select 1 img, rms from (with {steps} select * from gr)", "rms")
    bucket = "y + case when d >= 0 then s else 64 - s end"
    scores = f"with {steps} select 1 img, d, sum(b * b) score from (select d, {bucket} k, sum(t) b from (select y, t, d, cast(floor(((x + 1) * (abs(d) + 1) - 1) / 64.0) as integer) s from gz, (select unnest([-6, -3, 0, 2, 5]) d)) group by 1, 2) group by d"
    _register("skew_score", "img d score", _f1(lambda p: stats.skew_scores(p, [-6, -3, 0, 2, 5])), scores, "score")
    _register("border_mean", "img chan mean", _f1(stats.border_mean), "select 1 img, chan, avg(v) mean from f1 where x in (0, 63) or y in (0, 47) group by chan", "mean")


def bin_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a gray page binarized at its own threshold."""
    px = X.f1(spark, sf_dir)
    return pointwise.binarize_auto(px, stats.statistics(px))


def _diffused(step: int, ahead: str, behind: str) -> str:
    """SQL of the error diffusion of F1, a sample at a time: this row and the next one as lists."""
    w, h = X.W, X.H
    return f"""(with recursive im as materialized (select list(r order by y) m from (select y, list(v order by x) r from f1 group by y)),
 wk as (select 0 k, 0 y, 1 x, false back, 1 s, m[1] cur, m[2] nxt, cast(null as double) v, 0 oy, 0 ox from im
  union all
  select k + 1, (k + 1) // {w}, case when ((k + 1) // {w}) % 2 = 1 then {w} - (k + 1) % {w} else (k + 1) % {w} + 1 end, ((k + 1) // {w}) % 2 = 1, case when ((k + 1) // {w}) % 2 = 1 then -1 else 1 end,
   case when k % {w} = {w - 1} then below else here end, case when k % {w} = {w - 1} then coalesce(m[y + 3], list_transform(below, lambda z: 0.0)) else below end, new, y, x - 1
  from (select *, list_transform(range(1, {w + 1}), lambda j: case when j = x + s then cur[j] + 7 * e else cur[j] end) here,
    list_transform(range(1, {w + 1}), lambda j: case when j = x then nxt[j] + 5 * e when j = x + s then nxt[j] + ({ahead}) * e when j = x - s then nxt[j] + ({behind}) * e else nxt[j] end) below
   from (select wk.*, m, round(cur[x] / {step}.0) * {step} new, (cur[x] - round(cur[x] / {step}.0) * {step}) / 16 e from wk, im where k < {w * h})))
 select 1 chan, oy y, ox x, v from wk where k > 0)""".join(("select * from ", ""))


def _small(p: DataFrame) -> DataFrame:
    """F1 cut to 24 x 20: one level of multigrid."""
    return geometry.crop_y(geometry.crop_x(p, 0, 24), 0, 20)


def _two(px: DataFrame) -> DataFrame:
    """Two decimals of a solver's result."""
    return px.withColumn("v", F.round("v", 2))


def _solved_on(suffix: str, taken: Callable[[DataFrame], DataFrame], cut: str, w: int, h: int) -> None:
    """Solvers on what ``taken`` takes of F1, w x h pixels; ``cut`` is the same in SQL."""
    lap = _laplacian(cut, False)
    near = f"(select g.*, t.v tv, lag(g.v) over (partition by g.chan, g.y order by g.x) + lead(g.v) over (partition by g.chan, g.y order by g.x) a, lag(g.v) over (partition by g.chan, g.x order by g.y) + lead(g.v) over (partition by g.chan, g.x order by g.y) b from (select chan, y, x, 255 - v v from {cut}) g join ({lap}) t on t.y = g.y and t.x = g.x)"
    rhs = "((tv - 128) / -0.25)"
    asked = f"case when a is not null and b is not null then (a + b - {rhs}) / 4 when a is not null then (a - {rhs}) / 2 when b is not null then (b - {rhs}) / 2 else v end"

    def inverted(p: DataFrame) -> DataFrame:
        return p.withColumn("v", 255 - F.col("v"))

    _register(f"poisson_halfsweep{suffix}", PX, _f1(lambda p: solvers.poisson_halfsweep(inverted(taken(p)), scan.laplacian(taken(p)), -0.25, 1)), f"select chan, y, x, case when (x + y + 1) % 2 = 1 then {asked} else v end v from {near}")
    _register(f"poisson_residual{suffix}", "img error", _f1(lambda p: solvers.poisson_residual(inverted(taken(p)), scan.laplacian(taken(p)), -0.25)), f"select 1 img, sqrt(avg(power(({asked}) - v, 2))) error from {near} where a is not null or b is not null", "error")
    kernel = (4, -0.5, -0.25, 0.125)
    c3 = f"(select *, lag(v) over {_X_LINE} + lead(v) over {_X_LINE} s, lag(v) over {_Y_LINE} + lead(v) over {_Y_LINE} b from (select chan, y, x, 255 - v v, v p from {cut}))"
    damp = 16 / (16 + 2 * 0.25 + 2 * 0.0625 + 4 * 0.015625)
    o = f"(select *, lag(s) over {_Y_LINE} + lead(s) over {_Y_LINE} g from {c3})"
    _register(f"deconv_halfsweep{suffix}", PX, _f1(lambda p: solvers.deconvolution_halfsweep(taken(p), inverted(taken(p)), *kernel, 2)), f"select chan, y, x, case when s is not null and b is not null and (x - 1 - (2 + y)) % 2 = 0 then v + ((p + 0.5 * s + 0.25 * b - 0.125 * g) / 4 - v) * {damp!r} else v end v from {o}")
    # The solution is the image and a plane through what the guess differs by at the corners; to two decimals.
    corner = f"(select 128 - v from {cut} where x = {{0}} and y = {{1}})"
    bent = f"(1 - y / {h - 1}.0) * ((1 - x / {w - 1}.0) * {corner.format(0, 0)} + x / {w - 1}.0 * {corner.format(w - 1, 0)}) + y / {h - 1}.0 * ((1 - x / {w - 1}.0) * {corner.format(0, h - 1)} + x / {w - 1}.0 * {corner.format(w - 1, h - 1)})"
    if w > X.W:  # with the image's own corners the solution is the image: no ties to round
        corners = lambda: F.col("x").isin(0, w - 1) & F.col("y").isin(0, h - 1)
        _register(f"poisson_solve{suffix}", PX, _f1(lambda p: _two(solvers.poisson_solve(taken(p).withColumn("v", F.when(corners(), F.col("v")).otherwise(128.0)), scan.laplacian(taken(p)), tol=1e-9))), f"select * from {cut}")
        return
    _register(f"poisson_solve{suffix}", PX, _f1(lambda p: _two(solvers.poisson_solve(pointwise.fill(taken(p), {1: 128}), scan.laplacian(taken(p)), tol=1e-9))), f"select chan, y, x, round(v + {bent}, 2) v from {cut}")


def _tiled(p: DataFrame) -> DataFrame:
    """F1 four times, side by side: 128 x 96, so the solvers recur to coarser levels."""
    spread = p.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return spread.select("img", "pag", (F.col("w") * 2).alias("w"), (F.col("h") * 2).alias("h"), "chan", (F.col("y") + F.col("h") * F.floor(F.col("t") / 2)).cast("int").alias("y"), (F.col("x") + F.col("w") * (F.col("t") % 2)).cast("int").alias("x"), "v")


_TILED = "(select chan, cast(y + 48 * (t // 2) as integer) y, cast(x + 64 * (t % 2) as integer) x, v from f1, (select unnest(range(4)) t))"


def _solved_large() -> None:
    """Solvers on images whose sides are over 64, and with a mask: every level of multigrid takes part."""
    kernel = (4, -0.5, -0.25, 0.125)
    _solved_on("_large", _tiled, _TILED, 128, 96)
    _register("deconvolve_3x3_large", PX, _f1(lambda p: _two(solvers.deconvolve_3x3(scan.convolve_3x3(_tiled(p), *kernel), *kernel, tol=1e-9))), f"select * from {_TILED}")

    def masked(s: SparkSession, d: str) -> DataFrame:
        """Where alpha is 255 the guess is gray; the target is F3's own laplacian, so the solution is F3."""
        f3 = X.f3(s, d)
        alpha = f3.where("chan = 0")
        gray = joins.masked_add(pointwise.opaque(f3), pointwise.opaque(f3).withColumn("v", 256 - F.col("v")), f3)
        corner = F.col("g.x").isin(0, X.W - 1) & F.col("g.y").isin(0, X.H - 1)
        both = gray.alias("g").join(f3.alias("f"), [F.col(f"g.{c}") == F.col(f"f.{c}") for c in joins.PLACE])
        guess = both.select(*(F.col(f"g.{c}") for c in PIXEL), F.when(corner, F.col("f.v")).otherwise(F.col("g.v")).alias("v"))
        return _two(solvers.poisson_solve(guess, scan.laplacian(pointwise.opaque(f3)).unionByName(alpha), tol=1e-9))

    _register("poisson_solve_masked", PX, masked, "select * from f3 where chan <> 0")

    def pasted(s: SparkSession, d: str) -> DataFrame:
        f3 = X.f3(s, d)
        paste = f3.withColumn("v", F.when(F.col("chan") == 0, 255.0).otherwise(F.col("v")))
        return _two(solvers.seamless_paste(paste, pointwise.opaque(f3).withColumn("v", 255 - F.col("v")), tol=1e-9))

    w, h = X.W - 1, X.H - 1
    bent = f"(1 - f.y / {h}.0) * ((1 - f.x / {w}.0) * c.a + f.x / {w}.0 * c.b) + f.y / {h}.0 * ((1 - f.x / {w}.0) * c.c + f.x / {w}.0 * c.d)"
    ends = ", ".join(f"max(case when x = {x} and y = {y} then 255 - 2 * v end) {n}" for n, x, y in (("a", 0, 0), ("b", w, 0), ("c", 0, h), ("d", w, h)))
    _register("seamless_paste_whole", PX, pasted, f"select f.chan, f.y, f.x, round(f.v + {bent}, 2) v from f3 f join (select chan, {ends} from f3 group by chan) c on c.chan = f.chan where f.chan <> 0")
    near = "(select f.chan, f.y, f.x, f.v u, l.v g, m.v alpha from f3 f join ({}) l on l.chan = f.chan and l.y = f.y and l.x = f.x join f3 m on m.chan = 0 and m.y = f.y and m.x = f.x)".format(_laplacian("f1", False))
    _register("residual_two", PX, lambda s, d: joins.residual(scan.laplacian(X.f1(s, d)), X.f3(s, d)), f"select chan, y, x, case when alpha < 1 then 128 else u - g + 128 end v from {near}")
    _register("masked_add_two", PX, lambda s, d: joins.masked_add(X.f1(s, d), pointwise.opaque(X.f3(s, d)), X.f3(s, d)), "select f.chan, f.y, f.x, case when m.v >= 1 then f.v + c.v - 128 else f.v end v from f1 f join f3 c on c.chan = f.chan and c.y = f.y and c.x = f.x join f3 m on m.chan = 0 and m.y = f.y and m.x = f.x")


def _solved() -> None:
    kernel = (4, -0.5, -0.25, 0.125)
    _solved_on("", _small, "(select * from f1 where x < 24 and y < 20)", 24, 20)
    _solved_on("_page", lambda p: p, "(select * from f1)", 64, 48)
    _register("seamless_paste", PX, lambda s, d: solvers.seamless_paste(X.f3(s, d), pointwise.opaque(X.f3(s, d))))
    _register("deconvolve_3x3", PX, _f1(lambda p: _two(solvers.deconvolve_3x3(scan.convolve_3x3(p, *kernel), *kernel, tol=1e-9))), "select * from f1")
    _register("deconvolve_3x1", PX, _f1(lambda p: solvers.deconvolve_3x1(scan.convolve_3x3(p, 4, -1, 0, 0), -1, 4, -1)), "select * from f1")
    _register("deconvolve_1x3", PX, _f1(lambda p: solvers.deconvolve_1x3(scan.convolve_3x3(p, 4, 0, -1, 0), -1, 4, -1)), "select * from f1")
    _register("deconvolve_vector", "i v", lambda s, d: solvers.deconvolve_vector(scan.convolve_vector(X.f5(s, d), 1, 4, 1), 1, 4, 1), "select * from f5")
    _register("floyd_dither", PX, _f1(lambda p: solvers.floyd_dither(p, 64)), _diffused(64, "1", "3"))
    _register("floyd_dither_compat", PX, _f1(lambda p: solvers.floyd_dither(p, 64, compat=True)), _diffused(64, "case when back then 0 else 1 end", "case when back then 4 else 3 end"))


def _sourced() -> None:
    _register("pnm_roundtrip", PX, lambda s, d: to_px(pnm.read_images(pnm.encoded(pointwise.opaque(X.f3(s, d))).select(F.lit("p1.ppm").alias("path"), "content"))), "select * from f3 where chan <> 0")
    _register("pam_roundtrip", PX, lambda s, d: to_px(pnm.read_images(pnm.encoded(X.f3(s, d)).select(F.lit("p1.pam").alias("path"), "content"))), "select * from f3")
    _register("sample_bytes", "chan y x sample", _f1(lambda p: pnm.sample_bytes(p.withColumn("v", F.col("v") * 1.7 - 60))), "select chan, y, x, trunc(least(255, greatest(0, v * 1.7 - 60))) sample from f1")
    _register("vector_text", "line", lambda s, d: pnm.vector_text(X.f5(s, d)), "select printf('%d %f', i, v) line from f5")

    def paths(spark: SparkSession, d: str) -> DataFrame:
        return X.table(spark, d, "pages").select(F.concat(F.lit("scan/p"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"))

    _register("page_number", "path n", lambda s, d: paths(s, d).withColumn("n", pnm.page_number(F.col("path"))), "select 'scan/p' || page_id || '.png' path, page_id n from pages")
    _register("new_image", PX, lambda s, d: create.new_image(s, 2, 16, 8), "select c chan, y, x, 0.0 v from (select unnest([0, 1]) c) cross join (select unnest(range(16)) x) cross join (select unnest(range(8)) y)")
    _register("clone_shape", PX, _f1(lambda p: create.clone_shape(p, 0, 8, 0)), "select chan, y, x, 0.0 v from f1 where x < 8")
    _register("import_row", "i v", _f1(lambda p: create.import_row(p, 1, 7)), "select x i, v from f1 where y = 7")
    _register("import_column", "i v", _f1(lambda p: create.import_column(p, 1, 9)), "select y i, v from f1 where x = 9")
    _register("export_row", PX, _f1(lambda p: create.export_row(p, scan.cumul(create.import_row(p, 1, 7)), 1, 7)), "select chan, y, x, case when y = 7 then sum(v) over (partition by y order by x) else v end v from f1")


def _folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share; a local one only without a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = "/tmp/checkpoints/scanloom"
    path = f"{base.rstrip('/')}/raster-{uuid.uuid4().hex}"
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(root)
    return path


def _ran(words: str, *items: Callable[[SparkSession, str], DataFrame]) -> Query:
    """What lies on top of the stack after the words, run over the items; {} is a fresh folder."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        machine = pipeline.Machine(spark, _STDIN)
        for item in items:
            machine.push(item(spark, sf_dir))
        folder = _folder(spark) if "{}" in words else ""
        return pipeline.run(spark, words.replace("{}", folder).split(), _STDIN, machine).top()

    return query


#: A gray image with comments in its header, as standard input gives it.
_STDIN = b"P5 # gray\n# 12 by 5\n12 #w\n5\n255\n" + bytes((x * 7 + y * 31) % 256 for y in range(5) for x in range(12))


def _told() -> None:
    """The stack language, files and pages: what a user types."""
    bin_ = "select chan, y, x, case when v <= 127.5 then 0 else 255 end v from f1"
    stretched = "case when v <= 50 then 0 when v >= 200 then 255 else (v - 50) * 255 / 150.0 end"
    _register("stack_copy_swap_diff", PX, _ran("copy con 50 200 swap diff", X.f1), f"select chan, y, x, {stretched} - v + 128 v from f1")
    _register("stack_pop_unpop", PX, _ran("copy bin 0.5 pop unpop swap pop", X.f1), bin_)
    _register("stack_unpop_before", PX, _ran("con 0 10 half unpop", X.f1), "select chan, y, x, case when v <= 0 then 0 when v >= 10 then 255 else v * 25.5 end v from f1")
    _register("stack_quit", PX, _ran("bin 0.5 quit con 3 5 nonsense", X.f1), bin_)
    _register("stack_odd_pages", "pag y x v", _ran("odd bin 0.5 all", X.f4), "select pag, y, x, case when pag % 2 = 0 then v when v <= 127.5 then 0 else 255 end v from f4")
    _register("stack_page_number", "pag y x v", _ran("pag 17", X.f1), "select 17 pag, y, x, v from f1")
    _register("stack_clone", PX, _ran("clone 2 8 6", X.f1), "select c chan, y, x, 0.0 v from (select unnest([0, 1]) c) cross join (select unnest(range(8)) x) cross join (select unnest(range(6)) y)")
    _register("stack_stdin", PX, _ran("- cropx 2 12"), "select 1 chan, y, x - 2 x, (x * 7 + y * 31) % 256 v from (select unnest(range(12)) x) cross join (select unnest(range(5)) y) where x >= 2")
    _register("stack_write_read", f"pag {PX}", _ran("pag 7 w file:{}/p%03d.pgm {}/p007.pgm con 50 200", X.f1), f"select 7 pag, chan, y, x, {stretched} v from f1")
    _register("stack_write_read_pam", PX, _ran("pag 12 w file:{}/p%03d.pam {}/p012.pam", X.f3), "select * from f3")
    _register("stack_write_read_png", PX, _ran("pag 3 w file:{}/p%03d.png {}/p003.png", X.f3), "select * from f3")
    _register("stack_darker_files", PX, _ran("w file:{}/a.pgm w file:{}/b.pgm darker {}/a.pgm {}/b.pgm", X.f1, lambda s, d: _page_of_f3(s, d)), "select f.chan, f.y, f.x, least(f.v, g.v) v from f1 f join f3 g on g.chan = 1 and g.y = f.y and g.x = f.x")

    def to_output(spark: SparkSession, d: str) -> DataFrame:
        machine = pipeline.Machine(spark)
        machine.push(X.f1(spark, d))
        content = pipeline.run(spark, "w -".split(), machine=machine).output[0]
        return to_px(pnm.read_images(spark.createDataFrame([("-", content)], "path string, content binary")))

    _register("stack_write_output", PX, to_output, "select * from f1")

    def ex(words: str) -> Query:
        def query(spark: SparkSession, d: str) -> DataFrame:
            machine = pipeline.Machine(spark)
            machine.push(X.f1(spark, d))
            return machine.ex_of(pipeline.run(spark, words.split(), machine=machine).top())

        return query

    _register("stack_ex", "img ex", ex("copy ex 0.25 pop unpop swap pop double 0.5 half"), "select 1 img, 24.0 ex", "ex")
    _register("stack_ex_default", "img ex", ex("copy ex 30 pop"), "select 1 img, 30.0 ex", "ex")
    kinds = ["0.5", "a.png", "7", "-", "w", ".0", "+3", "1.", "1.2.3", "fix-bg", "-0"]
    _register("token_kinds", "line", lambda s, d: s.createDataFrame([(f"{t} {pipeline.token_kind(t)}",) for t in kinds], "line string"), "select unnest(['0.5 d', 'a.png f', '7 i', '- -', 'w w', '.0 d', '+3 i', '1. d', '1.2.3 f', 'fix-bg w', '-0 i']) line")
    _register("help_lines", "line", lambda s, d: s.createDataFrame([(x.split()[0],) for x in pipeline.run(s, ["--help"]).output[0].splitlines()], "line string"), "select unnest(['images', 'stack', 'planes', 'values', 'shape', 'solvers', 'figures', 'pages']) line")

    def message(words: str) -> str:
        try:
            pipeline.run(SparkSession.getActiveSession(), words.split())
        except pipeline.PipelineError as error:
            return str(error)
        return ""

    wrong = ("pop", "swap", "nonsense", "unpop", "image 1 1 1 pag 10000", "image 1 1 1 ex 0", "bin")
    _register("stack_errors", "line", lambda s, d: s.createDataFrame([(message(w),) for w in wrong], "line string"), "select unnest(['Missing image', 'Missing image', 'nonsense: unknown command', 'Nothing was popped', 'pag: the number is too large', 'ex: the height must be positive', 'a parameter is missing']) line")
    _register("new_vector", "i v", lambda s, d: create.new_vector(s, 9), "select unnest(range(9)) i, 0.0 v")
    _register("clear_vector", "i v", lambda s, d: create.clear_vector(X.f5(s, d)), "select i, 0.0 v from f5")
    _register("export_column", PX, _f1(lambda p: create.export_column(p, scan.cumul(create.import_column(p, 1, 9)), 1, 9)), "select chan, y, x, case when x = 9 then sum(v) over (partition by x order by y) else v end v from f1")
    _register("map_rows", PX, _f1(lambda p: map_rows(p, lambda samples, keys: samples[:, ::-1].cumsum(axis=1))), "select chan, y, 63 - x x, sum(v) over (partition by y order by x desc) v from f1")


def _page_of_f3(spark: SparkSession, d: str) -> DataFrame:
    return pointwise.extract_channel(X.f3(spark, d), 1)


for _part in (_pointwise, _joined, _shaped, _scanned, _reduced, _solved, _solved_large, _sourced, _told):
    _part()
