"""The same queries in plain SQL, written for another engine and from the definitions, to compare results with."""

from __future__ import annotations

import math

from ..functions.wcs import Wcs
from ..operators.smooth import SCALES, box_kernel, gaussian_kernel

SQL: dict[str, str] = {}

CUBE2 = """cube2 AS (SELECT CAST(l_quantity AS INT) AS x, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS y, count(*) AS i
                     FROM lineitem GROUP BY ALL)"""
CUBE3 = """cube3 AS (SELECT CAST(l_quantity AS INT) AS x, CAST(round(l_discount * 100) + 1 AS INT) AS y,
                            (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) AS v, count(*) AS i FROM lineitem GROUP BY ALL)"""
GRID2 = (
    CUBE2
    + """,
grid2 AS (SELECT a.x, b.y, CAST((b.y - 1) * 50 + a.x - 1 AS BIGINT) AS idx, coalesce(c.i, 0) AS i
          FROM range(1, 51) a(x), range(1, 84) b(y) LEFT JOIN cube2 c ON c.x = a.x AND c.y = b.y)"""
)
GRID3 = (
    CUBE3
    + """,
grid3 AS (SELECT a.x, b.y, e.v, CAST(((e.v - 1) * 11 + b.y - 1) * 50 + a.x - 1 AS BIGINT) AS idx, coalesce(c.i, 0) AS i
          FROM range(1, 51) a(x), range(1, 12) b(y), range(1, 29) e(v) LEFT JOIN cube3 c ON c.x = a.x AND c.y = b.y AND c.v = e.v)"""
)
RHO2 = (
    GRID2
    + """,
k3 AS (SELECT * FROM (VALUES (-1, 1), (0, 2), (1, 1)) t(d, w)),
rho AS (SELECT g.x, g.y, g.idx, any_value(g.i) AS i, CAST(sum(a.w * b.w * h.i) AS BIGINT) AS rho
        FROM grid2 g, k3 a, k3 b, grid2 h
        WHERE h.x = least(50, greatest(1, g.x + a.d)) AND h.y = least(83, greatest(1, g.y + b.d)) GROUP BY g.x, g.y, g.idx),
lev AS (SELECT CAST(sum(rho) AS DOUBLE) / count(*) AS mean, CAST(sum(rho * rho) AS DOUBLE) / count(*) AS sq FROM rho),
thr AS (SELECT mean, mean + sqrt(sq - mean * mean) AS top FROM lev),
bright AS (SELECT rho.* FROM rho, thr WHERE rho.rho > thr.mean)"""
)
LINK = (
    RHO2
    + """,
o1 AS (SELECT dx, dy FROM range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE dx <> 0 OR dy <> 0),
o4 AS (SELECT dx, dy FROM range(-4, 5) a(dx), range(-4, 5) b(dy) WHERE dx <> 0 OR dy <> 0),
p1 AS (SELECT a.idx, a.rho, b.idx AS pidx, b.rho AS prho, dx * dx + dy * dy AS d2, b.x AS bx, b.y AS byy
       FROM bright a, o1, bright b WHERE b.x = a.x + dx AND b.y = a.y + dy AND (b.rho > a.rho OR (b.rho = a.rho AND b.idx < a.idx))),
n1 AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY idx ORDER BY d2, bx DESC, byy DESC) = 1),
p4 AS (SELECT a.idx, a.rho, b.idx AS pidx, b.rho AS prho, dx * dx + dy * dy AS d2, b.x AS bx, b.y AS byy
       FROM (SELECT * FROM bright WHERE idx NOT IN (SELECT idx FROM n1)) a, o4, bright b
       WHERE b.x = a.x + dx AND b.y = a.y + dy AND (b.rho > a.rho OR (b.rho = a.rho AND b.idx < a.idx))),
n4 AS (SELECT * FROM p4 QUALIFY row_number() OVER (PARTITION BY idx ORDER BY d2, bx DESC, byy DESC) = 1),
link AS (SELECT b.x, b.y, b.idx, b.i, b.rho, n.pidx AS parent, n.d2, (n.prho - b.rho) / sqrt(n.d2) AS grad
         FROM bright b LEFT JOIN (SELECT * FROM n1 UNION ALL SELECT * FROM n4) n ON n.idx = b.idx),
cen AS (SELECT idx, row_number() OVER (ORDER BY idx) AS clump_id FROM link, thr WHERE rho > top AND (parent IS NULL OR d2 > 16))"""
)
LABEL = (
    LINK
    + """,
par AS (SELECT l.idx, CASE WHEN c.idx IS NULL THEN l.parent END AS parent FROM link l LEFT JOIN cen c ON c.idx = l.idx),
root AS (SELECT idx, idx AS root FROM par WHERE parent IS NULL UNION ALL SELECT p.idx, r.root FROM par p JOIN root r ON p.parent = r.idx),
lab AS (SELECT l.*, c.clump_id FROM link l JOIN root r ON r.idx = l.idx LEFT JOIN cen c ON c.idx = r.root)"""
)
CLUSTER = (
    LABEL
    + """,
span AS (SELECT clump_id, max(rho) - min(rho) AS s FROM lab WHERE clump_id IS NOT NULL GROUP BY clump_id),
st AS (SELECT lab.*, coalesce(lab.grad, -1) / (CASE WHEN s = 0 THEN 1 ELSE s END) > 0.01 AS steep FROM lab JOIN span ON span.clump_id = lab.clump_id),
mean AS (SELECT clump_id, avg(rho) AS m FROM st WHERE steep GROUP BY clump_id),
kept AS (SELECT st.* FROM st JOIN mean ON mean.clump_id = st.clump_id WHERE steep OR rho > m),
clu AS (SELECT x, y, idx, i, rho, dense_rank() OVER (ORDER BY clump_id) AS clump_id FROM kept)"""
)
MEASURE = (
    CLUSTER
    + """,
cat AS (SELECT clump_id AS id, arg_max(x, (i, -idx)) AS p1, arg_max(y, (i, -idx)) AS p2, max(i) AS peak, CAST(sum(i) AS BIGINT) AS total, count(*) AS volume,
               sum(i * x)::DOUBLE / sum(i) AS c1, sum(i * y)::DOUBLE / sum(i) AS c2,
               2.3548::DOUBLE * sqrt(greatest(sum(i * x * x)::DOUBLE / sum(i) - (sum(i * x)::DOUBLE / sum(i)) * (sum(i * x)::DOUBLE / sum(i)), 0)) AS s1,
               2.3548::DOUBLE * sqrt(greatest(sum(i * y * y)::DOUBLE / sum(i) - (sum(i * y)::DOUBLE / sum(i)) * (sum(i * y)::DOUBLE / sum(i)), 0)) AS s2
        FROM clu GROUP BY clump_id)"""
)
EDGE = "(p1 IN (1, 50) OR p2 IN (1, 83) OR c1 + 2 * s1 / 2.3548::DOUBLE > 50 OR c1 - 2 * s1 / 2.3548::DOUBLE < 1 OR c2 + 2 * s2 / 2.3548::DOUBLE > 83 OR c2 - 2 * s2 / 2.3548::DOUBLE < 1)"
CORE = "(c1 > 3 AND c1 <= 46 AND c2 > 3 AND c2 <= 79)"
PART = (
    CLUSTER
    + """,
near AS (SELECT a.idx AS a, b.idx AS b FROM clu a JOIN clu b ON a.clump_id = b.clump_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT idx AS a, idx AS b FROM clu UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
prt AS (SELECT c.*, m.part FROM clu c JOIN (SELECT a, min(b) AS part FROM reach GROUP BY a) m ON m.a = c.idx),
big AS (SELECT clump_id, part FROM (SELECT clump_id, part, count(*) AS n FROM prt GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY clump_id ORDER BY n DESC, part) = 1),
lp AS (SELECT prt.* FROM prt JOIN big ON big.clump_id = prt.clump_id AND big.part = prt.part)"""
)


def place(k: str, a: int, m: int) -> str:
    return f"1 + CAST({k} * {a} % {m} AS DOUBLE) / 100"


CAT3 = f"""cat AS (SELECT p_partkey AS id, {place("p_partkey", 7927, 11801)} AS k1, {place("p_partkey", 104723, 11801)} AS k2, {place("p_partkey", 1299721, 6801)} AS k3,
       {place("p_partkey", 7919, 11801)} AS c1, {place("p_partkey", 104729, 11801)} AS c2, {place("p_partkey", 1299709, 6801)} AS c3,
       4 + p_partkey % 5 + 0.5::DOUBLE AS s1, 3 + p_partkey % 4 + 0.25::DOUBLE AS s2, 5 + p_partkey % 6 + 0.125::DOUBLE AS s3,
       2 + p_partkey % 9 + CAST(p_partkey % 16 AS DOUBLE) / 16 AS peak, 100 + p_partkey % 1000 + CAST(p_partkey % 32 AS DOUBLE) / 32 AS total, 30 + p_partkey % 400 AS volume FROM part)"""


def r6(**names: str) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in names.items())


SQL["detect_2d"] = f"WITH RECURSIVE {MEASURE} SELECT id AS ID, p1 AS Peak1, p2 AS Peak2, {r6(Cen1='c1', Cen2='c2', Size1='s1', Size2='s2')}, peak AS Peak, total AS Sum, volume AS Volume FROM cat"
SQL["voxelize_2d"] = f"WITH {CUBE2} SELECT x, y, i AS intensity FROM cube2"
SQL["voxelize_3d"] = f"WITH {CUBE3} SELECT x, y, v, i AS intensity FROM cube3"
SQL["voxelize_events"] = "SELECT user_id % 50 + 1 AS x, day(ts) AS y, count(*) AS intensity FROM events GROUP BY ALL"
SQL["dense_grid"] = f"WITH {GRID3} SELECT x, y, v, idx, i AS intensity FROM grid3"
SQL["subcube_filter"] = f"WITH {CUBE3} SELECT x, y, v, i AS intensity FROM cube3 WHERE x BETWEEN 1 AND 20 AND v BETWEEN 10 AND 28"
SQL["nan_to_zero"] = "SELECT event_id, round(CASE WHEN event_id % 7 = 0 THEN 0 ELSE coalesce(value, 0) END, 6) AS intensity FROM events"
SQL["projection_maps"] = f"""WITH {CUBE3} SELECT CASE WHEN grouping(v) = 1 THEN 'xy' WHEN grouping(y) = 1 THEN 'xv' ELSE 'yv' END AS plane, x, y, v, CAST(sum(i) AS BIGINT) AS total
FROM cube3 GROUP BY GROUPING SETS ((x, y), (x, v), (y, v))"""
SQL["average_spectrum"] = f"WITH {GRID3}, m AS (SELECT v, x, avg(i) AS m FROM grid3 GROUP BY v, x) SELECT v, round(avg(m), 6) AS mean FROM m GROUP BY v"
SQL["lv_diagram"] = f"WITH {GRID3} SELECT v, x, round(avg(i), 6) AS mean FROM grid3 GROUP BY v, x"
SQL["bv_diagram"] = f"WITH {GRID3} SELECT v, y, round(avg(i), 6) AS mean FROM grid3 GROUP BY v, y"
SQL["bbox_crop"] = f"""WITH RECURSIVE {CLUSTER}, box AS (SELECT clump_id, min(x) - 1 AS xl, max(x) + 1 AS xh, min(y) - 1 AS yl, max(y) + 1 AS yh FROM clu GROUP BY clump_id)
SELECT clump_id, count(*) AS voxels, CAST(sum(i) AS BIGINT) AS total FROM box JOIN grid2 ON x BETWEEN xl AND xh AND y BETWEEN yl AND yh GROUP BY clump_id"""
SQL["smooth_binomial"] = f"WITH {RHO2} SELECT x, y, rho FROM rho"
SQL["smooth_binomial_3d"] = f"""WITH {GRID3}, k3 AS (SELECT * FROM (VALUES (-1, 1), (0, 2), (1, 1)) t(d, w))
SELECT g.x, g.y, g.v, CAST(sum(a.w * b.w * c.w * h.i) AS BIGINT) AS rho FROM grid3 g, k3 a, k3 b, k3 c, grid3 h
WHERE h.x = least(50, greatest(1, g.x + a.d)) AND h.y = least(11, greatest(1, g.y + b.d)) AND h.v = least(28, greatest(1, g.v + c.d)) GROUP BY ALL"""


def kernel(name: str, weights: list[float]) -> str:
    r = len(weights) // 2
    return f"{name} AS (SELECT d, CAST(w AS DOUBLE) AS w FROM (VALUES " + ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in enumerate(weights, -r)) + ") t(d, w))"


def clamped(out: str, name: str) -> str:
    """grid2 convolved with a kernel along x and y, the nearest value beyond the edge."""
    return f"""{out} AS (SELECT g.x, g.y, sum(a.w * b.w * h.i) AS g FROM grid2 g, {name} a, {name} b, grid2 h
        WHERE h.x = least(50, greatest(1, g.x + a.d)) AND h.y = least(83, greatest(1, g.y + b.d)) GROUP BY g.x, g.y)"""


SQL["smooth_gaussian"] = f"WITH {GRID2}, {kernel('k', gaussian_kernel(0.8))}, {clamped('s', 'k')} SELECT x, y, round(g, 6) AS rho FROM s"
SQL["adaptive_density"] = (
    f"WITH {GRID2}, "
    + ", ".join(f"{kernel(f'k{n}', gaussian_kernel(s))}, {clamped(f'g{n}', f'k{n}')}" for n, s in enumerate(SCALES))
    + ", u AS ("
    + " UNION ALL ".join(f"SELECT x, y, {n} AS n, g FROM g{n}" for n in range(len(SCALES)))
    + "), m AS (SELECT x, y, avg(g) AS m FROM u GROUP BY x, y) SELECT u.x, u.y, round(CAST(CAST(arg_min(g, (abs(g - m), n)) AS FLOAT) AS DOUBLE), 3) AS rho FROM u JOIN m ON m.x = u.x AND m.y = u.y GROUP BY u.x, u.y"
)
SQL["detail_residual"] = f"""WITH {GRID2}, {kernel("k", box_kernel(5, 1.0))},
b AS (SELECT g.x, g.y, any_value(g.i) AS i, sum(a.w * b.w * h.i) AS g FROM grid2 g, k a, k b, grid2 h WHERE h.x = g.x + a.d AND h.y = g.y + b.d GROUP BY g.x, g.y)
SELECT x, y, round(g, 6) AS blurred, round(i - g, 6) AS detail FROM b"""
SQL["difference_of_gaussians"] = (
    f"WITH {GRID2}, "
    + ", ".join(f"{kernel(f'k{n}', gaussian_kernel(0.4 * 1.05**n))}, {clamped(f'g{n}', f'k{n}')}" for n in range(16))
    + " "
    + " UNION ALL ".join(f"SELECT a.x, a.y, {n + 1} AS level, round(b.g - a.g, 6) AS difference FROM g{n} a JOIN g{n + 1} b ON a.x = b.x AND a.y = b.y" for n in range(15))
)
SQL["background_rms_median"] = "SELECT round(median(coalesce(CASE WHEN isnan(value) THEN 0 ELSE value END, 0)), 6) AS rms FROM events"
SQL["offmask_rms"] = f"WITH RECURSIVE {CLUSTER} SELECT round(sqrt(avg(i * i)), 6) AS rms FROM grid2 WHERE idx NOT IN (SELECT idx FROM clu)"
SQL["noise_cut"] = f"WITH {RHO2} SELECT idx, rho FROM bright"
SQL["neighbour_join"] = f"""WITH {RHO2} SELECT a.idx, count(*) AS n, CAST(sum(b.rho) AS BIGINT) AS total, CAST(sum((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS BIGINT) AS d2
FROM bright a JOIN bright b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.idx <> b.idx GROUP BY a.idx"""
SQL["nearest_higher"] = f"WITH {LINK} SELECT idx, rho, parent, d2, round(grad, 6) AS grad FROM link"
SQL["density_rank"] = f"WITH {RHO2} SELECT idx, row_number() OVER (ORDER BY rho DESC, idx) AS rank FROM bright"
SQL["cluster_centres"] = f"WITH {LINK} SELECT idx, clump_id FROM cen"
SQL["label_propagation"] = f"WITH RECURSIVE {LABEL} SELECT idx, clump_id FROM lab"
SQL["gradient_boundary"] = f"WITH RECURSIVE {CLUSTER} SELECT idx, clump_id FROM clu"
SQL["largest_component"] = f"WITH RECURSIVE {PART} SELECT idx, clump_id, part FROM lp"
SQL["area_span_filter"] = f"""WITH RECURSIVE {PART}, ok AS (SELECT clump_id FROM lp GROUP BY clump_id HAVING count(DISTINCT (x, y)) >= 15)
SELECT clump_id, count(*) AS n FROM clu WHERE clump_id IN (SELECT clump_id FROM ok) GROUP BY clump_id"""
SQL["mask_relabel"] = f"WITH RECURSIVE {CLUSTER} SELECT idx, dense_rank() OVER (ORDER BY clump_id) AS clump_id FROM clu WHERE clump_id % 3 <> 1"
SQL["clump_points"] = f"WITH RECURSIVE {CLUSTER} SELECT clump_id, x - min(x) OVER w AS x, y - min(y) OVER w AS y, i AS intensity FROM clu WINDOW w AS (PARTITION BY clump_id)"
SQL["peak_position"] = f"WITH RECURSIVE {MEASURE} SELECT id AS ID, p1 AS Peak1, p2 AS Peak2, peak AS Peak FROM cat"
SQL["orientation"] = f"""WITH RECURSIVE {CLUSTER}, foot AS (SELECT DISTINCT clump_id, x, y FROM clu),
m AS (SELECT clump_id, covar_pop(x, y) AS c, var_pop(y) - var_pop(x) AS d FROM foot GROUP BY clump_id)
SELECT clump_id, round(degrees(0.5 * atan2(2 * c, d)), 6) AS Angle FROM m WHERE abs(d) > 1e-6 AND abs(c) > 1e-6"""
SQL["touch_edge_filter"] = f"WITH RECURSIVE {MEASURE} SELECT id AS ID FROM cat WHERE NOT {EDGE}"
SQL["local_region"] = f"WITH RECURSIVE {MEASURE} SELECT id AS ID FROM cat WHERE {CORE}"
SQL["detect_counts"] = f"WITH RECURSIVE {MEASURE} SELECT count(*) AS found, count(*) FILTER (NOT {EDGE}) AS clear, count(*) FILTER (NOT {EDGE} AND {CORE}) AS core FROM cat"
SQL["round_catalog"] = f"WITH {CAT3} SELECT id AS ID, round_even(peak, 3) AS Peak, round_even(total, 3) AS Sum, round_even(s3, 3) AS Size3 FROM cat"
SQL["tile_ownership"] = f"""WITH {CAT3}, t AS (SELECT *, id % 3 AS ky, (id // 3) % 3 AS kx FROM cat)
SELECT id AS ID, printf('y%03dx%03d', ky, kx) AS tile FROM t
WHERE (kx = 0 OR c1 > kx * 40 + 0.5) AND (kx = 2 OR c1 <= kx * 40 + 40.5) AND (ky = 0 OR c2 > ky * 40 + 0.5) AND (ky = 2 OR c2 <= ky * 40 + 40.5)"""
SQL["mosaic_stitch"] = f"WITH {CUBE2} SELECT x, y, i AS intensity FROM cube2"
SQL["tile_split"] = f"""WITH {CUBE2}, t AS (SELECT kx, ky FROM range(0, 3) a(kx), range(0, 5) b(ky))
SELECT printf('y%03dx%03d', ky, kx) AS tile, count(*) AS n, CAST(sum(i) AS BIGINT) AS total FROM t JOIN cube2 ON x BETWEEN kx * 20 + 1 - 5 AND kx * 20 + 25 AND y BETWEEN ky * 20 + 1 - 5 AND ky * 20 + 25 GROUP BY ALL"""
SQL["tile_union"] = f"WITH {CAT3} SELECT c1 > 60 AS east, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM cat GROUP BY ALL"
SQL["row_setdiff"] = f"WITH {CUBE2} SELECT x, y FROM cube2 EXCEPT ALL SELECT user_id % 50 AS x, day(ts) AS y FROM (SELECT DISTINCT user_id % 50 AS user_id, ts::DATE AS ts FROM events) GROUP BY ALL"

_w = Wcs()
_d, _a = _w.pole


def world(p1: str, p2: str) -> tuple[str, str]:
    x = f"radians(({p1} - {_w.crpix[0]!r}::DOUBLE) * {_w.cdelt[0]!r}::DOUBLE)"
    y = f"radians(({p2} - {_w.crpix[1]!r}::DOUBLE) * {_w.cdelt[1]!r}::DOUBLE)"
    sd, cd = f"{math.sin(_d)!r}::DOUBLE", f"{math.cos(_d)!r}::DOUBLE"
    lat = f"degrees(asin(sin({y}) * {sd} + cos({y}) * {cd} * cos({x})))"
    lon = f"degrees({_a!r}::DOUBLE + atan2(-cos({y}) * sin({x}), sin({y}) * {cd} - cos({y}) * {sd} * cos({x})))"
    return f"({lon} + 720) % 360", lat


def speed(p3: str) -> str:
    return f"(({_w.crval[2]!r}::DOUBLE + ({p3} - 1) * {_w.cdelt[2]!r}::DOUBLE) / 1000)"


_k, _c = world("k1", "k2"), world("c1", "c2")
SQL["pix2world"] = f"""WITH {CAT3} SELECT id AS k, {r6(Peak1=_k[0], Peak2=_k[1], Peak3=speed("k3"), Cen1=_c[0], Cen2=_c[1], Cen3=speed("c3"), Size1="s1 * 30", Size2="s2 * 30", Size3="s3 * 0.166::DOUBLE")} FROM cat"""
SQL["world2pix"] = f"""WITH c AS (SELECT p_partkey AS id, 15.5::DOUBLE + CAST(p_partkey % 2001 AS DOUBLE) / 1000 AS lon, CAST(p_partkey * 7 % 1501 AS DOUBLE) / 1000 AS lat, 15 + CAST(p_partkey % 401 AS DOUBLE) / 10 AS vel FROM part),
r AS (SELECT *, radians(lon) - {_a!r}::DOUBLE AS l, radians(lat) AS b FROM c)
SELECT id AS ID, round(degrees(atan2(-cos(b) * sin(l), sin(b) * {math.cos(_d)!r}::DOUBLE - cos(b) * {math.sin(_d)!r}::DOUBLE * cos(l))) / {_w.cdelt[0]!r}::DOUBLE + 181, 6) AS x,
       round(degrees(asin(sin(b) * {math.sin(_d)!r}::DOUBLE + cos(b) * {math.cos(_d)!r}::DOUBLE * cos(l))) / {_w.cdelt[1]!r}::DOUBLE + 91, 6) AS y,
       round((vel * 1000 - {_w.crval[2]!r}::DOUBLE) / {_w.cdelt[2]!r}::DOUBLE + 1, 6) AS v FROM r"""
SQL["clump_id_format"] = """WITH c AS (SELECT p_partkey, CAST(p_partkey * 37 % 36000 AS DOUBLE) / 100 AS l, CAST(p_partkey % 401 - 200 AS DOUBLE) / 100 AS b, CAST(p_partkey * 3 % 2001 - 1000 AS DOUBLE) / 10 AS v FROM part)
SELECT p_partkey, 'MWISP' || printf('%07.3f', l) || CASE WHEN b < 0 THEN '-' ELSE '+' END || left(lpad(printf('%.3f', abs(b)), 6, '0'), 6)
       || CASE WHEN v < 0 THEN '-' ELSE '+' END || left(lpad(printf('%.3f', abs(v)), 6, '0'), 6) AS name FROM c"""
PAIRS = """s AS (SELECT id, c1 AS x, c2 AS y, c3 AS v, sqrt(s1 * s1 + s2 * s2) / 2.3548::DOUBLE AS s, s3 / 2.3548::DOUBLE AS sv FROM cat),
pairs AS (SELECT a.id AS src, b.id AS dst FROM s a JOIN s b ON a.id < b.id
          WHERE (a.s + b.s) * 0.8::DOUBLE > sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AND (a.sv + b.sv) * 0.8::DOUBLE > abs(a.v - b.v))"""
SQL["overlap_pairs"] = f"WITH {CAT3}, {PAIRS} SELECT src, dst FROM pairs"
SQL["overlap_components"] = f"""WITH RECURSIVE {CAT3}, {PAIRS}, e AS (SELECT src AS a, dst AS b FROM pairs UNION ALL SELECT dst, src FROM pairs),
reach AS (SELECT id AS a, id AS b FROM cat UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT a AS ID, min(b) AS component FROM reach GROUP BY a"""
F2 = "2.3548::DOUBLE"
SQL["fit_initial_guess"] = f"WITH {CAT3} SELECT id AS ID, {r6(A='peak', x0='c1', y0='c2', s1=f's1 / {F2}', s2=f's2 / {F2}', theta='0', v0='c3', s3=f's3 / {F2}')} FROM cat"
SQL["fit_bounds"] = f"""WITH {CAT3}, g AS (SELECT id, peak AS a, c1, c2, c3, s1 / {F2} AS s1, s2 / {F2} AS s2, s3 / {F2} AS s3 FROM cat)
SELECT id AS ID, {r6(A_lo="greatest(a - 3, 0.69)", A_hi="a + 3", x0_lo="c1 - s1", x0_hi="c1 + s1", s1_lo="least(0.5 * s1, 1)", s1_hi="1.5::DOUBLE * s1", theta_lo="-0.001", theta_hi="2 * pi()", v0_lo="c3 - s3", s3_hi="1.5::DOUBLE * s3")} FROM g"""
SQL["gaussian_model"] = f"""WITH {CAT3}, g AS (SELECT id, peak AS a, s1 / {F2} AS s1, s2 / {F2} AS s2, s3 / {F2} AS s3, CAST(id % 7 AS DOUBLE) / 10 AS t FROM cat)
SELECT id AS ID, round(a * exp(-(2.25 * (cos(t) ** 2 / (2 * s1 * s1) + sin(t) ** 2 / (2 * s2 * s2)) + 0.25 * (sin(t) ** 2 / (2 * s1 * s1) + cos(t) ** 2 / (2 * s2 * s2))
    - 0.75 * (sin(2 * t) / (2 * s2 * s2) - sin(2 * t) / (2 * s1 * s1)) + 1 / (2 * s3 * s3))), 6) AS m FROM g"""
FITS = "f AS (SELECT id, peak AS a, c1, c2, c3, CAST(id % 50 AS DOUBLE) / 10 AS t, 0.7::DOUBLE + CAST(id % 3 AS DOUBLE) / 4 AS s1, 0.8::DOUBLE + CAST(id % 5 AS DOUBLE) / 4 AS s2, 0.9::DOUBLE + CAST(id % 2 AS DOUBLE) / 4 AS s3 FROM cat)"
UNIT = f"{math.sqrt(2 * math.pi) * math.erf(3 / math.sqrt(2))!r}::DOUBLE"
FLUX = f"a * s1 * {UNIT} * s2 * {UNIT} * s3 * {UNIT}"
SQL["fit_flux_closed_form"] = f"WITH {CAT3}, {FITS} SELECT id AS ID, round({FLUX}, 6) AS flux FROM f"
SQL["fit_major_minor"] = f"""WITH {CAT3}, {FITS},
gx AS (SELECT id, unnest(range(0, CAST(ceil(6 * s1) AS BIGINT))) AS k FROM f), gy AS (SELECT id, unnest(range(0, CAST(ceil(6 * s2) AS BIGINT))) AS k FROM f), gv AS (SELECT id, unnest(range(0, CAST(ceil(6 * s3) AS BIGINT))) AS k FROM f),
m AS (SELECT f.*, gx.k - 3 * s1 AS dx, gy.k - 3 * s2 AS dy, gv.k - 3 * s3 AS dv FROM f JOIN gx ON gx.id = f.id JOIN gy ON gy.id = f.id JOIN gv ON gv.id = f.id),
n AS (SELECT id, count(*) FILTER (a * exp(-(dx * dx * (cos(t) ** 2 / (2 * s1 * s1) + sin(t) ** 2 / (2 * s2 * s2)) + dy * dy * (sin(t) ** 2 / (2 * s1 * s1) + cos(t) ** 2 / (2 * s2 * s2))
    + dx * dy * (sin(2 * t) / (2 * s2 * s2) - sin(2 * t) / (2 * s1 * s1)) + dv * dv / (2 * s3 * s3))) >= 0.5) AS vol FROM m GROUP BY id),
o AS (SELECT f.*, vol, {FLUX} AS flux, degrees(t) % 180 AS ang FROM f JOIN n ON n.id = f.id)
SELECT id AS ID, {r6(Size1=f"{F2} * greatest(s1, s2)", Size2=f"{F2} * least(s1, s2)", Theta="CASE WHEN s1 < s2 THEN (ang + 90) % 180 ELSE ang END", Sum="flux", Flux_SNR="CASE WHEN vol > 0 THEN flux / (0.5 * sqrt(vol)) ELSE flux / 0.5 END", Peak_SNR="a / 0.5")} FROM o"""
SQL["fit_world_catalog"] = f"""WITH {CAT3} SELECT id AS k, {r6(Galactic_Longitude=_c[0], Galactic_Latitude=_c[1], Velocity=speed("c3"), Size_major="s1 * 30", Size_minor="s2 * 30", Size_velocity="s3 * 0.166::DOUBLE", Flux="total * 0.166::DOUBLE")} FROM cat"""
SQL["fit_cost"] = f"WITH {CAT3}, r AS (SELECT id % 10 AS k, peak * exp(-(1 / (2 * (s1 / {F2}) * (s1 / {F2})))) - peak AS r FROM cat) SELECT k, round(sqrt(avg(r * r)), 6) AS cost FROM r GROUP BY k"

MATCH = f"""t AS (SELECT c_custkey AS i, {place("c_custkey", 7919, 11801)} AS x, {place("c_custkey", 104729, 11801)} AS y, {place("c_custkey", 1299709, 6801)} AS v,
    3.5::DOUBLE + c_custkey % 4 AS s1, 3.5::DOUBLE + c_custkey % 3 AS s2, 3.5::DOUBLE + c_custkey % 5 AS s3 FROM customer),
far AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 4 THEN 500.0::DOUBLE ELSE 0.0::DOUBLE END AS e FROM supplier),
f AS (SELECT s_suppkey AS j, {place("s_suppkey", 7919, 11801)} + CAST(s_suppkey * 7 % 15 - 7 AS DOUBLE) / 10 + e AS x, {place("s_suppkey", 104729, 11801)} + CAST(s_suppkey * 11 % 15 - 7 AS DOUBLE) / 10 + e AS y,
    {place("s_suppkey", 1299709, 6801)} + CAST(s_suppkey * 13 % 15 - 7 AS DOUBLE) / 10 + e AS v FROM far),
q AS (SELECT i, j, (t.x - f.x) * (t.x - f.x) + (t.y - f.y) * (t.y - f.y) + (t.v - f.v) * (t.v - f.v) AS d2,
    abs(t.x - f.x) <= least(2, s1 / {F2}) AND abs(t.y - f.y) <= least(2, s2 / {F2}) AND abs(t.v - f.v) <= least(2, s3 / {F2}) AS ok FROM t, f),
c AS (SELECT row_number() OVER (ORDER BY d2, i, j) AS n, * FROM q WHERE d2 <= 12.000001::DOUBLE),
g AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS us, CAST([] AS BIGINT[]) AS vs, CAST(0 AS BIGINT) AS n
      UNION ALL
      SELECT step + 1, list_append(us, b.i), list_append(vs, b.j), b.n
      FROM (SELECT g.step, g.us, g.vs, min(c.n) AS m FROM g JOIN c ON c.n > g.n AND NOT list_contains(g.us, c.i) AND NOT list_contains(g.vs, c.j) GROUP BY g.step, g.us, g.vs) p
      JOIN c b ON b.n = p.m WHERE b.ok),
hit AS (SELECT c.* FROM g JOIN c ON c.n = g.n)"""
SQL["match_pairs"] = f"WITH RECURSIVE {MATCH} SELECT i AS s_ID, j AS f_ID, round(sqrt(d2), 6) AS distance FROM hit"
SQL["match_miss"] = f"WITH RECURSIVE {MATCH} SELECT i AS s_ID FROM t WHERE i NOT IN (SELECT i FROM hit)"
SQL["match_false"] = f"WITH RECURSIVE {MATCH} SELECT j AS f_ID FROM f WHERE j NOT IN (SELECT j FROM hit)"
SQL["match_metrics"] = f"""WITH RECURSIVE {MATCH}, n AS (SELECT (SELECT count(*) FROM hit) AS m, (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM f) AS nf)
SELECT m AS matched, nt AS n_truth, nf AS n_found, round(m / nf, 6) AS precision, round(m / nt, 6) AS recall, round(2 * (m / nf) * (m / nt) / (m / nf + m / nt), 6) AS f1 FROM n"""
SQL["separability"] = f"""WITH {CAT3}, c AS (SELECT id, c1 AS x, c2 AS y, c3 AS v, s1 / 4 AS s, s3 / 4 AS sv FROM cat)
SELECT id AS ID FROM c a WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.id % 2 = 0 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < a.s + b.s AND abs(a.v - b.v) < a.sv + b.sv)"""
SQL["render_model"] = f"""WITH {CAT3}, g AS (SELECT id, 't' || (id % 4) AS tile, peak AS a, c1, c2, c3, s1 / {F2} AS s1, s2 / {F2} AS s2, s3 / {F2} AS s3 FROM cat),
h AS (SELECT *, ceil(greatest(s1, s2) * 4) AS w FROM g), gx AS (SELECT *, unnest(range(CAST(greatest(floor(c1) - w, 1) AS BIGINT), CAST(least(ceil(c1) + w, 120) AS BIGINT) + 1)) AS x FROM h),
gy AS (SELECT *, unnest(range(CAST(greatest(floor(c2) - w, 1) AS BIGINT), CAST(least(ceil(c2) + w, 120) AS BIGINT) + 1)) AS y FROM gx),
gv AS (SELECT *, unnest(range(CAST(greatest(floor(c3) - ceil(s3 * 4), 1) AS BIGINT), CAST(least(ceil(c3) + ceil(s3 * 4), 70) AS BIGINT) + 1)) AS v FROM gy),
m AS (SELECT tile, x, y, v, sum(a * exp(-((x - c1) * (x - c1) / (2 * s1 * s1) + (y - c2) * (y - c2) / (2 * s2 * s2) + (v - c3) * (v - c3) / (2 * s3 * s3)))) AS m FROM gv GROUP BY ALL)
SELECT tile, v, count(*) AS n, round(sum(m), 4) AS total FROM m GROUP BY tile, v"""
SQL["lognormal_fit"] = "SELECT round(stddev_pop(ln(l_extendedprice)), 6) AS sigma, round(exp(avg(ln(l_extendedprice))), 6) AS scale, count(*) AS n FROM lineitem WHERE l_extendedprice > 0"
HIST = "r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), h AS (SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 25), 24) AS BIGINT) AS bin, count(*) AS n FROM lineitem, r GROUP BY ALL)"
SQL["histogram"] = f"WITH {HIST} SELECT bin, n FROM h"
SQL["rank_correlation"] = f"""WITH {HIST}, f AS (SELECT stddev_pop(ln(l_extendedprice)) AS sigma, avg(ln(l_extendedprice)) AS mu FROM lineitem WHERE l_extendedprice > 0),
x AS (SELECT n, CAST(lo + (bin + 0.5) * (hi - lo) / 25 AS DOUBLE) AS x FROM h, r), d AS (SELECT n, exp(-(ln(x) - mu) * (ln(x) - mu) / (2 * sigma * sigma)) / (x * sigma * sqrt(2 * pi())) AS p FROM x, f),
k AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS b FROM d) SELECT round(corr(a, b), 6) AS rho FROM k"""
SQL["stratified_quota"] = """WITH w AS (SELECT floor(l_extendedprice * 4 / 20000) AS s, count(*) AS c FROM lineitem GROUP BY ALL), n AS (SELECT sum(c) AS n FROM w),
p AS (SELECT floor(o_totalprice / 20000) AS s, count(*) AS a FROM orders GROUP BY ALL)
SELECT CAST(w.s AS BIGINT) AS stratum, CAST(ceil(c / n * 1000) AS BIGINT) AS quota, a AS available, round(c / n, 6) AS share FROM w JOIN p ON p.s = w.s, n"""
SQL["clump_spectrum"] = f"""WITH {GRID3}, l AS (SELECT *, (x - 1) // 10 + 1 AS clump_id FROM grid3 WHERE i > 3),
b AS (SELECT clump_id, greatest(min(x) - 1, 1) AS xl, least(max(x) + 1, 50) AS xh, greatest(min(y) - 1, 1) AS yl, least(max(y) + 1, 11) AS yh, greatest(min(v) - 1, 1) AS vl, least(max(v) + 1, 28) AS vh FROM l GROUP BY clump_id)
SELECT b.clump_id, g.v, round(avg(CASE WHEN l.idx IS NOT NULL THEN g.i ELSE 0 END), 6) AS mean
FROM b JOIN grid3 g ON g.x BETWEEN xl AND xh AND g.y BETWEEN yl AND yh AND g.v BETWEEN vl AND vh LEFT JOIN l ON l.idx = g.idx AND l.clump_id = b.clump_id GROUP BY ALL"""
SQL["random_sample"] = "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':0'), o_orderkey LIMIT 100"
SQL["stratified_resample"] = """WITH w AS (SELECT floor(l_extendedprice * 4 / 20000) AS s, count(*) AS c FROM lineitem GROUP BY ALL), n AS (SELECT sum(c) AS n FROM w),
p AS (SELECT floor(o_totalprice / 20000) AS s, count(*) AS a FROM orders GROUP BY ALL), q AS (SELECT w.s, CAST(ceil(c / n * 1000) AS BIGINT) AS quota, a FROM w JOIN p ON p.s = w.s, n),
k AS (SELECT o.*, quota, a, row_number() OVER (PARTITION BY q.s ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':0'), o_orderkey) AS rank FROM orders o JOIN q ON floor(o_totalprice / 20000) = q.s),
e AS (SELECT *, unnest(range(1, CAST(ceil(quota / a) AS BIGINT) + 1)) AS copy FROM k)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, round(CAST(o_totalprice AS DOUBLE), 6) AS o_totalprice FROM e WHERE (copy - 1) * a + rank <= quota"""

# A southern header, from unit vectors: of the reference point, east and north of it.


def vectors(p1: str, p2: str, lon0: float, lat0: float, crpix: tuple) -> tuple[str, str]:
    a, d = math.radians(lon0), math.radians(lat0)
    out, east, north = (math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)), (-math.sin(a), math.cos(a), 0.0), (-math.sin(d) * math.cos(a), -math.sin(d) * math.sin(a), math.cos(d))
    x = f"radians(({p1} - {crpix[0]!r}::DOUBLE) * {_w.cdelt[0]!r}::DOUBLE)"
    y = f"radians(({p2} - {crpix[1]!r}::DOUBLE) * {_w.cdelt[1]!r}::DOUBLE)"
    at = [f"(cos({y}) * cos({x}) * {o!r}::DOUBLE + cos({y}) * sin({x}) * {e!r}::DOUBLE + sin({y}) * {n!r}::DOUBLE)" for o, e, n in zip(out, east, north, strict=True)]
    return f"(degrees(atan2({at[1]}, {at[0]})) + 720) % 360", f"degrees(asin({at[2]}))"


_south = lambda p1, p2: vectors(p1, p2, 30.0, -1.25, (20.0, 6.0))
_sl, _sb = _south("x", "y")
SOUTH3 = f"{CUBE3}, s AS (SELECT *, {_sl} AS lon, {_sb} AS lat, (12000 + (v - 4) * {_w.cdelt[2]!r}::DOUBLE) / 1000 AS vel FROM cube3)"
SQL["world_range_filter"] = f"WITH {SOUTH3} SELECT x, y, v, i AS intensity FROM s WHERE lon BETWEEN 29.904 AND 30.096 AND lat BETWEEN -9 AND -1.24 AND vel BETWEEN 12.1 AND 99"
SQL["world_range_clamp"] = f"""WITH {SOUTH3}, e AS (SELECT min(lon) AS l0, max(lon) AS l1, min(lat) AS b0, max(lat) AS b1, min(vel) AS v0, max(vel) AS v1 FROM s)
SELECT 'lon' AS axis, round(greatest(29.904, l0), 6) AS low, round(least(30.096, l1), 6) AS high, l0 > 29.904 OR l1 < 30.096 AS moved FROM e
UNION ALL SELECT 'lat', round(greatest(-9, b0), 6), round(least(-1.24, b1), 6), b0 > -9 OR b1 < -1.24 FROM e UNION ALL SELECT 'vel', round(greatest(12.1, v0), 6), round(least(99, v1), 6), v0 > 12.1 OR v1 < 99 FROM e"""
_s = _south("c1", "c2")
SQL["pix2world_south"] = f"WITH {CAT3} SELECT id AS ID, {r6(lon=_s[0], lat=_s[1], x='c1', y='c2')} FROM cat"
SQL["peak_spectrum"] = f"""WITH {GRID3}, p AS (SELECT p_partkey AS id, 1 + p_partkey * 7 % 50 AS x, 1 + p_partkey * 3 % 11 AS y, 1 + p_partkey * 5 % 28 AS z FROM part),
c AS (SELECT *, unnest(range(greatest(z - 6, 0) + 1, least(z + 6, 27) + 1)) AS v FROM p) SELECT c.id AS clump_id, c.v, g.i AS peak FROM c JOIN grid3 g ON g.x = c.x AND g.y = c.y AND g.v = c.v"""
SQL["fit_world2pix"] = f"WITH {CAT3} SELECT id AS k, {r6(Cen1='c1', Cen2='c2', Cen3='c3', Size1='s1', Size2='s2', Size3='s3', Theta='id % 180', Peak='peak', Sum='total * 0.166::DOUBLE', Flux_SNR='id / 7')} FROM cat"
SQL["fit_world_rounded"] = f"""WITH {CAT3} SELECT id AS k, {r6(Galactic_Longitude=f"round_even({_c[0]}, 3)", Galactic_Latitude=f"round_even({_c[1]}, 3)", Size_major="round_even(s1 * 30, 0)", Size_minor="round_even(s2 * 30, 0)", Theta="id % 180", Peak="round_even(peak, 1)")} FROM cat"""
_mean = "(s1 + s2) / 2"
BOXES = ", ".join(
    f"CAST(greatest(trunc({c} - 1 - 1.5::DOUBLE * {s}), 0) AS BIGINT) + 1 AS {a}_lo, CAST(least(trunc({c} + 1.5::DOUBLE * {s}), {n}) AS BIGINT) AS {a}_hi"
    for a, c, s, n in (("x", "c1", "s1", 120), ("y", "c2", f"({_mean})", 120), ("v", "c3", f"({_mean})", 70))
)
SQL["sized_boxes"] = f"WITH {CAT3} SELECT id AS clump_id, {BOXES} FROM cat"
SQL["world_axes"] = f"""WITH {CAT3}, b AS (SELECT *, {BOXES}, {_c[0]} AS lon, {_c[1]} AS lat, {speed("c3")} AS vel FROM cat)
SELECT id AS clump_id, {r6(lon_lo="lon - (c1 - x_lo + 1) / 120", lon_hi="lon + (x_hi - c1) / 120", lat_lo="lat - (c2 - y_lo + 1) / 120", lat_hi="lat + (y_hi - c2) / 120", vel_lo="vel - (c3 - v_lo + 1) * 0.166::DOUBLE", vel_hi="vel + (v_hi - c3) * 0.166::DOUBLE")} FROM b"""
SQL["neighbour_box"] = f"""WITH {CUBE3}, b AS (SELECT *, CAST(((v - 1) * 11 + y - 1) * 50 + x - 1 AS BIGINT) AS idx FROM cube3 WHERE i > 4)
SELECT a.idx, count(*) AS n, CAST(sum(b.i) AS BIGINT) AS total, CAST(sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.v - b.v) ** 2) AS BIGINT) AS d2
FROM b a JOIN b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND abs(a.v - b.v) <= 1 AND a.idx <> b.idx GROUP BY a.idx"""
SQL["fill_holes"] = f"""WITH RECURSIVE {CUBE2}, c AS (SELECT x, y, (y - 1) // 10 AS k FROM cube2 WHERE i > 12),
box AS (SELECT k, min(x) - 1 AS xl, max(x) + 1 AS xh, min(y) - 1 AS yl, max(y) + 1 AS yh FROM c GROUP BY k),
cell AS (SELECT k, xl, xh, yl, yh, x, unnest(range(yl, yh + 1)) AS y FROM (SELECT *, unnest(range(xl, xh + 1)) AS x FROM box)),
free AS (SELECT * FROM cell WHERE (k, x, y) NOT IN (SELECT k, x, y FROM c)),
out AS (SELECT k, x, y FROM free WHERE x IN (xl, xh) OR y IN (yl, yh) UNION SELECT f.k, f.x, f.y FROM out o JOIN free f ON f.k = o.k AND abs(f.x - o.x) + abs(f.y - o.y) = 1)
SELECT CAST(k AS BIGINT) AS clump_id, CAST((y - 1) * 50 + x - 1 AS BIGINT) AS idx FROM (SELECT k, x, y FROM c UNION ALL SELECT k, x, y FROM free WHERE (k, x, y) NOT IN (SELECT k, x, y FROM out))"""
SQL["mosaic_masks"] = f"""WITH {CUBE2}, l AS (SELECT x, y, (y - 1) // 20 AS ky, (x - 1) // 20 AS kx, x % 3 + 1 AS id FROM cube2 WHERE i > 12),
n AS (SELECT ky, kx, id, row_number() OVER (ORDER BY ky, kx, id) AS m FROM (SELECT DISTINCT ky, kx, id FROM l WHERE id <> 2))
SELECT CAST((y - 1) * 50 + x - 1 AS BIGINT) AS idx, m AS clump_id FROM l JOIN n USING (ky, kx, id)"""

# Detection on the cubes of all blocks of suppliers: the chain above, tile by tile.
SQL["detect_suppliers"] = f"""WITH RECURSIVE cube AS (SELECT l_suppkey // 25 AS t, CAST(l_quantity AS INT) AS x, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS y, count(*) AS i FROM lineitem GROUP BY ALL),
g AS (SELECT t.t, a.x, b.y, CAST((b.y - 1) * 50 + a.x - 1 AS BIGINT) AS idx, coalesce(c.i, 0) AS i FROM (SELECT DISTINCT t FROM cube) t, range(1, 51) a(x), range(1, 84) b(y) LEFT JOIN cube c ON c.t = t.t AND c.x = a.x AND c.y = b.y),
k3 AS (SELECT * FROM (VALUES (-1, 1), (0, 2), (1, 1)) t(d, w)),
rho AS (SELECT g.t, g.x, g.y, g.idx, any_value(g.i) AS i, CAST(sum(a.w * b.w * h.i) AS BIGINT) AS rho FROM g, k3 a, k3 b, g h
        WHERE h.t = g.t AND h.x = least(50, greatest(1, g.x + a.d)) AND h.y = least(83, greatest(1, g.y + b.d)) GROUP BY g.t, g.x, g.y, g.idx),
lev AS (SELECT CAST(sum(rho) AS DOUBLE) / count(*) AS mean, CAST(sum(rho * rho) AS DOUBLE) / count(*) AS sq FROM rho), thr AS (SELECT mean, mean + sqrt(sq - mean * mean) AS top FROM lev),
bright AS (SELECT rho.* FROM rho, thr WHERE rho.rho > thr.mean),
o1 AS (SELECT dx, dy FROM range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE dx <> 0 OR dy <> 0), o4 AS (SELECT dx, dy FROM range(-4, 5) a(dx), range(-4, 5) b(dy) WHERE dx <> 0 OR dy <> 0),
p1 AS (SELECT a.t, a.idx, b.idx AS pidx, b.rho AS prho, dx * dx + dy * dy AS d2, b.x AS bx, b.y AS byy FROM bright a, o1, bright b
       WHERE b.t = a.t AND b.x = a.x + dx AND b.y = a.y + dy AND (b.rho > a.rho OR (b.rho = a.rho AND b.idx < a.idx))),
n1 AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY t, idx ORDER BY d2, bx DESC, byy DESC) = 1),
p4 AS (SELECT a.t, a.idx, b.idx AS pidx, b.rho AS prho, dx * dx + dy * dy AS d2, b.x AS bx, b.y AS byy FROM (SELECT * FROM bright WHERE (t, idx) NOT IN (SELECT t, idx FROM n1)) a, o4, bright b
       WHERE b.t = a.t AND b.x = a.x + dx AND b.y = a.y + dy AND (b.rho > a.rho OR (b.rho = a.rho AND b.idx < a.idx))),
n4 AS (SELECT * FROM p4 QUALIFY row_number() OVER (PARTITION BY t, idx ORDER BY d2, bx DESC, byy DESC) = 1),
link AS (SELECT b.*, n.pidx AS parent, n.d2, (n.prho - b.rho) / sqrt(n.d2) AS grad FROM bright b LEFT JOIN (SELECT * FROM n1 UNION ALL SELECT * FROM n4) n ON n.t = b.t AND n.idx = b.idx),
cen AS (SELECT t, idx, row_number() OVER (PARTITION BY t ORDER BY idx) AS clump_id FROM link, thr WHERE rho > top AND (parent IS NULL OR d2 > 16)),
par AS (SELECT l.t, l.idx, CASE WHEN c.idx IS NULL THEN l.parent END AS parent FROM link l LEFT JOIN cen c ON c.t = l.t AND c.idx = l.idx),
root AS (SELECT t, idx, idx AS root FROM par WHERE parent IS NULL UNION ALL SELECT p.t, p.idx, r.root FROM par p JOIN root r ON p.t = r.t AND p.parent = r.idx),
lab AS (SELECT l.*, c.clump_id FROM link l JOIN root r ON r.t = l.t AND r.idx = l.idx JOIN cen c ON c.t = r.t AND c.idx = r.root),
span AS (SELECT t, clump_id, max(rho) - min(rho) AS s FROM lab GROUP BY ALL),
st AS (SELECT lab.*, coalesce(lab.grad, -1) / (CASE WHEN s = 0 THEN 1 ELSE s END) > 0.01 AS steep FROM lab JOIN span ON span.t = lab.t AND span.clump_id = lab.clump_id),
mean AS (SELECT t, clump_id, avg(rho) AS m FROM st WHERE steep GROUP BY ALL),
clu AS (SELECT st.t, x, y, idx, i, dense_rank() OVER (PARTITION BY st.t ORDER BY st.clump_id) AS clump_id FROM st JOIN mean ON mean.t = st.t AND mean.clump_id = st.clump_id WHERE steep OR rho > m),
cat AS (SELECT t, clump_id, arg_max(x, (i, -idx)) AS p1, arg_max(y, (i, -idx)) AS p2, max(i) AS peak, CAST(sum(i) AS BIGINT) AS total, count(*) AS volume, nullif(sum(i), 0)::DOUBLE AS m,
               sum(i * x)::DOUBLE AS sx, sum(i * y)::DOUBLE AS sy, sum(i * x * x)::DOUBLE AS qx, sum(i * y * y)::DOUBLE AS qy FROM clu GROUP BY t, clump_id)
SELECT format('s{{:05d}}', t) AS tile, clump_id AS ID, p1 AS Peak1, p2 AS Peak2, {r6(Cen1="sx / m", Cen2="sy / m", Size1="2.3548::DOUBLE * sqrt(greatest(qx / m - (sx / m) * (sx / m), 0))", Size2="2.3548::DOUBLE * sqrt(greatest(qy / m - (sy / m) * (sy / m), 0))")},
       peak AS Peak, total AS Sum, volume AS Volume FROM cat"""
SQL["decision_graph"] = f"""WITH {LINK}, w AS (SELECT greatest(coalesce(sqrt(max(d2)), 0), 4.001::DOUBLE) AS far FROM link)
SELECT idx, rho, coalesce(parent, idx) AS parent, round(coalesce(sqrt(d2), far), 6) AS delta FROM link, w"""
SQL["fit_in_bounds"] = f"""WITH {CAT3}, g AS (SELECT *, s1 / {F2} AS g1, s2 / {F2} AS g2, s3 / {F2} AS g3, s1 / {F2} * (id % 3 + 0.25::DOUBLE) AS t FROM cat)
SELECT id AS ID, abs(id % 5 - 2) <= g1 AND t >= least(g1 * 0.5, 1) AND t <= g1 * 1.5 AND g2 >= least(g2 * 0.5, 1) AND g3 >= least(g3 * 0.5, 1)
       AND peak >= greatest(peak - 3, 0.69::DOUBLE) AS inside FROM g"""
SQL["catalog_names"] = f"""WITH {CAT3} SELECT id AS ID, CAST(5 + 7 + 7 + 8 AS BIGINT) - 1 AS letters, {r6(Cen1='c1', lon=_c[0])} FROM cat"""
SQL["pix2world_fixed"] = f"WITH {CAT3} SELECT id AS k, {r6(Cen1=_c[0], Cen3=speed('c3'), Size1='s1 * 30', Size3='s3 * 0.166::DOUBLE')} FROM cat"
SQL["mosaic_rows"] = f"WITH {CUBE2} SELECT x, y, i AS intensity FROM cube2"
SQL["detect_log"] = f"""WITH RECURSIVE {MEASURE} SELECT '{{''x'': 50, ''y'': 83}}' AS shape, '2.0' AS rms, '4' AS delta_min, 'adaptive' AS sigma, count(*) AS clumps FROM cat"""


SQL["overlap_tiles"] = f"""WITH RECURSIVE {CAT3}, s AS (SELECT 't' || id % 4 AS tile, id // 4 AS id, c1 AS x, c2 AS y, c3 AS v,
     sqrt(power(s1 * CASE WHEN id % 97 = 5 THEN 20 ELSE 1 END, 2) + s2 * s2) / 2.3548::DOUBLE AS s, s3 / 2.3548::DOUBLE AS sv FROM cat),
e AS (SELECT a.tile, a.id AS a, b.id AS b FROM s a JOIN s b ON a.tile = b.tile AND a.id <> b.id
      WHERE (a.s + b.s) * 0.4::DOUBLE > sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AND (a.sv + b.sv) * 0.4::DOUBLE > abs(a.v - b.v)),
reach AS (SELECT tile, id AS a, id AS b FROM s UNION SELECT r.tile, r.a, e.b FROM reach r JOIN e ON e.tile = r.tile AND e.a = r.b)
SELECT tile, a AS ID, min(b) AS component FROM reach GROUP BY tile, a"""

SQL["nearest_higher_anywhere"] = f"""WITH {LINK}, alone AS (SELECT * FROM link WHERE parent IS NULL),
far AS (SELECT a.idx, b.idx AS parent, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, b.rho AS prho FROM alone a JOIN bright b ON b.rho > a.rho OR (b.rho = a.rho AND b.idx < a.idx)
        QUALIFY row_number() OVER (PARTITION BY a.idx ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.x DESC, b.y DESC) = 1)
SELECT l.idx, l.rho, coalesce(l.parent, f.parent) AS parent, coalesce(l.d2, f.d2) AS d2, round(CAST(coalesce(l.grad, (f.prho - l.rho) / sqrt(f.d2)) AS DOUBLE), 6) AS grad FROM link l LEFT JOIN far f ON f.idx = l.idx"""

#: Tiles are numbers here, and get their names at last.
SUPPLIERS = """blocks AS (SELECT l_suppkey // 25 AS tile, CAST(l_quantity AS INT) AS x, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS y, count(*) AS i FROM lineitem GROUP BY ALL)"""
SQL["decision_graph_anywhere"] = f"""WITH {SUPPLIERS}, cells AS (SELECT t.tile, a.x, b.y, (b.y - 1) * 50 + a.x - 1 AS idx, coalesce(c.i, 0) AS i
     FROM (SELECT DISTINCT tile FROM blocks) t, range(1, 51) a(x), range(1, 84) b(y) LEFT JOIN blocks c ON c.tile = t.tile AND c.x = a.x AND c.y = b.y),
k3 AS (SELECT * FROM (VALUES (-1, 1), (0, 2), (1, 1)) t(d, w)),
rho AS (SELECT g.tile, g.x, g.y, g.idx, CAST(sum(a.w * b.w * h.i) AS BIGINT) AS rho FROM cells g, k3 a, k3 b, cells h
        WHERE h.tile = g.tile AND h.x = least(50, greatest(1, g.x + a.d)) AND h.y = least(83, greatest(1, g.y + b.d)) GROUP BY ALL),
bright AS (SELECT * FROM rho WHERE rho > (SELECT CAST(sum(rho) AS DOUBLE) / count(*) FROM rho)),
o4 AS (SELECT dx, dy FROM range(-4, 5) a(dx), range(-4, 5) b(dy) WHERE dx <> 0 OR dy <> 0),
p4 AS (SELECT a.tile, a.idx, b.idx AS parent, dx * dx + dy * dy AS d2, b.x AS bx, b.y AS byy FROM bright a, o4, bright b
       WHERE b.tile = a.tile AND b.x = a.x + dx AND b.y = a.y + dy AND (b.rho > a.rho OR (b.rho = a.rho AND b.idx < a.idx))),
n4 AS (SELECT * FROM p4 QUALIFY row_number() OVER (PARTITION BY tile, idx ORDER BY greatest(abs(bx - (idx % 50 + 1)), abs(byy - (idx // 50 + 1))) > 1, d2, bx DESC, byy DESC) = 1),
alone AS (SELECT * FROM bright a WHERE NOT EXISTS (SELECT 1 FROM n4 WHERE n4.tile = a.tile AND n4.idx = a.idx)),
far AS (SELECT a.tile, a.idx, b.idx AS parent, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM alone a JOIN bright b ON b.tile = a.tile AND (b.rho > a.rho OR (b.rho = a.rho AND b.idx < a.idx))
        QUALIFY row_number() OVER (PARTITION BY a.tile, a.idx ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.x DESC, b.y DESC) = 1),
link AS (SELECT b.tile, b.idx, b.rho, n.parent, n.d2 FROM bright b LEFT JOIN (SELECT tile, idx, parent, d2 FROM n4 UNION ALL SELECT * FROM far) n ON n.tile = b.tile AND n.idx = b.idx),
wide AS (SELECT tile, sqrt(max(d2)) AS w FROM link GROUP BY tile)
SELECT 's' || lpad(CAST(link.tile AS VARCHAR), 5, '0') AS tile, idx, rho, coalesce(parent, idx) AS parent, round(CAST(coalesce(sqrt(d2), greatest(coalesce(w, 0.0), 4.001)) AS DOUBLE), 6) AS delta FROM link JOIN wide ON wide.tile = link.tile"""

SQL["connected_parts"] = f"""WITH RECURSIVE {SUPPLIERS}, lab AS (SELECT tile, x, y, (y - 1) * 50 + x - 1 AS idx, i % 2 AS clump_id FROM blocks WHERE i > 5),
near AS (SELECT a.tile, a.clump_id, a.idx AS a, b.idx AS b FROM lab a JOIN lab b ON a.tile = b.tile AND a.clump_id = b.clump_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT tile, clump_id, idx AS a, idx AS b FROM lab UNION SELECT r.tile, r.clump_id, r.a, n.b FROM reach r JOIN near n ON n.tile = r.tile AND n.clump_id = r.clump_id AND n.a = r.b)
SELECT 's' || lpad(CAST(tile AS VARCHAR), 5, '0') AS tile, idx, clump_id, part FROM (SELECT tile, a AS idx, clump_id, min(b) AS part FROM reach GROUP BY ALL)"""

SQL["reconcile_masks"] = f"""WITH RECURSIVE {RHO2}, cells AS (SELECT x, y, idx FROM rho, thr WHERE rho.rho > thr.top),
tiled AS (SELECT ky * 1000 + kx AS tile, x, y, idx FROM cells, range(5) a(ky), range(3) b(kx)
          WHERE ky BETWEEN greatest(0, floor((y - 6) / 20)) AND least(4, floor((y + 4) / 20)) AND kx BETWEEN greatest(0, floor((x - 6) / 20)) AND least(2, floor((x + 4) / 20))),
near AS (SELECT a.tile, a.idx AS a, b.idx AS b FROM tiled a JOIN tiled b ON a.tile = b.tile AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT tile, idx AS a, idx AS b FROM tiled UNION SELECT r.tile, r.a, n.b FROM reach r JOIN near n ON n.tile = r.tile AND n.a = r.b),
lab AS (SELECT tile, a AS idx, min(b) AS clump FROM reach GROUP BY tile, a),
e AS (SELECT DISTINCT a.tile AS t1, a.clump AS c1, b.tile AS t2, b.clump AS c2 FROM lab a JOIN lab b ON a.idx = b.idx),
whole AS (SELECT t1 AS tile, c1 AS clump, t1 AS t, c1 AS c FROM e UNION SELECT w.tile, w.clump, e.t2, e.c2 FROM whole w JOIN e ON e.t1 = w.t AND e.c1 = w.c),
root AS (SELECT tile, clump, min(struct_pack(t := t, c := c)) AS r FROM whole GROUP BY tile, clump)
SELECT lab.idx, CAST(min(n) AS BIGINT) AS mosaic_id FROM lab JOIN (SELECT tile, clump, dense_rank() OVER (ORDER BY r) AS n FROM root) k ON k.tile = lab.tile AND k.clump = lab.clump GROUP BY lab.idx"""

SQL["region_extras"] = f"""WITH RECURSIVE {CLUSTER} SELECT clump_id AS ID, count(*) AS Volume, CAST(sum(i * i) AS BIGINT) AS Squares, min(i) AS Least, count(*) FILTER (rho > (SELECT top FROM thr)) AS Bright,
       round(sum(i * x)::DOUBLE / sum(i), 6) AS Cen1 FROM clu GROUP BY clump_id"""

#: Both lie at odd and even places of a line, a step apart: place s is next to f = s - 1 and f = s; in the order of distance, s
#: and f, s takes s - 1 if there is one and the supplier before has left it, else s.
SQL["match_lattice"] = """WITH RECURSIVE n AS (SELECT (SELECT max(s_suppkey) FROM supplier) AS s, (SELECT max(c_custkey) FROM customer) AS c),
line AS (SELECT s_suppkey AS s, EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey - 1) AS lower, EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey) AS same FROM supplier),
walk AS (SELECT -1::BIGINT AS s, NULL::BIGINT AS f, false AS used UNION ALL
         SELECT walk.s + 1, CASE WHEN l.s IS NULL THEN NULL WHEN l.lower AND NOT walk.used THEN l.s - 1 WHEN l.same THEN l.s END, coalesce(NOT (l.lower AND NOT walk.used) AND l.same, false)
         FROM walk CROSS JOIN n LEFT JOIN line l ON l.s = walk.s + 1 WHERE walk.s < n.s)
SELECT s AS s_ID, f AS f_ID, 1.0::DOUBLE AS distance FROM walk WHERE f IS NOT NULL"""
