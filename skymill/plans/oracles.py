"""DuckDB SQL for the registered queries, written from the formulas and not from the plans."""

from __future__ import annotations

import math

import numpy as np

from ..config import unit_axis
from .palette_rows import MAGMA_ROWS, VIRIDIS_ROWS

AXIS = unit_axis((1.0, 2.0, 3.0))
PI = repr(math.pi)
#: Nodes and weights of the quadrature, computed here.
NODES = [(float(x), float(w)) for x, w in zip(*np.polynomial.legendre.leggauss(16), strict=True) if x > 0]
#: Evenly spaced colours of the palettes without tables.
EVEN_ROWS = {
    "hot": ((0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1)),
    "grayscale": ((0, 0, 0), (1, 1, 1)),
    "fire": ((0, 0, 0), (0.5, 0, 0), (1, 0, 0), (1, 0.5, 0), (1, 1, 0), (1, 1, 1)),
    "ice": ((0, 0, 0), (0, 0, 0.5), (0, 0, 1), (0, 1, 1), (1, 1, 1)),
    "coolwarm": ((0, 0, 1), (1, 1, 1), (1, 0, 0)),
    "inferno": ((0.001462, 0.000466, 0.013866), (0.3415, 0.055545, 0.417309), (0.735683, 0.215906, 0.330245), (0.977856, 0.572965, 0.152024), (0.988362, 0.998364, 0.644924)),
    "plasma": ((0.050383, 0.029803, 0.527975), (0.436508, 0.026239, 0.644324), (0.798216, 0.280197, 0.469538), (0.973416, 0.585761, 0.250652), (0.940015, 0.975158, 0.131326)),
}


def _e(i: int) -> str:
    """Component i, counted from zero, of a vector."""
    return f"CAST(embedding[{i + 1}] AS DOUBLE)"


def _wrap(p: str) -> str:
    return f"CASE WHEN {p} < 0 THEN {p} + 1e0 WHEN {p} >= 1e0 THEN {p} - 1e0 ELSE {p} END"


def _image_of(d: str) -> str:
    return f"CASE WHEN {d} > 5e-1 THEN {d} - 1e0 WHEN {d} < -5e-1 THEN {d} + 1e0 ELSE {d} END"


EMB = f"particles_emb AS (SELECT vec_id AS id, CAST(label % 6 AS INTEGER) AS ptype, {_e(0)} + 5e-1 AS x, {_e(1)} + 5e-1 AS y, {_e(2)} + 5e-1 AS z, {_e(3)} AS vx, {_e(4)} AS vy, {_e(5)} AS vz FROM embeddings)"


def _snap(name: str, scale: str, first: int, modulus: int, gone: int) -> str:
    xyz = ", ".join(f"{_wrap(f'({_e(i)} + 5e-1 + {scale} * {_e(first + i)})')} AS {a}" for i, a in enumerate("xyz"))
    return f"{name} AS (SELECT vec_id AS id, {xyz} FROM embeddings WHERE vec_id % {modulus} <> {gone})"


SNAP_B, SNAP_P, SNAP_N = _snap("snap_b", "15e-1", 6, 7, 3), _snap("snap_p", "-12e-1", 9, 11, 5), _snap("snap_n", "18e-1", 12, 13, 4)
EVT = """particles_evt AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS ptype,
  ((day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 2592e3 AS x, value / 5e2 AS y, ((user_id % 100) + 5e-1) / 1e2 AS z FROM events)"""
LI = "particles_li AS (SELECT CAST(l_linenumber - 1 AS INTEGER) AS ptype, l_quantity / 51e0 AS x, l_extendedprice / 105000e0 AS y, ((l_suppkey % 100) + 5e-1) / 1e2 AS z FROM lineitem)"


def _cic(name: str, source: str, n: int, lbox: str = "1e0", keys: str = "", compat: bool = False) -> str:
    """CTEs that deposit a source's x and y on an n*n image, four weights for each particle."""
    k = f"{keys}, " if keys else ""
    corners = " UNION ALL ".join(
        f"SELECT {k}iy + {dy} AS iy, ix + {dx} AS ix, {'tx' if dx else '(1 - tx)'} * {'ty' if dy else '(1 - ty)'} * w AS v FROM {name}_c" for dy in (0, 1) for dx in (0, 1)
    )
    inside = f"ix BETWEEN 0 AND {n - 1} AND " + (f"iy >= -{n}" if compat else f"iy BETWEEN 0 AND {n - 1}")
    row = f"(iy + {n}) % {n}" if compat else "iy"
    return f"""{name}_p AS (SELECT {k}(x - 5e-1) * {n} / {lbox} + {n / 2} AS px, (y - 5e-1) * {n} / {lbox} + {n / 2} AS py, {n * n}e0 / ({lbox} * {lbox}) AS w FROM {source}),
{name}_i AS (SELECT *, CAST(floor(px - 5e-1) AS INTEGER) AS ix, CAST(floor(py - 5e-1) AS INTEGER) AS iy FROM {name}_p),
{name}_c AS (SELECT *, px - (ix + 5e-1) AS tx, py - (iy + 5e-1) AS ty FROM {name}_i),
{name}_a AS ({corners}),
{name} AS (SELECT {k}{row} AS iy, ix, sum(v) AS rho FROM {name}_a WHERE {inside} GROUP BY ALL)"""


def _shown(name: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"SELECT * FROM (SELECT {k}CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, round(rho, 4) AS rho FROM {name}) WHERE rho > 0"


LI_MAP = f"WITH {LI}, {_cic('img', 'particles_li', 64)}"
BASIS = "(2*t*t*t - 3*t*t + 1) AS h00, (t*t*t - 2*t*t + t) AS h10, (3*t*t - 2*t*t*t) AS h01, (t*t*t - t*t) AS h11"
JOIN_B = "SELECT a.id, a.ptype, a.x, a.y, a.z, b.x AS xb, b.y AS yb, b.z AS zb, b.id IS NOT NULL AS has_b FROM particles_emb a LEFT JOIN snap_b b ON a.id = b.id"


def _hermite(source: str, keys: str) -> str:
    parts = []
    for a in "xyz":
        d = _image_of(f"({a}b - {a})")
        parts.append(f"CASE WHEN has_b THEN {_wrap(f'(h00*{a} + h10*({d}) + h01*({a} + ({d})) + h11*({d}))')} ELSE {a} END AS {a}")
    return f"SELECT {keys}, {', '.join(parts)} FROM {source}"


def _catmull(with_next: bool) -> str:
    parts = []
    for a in "xyz":
        d = _image_of(f"({a}b - {a})")
        m0 = f"(CASE WHEN has_p THEN ({_image_of(f'({a} - {a}p)')}) ELSE ({d}) END / 2)"
        m1 = f"(CASE WHEN has_n THEN ({_image_of(f'({a}n - {a})')}) ELSE ({d}) END / 2)" if with_next else f"(({d}) / 2)"
        parts.append(f"round(CASE WHEN has_b THEN {_wrap(f'(h00*{a} + h10*{m0} + h01*({a} + ({d})) + h11*{m1})')} ELSE {a} END, 6) AS {a}")
    more = ", n.x AS xn, n.y AS yn, n.z AS zn, n.id IS NOT NULL AS has_n" if with_next else ""
    joins = "LEFT JOIN snap_n n ON a.id = n.id" if with_next else ""
    return f"""WITH {EMB}, {SNAP_B}, {SNAP_P}, {SNAP_N},
m AS (SELECT a.id, a.ptype, a.x, a.y, a.z, b.x AS xb, b.y AS yb, b.z AS zb, b.id IS NOT NULL AS has_b, p.x AS xp, p.y AS yp, p.z AS zp, p.id IS NOT NULL AS has_p{more}, 4e-1 AS t
  FROM particles_emb a LEFT JOIN snap_b b ON a.id = b.id LEFT JOIN snap_p p ON a.id = p.id {joins}),
s AS (SELECT *, {BASIS} FROM m) SELECT id, ptype, {", ".join(parts)} FROM s"""


def _turned() -> str:
    kx, ky, kz = AXIS
    dot = f"({kx}*vx + {ky}*vy + {kz}*vz)"
    cross = (f"({ky}*vz - {kz}*vy)", f"({kz}*vx - {kx}*vz)", f"({kx}*vy - {ky}*vx)")
    turned = ", ".join(f"5e-1 + v{a}*cos(ang) + {cross[i]}*sin(ang) + {AXIS[i]}*{dot}*(1 - cos(ang)) AS {a}" for i, a in enumerate("xyz"))
    return f"""{EMB}, fr AS (SELECT CAST(range AS INTEGER) AS frame, radians(range * 25e0) AS ang FROM range(4)),
v AS (SELECT frame, ang, x - 5e-1 AS vx, y - 5e-1 AS vy, z - 5e-1 AS vz FROM particles_emb CROSS JOIN fr), turned AS (SELECT frame, {turned} FROM v)"""


def _grid(n: int, source: str) -> str:
    """CTEs for unit masses on an n**3 grid; source has px, py, pz in cells."""
    corners = " UNION ALL ".join(
        f"SELECT iz + {dz} AS iz, iy + {dy} AS iy, ix + {dx} AS ix, {'tx' if dx else '(1-tx)'} * {'ty' if dy else '(1-ty)'} * {'tz' if dz else '(1-tz)'} AS w FROM g_c" for dz in (0, 1) for dy in (0, 1) for dx in (0, 1)
    )
    return f"""g_i AS (SELECT *, CAST(floor(px - 5e-1) AS INTEGER) AS ix, CAST(floor(py - 5e-1) AS INTEGER) AS iy, CAST(floor(pz - 5e-1) AS INTEGER) AS iz FROM {source}),
g_c AS (SELECT *, px - (ix + 5e-1) AS tx, py - (iy + 5e-1) AS ty, pz - (iz + 5e-1) AS tz FROM g_i), g_a AS ({corners}),
grid AS (SELECT iz, iy, ix, sum(w) AS rho FROM g_a WHERE ix BETWEEN 0 AND {n - 1} AND iy BETWEEN 0 AND {n - 1} AND iz BETWEEN 0 AND {n - 1} GROUP BY ALL)"""


def _mean(n: int) -> str:
    width = " * ".join(f"(3 - (CASE WHEN {a} = 0 THEN 1 ELSE 0 END) - (CASE WHEN {a} = {n - 1} THEN 1 ELSE 0 END))" for a in ("iz", "iy", "ix"))
    return f"""d3 AS (SELECT CAST(range AS INTEGER) - 1 AS d FROM range(3)),
m_s AS (SELECT g.iz + a.d AS iz, g.iy + b.d AS iy, g.ix + c.d AS ix, rho FROM grid g, d3 a, d3 b, d3 c),
m_t AS (SELECT iz, iy, ix, sum(rho) AS total FROM m_s WHERE ix BETWEEN 0 AND {n - 1} AND iy BETWEEN 0 AND {n - 1} AND iz BETWEEN 0 AND {n - 1} GROUP BY ALL),
mean_grid AS (SELECT iz, iy, ix, total / ({width}) AS rho FROM m_t)"""


UNIT_GRID = f"WITH {EVT}, pos AS (SELECT x * 16 AS px, y * 16 AS py, z * 16 AS pz FROM particles_evt), {_grid(16, 'pos')}"
D2 = "((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"


def _knn(k: int) -> str:
    return f"{EMB}, pairs AS (SELECT a.id, {D2} AS r2 FROM particles_emb a, particles_emb b), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r2) AS rn FROM pairs), kth AS (SELECT id, r2 FROM ranked WHERE rn = {k})"


PLACE = "round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, count(*) AS n"


def _knn_li(k: int) -> str:
    """The k nearest line items in the cubes around each; those with too few within a cube's edge are compared with all."""
    around = ", ".join(f"CAST(range % {3 ** (i + 1)} // {3**i} - 1 AS INTEGER) AS d{x}" for i, x in enumerate("xyz"))
    return f"""WITH {LI}, li AS MATERIALIZED (SELECT row_number() OVER () AS id, x, y, z FROM particles_li), e AS (SELECT 25e-1 * pow({k} * 75e-2 / ({PI} * count(*)), 1e0 / 3) AS edge FROM li),
c AS (SELECT id, x, y, z, edge, {', '.join(f'CAST(floor({x} / edge) AS INTEGER) AS c{x}' for x in 'xyz')} FROM li, e), around AS (SELECT {around} FROM range(27)),
wide AS (SELECT id, x, y, z, cx + dx AS cx, cy + dy AS cy, cz + dz AS cz FROM c, around),
near AS (SELECT a.id, list_sort(min({D2}, {k})) AS best FROM wide a JOIN c b USING (cx, cy, cz) GROUP BY a.id),
poor AS (SELECT p.* FROM li p JOIN near USING (id), e WHERE len(best) < {k} OR best[{k}] > edge * edge),
kth AS (SELECT id, best[{k}] AS r2 FROM near ANTI JOIN poor USING (id) UNION ALL SELECT a.id, list_sort(min({D2}, {k}))[{k}] AS r2 FROM poor a, li b GROUP BY a.id)"""


WITH_H = f"{_knn(8)}, lengths AS (SELECT p.*, least(12e-1 * sqrt(r2), 125e-3) AS h FROM particles_emb p JOIN kth USING (id))"


def _profile(u: str) -> str:
    return f"(CASE WHEN {u} < 1 THEN 1 - 15e-1*{u}*{u} + 75e-2*{u}*{u}*{u} WHEN {u} < 2 THEN 25e-2*(2-{u})*(2-{u})*(2-{u}) ELSE 0e0 END)"


def _projected(q2: str) -> str:
    terms = " + ".join(f"2*{w}*{_profile(f'sqrt({q2} + (4-{q2})*{x * x!r})')}" for x, w in NODES)
    return f"CASE WHEN {q2} < 4 THEN sqrt(greatest(4 - {q2}, 0e0)) * ({terms}) / {PI} ELSE 0e0 END"


def _spline(u: str) -> str:
    return f"(8 / {PI} * CASE WHEN {u} < 5e-1 THEN 6*{u}*{u}*({u}-1) + 1 WHEN {u} < 1 THEN 2*(1-{u})*(1-{u})*(1-{u}) ELSE 0e0 END)"


def _table(top: float, value: str) -> str:
    return f"SELECT i, round(u, 8) AS u, round({value}, 8) AS value FROM (SELECT CAST(range AS INTEGER) AS i, CAST(range * {top / 64!r} AS DOUBLE) AS u FROM range(65))"


def _levels(source: str, keys: str, lo: str = "1e-1", hi: str = "1e0") -> str:
    part = f"PARTITION BY {keys}"
    return f"""lv_r AS (SELECT {keys}, log10(rho) AS v, row_number() OVER ({part} ORDER BY log10(rho)) - 1 AS i, count(*) OVER ({part}) AS n FROM {source} WHERE rho > 0),
lv_k AS (SELECT *, CAST(floor({lo} * (n - 1)) AS BIGINT) AS k0, least(CAST(floor({hi} * (n - 1)) AS BIGINT), n - 1) AS k1 FROM lv_r),
lv_f AS (SELECT *, CASE WHEN k1 <= k0 THEN least(k0 + 1, n - 1) ELSE k1 END AS k2 FROM lv_k),
lv_m AS (SELECT {keys}, max(n) AS n, max(CASE WHEN i = k0 THEN v END) AS vmin, max(CASE WHEN i = k2 THEN v END) AS vmax FROM lv_f GROUP BY ALL),
lv AS (SELECT {keys}, n, vmin, CASE WHEN vmax - vmin < 1e-2 THEN vmin + 1e-2 ELSE vmax END AS vmax FROM lv_m)"""


def _scaled(log_scale: bool) -> str:
    v = "(greatest(4e0, least(6e0, log10(CASE WHEN rho > 0 THEN rho ELSE 1e-30 END))) - 4e0) / (6e0 - 4e0)" if log_scale else "greatest(0e0, least(1e6, rho)) / 1e6"
    return f"{LI_MAP}, sc AS (SELECT CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, {v} AS t FROM img)"


def _rows(stops: list[tuple]) -> str:
    return "(VALUES " + ", ".join(f"({', '.join(f'CAST({float(x)!r} AS DOUBLE)' for x in s)})" for s in stops) + ")"


def _palettes() -> str:
    parts = []
    for n, colours in EVEN_ROWS.items():
        k = len(colours) - 1
        stops = _rows([(i, *c) for i, c in enumerate(colours)])
        rgb = ", ".join(f"round(a.{c} + (s.f - a.p) * (b.{c} - a.{c}), 6) AS {c}" for c in "rgb")
        parts.append(f"SELECT '{n}' AS cmap, s.i, {rgb} FROM (SELECT CAST(range AS INTEGER) AS i, range / 255e0 * {k} AS f FROM range(256)) s JOIN {stops} a(p, r, g, b) ON a.p = least(floor(s.f), {k - 1}) JOIN {stops} b(p, r, g, b) ON b.p = a.p + 1")
    for n, table in (("viridis", VIRIDIS_ROWS), ("magma", MAGMA_ROWS)):
        parts.append(f"SELECT '{n}' AS cmap, CAST(i AS INTEGER) AS i, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM {_rows([(i, *c) for i, c in enumerate(table)])} m(i, r, g, b)")
    return " UNION ALL ".join(parts)


def _inpaint() -> str:
    return f"""WITH {EMB}, {_cic('img', 'particles_emb', 32)}, known AS (SELECT CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, rho FROM img WHERE rho > 1e-4), grid AS (SELECT CAST(a.range AS INTEGER) AS iy, CAST(b.range AS INTEGER) AS ix FROM range(32) a, range(32) b),
near AS (SELECT g.iy, g.ix, avg(k.rho) AS rho FROM grid g JOIN known k ON abs(k.iy - g.iy) <= 1 AND abs(k.ix - g.ix) <= 1 AND NOT (k.iy = g.iy AND k.ix = g.ix) WHERE g.iy BETWEEN 1 AND 30 AND g.ix BETWEEN 1 AND 30 GROUP BY ALL)
SELECT 0 AS frame, g.iy, g.ix, round(coalesce(k.rho, n.rho), 4) AS rho FROM grid g LEFT JOIN known k USING (iy, ix) LEFT JOIN near n USING (iy, ix) WHERE coalesce(k.rho, n.rho) > 0"""


def _grid_lengths() -> str:
    n, cells = 16, 16**3
    corners = " UNION ALL ".join(
        f"SELECT id, iz + {dz} AS iz, iy + {dy} AS iy, ix + {dx} AS ix, {'tx' if dx else '(1-tx)'} * {'ty' if dy else '(1-ty)'} * {'tz' if dz else '(1-tz)'} AS w FROM g_c" for dz in (0, 1) for dy in (0, 1) for dx in (0, 1)
    )
    return f"""WITH {EVT}, b AS (SELECT count(*) AS n, {', '.join(f'min({a}) - 1e-4 AS l{a}, max({a}) + 1e-4 - (min({a}) - 1e-4) AS s{a}' for a in 'xyz')} FROM particles_evt),
pos AS (SELECT id, {', '.join(f'({a} - l{a}) * {n} / s{a} AS p{a}' for a in 'xyz')} FROM particles_evt, b), {_grid(n, 'pos')}, {_mean(n)}, back AS ({corners}),
got AS (SELECT id, sum(w * coalesce(m.rho, 0)) AS rho FROM back k LEFT JOIN mean_grid m USING (iz, iy, ix) GROUP BY id)
SELECT id, round(CASE WHEN rho >= 1e-1 * n / {cells}e0 THEN least(12e-1 * pow(3 * 32 * sx * sy * sz / {cells}e0 / (4 * {PI}), 1e0/3) / pow(rho, 1e0/3), 8 * 20e0 / 768) END, 6) AS h FROM got, b"""


def _first_splits() -> str:
    def step(source: str, name: str) -> str:
        return f"""{name}_b AS (SELECT node, count(*) AS n, max(x)-min(x) AS sx, max(y)-min(y) AS sy, max(z)-min(z) AS sz FROM {source} GROUP BY node),
{name}_r AS (SELECT s.*, n, row_number() OVER (PARTITION BY s.node ORDER BY CASE WHEN sx >= sy AND sx >= sz THEN x WHEN sy >= sz THEN y ELSE z END, id) AS rn FROM {source} s JOIN {name}_b USING (node)),
{name} AS (SELECT id, x, y, z, 2 * node + CASE WHEN rn > n // 2 THEN 1 ELSE 0 END AS node FROM {name}_r)"""

    return f"WITH {EMB}, s0 AS (SELECT id, x, y, z, CAST(1 AS BIGINT) AS node FROM particles_emb), {step('s0', 's1')}, {step('s1', 's2')} SELECT id, node FROM s2"


def _opened() -> str:
    sql, seen = [EMB], []
    for level in range(3):
        e = 0.5**level
        sql.append(f"c{level} AS (SELECT {', '.join(f'CAST(floor({a} / {e}) AS BIGINT) AS c{a}' for a in 'xyz')}, {', '.join(f'avg({a}) AS m{a}' for a in 'xyz')} FROM particles_emb GROUP BY ALL)")
        if level == 0:
            sql.append("w0 AS (SELECT p.id, p.x, p.y, p.z, c.* FROM particles_emb p JOIN c0 c ON " + " AND ".join(f"abs(c.c{a} - floor(p.{a})) <= 1" for a in "xyz") + ")")
        else:
            sql.append(f"w{level} AS (SELECT p.id, p.x, p.y, p.z, c.* FROM o{level - 1} p JOIN c{level} c ON " + " AND ".join(f"floor(c.c{a} / 2e0) = p.c{a}" for a in "xyz") + ")")
        sql.append(f"o{level} AS (SELECT * FROM w{level} WHERE ((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)) * 7e-1 * 7e-1 < {e * e})")
        seen.append(f"SELECT id FROM w{level}")
    return f"WITH {', '.join(sql)} SELECT id, count(*) AS n_cells FROM ({' UNION ALL '.join(seen)}) GROUP BY id"


def _tree(source: str, axes: str, bucket: int, depth: int) -> str:
    """CTEs: nodes, every cell of every level whose cell above holds more than a bucket."""
    cells = ", ".join(f"greatest(0, CAST(ceil((p.{a} - l{a}) / s{a} * {2**depth}) AS BIGINT) - 1) AS c{a}" for a in axes)
    digit = " + ".join(f"((c{a} >> ({depth} - i)) & 1) * {1 << k}" for k, a in enumerate(axes))
    ends = ", ".join(f"min({a}) AS l{a}, max({a}) - min({a}) AS s{a}" for a in axes)
    stats = ", ".join(f"avg({a}) AS mean_{a}, any_value(l{a} + (c{a} >> ({depth} - level)) * s{a} / (1 << level)) AS low_{a}, any_value(l{a} + ((c{a} >> ({depth} - level)) + 1) * s{a} / (1 << level)) AS high_{a}" for a in axes)
    return f"""t_b AS (SELECT {ends} FROM {source}), t_c AS (SELECT p.*, t_b.*, {cells} FROM {source} p, t_b),
t_e AS (SELECT *, CAST(list_aggregate(list_transform(range(1, level + 1), lambda i: CAST({digit} AS VARCHAR)), 'string_agg', '') AS VARCHAR) AS digits FROM (SELECT t_c.*, CAST(range AS INTEGER) AS level FROM t_c, range({depth + 1}))),
t_n AS (SELECT coalesce(digits, '') AS path, level, count(*) AS n, {stats} FROM t_e GROUP BY coalesce(digits, ''), level),
nodes AS MATERIALIZED (SELECT c.*, c.n > {bucket} AND c.level < {depth} AS split FROM t_n c WHERE level = 0 OR EXISTS (SELECT 1 FROM t_n p WHERE p.level = c.level - 1 AND p.path = left(c.path, c.level - 1) AND p.n > {bucket}))"""


def _tree_nodes(views: str, source: str, axes: str, bucket: int, depth: int) -> str:
    shown = ", ".join(f"round({k}_{a}, 6) AS {k}_{a}" for k in ("mean", "low", "high") for a in axes)
    between = "translate(path, '01234567', '02345678') || '1'"
    return f"WITH {views}, {_tree(source, axes, bucket, depth)} SELECT path, level, split, n, {shown}, row_number() OVER (ORDER BY path) AS index, row_number() OVER (ORDER BY {between}) - 1 AS place FROM nodes"


def _tree_walks() -> str:
    last = 2**6 - 1
    cells = ", ".join(f"least({last}, greatest(0, CAST(ceil((q.{a} - low_{a}) / (high_{a} - low_{a}) * 64) AS BIGINT) - 1)) AS c{a}" for a in "xyz")
    digit = " + ".join(f"((c{a} >> (6 - i)) & 1) * {1 << k}" for k, a in enumerate("xyz"))
    over = " AND ".join(f"q.{a} - 5e-2 < high_{a} AND q.{a} + 5e-2 > low_{a}" for a in "xyz")
    return f"""WITH {EMB}, {_tree('particles_emb', 'xyz', 8, 6)}, q AS (SELECT id, x + 1e-1 AS x, y, z FROM particles_emb),
w AS (SELECT id, list_aggregate(list_transform(range(1, 7), lambda i: CAST({digit} AS VARCHAR)), 'string_agg', '') AS whole FROM (SELECT id, {cells} FROM q, nodes r WHERE r.level = 0)),
deep AS (SELECT id, arg_max(path, level) AS path, arg_max(n, level) AS n FROM w JOIN nodes ON path = left(whole, level) GROUP BY id),
near AS (SELECT id, count(*) AS n_leaves, sum(n) AS n_members FROM q JOIN nodes ON NOT split AND {over} GROUP BY id)
SELECT id, path, n, coalesce(n_leaves, 0) AS n_leaves, CAST(coalesce(n_members, 0) AS BIGINT) AS n_members FROM deep LEFT JOIN near USING (id)"""


def _composite() -> str:
    rgb = ", ".join(f"{_byte(f'(g * sqrt(u) + {b} * 1e0 * (1 - sqrt(u))) / (sqrt(u) + 1e0 * (1 - sqrt(u)))')} AS {n}" for n, b in (("r", "2e-1"), ("g", "4e-1"), ("b", "6e-1")))
    # Gray is linear in t between its 256 rows as well.
    return f"{_scaled(True)}, q AS (SELECT iy, ix, round(t, 6) AS u, round(t, 6) AS g FROM sc) SELECT iy, ix, {rgb}, 255 AS a FROM q"


def _looked_up(source: str, name: str) -> str:
    """CTEs: the source's rows and r, g, b of its t in magma."""
    rgb = ", ".join(f"a.{c} + (s.f - a.i) * (b.{c} - a.{c}) AS {c}" for c in "rgb")
    return f"""m AS (SELECT * FROM {_rows([(i, *c) for i, c in enumerate(MAGMA_ROWS)])} m(i, r, g, b)), {name}_f AS (SELECT *, least(1e0, greatest(0e0, t)) * 255 AS f FROM {source}),
{name} AS (SELECT s.* EXCLUDE (f), {rgb} FROM {name}_f s JOIN m a ON a.i = floor(s.f) JOIN m b ON b.i = least(floor(s.f) + 1, 255))"""


def _byte(v: str) -> str:
    return f"CAST(floor(least(1e0, greatest(0e0, {v})) * 255 + 5e-1) AS INTEGER)"


def _magma() -> str:
    return f"{_scaled(True)}, {_looked_up('sc', 'c')} SELECT iy, ix, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM c"


def _filled(source: str, n: int, passes: int = 64) -> str:
    """CTEs: full, the source's positive pixels after all passes of hole filling."""
    out = [f"grid AS MATERIALIZED (SELECT CAST(a.range AS INTEGER) AS iy, CAST(b.range AS INTEGER) AS ix FROM range({n}) a, range({n}) b)", "off AS (SELECT CAST(a.range AS INTEGER) - 1 AS dy, CAST(b.range AS INTEGER) - 1 AS dx FROM range(3) a, range(3) b WHERE a.range <> 1 OR b.range <> 1)", f"f0 AS MATERIALIZED (SELECT CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, rho FROM {source} WHERE rho > 0)"]
    for i in range(passes):
        near = f"SELECT iy + dy AS iy, ix + dx AS ix, avg(rho) AS near FROM f{i}, off WHERE iy + dy BETWEEN 1 AND {n - 2} AND ix + dx BETWEEN 1 AND {n - 2} GROUP BY ALL"
        out.append(f"f{i + 1} AS MATERIALIZED (SELECT iy, ix, coalesce(rho, near) AS rho FROM f{i} FULL JOIN ({near}) USING (iy, ix))")
    return ", ".join([*out, f"full_image AS (SELECT * FROM f{passes})"])


def _inpaint_full() -> str:
    return f"WITH {EMB}, {_cic('img', 'particles_emb', 32)}, known AS (SELECT * FROM img WHERE rho > 1e-4), {_filled('known', 32)} SELECT * FROM (SELECT 0 AS frame, iy, ix, round(rho, 4) AS rho FROM full_image) WHERE rho > 0"


def _full_render() -> str:
    """Floor at a ten-thousandth, filling, levels of what is filled, magma by the square root's opacity over black."""
    rgb = ", ".join(f"{_byte(f'({c} * o + 0e0) / (o + 1e0 * (1 - o))')} AS {c}" for c in "rgb")
    return f"""{LI_MAP}, known AS (SELECT * FROM img WHERE rho >= 1e-4), {_filled('known', 64)}, fr AS (SELECT 0 AS frame, rho FROM full_image), {_levels('fr', 'frame')},
n AS (SELECT iy, ix, rho, (greatest(vmin, least(vmax, log10(rho))) - vmin) / (vmax - vmin) AS t FROM full_image, lv), {_looked_up('n', 'c')}, o AS (SELECT *, sqrt(least(1e0, greatest(0e0, t))) AS o FROM c)
SELECT 0 AS frame, iy, ix, round(rho, 4) AS rho, {rgb}, {_byte('o + 1e0 * (1 - o)')} AS a FROM o"""


def _png() -> str:
    shown = ", ".join(f"coalesce({_byte(c)}, 0) AS {c}" for c in "rgb")
    return f"{_scaled(True)}, {_looked_up('sc', 'c')}, grid AS (SELECT CAST(a.range AS INTEGER) AS iy, CAST(b.range AS INTEGER) AS ix FROM range(64) a, range(64) b) SELECT 0 AS frame, grid.iy, grid.ix, {shown}, 255 AS a FROM grid LEFT JOIN c USING (iy, ix)"


def _leaf_lengths(levels: int = 16) -> str:
    """Nodes of more than 32 rows are halved, level by level; as many levels as 2 million particles need."""
    out = [EMB, "s0 AS MATERIALIZED (SELECT id, x, y, z, CAST(1 AS BIGINT) AS node FROM particles_emb)"]
    for i in range(levels):
        spans = f"SELECT node, count(*) AS n, max(x)-min(x) AS sx, max(y)-min(y) AS sy, max(z)-min(z) AS sz FROM s{i} GROUP BY node"
        ranked = f"SELECT s.*, n, row_number() OVER (PARTITION BY s.node ORDER BY CASE WHEN sx >= sy AND sx >= sz THEN x WHEN sy >= sz THEN y ELSE z END, id) AS rn FROM s{i} s JOIN ({spans}) USING (node)"
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT id, x, y, z, CASE WHEN n <= 32 THEN node ELSE 2 * node + CASE WHEN rn > n // 2 THEN 1 ELSE 0 END END AS node FROM ({ranked}))")
    volume = " * ".join(f"CASE WHEN max({a}) - min({a}) > 1e-10 THEN max({a}) - min({a}) ELSE 1e0 END" for a in "xyz")
    out.append(f"d AS (SELECT node, count(*) / ({volume} + 1e-30) AS density FROM s{levels} GROUP BY node)")
    # Nodes that stop early keep their number, which no child of another node has.
    return f"WITH {', '.join(out)} SELECT id, round(least(12e-1 * cbrt(32 / (density * (4e0 / 3 * {PI}))), 8 * 1e0 / 64), 6) AS h FROM s{levels} JOIN d USING (node)"


STOPS = [(0.2, 0.0, 0.1, 0.5), (0.5, 0.3, 0.9, 0.4), (0.5, 0.6, 0.2, 0.1), (0.9, 1.0, 0.8, 0.0)]


def _custom() -> str:
    parts = []
    for c, n in ((1, "r"), (2, "g"), (3, "b")):
        case = f"CASE WHEN t <= {STOPS[0][0]!r} THEN {STOPS[0][c]!r}"
        for a, b in zip(STOPS, STOPS[1:], strict=False):
            f = f"(t - {a[0]!r}) / {b[0] - a[0]!r}" if b[0] > a[0] else "5e-1"
            case += f" WHEN t <= {b[0]!r} THEN {a[c]!r} + {f} * {b[c] - a[c]!r}"
        parts.append(f"round(CAST({case} ELSE {STOPS[-1][c]!r} END AS DOUBLE), 6) AS {n}")
    return f"SELECT i, {', '.join(parts)} FROM (SELECT CAST(range AS INTEGER) AS i, range / 1e2 AS t FROM range(101))"


HIST = f"WITH {LI}, hist AS (SELECT CAST(greatest(0, least(255, trunc(x * 256e0))) AS INTEGER) AS bin, count(*) AS n FROM particles_li GROUP BY ALL)"
SPLITS = f"""{HIST}, cum AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS c FROM hist), tot AS (SELECT sum(n) AS total FROM hist),
ends AS (SELECT k.range AS slab, coalesce((SELECT min(bin) + 1 FROM cum, tot WHERE c * 5 >= k.range * total), 256) AS e FROM range(1, 5) k),
rising AS (SELECT slab, least(256, max(e - slab) OVER (ORDER BY slab) + slab) AS end_bin FROM ends UNION ALL SELECT 5, 256),
splits AS (SELECT CAST(slab - 1 AS INTEGER) AS slab, CAST(coalesce(lag(end_bin) OVER (ORDER BY slab), 0) AS INTEGER) AS first_bin, CAST(end_bin AS INTEGER) AS end_bin FROM rising)"""

def _single(p: str) -> str:
    return f"CAST(CAST({p} AS FLOAT) AS DOUBLE)"


MOVING = ", ".join(f"round({_single(c)}, 6) AS {c}" for c in ("x", "y", "z", "vx", "vy", "vz"))
HEADERS = f"""WITH {EMB} SELECT CAST(t.range AS INTEGER) AS ptype, 8e-1 AS time, 25e-2 AS redshift, 3 AS num_files, 1e0 AS box_size, count(p.id) AS n, count(p.id) AS n_total
  FROM range((SELECT max(ptype) + 1 FROM particles_emb)) t LEFT JOIN particles_emb p ON p.ptype = t.range GROUP BY t.range"""


def _in_view(p: str, half: str) -> str:
    return f"abs(2 * ({_image_of(f'({p} - 5e-1)')}) / (2 * {half})) < 1"


def _unwrapped(p: str) -> str:
    return f"round(5e-1 + ({_image_of(f'({p} - 5e-1)')}), 6)"


def _render_steps() -> str:
    seen = " AND ".join(_in_view(a, "25e-2") for a in "xyz")
    return f"""WITH {EMB}, s AS (SELECT ptype, {', '.join(f'{_single(a)} AS {a}' for a in 'xyz')} FROM particles_emb WHERE ptype IN (0, 1, 4))
SELECT ptype, CAST(range AS INTEGER) AS frame, round(5e-1 * pow(5e-1, range), 6) AS lbox, {', '.join(f'{_unwrapped(a)} AS {a}' for a in 'xyz')} FROM s, range(3) WHERE {seen}"""


def _sequence() -> str:
    tables, parts = ("snap_p", "particles_emb", "snap_b", "snap_n"), []
    for i, (a, b) in enumerate(zip(tables, tables[1:], strict=False)):
        parts.append(f"SELECT {i} AS interval, a.id, a.x, a.y, a.z, b.x AS xb, b.y AS yb, b.z AS zb, b.id IS NOT NULL AS has_b FROM {a} a LEFT JOIN {b} b ON a.id = b.id")
    seen = " AND ".join(_in_view(a, "5e-1") for a in "xyz")
    return f"""WITH {EMB}, {SNAP_B}, {SNAP_P}, {SNAP_N}, m AS ({' UNION ALL '.join(parts)}),
f AS (SELECT m.*, CAST(2 * interval + range AS INTEGER) AS frame, range / 2e0 AS t FROM m, range(3) WHERE range < 2 OR interval = 2), s AS (SELECT *, {BASIS} FROM f), p AS ({_hermite('s', 'id, frame')})
SELECT id, frame, {', '.join(f'{_unwrapped(a)} AS {a}' for a in 'xyz')} FROM p WHERE {seen}"""


def _hot() -> str:
    rgb = ", ".join(f"coalesce({_byte(f'least(1e0, greatest(0e0, 3 * least(1e0, greatest(0e0, t)) - {k}))')}, 0) AS {c}" for k, c in enumerate("rgb"))
    return f"{_scaled(True)}, grid AS (SELECT CAST(a.range AS INTEGER) AS iy, CAST(b.range AS INTEGER) AS ix FROM range(64) a, range(64) b) SELECT grid.iy, grid.ix, {rgb} FROM grid LEFT JOIN sc USING (iy, ix)"


def _gray() -> str:
    shown = ", ".join(f"coalesce({_byte('rho / 5e5')}, 0) AS {c}" for c in "rgb")
    return f"{LI_MAP}, grid AS (SELECT CAST(a.range AS INTEGER) AS iy, CAST(b.range AS INTEGER) AS ix FROM range(64) a, range(64) b) SELECT 0 AS frame, grid.iy, grid.ix, {shown} FROM grid LEFT JOIN img USING (iy, ix)"


#: What each list of flags means, written out: only settings that differ from the defaults.
DEFAULT_SETTINGS = {
    "mask": "2", "colormap": "magma", "opacity_func": "flat", "opacity_gamma": "2.0", "auto_pct_lo": "0.1", "auto_pct_hi": "1.0", "log_scale": "True", "lock_levels": "False", "zoom_factor": "0.5", "lbox": "0.0", "xc": "0.5",
    "rot_axis": "(0.0, 0.0, 1.0)", "num_ngb": "32", "sph_eta": "1.2", "width": "768", "mode": "single",
}
CHANGED_SETTINGS = {
    "defaults": {},
    "types add up": {"mask": "35"},
    "a later flag replaces the default": {"mask": "1"},
    "preset": {"colormap": "inferno", "opacity_func": "power", "opacity_gamma": "3.0", "auto_pct_lo": "0.02", "log_scale": "False"},
    "names": {"colormap": "grayscale", "lock_levels": "True"},
    "box units": {"lbox": "12.5", "xc": "25.0", "rot_axis": "(0.0, 0.6, 0.8)"},
}


def _settings() -> str:
    rows = ", ".join(f"('{name}', '{key}', '{value}')" for name, changed in CHANGED_SETTINGS.items() for key, value in (DEFAULT_SETTINGS | changed).items())
    return f"SELECT * FROM (VALUES {rows}) s(name, key, value)"


def _palette_file() -> str:
    rgb = ", ".join(f"round(CASE WHEN t <= 25e-2 THEN {b} * t / 25e-2 ELSE {b} + (t - 25e-2) / 75e-2 * ({c} - {b}) END, 6) AS {n}" for n, b, c in (("r", "2e-1", "1e0"), ("g", "4e-1", "5e-1"), ("b", "8e-1", "0e0")))
    return f"SELECT i, {rgb} FROM (SELECT CAST(range AS INTEGER) AS i, range / 255e0 AS t FROM range(256))"


ORACLE_SQL = {
    "cic_density_map": f"{LI_MAP} {_shown('img')}",
    "type_mask_select": f"WITH {LI} SELECT ptype, count(*) AS n, round(sum(x), 4) AS sum_x FROM particles_li WHERE (82 & (1 << ptype)) <> 0 GROUP BY ptype",
    "view_cube_clustered": f"WITH {LI} SELECT ptype, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM particles_li WHERE ptype IN (1, 2, 3, 4, 6) AND abs(2 * ({_image_of('(x - 2e-2)')}) / 3e-1) < 1 AND abs(2 * ({_image_of('(y - 95e-2)')}) / 3e-1) < 1 AND abs(2 * ({_image_of('(z - 97e-2)')}) / 3e-1) < 1",
    "view_cube_select": f"WITH {EVT} SELECT id, ptype, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM particles_evt WHERE abs(2 * ({_image_of('(x - 1e-1)')}) / 4e-1) < 1 AND abs(2 * ({_image_of('(y - 5e-1)')}) / 4e-1) < 1 AND abs(2 * ({_image_of('(z - 5e-1)')}) / 4e-1) < 1",
    "type_counts_rollup": f"WITH {LI} SELECT part, ptype, count(*) AS n FROM (SELECT CAST(floor(y * 4) AS INTEGER) AS part, ptype FROM particles_li) GROUP BY ROLLUP (part, ptype)",
    "type_boundaries": f"WITH {LI}, c AS (SELECT ptype, count(*) AS n FROM particles_li GROUP BY ptype) SELECT ptype, n, CAST(sum(n) OVER (ORDER BY ptype) - n AS BIGINT) AS first_row, CAST(sum(n) OVER (ORDER BY ptype) AS BIGINT) AS end_row FROM c",
    "missing_types": f"WITH {EMB} SELECT CAST(range AS INTEGER) AS ptype FROM range(32) WHERE (423 & (1 << range)) <> 0 AND range NOT IN (SELECT ptype FROM particles_emb)",
    "bbox": f"WITH {EVT} SELECT count(*) AS n, {', '.join(f'round({f}({a}), 6) AS {f}_{a}' for a in 'xyz' for f in ('min', 'max'))} FROM particles_evt",
    "wrap_positions": f"WITH {EMB}, {SNAP_B} SELECT a.id, {', '.join(f'round({_wrap(f"(a.{c} + 7e-1)")}, 6) AS w{c}' for c in 'xyz')}, {', '.join(f'round({_image_of(f"(b.{c} - a.{c})")}, 6) AS d{c}' for c in 'xyz')} FROM particles_emb a JOIN snap_b b ON a.id = b.id",
    "velocity_extrapolate": f"WITH {EMB} SELECT id, ptype, {', '.join(f'round({a} + 5e-1 * v{a}, 6) AS {a}' for a in 'xyz')} FROM particles_emb",
    "id_match_left": f"WITH {EMB}, {SNAP_B}, m AS ({JOIN_B}) SELECT id, ptype, has_b, round(xb, 6) AS x_b, round(yb, 6) AS y_b, round(zb, 6) AS z_b FROM m",
    "id_match_count": f"WITH {SNAP_B} SELECT count(*) AS matched FROM embeddings WHERE vec_id IN (SELECT id FROM snap_b)",
    "hermite_two_snap": f"WITH {EMB}, {SNAP_B}, m AS ({JOIN_B}), s AS (SELECT *, {BASIS} FROM (SELECT *, 3e-1 AS t FROM m)), p AS ({_hermite('s', 'id, ptype')}) SELECT id, ptype, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM p",
    "hermite_frames": f"WITH {EMB}, {SNAP_B}, m AS ({JOIN_B}), s AS (SELECT *, {BASIS} FROM (SELECT m.*, CAST(range AS INTEGER) AS frame, range / 3e0 AS t FROM m, range(4))), p AS ({_hermite('s', 'frame')}), {_cic('img', 'p', 32, keys='frame')} {_shown('img', 'frame')}",
    "catmull_three_snap": _catmull(False),
    "catmull_four_snap": _catmull(True),
    "rotate_frames": f"WITH {_turned()}, {_cic('img', 'turned', 64, keys='frame')} {_shown('img', 'frame')}",
    "zoom_frames": f"WITH {LI}, z AS (SELECT CAST(range AS INTEGER) AS frame, pow(5e-1, range) AS lbox, x, y FROM particles_li, range(3)), {_cic('img', 'z', 32, 'lbox', 'frame')} {_shown('img', 'frame')}",
    "cic_map_compat": f"WITH {LI}, {_cic('img', 'particles_li', 64, '6e-1', compat=True)} {_shown('img')}",
    "cic_3d_grid": f"{UNIT_GRID} SELECT * FROM (SELECT iz, iy, ix, round(rho, 4) AS rho FROM grid) WHERE rho > 0",
    "grid_box_mean": f"{UNIT_GRID}, {_mean(16)} SELECT * FROM (SELECT iz, iy, ix, round(rho, 4) AS rho FROM mean_grid) WHERE rho > 0",
    "grid_smoothing_length": _grid_lengths(),
    "knn_smoothing_length": f"{_knn_li(32)} SELECT {PLACE}, round(max(least(12e-1 * sqrt(r2), 25e-1)), 6) AS h FROM kth JOIN li USING (id) GROUP BY x, y, z",
    "leaf_first_splits": _first_splits(),
    "radius_neighbours": f"WITH {EMB} SELECT * FROM (SELECT a.id, b.id AS other, {D2} AS r2 FROM particles_emb a, particles_emb b) WHERE r2 <= 1e-1 * 1e-1".replace("SELECT * FROM (SELECT a.id", "SELECT id, other, round(r2, 8) AS r2 FROM (SELECT a.id"),
    "kde_density": f"WITH {EMB}, p AS (SELECT a.id, sqrt({D2}) / 2e-1 AS u FROM particles_emb a, particles_emb b WHERE {D2} <= 2e-1 * 2e-1) SELECT id, round(sum({_spline('u')} / 8e-3), 4) AS density FROM p GROUP BY id",
    "nth_neighbour": f"{_knn_li(6)} SELECT {PLACE}, round(max(sqrt(r2)), 6) AS distance FROM kth JOIN li USING (id) GROUP BY x, y, z",
    "octant_counts": f"WITH {EVT} SELECT CAST((x > 5e-1)::INT + 2 * (y > 5e-1)::INT + 4 * (z > 5e-1)::INT AS INTEGER) AS octant, count(*) AS n, {', '.join(f'round(avg({a}), 6) AS mean_{a}' for a in 'xyz')} FROM particles_evt GROUP BY ALL",
    "opened_cells": _opened(),
    "octree_nodes": _tree_nodes(EMB, "particles_emb", "xyz", 8, 6),
    "binary_tree_nodes": _tree_nodes(EVT, "particles_evt", "x", 64, 8),
    "octree_walks": _tree_walks(),
    "kernel_table_3d": _table(1.0, _spline("u")),
    "kernel_table_proj": _table(2.0, _projected("(u*u)")),
    "kernel_cumulative": _table(2.0, f"(CASE WHEN u < 1 THEN u - 5e-1*u*u*u + 1875e-4*u*u*u*u WHEN u < 2 THEN 6875e-4 + 2*u - 15e-1*u*u + 5e-1*u*u*u - u*u*u*u/16 - 9375e-4 ELSE 75e-2 END) / {PI}"),
    "h_band_histogram": f"WITH {WITH_H}, b AS (SELECT h * 64 AS px FROM lengths) SELECT CASE WHEN px <= 0 THEN 'zero' WHEN px < 2 THEN 'below 2' WHEN px < 8 THEN '2 to 8' WHEN px <= 16 THEN '8 to 16' ELSE 'above 16' END AS band, count(*) AS n, CAST(sum(CASE WHEN px > 0 THEN pow(2 * ceil(2 * px) + 1, 2) ELSE 0 END) AS BIGINT) AS pixel_writes FROM b GROUP BY ALL",
    "deposit_counters": f"""WITH {LI}, p AS (SELECT (x - 5e-1) * 768 + 192 AS px, (y - 5e-1) * 768 + 192 AS py, CASE WHEN ptype = 0 THEN 0 ELSE ptype * 4e-3 * 768 END AS hp FROM particles_li),
q AS (SELECT *, greatest(-px, px - 384, -py, py - 384) < ceil(2 * least(hp, 8e0)) + 1 AS near FROM p)
SELECT count(*) AS n_particles, CAST(count_if(near AND hp > 0 AND hp <= 16) AS BIGINT) AS n_deposited, CAST(count_if(NOT near AND hp > 0 AND hp <= 16) AS BIGINT) AS n_outside, CAST(count_if(hp = 0) AS BIGINT) AS n_without,
CAST(count_if(hp > 16) AS BIGINT) AS n_skipped, CAST(count_if(near AND hp > 8 AND hp <= 16) AS BIGINT) AS n_capped FROM q""",
    "arrivals_locked_levels": f"WITH {LI}, s AS (SELECT * FROM particles_li WHERE ptype = 3), {_cic('img', 's', 64)}, f AS (SELECT 0 AS frame, rho FROM img), {_levels('f', 'frame')} SELECT ptype AS snapshot, 3 AS first, round(vmin, 6) AS vmin, round(vmax, 6) AS vmax FROM (SELECT DISTINCT ptype FROM particles_li), lv",
    "sph_line_item_frames": f"""WITH {LI}, z AS (SELECT CAST(f.range AS INTEGER) AS frame, pow(5e-1, f.range) AS lbox, x, y, (1 + ptype % 2) * 8e-4 AS h FROM particles_li, range(2) f),
p AS (SELECT frame, (x - 5e-1) * 768 / lbox + 384 AS px, (y - 5e-1) * 768 / lbox + 384 AS py, h * 768 / lbox AS hp FROM z),
q AS (SELECT frame, CAST(trunc(py) + b.range AS INTEGER) AS iy, CAST(trunc(px) + a.range AS INTEGER) AS ix, px, py, hp FROM p JOIN range(-6, 7) a ON abs(a.range) <= ceil(2 * hp) JOIN range(-6, 7) b ON abs(b.range) <= ceil(2 * hp)),
r AS (SELECT frame, iy, ix, hp, ((ix + 5e-1 - px)*(ix + 5e-1 - px) + (iy + 5e-1 - py)*(iy + 5e-1 - py)) / (hp*hp) AS q2 FROM q WHERE ix BETWEEN 0 AND 767 AND iy BETWEEN 0 AND 767)
SELECT * FROM (SELECT frame, iy // 8 AS iy, ix // 8 AS ix, round(sum(({_projected('q2')}) / (hp*hp)), 4) AS mass FROM r WHERE q2 < 4 GROUP BY ALL) WHERE mass > 0""",
    "sph_density_map": f"WITH {WITH_H}, p AS (SELECT x * 64 AS px, y * 64 AS py, least(h * 64, 8e0) AS hp FROM lengths WHERE h > 0 AND h * 64 <= 16), g AS (SELECT CAST(a.range AS INTEGER) AS iy, CAST(b.range AS INTEGER) AS ix FROM range(64) a, range(64) b), q AS (SELECT iy, ix, hp, ((ix + 5e-1 - px)*(ix + 5e-1 - px) + (iy + 5e-1 - py)*(iy + 5e-1 - py)) / (hp*hp) AS q2 FROM p JOIN g ON abs(ix - trunc(px)) <= ceil(2*hp) AND abs(iy - trunc(py)) <= ceil(2*hp)) SELECT * FROM (SELECT iy, ix, round(sum(({_projected('q2')}) / (hp*hp) * 4096), 4) AS rho FROM q WHERE q2 < 4 GROUP BY ALL) WHERE rho > 0",
    "sph_3d_map": f"WITH {WITH_H}, p AS (SELECT x * 24 AS px, y * 24 AS py, z * 24 AS pz, least(h * 24, 8e0) AS hp FROM lengths WHERE h > 0 AND h * 24 <= 16), g AS (SELECT CAST(a.range AS INTEGER) AS iz, CAST(b.range AS INTEGER) AS iy, CAST(c.range AS INTEGER) AS ix FROM range(24) a, range(24) b, range(24) c), q AS (SELECT iz, iy, ix, hp, sqrt((ix + 5e-1 - px)*(ix + 5e-1 - px) + (iy + 5e-1 - py)*(iy + 5e-1 - py) + (iz + 5e-1 - pz)*(iz + 5e-1 - pz)) / hp AS u FROM p JOIN g ON abs(ix + 5e-1 - px) <= hp AND abs(iy + 5e-1 - py) <= hp AND abs(iz + 5e-1 - pz) <= hp) SELECT * FROM (SELECT iz, iy, ix, round(sum({_spline('u')} / (hp*hp*hp)), 4) AS rho FROM q WHERE u < 1 GROUP BY ALL) WHERE rho > 0",
    "image_range_report": f"{LI_MAP}, m AS (SELECT count_if(rho > 0) AS n_positive, max(rho) AS mx, min(CASE WHEN rho > 0 THEN rho END) AS mn, sum(rho) / 4096 AS mean FROM img) SELECT CAST(n_positive AS BIGINT) AS n_positive, round(mx, 4) AS max_rho, round(mn, 4) AS min_positive, round(mean, 4) AS mean_rho, (SELECT CAST(count_if(rho > 1e-6 * mx) AS BIGINT) FROM img) AS n_above_floor FROM m",
    "auto_levels": f"{LI_MAP}, f AS (SELECT 0 AS frame, rho FROM img), {_levels('f', 'frame')} SELECT frame, n, round(vmin, 6) AS vmin, round(vmax, 6) AS vmax FROM lv",
    "locked_levels_frames": f"WITH {_turned()}, {_cic('img', 'turned', 32, keys='frame')}, sh AS ({_shown('img', 'frame')}), f0 AS (SELECT * FROM sh WHERE frame = 0), {_levels('f0', 'frame')} SELECT s.frame, round(vmin, 6) AS vmin, round(vmax, 6) AS vmax FROM (SELECT DISTINCT frame FROM sh) s, lv",
    "noise_floor": f"{LI_MAP}, f AS (SELECT * FROM img WHERE rho >= pow(1e1, 72e-1) * 1e-4) {_shown('f')}",
    "inpaint_one_pass": _inpaint(),
    "inpaint_full": _inpaint_full(),
    "leaf_smoothing_length": _leaf_lengths(),
    "render_png": _png(),
    "full_render": _full_render(),
    "normalise_log": f"{_scaled(True)} SELECT iy, ix, round(t, 6) AS t FROM sc",
    "normalise_linear": f"{_scaled(False)} SELECT iy, ix, round(t, 6) AS t FROM sc",
    "opacity_transfer": "SELECT i, round(8e-1, 8) AS o_flat, round(t * 8e-1, 8) AS o_linear, round(sqrt(t) * 8e-1, 8) AS o_sqrt, round(pow(t, 2) * 8e-1, 8) AS o_power, round(ln(1 + 9 * t) / ln(1e1) * 8e-1, 8) AS o_log, round((CASE WHEN t >= 1e-1 THEN 1e0 ELSE 0e0 END) * 8e-1, 8) AS o_threshold FROM (SELECT CAST(range AS INTEGER) AS i, range / 1e2 AS t FROM range(101))",
    "palette_generated": _palettes(),
    "palette_lookup_magma": _magma(),
    "custom_palette": _custom(),
    "composite_rgba": _composite(),
    "slab_histogram": f"{HIST} SELECT bin, n FROM hist",
    "slab_splits": f"{SPLITS} SELECT slab, round(first_bin / 256e0, 6) AS lo, round(end_bin / 256e0, 6) AS hi, first_bin, end_bin FROM splits",
    "slab_assign": f"{SPLITS}, a AS (SELECT x, coalesce((SELECT min(slab) FROM splits WHERE p.x < end_bin / 256e0), 4) AS slab FROM particles_li p) SELECT slab, count(*) AS n, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x FROM a GROUP BY slab",
    "snapshot_roles": "SELECT * FROM (SELECT seq, root AS prev, lead(root, 1) OVER (ORDER BY seq) AS a, lead(root, 2) OVER (ORDER BY seq) AS b, lead(root, 3) OVER (ORDER BY seq) AS next FROM (SELECT CAST(range AS INTEGER) AS seq, printf('snap_%03d', range) AS root FROM range(10))) WHERE next IS NOT NULL",
    "global_frame_numbers": "SELECT CAST(s.range AS INTEGER) AS seq, CAST(l.range AS INTEGER) AS local, CAST(24 * s.range + l.range AS INTEGER) AS global_frame, printf('frame.%04d.png', 24 * s.range + l.range) AS file FROM range(9) s, range(25) l WHERE l.range < 24 OR s.range = 8",
    "global_levels": f"WITH {LI}, {_cic('img', 'particles_li', 32, keys='ptype')}, sh AS ({_shown('img', 'ptype')}), {_levels('sh', 'ptype')}, r AS (SELECT vmin, vmax, row_number() OVER (ORDER BY vmin) - 1 AS i0, row_number() OVER (ORDER BY vmax) - 1 AS i1, count(*) OVER () AS k FROM lv) SELECT round(max(CASE WHEN i0 = floor(5e-2 * (k - 1)) THEN vmin END), 6) AS vmin, round(max(CASE WHEN i1 = floor(95e-2 * (k - 1)) THEN vmax END), 6) AS vmax FROM r",
    "gadget_particles": f"WITH {EMB} SELECT id, ptype, {MOVING} FROM particles_emb",
    "hdf5_particles": f"WITH {EMB} SELECT id, ptype, {MOVING} FROM particles_emb",
    "hdf5_types_and_columns": f"WITH {EMB} SELECT ptype, {', '.join(f'round({_single(a)}, 6) AS {a}' for a in 'xyz')} FROM particles_emb WHERE ptype IN (1, 4)",
    "gadget_headers": HEADERS,
    "hdf5_headers": HEADERS,
    "cosmology_header": "SELECT 8e-1 AS a, 68e0 AS h0, 31e-2 AS omega_m, 69e-2 AS omega_lambda, 68e-2 AS h",
    "snapshot_render_steps": _render_steps(),
    "sequence_probe_levels": f"""WITH {EMB}, {SNAP_B}, {SNAP_P}, s AS (SELECT 0 AS frame, x, y, z FROM snap_p UNION ALL SELECT 2, x, y, z FROM particles_emb UNION ALL SELECT 4, x, y, z FROM snap_b),
u AS (SELECT frame, {', '.join(f"5e-1 + {_image_of(f'({a} - 5e-1)')} AS {a}" for a in 'xyz')} FROM s WHERE {' AND '.join(f"abs(2 * ({_image_of(f'({a} - 5e-1)')})) < 1" for a in 'xyz')}),
{_cic('img', 'u', 32, keys='frame')}, {_levels('img', 'frame')}, r AS (SELECT *, row_number() OVER (ORDER BY vmin) - 1 AS i, row_number() OVER (ORDER BY vmax) - 1 AS j, count(*) OVER () AS k FROM lv)
SELECT round(max(CASE WHEN i = floor(5e-2 * (k - 1)) THEN vmin END), 6) AS vmin, round(max(CASE WHEN j = floor(95e-2 * (k - 1)) THEN vmax END), 6) AS vmax FROM r""",
    "sequence_hermite": _sequence(),
    "sequence_bucketed": _sequence(),
    "length_file": "SELECT CAST(range AS INTEGER) AS i, round(CAST(CAST(5e-1 / (range + 3) AS FLOAT) AS DOUBLE), 6) AS h FROM range(101)",
    "snapshot_list_file": "SELECT * FROM (VALUES (0, 'run/snap_000'), (1, 'run/snap_001'), (2, 'run/snap_002')) s(seq, root)",
    "palette_file": _palette_file(),
    "pnm_pixels": _hot(),
    "gray_picture": _gray(),
    "pixel_lengths": f"WITH {WITH_H} SELECT id, round(least(h * 64, 4e0), 6) AS h_px FROM lengths WHERE h > 0 AND h * 64 <= 75e-1",
    "kernel_lookup": "WITH v AS (SELECT [1e0, 5e-1, 25e-2, 125e-3, 0e0] AS v), p AS (SELECT CAST(range AS INTEGER) AS i, range / 5e1 AS u FROM range(121)), q AS (SELECT i, u, 2 * u AS f, CAST(floor(2 * u) AS INTEGER) AS k FROM p) SELECT i, round(CASE WHEN u < 2 THEN v[k + 1] + (f - k) * (v[k + 2] - v[k + 1]) ELSE 0e0 END, 8) AS value FROM q, v",
    "box_distances": f"WITH {EMB} SELECT id, round(pow(greatest(4e-1 - x, 0e0, x - 6e-1), 2) + pow(greatest(45e-2 - y, 0e0, y - 55e-2), 2) + pow(greatest(5e-1 - z, 0e0, z - 5e-1), 2), 8) AS d2 FROM particles_emb",
    "sorted_ids": "SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings",
    "settings": _settings(),
    "snap_dt": "WITH s AS (SELECT 5e-1 + (range + 5e-1) * 2e-6 AS a FROM range(10000)), d AS (SELECT sum(2e-6 / (a * sqrt(309e-3 / (a*a*a) + 691e-3) * (6774e-2 / 3085677581e10))) AS dt FROM s) SELECT round(dt * 6774e-4 / 3085677581e10, 9) AS snap_dt, round(dt / 315576e11, 6) AS dt_gyr FROM d",
}

# The same results, by table functions.
ORACLE_SQL["sql_kernel_footprints"] = ORACLE_SQL["sph_line_item_frames"]
ORACLE_SQL["sql_cell_stencils"] = ORACLE_SQL["cic_density_map"]

#: SQL of queries that read no given table; tests use it, the entry does not.
FIXED_SQL = {name: ORACLE_SQL.pop(name) for name in (
    "kernel_table_3d", "kernel_table_proj", "kernel_cumulative", "kernel_lookup", "opacity_transfer", "palette_generated", "custom_palette", "palette_file", "snapshot_roles", "global_frame_numbers", "snap_dt", "length_file", "snapshot_list_file", "settings", "cosmology_header",
)}
