"""Pieces of DuckDB SQL text for the oracle queries."""

R = "6371008.8e0"


def hav_m(x1, y1, x2, y2):
    a = (f"(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) "
         f"* pow(sin(radians({x2} - {x1}) / 2), 2))")
    return f"(2e0 * atan2(sqrt({a}), sqrt(greatest(0e0, 1 - {a}))) * {R})"


def hav_km(x1, y1, x2, y2):
    return f"({hav_m(x1, y1, x2, y2)} / 1000e0)"


def bearing(x1, y1, x2, y2):
    return (f"fmod(degrees(atan2(sin(radians({x2} - {x1})) * cos(radians({y2})), cos(radians({y1})) * sin(radians({y2})) "
            f"- sin(radians({y1})) * cos(radians({y2})) * cos(radians({x2} - {x1})))) + 360e0, 360e0)")


def fold(x):
    return f"(CASE WHEN {x} > 180 THEN 360e0 - {x} ELSE {x} END)"


def turn(b1, b2):
    return fold(f"abs({b2} - {b1})")


def js_round(x, d=0):
    return f"(floor({x} * 1e{d} + 0.5e0) / 1e{d})"


def unit(x, y, name):
    """Three columns name_x, name_y, name_z."""
    return (f"cos(radians({y})) * cos(radians({x})) AS {name}_x, cos(radians({y})) * sin(radians({x})) AS {name}_y, "
            f"sin(radians({y})) AS {name}_z")


def dot(a, b):
    return f"({a}_x * {b}_x + {a}_y * {b}_y + {a}_z * {b}_z)"


def cross(a, b, name):
    return (f"({a}_y * {b}_z - {a}_z * {b}_y) AS {name}_x, ({a}_z * {b}_x - {a}_x * {b}_z) AS {name}_y, "
            f"({a}_x * {b}_y - {a}_y * {b}_x) AS {name}_z")


def point_segment(rel, p, a, b, out, keep="*"):
    """Subquery over ``rel`` with the point-segment distance in metres as ``out``."""
    return f"""(SELECT {keep}, CASE WHEN ps_ab < 1e-3 THEN ps_pa WHEN ps_len < 1e-12 THEN least(ps_pa, ps_pb)
   WHEN ps_x * (ps_ay * ps_nz - ps_az * ps_ny) * -1 + ps_y * (ps_ax * ps_nz - ps_az * ps_nx) - ps_z * (ps_ax * ps_ny - ps_ay * ps_nx) >= -1e-9 * ps_pl
    AND ps_x * (ps_by * ps_nz - ps_bz * ps_ny) - ps_y * (ps_bx * ps_nz - ps_bz * ps_nx) + ps_z * (ps_bx * ps_ny - ps_by * ps_nx) >= -1e-9 * ps_pl
   THEN asin(least(1e0, abs(ps_off))) * {R} ELSE least(ps_pa, ps_pb) END AS {out}
 FROM (SELECT *, sqrt(pow(ps_vx - ps_off * ps_nx, 2) + pow(ps_vy - ps_off * ps_ny, 2) + pow(ps_vz - ps_off * ps_nz, 2)) AS ps_pl,
   ps_vx - ps_off * ps_nx AS ps_x, ps_vy - ps_off * ps_ny AS ps_y, ps_vz - ps_off * ps_nz AS ps_z
  FROM (SELECT *, ps_vx * ps_nx + ps_vy * ps_ny + ps_vz * ps_nz AS ps_off
   FROM (SELECT *, ps_cx / nullif(ps_len, 0) AS ps_nx, ps_cy / nullif(ps_len, 0) AS ps_ny, ps_cz / nullif(ps_len, 0) AS ps_nz
    FROM (SELECT *, sqrt(ps_cx * ps_cx + ps_cy * ps_cy + ps_cz * ps_cz) AS ps_len
     FROM (SELECT *, ps_ay * ps_bz - ps_az * ps_by AS ps_cx, ps_az * ps_bx - ps_ax * ps_bz AS ps_cy, ps_ax * ps_by - ps_ay * ps_bx AS ps_cz
      FROM (SELECT *, {hav_m(*p, *a)} AS ps_pa, {hav_m(*p, *b)} AS ps_pb, {hav_m(*a, *b)} AS ps_ab,
        cos(radians({p[1]})) * cos(radians({p[0]})) AS ps_vx, cos(radians({p[1]})) * sin(radians({p[0]})) AS ps_vy, sin(radians({p[1]})) AS ps_vz,
        cos(radians({a[1]})) * cos(radians({a[0]})) AS ps_ax, cos(radians({a[1]})) * sin(radians({a[0]})) AS ps_ay, sin(radians({a[1]})) AS ps_az,
        cos(radians({b[1]})) * cos(radians({b[0]})) AS ps_bx, cos(radians({b[1]})) * sin(radians({b[0]})) AS ps_by, sin(radians({b[1]})) AS ps_bz
       FROM {rel}))))))) ps"""


def slerp(x1, y1, x2, y2, t):
    """Two SQL expressions lon, lat."""
    w = (f"acos(greatest(-1e0, least(1e0, cos(radians({y1})) * cos(radians({x1})) * cos(radians({y2})) * cos(radians({x2})) + "
         f"cos(radians({y1})) * sin(radians({x1})) * cos(radians({y2})) * sin(radians({x2})) + sin(radians({y1})) * sin(radians({y2})))))")
    k1, k2 = f"(sin((1 - {t}) * {w}) / sin({w}))", f"(sin({t} * {w}) / sin({w}))"
    vx = f"({k1} * cos(radians({y1})) * cos(radians({x1})) + {k2} * cos(radians({y2})) * cos(radians({x2})))"
    vy = f"({k1} * cos(radians({y1})) * sin(radians({x1})) + {k2} * cos(radians({y2})) * sin(radians({x2})))"
    vz = f"({k1} * sin(radians({y1})) + {k2} * sin(radians({y2})))"
    lon = f"(CASE WHEN {t} <= 0 OR {w} < 1e-6 THEN {x1} WHEN {t} >= 1 THEN {x2} ELSE degrees(atan2({vy}, {vx})) END)"
    lat = f"(CASE WHEN {t} <= 0 OR {w} < 1e-6 THEN {y1} WHEN {t} >= 1 THEN {y2} ELSE degrees(asin(greatest(-1e0, least(1e0, {vz})))) END)"
    return lon, lat


def destination(x, y, km, b):
    d = f"({km} * 1000e0 / {R})"
    lat = f"asin(sin(radians({y})) * cos({d}) + cos(radians({y})) * sin({d}) * cos(radians({b})))"
    lon = (f"degrees(radians({x}) + atan2(sin(radians({b})) * sin({d}) * cos(radians({y})), "
           f"cos({d}) - sin(radians({y})) * sin({lat})))")
    return lon, f"degrees({lat})"


def arc_tests(rel, p1, p2, p3, p4):
    """Subquery over ``rel`` adding ``arc_sign`` (1, -1 or 0) and ``arc_t`` (fraction along p1-p2)."""
    def on(sign):
        return " AND ".join(
            f"{sign} * ({dot('ac_q', 'ac_m' + k)}) > 0 AND {sign} * {dot('ac_q', 'ac_s' + k)} / ac_ql >= -1e-9 "
            f"AND {sign} * {dot('ac_q', 'ac_r' + k)} / ac_ql >= -1e-9" for k in ("1", "2"))
    def add(a, b, name):
        return ", ".join(f"{a}_{i} + {b}_{i} AS {name}_{i}" for i in "xyz")
    sq = "sqrt({0}_x * {0}_x + {0}_y * {0}_y + {0}_z * {0}_z)".format
    return f"""(SELECT *, CASE WHEN arc_sign = 0 THEN NULL WHEN ac_tot < 1e-9 THEN 0e0 ELSE greatest(0e0, least(1e0,
    acos(greatest(-1e0, least(1e0, arc_sign * {dot('ac_a', 'ac_q')} / ac_ql))) / ac_tot)) END AS arc_t
 FROM (SELECT *, CASE WHEN ac_l1 < 1e-12 OR ac_l2 < 1e-12 OR ac_ql < 1e-12 THEN 0 WHEN {on('1')} THEN 1 WHEN {on('-1')} THEN -1 ELSE 0 END AS arc_sign
  FROM (SELECT *, {sq('ac_q')} AS ac_ql, {sq('ac_n1')} AS ac_l1, {sq('ac_n2')} AS ac_l2, acos(greatest(-1e0, least(1e0, {dot('ac_a', 'ac_b')}))) AS ac_tot
   FROM (SELECT *, {cross('ac_n1', 'ac_n2', 'ac_q')}, {add('ac_a', 'ac_b', 'ac_m1')}, {add('ac_c', 'ac_d', 'ac_m2')},
     {cross('ac_n1', 'ac_a', 'ac_s1')}, {cross('ac_b', 'ac_n1', 'ac_r1')}, {cross('ac_n2', 'ac_c', 'ac_s2')}, {cross('ac_d', 'ac_n2', 'ac_r2')}
    FROM (SELECT *, {cross('ac_a', 'ac_b', 'ac_n1')}, {cross('ac_c', 'ac_d', 'ac_n2')}
     FROM (SELECT *, {unit(*p1, 'ac_a')}, {unit(*p2, 'ac_b')}, {unit(*p3, 'ac_c')}, {unit(*p4, 'ac_d')} FROM {rel}))))))"""


def toggles(x, y, x1, y1, x2, y2, rule="closed_right"):
    xi = f"(({y} - {y1}) * ({x2} - {x1}) / nullif({y2} - {y1}, 0) + {x1})"
    if rule == "half_open":
        return f"((({y1} > {y}) <> ({y2} > {y})) AND {x} < {xi})"
    return (f"({y} > least({y1}, {y2}) AND {y} <= greatest({y1}, {y2}) AND {x} <= greatest({x1}, {x2}) AND {y1} <> {y2} "
            f"AND ({x1} = {x2} OR {x} <= {xi}))")


def planar_cross(p1, p2, p3, p4):
    def ccw(a, b, d):
        return f"(({d[1]} - {a[1]}) * ({b[0]} - {a[0]}) > ({b[1]} - {a[1]}) * ({d[0]} - {a[0]}))"
    return f"(({ccw(p1, p3, p4)} <> {ccw(p2, p3, p4)}) AND ({ccw(p1, p2, p3)} <> {ccw(p1, p2, p4)}))"
