"""SQL fragments shared by the checks; each is written from the definition, not from the Spark code."""

from __future__ import annotations


def hav(a, b, c, d, r=6371000.0):
    return (f"({2 * r}::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a}))"
            f" * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))))")


def flat(a, b, c, d):
    return (f"sqrt(pow((({c}) - ({a})) * 111320.0::DOUBLE, 2)"
            f" + pow((({d}) - ({b})) * 111320.0::DOUBLE * cos(radians((({a}) + ({c})) / 2)), 2))")


def bearing(a, b, c, d):
    """Signed initial bearing."""
    return (f"degrees(atan2(sin(radians(({d}) - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c}))"
            f" - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b})))))")


def seg_dist_m(lat, lng, ay, ax, by, bx):
    """Distance in metres of a point to a segment, flat about the point."""
    k = f"(111320.0::DOUBLE * cos(radians({lat})))"
    px, py = f"((({ax}) - ({lng})) * {k})", f"((({ay}) - ({lat})) * 111320.0::DOUBLE)"
    qx, qy = f"((({bx}) - ({lng})) * {k})", f"((({by}) - ({lat})) * 111320.0::DOUBLE)"
    t = (f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(-({px} * ({qx} - {px}) + {py} * ({qy} - {py}))"
         f" / nullif(pow({qx} - {px}, 2) + pow({qy} - {py}, 2), 0), 0)))")
    return f"sqrt(pow({px} + {t} * ({qx} - {px}), 2) + pow({py} + {t} * ({qy} - {py}), 2))"


def edges(points: str, key: str) -> str:
    """Ring edges (y1, x1) -> (y2, x2) with the closing edge, from ordered vertex rows."""
    w = f"PARTITION BY {key} ORDER BY i"
    return (f"SELECT {key}, i, lat AS yi, lng AS xi,"
            f" coalesce(lag(lat) OVER ({w}), last_value(lat) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS yj,"
            f" coalesce(lag(lng) OVER ({w}), last_value(lng) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS xj"
            f" FROM {points}")


def crosses(lat: str, lng: str, e: str = "e") -> str:
    return (f"(({e}.yi > {lat}) <> ({e}.yj > {lat}) AND {lng} < ({e}.xj - {e}.xi) * ({lat} - {e}.yi)"
            f" / ({e}.yj - {e}.yi) + {e}.xi)")


def seg_cross(ay, ax, by, bx, cy, cx, dy, dx):
    det = f"((({bx}) - ({ax})) * (({dy}) - ({cy})) - (({by}) - ({ay})) * (({dx}) - ({cx})))"
    t = f"((({cx}) - ({ax})) * (({dy}) - ({cy})) - (({cy}) - ({ay})) * (({dx}) - ({cx}))) / {det}"
    u = f"-((({bx}) - ({ax})) * (({cy}) - ({ay})) - (({by}) - ({ay})) * (({cx}) - ({ax}))) / {det}"
    return f"(abs({det}) >= 1e-12 AND {t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1)"
