"""Pinhole camera geometry as Column expressions.

Camera axes: x right, y down, z along the optical axis. Pitch 0 looks at the horizon, -90 straight
down; roll is positive with the right side down; the world is east, north, up in metres.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[Column]]


def focal_px(focal_35mm: Column, width: Column) -> Column:
    """Focal length in pixels of a 35 mm equivalent one."""
    return focal_35mm * width / 36.0


def rotation_world_to_camera(yaw: Column, pitch: Column, roll: Column) -> Matrix:
    """Rows are the camera's axes in the world."""
    p, r, a = F.radians(pitch), F.radians(roll), F.radians(yaw)
    sp, cp, sr, cr, sa, ca = F.sin(p), F.cos(p), F.sin(r), F.cos(r), F.sin(a), F.cos(a)
    # level axes towards north: right (1, 0, 0), down (0, sp, -cp), forward (0, cp, sp)
    right = [cr, sr * sp, -sr * cp]
    down = [-sr, cr * sp, -cr * cp]
    ahead = [F.lit(0.0), cp, sp]
    return [[v[0] * ca + v[1] * sa, v[1] * ca - v[0] * sa, v[2]] for v in (right, down, ahead)]


def image_from_ground(focal: Column, width: Column, height: Column, rotation: Matrix, agl: Column) -> Matrix:
    """Homography from (east, north) offsets on the ground to pixels; nulls for a camera that is not above the ground (a
    height of 1e-6 or less)."""
    agl = F.when(agl > 1e-6, agl)
    cols = [[rotation[r][c] for r in range(3)] for c in range(2)] + [[-agl * rotation[r][2] for r in range(3)]]
    return [
        [focal * v[0] + width / 2 * v[2] for v in cols],
        [focal * v[1] + height / 2 * v[2] for v in cols],
        [v[2] for v in cols],
    ]


def determinant(m: Matrix) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def inverse(m: Matrix) -> Matrix:
    """By cofactors; null where the determinant is below 1e-12."""
    det = determinant(m)
    det = F.when(F.abs(det) >= 1e-12, det)
    minor = lambda r, c: m[(r + 1) % 3][(c + 1) % 3] * m[(r + 2) % 3][(c + 2) % 3] - m[(r + 1) % 3][(c + 2) % 3] * m[(r + 2) % 3][(c + 1) % 3]
    return [[minor(c, r) / det for c in range(3)] for r in range(3)]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return [[sum((a[r][k] * b[k][c] for k in range(1, 3)), a[r][0] * b[0][c]) for c in range(3)] for r in range(3)]


def canvas_from_ground(east: Column, north: Column, min_x: Column, max_y: Column, gsd: Column) -> Matrix:
    """Ground offsets of a camera to canvas pixels; rows of the canvas run from north to south."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return [[1 / gsd, zero, (east - min_x) / gsd], [zero, -1 / gsd, (max_y - north) / gsd], [zero, zero, one]]


def project(m: Matrix, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Image of a point under a homography, and its scale w."""
    w = m[2][0] * x + m[2][1] * y + m[2][2]
    return (m[0][0] * x + m[0][1] * y + m[0][2]) / w, (m[1][0] * x + m[1][1] * y + m[1][2]) / w, w


def ground_corners(ground_from_image: Column, width: Column, height: Column, max_range: Column) -> Column:
    """The four image corners on the ground, as an array of (east, north); corners beyond max_range or
    above the horizon are pulled back to it along their azimuth. Null with fewer than three.

    The homography is an array of nine, row by row. Each step maps the array of corners once, so that
    no expression is repeated in the plan.
    """
    m, zero = ground_from_image, F.lit(0.0)
    row = lambda k, c: m[3 * k] * c["x"] + m[3 * k + 1] * c["y"] + m[3 * k + 2]
    xy = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (width, zero), (width, height), (zero, height))))
    g = F.transform(xy, lambda c: F.struct(row(0, c).alias("e"), row(1, c).alias("n"), row(2, c).alias("w")))
    g = F.transform(F.filter(g, lambda c: F.abs(c["w"]) >= 1e-9), lambda c: F.struct((c["e"] / c["w"]).alias("e"), (c["n"] / c["w"]).alias("n"), (c["w"] > 0).alias("ahead")))
    g = F.transform(g, lambda c: F.struct(c["e"].alias("e"), c["n"].alias("n"), c["ahead"].alias("ahead"), F.sqrt(c["e"] * c["e"] + c["n"] * c["n"]).alias("r")))
    g = F.filter(g, lambda c: c["ahead"] | (c["r"] > 1e-9))
    scale = lambda c: F.when(~c["ahead"], -max_range / c["r"]).when(c["r"] > max_range, max_range / c["r"]).otherwise(1.0)
    g = F.transform(g, lambda c: F.struct(c["e"].alias("e"), c["n"].alias("n"), scale(c).alias("k")))
    g = F.transform(g, lambda c: F.struct((c["e"] * c["k"]).alias("east"), (c["n"] * c["k"]).alias("north")))
    return F.when(F.size(g) >= 3, g)


def local_scale(m: Matrix, x: Column, y: Column) -> Column:
    """Target pixels for each source pixel at a point: root of the Jacobian's determinant."""
    u, v, w = project(m, x, y)
    det = (m[0][0] - u * m[2][0]) * (m[1][1] - v * m[2][1]) - (m[0][1] - u * m[2][1]) * (m[1][0] - v * m[2][0])
    return F.when(F.abs(w) < 1e-12, 0.0).otherwise(F.sqrt(F.abs(det)) / F.abs(w))


def usable_range_factor(nadir_gsd: Column, target_gsd: Column, lo: float = 0.4, hi: float = 4.0) -> Column:
    """Range, in flying heights, up to which a frame resolves the target: tan t with sin t / cos^2 t = k, solved."""
    k = target_gsd / nadir_gsd
    s = (F.sqrt(1 + 4 * k * k) - 1) / (2 * k)
    tan = F.least(F.lit(hi), F.greatest(F.lit(lo), s / F.sqrt(1 - s * s)))
    return F.when((nadir_gsd <= 0) | (target_gsd <= 0), hi).when(k <= 1.0, lo).otherwise(tan)


def nadir_weight(d_east: Column, d_north: Column, agl: Column, max_range: Column) -> Column:
    """Cube of the cosine of the angle from nadir; 0 beyond max_range."""
    r2 = d_east * d_east + d_north * d_north
    return F.when(r2 > max_range * max_range, 0.0).otherwise(F.pow(agl / F.sqrt(r2 + agl * agl), 3))


def pitch_roll_from_down(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pitch and roll of a camera that sees world-down along (x, y, z)."""
    norm = F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(1e-12))
    pitch = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / norm)))) - 90.0
    return pitch, F.degrees(F.atan2(x / norm, y / norm))


def yaw_from_motion(down: list[Column], motion: list[Column], track: Column) -> Column:
    """Azimuth of the optical axis of a camera that sees down and its own motion, the track of which is
    known; null where the two are parallel.

    Of the optical axis z, what is along the motion and what is across it (across = down x motion)
    are its horizontal parts; across points to the left of the track.
    """
    unit = lambda v: [c / F.greatest(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]), F.lit(1e-12)) for c in v]
    d, t = unit(down), unit(motion)
    along = t[0] * d[0] + t[1] * d[1] + t[2] * d[2]
    level = [t[k] - along * d[k] for k in range(3)]
    size = F.sqrt(level[0] * level[0] + level[1] * level[1] + level[2] * level[2])
    h = [c / F.when(size >= 1e-6, size) for c in level]
    across_z = d[0] * h[1] - d[1] * h[0]
    a = F.radians(track)
    # world: down x (sin a, cos a, 0) = (cos a, -sin a, 0)
    east, north = h[2] * F.sin(a) + across_z * F.cos(a), h[2] * F.cos(a) - across_z * F.sin(a)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def nadir_affine(ground_w: Column, width: Column, height: Column, yaw: Column, east: Column, north: Column, min_x: Column, max_y: Column, gsd: Column) -> Column:
    """The 2 x 3 matrix, row by row, that takes the pixels of a nadir photograph to a canvas: scaled by what a pixel
    covers, turned by the yaw, centre on centre."""
    scale = ground_w / width / gsd
    a, b = scale * F.cos(F.radians(yaw)), scale * F.sin(F.radians(yaw))
    x, y = width / 2.0, height / 2.0
    return F.array(a, -b, (east - min_x) / gsd - (a * x - b * y), b, a, (max_y - north) / gsd - (b * x + a * y))


def best_attitude(candidates: Column, most_roll: float = 35.0) -> Column:
    """Of an array of (pitch, roll, ...) structs the one with the smallest absolute roll, the first on a tie; null if
    all roll more than allowed."""
    ok = F.filter(candidates, lambda c: F.abs(c["roll"]) <= most_roll)
    keyed = F.transform(ok, lambda c, i: F.struct(F.abs(c["roll"]).alias("r"), i.alias("i")))
    return F.get(ok, F.array_min(keyed)["i"])
