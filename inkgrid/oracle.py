"""DuckDB SQL for the registered queries, built from named steps and formulated on its own."""

from __future__ import annotations

from inkgrid.functions.scalar import cubic_weights, ellipse_half_widths, gaussian_weights, trig_table


class Steps:
    """A chain of common table expressions."""

    def __init__(self) -> None:
        self.parts: dict[str, str] = {}
        #: Long chains compute each step once; short ones are left to the optimiser.
        self.once = False

    def add(self, name: str, sql: str) -> str:
        self.parts.setdefault(name, sql)
        return name

    def select(self, sql: str) -> str:
        return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' * self.once}({s})" for n, s in self.parts.items()) + "\n" + sql


def _values(rows: list[tuple[int, ...]]) -> str:
    return ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


def _reflect(i: str, n: str) -> str:
    m = f"greatest(2 * ({n} - 1), 1)"
    k = f"((({i}) % {m} + {m}) % {m})"
    return f"(CASE WHEN {n} = 1 THEN 0 WHEN {k} < {n} THEN {k} ELSE 2 * ({n} - 1) - {k} END)"


# Rasters.


def glyph(q: Steps) -> str:
    q.add("glyph_text", "SELECT doc_id AS image_id, list_filter(string_split(text, ''), lambda c: c <> '') AS ch FROM documents WHERE text IS NOT NULL AND length(text) > 0")
    q.add("glyph_at", "SELECT image_id, ch, unnest(range(0, 32 * ((len(ch) + 31) // 32))) AS i FROM glyph_text")
    q.add("glyph_cp", "SELECT image_id, (i // 32)::INTEGER AS y, (i % 32)::INTEGER AS x, coalesce(unicode(ch[i + 1]), 0) AS cp FROM glyph_at")
    return q.add("glyph", "SELECT image_id, y, x, CASE WHEN image_id % 3 = 0 THEN 126 + cp % 4 ELSE cp % 256 END AS v FROM glyph_cp")


def glyph_bgr(q: Steps) -> str:
    glyph(q)
    return q.add("glyph_bgr", "SELECT image_id, y, x, cp * 5 % 256 AS b, (cp * 7 + x) % 256 AS g, (cp * 11 + y) % 256 AS r FROM glyph_cp")


def card_bgr(q: Steps, source: str = "part") -> str:
    key, size = {"part": ("p_partkey", "p_size"), "supplier": ("s_suppkey", "s_nationkey")}[source]
    q.add(f"{source}_px", f"SELECT {key}::BIGINT AS k, {size}::INTEGER AS s, yy.i::INTEGER AS y, xx.i::INTEGER AS x FROM {source}, range(24) yy(i), range(32) xx(i)")
    q.add(f"{source}_kind", f"""SELECT k, y, x,
      CASE WHEN k % 11 = 0 THEN false WHEN k % 13 = 0 THEN x BETWEEN 5 AND 7 AND y BETWEEN 5 AND 7
           ELSE x >= 3 + k % 5 AND x < 13 + k % 5 + s % 13 AND y >= 3 + k % 4 AND y < 10 + k % 4 + s % 9 END AS card FROM {source}_px""")
    tone = lambda i, c, w: f"CASE WHEN card AND (x + 3 * y + k) % 7 = 0 AND k % 13 <> 0 THEN {i} WHEN card OR (k % 4 = 0 AND x BETWEEN 27 AND 30 AND y BETWEEN 20 AND 23) THEN {c} ELSE {w} END"
    return q.add(f"card_{source}", f"SELECT k AS image_id, y, x, {tone(40, 230, 60)} AS b, {tone(40, 232, 110)} AS g, {tone(40, 235, 150)} AS r FROM {source}_kind")


def ruling(q: Steps) -> str:
    return q.add("ruling", """SELECT s_suppkey::BIGINT AS image_id, yy.i::INTEGER AS y, xx.i::INTEGER AS x,
      CASE WHEN ((100 * yy.i - xx.i * (s_suppkey % 41 - 20)) % 1600 + 1600) % 1600 < 200 THEN 0 ELSE 255 END AS v FROM supplier, range(72) yy(i), range(96) xx(i)""")


def grid(q: Steps) -> str:
    q.add("grid_at", "SELECT vec_id AS image_id, embedding AS e, unnest(range(0, len(embedding))) AS i FROM embeddings WHERE embedding IS NOT NULL")
    return q.add("grid", "SELECT image_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, least(255, greatest(0, floor((e[i + 1]::DOUBLE + 0.5) * 255)))::INTEGER AS v FROM grid_at")


# Pixels.


def gray(q: Steps, p: str) -> str:
    return q.add(f"{p}_gray", f"SELECT image_id, y, x, ((299 * r + 587 * g + 114 * b + 500) // 1000)::INTEGER AS v FROM {p}")


def hsv(q: Steps, p: str) -> str:
    q.add(f"{p}_mm", f"SELECT *, greatest(b, g, r) AS hi, least(b, g, r) AS lo FROM {p}")
    q.add(f"{p}_deg", f"""SELECT *, CASE WHEN hi = lo THEN 0.0::DOUBLE WHEN hi = r THEN 60 * (g - b) / (hi - lo)::DOUBLE
      WHEN hi = g THEN 120 + 60 * (b - r) / (hi - lo)::DOUBLE ELSE 240 + 60 * (r - g) / (hi - lo)::DOUBLE END AS d FROM {p}_mm""")
    return q.add(f"{p}_hsv", f"""SELECT image_id, y, x, r, (floor((CASE WHEN d < 0 THEN d + 360 ELSE d END) / 2 + 0.5)::INTEGER % 180)::INTEGER AS h,
      (CASE WHEN hi = 0 THEN 0 ELSE floor(255 * (hi - lo)::DOUBLE / hi + 0.5) END)::INTEGER AS s, hi AS v FROM {p}_deg""")


WOOD = "h BETWEEN 5 AND 35 AND s BETWEEN 25 AND 200 AND v BETWEEN 40 AND 220"


def wood(q: Steps, p: str) -> str:
    hsv(q, p)
    return q.add(f"{p}_wood", f"SELECT image_id, y, x, CASE WHEN {WOOD} THEN 255 ELSE 0 END AS v FROM {p}_hsv")


def otsu(q: Steps, p: str) -> str:
    q.add(f"{p}_hist", f"SELECT image_id, v, count(*) AS c FROM {p} GROUP BY ALL")
    q.add(f"{p}_cum", f"""SELECT image_id, v, sum(c) OVER u AS n1, sum(c * v) OVER u AS s1, sum(c) OVER i AS n, sum(c * v) OVER i AS s FROM {p}_hist
      WINDOW i AS (PARTITION BY image_id), u AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING)""")
    q.add(f"{p}_sigma", f"SELECT image_id, v, ((s1 * n - n1 * s)::DOUBLE * (s1 * n - n1 * s)::DOUBLE) / (n1 * (n - n1))::DOUBLE AS sigma FROM {p}_cum WHERE n1 < n")
    return q.add(f"{p}_otsu", f"SELECT i.image_id, coalesce(t, 0)::INTEGER AS t FROM (SELECT DISTINCT image_id FROM {p}) i LEFT JOIN (SELECT image_id, arg_max(v, (sigma, -v)) AS t FROM {p}_sigma GROUP BY image_id) s USING (image_id)")


def binarized(q: Steps, p: str) -> str:
    otsu(q, p)
    return q.add(f"{p}_bin", f"SELECT image_id, y, x, CASE WHEN v > t THEN 255 ELSE 0 END AS v FROM {p} JOIN {p}_otsu USING (image_id)")


# Neighbourhoods.

_W = "WINDOW a AS (PARTITION BY image_id, y ORDER BY x), b AS (PARTITION BY image_id, x ORDER BY y)"


def laplacian(q: Steps, p: str) -> str:
    q.add(f"{p}_four", f"SELECT image_id, y, x, v, lag(v) OVER a AS l, lead(v) OVER a AS r, lag(v) OVER b AS u, lead(v) OVER b AS d FROM {p} {_W}")
    return q.add(f"{p}_lap", f"SELECT image_id, y, x, coalesce(l, r, v) + coalesce(r, l, v) + coalesce(u, d, v) + coalesce(d, u, v) - 4 * v AS g FROM {p}_four")


def blur(q: Steps, p: str, threshold: float = 100.0) -> str:
    laplacian(q, p)
    q.add(f"{p}_sums", f"SELECT image_id, count(*) AS n, sum(g)::BIGINT AS s, sum(g::BIGINT * g)::BIGINT AS sq FROM {p}_lap GROUP BY image_id")
    return q.add(f"{p}_blur", f"SELECT image_id, round_even((n * sq - s * s)::DOUBLE / (n * n)::DOUBLE * 100, 0) / 100 AS blur_score, (n * sq - s * s)::DOUBLE / (n * n)::DOUBLE < {threshold} AS is_blurry FROM {p}_sums")


def size(q: Steps, p: str) -> str:
    return q.add(f"{p}_size", f"SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width FROM {p} GROUP BY image_id")


def gaussian(q: Steps, p: str, k: int) -> str:
    """By joins with a table of weights."""
    size(q, p)
    q.add(f"taps{k}", f"SELECT * FROM (VALUES {_values([(i - k // 2, w) for i, w in enumerate(gaussian_weights(k))])}) t(o, w)")
    q.add(f"{p}_need", f"SELECT image_id, y, x, o, w, {_reflect('x + o', 'width')} AS sx FROM {p} JOIN {p}_size USING (image_id), taps{k}")
    q.add(f"{p}_gx", f"SELECT n.image_id, n.y, n.x, ((sum(n.w * s.v) + 32768) // 65536)::INTEGER AS v FROM {p}_need n JOIN {p} s ON n.image_id = s.image_id AND n.y = s.y AND n.sx = s.x GROUP BY ALL")
    q.add(f"{p}_need2", f"SELECT image_id, y, x, o, w, {_reflect('y + o', 'height')} AS sy FROM {p} JOIN {p}_size USING (image_id), taps{k}")
    return q.add(f"{p}_gauss", f"SELECT n.image_id, n.y, n.x, ((sum(n.w * s.v) + 32768) // 65536)::INTEGER AS v FROM {p}_need2 n JOIN {p}_gx s ON n.image_id = s.image_id AND n.x = s.x AND n.sy = s.y GROUP BY ALL")


def rect(q: Steps, p: str, kw: int, kh: int, pick: str) -> str:
    name = f"{p}_{pick}{kw}x{kh}"
    q.add(f"{name}_h", f"SELECT image_id, y, x, {pick}(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {kw // 2} PRECEDING AND {kw - 1 - kw // 2} FOLLOWING) AS v FROM {p}")
    return q.add(name, f"SELECT image_id, y, x, {pick}(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {kh // 2} PRECEDING AND {kh - 1 - kh // 2} FOLLOWING) AS v FROM {name}_h")


def closing(q: Steps, p: str, k: int) -> str:
    return rect(q, rect(q, p, k, k, "max"), k, k, "min")


def opening(q: Steps, p: str, k: int) -> str:
    return rect(q, rect(q, p, k, k, "min"), k, k, "max")


def ellipse(q: Steps, p: str, k: int) -> str:
    """By joins with a table of offsets."""
    q.add(f"ell{k}", f"SELECT * FROM (VALUES {_values([(d - k // 2, o) for d, w in enumerate(ellipse_half_widths(k)) for o in range(-w, w + 1)])}) t(dy, dx)")
    for name, source, pick in ((f"{p}_edil", p, "max"), (f"{p}_eclose", f"{p}_edil", "min")):
        q.add(name, f"SELECT t.image_id, t.y, t.x, {pick}(s.v) AS v FROM {source} t, ell{k} e JOIN {source} s ON s.image_id = t.image_id AND s.y = t.y + e.dy AND s.x = t.x + e.dx GROUP BY ALL")
    return f"{p}_eclose"


def normalised(q: Steps, p: str, k: int) -> str:
    ellipse(q, p, k)
    return q.add(f"{p}_flat", f"SELECT a.image_id, a.y, a.x, (CASE WHEN c.v = 0 THEN 0 ELSE least(255, round_even(a.v * 255 / c.v::DOUBLE, 0)) END)::INTEGER AS v FROM {p} a JOIN {p}_eclose c USING (image_id, y, x)")


def adaptive(q: Steps, p: str, k: int) -> str:
    return opening(q, binarized(q, normalised(q, p, k)), 2)


def sobel(q: Steps, p: str) -> str:
    """By joins with the eight reflected neighbours."""
    size(q, p)
    q.add("around", "SELECT * FROM (VALUES (-1,-1,-1,-1), (-1,0,0,-2), (-1,1,1,-1), (0,-1,-2,0), (0,1,2,0), (1,-1,-1,1), (1,0,0,2), (1,1,1,1)) t(dy, dx, wx, wy)")
    q.add(f"{p}_nb", f"SELECT image_id, y, x, wx, wy, {_reflect('y + dy', 'height')} AS sy, {_reflect('x + dx', 'width')} AS sx FROM {p} JOIN {p}_size USING (image_id), around")
    return q.add(f"{p}_sobel", f"SELECT n.image_id, n.y, n.x, sum(wx * s.v)::INTEGER AS gx, sum(wy * s.v)::INTEGER AS gy FROM {p}_nb n JOIN {p} s ON s.image_id = n.image_id AND s.y = n.sy AND s.x = n.sx GROUP BY ALL")


def canny(q: Steps, p: str, low: int = 50, high: int = 150) -> str:
    sobel(q, p)
    q.add(f"{p}_m", f"SELECT *, abs(gx) + abs(gy) AS m FROM {p}_sobel")
    q.add(f"{p}_dir", f"""SELECT *, CASE WHEN abs(gy)::BIGINT * 32768 < abs(gx)::BIGINT * 13573 THEN 0 WHEN abs(gy)::BIGINT * 32768 > abs(gx)::BIGINT * 79109 THEN -1
      WHEN gx::BIGINT * gy > 0 THEN -1 ELSE -1 END AS dy, CASE WHEN abs(gy)::BIGINT * 32768 < abs(gx)::BIGINT * 13573 THEN -1
      WHEN abs(gy)::BIGINT * 32768 > abs(gx)::BIGINT * 79109 THEN 0 WHEN gx::BIGINT * gy > 0 THEN -1 ELSE 1 END AS dx FROM {p}_m""")
    q.add(f"{p}_thin", f"""SELECT c.image_id, c.y, c.x, CASE WHEN c.m > coalesce(f.m, 0) AND c.m >= coalesce(t.m, 0) THEN c.m ELSE 0 END AS m FROM {p}_dir c
      LEFT JOIN {p}_m f ON f.image_id = c.image_id AND f.y = c.y + c.dy AND f.x = c.x + c.dx LEFT JOIN {p}_m t ON t.image_id = c.image_id AND t.y = c.y - c.dy AND t.x = c.x - c.dx""")
    # Growing from the strong pixels through the weak ones.
    q.add(f"{p}_grow", f"SELECT image_id, y, x FROM {p}_thin WHERE m > {high} UNION SELECT w.image_id, w.y, w.x FROM {p}_grow s JOIN {p}_thin w ON w.image_id = s.image_id AND abs(w.y - s.y) <= 1 AND abs(w.x - s.x) <= 1 AND w.m > {low}")
    return q.add(f"{p}_canny", f"SELECT t.image_id, t.y, t.x, CASE WHEN g.image_id IS NULL THEN 0 ELSE 255 END AS v FROM {p}_thin t LEFT JOIN {p}_grow g USING (image_id, y, x)")


# Local contrast.


def clahe_lut(q: Steps, p: str, tiles: int, clip: float = 1.5) -> str:
    size(q, p)
    q.add(f"{p}_ext", f"SELECT *, ((width + {tiles - 1}) // {tiles})::INTEGER AS tw, ((height + {tiles - 1}) // {tiles})::INTEGER AS th FROM {p}_size")
    q.add(f"{p}_pad", f"SELECT image_id, tw, th, py.i AS py, px.i AS px, {_reflect('py.i', 'height')} AS sy, {_reflect('px.i', 'width')} AS sx FROM {p}_ext, LATERAL (SELECT unnest(range(0, th * {tiles})) AS i) py, LATERAL (SELECT unnest(range(0, tw * {tiles})) AS i) px")
    q.add(f"{p}_tile", f"SELECT d.image_id, (py // th)::INTEGER AS ty, (px // tw)::INTEGER AS tx, tw * th AS area, v, count(*) AS c FROM {p}_pad d JOIN {p} s ON s.image_id = d.image_id AND s.y = d.sy AND s.x = d.sx GROUP BY ALL")
    q.add(f"{p}_bins", f"""SELECT t.image_id, t.ty, t.tx, t.area, greatest(1, floor({clip}::DOUBLE * t.area / 256))::INTEGER AS lim, b.i::INTEGER AS v, coalesce(c, 0) AS c
      FROM (SELECT DISTINCT image_id, ty, tx, area FROM {p}_tile) t CROSS JOIN range(256) b(i) LEFT JOIN {p}_tile h ON h.image_id = t.image_id AND h.ty = t.ty AND h.tx = t.tx AND h.v = b.i""")
    q.add(f"{p}_over", f"SELECT *, sum(greatest(c - lim, 0)) OVER (PARTITION BY image_id, ty, tx) AS e FROM {p}_bins")
    q.add(f"{p}_level", f"""SELECT *, least(c, lim) + e // 256 + CASE WHEN e % 256 > 0 AND v % greatest(256 // greatest(e % 256, 1), 1) = 0 AND v // greatest(256 // greatest(e % 256, 1), 1) < e % 256 THEN 1 ELSE 0 END AS lv FROM {p}_over""")
    return q.add(f"{p}_lut", f"SELECT image_id, ty, tx, v, least(255, round_even(sum(lv) OVER (PARTITION BY image_id, ty, tx ORDER BY v ROWS UNBOUNDED PRECEDING)::DOUBLE * 255 / area, 0))::INTEGER AS lut FROM {p}_level")


def clahe(q: Steps, p: str, tiles: int) -> str:
    lut = clahe_lut(q, p, tiles)
    q.add(f"{p}_pos", f"SELECT image_id, y, x, v, x / tw::DOUBLE - 0.5 AS fx, y / th::DOUBLE - 0.5 AS fy FROM {p} JOIN {p}_ext USING (image_id)")
    inside = lambda e: f"greatest(0, least({tiles - 1}, {e}))::INTEGER"
    q.add(f"{p}_near", f"SELECT *, {inside('floor(fx)')} AS a1, {inside('floor(fx) + 1')} AS a2, {inside('floor(fy)')} AS b1, {inside('floor(fy) + 1')} AS b2, fx - floor(fx) AS wx, fy - floor(fy) AS wy FROM {p}_pos")
    on = lambda t, b, a: f"JOIN {lut} {t} ON {t}.image_id = n.image_id AND {t}.ty = n.{b} AND {t}.tx = n.{a} AND {t}.v = n.v"
    return q.add(f"{p}_clahe", f"""SELECT n.image_id, n.y, n.x, round_even((p.lut * (1 - wx) + q.lut * wx) * (1 - wy) + (r.lut * (1 - wx) + s.lut * wx) * wy, 0)::INTEGER AS v FROM {p}_near n
      {on('p', 'b1', 'a1')} {on('q', 'b1', 'a2')} {on('r', 'b2', 'a1')} {on('s', 'b2', 'a2')}""")


def nlm(q: Steps, p: str, template: int, search: int, h: float = 7.0) -> str:
    """Patches around all places within reach, as arrays; squared distances by inner products (whole numbers that a FLOAT holds exactly)."""
    size(q, p)
    t, r = template // 2, search // 2
    n = template * template
    q.add(f"{p}_px", f"SELECT image_id, height, width, list(v ORDER BY y, x) AS px FROM {p} JOIN {p}_size USING (image_id) GROUP BY ALL")
    q.add(f"{p}_tall", f"SELECT *, unnest(range({-r}, height + {r})) AS cy FROM {p}_px")
    q.add(f"{p}_centre", f"SELECT *, unnest(range({-r}, width + {r})) AS cx FROM {p}_tall")
    offsets = [(a, b) for a in range(-t, t + 1) for b in range(-t, t + 1)]
    value = lambda dy, dx: f"px[{_reflect(f'cy + {dy}', 'height')} * width + {_reflect(f'cx + {dx}', 'width')} + 1]"
    q.add(f"{p}_patch", f"SELECT image_id, cy::INTEGER AS cy, cx::INTEGER AS cx, height, width, {value(0, 0)} AS v, [{', '.join(value(*o) for o in offsets)}]::FLOAT[{n}] AS a FROM {p}_centre")
    q.add(f"{p}_norm", f"SELECT *, array_inner_product(a, a) AS s FROM {p}_patch")
    q.add(f"{p}_off", f"SELECT dy.i::INTEGER AS dy, dx.i::INTEGER AS dx FROM range({-r}, {r + 1}) dy(i), range({-r}, {r + 1}) dx(i)")
    q.add(f"{p}_pair", f"SELECT image_id, cy, cx, cy + dy AS oy, cx + dx AS ox, a, s FROM {p}_norm, {p}_off WHERE cy BETWEEN 0 AND height - 1 AND cx BETWEEN 0 AND width - 1")
    q.add(f"{p}_w", f"SELECT m.image_id, m.cy, m.cx, o.v, exp(-((m.s + o.s - 2 * array_inner_product(m.a, o.a))::DOUBLE / {n}::DOUBLE) / {h * h}::DOUBLE) AS w FROM {p}_pair m JOIN {p}_norm o ON o.image_id = m.image_id AND o.cy = m.oy AND o.cx = m.ox")
    return q.add(f"{p}_nlm", f"SELECT image_id, cy AS y, cx AS x, round_even(sum(CASE WHEN w < 0.001 THEN 0 ELSE w * v END) / sum(CASE WHEN w < 0.001 THEN 0 ELSE w END), 0)::INTEGER AS v FROM {p}_w GROUP BY ALL")


# Regions.


def row_runs(q: Steps, p: str) -> str:
    return q.add(f"{p}_runs", f"SELECT image_id, y, min(x) AS x1, max(x) AS x2 FROM (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM {p} WHERE v > 0) GROUP BY image_id, y, k")


def comps(q: Steps, p: str) -> str:
    runs = row_runs(q, p)
    q.add(f"{p}_reach", f"""SELECT image_id, y, x1, x2, y AS cy, x1 AS cx FROM {runs} UNION
      SELECT n.image_id, n.y, n.x1, n.x2, r.cy, r.cx FROM {p}_reach r JOIN {runs} n ON n.image_id = r.image_id AND abs(n.y - r.y) = 1 AND n.x1 <= r.x2 + 1 AND r.x1 <= n.x2 + 1""")
    q.add(f"{p}_label", f"SELECT image_id, y, x1, x2, min((cy, cx)) AS c FROM {p}_reach GROUP BY image_id, y, x1, x2")
    q.add(f"{p}_rows", f"SELECT image_id, c[1] AS comp_y, c[2] AS comp_x, y, min(x1) AS lo, max(x2) AS hi, sum(x2 - x1 + 1) AS px FROM {p}_label GROUP BY ALL")
    q.add(f"{p}_strip", f"SELECT *, ((hi - lo) + lead(hi - lo) OVER (PARTITION BY image_id, comp_y, comp_x ORDER BY y)) / 2.0::DOUBLE AS strip FROM {p}_rows")
    return q.add(f"{p}_comps", f"SELECT image_id, comp_y, comp_x, min(lo) AS x, min(y) AS y, max(hi) - min(lo) + 1 AS w, max(y) - min(y) + 1 AS h, sum(px)::BIGINT AS n_pixels, coalesce(sum(strip), 0.0::DOUBLE) AS area FROM {p}_strip GROUP BY image_id, comp_y, comp_x")


def box(q: Steps, p: str, sized: str) -> str:
    comps(q, p)
    size(q, sized)
    q.add(f"{p}_top", f"SELECT * FROM {p}_comps QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, comp_y, comp_x) = 1")
    big = "CASE WHEN area >= 0.05::DOUBLE * height * width THEN"
    return q.add(f"{p}_box", f"SELECT z.image_id, height, width, {big} x END AS x, {big} y END AS y, {big} w END AS w, {big} h END AS h FROM {sized}_size z LEFT JOIN {p}_top USING (image_id)")


def document_mask(q: Steps, p: str, s) -> str:  # noqa: ANN001
    bright = binarized(q, gaussian(q, gray(q, p), s.blur))
    wood(q, p)
    q.add(f"{p}_both", f"SELECT a.image_id, a.y, a.x, a.v & (255 - w.v) AS v FROM {bright} a JOIN {p}_wood w USING (image_id, y, x)")
    return opening(q, closing(q, f"{p}_both", s.close), s.open)


def cropped(q: Steps, p: str, mask: str, margin: int) -> str:
    boxes = box(q, mask, p)
    q.add(f"{p}_cut", f"SELECT image_id, x, least(x + {margin}, width - 1) AS xa, least(y + {margin}, height - 1) AS ya, least(x + w - {margin}, width) AS xb, least(y + h - {margin}, height) AS yb FROM {boxes}")
    q.add(f"{p}_edge", f"SELECT image_id, x IS NOT NULL AND xb > xa AND yb > ya AS ok, xa, ya, xb, yb FROM {p}_cut")
    return q.add(f"{p}_crop", f"""SELECT image_id, (y - CASE WHEN ok THEN ya ELSE 0 END)::INTEGER AS y, (x - CASE WHEN ok THEN xa ELSE 0 END)::INTEGER AS x, b, g, r FROM {p} JOIN {p}_edge USING (image_id)
      WHERE NOT ok OR (x >= xa AND x < xb AND y >= ya AND y < yb)""")


# Lines and rotation.


def votes(q: Steps, p: str, threshold: int) -> str:
    q.add("trig", f"SELECT * FROM (VALUES {_values(trig_table())}) t(theta, c, s)")
    q.add(f"{p}_cast", f"SELECT image_id, y, x, theta, floor((x * c + y * s + 8192) / 16384)::INTEGER AS rho, floor((y * c - x * s) / 16384)::INTEGER AS pos FROM {p}, trig WHERE v > 0")
    q.add(f"{p}_acc", f"SELECT image_id, theta, rho, count(*) AS n FROM {p}_cast GROUP BY ALL")
    beside = lambda shift, over, column, step: f"CASE WHEN {shift}({column}) OVER {over} = {column} + {step} THEN {shift}(n) OVER {over} ELSE 0 END"
    q.add(f"{p}_near", f"""SELECT *, {beside('lag', 'a', 'rho', -1)} AS l, {beside('lead', 'a', 'rho', 1)} AS r, {beside('lag', 'b', 'theta', -1)} AS d, {beside('lead', 'b', 'theta', 1)} AS u FROM {p}_acc
      WINDOW a AS (PARTITION BY image_id, theta ORDER BY rho), b AS (PARTITION BY image_id, rho ORDER BY theta)""")
    return q.add(f"{p}_hough", f"SELECT image_id, theta, rho, n FROM {p}_near WHERE n >= {threshold} AND n > l AND n > d AND n >= r AND n >= u")


def segments(q: Steps, p: str, threshold: int, min_length: int, max_gap: int) -> str:
    votes(q, p, threshold)
    q.add(f"{p}_on", f"SELECT c.* FROM {p}_cast c JOIN {p}_hough h USING (image_id, theta, rho)")
    q.add(f"{p}_gap", f"SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY image_id, theta, rho ORDER BY pos, y, x) > {max_gap} THEN 1 ELSE 0 END AS cut FROM {p}_on")
    q.add(f"{p}_isl", f"SELECT *, sum(cut) OVER (PARTITION BY image_id, theta, rho ORDER BY pos, y, x ROWS UNBOUNDED PRECEDING) AS k FROM {p}_gap")
    q.add(f"{p}_ends", f"SELECT image_id, theta, rho, k, min((x, y)) AS a, max((x, y)) AS b FROM {p}_isl GROUP BY ALL HAVING max(pos) - min(pos) >= {min_length}")
    return q.add(f"{p}_seg", f"SELECT image_id, a[1] AS x1, a[2] AS y1, b[1] AS x2, b[2] AS y2 FROM {p}_ends")


def skew(q: Steps, p: str, images: str, threshold: int, min_length: int, max_gap: int) -> str:
    seg = segments(q, p, threshold, min_length, max_gap)
    q.add(f"{p}_ang", f"SELECT image_id, degrees(atan2(y2 - y1, x2 - x1)) AS a FROM {seg}")
    q.add(f"{p}_med", f"SELECT image_id, count(*) AS n_lines, round(median(a), 9) AS m FROM {p}_ang WHERE a > -45 AND a < 45 GROUP BY image_id")
    return q.add(f"{p}_skew", f"SELECT image_id, coalesce(n_lines, 0) AS n_lines, m AS median_angle, coalesce(abs(m) BETWEEN 0.5 AND 30, false) AS applied FROM (SELECT DISTINCT image_id FROM {images}) i LEFT JOIN {p}_med USING (image_id)")


def geometry(q: Steps, skewed: str, images: str) -> str:
    size(q, images)
    u = 1 << 20
    q.add(f"{images}_cs", f"SELECT image_id, height AS h, width AS w, round(cos(radians(CASE WHEN applied THEN median_angle ELSE 0 END)) * {u})::BIGINT AS c, round(sin(radians(CASE WHEN applied THEN median_angle ELSE 0 END)) * {u})::BIGINT AS s FROM {images}_size JOIN {skewed} USING (image_id)")
    q.add(f"{images}_new", f"SELECT *, ((h * abs(s) + w * abs(c)) // {u})::INTEGER AS new_w, ((h * abs(c) + w * abs(s)) // {u})::INTEGER AS new_h, w // 2 AS cx, h // 2 AS cy FROM {images}_cs")
    return q.add(f"{images}_geo", f"""SELECT image_id, h AS height, w AS width, new_w, new_h, round(c / {u}::DOUBLE, 9) AS m00, round(s / {u}::DOUBLE, 9) AS m01,
      round((({u} - c) * cx - s * cy) / {u}::DOUBLE + (new_w - w) / 2.0::DOUBLE, 9) AS m02, round(-s / {u}::DOUBLE, 9) AS m10, round(c / {u}::DOUBLE, 9) AS m11,
      round((s * cx + ({u} - c) * cy) / {u}::DOUBLE + (new_h - h) / 2.0::DOUBLE, 9) AS m12, c, s, cx, cy FROM {images}_new""")


def rotated(q: Steps, p: str, geo: str, channel: str = "v") -> str:
    """By joins with tap tables and the clamped source pixels."""
    u = 1 << 20
    q.add("cubic", f"SELECT * FROM (VALUES {_values([(i, k - 1, w) for i, r in enumerate(cubic_weights()) for k, w in enumerate(r)])}) t(f, o, w)")
    q.add(f"{p}_tgt", f"SELECT g.*, 2 * tx - (new_w - width) - 2 * cx AS dx, 2 * ty - (new_h - height) - 2 * cy AS dy, tx, ty FROM (SELECT *, unnest(range(0, new_w)) AS tx FROM (SELECT *, unnest(range(0, new_h)) AS ty FROM {geo})) g")
    q.add(f"{p}_src", f"SELECT image_id, tx, ty, height, width, floor((16 * (c * dx - s * dy) + cx * 32 * {u} + {u // 2}) / {u})::BIGINT AS sx, floor((16 * (s * dx + c * dy) + cy * 32 * {u} + {u // 2}) / {u})::BIGINT AS sy FROM {p}_tgt")
    low = lambda a: f"floor({a} / 32)::BIGINT"
    q.add(f"{p}_tap", f"""SELECT image_id, tx, ty, wx.w * wy.w AS w, greatest(0, least({low('sx')} + wx.o, width - 1)) AS ax, greatest(0, least({low('sy')} + wy.o, height - 1)) AS ay
      FROM {p}_src JOIN cubic wx ON wx.f = ((sx % 32) + 32) % 32 JOIN cubic wy ON wy.f = ((sy % 32) + 32) % 32""")
    return q.add(f"{p}_rot_{channel}", f"SELECT t.image_id, ty::INTEGER AS y, tx::INTEGER AS x, greatest(0, least(255, floor((sum(w * {channel}) + {1 << 21}) / {1 << 22})))::INTEGER AS {channel} FROM {p}_tap t JOIN {p} s ON s.image_id = t.image_id AND s.y = t.ay AND s.x = t.ax GROUP BY t.image_id, ty, tx")


# Recognition.


def raw_ocr(q: Steps) -> str:
    q.add("ocr_lines", "SELECT doc_id AS k, v.variant, CASE WHEN doc_id % 11 = 0 THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS t FROM documents, (VALUES ('raw'), ('preprocessed')) v(variant) WHERE text IS NOT NULL")
    return q.add("ocr", """SELECT k, 'scan/' || k || '.png' AS document_name, variant, t, CASE WHEN k % 13 <> 0 THEN len(t) ELSE 0 END AS n_scores,
      CASE WHEN k % 7 = 0 THEN greatest(len(t) - 1, 0) ELSE len(t) END AS n_polys FROM ocr_lines""")


def blocks(q: Steps) -> str:
    raw_ocr(q)
    q.add("ocr_at", "SELECT k, document_name, variant, t, unnest(range(0, least(len(t), n_scores, n_polys))) AS i FROM ocr")
    return q.add("block", "SELECT document_name, variant, i::INTEGER AS block_idx, t[i + 1] AS text, (('0x' || substr(md5(variant || t[i + 1]), 1, 6))::BIGINT % 1000) / 1000.0::DOUBLE AS confidence FROM ocr_at")


def summary(q: Steps) -> str:
    blocks(q)
    return q.add("summary", "SELECT o.document_name, o.variant, count(b.block_idx) AS total_blocks, round(avg(confidence), 9) AS mean_confidence FROM ocr o LEFT JOIN block b USING (document_name, variant) GROUP BY o.document_name, o.variant")
