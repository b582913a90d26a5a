"""SQL of fitted maps: matrices are lists of rows, and roots of matrices come from a recursive iteration.

Maps whose solution is made of products, inverses, inverse roots and polar factors
need no decomposition: for a symmetric positive matrix A the coupled iteration
T = (3 I - Z Y) / 2, Y <- Y T, Z <- T Z from Y = A / trace(A), Z = I converges to the root
and the inverse root of A / trace(A).
"""

from __future__ import annotations

from latentspark.sources.fixtures import LATENT_SQL, WIDE_SQL, WIDTH, WIDTH_A, WIDTH_B

#: Steps of the iteration; each multiplies the least eigenvalue by over 2 until it is near 1.
STEPS = 40


def product(a: str, b: str) -> str:
    """a times the transpose of b."""
    return f"list_transform({a}, lambda r: list_transform({b}, lambda c: list_dot_product(r, c)))"


def transposed(a: str) -> str:
    return f"list_transform(range(1, len({a}[1]) + 1), lambda k: list_transform({a}, lambda r: r[k]))"


def scaled(a: str, by: str) -> str:
    return f"list_transform({a}, lambda r: list_transform(r, lambda v: v * ({by})))"


def ridged(a: str, alpha: float) -> str:
    """a plus alpha times its mean diagonal."""
    return f"list_transform({a}, lambda r, i: list_transform(r, lambda v, j: v + CASE WHEN i = j THEN {alpha} * list_sum(list_transform({a}, lambda q, k: q[k])) / len({a}) ELSE 0 END))"


def mean_rows(relation: str, vector: str, width: int, where: str) -> str:
    return f"(SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg({vector}[i]) AS m FROM {relation}, (SELECT unnest(range(1, {width + 1})) AS i) WHERE {where} GROUP BY i))"


def moments(relation: str, x: str, y: str, width_x: int, width_y: int, aggregate: str = "avg") -> str:
    """Mean (or sum) of x'y over a relation."""
    sides = f"(SELECT unnest(range(1, {width_x + 1})) AS i), (SELECT unnest(range(1, {width_y + 1})) AS j)"
    return f"(SELECT list(r ORDER BY i) FROM (SELECT i, list(c ORDER BY j) AS r FROM (SELECT i, j, {aggregate}({x}[i] * {y}[j]) AS c FROM {relation}, {sides} GROUP BY i, j) GROUP BY i))"


def roots(name: str, matrix: str, of: str) -> str:
    """CTEs that end in ``name(root, inv)``: root and inverse root of the symmetric positive ``matrix`` of the one row of ``of``."""
    step = f"list_transform({product('z', transposed('y'))}, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = j THEN 1.5 ELSE 0 END - 0.5 * v))"
    return f"""
{name}_0 AS (SELECT {matrix} AS a FROM {of}), {name}_1 AS (SELECT a, list_sum(list_transform(a, lambda r, i: r[i])) AS s FROM {name}_0),
{name}_2(n, s, y, z) AS (
  SELECT 0, s, {scaled("a", "1 / s")}, list_transform(a, lambda r, i: list_transform(r, lambda v, j: CAST(i = j AS DOUBLE))) FROM {name}_1
  UNION ALL SELECT n + 1, s, {product("y", transposed("t"))}, {product("t", transposed("z"))} FROM (SELECT *, {step} AS t FROM {name}_2 WHERE n < {STEPS})
), {name} AS (SELECT {scaled("y", "sqrt(s)")} AS root, {scaled("z", "1 / sqrt(s)")} AS inv FROM {name}_2 WHERE n = {STEPS})"""


TRAIN = "split = 'train'"

#: Means, centred pairs ``(split, x, y, t)`` and the train split's covariances ``(xx, yy, xy)``.
def pairs_of(latent: str, width_a: int, width_b: int) -> str:
    return f"""WITH RECURSIVE {latent}, mean AS (
  SELECT {mean_rows("a", "v", width_a, TRAIN)} AS ma, {mean_rows("b", "v", width_b, TRAIN)} AS mb
), duo AS (
  SELECT a.sample_id, a.split, list_transform(a.v, lambda v, i: v - ma[i]) AS x, list_transform(b.v, lambda v, i: v - mb[i]) AS y, b.v AS t
  FROM a JOIN b ON a.sample_id = b.sample_id, mean
), train AS (SELECT * FROM duo WHERE split = 'train'), c AS (
  SELECT {moments("train", "x", "x", width_a, width_a)} AS xx, {moments("train", "y", "y", width_b, width_b)} AS yy, {moments("train", "x", "y", width_a, width_b)} AS xy
)"""


PAIRS = pairs_of(LATENT_SQL, WIDTH_A, WIDTH_B)


def scored(method: str, parameters: int = WIDTH_A * WIDTH_B, symbols: int = WIDTH_A, pilots: str = "train", more: str = "", width_b: int = WIDTH_B) -> str:
    """The record of a map ``f(p)`` from centred source rows to centred target rows."""
    return f"""
, m AS (
  SELECT sample_id, t, list_transform({transposed("p")}, lambda q, i: list_dot_product(q, x) + mb[i]) AS p FROM duo, f, mean WHERE split = 'test'
), d AS (SELECT sample_id, unnest(range(1, {width_b + 1})) AS i, unnest(p) AS p, unnest(t) AS t FROM m), e AS (
  SELECT sum((p - t) * (p - t)) AS e, sum(t * t) AS q, var_pop(t) * count(*) AS c, count(*) AS n FROM d GROUP BY i
), k AS (
  SELECT m.sample_id, 1 + count(*) FILTER (o.sample_id <> m.sample_id AND list_cosine_similarity(m.p, o.t) > list_cosine_similarity(m.p, m.t)) AS rank FROM m, m o GROUP BY m.sample_id
)
SELECT '{method}' AS method, round((SELECT sum(e) / sum(n) FROM e), 6) AS mse, round((SELECT sum(e) / sum(q) FROM e), 6) AS nmse, round((SELECT 1 - sum(e) / sum(c) FROM e), 6) AS r2,
  round((SELECT avg(list_cosine_similarity(p, t)) FROM m), 6) AS cosine, round(avg(1.0 / rank), 6) AS mrr, round(avg(CAST(rank <= 1 AS INT)), 6) AS top1,
  round(avg(CAST(rank <= 5 AS INT)), 6) AS top5, round(avg(CAST(rank <= 10 AS INT)), 6) AS top10,
  CAST((SELECT count(*) FROM {pilots}) AS INTEGER) AS paired_used, {symbols} AS symbols, {parameters} AS map_params{more} FROM k"""


WHITE = "," + roots("wx", "xx", "c") + "," + roots("wy", "yy", "c") + f", w AS (SELECT wx.inv AS wx, wy.root AS ry, {product(product('wx.inv', transposed('xy')), 'wy.inv')} AS m FROM wx, wy, c)"


def polar(matrix: str, of: str) -> str:
    """CTEs that end in ``polar(q)``: the polar factor of a wide matrix."""
    return f"broad AS (SELECT {matrix} AS g FROM {of})," + roots("pr", product("g", "g"), "broad") + f", polar AS (SELECT {product('pr.inv', transposed('g'))} AS q FROM pr, broad)"


def rigid(pairs: str = PAIRS) -> str:
    """Whitened spaces joined by the polar factor of their cross moments."""
    return pairs + WHITE + ", " + polar("m", "w") + f", f AS (SELECT {product(product('wx', transposed('q')), 'ry')} AS p FROM w, polar)"


def least(pairs: str = PAIRS) -> str:
    """Whitened least squares: the gram is the identity, so the ridge only scales."""
    return pairs + WHITE + f", f AS (SELECT {scaled(product(product('wx', transposed('m')), 'ry'), '1 / (1 + 1e-6)')} AS p FROM w)"


def turned(pairs: str = PAIRS) -> str:
    """Charts that only turn the centred spaces change nothing in an orthogonal map."""
    return pairs + ", " + polar("xy", "c") + ", f AS (SELECT q AS p FROM polar)"


def canonical(reg: float, pairs: str = PAIRS) -> str:
    """With S the ridged roots and Q the polar factor of Sx Cxy Sy, the map over all directions is Sx (Q Sy^2 Q')^-1 Q Sy."""
    return (
        pairs + "," + roots("sx", ridged("xx", reg), "c") + "," + roots("sy", ridged("yy", reg), "c")
        + f", sw AS (SELECT {product(product('sx.inv', transposed('xy')), 'sy.inv')} AS m FROM sx, sy, c), " + polar("m", "sw")
        + f", qs AS (SELECT {product('q', 'sy.inv')} AS g FROM polar, sy)," + roots("qr", product("g", "g"), "qs")
        + f", f AS (SELECT {product(product(product('sx.inv', 'qr.inv'), 'qr.inv'), transposed('g'))} AS p FROM sx, qr, qs)"
    )


def on_pilots(method: str, n: int, seed: int) -> str:
    """A map fitted on n pilots by hash, between charts whitened on the whole train split."""
    base = (
        PAIRS + "," + roots("wx", "xx", "c") + "," + roots("wy", "yy", "c")
        + f", pilots AS (SELECT * FROM train ORDER BY md5('{seed}:' || sample_id), sample_id LIMIT {n})"
        + f", sums AS (SELECT {moments('pilots', 'x', 'x', WIDTH_A, WIDTH_A, 'sum')} AS gx, {moments('pilots', 'x', 'y', WIDTH_A, WIDTH_B, 'sum')} AS gxy)"
        + f", w AS (SELECT wx.inv AS wx, wy.root AS ry, {product(product('wx.inv', transposed('gx')), 'wx.inv')} AS g, {product(product('wx.inv', transposed('gxy')), 'wy.inv')} AS m FROM wx, wy, sums)"
    )
    if method == "procrustes":
        fit = ", " + polar("m", "w") + f", f AS (SELECT {product(product('wx', transposed('q')), 'ry')} AS p FROM w, polar)"
    else:
        fit = "," + roots("gi", ridged("g", 1e-6), "w") + f", f AS (SELECT {product(product(product(product('wx', 'inv'), 'inv'), transposed('m')), 'ry')} AS p FROM w, gi)"
    return base + fit + scored(method, pilots="pilots", more=f", {n} AS n_pilots, {seed} AS seed")


PILOT_SWEEP_SQL = " UNION ALL ".join(f"SELECT * FROM ({on_pilots(method, n, seed)})" for seed in (0, 1) for n in (32, 64) for method in ("procrustes", "linear"))

MAP_SQL = {
    "procrustes": rigid() + scored("procrustes"),
    "l_ortho": rigid() + scored("l_ortho"),
    "linear": least() + scored("linear"),
    "affine": least() + scored("affine", WIDTH_A * WIDTH_B + WIDTH_B),
    "pca_procrustes": turned() + scored("pca_procrustes"),
    "cca": canonical(1e-3) + scored("cca", WIDTH_A * WIDTH_A + WIDTH_A * WIDTH_B),
    # 99 % of the variance takes every direction of these tables, and turning the spaces changes nothing.
    "svcca": canonical(1e-4) + scored("svcca", WIDTH_A * WIDTH_A + WIDTH_A * WIDTH_B),
}


def _wide() -> dict[str, str]:
    """The same maps between agents of an embedding's whole width."""
    pairs, d = pairs_of(WIDE_SQL, WIDTH, WIDTH), WIDTH
    made = {
        "procrustes": (rigid(pairs), d * d), "l_ortho": (rigid(pairs), d * d), "linear": (least(pairs), d * d), "affine": (least(pairs), d * d + d),
        "pca_procrustes": (turned(pairs), d * d), "cca": (canonical(1e-3, pairs), 2 * d * d),
    }
    return {f"wide_{name}": sql + scored(name, parameters, d, width_b=d) for name, (sql, parameters) in made.items()}


WIDE_MAP_SQL = _wide()


def cells(matrix: str, of: str) -> str:
    rows = f"SELECT unnest(range(0, len({matrix}))) AS i, unnest({matrix}) AS r FROM {of}"
    return f" SELECT CAST(i AS INTEGER) AS i, CAST(unnest(range(0, len(r))) AS INTEGER) AS j, round(unnest(r), 6) + 0.0 AS value FROM ({rows})"


ALL_B = f"""WITH RECURSIVE {LATENT_SQL}, mean AS (SELECT {mean_rows("b", "v", WIDTH_B, "true")} AS mb), centred AS (
  SELECT sample_id, split, geo_label, v, list_transform(v, lambda x, i: x - mb[i]) AS y FROM b, mean
), c AS (SELECT {moments("centred", "y", "y", WIDTH_B, WIDTH_B)} AS yy)"""

WHITEN_SQL = ALL_B + "," + roots("wy", "yy", "c") + cells("inv", "wy")


def axes(k: int, steps: int = 14) -> str:
    """CTEs axis_1 .. axis_k ``(v, rest)``: leading eigenvectors by squaring, each taken out of the matrix before the next."""
    out, of, matrix = "", "c", "yy"
    for at in range(1, k + 1):
        trace = "list_sum(list_transform(a, lambda r, i: r[i]))"
        out += f"""
, power_{at}(n, m, a) AS (
  SELECT 0, {matrix}, {scaled(matrix, f"1 / list_sum(list_transform({matrix}, lambda r, i: r[i]))")} FROM {of}
  UNION ALL SELECT n + 1, m, {scaled("a", f"1 / {trace}")} FROM (SELECT n, m, {product("a", "a")} AS a FROM power_{at} WHERE n < {steps})
), top_{at} AS (
  SELECT m, a[place] AS row, sqrt(a[place][place]) AS size FROM (SELECT m, a, list_position(d, list_max(d)) AS place FROM (SELECT *, list_transform(a, lambda r, i: r[i]) AS d FROM power_{at} WHERE n = {steps}))
), axis_{at} AS (
  SELECT v, list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - value * v[i] * v[j])) AS rest
  FROM (SELECT m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS value FROM (SELECT m, list_transform(row, lambda x: x / size) AS v FROM top_{at}))
)"""
        of, matrix = f"axis_{at}", "rest"
    return out


PCA_SQL = ALL_B + axes(4) + " UNION ALL ".join(f" SELECT CAST(unnest(range(0, {WIDTH_B})) AS INTEGER) AS i, {at - 1} AS j, round(unnest(v), 6) + 0.0 AS value FROM axis_{at}" for at in range(1, 5))

CLASSES = "(SELECT list(g ORDER BY g) AS l FROM (SELECT DISTINCT geo_label AS g FROM tr))"
#: One-hot ridge with a free intercept; the first class wins ties.
PROBE_SQL = f"""WITH RECURSIVE {LATENT_SQL}, mean AS (SELECT {mean_rows("b", "v", WIDTH_B, TRAIN)} AS mb), tr AS (
  SELECT geo_label, list_transform(v, lambda x, i: x - mb[i]) AS y FROM b, mean WHERE split = 'train' AND geo_label IS NOT NULL
), hot AS (
  SELECT y, list_transform(l, lambda g: CAST(g = geo_label AS DOUBLE)) AS h FROM tr, {CLASSES}
), c AS (SELECT {moments("tr", "y", "y", WIDTH_B, WIDTH_B, "sum")} AS yy), cross_c AS (
  SELECT list(r ORDER BY i) AS yh FROM (SELECT i, list(s ORDER BY j) AS r FROM (SELECT i, j, sum(y[i] * h[j]) AS s FROM hot, (SELECT unnest(range(1, {WIDTH_B + 1})) AS i), (SELECT unnest(range(1, len(h) + 1)) AS j FROM (SELECT h FROM hot LIMIT 1)) GROUP BY i, j) GROUP BY i)
),{roots("g", ridged("yy", 1e-6), "c")}, weights AS (
  SELECT {product(product("inv", "inv"), transposed("yh"))} AS w FROM g, cross_c
), share AS (SELECT list(s ORDER BY j) AS b FROM (SELECT j, avg(h[j]) AS s FROM hot, (SELECT unnest(range(1, len(h) + 1)) AS j FROM (SELECT h FROM hot LIMIT 1)) GROUP BY j)), said AS (
  SELECT sample_id, geo_label, list_transform({transposed("w")}, lambda q, j: list_dot_product(q, list_transform(v, lambda x, i: x - mb[i])) + b[j]) AS s FROM b AS test, mean, weights, share WHERE split = 'test'
)
SELECT sample_id, geo_label, l[list_position(s, list_max(s))] AS predicted FROM said, {CLASSES}"""


def _off_unit(relation: str, vector: str, width: int) -> str:
    return f"(SELECT avg(abs(1 - s)) FROM (SELECT var_pop({vector}[i]) AS s FROM {relation}, (SELECT unnest(range(1, {width + 1})) AS i) GROUP BY i))"


def _apply(matrix: str, vector: str) -> str:
    return f"list_transform({matrix}, lambda c: list_dot_product(c, {vector}))"


#: Variance and cross moments of both splits on charts whitened on the train split; inverse roots are symmetric.
CORRELATION_SQL = (
    PAIRS + "," + roots("wx", "xx", "c") + "," + roots("wy", "yy", "c")
    + f", z AS (SELECT split, {_apply('wx.inv', 'x')} AS x, {_apply('wy.inv', 'y')} AS y FROM duo, wx, wy)"
    + "".join(f", z_{s} AS (SELECT * FROM z WHERE split = '{s}'), g_{s} AS (SELECT {moments(f'z_{s}', 'x', 'y', WIDTH_A, WIDTH_B)} AS g)" for s in ("train", "test"))
    + " UNION ALL ".join(
        f" SELECT '{s}' AS split, round({_off_unit(f'z_{s}', 'x', WIDTH_A)}, 6) + 0.0 AS src_off, round({_off_unit(f'z_{s}', 'y', WIDTH_B)}, 6) + 0.0 AS tgt_off, "
        f"round(sqrt(list_sum(list_transform(g, lambda r: list_dot_product(r, r))) / {min(WIDTH_A, WIDTH_B)}), 6) AS rho_rms FROM g_{s}" for s in ("train", "test"))
)

#: Covariance of held-out rows on a chart whitened on the train split.
HELD_OUT_SQL = (
    PAIRS + "," + roots("wy", "yy", "c")
    + f", z0 AS (SELECT {_apply('wy.inv', 'y')} AS z FROM duo, wy WHERE split = 'test'), zm AS (SELECT {mean_rows('z0', 'z', WIDTH_B, 'true')} AS m)"
    + f", z1 AS (SELECT list_transform(z, lambda v, i: v - m[i]) AS z FROM z0, zm), zc AS (SELECT {moments('z1', 'z', 'z', WIDTH_B, WIDTH_B)} AS zz)"
    + cells("zz", "zc")
)
