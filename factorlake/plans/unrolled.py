"""SQL that computes what the iterative operators compute, a few iterations written out.

Rank two has closed 2 x 2 systems, rank one plain quotients; starts are the fixed factors of `data`.
"""

from __future__ import annotations


def _closed(b0: str, b1: str, g00: str, g01: str, g11: str) -> tuple[str, str]:
    det = f"({g00} * {g11} - {g01} * {g01})"
    return f"greatest(({b0} * {g11} - {b1} * {g01}) / {det}, 0)", f"greatest(({b1} * {g00} - {b0} * {g01}) / {det}, 0)"


def rank_two(steps: int, l1: float = 0.0, l2: float = 0.0, l21: float = 0.0, angular: float = 0.0) -> str:
    """CTEs from a, dims and w (w0, w1) to w{steps} (i, w0, w1) and d{steps} (d0, d1), penalties on both sides."""
    out = ["rows_ AS (SELECT unnest(range(m)) AS i FROM dims)", "cols_ AS (SELECT unnest(range(n)) AS j FROM dims)", "w0_ AS (SELECT i, w0, w1 FROM w)"]
    for t in range(steps):
        r = [f"{l2}"] * 2
        if l21 and t:
            r = [f"({l2} + {l21} / (SELECT n0 FROM s{t}))", f"({l2} + {l21} / (SELECT n1 FROM s{t}))"]
        out.append(f"g{t} AS (SELECT sum(w0 * w0) + {r[0]} AS g00, sum(w0 * w1) AS g01, sum(w1 * w1) + {r[1]} AS g11 FROM w{t}_)")
        out.append(f"b{t} AS (SELECT j, coalesce(sum(v * w0), 0) - {l1} AS b0, coalesce(sum(v * w1), 0) - {l1} AS b1 FROM cols_ LEFT JOIN (SELECT a.j, v, w0, w1 FROM a JOIN w{t}_ USING (i)) USING (j) GROUP BY j)")
        x, y = _closed("b0", "b1", "g00", "g01", "g11")
        out.append(f"f{t} AS (SELECT j, {x} AS h0, {y} AS h1 FROM b{t}, g{t})")
        if angular and t:
            out.append(f"h{t} AS (SELECT j, greatest(h0 - {angular} * n0 * h1 / n1 * c, 0) AS h0, greatest(h1 - {angular} * n1 * h0 / n0 * c, 0) AS h1 FROM f{t}, s{t})")
        else:
            out.append(f"h{t} AS (SELECT j, h0, h1 FROM f{t})")
        out.append(f"s{t + 1} AS (SELECT sum(h0) AS d0, sum(h1) AS d1, sum(h0 * h0) AS g00, sum(h0 * h1) AS g01, sum(h1 * h1) AS g11, sqrt(sum(h0 * h0)) AS n0, sqrt(sum(h1 * h1)) AS n1, sum(h0 * h1) / sqrt(sum(h0 * h0) * sum(h1 * h1)) AS c FROM h{t})")
        pen = f"{l2}" if not l21 else None
        p0, p1 = (pen, pen) if pen else (f"({l2} + {l21} / (SELECT sqrt(sum(w0 * w0)) FROM w{t}_))", f"({l2} + {l21} / (SELECT sqrt(sum(w1 * w1)) FROM w{t}_))")
        out.append(f"k{t} AS (SELECT g00 / (d0 * d0) + {p0} AS g00, g01 / (d0 * d1) AS g01, g11 / (d1 * d1) + {p1} AS g11, d0, d1 FROM s{t + 1})")
        out.append(f"c{t} AS (SELECT i, coalesce(sum(v * h0), 0) / any_value(k{t}.d0) - {l1} AS b0, coalesce(sum(v * h1), 0) / any_value(k{t}.d1) - {l1} AS b1 FROM rows_ LEFT JOIN (SELECT a.i, v, h0, h1 FROM a JOIN h{t} USING (j)) USING (i), k{t} GROUP BY i)")
        out.append(f"u{t} AS (SELECT i, {x} AS w0, {y} AS w1 FROM c{t}, k{t})")
        turn = f"u{t}"
        if angular:
            out.append(f"q{t} AS (SELECT sqrt(sum(w0 * w0)) AS n0, sqrt(sum(w1 * w1)) AS n1, sum(w0 * w1) / sqrt(sum(w0 * w0) * sum(w1 * w1)) AS c FROM u{t})")
            out.append(f"v{t} AS (SELECT i, greatest(w0 - {angular} * n0 * w1 / n1 * c, 0) AS w0, greatest(w1 - {angular} * n1 * w0 / n0 * c, 0) AS w1 FROM u{t}, q{t})")
            turn = f"v{t}"
        out.append(f"d{t + 1} AS (SELECT sum(w0) AS d0, sum(w1) AS d1 FROM {turn})")
        out.append(f"w{t + 1}_ AS (SELECT i, w0 / d0 AS w0, w1 / d1 AS w1 FROM {turn}, d{t + 1})")
    return ", ".join(out) + f", done AS (SELECT i, w0, w1, d0, d1 FROM w{steps}_, d{steps})"


def rank_two_masked(steps: int) -> str:
    """The same with an own Gram matrix for each column and row, from the stored entries of a only."""
    out = ["w0_ AS (SELECT i, w0, w1 FROM w)"]
    x, y = _closed("b0", "b1", "g00", "g01", "g11")
    for t in range(steps):
        out.append(f"b{t} AS (SELECT j, sum(v * w0) AS b0, sum(v * w1) AS b1, sum(w0 * w0) AS g00, sum(w0 * w1) AS g01, sum(w1 * w1) AS g11 FROM a JOIN w{t}_ USING (i) GROUP BY j)")
        out.append(f"h{t} AS (SELECT j, {x} AS h0, {y} AS h1 FROM b{t})")
        out.append(f"s{t} AS (SELECT sum(h0) AS d0, sum(h1) AS d1 FROM h{t})")
        out.append(f"c{t} AS (SELECT i, sum(v * h0 / d0) AS b0, sum(v * h1 / d1) AS b1, sum(h0 * h0 / (d0 * d0)) AS g00, sum(h0 * h1 / (d0 * d1)) AS g01, sum(h1 * h1 / (d1 * d1)) AS g11 FROM a JOIN h{t} USING (j), s{t} GROUP BY i)")
        out.append(f"u{t} AS (SELECT i, {x} AS w0, {y} AS w1 FROM c{t})")
        out.append(f"d{t + 1} AS (SELECT sum(w0) AS d0, sum(w1) AS d1 FROM u{t})")
        out.append(f"w{t + 1}_ AS (SELECT i, w0 / d0 AS w0, w1 / d1 AS w1 FROM u{t}, d{t + 1})")
    return ", ".join(out) + f", done AS (SELECT i, w0, w1, d0, d1 FROM w{steps}_, d{steps})"


def rank_one(steps: int, weight: str, rounds: int = 5, sizes: bool = False, graph: float = 0.0, name: str = "") -> str:
    """Reweighted rank one from a, dims and w (w0). weight: SQL of v, mu and, with sizes, z (the row's size). With graph, the
    Laplacian l (a, b, v) of the columns weighs on H from the second step on."""
    n = name
    out = [f"{n}w0_ AS (SELECT i, w0 AS w, 1.0::DOUBLE AS d FROM w)", f"{n}z0 AS (SELECT i, 5.0::DOUBLE AS z FROM w)"]
    for t in range(steps):
        g = f"(SELECT sum(w * w) FROM {n}w{t}_)" + (f" + {graph} * (SELECT sum(l.v * x.h * y.h) FROM l JOIN {n}h{t - 1}_{rounds} x ON x.j = l.a JOIN {n}h{t - 1}_{rounds} y ON y.j = l.b)" if graph and t else "")
        out.append(f"{n}e{t} AS (SELECT a.i, a.j, v, w, z FROM a JOIN {n}w{t}_ USING (i) JOIN {n}z{t} USING (i))")
        out.append(f"{n}h{t}_0 AS (SELECT j, greatest(sum(v * w) / ({g}), 0) AS h FROM {n}e{t} GROUP BY j)")
        for q in range(rounds):
            out.append(f"{n}r{t}_{q} AS (SELECT j, v, w, {weight} AS k FROM (SELECT j, v, w, z, w * h AS mu FROM {n}e{t} JOIN {n}h{t}_{q} USING (j)))")
            out.append(f"{n}h{t}_{q + 1} AS (SELECT j, greatest(sum(k * v * w) / ({g} + sum((k - 1) * w * w)), 0) AS h FROM {n}r{t}_{q} GROUP BY j)")
        h = f"{n}h{t}_{rounds}"
        out.append(f"{n}s{t} AS (SELECT sum(h) AS d, sum(h * h) AS g FROM {h})")
        out.append(f"{n}k{t} AS (SELECT i, j, v, h, {weight} AS k FROM (SELECT i, j, v, h, z, w * h AS mu FROM {n}e{t} JOIN {h} USING (j)))")
        out.append(f"{n}u{t} AS (SELECT i, greatest((sum(k * v * h) / any_value(d)) / (any_value(g) / power(any_value(d), 2) + sum((k - 1) * h * h) / power(any_value(d), 2)), 0) AS w FROM {n}k{t}, {n}s{t} GROUP BY i)")
        out.append(f"{n}w{t + 1}_ AS (SELECT i, w / (SELECT sum(w) FROM {n}u{t}) AS w, (SELECT sum(w) FROM {n}u{t}) AS d FROM {n}u{t})")
        if sizes:
            out.append(f"{n}m{t} AS (SELECT a.i, sum(a.v * a.v - 2 * a.v * greatest(x.w * x.d * h.h / s.d, 1e-10)) AS left_ FROM a JOIN {n}w{t + 1}_ x ON x.i = a.i JOIN {h} h ON h.j = a.j, {n}s{t} s GROUP BY a.i)")
            out.append(f"{n}y{t} AS (SELECT x.i, w * x.d AS mu, power(w * x.d, 2) * s.g / (s.d * s.d) AS sq, left_ FROM {n}w{t + 1}_ x JOIN {n}m{t} USING (i), {n}s{t} s)")
            out.append(f"{n}z{t + 1} AS (SELECT i, CASE WHEN sq + left_ - mu > 1e-10 AND sq > 1e-10 THEN least(greatest(sq / (sq + left_ - mu), 0.01), 1e6) ELSE 1e6 END AS z FROM {n}y{t})")
        else:
            out.append(f"{n}z{t + 1} AS (SELECT i, 5.0::DOUBLE AS z FROM w)")
    return ", ".join(out) + f", {n}done AS (SELECT i, w, d FROM {n}w{steps}_), {n}size AS (SELECT i, z FROM {n}z{steps})"


def theta(steps: int = 5, start: float = 0.1) -> str:
    """Majorising steps of the generalised Poisson from f (i, v, mu) and t (i, total: mu over all columns): th{steps} (i, theta)."""
    out = [f"th0 AS (SELECT DISTINCT i, {start}::DOUBLE AS theta FROM f)"]
    for q in range(steps):
        out.append(f"tp{q} AS (SELECT i, any_value(theta) AS old, sum(CASE WHEN v >= 1 THEN (v - 1) * mu / greatest(mu + theta * v, 1e-10) ELSE 0 END) + count(*) FILTER (v >= 1) AS alpha, sum(CASE WHEN v >= 1 THEN (v - 1) * (1 - mu / greatest(mu + theta * v, 1e-10)) ELSE 0 END) AS gamma, sum(v) AS y FROM f JOIN th{q} USING (i) GROUP BY i)")
        out.append(f"tb{q} AS (SELECT i, old, alpha, gamma, y - total - gamma + alpha AS beta FROM tp{q} JOIN t USING (i))")
        out.append(f"th{q + 1} AS (SELECT i, CASE WHEN beta * beta + 4 * alpha * gamma > 0 AND -beta + sqrt(beta * beta + 4 * alpha * gamma) >= 0 THEN least((-beta + sqrt(beta * beta + 4 * alpha * gamma)) / (2 * alpha), 5) ELSE old END AS theta FROM tb{q})")
    return ", ".join(out)


def power(steps: int) -> str:
    """Power iteration on A A' from ones: u (i, u) of unit length and top (d), the first singular pair."""
    out = ["x0 AS (SELECT DISTINCT i, 1.0::DOUBLE AS x FROM a)"]
    for t in range(steps):
        out.append(f"y{t} AS (SELECT j, sum(v * x) AS y FROM a JOIN x{t} USING (i) GROUP BY j)")
        out.append(f"z{t} AS (SELECT i, sum(v * y) AS z FROM a JOIN y{t} USING (j) GROUP BY i)")
        out.append(f"x{t + 1} AS (SELECT i, z / (SELECT sqrt(sum(z * z)) FROM z{t}) AS x FROM z{t})")
    out.append(f"u AS (SELECT i, x AS u FROM x{steps}), last_ AS (SELECT j, sum(v * u) AS y FROM a JOIN u USING (i) GROUP BY j), top AS (SELECT sqrt(sum(y * y)) AS d FROM last_)")
    return ", ".join(out)


def split(steps: int) -> str:
    """Closed rank-two steps of a split from a, dims and w (w0, w1): sides (j, cluster)."""
    out = ["cols_ AS (SELECT unnest(range(n)) AS j FROM dims)", "rows_ AS (SELECT unnest(range(m)) AS i FROM dims)", "w0_ AS (SELECT i, w0, w1 FROM w)"]
    x, y = _closed("b0", "b1", "g00", "g01", "g11")
    for t in range(steps):
        out.append(f"g{t} AS (SELECT sum(w0 * w0) AS g00, sum(w0 * w1) AS g01, sum(w1 * w1) AS g11 FROM w{t}_)")
        out.append(f"b{t} AS (SELECT j, coalesce(sum(v * w0), 0) AS b0, coalesce(sum(v * w1), 0) AS b1 FROM cols_ LEFT JOIN (SELECT a.j, v, w0, w1 FROM a JOIN w{t}_ USING (i)) USING (j) GROUP BY j)")
        out.append(f"f{t} AS (SELECT j, {x} AS h0, {y} AS h1 FROM b{t}, g{t})")
        out.append(f"h{t} AS (SELECT j, h0 / (SELECT sum(h0) FROM f{t}) AS h0, h1 / (SELECT sum(h1) FROM f{t}) AS h1 FROM f{t})")
        out.append(f"k{t} AS (SELECT sum(h0 * h0) AS g00, sum(h0 * h1) AS g01, sum(h1 * h1) AS g11 FROM h{t})")
        out.append(f"c{t} AS (SELECT i, coalesce(sum(v * h0), 0) AS b0, coalesce(sum(v * h1), 0) AS b1 FROM rows_ LEFT JOIN (SELECT a.i, v, h0, h1 FROM a JOIN h{t} USING (j)) USING (i) GROUP BY i)")
        out.append(f"u{t} AS (SELECT i, {x} AS w0, {y} AS w1 FROM c{t}, k{t})")
        out.append(f"w{t + 1}_ AS (SELECT i, w0 / (SELECT sum(w0) FROM u{t}) AS w0, w1 / (SELECT sum(w1) FROM u{t}) AS w1 FROM u{t})")
    out.append(f"scale_ AS (SELECT sum(v * w0) AS s0, sum(v * w1) AS s1 FROM a JOIN w{steps}_ USING (i))")
    return ", ".join(out) + f", sides AS (SELECT j, CASE WHEN (CASE WHEN s0 >= s1 THEN h0 - h1 ELSE h1 - h0 END) > 0 THEN 0 ELSE 1 END AS cluster FROM h{steps - 1}, scale_)"
