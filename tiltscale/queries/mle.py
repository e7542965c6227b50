"""SQL text of the difference tests' fits: the same roots as ``operators.diff`` finds, by halving alone."""

from __future__ import annotations

from ..operators.diff import DEFAULT_K

#: Halvings and Newton's steps after them; brackets are at most 0.23 wide.
ROUNDS = {"nb": (52, 0), "betanb": (14, 3)}
_FROM = 12  # Stirling's series starts here


def _psi(z: str) -> str:
    u, v = f"(1 / pow({z} + {_FROM}, 2))", f"({z} + {_FROM})"
    return f"(ln({v}) - 0.5 / {v} - {u} * (1 / 12.0 - {u} * (1 / 120.0 - {u} * (1 / 252.0 - {u} * (1 / 240.0 - {u} / 132.0)))) - ({' + '.join(f'1 / ({z} + {i}.0)' for i in range(_FROM))}))"


def _psi1(z: str) -> str:
    u, v = f"(1 / pow({z} + {_FROM}, 2))", f"({z} + {_FROM})"
    return f"(1 / {v} + {u} / 2 + {u} / {v} * (1 / 6.0 - {u} * (1 / 30.0 - {u} * (1 / 42.0 - {u} * (1 / 30.0 - {u} * 5 / 66.0)))) + {' + '.join(f'1 / pow({z} + {i}.0, 2)' for i in range(_FROM))})"


def _rising(z: str, r: str) -> str:
    tail = lambda v: f"(1 / (12 * {v}) - 1 / (360 * pow({v}, 3)) + 1 / (1260 * pow({v}, 5)))"
    return f"(({z} - 0.5) * ln(1 + {r} / {z}) + {r} * ln({z} + {r}) - {r} + {tail(f'({z} + {r})')} - {tail(z)})"


def _columns(dist: str, bend: bool) -> str:
    """Columns value, slope (and bend) of a cell (x, r) at p, given x > 4; each uses those before it."""
    out = []
    if dist == "nb":
        head = ["pow(1 - p, r) AS h0", *[f"h{i} * p * (r + {i}) / {i + 1} AS h{i + 1}" for i in range(5)]]
        out += head
        out.append(f"1 - ({' + '.join(f'h{i}' for i in range(5))}) AS m0")
        # from a small mass: its first term times a series, from its far end
        out.append("CASE WHEN m0 < 0.05 THEN list_reduce(list_reverse(range(1, 120))::DOUBLE[], lambda a, j: 1 + p * (r + 4 + j) / (5 + j) * a) ELSE m0 / h5 END AS s")
        out.append("5 / (p * (1 - p) * s) AS f")
        out.append("x * ln(p) + r * ln(1 - p) - (ln(s) + lgamma(r + 5) - lgamma(r) - lgamma(6.0) + 5 * ln(p) + r * ln(1 - p)) AS value")
        out.append("x / p - r / (1 - p) - f AS slope")
        if bend:
            out.append("-x / (p * p) - r / pow(1 - p, 2) - f * (4 / p - (r - 1) / (1 - p) - f) AS bend")
        return ", ".join(out)
    k = f"{DEFAULT_K}::DOUBLE"
    out += [f"{k} AS k", "p * k AS a", "(1 - p) * k AS b", f"exp({_rising('b', 'r')} - {_rising('k', 'r')}) AS t0", f"-k * ({_psi('(b + r)')} - {_psi('b')}) AS s0"]
    for i in range(4):
        out += [f"t{i} * ({i} + r) * ({i} + a) / ({i + 1} * ({i} + k + r)) AS t{i + 1}", f"s{i} + k / ({i} + a) AS s{i + 1}"]
    out.append(f"1 - ({' + '.join(f't{i}' for i in range(5))}) AS m")
    out.append(f"-({' + '.join(f't{i} * s{i}' for i in range(5))}) / m AS f")
    out.append(f"{_rising('a', 'x')} + {_rising('b', 'r')} - ln(m) AS value")
    out.append(f"k * ({_psi('(a + x)')} - {_psi('a')}) + s0 - f AS slope")
    if bend:
        out.append(f"k * k * ({_psi1('(b + r)')} - {_psi1('b')}) AS c0")
        out += [f"c{i} - pow(k / ({i} + a), 2) AS c{i + 1}" for i in range(4)]
        out.append(f"-({' + '.join(f't{i} * (s{i} * s{i} + c{i})' for i in range(5))}) / m - f * f AS f2")
        out.append(f"k * k * ({_psi1('(a + x)')} - {_psi1('a')}) + c0 - f2 AS bend")
    return ", ".join(out)


def cells_sql(grouped: str, keys: str) -> str:
    """CTEs problem (id, keys, allele, group, n) and cell (id, x, r, n) from a table of observations by group."""
    return f"""
side AS (
  SELECT {keys}, "group", 'ref' AS allele, ref_count::DOUBLE AS x, alt_count::DOUBLE AS r FROM {grouped} UNION ALL SELECT {keys}, "group", 'alt', alt_count, ref_count FROM {grouped}
), many AS (
  SELECT {keys}, allele, "group", x, r, count(*) AS n FROM (SELECT * FROM side UNION ALL SELECT * REPLACE ('__all__' AS "group") FROM side) GROUP BY ALL
), problem AS MATERIALIZED (
  SELECT *, row_number() OVER () AS id FROM (SELECT {keys}, allele, "group", sum(n)::BIGINT AS n FROM many GROUP BY ALL)
), cell AS MATERIALIZED (
  SELECT id, x, r, many.n FROM many JOIN problem USING ({keys}, allele, "group")
)"""


def fits_sql(dist: str = "nb") -> str:
    """CTE fit (id, p, nll, var, var_sandwich) of the table ``cell``."""
    slope, bent = _columns(dist, False), _columns(dist, True)
    text = f"""
grid AS (
  SELECT id, arg_min(i, nll) AS i FROM (
    SELECT id, i, -sum(n * value) AS nll FROM (SELECT *, {slope} FROM (SELECT *, 0.01 + 0.98 * i / 9 AS p FROM cell, range(10) AS g(i))) GROUP BY id, i
  ) GROUP BY id
), b0 AS MATERIALIZED (
  SELECT id, CASE WHEN i = 0 THEN 1e-12 ELSE 0.01 + 0.98 * (i - 1) / 9 END AS lo, CASE WHEN i = 9 THEN 1 - 1e-12 ELSE 0.01 + 0.98 * (i + 1) / 9 END AS hi, 0.01 + 0.98 * i / 9 AS p FROM grid
)"""
    halve, newton = ROUNDS[dist]
    for k in range(halve):
        text += f""", b{k + 1} AS MATERIALIZED (
  SELECT id, lo, hi, (lo + hi) / 2 AS p FROM (
    SELECT id, CASE WHEN sum(n * slope) > 0 THEN any_value(p) ELSE any_value(lo) END AS lo, CASE WHEN sum(n * slope) > 0 THEN any_value(hi) ELSE any_value(p) END AS hi
    FROM (SELECT *, {slope} FROM cell JOIN b{k} USING (id)) GROUP BY id
  )
)"""
    for k in range(halve, halve + newton):
        text += f""", b{k + 1} AS MATERIALIZED (
  SELECT id, any_value(lo) AS lo, any_value(hi) AS hi, greatest(least(any_value(p) - sum(n * slope) / sum(n * bend), any_value(hi)), any_value(lo)) AS p
  FROM (SELECT *, {bent} FROM cell JOIN b{k} USING (id)) GROUP BY id
)"""
    # only least counts: the likelihood falls with p, whose mass above the truncation then has no digits left in 1 - head
    edge, low = ("value", "p") if dist == "nb" else (_EDGE, "CASE WHEN top = 5 THEN 1e-12 ELSE p END")
    return text + f""", last AS MATERIALIZED (
  SELECT id, CASE WHEN p < 2e-12 THEN 1e-12 WHEN p > 1 - 2e-12 THEN 1 - 1e-12 ELSE p END AS p FROM (SELECT id, {low} AS p FROM b{halve + newton} JOIN (SELECT id, max(x) AS top FROM cell GROUP BY id) USING (id))
), fit AS MATERIALIZED (
  SELECT id, p, nll, CASE WHEN info > 0 AND p > 1e-12 AND p < 1 - 1e-12 THEN 1 / info END AS var, CASE WHEN info > 0 AND p > 1e-12 AND p < 1 - 1e-12 THEN squares / (info * info) END AS var_sandwich FROM (
    SELECT id, any_value(p) AS p, -sum(n * CASE WHEN p > 1e-11 THEN value ELSE {edge} END) AS nll, -sum(n * bend) AS info, sum(n * slope * slope) AS squares
    FROM (SELECT *, {bent} FROM cell JOIN last USING (id)) GROUP BY id
  )
)"""


#: The beta negative binomial's value at a vanishing p, its mass summed term by term.
_EDGE = """(lgamma(a + x) - lgamma(a) + lgamma(b + r) - lgamma(b) - ln(list_sum(list_transform(range(5, 200),
    lambda y: exp(lgamma(y + r) - lgamma(r) - lgamma(y + 1.0) + lgamma(a + y) - lgamma(a) + lgamma(b + r) - lgamma(b) + lgamma(k) - lgamma(k + r + y))))))"""


def erfc(z: str) -> str:
    """Of z >= 0: one less a series of positive terms, or beyond 2.5 the continued fraction from its far end."""
    series = f"1 - coalesce(list_sum(list_transform(range(80), lambda i: exp((2 * i + 1) * ln(greatest({z}, 1e-300)) - ({z}) * ({z}) - lgamma(i + 1.5)))), 0)"
    fraction = f"exp(-({z}) * ({z})) / (({z}) * sqrt(pi()) * list_reduce(list_reverse(range(1, 200))::DOUBLE[], lambda a, j: 1 + j / (2 * ({z}) * ({z})) / a))"
    return f"(CASE WHEN {z} > 2.5 THEN {fraction} ELSE {series} END)"


def chi2_sf(x: str, df: str) -> str:
    """For one or two degrees of freedom."""
    return f"(CASE WHEN {df} = 1 THEN {erfc(f'sqrt(({x}) / 2)')} ELSE exp(-({x}) / 2) END)"


def norm_two_sided(z: str) -> str:
    return erfc(f"({z}) / sqrt(2.0)")


def wald_sql(keys: str, var: str = "var", logit: bool = False, contrast: tuple[float, float, float] = (1, -1, 0)) -> str:
    """CTE tested (keys, allele, n, p and std of control and test, pval) from ``problem`` and ``fit``."""
    a, b, c = contrast
    value = "ln(p / (1 - p))" if logit else "p"
    spread = "* pow(1 / p + 1 / (1 - p), 2)" if logit else ""
    return f"""
shown AS (
  SELECT {keys}, allele, "group", n, p, {value} AS v, raw, raw {spread} AS w FROM (SELECT *, CASE WHEN {var} IS NOT NULL THEN least(greatest({var}, 0), pow(1 - p, 2)) END AS raw FROM problem JOIN fit USING (id))
), tested AS (
  SELECT {keys}, allele, n_control, n_test, p_control, p_test, sqrt(raw_control) AS std_control, sqrt(raw_test) AS std_test,
    CASE WHEN raw_control + raw_test > 0 AND ws > 0 THEN {norm_two_sided('abs(zs) / sqrt(ws)')} ELSE 1.0 END AS pval FROM (
    SELECT {keys}, allele, c.n AS n_control, t.n AS n_test, c.p AS p_control, t.p AS p_test, c.raw AS raw_control, t.raw AS raw_test,
      {float(a)} * c.v + {float(b)} * t.v + {float(c)} AS zs, {float(a * a)} * c.w + {float(b * b)} * t.w AS ws
    FROM (SELECT * FROM shown WHERE "group" = 'control') c JOIN (SELECT * FROM shown WHERE "group" = 'test') t USING ({keys}, allele)
  )
)"""


def lrt_sql(keys: str) -> str:
    """CTE ratio (keys, allele, groups, n_all, p_all, stat, pval)."""
    return f"""
ratio AS (
  SELECT *, {chi2_sf('stat', 'groups - 1')} AS pval FROM (
    SELECT {keys}, allele, count(*) FILTER ("group" <> '__all__') AS groups, max(n) FILTER ("group" = '__all__') AS n_all, max(p) FILTER ("group" = '__all__') AS p_all,
      greatest(2 * (max(nll) FILTER ("group" = '__all__') - sum(nll) FILTER ("group" <> '__all__')), 0) AS stat
    FROM problem JOIN fit USING (id) GROUP BY ALL
  ) WHERE groups >= 2
)"""


def pairs_sql(keys: str, dist: str = "nb") -> str:
    """CTE pair (keys, allele, group, n, p, p_all, pval): each group against all groups' p."""
    return f"""
pooled AS (
  SELECT {keys}, allele, p AS p_all FROM problem JOIN fit USING (id) WHERE "group" = '__all__'
), own AS (
  SELECT id, {keys}, allele, "group", problem.n, p AS p_own, nll, p_all FROM problem JOIN fit USING (id) JOIN pooled USING ({keys}, allele) WHERE "group" <> '__all__'
), moved AS (
  SELECT id, -sum(n * value) AS moved_nll FROM (SELECT *, {_columns(dist, False)} FROM (SELECT id, cell.x, cell.r, cell.n, p_all AS p FROM cell JOIN own USING (id))) GROUP BY id
), pair AS (
  SELECT {keys}, allele, "group", n, p_own AS p, p_all, {chi2_sf('greatest(2 * (moved_nll - nll), 0)', '1')} AS pval FROM own JOIN moved USING (id)
)"""


def wide_sql(table: str, keys: str, fields: list[str]) -> str:
    """A query with one row a key, and the fields of both alleles."""
    each = ", ".join(f"{a}.{f} AS {n}_{f}" for a, n in (("a", "ref"), ("b", "alt")) for f in fields)
    return f"SELECT {keys}, {each} FROM (SELECT * FROM {table} WHERE allele = 'ref') a JOIN (SELECT * FROM {table} WHERE allele = 'alt') b USING ({keys})"


def with_fdr(table: str, p: str, out: str, by: str = "") -> str:
    """A query: ``table`` with the Benjamini-Hochberg values of the column p."""
    keep = f"{by}, " if by else ""
    return f"""SELECT * EXCLUDE (__k, __m), CASE WHEN {p} IS NOT NULL THEN least(1, min({p} * __m / __k) OVER (PARTITION BY {keep}{p} IS NULL ORDER BY {p} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS {out}
    FROM (SELECT *, count({p}) OVER (PARTITION BY {keep}{p} IS NULL ORDER BY {p} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __k, count({p}) OVER ({f'PARTITION BY {by}' if by else ''}) AS __m FROM {table})"""


def effects_sql(keys: str) -> str:
    """CTE effect (keys, allele, group, es, es_var, mean_es) from ``cell`` and ``pair``: moments of NB(r, p) given x > 4 by their sums."""
    return f"""
want AS (
  SELECT DISTINCT r, unnest([p_own, p_all]) AS p FROM cell JOIN own USING (id)
), sums AS (
  SELECT r, p, sum(w) AS s0, sum(w * t) AS s1, sum(w * t * t) AS s2, sum(w * x) AS sx FROM (
    SELECT r, p, x, log2(x) AS t, exp(lgamma(x + r) - lgamma(r) - lgamma(x + 1.0) + x * ln(p) + r * ln(1 - p)) AS w
    FROM want, unnest(range(5, greatest(60, (r * p + 12 * sqrt(r * p)) / (1 - p) - 60 / ln(p))::BIGINT)) AS u(x)
  ) GROUP BY r, p
), moment AS (
  SELECT r, p, s1 / s0 AS first, s2 / s0 - pow(s1 / s0, 2) AS spread, sx / s0 AS mean FROM sums
), effect AS (
  SELECT {keys}, allele, "group", sum(cell.n * (a.first - b.first)) / sum(cell.n) AS es, sum(cell.n * (a.spread + b.spread)) / pow(sum(cell.n), 2) AS es_var,
    sum(cell.n * (log2(a.mean) - log2(b.mean))) / sum(cell.n) AS mean_es
  FROM cell JOIN own USING (id) JOIN moment a ON a.r = cell.r AND a.p = p_own JOIN moment b ON b.r = cell.r AND b.p = p_all GROUP BY {keys}, allele, "group"
)"""
