"""The registered queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

import math

from weftline.operators.distances import random_directions

EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, 60.0]
KEY = "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)))"
POP = f"""pop AS (
  SELECT {KEY} AS row_id, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, l_quantity AS z1, l_extendedprice / 1000 AS z2,
    l_quantity * ((1 - l_discount) * (1 + l_tax)) AS x1, (l_extendedprice / 1000) * ((1 - l_discount) * (1 + l_tax)) AS x2,
    CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 1 + l_discount * 10 END AS w
  FROM lineitem)"""


def long(weight: str = "w") -> str:
    parts = " UNION ALL ".join(f"SELECT '{d}' AS dim, y, {weight} AS w, {d} AS v FROM pop" for d in ("x1", "x2", "z1", "z2"))
    return f"long AS ({parts})"


def w1(source: str, by: str = "dim", name: str = "w1", out: str = "w") -> str:
    """CTEs that end in ``out`` (by, name)."""
    return f"""{out}_m AS (SELECT {by}, v, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS a, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS b FROM {source} GROUP BY ALL),
{out}_t AS (SELECT {by}, sum(a) AS ta, sum(b) AS tb FROM {out}_m GROUP BY ALL),
{out}_s AS (SELECT {by}, sum(a / ta - b / tb) OVER (PARTITION BY {by} ORDER BY v) AS h, lead(v) OVER (PARTITION BY {by} ORDER BY v) - v AS d FROM {out}_m JOIN {out}_t USING ({by})),
{out} AS (SELECT {by}, coalesce(sum(abs(h) * d), 0) AS {name} FROM {out}_s GROUP BY ALL)"""


HIST = """r AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM long GROUP BY dim),
g AS (SELECT *, least(99, greatest(0, CAST(floor((v - lo) / (hi - lo) * 100) AS INTEGER))) AS k FROM long JOIN r USING (dim)),
f AS (SELECT *, CASE WHEN v < lo + (hi - lo) * k / 100 THEN k - 1 WHEN v >= lo + (hi - lo) * (k + 1) / 100 THEN k + 1 ELSE k END AS j FROM g),
m AS (SELECT dim, greatest(0, least(99, j)) AS bin, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS a, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS b FROM f GROUP BY ALL),
h AS (SELECT dim, bin, a / sum(a) OVER (PARTITION BY dim) AS p, b / sum(b) OVER (PARTITION BY dim) AS q FROM m),
js AS (SELECT dim, (sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2 AS js,
  sum(CASE WHEN p + q > 0 THEN (p - q) * (p - q) / (p + q) ELSE 0 END) AS triangular FROM h GROUP BY dim)"""
METRICS = "SELECT dim, 'wasserstein' AS metric, w1 AS value FROM w UNION ALL SELECT dim, 'jensen_shannon', js FROM js UNION ALL SELECT dim, 'triangular', triangular FROM js"


def hashed(seed, key: str = "row_id") -> str:
    return f"md5(concat_ws('|', '{seed}', {key}))"


def uniform(text: str) -> str:
    return f"(('0x' || substr({text}, 1, 8))::BIGINT)::DOUBLE"


def ranked(seed, by: str = "PARTITION BY y", source: str = "pop") -> str:
    return f"ranked AS (SELECT *, row_number() OVER ({by} ORDER BY {hashed(seed)}, row_id) AS rank, count(*) OVER ({by}) AS n FROM {source})"


def bin_of(v: str, edges: list[float] = EDGES) -> str:
    inner = " + ".join(f"CAST({v} >= {e} AS INTEGER)" for e in edges)
    return f"greatest(0, least({len(edges) - 2}, {inner} - 1))"


STD = """s AS (SELECT avg(z1) AS m1, stddev_pop(z1) AS s1, avg(z2) AS m2, stddev_pop(z2) AS s2 FROM pop WHERE y = 0),
std AS (SELECT row_id, y, x1, x2, w, (z1 - m1) / s1 AS z1, (z2 - m2) / s2 AS z2 FROM pop, s)"""
GRID = """grid AS (SELECT CAST(l_partkey % 8 AS INTEGER) AS b, CAST(l_suppkey % 8 AS INTEGER) AS s, l_extendedprice / 1000 AS v, 1 + l_discount AS w,
  least(4, CAST(floor(l_quantity / 10) AS INTEGER)) AS bin FROM lineitem)"""
SPECTRA = "spectra AS (SELECT b, s, bin, sum(w) / sum(sum(w)) OVER (PARTITION BY b, s) AS f FROM grid GROUP BY b, s, bin)"
ARMS = "arms AS (SELECT event_type AS arm, user_id AS seed, avg(value) AS value FROM events GROUP BY ALL)"
DAILY = "daily AS (SELECT event_type, CAST(ts AS DATE) AS day, {} AS v FROM events GROUP BY ALL)"
IBU = f"""prior AS (SELECT {bin_of('z1')} AS b, count(*)::DOUBLE AS c FROM pop WHERE y = 0 GROUP BY 1),
data AS (SELECT {bin_of('x1')} AS b, count(*)::DOUBLE AS c FROM pop WHERE y = 1 GROUP BY 1),
tr AS (SELECT {bin_of('z1')} AS t, {bin_of('x1')} AS r, count(*) AS n FROM pop WHERE y = 0 GROUP BY ALL),
resp AS (SELECT t, r, n / sum(n) OVER (PARTITION BY t) AS p FROM tr),
u0 AS (SELECT b, c FROM prior)"""
for _k in range(3):
    IBU += f""",
m{_k} AS (SELECT r, sum(p * c) AS m FROM resp JOIN u{_k} ON t = b GROUP BY r),
q{_k} AS (SELECT t, sum(CASE WHEN m > 0 THEN p * d.c / m ELSE 0 END) AS q FROM resp JOIN m{_k} USING (r) JOIN data d ON d.b = r GROUP BY t),
u{_k + 1} AS (SELECT b, c * q AS c FROM u{_k} JOIN q{_k} ON t = b)"""
SAMPLES = f"""{ranked(23)}, a AS (SELECT x1, x2 FROM ranked WHERE y = 1 AND rank <= 16384), b AS (SELECT row_id, x1, x2, w FROM ranked WHERE y = 0 AND rank <= 16384)"""


def kernel(d2: str, bandwidth: float) -> str:
    return " + ".join(f"exp(-({d2}) / (2 * {(bandwidth * f) ** 2!r}))" for f in (0.5, 2**-0.5, 1.0, 2**0.5, 2.0))


def with_pop(rest: str) -> str:
    return f"WITH {POP}{rest}"


def d2(p: str, q: str) -> str:
    return f"({p}.x1 - {q}.x1) * ({p}.x1 - {q}.x1) + ({p}.x2 - {q}.x2) * ({p}.x2 - {q}.x2)"


VIEWS = """views AS (SELECT 'quantity' AS variable, b, s, bin, w FROM grid UNION ALL SELECT 'price', b, s, CAST(least(4, floor(v / 20)) AS INTEGER), w FROM grid),
spectra AS (SELECT variable, b, s, bin, sum(w) / sum(sum(w)) OVER (PARTITION BY variable, b, s) AS f FROM views GROUP BY variable, b, s, bin),
g AS (SELECT variable, bin, avg(f) AS g FROM spectra GROUP BY ALL), r AS (SELECT variable, bin, b, avg(f) AS rm FROM spectra GROUP BY ALL), k AS (SELECT variable, bin, s, avg(f) AS cm FROM spectra GROUP BY ALL),
x AS (SELECT variable, b, s, bin, f - rm - cm + g AS x FROM spectra JOIN r USING (variable, bin, b) JOIN k USING (variable, bin, s) JOIN g USING (variable, bin)),
e AS (SELECT variable, p.bin AS bin_a, q.bin AS bin_b, sum(p.x * q.x) / 49 AS e FROM x p JOIN x q USING (variable, b, s) GROUP BY ALL),
rd AS (SELECT variable, bin, b, rm - g AS x FROM r JOIN g USING (variable, bin)), kd AS (SELECT variable, bin, s, cm - g AS x FROM k JOIN g USING (variable, bin)),
d AS (SELECT variable, p.bin AS bin_a, q.bin AS bin_b, sum(p.x * q.x) / 7 AS d FROM rd p JOIN rd q USING (variable, b) GROUP BY ALL),
i AS (SELECT variable, p.bin AS bin_a, q.bin AS bin_b, sum(p.x * q.x) / 7 AS i FROM kd p JOIN kd q USING (variable, s) GROUP BY ALL),
cov AS (SELECT variable, bin_a, bin_b, d - e / 8 AS data, i - e / 8 AS initialization, e AS interaction, d - e / 8 + i - e / 8 + e AS total FROM e JOIN d USING (variable, bin_a, bin_b) JOIN i USING (variable, bin_a, bin_b))"""

SIGMOID = "1 / (1 + exp(-({})))"
COSINES = ", ".join(f"({k}, {a!r}, {b!r})" for k, (a, b) in enumerate(random_directions(128, 2)))
CHARGES = 0x5228849

def _level(name: str, factor: str) -> str:
    f, pt = f"({factor})", f"(l_extendedprice * ({factor}))"
    charge = "(((CHARGES >> CAST(2 * (l_partkey % 16) AS BIGINT)) & 3) - 1)".replace("CHARGES", str(CHARGES))
    return f"""round(sum(l_quantity * {f}), 6) AS {name}_mass, count(*)::DOUBLE AS {name}_mult, round(avg(sqrt(l_discount * {f})), 6) AS {name}_w,
  round(CASE WHEN avg(sqrt(l_discount * {f})) > 0 THEN avg(sqrt(l_tax * {f})) / avg(sqrt(l_discount * {f})) ELSE 0 END, 6) AS {name}_tau21, round(min(sqrt(l_discount * {f})), 6) AS {name}_zg,
  round(2 * ln(max(l_quantity * {f}) / sum({pt})), 6) AS {name}_sdm, round(sum({charge} * sqrt({pt})) / sum(sqrt({pt})), 6) AS {name}_q, round(sum(abs({charge}) * {pt}) / sum({pt}), 6) AS {name}_f_ch,
  round(max(sqrt(l_tax * {f})), 6) AS {name}_lha, round(sum(l_discount * sqrt(l_discount * {f})), 6) AS {name}_ang2, round(sqrt(sum({pt} * {pt})) / sum({pt}), 6) AS {name}_ptd,
  (count(*) FILTER ({charge} <> 0 AND {pt} > 0))::DOUBLE AS {name}_n_ch"""


ORACLE_SQL = {
    "jet_shard": f"SELECT l_orderkey, {_level('gen', '1.0')}, {_level('sim', '(1 - l_discount) * (1 + l_tax)')} FROM lineitem GROUP BY l_orderkey",
    "leakage_check": "SELECT 0.0::DOUBLE AS largest_difference",
    "summary_spectra": f"""WITH {GRID}, {VIEWS} SELECT variable, bin, round(g, 6) AS f, round(sqrt(greatest(data, 0)), 6) AS sd_data, round(sqrt(greatest(initialization, 0)), 6) AS sd_initialization,
round(sqrt(greatest(interaction, 0)), 6) AS sd_interaction, round(sqrt(greatest(total, 0)), 6) AS sd_total FROM g JOIN cov USING (variable) WHERE bin = bin_a AND bin_a = bin_b""",
    "summary_covariances": f"""WITH {GRID}, {VIEWS} SELECT variable, bin_a, bin_b, round(1e3 * data, 6) AS data, round(1e3 * initialization, 6) AS initialization,
round(1e3 * interaction, 6) AS interaction, round(1e3 * total, 6) AS total FROM cov""",
    "summary_correlations": f"""WITH {GRID}, {VIEWS}, v AS (SELECT variable, bin_a AS bin, interaction AS v FROM cov WHERE bin_a = bin_b)
SELECT variable, bin_a, bin_b, round(interaction / sqrt(a.v * c.v), 4) AS interaction FROM cov JOIN v a USING (variable) JOIN v c USING (variable) WHERE a.bin = bin_a AND c.bin = bin_b""",
    "w1_per_dim": with_pop(f", {long('1.0')}, {w1('long')} SELECT dim, round(w1, 6) AS w1 FROM w"),
    "w1_weighted": with_pop(f", {long()}, {w1('long')} SELECT dim, round(w1, 6) AS w1 FROM w"),
    "improvement_pct": with_pop(
        f", {long('1.0')}, {w1('long', name='before', out='p')}, {long().replace('long AS', 'long2 AS')}, {w1('long2', name='after', out='q')} "
        "SELECT dim, round(before, 6) AS before, round(after, 6) AS after, round(CASE WHEN before > 0 THEN (1 - after / before) * 100 ELSE 0 END, 6) AS improvement FROM p JOIN q USING (dim)"
    ),
    "hist_normalized": with_pop(f", {long()}, {HIST} SELECT dim, bin, round(p, 6) AS p, round(q, 6) AS q FROM h"),
    "js_divergence": with_pop(f", {long()}, {HIST} SELECT dim, round(js, 6) AS js FROM js"),
    "triangular": with_pop(f", {long()}, {HIST} SELECT dim, round(triangular, 6) AS triangular FROM js"),
    "metric_set_long": with_pop(f", {long()}, {HIST}, {w1('long')}, o AS ({METRICS}) SELECT dim, metric, round(value, 6) AS value FROM o"),
    "metric_comparison": f"""WITH {POP}, one AS (WITH {long('1.0')}, {HIST}, {w1('long')} {METRICS}), two AS (WITH {long()}, {HIST}, {w1('long')} {METRICS})
SELECT dim, metric, round(one.value, 6) AS before, round(two.value, 6) AS after, round(CASE WHEN one.value > 0 THEN (1 - two.value / one.value) * 100 ELSE 0 END, 6) AS improvement
FROM one JOIN two USING (dim, metric)""",
    "sliced_w1": with_pop(
        f""", n AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM pop WHERE y = 1),
u AS (SELECT y, w, (x1 - m1) / s1 AS u1, (x2 - m2) / s2 AS u2 FROM pop, n), d(dim, c, s) AS (VALUES {COSINES}),
long AS (SELECT dim, y, w, round(0.0 + u1 * c + u2 * s, 9) AS v FROM u, d), {w1('long')} SELECT round(avg(w1), 6) AS sliced_w1 FROM w"""
    ),
    "axis_w1": with_pop(
        f""", n AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM pop WHERE y = 1),
long AS (SELECT 1 AS dim, y, w, (x1 - m1) / s1 AS v FROM pop, n UNION ALL SELECT 2, y, w, (x2 - m2) / s2 FROM pop, n), {w1('long')} SELECT round(avg(w1), 6) AS axis_w1 FROM w"""
    ),
    "ess": with_pop(" SELECT y, round(pow(sum(w), 2) / sum(w * w), 6) AS ess FROM pop GROUP BY y"),
    "weight_dispersion": with_pop(
        " SELECT round(pow(sum(w), 2) / sum(w * w), 6) AS ess, round(pow(sum(w), 2) / sum(w * w) / count(*), 6) AS share, round(var_pop(w) / pow(avg(w), 2), 6) AS dispersion FROM pop WHERE y = 0"
    ),
    "generator_weights": with_pop(""",
u AS (SELECT row_id, (z1 - 25) / 15 AS a, (z2 - 50) / 30 AS b FROM pop WHERE y = 0),
o AS (SELECT row_id, 0.5 + 0.3 * greatest(0, 0.5 * a - 0.75 * b + 0.1) - 0.2 * greatest(0, -0.25 * a + 0.5 * b + 0.2) + 0.4 * greatest(0, 0.125 * a + 0.25 * b - 0.1) AS o FROM u),
g AS (SELECT row_id, greatest(o, 0) + ln(1 + exp(-abs(o))) AS g FROM o) SELECT row_id, round(g / avg(g) OVER (), 6) AS w FROM g"""),
    "normalize_mean_one": with_pop(" SELECT row_id, round(w / avg(w) OVER (), 6) AS w FROM pop WHERE y = 0"),
    "normalize_class_preserving": with_pop(
        ", t AS (SELECT count(*) AS n, sum(w) AS s FROM pop WHERE y = 0) SELECT row_id, round(CASE WHEN y = 0 THEN w * n / (s + 1e-7) ELSE 1 END, 6) AS w FROM pop, t"
    ),
    "normalize_sum_to_one": with_pop(" SELECT row_id, round(w / sum(w) OVER (), 12) AS w FROM pop WHERE y = 0"),
    "normalize_count_preserving": with_pop(" SELECT row_id, round(w * count(*) OVER () / sum(w) OVER (), 6) AS w FROM pop WHERE y = 0"),
    "likelihood_ratio_weights": with_pop(
        f", q AS (SELECT row_id, greatest(1e-7, least(1 - 1e-7, {SIGMOID.format('(x1 - 25) / 5')})) AS q FROM pop WHERE y = 0) SELECT row_id, round(q / (1 - q), 6) AS w FROM q"
    ),
    "bce_weighted": with_pop(
        f", q AS (SELECT y, w, {SIGMOID.format('(x1 - 25) / 10')} AS d FROM pop) SELECT round(-sum(w * (y * ln(d + 1e-7) + (1 - y) * ln(1 - d + 1e-7))) / count(*), 6) AS loss, count(*) AS rows FROM q"
    ),
    "critic_gap": with_pop(
        ", q AS (SELECT y, w, x1 / 10 + x2 / 100 AS f FROM pop) SELECT round(avg(f) FILTER (y = 1) - sum(w * f) FILTER (y = 0) / sum(w) FILTER (y = 0), 6) AS gap FROM q"
    ),
    "gradient_penalty": with_pop(" SELECT round(avg(pow(greatest(0, sqrt(pow(x1 / 25, 2) + pow(x2 / 50, 2)) - 1), 2)), 6) AS penalty FROM pop"),
    "variance_split": with_pop(
        """, q AS (SELECT w, avg(w) OVER (PARTITION BY floor(x1 / 5)) AS h FROM pop WHERE y = 0), r AS (SELECT var_pop(w) AS t, var_pop(h) AS v, avg(pow(w - h, 2)) AS e FROM q)
SELECT round(t, 6) AS total, round(v, 6) AS visible, round(e, 6) AS residual, round(t - v - e, 6) + 0.0 AS closure FROM r"""
    ),
    "standardize": with_pop(f", {STD} SELECT row_id, round(z1, 6) AS z1, round(z2, 6) AS z2 FROM std"),
    "population_counts": with_pop(" SELECT y, count(*) AS n, round(min(z1), 6) AS z1_min, round(max(z2), 6) AS z2_max FROM pop GROUP BY y"),
    "interleave_partition": with_pop(" SELECT row_id, y, round(x1, 6) AS x1 FROM pop"),
    "truth_guard": with_pop(" SELECT y, count(CASE WHEN y = 0 THEN z1 END) AS known, count(*) AS n FROM pop GROUP BY y"),
    "hash_split": with_pop(
        f""", {ranked(42)}, c AS (SELECT *, floor(n * 0.2) AS t FROM ranked)
SELECT row_id, y, CASE WHEN rank > n - t THEN 'test' WHEN rank > n - t - floor((n - t) * (0.1 / 0.8)) THEN 'validation' ELSE 'train' END AS split FROM c"""
    ),
    "hash_split_disjoint": with_pop(
        f""", {ranked(42)}, c AS (SELECT *, floor(n * 0.2) AS t FROM ranked), d AS (
SELECT row_id, y, CASE WHEN rank > n - t THEN 'test' WHEN rank > n - t - floor((n - t) * (0.1 / 0.8)) THEN 'validation' ELSE 'train' END AS split FROM c)
SELECT y, split, count(*) AS n, count(DISTINCT row_id) AS ids FROM d GROUP BY ALL"""
    ),
    "subsample_top_m": with_pop(f", {ranked(7)} SELECT row_id, y, rank FROM ranked WHERE rank <= 500"),
    "balanced_classes": with_pop(f", {ranked(3)} SELECT row_id, y FROM ranked WHERE rank <= (SELECT min(n) FROM ranked)"),
    "reserve_eval": with_pop(f", mc AS (SELECT * FROM pop WHERE y = 0), {ranked(5, '', 'mc')} SELECT row_id, CAST(rank <= 200 AS INTEGER) AS reserved FROM ranked"),
    "disjoint_null_halves": with_pop(f", mc AS (SELECT * FROM pop WHERE y = 0), {ranked(11, '', 'mc')} SELECT row_id, CAST(rank > 300 AS INTEGER) AS half FROM ranked WHERE rank <= 600"),
    "bootstrap_multiplicity": with_pop(
        f""", {ranked('13:order')}, d AS (SELECT y, ('0x' || substr(md5(concat_ws('|', '13:draw', y, rank)), 1, 12))::BIGINT % n AS d FROM ranked), c AS (SELECT y, d, count(*) AS c FROM d GROUP BY ALL)
SELECT row_id, r.y, coalesce(c, 0) AS multiplicity FROM ranked r LEFT JOIN c ON c.y = r.y AND c.d = r.rank - 1"""
    ),
    "bootstrap_mean": with_pop(
        f""", {ranked('13:order')}, d AS (SELECT y, ('0x' || substr(md5(concat_ws('|', '13:draw', y, rank)), 1, 12))::BIGINT % n AS d FROM ranked)
SELECT r.y, count(*) AS n, round(avg(x1), 6) AS mean_x1 FROM d JOIN ranked r ON d.y = r.y AND d.d = r.rank - 1 GROUP BY r.y"""
    ),
    "pseudo_domains": with_pop(
        f""", mc AS (SELECT row_id, z2, avg(z2) OVER () AS m, stddev_pop(z2) OVER () AS s FROM pop WHERE y = 0)
SELECT row_id, CAST({uniform(hashed(17))} / 4294967296.0 < {SIGMOID.format('1.5 * ((z2 - m) / s)')} AS INTEGER) AS domain FROM mc"""
    ),
    "jet_features": f"""WITH c AS (SELECT l_orderkey, l_extendedprice AS pt, (({CHARGES} >> (2 * (l_partkey % 16))::INTEGER) & 3) - 1 AS q FROM lineitem)
SELECT l_orderkey, round(sum(q * sqrt(pt)) / sum(sqrt(pt)), 6) + 0.0 AS q, round(sum(abs(q) * pt) / sum(pt), 6) AS f_ch, count(*) FILTER (q <> 0 AND pt > 0) AS n_ch, round(sqrt(sum(pt * pt)) / sum(pt), 6) AS ptd
FROM c GROUP BY l_orderkey""",
    "charge_decode": f"SELECT CAST(l_partkey % 16 AS INTEGER) AS pid, CAST((({CHARGES} >> (2 * (l_partkey % 16))::INTEGER) & 3) - 1 AS INTEGER) AS charge, count(*) AS n FROM lineitem GROUP BY ALL",
    "cubic_response": with_pop(f", {STD} SELECT y, " + ", ".join(f"round(avg(z2 + {s / 10} * z2 * z2 * z2), 6) + 0.0 AS mean_{s}" for s in (0, 1, 5)) + " FROM std GROUP BY y"),
    "gaussian_smearing": with_pop(
        f""", g AS (SELECT y, z1, sqrt(-2 * ln(({uniform(hashed('smear:a'))} + 0.5) / 4294967296.0)) * cos(2 * {math.pi!r} * (({uniform(hashed('smear:b'))} + 0.5) / 4294967296.0)) AS n FROM pop)
SELECT y, round(avg(n), 6) AS mean, round(stddev_pop(z1 + 2 * n), 6) AS sd FROM g GROUP BY y"""
    ),
    "saturated_bins": with_pop(f" SELECT y, {bin_of('x1')} AS bin, count(*) AS n FROM pop GROUP BY ALL"),
    "response_matrix": with_pop(
        f", {IBU} SELECT a.t, b.r, round(coalesce(p, 0), 6) AS p FROM (SELECT unnest(range(5))::INTEGER AS t) a CROSS JOIN (SELECT unnest(range(5))::INTEGER AS r) b LEFT JOIN resp ON resp.t = a.t AND resp.r = b.r"
    ),
    "purity_candidates": with_pop(
        """, mc AS (SELECT z1, x1 FROM pop WHERE y = 0), s AS (SELECT min(z1) AS lo, max(z1) AS hi FROM mc),
k AS (SELECT i::INTEGER AS candidate, lo, lo + 0.01 + (hi - lo - 0.01) / 99 * i AS c FROM s, (SELECT unnest(range(100)) AS i)),
n AS (SELECT candidate, any_value(c) AS c, count(*) FILTER (z1 >= lo AND z1 < c) AS d, count(*) FILTER (z1 >= lo AND z1 < c AND x1 >= lo AND x1 < c) AS n FROM k, mc GROUP BY candidate)
SELECT candidate, round(c, 6) AS c, round(CASE WHEN d > 0 THEN n / d ELSE 0 END, 6) AS purity FROM n"""
    ),
    "ibu_iterations": with_pop(f", {IBU}, o AS (" + " UNION ALL ".join(f"SELECT {k} AS round, b AS bin, c FROM u{k}" for k in range(4)) + ") SELECT round, bin, round(c, 6) AS content FROM o"),
    "ibu_weights": with_pop(
        f""", {IBU}, bw AS (SELECT u3.b, CASE WHEN prior.c > 0 THEN u3.c / prior.c ELSE 0 END AS bw FROM u3 JOIN prior USING (b)), e AS (SELECT row_id, bw FROM pop JOIN bw ON {bin_of('z1')} = b WHERE y = 0)
SELECT row_id, round(bw / avg(bw) OVER (), 6) AS w FROM e"""
    ),
    "joint_product_weights": with_pop(
        """, q AS (SELECT row_id, y, (1 + z1 / 50) * (CASE WHEN z2 < 10 THEN 0.0 ELSE 1.5 END) AS p FROM pop), m AS (SELECT avg(p) AS m FROM q WHERE y = 0)
SELECT row_id, round(CASE WHEN y = 0 THEN p / m ELSE 1 END, 6) AS w FROM q, m"""
    ),
    "median_bandwidth": with_pop(f", {SAMPLES} SELECT round(sqrt(quantile_cont({d2('p', 'q')}, 0.5) / 2), 6) AS bandwidth FROM a p, a q"),
    "mmd2_weighted": with_pop(
        f""", {SAMPLES}, bw AS (SELECT *, w / sum(w) OVER () AS u FROM b), n AS (SELECT count(*) AS n FROM a),
aa AS (SELECT (sum({kernel(d2('p', 'q'), 10.0)}) - 5 * any_value(n)) / (any_value(n) * (any_value(n) - 1)) AS v FROM a p, a q, n),
bb AS (SELECT sum(p.u * q.u * ({kernel(d2('p', 'q'), 10.0)})) - 5 * (SELECT sum(u * u) FROM bw) AS v FROM bw p, bw q),
ab AS (SELECT sum(p.u * ({kernel(d2('p', 'q'), 10.0)})) / (SELECT n FROM n) AS v FROM bw p, a q), s AS (SELECT sum(u * u) AS s FROM bw)
SELECT round(aa.v + bb.v / (1 - s) - 2 * ab.v, 6) AS mmd2, round(1 / s, 6) AS ess, round(aa.v, 6) AS data, round(ab.v, 6) AS cross_term FROM aa, bb, ab, s"""
    ),
    "quantile_edges": with_pop(
        ", q AS (SELECT quantile_cont(z2, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM pop) SELECT CAST(i - 1 AS INTEGER) AS i, round(q[i], 6) AS edge FROM q, (SELECT unnest(range(1, 12)) AS i)"
    ),
    "binned_spectra": f"WITH {GRID}, {SPECTRA} SELECT b, s, bin, round(f, 6) AS f FROM spectra",
    "uncertainty_summary": f"""WITH {GRID}, l AS (SELECT 'price' AS variable, b, s, v, w FROM grid UNION ALL SELECT 'bin', b, s, bin::DOUBLE, w FROM grid),
c AS (SELECT variable, b, s, sum(w * v) / sum(w) AS v FROM l GROUP BY ALL), g AS (SELECT variable, avg(v) AS g FROM c GROUP BY ALL),
r AS (SELECT variable, b, avg(v) AS rm FROM c GROUP BY ALL), k AS (SELECT variable, s, avg(v) AS cm FROM c GROUP BY ALL),
d AS (SELECT variable, 8 * sum(pow(rm - g, 2)) / 7 AS d FROM r JOIN g USING (variable) GROUP BY ALL), i AS (SELECT variable, 8 * sum(pow(cm - g, 2)) / 7 AS i FROM k JOIN g USING (variable) GROUP BY ALL),
e AS (SELECT variable, sum(pow(v - rm - cm + g, 2)) / 49 AS e FROM c JOIN r USING (variable, b) JOIN k USING (variable, s) JOIN g USING (variable) GROUP BY ALL),
a AS (SELECT variable, g, (d - e) / 8 AS data, (i - e) / 8 AS initialization, e FROM g JOIN d USING (variable) JOIN i USING (variable) JOIN e USING (variable)),
t AS (SELECT *, data + initialization + e AS total, data + initialization + 2 * e AS naive FROM a)
SELECT variable, round(g, 6) AS mean, round(data, 6) AS data, round(initialization, 6) AS initialization, round(e, 6) AS interaction, round(total, 6) AS total, round(naive, 6) AS naive,
  round(sqrt(greatest(total, 0)), 6) AS sd_total, round(sqrt(greatest(naive, 0)), 6) AS sd_naive FROM t""",
    "weighted_means": f"WITH {GRID} SELECT b, s, round(sum(w * v) / sum(w), 6) AS mean FROM grid GROUP BY b, s",
    "evaluation_variance": f"""WITH {GRID}, m AS (SELECT b, s, sum(w * v) / sum(w) AS mean, sum(w) AS t FROM grid GROUP BY b, s)
SELECT b, s, round(any_value(mean), 6) AS mean, round(sum(w * w * pow(v - mean, 2)) / pow(any_value(t), 2), 6) AS variance FROM grid JOIN m USING (b, s) GROUP BY b, s""",
    "evaluation_covariance": f"""WITH {GRID}, h AS (SELECT bin, sum(w) AS h, sum(w * w) AS h2 FROM grid GROUP BY bin), t AS (SELECT sum(h) AS t, sum(h2) AS w2 FROM h)
SELECT a.bin AS bin_a, b.bin AS bin_b, round(1e6 * ((CASE WHEN a.bin = b.bin THEN a.h2 ELSE 0 END) - a.h / t * b.h2 - a.h2 * b.h / t + a.h / t * b.h / t * w2) / (t * t), 6) AS cov FROM h a, h b, t""",
    "spectra_covariance": f"WITH {GRID}, {SPECTRA} SELECT x.bin AS bin_a, y.bin AS bin_b, round(1e3 * covar_samp(x.f, y.f), 6) AS cov FROM spectra x JOIN spectra y USING (b, s) GROUP BY ALL",
    "correlation_guarded": f"""WITH {GRID}, {SPECTRA}, c AS (SELECT x.bin AS bin_a, y.bin AS bin_b, covar_samp(x.f, y.f) AS cov FROM spectra x JOIN spectra y USING (b, s) GROUP BY ALL)
SELECT c.bin_a, c.bin_b, round(CASE WHEN a.cov > 0 AND b.cov > 0 THEN c.cov / sqrt(a.cov * b.cov) ELSE 'nan'::DOUBLE END, 6) AS corr
FROM c JOIN c a ON a.bin_a = c.bin_a AND a.bin_b = c.bin_a JOIN c b ON b.bin_a = c.bin_b AND b.bin_b = c.bin_b""",
    "anova_components": f"""WITH {GRID}, c AS (SELECT b, s, sum(w * v) / sum(w) AS v FROM grid GROUP BY b, s), g AS (SELECT avg(v) AS g FROM c),
r AS (SELECT b, avg(v) AS rm FROM c GROUP BY b), k AS (SELECT s, avg(v) AS cm FROM c GROUP BY s),
d AS (SELECT 8 * sum(pow(rm - g, 2)) / 7 AS d FROM r, g), i AS (SELECT 8 * sum(pow(cm - g, 2)) / 7 AS i FROM k, g),
e AS (SELECT sum(pow(v - rm - cm + g, 2)) / 49 AS e FROM c JOIN r USING (b) JOIN k USING (s), g)
SELECT round((d - e) / 8, 6) AS data, round((i - e) / 8, 6) AS initialization, round(e, 6) AS interaction, round((d - e) / 8 + (i - e) / 8 + e, 6) AS total, round((d - e) / 8 + (i - e) / 8 + 2 * e, 6) AS naive FROM d, i, e""",
    "component_covariance": f"""WITH {GRID}, {SPECTRA}, g AS (SELECT bin, avg(f) AS g FROM spectra GROUP BY bin), r AS (SELECT bin, b, avg(f) AS rm FROM spectra GROUP BY ALL), k AS (SELECT bin, s, avg(f) AS cm FROM spectra GROUP BY ALL),
x AS (SELECT b, s, bin, f - rm - cm + g AS x FROM spectra JOIN r USING (bin, b) JOIN k USING (bin, s) JOIN g USING (bin)),
e AS (SELECT p.bin AS bin_a, q.bin AS bin_b, sum(p.x * q.x) / 49 AS e FROM x p JOIN x q USING (b, s) GROUP BY ALL),
rd AS (SELECT bin, b, rm - g AS x FROM r JOIN g USING (bin)), kd AS (SELECT bin, s, cm - g AS x FROM k JOIN g USING (bin)),
d AS (SELECT p.bin AS bin_a, q.bin AS bin_b, sum(p.x * q.x) / 7 AS d FROM rd p JOIN rd q USING (b) GROUP BY ALL),
i AS (SELECT p.bin AS bin_a, q.bin AS bin_b, sum(p.x * q.x) / 7 AS i FROM kd p JOIN kd q USING (s) GROUP BY ALL)
SELECT bin_a, bin_b, round(1e3 * (d - e / 8), 6) AS data, round(1e3 * (i - e / 8), 6) AS initialization, round(1e3 * e, 6) AS interaction FROM e JOIN d USING (bin_a, bin_b) JOIN i USING (bin_a, bin_b)""",
    "arm_summary": f"WITH {ARMS} SELECT arm, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / sqrt(count(*)), 6) AS se FROM arms GROUP BY arm",
    "paired_delta": f"""WITH {ARMS}, d AS (SELECT a.arm, a.value - b.value AS d FROM arms a JOIN arms b ON a.seed = b.seed AND b.arm = 'click' WHERE a.arm <> 'click')
SELECT arm, count(*) AS n, round(avg(d), 6) AS delta, round(stddev_samp(d) / sqrt(count(*)), 6) AS se, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM d GROUP BY arm HAVING count(*) >= 2""",
    "observable_means": "WITH o AS (SELECT user_id AS arm, event_type, avg(value) AS v FROM events WHERE user_id IS NOT NULL GROUP BY ALL) SELECT arm, round(avg(v), 6) AS value FROM o GROUP BY arm",
    "tied_epoch_sets": """WITH d AS (SELECT event_type AS run, CAST(ts AS DATE) AS epoch, avg(value) AS v FROM events GROUP BY ALL)
SELECT run, epoch, round(v, 6) AS val_mmd FROM (SELECT *, min(v) OVER (PARTITION BY run) AS least FROM d) WHERE v <= least + 5.0""",
    "signed_rank_test": """WITH d AS (SELECT round(round(l_quantity + 0.0, 1) - round(l_extendedprice / 1500, 1), 12) AS d FROM lineitem), s AS (SELECT abs(d) AS size, count(*) AS t, count(*) FILTER (d > 0) AS plus FROM d WHERE d <> 0 GROUP BY 1),
r AS (SELECT *, coalesce(sum(t) OVER (ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS rank FROM s),
w AS (SELECT CAST(sum(t) AS BIGINT) AS n, sum(rank * plus) AS p, sum(rank * (t - plus)) AS m, sum(pow(t::DOUBLE, 3) - t) AS ties FROM r)
SELECT n, round(p, 3)::DOUBLE AS w_plus, round(m, 3)::DOUBLE AS w_minus, round((p - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n::DOUBLE + 1) / 24 - ties / 48), 3) AS z FROM w""",
    "first_moment_transfer": with_pop(""", m AS (SELECT avg(z1) FILTER (y = 1) AS o, avg(z1) FILTER (y = 0) AS s, sum(z1 * w) FILTER (y = 0) / sum(w) FILTER (y = 0) AS w FROM pop)
SELECT round(o, 6) AS observed, round(s, 6) AS simulated, round(w, 6) AS weighted, round(100 * (w - s) / (o - s), 6) AS closed FROM m"""),
    "mean_epoch_weights": """WITH h AS (SELECT year(l_shipdate) AS epoch, CAST(l_suppkey AS VARCHAR) AS row_id, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY ALL)
SELECT row_id, round(avg(w / m), 6) AS w FROM (SELECT *, avg(w) OVER (PARTITION BY epoch) AS m FROM h) GROUP BY row_id""",
    "tied_to_best": "WITH a AS (SELECT user_id AS arm, avg(value) / 1e6 AS v FROM events GROUP BY 1) SELECT arm, CAST(abs(v - min(v) OVER ()) <= 2 * 1.159e-4 AS INTEGER) AS tied FROM a",
    "best_method_ties": """WITH s AS (SELECT l_suppkey AS variable, l_returnflag AS method, round(avg(l_quantity), 1) AS after FROM lineitem GROUP BY ALL),
w AS (SELECT *, min(after) OVER (PARTITION BY variable) AS l, count(*) OVER (PARTITION BY variable) AS n FROM s) SELECT variable, method, after FROM w WHERE n >= 2 AND after - l <= 1e-12 + 1e-7 * abs(l)""",
    "missing_cells": """WITH f AS (SELECT min(user_id) AS u, min(CAST(ts AS DATE)) AS d, max(user_id) - min(user_id) + 1 AS nb, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS ns FROM events),
have AS (SELECT DISTINCT user_id - u AS b, date_diff('day', d, CAST(ts AS DATE)) AS s FROM events, f), grid AS (SELECT unnest(range(CAST(nb * ns AS BIGINT))) AS i, ns FROM f)
SELECT i AS cell, CAST(i // ns AS INTEGER) AS b, CAST(i % ns AS INTEGER) AS s FROM grid WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.b = i // ns AND have.s = i % ns)""",
    "stream_histogram": """SELECT event_type, CAST(greatest(0, least(9, floor(value / 100.0 * 10))) AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY ALL""",
    "phase_upsert": "SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 2 ELSE o_totalprice END, 6) AS seconds FROM orders",
    "rolling_median5": f"""WITH {DAILY.format('avg(value)')}, n AS (SELECT event_type, day, v, first_value(v) OVER w AS f, last_value(v) OVER w AS l, lag(v, 1) OVER o AS a1, lag(v, 2) OVER o AS a2, lead(v, 1) OVER o AS b1, lead(v, 2) OVER o AS b2
FROM daily WINDOW o AS (PARTITION BY event_type ORDER BY day), w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_type, day, round(v, 6) AS v, round(list_sort([v, coalesce(a1, f), coalesce(a2, f), coalesce(b1, l), coalesce(b2, l)])[3], 6) AS smooth FROM n""",
    "ess_percent": f"WITH {DAILY.format('sum(value)')} SELECT event_type, day, round(100 * v / first_value(v) OVER (PARTITION BY event_type ORDER BY day), 6) AS percent FROM daily",
    "floor_estimates": """SELECT l_returnflag AS g, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS sd, round(stddev_samp(l_extendedprice) / sqrt(count(*)), 6) AS se,
round(stddev_samp(l_extendedprice) / sqrt(2 * (count(*) - 1)), 6) AS sd_error FROM lineitem GROUP BY 1""",
    "log_log_slope": "WITH f AS (SELECT l_quantity AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1) SELECT round(regr_slope(ln(sd), ln(m)), 6) AS slope FROM f WHERE sd > 0",
    "varying_config_keys": """WITH e AS (SELECT l_orderkey AS run, 'flag' AS key, l_returnflag AS value FROM lineitem UNION ALL SELECT l_orderkey, 'status', l_linestatus FROM lineitem)
SELECT key FROM e GROUP BY key HAVING count(DISTINCT value) > 1 OR count(DISTINCT run) < (SELECT count(DISTINCT run) FROM e)""",
    "tilt_moments": with_pop(
        f", {STD}, o AS ("
        + " UNION ALL ".join(f"SELECT '{n}' AS statistic, sum(w * ({c})) / sum(w) AS m FROM std WHERE y = 0" for n, c in (("z1", "z1"), ("z2", "z2"), ("z1_z1", "z1 * z1"), ("z1_z2", "z1 * z2"), ("z2_z2", "z2 * z2")))
        + ") SELECT statistic, round(m, 6) + 0.0 AS mean FROM o"
    ),
    "response_delta": with_pop(
        f""", q AS (SELECT y, greatest(1e-7, least(1 - 1e-7, {SIGMOID.format('(z1 - 25) / 40')})) AS p, greatest(1e-7, least(1 - 1e-7, {SIGMOID.format('(z1 - 25) / 40 + (x2 - 50) / 400')})) AS q FROM pop),
d AS (SELECT y, -(y * ln(p) + (1 - y) * ln(1 - p)) + (y * ln(q) + (1 - y) * ln(1 - q)) AS d FROM q), c AS (SELECT avg(d) AS m, var_samp(d) AS v, count(*) AS n FROM d GROUP BY y)
SELECT round(avg(m), 6) AS nats, round(avg(m) / ln(2), 6) AS bits, round(sqrt(sum(v / n)) / 2, 6) AS se FROM c"""
    ),
    "window_histogram": """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, greatest(0, least(9, CAST(floor(value / 100 * 10) AS INTEGER))) AS bin, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""",
    "sweep_response": with_pop(
        f""", {STD}, k AS (SELECT i / 24 AS s FROM (SELECT unnest(range(25)) AS i)), long AS (SELECT s, y, 1.0 AS w, z2 + s * z2 * z2 * z2 AS v FROM std, k), {w1('long', 's')}
SELECT round(s, 6) AS s, round(w1, 6) AS w1 FROM w"""
    ),
    "config_hash": """SELECT c_custkey, substr(sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}'), 1, 16) AS hash FROM customer""",
    "hash_order": f"WITH c AS (SELECT c_custkey::VARCHAR AS row_id FROM customer), {ranked(99, '', 'c')} SELECT row_id, rank FROM ranked",
}
