"""The catalogue's queries as plain SQL over the same tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def expr(value: str = "greatest(embedding[g]::DOUBLE, 0.0)", module: str = "'all'", name: str = "expr") -> str:
    return f"""{name} AS (
  SELECT {module} AS module, vec_id AS cell_id, (g - 1)::INT AS gene, {value} AS value
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS g FROM embeddings))"""


RAW = "embedding[g]::DOUBLE"
RELU = expr()
LABEL = "'L' || label"


def bounds(source: str = "expr", name: str = "nbr") -> str:
    return f"""{name}_p AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY module, gene ORDER BY value, cell_id) - 1 AS p,
    rank() OVER (PARTITION BY module, gene ORDER BY value) - 1 AS t0,
    count(*) OVER (PARTITION BY module, gene, value) AS ts, count(*) OVER (PARTITION BY module, gene) AS n,
    sum(CASE WHEN value <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY module, gene) AS m FROM {source}),
{name}_w AS (SELECT *, floor(0.1::DOUBLE * n)::BIGINT AS w FROM {name}_p),
{name}_a AS (SELECT *,
    CASE WHEN ts > w THEN t0 ELSE greatest(CASE WHEN m > w AND m < n THEN m ELSE 0 END, t0 - w) END AS lo_at,
    CASE WHEN ts > w THEN t0 + ts - 1 ELSE least(n - 1, t0 + ts - 1 + w) END AS hi_at FROM {name}_w),
{name} AS MATERIALIZED (SELECT a.module, a.cell_id, a.gene, a.value, a.t0, a.ts, a.n, l.value AS lo, h.value AS hi FROM {name}_a a
  JOIN {name}_p l ON l.module = a.module AND l.gene = a.gene AND l.p = a.lo_at
  JOIN {name}_p h ON h.module = a.module AND h.gene = a.gene AND h.p = a.hi_at)"""


MEMBERS = """mem AS MATERIALIZED (SELECT k.cell_id AS k, k.gene, c.cell_id AS c FROM nbr k
  JOIN expr c ON c.module = k.module AND c.gene = k.gene AND c.value BETWEEN k.lo AND k.hi)"""
SINGLES = "one AS MATERIALIZED (SELECT k, gene, count(*) AS c FROM mem GROUP BY ALL)"
# All pairs of genes per cell with single and joint counts.
PAIRS = """both_in AS MATERIALIZED (SELECT x.k, x.gene AS a, y.gene AS b, count(*) AS c_ab FROM mem x
  JOIN mem y ON y.k = x.k AND y.c = x.c AND y.gene > x.gene GROUP BY ALL),
gene AS (SELECT DISTINCT gene FROM expr), cell AS (SELECT DISTINCT cell_id FROM expr),
pair AS MATERIALIZED (SELECT cell.cell_id AS k, g.gene AS a, h.gene AS b, coalesce(p.c, 0) AS c_a, coalesce(q.c, 0) AS c_b,
    coalesce(t.c_ab, 0) AS c_ab, (SELECT count(*) FROM cell) AS n
  FROM cell CROSS JOIN gene g JOIN gene h ON h.gene > g.gene
  LEFT JOIN one p ON p.k = cell.cell_id AND p.gene = g.gene
  LEFT JOIN one q ON q.k = cell.cell_id AND q.gene = h.gene
  LEFT JOIN both_in t ON t.k = cell.cell_id AND t.a = g.gene AND t.b = h.gene)"""
COUNTED = f"{RELU},\n{bounds()},\n{MEMBERS},\n{SINGLES},\n{PAIRS}"
CRITICAL = "2.5758293035489004"


def z(n: str, x: str, y: str, xy: str) -> str:
    n, x, y, xy = (f"({c})::DOUBLE" for c in (n, x, y, xy))
    rho = f"(({n} * {xy} - {x} * {y}) / ({n} * {n}))"
    sigma = f"sqrt(greatest({x} * {y} * ({n} - {x}) * ({n} - {y}), 1e-10) / ({n} * {n} * {n} * {n} * ({n} - 1.0) + 1e-10))"
    return f"(CASE WHEN {sigma} > 1e-10 THEN {rho} / {sigma} ELSE 0.0 END)"


Z0 = z("n", "c_a", "c_b", "c_ab")
EDGES0 = f"edge0 AS MATERIALIZED (SELECT k, a, b FROM pair WHERE NOT (abs({Z0}) < {CRITICAL}))"
Z1 = z("c_z", "c_xz", "c_yz", "c_xyz")
TESTS1 = f"""near AS MATERIALIZED (SELECT k, a AS node, b AS other FROM edge0 UNION ALL SELECT k, b, a FROM edge0),
test AS MATERIALIZED (SELECT e.k, e.a, e.b, n.other AS given, 0 AS pool FROM edge0 e JOIN near n ON n.k = e.k AND n.node = e.a AND n.other <> e.b
  UNION ALL SELECT e.k, e.a, e.b, n.other, 1 FROM edge0 e JOIN near n ON n.k = e.k AND n.node = e.b AND n.other <> e.a),
triple AS MATERIALIZED (SELECT t.k, t.a, t.b, t.given, count(*) AS c_z, count(x.c) AS c_xz, count(y.c) AS c_yz,
    count(*) FILTER (x.c IS NOT NULL AND y.c IS NOT NULL) AS c_xyz
  FROM (SELECT DISTINCT k, a, b, given FROM test) t JOIN mem z ON z.k = t.k AND z.gene = t.given
  LEFT JOIN mem x ON x.k = t.k AND x.gene = t.a AND x.c = z.c
  LEFT JOIN mem y ON y.k = t.k AND y.gene = t.b AND y.c = z.c GROUP BY ALL),
counted AS MATERIALIZED (SELECT t.k, t.a, t.b, t.given, t.pool, c_z, c_xz, c_yz, c_xyz FROM test t JOIN triple USING (k, a, b, given)),
tested AS MATERIALIZED (SELECT *, c_z > 1 AND abs({Z1}) < {CRITICAL} AS separates FROM counted),
sep1 AS MATERIALIZED (SELECT k, a, b, arg_min(given, pool * 1000 + given)::INT AS given FROM tested WHERE separates GROUP BY ALL),
edge1 AS MATERIALIZED (SELECT k, a, b FROM edge0 ANTI JOIN sep1 USING (k, a, b))"""
LEVEL1 = f"{COUNTED},\n{EDGES0},\n{TESTS1}"
ARCS = """arc0 AS MATERIALIZED (SELECT k, a AS src, b AS dst FROM edge1 UNION ALL SELECT k, b, a FROM edge1),
open_triple AS (SELECT l.k, l.src AS c, l.dst AS a, r.dst AS b FROM arc0 l JOIN arc0 r ON r.k = l.k AND r.src = l.src AND r.dst > l.dst
  ANTI JOIN edge1 e ON e.k = l.k AND e.a = l.dst AND e.b = r.dst),
collider AS MATERIALIZED (SELECT t.* FROM open_triple t LEFT JOIN sep1 s ON s.k = t.k AND s.a = t.a AND s.b = t.b WHERE s.given IS NULL OR s.given <> t.c),
gone AS MATERIALIZED (SELECT k, c AS src, a AS dst FROM collider UNION SELECT k, c, b FROM collider),
arc AS MATERIALIZED (SELECT * FROM arc0 ANTI JOIN gone USING (k, src, dst))"""
ORIENTED = f"{LEVEL1},\n{ARCS}"
CORR = """cell_n AS (SELECT gene, avg(value) AS m, sqrt(var_pop(value) * count(*)) AS norm FROM expr GROUP BY gene),
unit AS (SELECT cell_id, e.gene, CASE WHEN norm > 1e-8 THEN (value - m) / norm ELSE 0.0 END AS u FROM expr e JOIN cell_n USING (gene)),
corr AS MATERIALIZED (SELECT x.gene AS i, y.gene AS j, CASE WHEN x.gene = y.gene THEN 1.0 ELSE greatest(-1.0, least(1.0, sum(x.u * y.u))) END AS corr
  FROM unit x JOIN unit y ON y.cell_id = x.cell_id AND y.gene >= x.gene GROUP BY x.gene, y.gene)"""
PRIOR = """weight AS (SELECT i, j, round(abs(corr), 9) AS w FROM corr WHERE i < j),
listed AS (SELECT i AS src, j AS dst, w FROM weight WHERE w > 0 UNION ALL SELECT j, i, w FROM weight WHERE w > 0),
prior AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) AS rank FROM listed) WHERE rank <= 5)"""


def r6(c: str) -> str:
    return f"round({c}, 6) + 0.0"


def add(key: str, select: str, *ctes: str, recursive: bool = False) -> None:
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" if ctes else ""
    ORACLE[key] = head + select


# --- neighbourhoods and counts
RANGE = f"SELECT cell_id, gene, {r6('lo')} AS lo, {r6('hi')} AS hi FROM nbr"
add("nbr_bounds", RANGE, expr(RAW), bounds())
add("nbr_bounds_relu", RANGE, RELU, bounds())
add("nbr_bounds_by_label", RANGE.replace("SELECT ", "SELECT module, ", 1), expr(module=LABEL), bounds())
TIES = """expr AS (SELECT 'all' AS module, row_number() OVER () AS cell_id, g AS gene,
    CASE g WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END AS value
  FROM lineitem, (SELECT unnest([0, 1, 2]) AS g))"""
add("nbr_bounds_ties", "SELECT DISTINCT gene, value, t0 AS tie_start, ts AS tie_size, lo, hi FROM nbr", TIES, bounds())
SIZE = "SELECT n.cell_id, n.gene, coalesce(o.c, 0) AS members FROM nbr n LEFT JOIN one o ON o.k = n.cell_id AND o.gene = n.gene"
add("nbr_size", SIZE, expr(RAW), bounds(), MEMBERS, SINGLES)
CUMULATED = "cum AS MATERIALIZED (SELECT gene, value, sum(count(*)) OVER (PARTITION BY gene ORDER BY value) AS upto FROM expr GROUP BY gene, value)"
add("nbr_size_relu", """SELECT n.cell_id, n.gene, greatest(coalesce(h.upto, 0) - coalesce(l.upto, 0), 0)::BIGINT AS members
FROM nbr n ASOF LEFT JOIN cum h ON h.gene = n.gene AND n.hi >= h.value ASOF LEFT JOIN cum l ON l.gene = n.gene AND n.lo > l.value""", RELU, bounds(), CUMULATED)
add("count_pair", "SELECT k AS cell_id, a, b, c_a, c_b, c_ab FROM pair", COUNTED)
add("count_pair_ties", """SELECT k.a, k.b, k.va, k.vb, k.weight, coalesce(sum(p.weight), 0)::BIGINT AS members FROM point k
JOIN tie x ON x.gene = k.a AND x.value = k.va JOIN tie y ON y.gene = k.b AND y.value = k.vb
LEFT JOIN point p ON p.a = k.a AND p.b = k.b AND p.va BETWEEN x.lo AND x.hi AND p.vb BETWEEN y.lo AND y.hi GROUP BY ALL""",
    TIES, bounds(), "tie AS (SELECT DISTINCT gene, value, lo, hi FROM nbr)",
    """point AS (SELECT 0 AS a, 1 AS b, l_quantity AS va, l_discount AS vb, count(*) AS weight FROM lineitem GROUP BY ALL
  UNION ALL SELECT 0, 2, l_quantity, l_tax, count(*) FROM lineitem GROUP BY ALL
  UNION ALL SELECT 1, 2, l_discount, l_tax, count(*) FROM lineitem GROUP BY ALL)""")
add("count_joint", """SELECT k.cell_id, k.gene, count(c.cell_id) AS members FROM nbr k JOIN raw_nbr r USING (cell_id, gene)
LEFT JOIN (SELECT e.cell_id, e.gene, e.value AS v, raw.value AS w FROM expr e JOIN raw USING (cell_id, gene)) c
  ON c.gene = k.gene AND c.v BETWEEN k.lo AND k.hi AND c.w BETWEEN r.lo AND r.hi GROUP BY ALL""",
    RELU, expr(RAW, name="raw"), bounds(), bounds("raw", "raw_nbr"))
add("ci_level0", f"SELECT k AS cell_id, a, b, {r6(Z0)} AS z, abs({Z0}) < {CRITICAL} AS separates FROM pair", COUNTED)
add("pair_uncond_z", f"""SELECT a, b, sum((abs({Z0}) < {CRITICAL})::INT)::BIGINT AS independent_cells,
  {r6(f'max(abs({Z0}))')} AS strongest_z FROM pair GROUP BY a, b""", COUNTED)
add("pair_uncond_p", f"""SELECT k AS cell_id, a, b, {r6("""CASE WHEN x < 3 THEN
  1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 70), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(x, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))
  WHEN x > 26 THEN 0.0 ELSE exp(-x * x) / sqrt(pi()) / (x + 0.5 / (x + 1 / (x + 1.5 / (x + 2 / (x + 2.5 / (x + 3 / (x + 3.5 / (x + 4 / (x + 4.5 / x)))))))))END""")} AS p
FROM (SELECT k, a, b, abs({Z0}) / sqrt(2.0) AS x FROM pair)""", COUNTED)
add("ci_level1", f"""SELECT k AS cell_id, a, b, given, pool, c_z, c_xz, c_yz, c_xyz,
  CASE WHEN c_z > 1 THEN {r6(Z1)} END AS z, separates FROM tested""", LEVEL1)
add("count_triple", """SELECT DISTINCT cell_id, g[1] AS g0, g[2] AS g1, g[3] AS g2, members FROM (
  SELECT k AS cell_id, list_sort([a, b, given]) AS g, c_xyz AS members FROM triple)""", LEVEL1)
add("skeleton_l0", "SELECT k AS cell_id, a, b FROM edge0", COUNTED, EDGES0)
add("skeleton_l1", "SELECT k AS cell_id, a, b FROM edge1", LEVEL1)
add("sepsets_l1", "SELECT k AS cell_id, a, b, given FROM sep1", LEVEL1)
add("collider_edges", "SELECT k AS cell_id, src, dst FROM arc", ORIENTED)

# --- priors
add("prior_topk", f"SELECT src, dst, rank::INT AS rank, {r6('w')} AS w FROM prior", RELU, CORR, PRIOR)
add("prior_load", f"""SELECT least(l, r) AS a, greatest(l, r) AS b, {r6('max(least(greatest(c / greatest(top, 1.0), 0.0), 1.0))')} AS w
FROM raw WHERE l <> '' AND r <> '' AND l <> r AND c > 0 GROUP BY 1, 2""",
    "raw AS (SELECT trim(p_brand) AS l, 'Brand#' || p_size AS r, p_retailprice - 900.0 AS c, max(p_retailprice - 900.0) OVER () AS top FROM part)")
add("target_prior", f"SELECT src, dst, {r6('max(w)')} AS w FROM best WHERE rank <= 5 GROUP BY src, dst",
    """best AS MATERIALIZED (SELECT p_brand AS src, p_type AS dst, p_size / 50.0::DOUBLE AS w,
  row_number() OVER (PARTITION BY p_type ORDER BY p_size / 50.0::DOUBLE DESC, p_brand) AS rank FROM part WHERE p_size > 0 AND p_brand <> p_type)""")
add("forbidden_pairs", """SELECT g.gene AS a, h.gene AS b FROM (SELECT DISTINCT gene FROM expr) g JOIN (SELECT DISTINCT gene FROM expr) h ON g.gene < h.gene
WHERE NOT EXISTS (SELECT 1 FROM prior p WHERE least(p.src, p.dst) = g.gene AND greatest(p.src, p.dst) = h.gene)""", RELU, CORR, PRIOR)
add("effective_alpha", f"""SELECT a, b, {r6('w')} AS w, {r6('least(greatest(0.01, CASE WHEN w >= 0.01 THEN 0.01 + pow(w, 2.0) * 0.19 ELSE 0.01 END, 0.01 + w / 2 * 0.19), 1.0)')} AS alpha
FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(w) AS w FROM prior GROUP BY 1, 2)""", RELU, CORR, PRIOR)
PROFILE = """profile AS (SELECT cell_id, gene, CASE WHEN value > 0 THEN (rank() OVER w + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0)
  / count(*) OVER (PARTITION BY gene) ELSE 0.0 END AS profile FROM expr WHERE value > 0 WINDOW w AS (PARTITION BY gene ORDER BY value))"""
add("activity_prior", f"""SELECT e.cell_id, p.src, p.dst, {r6('p.w * coalesce(f.profile, 0.0)')} AS w FROM prior p
JOIN expr e ON e.gene = p.src LEFT JOIN profile f ON f.cell_id = e.cell_id AND f.gene = e.gene""", RELU, CORR, PRIOR, PROFILE)
PAIRED = """duet AS (SELECT k, least(src, dst) AS a, greatest(src, dst) AS b, bool_or(src < dst) AS up, bool_or(src > dst) AS down FROM arc GROUP BY 1, 2, 3),
weighed AS (SELECT d.*, coalesce(f.w, 0.0) AS w_up, coalesce(r.w, 0.0) AS w_down FROM duet d
  LEFT JOIN prior f ON f.src = d.a AND f.dst = d.b LEFT JOIN prior r ON r.src = d.b AND r.dst = d.a),
turned AS (SELECT *, CASE WHEN up THEN w_down > w_up ELSE w_up > w_down END AS flipped FROM weighed),
oriented AS (SELECT *, up <> flipped AS goes_up FROM turned)"""
PRIORED = (ORIENTED, CORR, PRIOR, PAIRED)
add("orient_prior", f"""SELECT k AS cell_id, CASE WHEN goes_up THEN a ELSE b END AS src, CASE WHEN goes_up THEN b ELSE a END AS dst,
  {r6('CASE WHEN goes_up THEN w_up ELSE w_down END')} AS satisfied, flipped AS reversed, w_up > 0 AND w_down > 0 AS conflict FROM oriented""", *PRIORED)
add("orient_totals", f"""SELECT 'all' AS module, count(*) FILTER (greatest(w_up, w_down) > 0) AS candidate_edges,
  count(*) FILTER (CASE WHEN goes_up THEN w_up ELSE w_down END > 0) AS oriented_edges,
  {r6('sum(CASE WHEN goes_up THEN w_up ELSE w_down END)')} AS satisfied_weight, {r6('sum(greatest(w_up, w_down))')} AS available_weight,
  count(*) FILTER (flipped) AS reversed_edges, count(*) FILTER (w_up > 0 AND w_down > 0) AS conflict_edges FROM oriented""", *PRIORED)
add("orient_bidir", """SELECT k AS cell_id, a AS src, b AS dst FROM weighed WHERE up AND (NOT down OR w_up >= w_down)
UNION ALL SELECT k, b, a FROM weighed WHERE down AND (NOT up OR w_down >= w_up)""", *PRIORED)

# --- normalisation, selection, ranks
SPARSE = "sparse AS (SELECT l_suppkey AS cell_id, l_partkey AS feature_id, sum(l_quantity) AS count FROM lineitem GROUP BY ALL)"
add("log_norm", f"SELECT cell_id, feature_id, {r6('ln(1 + count * (1e4 / sum(count) OVER (PARTITION BY cell_id)))')} AS value FROM sparse", SPARSE)
EVENTS = ("click", "error", "purchase", "signup", "view")
add("log_norm_dense", "SELECT user_id AS cell_id, " + ", ".join(
    f"round(ln(1 + count(*) FILTER (event_type = '{e}') * (1e4 / count(*))), 6) AS {e}" for e in EVENTS) + " FROM events GROUP BY user_id")
add("count_likeness", f"""SELECT {r6('avg((abs(count - round(count)) <= 1e-8 + 1e-5 * abs(round(count)))::INT)')} AS integer_share, max(count) AS top,
  CASE WHEN avg((abs(count - round(count)) <= 1e-8 + 1e-5 * abs(round(count)))::INT) > 0.95 AND max(count) > 20
    THEN 'counts_to_log1p' ELSE 'already_log_like' END AS mode FROM sparse""", SPARSE)
add("library_size", "SELECT cell_id, sum(count) AS total FROM sparse GROUP BY cell_id", SPARSE)
add("tfidf", f"""SELECT cell_id, feature_id, {r6('(1.0 / len * ln(1 + (SELECT count(DISTINCT cell_id) FROM sparse) / df)) * 1000')} AS weight FROM (
  SELECT *, count(*) OVER (PARTITION BY cell_id)::DOUBLE AS len, count(*) OVER (PARTITION BY feature_id)::DOUBLE AS df FROM sparse)""", SPARSE)
STATS = """facts AS (SELECT feature_id, count(*) FILTER (count > 0) AS detected, sum(count) / n AS mean,
  sum(count * count) / n - (sum(count) / n) * (sum(count) / n) AS variance
  FROM sparse, (SELECT count(DISTINCT cell_id) AS n FROM sparse) GROUP BY feature_id, n)"""
add("feature_stats", f"SELECT feature_id, detected, {r6('mean')} AS mean, {r6('variance')} AS variance FROM facts", SPARSE, STATS)
add("top_var_genes", f"""SELECT feature_id, detected, {r6('variance')} AS variance FROM (SELECT * FROM facts WHERE detected >= 10
  ORDER BY variance DESC, feature_id DESC LIMIT 1000)""", SPARSE, STATS)
add("top_cells", "SELECT cell_id, total FROM (SELECT cell_id, sum(count) AS total FROM sparse GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 50)", SPARSE)
add("variance_windows", """SELECT group_id::INT AS group_id, gene FROM ranked JOIN window_start ON r >= s AND r < s + 6""", RELU,
    "ranked AS (SELECT gene, row_number() OVER (ORDER BY v DESC, gene DESC) - 1 AS r FROM (SELECT gene, round(var_pop(value), 9) AS v FROM expr GROUP BY gene))",
    """window_start AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS group_id FROM (
  SELECT unnest(range(0, 59, 4)) AS s UNION SELECT 58))""")
add("p95_scale", f"""SELECT cell_id, feature_id, {r6('CASE WHEN p95 > 0 THEN least(1.0, greatest(0.0, ln(1 + count) / ln(1 + p95))) ELSE 0.0 END')} AS access
FROM sparse JOIN (SELECT feature_id, quantile_cont(count, 0.95) FILTER (count > 0) AS p95 FROM sparse GROUP BY feature_id) USING (feature_id)""", SPARSE)
add("keep_threshold", f"SELECT l_returnflag, {r6('quantile_cont(l_extendedprice, 0.85)')} AS threshold FROM lineitem GROUP BY l_returnflag")
add("peak_median", f"SELECT gene, {r6('median(value)')} AS median FROM expr GROUP BY gene", expr(RAW))
AVERAGE = "rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0::DOUBLE"
add("avg_rank", f"SELECT cell_id, gene, ({AVERAGE})::DOUBLE AS avg_rank FROM expr", RELU)
add("avg_rank_ties", f"SELECT DISTINCT gene, value, count(*) OVER (PARTITION BY gene, value) AS tie_size, ({AVERAGE})::DOUBLE AS avg_rank FROM expr", TIES)
add("zero_rank", f"SELECT e.cell_id, e.gene, {r6('coalesce(f.profile, 0.0)')} AS profile FROM expr e LEFT JOIN profile f USING (cell_id, gene)", RELU, PROFILE)
SCALED = "1.0 + (row_number() OVER (PARTITION BY gene ORDER BY value, cell_id) - 1) / (count(*) OVER (PARTITION BY gene) - 1)::DOUBLE"
add("ordinal_rank", f"SELECT cell_id, gene, {r6(SCALED)} AS scaled FROM expr", RELU)
add("sort_position", "SELECT cell_id, gene, p AS position, t0 AS tie_start, ts AS tie_size, m::BIGINT AS n_floor FROM nbr_p", RELU, bounds())


def minmax(v: str, group: str) -> str:
    lo, hi = (f"{f}({v}) OVER (PARTITION BY {group})" for f in ("min", "max"))
    return f"CASE WHEN {hi} - {lo} <= 1e-8 THEN 1.0 ELSE ({v} - {lo}) / ({hi} - {lo}) END"


add("minmax", f"SELECT cell_id, gene, {r6(minmax('value', 'gene'))} AS scaled FROM expr", expr(RAW))
add("minmax_customer", f"SELECT c_custkey, {r6(minmax('c_acctbal', 'c_nationkey'))} AS scaled FROM customer")
MEAN = "value / CASE WHEN abs(avg(value) OVER (PARTITION BY gene)) > 1e-8 THEN avg(value) OVER (PARTITION BY gene) ELSE 1.0 END"
add("colmean", f"SELECT cell_id, gene, {r6(MEAN)} AS scaled FROM expr", RELU)
for mode, beta in (("expression", "value"), ("uniform", "1.0::DOUBLE"), ("blend", f"0.6::DOUBLE * ({MEAN}) + (1.0 - 0.6::DOUBLE)"),
                   ("clipped_blend", f"0.6::DOUBLE * least(greatest({MEAN}, 0.0), 3.0) + (1.0 - 0.6::DOUBLE)"),
                   ("rank_blend", f"0.6::DOUBLE * ({SCALED}) + (1.0 - 0.6::DOUBLE)")):
    add(f"beta_{mode}", f"SELECT cell_id, gene, {r6(beta)} AS beta FROM expr", RELU)

# --- correlation and modules
add("pearson", f"SELECT i, j, {r6('corr')} AS corr FROM corr", RELU, CORR)
add("spearman", f"SELECT i, j, {r6('corr')} AS corr FROM corr", expr(name="base"),
    f"expr AS (SELECT module, cell_id, gene, {AVERAGE} AS value FROM base)", CORR)
ADJ = "adj AS (SELECT i, j, CASE WHEN i = j THEN 0.0 ELSE pow(abs(corr), 2.0) END AS a FROM corr)"
add("adjacency", f"SELECT i, j, {r6('a')} AS adjacency FROM adj", RELU, CORR, ADJ)
add("tom", f"""SELECT a.i, a.j, {r6('''CASE WHEN a.i = a.j THEN 1.0 WHEN least(x.k, y.k) + 1.0 - a.a > 1e-8
  THEN (s.shared + a.a) / (least(x.k, y.k) + 1.0 - a.a) ELSE 0.0 END''')} AS tom FROM adj a JOIN shared s USING (i, j)
JOIN degree x ON x.i = a.i JOIN degree y ON y.i = a.j""", RELU, CORR, ADJ,
    "whole AS (SELECT i, j, a FROM adj UNION ALL SELECT j, i, a FROM adj WHERE i < j)",
    "degree AS (SELECT i, sum(a) AS k FROM whole GROUP BY i)",
    "shared AS (SELECT x.i, y.i AS j, sum(x.a * y.a) AS shared FROM whole x JOIN whole y ON y.j = x.j GROUP BY ALL)")
SHARED = "distal AS (SELECT DISTINCT l.dst AS i, r.dst AS j FROM prior l JOIN prior r ON r.src = l.src AND l.dst < r.dst)"
add("shared_support", "SELECT i, j FROM distal", RELU, CORR, PRIOR, SHARED)


def corr_by_module(source: str, name: str) -> str:
    return f"""{name}_n AS (SELECT module, gene, avg(value) AS m, sqrt(var_pop(value) * count(*)) AS norm FROM {source} GROUP BY ALL),
{name}_u AS (SELECT module, cell_id, gene, CASE WHEN norm > 1e-8 THEN (value - m) / norm ELSE 0.0 END AS u FROM {source} JOIN {name}_n USING (module, gene)),
{name} AS (SELECT x.module, x.gene AS i, y.gene AS j, greatest(-1.0, least(1.0, sum(x.u * y.u))) AS corr FROM {name}_u x
  JOIN {name}_u y ON y.module = x.module AND y.cell_id = x.cell_id AND y.gene > x.gene GROUP BY ALL)"""


add("pair_priors", f"""SELECT module, i, j, {r6('a')} AS local_adjacency, strong AS strong_edge, amb AS ambiguous_edge, prom AS promoter_support, dist AS distal_support,
  CASE WHEN strong THEN 'strong_rna' ELSE concat_ws('|', CASE WHEN prom THEN 'ambiguous_with_promoter' END, CASE WHEN dist THEN 'ambiguous_with_distal' END) END AS support_rule
FROM flagged WHERE strong OR (amb AND (prom OR dist))""",
    RELU, CORR, PRIOR, SHARED, expr(module=LABEL, name="rna"), expr(RAW, LABEL, "act"), corr_by_module("rna", "rc"), corr_by_module("act", "ac"),
    "ladj AS (SELECT module, i, j, pow(abs(corr), 6.0) AS a FROM rc)",
    "cut AS (SELECT module, quantile_cont(a, 0.97) AS s, quantile_cont(a, 0.85) AS q FROM ladj GROUP BY module)",
    "pcut AS (SELECT module, quantile_cont(abs(corr), 0.8) AS p FROM ac GROUP BY module)",
    """flagged AS (SELECT module, i, j, a, a >= s AS strong, a >= q AND NOT a >= s AS amb, abs(ac.corr) >= p AS prom, d.i IS NOT NULL AS dist
  FROM ladj JOIN cut USING (module) JOIN ac USING (module, i, j) JOIN pcut USING (module) LEFT JOIN distal d USING (i, j))""")
add("module_summary", """SELECT count(*) AS module_count, min(c) AS min_size, median(c)::DOUBLE AS median_size, max(c) AS max_size,
  sum(c * (c - 1) // 2)::BIGINT AS pairwise_load FROM (SELECT label, count(*) AS c FROM embeddings GROUP BY label)""")
add("module_order", "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS order_in_module FROM embeddings")
add("module_centroid", f"SELECT gene // 8 AS module_no, cell_id, {r6('avg(value)')} AS centroid FROM expr GROUP BY ALL", RELU)
add("module_labels", "SELECT p_partkey AS gene, CASE WHEN p_size > 25 THEN p_size ELSE -1 END AS label FROM part")
add("module_concat", f"""SELECT cell_id, gene, {r6('CASE WHEN r.value > 0 THEN r.value ELSE e.value END')} AS score FROM expr e JOIN raw r USING (cell_id, gene)""",
    RELU, expr(RAW, name="raw"))
add("score_matrix", "SELECT vec_id AS cell_id, " + ", ".join(f"round(greatest(embedding[{i + 1}]::DOUBLE, 0.0), 6) AS g{i}" for i in range(64)) + " FROM embeddings")

# --- intervals, names, motifs
TIMELINE = """anchor AS (SELECT o_orderkey AS gene_id, o_custkey AS chrom, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS pos FROM orders),
span AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)) AS peak_id,
  o_custkey AS chrom, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS e
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
add("interval_join", "SELECT gene_id, peak_id FROM anchor a JOIN span p ON p.chrom = a.chrom AND p.s <= a.pos + 30 AND p.e >= a.pos - 30", TIMELINE)
add("two_tier", """SELECT gene_id, peak_id, CASE WHEN s <= pos + 10 AND e >= pos - 10 THEN 'promoter' ELSE 'distal' END AS tier, abs((s + e) // 2 - pos) AS distance
FROM anchor a JOIN span p ON p.chrom = a.chrom AND p.s <= a.pos + 90 AND p.e >= a.pos - 90""", TIMELINE)
SUPPLIERS = """named AS (SELECT s_name AS name, s_suppkey || '.' || s_nationkey AS feature_id,
  CASE WHEN s_acctbal > 0 THEN 'chr' || s_nationkey || ':' || s_suppkey * 100 || '-' || (s_suppkey * 100 + 50) ELSE 'unplaced' END AS interval FROM supplier),
start AS (SELECT n_nationkey::VARCHAR AS key, 'chr' || n_regionkey AS chrom, n_nationkey::BIGINT * 1000 AS pos FROM nation)"""
RESOLVED = """resolved AS (SELECT n.name, coalesce(a.chrom, b.chrom, c.chrom) AS listed_chrom, coalesce(a.pos, b.pos, c.pos) AS listed_pos,
  CASE WHEN contains(n.interval, ':') THEN split_part(n.interval, ':', 1) END AS own_chrom,
  CASE WHEN contains(n.interval, ':') THEN split_part(split_part(n.interval, ':', 2), '-', 1)::BIGINT END AS own_pos
  FROM named n LEFT JOIN start a ON a.key = n.name LEFT JOIN start b ON b.key = n.feature_id LEFT JOIN start c ON c.key = split_part(n.feature_id, '.', 1)),
placed AS (SELECT name, coalesce(listed_chrom, own_chrom) AS chrom, coalesce(listed_pos, own_pos) AS pos,
  CASE WHEN listed_chrom IS NOT NULL THEN 'gtf_tss' WHEN own_chrom IS NOT NULL THEN 'h5_interval_start' ELSE 'missing' END AS anchor_source FROM resolved)"""
add("anchor_resolve", "SELECT name, chrom, pos, anchor_source FROM placed", SUPPLIERS, RESOLVED)
add("anchor_hist", "SELECT anchor_source, count(*) AS genes FROM placed GROUP BY anchor_source", SUPPLIERS, RESOLVED)
add("symbol_resolve", """SELECT n.name, feature_id, coalesce(a.n_name, b.n_name, n.name) AS gene_symbol FROM named n
LEFT JOIN nation a ON a.n_nationkey::VARCHAR = upper(split_part(n.name, '.', 1)) LEFT JOIN nation b ON b.n_nationkey::VARCHAR = upper(split_part(feature_id, '.', 1))""", SUPPLIERS)
add("links_topk", f"""SELECT gene_id, peak_id, rank::INT AS retained_rank, {r6('score')} AS score, {r6('score / greatest(sum(score) OVER (PARTITION BY gene_id), 1e-8)')} AS share
FROM best WHERE rank <= 5 AND score > 0""",
    """pair AS MATERIALIZED (SELECT o_custkey AS gene_id, l_orderkey || '-' || l_linenumber AS peak_id, max(l_discount - 0.05::DOUBLE) AS corr,
  min(abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) * 1000.0::DOUBLE) AS distance FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""",
    "scored AS (SELECT *, abs(corr) * exp(-distance / 200000.0) AS score FROM pair)",
    "best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY score DESC, peak_id) AS rank FROM scored)")
RANKED = "rank_{n} AS (SELECT gene, cell_id, " + AVERAGE + " AS r FROM {s})"
add("peak_gene_links", f"""SELECT gene_id, 'p' || peak_id AS peak_name, 'chr1:' || peak_id * 1000 || '-' || (peak_id * 1000 + 400) AS peak_interval,
  {r6('corr')} AS corr, abs(peak_id * 1000 + 200 - gene_id * 1000)::DOUBLE AS distance_to_tss, {r6('median')} AS median
FROM linked JOIN (SELECT gene AS peak_id, median(value) AS median FROM raw GROUP BY gene) USING (peak_id) WHERE corr > 0.05""",
    RELU, expr(RAW, name="raw"), RANKED.format(n="g", s="expr"), RANKED.format(n="p", s="raw"),
    "near AS MATERIALIZED (SELECT x.gene AS gene_id, y.gene AS peak_id FROM (SELECT DISTINCT gene FROM expr) x JOIN (SELECT DISTINCT gene FROM expr) y ON y.gene * 1000 <= x.gene * 1000 + 4000 AND y.gene * 1000 + 400 >= x.gene * 1000 - 4000)",
    "linked AS (SELECT gene_id, peak_id, corr(a.r, b.r) AS corr FROM near JOIN rank_g a ON a.gene = gene_id JOIN rank_p b ON b.gene = peak_id AND b.cell_id = a.cell_id GROUP BY ALL)")
add("gene_activity", f"""SELECT c.gene AS gene_id, c.cell_id, {r6('sum(s.share * p.value)')} AS activity FROM expr c JOIN share s ON s.gene_id = c.gene
JOIN expr p ON p.gene = s.peak_id AND p.cell_id = c.cell_id GROUP BY ALL""",
    RELU, RANKED.format(n="g", s="expr"),
    """near AS MATERIALIZED (SELECT x.gene AS gene_id, y.gene AS peak_id, y.gene * 1000 <= x.gene * 1000 + 500 AND y.gene * 1000 + 400 >= x.gene * 1000 - 500 AS promoter,
  abs(y.gene * 1000 + 200 - x.gene * 1000)::DOUBLE AS distance FROM (SELECT DISTINCT gene FROM expr) x JOIN (SELECT DISTINCT gene FROM expr) y
  ON y.gene * 1000 <= x.gene * 1000 + 6000 AND y.gene * 1000 + 400 >= x.gene * 1000 - 6000)""",
    """scored AS (SELECT gene_id, peak_id, abs(corr(a.r, b.r)) * exp(-any_value(distance) / 200000.0) AS score FROM near
  JOIN rank_g a ON a.gene = gene_id JOIN rank_g b ON b.gene = peak_id AND b.cell_id = a.cell_id WHERE NOT promoter GROUP BY gene_id, peak_id)""",
    "best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY score DESC, peak_id) AS rank FROM scored) WHERE rank <= 5 AND score > 0)",
    """share AS (SELECT gene_id, peak_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY gene_id) AS share FROM near WHERE promoter
  UNION ALL SELECT gene_id, peak_id, score / sum(score) OVER (PARTITION BY gene_id) FROM best)""")
add("make_unique", """SELECT p_partkey::VARCHAR AS feature_id, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1
  THEN p_name ELSE p_name || '|' || p_partkey END AS unique_name FROM part""")
add("canon_token", "SELECT p_partkey, upper(split_part(trim(p_brand), '.', 1)) AS token FROM part")
add("strip_version", "SELECT p_partkey, 'id' || p_partkey AS token FROM part")
add("parse_interval", """SELECT name, CASE WHEN ok THEN split_part(interval, ':', 1) END AS chrom, CASE WHEN ok THEN split_part(rest, '-', 1)::BIGINT END AS start,
  CASE WHEN ok THEN split_part(rest, '-', 2)::BIGINT END AS end, CASE WHEN ok THEN (split_part(rest, '-', 1)::BIGINT + split_part(rest, '-', 2)::BIGINT) // 2 END AS center
FROM (SELECT name, interval, contains(interval, ':') AS ok, split_part(interval, ':', 2) AS rest FROM named)""", SUPPLIERS)
add("attribute_parse", "SELECT s_suppkey, 'G' || s_suppkey || '.1' AS gene_id, s_name AS gene_name, '2' AS level FROM supplier")
add("motif_name_tokens", "SELECT p_partkey, upper(p_brand) || '|' || upper(p_type) AS tokens FROM part")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGT" * 6 + "AC"
SEQS = f"seq AS (SELECT doc_id::VARCHAR AS peak_name, lang, translate(text, '{UPPER}{UPPER.lower()}', '{BASES}{BASES}') AS s FROM documents)"
PSSM = r"""tally AS (SELECT lang, p, sum(length(x) - length(replace(x, 'A', ''))) AS "A", sum(length(x) - length(replace(x, 'C', ''))) AS "C",
    sum(length(x) - length(replace(x, 'G', ''))) AS "G", sum(length(x) - length(replace(x, 'T', ''))) AS "T"
  FROM (SELECT lang, p, regexp_replace(substr(s, p), '(.).{0,5}', '\1', 'gs') AS x FROM seq, (SELECT unnest(range(1, 7)) AS p)) GROUP BY lang, p),
odds AS (SELECT lang, p, unnest(['A', 'C', 'G', 'T']) AS c, unnest([log2(("A" + 0.5) / total / 0.25), log2(("C" + 0.5) / total / 0.25), log2(("G" + 0.5) / total / 0.25), log2(("T" + 0.5) / total / 0.25)]) AS o
  FROM (SELECT *, ("A" + "C" + "G" + "T" + 2.0)::DOUBLE AS total FROM tally)),
ends AS (SELECT lang, sum(lo) AS lo, sum(hi) AS hi FROM (SELECT lang, p, min(o) AS lo, max(o) AS hi FROM odds GROUP BY lang, p) GROUP BY lang)"""
add("pssm_table", f"SELECT lang AS motif_id, {r6('lo')} AS min_score, {r6('hi')} AS max_score FROM ends", SEQS, PSSM)
add("pssm_scan", f"""SELECT peak_name, upper(lang) AS tf_symbol, {r6('max((score - lo) / (hi - lo))')} AS rel_score, {r6('max(score)')} AS abs_score
FROM found JOIN hit USING (w) WHERE score >= lo + 0.85 * (hi - lo) GROUP BY peak_name, lang""", SEQS, PSSM,
    "found AS MATERIALIZED (SELECT DISTINCT peak_name, substr(s, i, 6) AS w FROM (SELECT peak_name, s, unnest(range(1, length(s) - 4)) AS i FROM seq))",
    "word AS MATERIALIZED (SELECT DISTINCT w FROM found WHERE regexp_full_match(w, '[ACGT]{6}'))",
    """hit AS (SELECT w, lang, lo, hi, greatest(plus, minus) AS score FROM (
  SELECT w, lang, sum(CASE WHEN c = substr(w, p, 1) THEN o END) AS plus, sum(CASE WHEN c = translate(substr(w, 7 - p, 1), 'ACGT', 'TGCA') THEN o END) AS minus
  FROM word, odds GROUP BY w, lang) JOIN ends USING (lang))""")
add("triplets_best", f"""SELECT module AS module_id, tf AS tf_module_column, gene AS gene_module_column, {r6('max(score)')} AS score, arg_min(peak, (-score, peak)) AS supporting_peak_name
FROM (SELECT module, t.p_brand AS tf, l.gene, l.peak, h.rel * l.acc * l.cor AS score FROM scored l JOIN hit h USING (peak)
  JOIN (SELECT DISTINCT p_type, p_brand FROM part) t ON t.p_type = l.module AND upper(t.p_brand) = h.tf WHERE t.p_brand <> l.gene) WHERE score > 0 GROUP BY ALL""",
    "link AS (SELECT p_type AS module, p_brand AS gene, p_name AS peak, max(p_size / 50.0::DOUBLE) AS c, max(p_retailprice / 10.0::DOUBLE) AS m FROM part GROUP BY ALL)",
    f"scored AS (SELECT module, gene, peak, {minmax('m', 'module')} AS acc, {minmax('c', 'module, gene')} AS cor FROM link)",
    "hit AS (SELECT p_name AS peak, upper(p_brand) AS tf, max(p_size) / 50.0::DOUBLE AS rel FROM part GROUP BY 1, 2)")

# --- graphs and propagation
DAG = (COUNTED, EDGES0)
add("csr_pack", """SELECT cell_id, string_agg(before::VARCHAR, ',' ORDER BY i) AS node_ptr, any_value(targets) AS targets FROM (
  SELECT c.cell_id, i, (SELECT count(*) FROM edge0 e WHERE e.k = c.cell_id AND e.a < i) AS before, coalesce(t.targets, '') AS targets
  FROM cell c CROSS JOIN (SELECT unnest(range(0, 65)) AS i) LEFT JOIN (SELECT k, string_agg(b::VARCHAR, ',' ORDER BY a, b) AS targets FROM edge0 GROUP BY k) t ON t.k = c.cell_id)
GROUP BY cell_id""", *DAG)
add("csr_decode", "SELECT k AS cell_id, a AS src, b AS dst FROM edge0", *DAG)
add("degrees", """SELECT k AS cell_id, gene, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (
  SELECT k, a AS gene, 1 AS o, 0 AS i FROM edge0 UNION ALL SELECT k, b, 0, 1 FROM edge0) GROUP BY k, gene""", *DAG)
add("reach", "SELECT k AS cell_id, src, dst FROM path", *DAG,
    "path AS (SELECT k, a AS src, b AS dst FROM edge0 UNION SELECT p.k, p.src, e.b FROM path p JOIN edge0 e ON e.k = p.k AND e.a = p.dst)", recursive=True)
add("directed_part", "SELECT k AS cell_id, src, dst FROM arc x WHERE NOT EXISTS (SELECT 1 FROM arc y WHERE y.k = x.k AND y.src = x.dst AND y.dst = x.src)", ORIENTED)
add("undirected_part", "SELECT x.k AS cell_id, x.src, x.dst FROM arc x JOIN arc y ON y.k = x.k AND y.src = x.dst AND y.dst = x.src", ORIENTED)
add("edges_supported", "SELECT k AS cell_id, count(*) AS supported_edges FROM edge0 e JOIN prior p ON p.src = e.a AND p.dst = e.b GROUP BY k", *DAG, CORR, PRIOR)
COEF = "coef AS MATERIALIZED (SELECT k, a, b, CASE WHEN p.w > 0 THEN 1.0 + 2.0 * p.w ELSE 1.0 END AS c FROM edge0 e LEFT JOIN prior p ON p.src = e.a AND p.dst = e.b)"
MEAN_OUT = "c / sum(c) OVER (PARTITION BY k, a)"
for name, coef in (("sum", "c"), ("mean_out", MEAN_OUT), ("sym", "c / sqrt(sum(c) OVER (PARTITION BY k, a) * sum(c) OVER (PARTITION BY k, b))")):
    add(f"edge_coeff_{name}", f"SELECT k AS cell_id, a AS src, b AS dst, {r6(coef)} AS coef FROM coef", *DAG, CORR, PRIOR, COEF)
WALK = """walk AS (SELECT cell_id AS k, gene AS origin, gene AS at, 1.0::DOUBLE AS weight FROM expr
  UNION ALL SELECT w.k, w.origin, e.b, w.weight * 0.05 * e.c FROM walk w JOIN step e ON e.k = w.k AND e.a = w.at)"""
KATZ = f"SELECT w.k AS cell_id, w.origin AS gene, {r6('sum(w.weight * s.beta)')} AS score FROM walk w JOIN beta s ON s.cell_id = w.k AND s.gene = w.at GROUP BY ALL"
add("katz_dag", KATZ, *DAG, "step AS (SELECT k, a, b, 1.0::DOUBLE AS c FROM edge0)", "beta AS (SELECT cell_id, gene, value AS beta FROM expr)", WALK, recursive=True)
add("katz_weighted", KATZ, *DAG, CORR, PRIOR, COEF, f"step AS (SELECT k, a, b, {MEAN_OUT} AS c FROM coef)",
    f"beta AS (SELECT cell_id, gene, 0.6::DOUBLE * ({MEAN}) + (1.0 - 0.6::DOUBLE) AS beta FROM expr)", WALK, recursive=True)

PLACED = """, depth AS (SELECT cell_id AS k, gene, 0 AS d FROM expr UNION SELECT e.k, e.b, p.d + 1 FROM depth p JOIN edge0 e ON e.k = p.k AND e.a = p.gene)
SELECT k AS cell_id, (row_number() OVER (PARTITION BY k ORDER BY max(d), gene) - 1)::INT AS place, gene FROM depth GROUP BY k, gene"""
ORACLE["topo_order"] = "WITH RECURSIVE " + ",\n".join(DAG) + PLACED
add("katz_cyclic", f"SELECT k AS cell_id, gene, {r6('sum(part)')} AS score FROM term GROUP BY ALL", *DAG,
    "step AS MATERIALIZED (SELECT k, a, b FROM edge0 UNION ALL SELECT k, b, a FROM edge0)",
    """term AS (SELECT cell_id AS k, gene, value AS part, 0 AS power FROM expr
  UNION ALL SELECT e.k, e.a, sum(0.05::DOUBLE * t.part), t.power + 1 FROM term t JOIN step e ON e.k = t.k AND e.b = t.gene WHERE t.power < 60 GROUP BY e.k, e.a, t.power)""", recursive=True)


def closure_rounds(most: int, arcs: str) -> str:
    """Rules 1-3 by rounds; further rounds than are needed change nothing."""
    linked = lambda a, b: f"EXISTS (SELECT 1 FROM tied t WHERE t.k = u.k AND t.src = {a} AND t.dst = {b})"
    parts = [f"tied AS MATERIALIZED (SELECT k, src, dst FROM {arcs} UNION SELECT k, dst, src FROM {arcs})",
             f"loose0 AS MATERIALIZED (SELECT x.* FROM {arcs} x SEMI JOIN {arcs} y ON y.k = x.k AND y.src = x.dst AND y.dst = x.src)",
             f"known0 AS MATERIALIZED (SELECT x.* FROM {arcs} x ANTI JOIN {arcs} y ON y.k = x.k AND y.src = x.dst AND y.dst = x.src)"]
    for i in range(most):
        parts += [f"""found{i} AS MATERIALIZED (
  SELECT u.k, u.src, u.dst FROM loose{i} u JOIN known{i} x ON x.k = u.k AND x.dst = u.src AND x.src <> u.dst WHERE NOT {linked("x.src", "u.dst")}
  UNION SELECT u.k, u.src, u.dst FROM loose{i} u JOIN known{i} x ON x.k = u.k AND x.src = u.src JOIN known{i} y ON y.k = u.k AND y.src = x.dst AND y.dst = u.dst
  UNION SELECT u.k, u.src, u.dst FROM loose{i} u JOIN loose{i} p ON p.k = u.k AND p.src = u.src JOIN known{i} x ON x.k = u.k AND x.src = p.dst AND x.dst = u.dst
    JOIN loose{i} q ON q.k = u.k AND q.src = u.src AND q.dst > p.dst JOIN known{i} y ON y.k = u.k AND y.src = q.dst AND y.dst = u.dst
    WHERE NOT {linked("p.dst", "q.dst")})""",
                  f"fresh{i} AS MATERIALIZED (SELECT * FROM found{i} f WHERE f.src < f.dst OR NOT EXISTS (SELECT 1 FROM found{i} g WHERE g.k = f.k AND g.src = f.dst AND g.dst = f.src))",
                  f"known{i + 1} AS MATERIALIZED (SELECT * FROM known{i} UNION ALL SELECT * FROM fresh{i})",
                  f"loose{i + 1} AS MATERIALIZED (SELECT l.* FROM loose{i} l ANTI JOIN (SELECT k, src, dst FROM fresh{i} UNION SELECT k, dst, src FROM fresh{i}) f USING (k, src, dst))"]
    return ",\n".join(parts)


add("orientation_closure", "SELECT k AS cell_id, src, dst FROM known20 UNION ALL SELECT k, src, dst FROM loose20", *DAG, CORR, PRIOR,
    "first AS MATERIALIZED (SELECT src, dst FROM prior WHERE rank = 1)", "against AS MATERIALIZED (SELECT dst AS src, src AS dst FROM first x ANTI JOIN first y ON y.src = x.dst AND y.dst = x.src)",
    "told AS MATERIALIZED (SELECT * FROM (SELECT k, a AS src, b AS dst FROM edge0 UNION ALL SELECT k, b, a FROM edge0) ANTI JOIN against USING (src, dst))", closure_rounds(20, "told"))

# --- neighbours
NEAR = """near AS MATERIALIZED (SELECT x.vec_id AS cell_id, y.vec_id AS other, list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS d FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id),
best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, other) AS rank FROM near) WHERE rank <= 30)"""
add("knn", f"SELECT cell_id, other, rank::INT AS rank, {r6('d')} AS distance FROM best", NEAR)
add("knn_graph", f"SELECT cell_id, other, {r6('1.0::DOUBLE / count(*) OVER (PARTITION BY cell_id)')} AS weight FROM link", NEAR,
    "link AS (SELECT cell_id, other FROM best UNION SELECT other, cell_id FROM best UNION SELECT vec_id, vec_id FROM embeddings)")


add("joint_profiles", f"""SELECT gene, cell_id, {r6('value')} AS value, {r6('lo')} AS lo, {r6('hi')} AS hi FROM nbr WHERE value <> 0
UNION ALL SELECT gene, NULL, 0.0, {r6('min(lo)')}, {r6('min(hi)')} FROM nbr WHERE value = 0 GROUP BY gene""", """sold AS (
  SELECT l_suppkey AS cell_id, l_partkey AS part, sum(l_quantity) AS c FROM lineitem GROUP BY ALL),
high AS (SELECT part, quantile_cont(c, 0.95) AS p95 FROM sold WHERE c > 0 GROUP BY part),
scaled AS (SELECT cell_id, part, CASE WHEN p95 > 0 THEN least(greatest(ln(1 + c) / ln(1 + p95), 0.0), 1.0) ELSE 0.0 END AS access FROM sold JOIN high USING (part)),
linked AS (SELECT DISTINCT p_brand || '/' || p_size AS gene, p_partkey AS part FROM part WHERE p_size > 0),
profile AS (SELECT gene, cell_id, CASE WHEN max(access) <= 0.6 THEN 0.0 ELSE max(access) END AS value FROM linked JOIN scaled USING (part) GROUP BY ALL),
grid AS (SELECT 'all' AS module, g.gene, s.s_suppkey AS cell_id, coalesce(p.value, 0.0) AS value
  FROM (SELECT DISTINCT gene FROM linked) g CROSS JOIN supplier s LEFT JOIN profile p ON p.gene = g.gene AND p.cell_id = s.s_suppkey)""", bounds("grid").replace("value <= 0", "value <= 0.6"))

add("column_variance", f"SELECT gene, {r6('var_pop(value)')} AS variance FROM expr GROUP BY gene", RELU)

add("pair_floor", f"""SELECT a, b, {r6('w')} AS w, 'weighted' AS mode FROM p WHERE w >= 0.4 UNION ALL SELECT a, b, 1.0, 'binary' FROM p""",
    "p AS (SELECT least(p_brand, 'Brand#' || p_size) AS a, greatest(p_brand, 'Brand#' || p_size) AS b, max(least(greatest(p_size / 50.0::DOUBLE, 0.0), 1.0)) AS w FROM part WHERE p_brand <> 'Brand#' || p_size AND p_size > 0 GROUP BY 1, 2)")
add("usable_links", f"""SELECT p_brand AS gene, p_type || ' ' || p_size AS peak_name, {r6('max((p_retailprice - 950.0) / 1000.0)')} AS weight FROM part
WHERE p_size > 10 AND p_retailprice > 950.0 AND p_brand <> 'Brand#3' GROUP BY 1, 2""")
add("weighted_profiles", f"SELECT gene, cell_id, {r6('value')} AS value FROM profile WHERE value > 0.3", SPARSE,
    "high AS (SELECT feature_id, quantile_cont(count, 0.95) AS p95 FROM sparse WHERE count > 0 GROUP BY feature_id)",
    "scaled AS (SELECT cell_id, feature_id, CASE WHEN p95 > 0 THEN least(greatest(ln(1 + count) / ln(1 + p95), 0.0), 1.0) ELSE 0.0 END AS access FROM sparse JOIN high USING (feature_id))",
    "profile AS (SELECT p_brand || '/' || p_size AS gene, cell_id, sum(greatest((p_size - 5) / 50.0::DOUBLE, 0.0) * access) AS value FROM scaled JOIN part ON p_partkey = feature_id GROUP BY ALL)")
add("feature_type", "SELECT cell_id, feature_id, count FROM sparse JOIN part ON p_partkey = feature_id WHERE p_type = 'PROMO'", SPARSE)
add("auto_log", f"""SELECT cell_id, feature_id, {r6('ln(1 + count * (1e4 / sum(count) OVER (PARTITION BY cell_id)))')} AS value, 'counts_to_log1p' AS mode FROM sparse
UNION ALL SELECT cell_id, feature_id, {r6('ln(1 + count)')}, 'already_log_like' FROM sparse""", SPARSE)
add("local_ids", """SELECT s * 1000 + e AS local_id, CASE WHEN s <= pos + 5 AND e >= pos - 5 THEN 'promoter' ELSE 'distal' END AS tier, count(*) AS pairs
FROM anchor a JOIN span p ON p.chrom = a.chrom AND p.s <= a.pos + 20 AND p.e >= a.pos - 20 WHERE (s * 1000 + e) % 10 <> 3 GROUP BY ALL""", TIMELINE)
add("module_names", """SELECT DISTINCT CASE WHEN p_size > 5 THEN 's3://b/x/module_' || p_brand || '_expression.csv' ELSE p_type || '/other.csv' END AS path,
  CASE WHEN p_size > 5 THEN 'module_' || p_brand || '_expression' ELSE '' END AS module, CASE WHEN p_size > 5 THEN p_brand ELSE '' END AS module_id FROM part""")
add("separating_sets", """SELECT x.p_brand, x.v || ',' || y.v AS members, 2 AS size FROM one x JOIN one y ON y.p_brand = x.p_brand AND y.v > x.v
UNION ALL SELECT x.p_brand, x.v || ',' || y.v || ',' || z.v, 3 FROM one x JOIN one y ON y.p_brand = x.p_brand AND y.v > x.v JOIN one z ON z.p_brand = x.p_brand AND z.v > y.v""",
    "one AS (SELECT DISTINCT p_brand, p_size AS v FROM part)")
ORACLE["access_links"] = ORACLE["gene_activity"].rpartition("SELECT c.gene AS gene_id")[0] + f"""SELECT gene_id, peak_id, 'promoter' AS link_kind, distance, 1.0 AS score, 0 AS retained_rank FROM near WHERE promoter
UNION ALL SELECT gene_id, peak_id, 'distal', distance, {r6('score')}, rank::INT FROM best JOIN near USING (gene_id, peak_id)"""
