"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from causeway.functions.scalar import SCREENS
from causeway.spec import DAY, LINES

_TX = """tx AS (
  SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_ord, CAST(epoch(l_shipdate) AS BIGINT) AS t,
         l_extendedprice AS amount, CAST(l_returnflag = 'R' AS INTEGER) AS label, o_custkey AS cust, l_suppkey AS supp, nullif(p_brand, 'Brand#11') AS brand,
         nullif(c_mktsegment, 'BUILDING') AS segment, l_linestatus AS status, p_size AS size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""


def _edges(layers) -> str:
    one = "SELECT row_ord, t, amount, label, '{a}--{b}' AS layer, '{a}=' || {a} AS a, '{b}=' || {b} AS b FROM tx WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    return _TX + ", e AS (" + " UNION ALL ".join(one.format(a=x.split("--")[0], b=x.split("--")[1]) for x in layers) + ")"


def _ends(layers) -> str:
    return _edges(layers) + ", ends AS (SELECT *, 'left' AS side, a AS node, b AS other FROM e UNION ALL SELECT *, 'right' AS side, b AS node, a AS other FROM e)"


def _frame(keys: str, back: int) -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {back} PRECEDING)"


def _hist(days: int, layers=LINES.risk) -> str:
    back = days * DAY + 1
    return _ends(layers) + f""",
g0 AS (SELECT layer, t, count(*) AS n, sum(label) AS f FROM e GROUP BY layer, t),
g AS (SELECT layer, t, coalesce(sum(n) {_frame('layer', back)}, 0) AS gn, coalesce(sum(f) {_frame('layer', back)}, 0) AS gf FROM g0),
h0 AS (SELECT *, count(label) {_frame('layer, node', back)} AS n, coalesce(sum(label) {_frame('layer, node', back)}, 0) AS f FROM ends),
h AS (SELECT h0.*, CASE WHEN gn > 0 THEN CAST(gf AS DOUBLE) / gn ELSE 0 END AS rate FROM h0 JOIN g USING (layer, t))"""


def _signal(alpha: int, f: str = "f", n: str = "n", rate: str = "rate") -> str:
    return f"(({f} + CAST({alpha} AS DOUBLE) * {rate}) / ({n} + CAST({alpha} AS DOUBLE)))"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0 AS {name}"


def _history(days: int, alpha: int) -> str:
    return f"""WITH {_hist(days)} SELECT row_ord, layer, side, node, {r(_signal(alpha), 'H')}, {r('CASE WHEN n > 0 THEN CAST(f AS DOUBLE) / n ELSE rate END', 'H_raw')},
{r('ln(1 + CAST(f AS DOUBLE))', 'fraud_log')}, {r('ln(1 + CAST(n AS DOUBLE))', 'exposure_log')}, CAST(n = 0 AS INTEGER) AS missing FROM h"""


def _temporal(layers) -> str:
    return _ends(layers) + f""",
s0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY layer, node, other ORDER BY row_ord) = 1 AS INTEGER) AS fresh, ln(1 + greatest(amount, 0)) AS la FROM ends),
s AS (SELECT row_ord, t, layer, side, count(*) {_frame('layer, node', 1)} AS n, max(t) {_frame('layer, node', 1)} AS last_t, coalesce(sum(fresh) {_frame('layer, node', 1)}, 0) AS deg,
   avg(la) {_frame('layer, node', 1)} AS am, count(*) {_frame('layer, node', DAY + 1)} AS n1, count(*) {_frame('layer, node', 7 * DAY + 1)} AS n7 FROM s0),
p AS (SELECT row_ord, layer, count(*) {_frame('layer, a, b', 1)} AS count_ab, max(t) {_frame('layer, a, b', 1)} AS last_ab FROM e),
v AS (SELECT l.row_ord, l.t, l.layer, l.n AS count_a, r.n AS count_b, count_ab, CAST(count_ab > 0 AS INTEGER) AS edge_seen, l.t - l.last_t AS time_since_a, l.t - r.last_t AS time_since_b, l.t - last_ab AS time_since_edge,
   l.deg AS degree_a, r.deg AS degree_b, l.am AS amount_mean_a, r.am AS amount_mean_b,
   greatest(ln(1 + CAST(l.n - l.n1 AS DOUBLE)) - ln(1 + CAST(l.n - l.n7 AS DOUBLE) / 7), ln(1 + CAST(r.n - r.n1 AS DOUBLE)) - ln(1 + CAST(r.n - r.n7 AS DOUBLE) / 7)) AS count_velocity,
   CASE WHEN l.n = 0 AND r.n = 0 THEN 'C11' WHEN l.n = 0 OR r.n = 0 THEN 'C10' WHEN count_ab > 0 THEN 'C00_oldedge' ELSE 'C00_newedge' END AS cohort
   FROM s l JOIN s r ON l.row_ord = r.row_ord AND l.layer = r.layer AND l.side = 'left' AND r.side = 'right' JOIN p ON p.row_ord = l.row_ord AND p.layer = l.layer)"""


_TEMPORAL = _temporal(LINES.layers())

_FLAGS = ", ".join(
    f"CAST({how}(CAST({test} AS INTEGER)) AS INTEGER) AS {name}"
    for how, test, name in (
        ("max", "cohort = 'C00_newedge'", "cohort_any_C00_newedge"), ("max", "cohort = 'C00_oldedge'", "cohort_any_C00_oldedge"), ("max", "cohort = 'C10'", "cohort_any_C10"),
        ("min", "cohort = 'C11'", "cohort_all_C11"), ("min", "cohort LIKE 'C00%'", "known_endpoints_all_edges"),
    )
)

_ZERO = _hist(0) + f""",
w AS (SELECT row_ord, layer, count(*) {_frame('layer, a, b', 1)} AS w FROM e),
b0 AS (SELECT l.row_ord, l.layer, {_signal(5, 'l.f', 'l.n', 'l.rate')} AS a, {_signal(5, 'r.f', 'r.n', 'r.rate')} AS b, CASE WHEN l.n > 0 THEN CAST(l.f AS DOUBLE) / l.n ELSE l.rate END AS ra, CASE WHEN r.n > 0 THEN CAST(r.f AS DOUBLE) / r.n ELSE r.rate END AS rb, l.n AS na, r.n AS nb, CAST(w AS DOUBLE) AS w
   FROM h l JOIN h r ON l.row_ord = r.row_ord AND l.layer = r.layer AND l.side = 'left' AND r.side = 'right' JOIN w ON w.row_ord = l.row_ord AND w.layer = l.layer),
b1 AS (SELECT *, (CAST(0.1 AS DOUBLE) + w) / (CAST(0.1 AS DOUBLE) * (CAST(0.1 AS DOUBLE) + 2 * w)) AS same, w / (CAST(0.1 AS DOUBLE) * (CAST(0.1 AS DOUBLE) + 2 * w)) AS x, 2 / (CAST(0.1 AS DOUBLE) + 2 * w) AS res, 5 + na AS da, 5 + nb AS db FROM b0),
z AS (SELECT *, CAST(0.1 AS DOUBLE) * (same * a + x * b) AS sa, CAST(0.1 AS DOUBLE) * (same * b + x * a) AS sb, (da + w) * (db + w) - w * w AS det2 FROM b1)"""

_S = "s AS (SELECT (row_ord - 1) // 10000 AS \"window\", l.row_ord AS \"order\", l.label AS y, " + f"round({_signal(5, 'l.f', 'l.n', 'l.rate')}, 9) AS score, round({_signal(5, 'r.f', 'r.n', 'r.rate')}, 9) AS second, l.n AS seen FROM h l JOIN (SELECT row_ord AS ro, f, n, rate FROM h WHERE side = 'right') r ON l.row_ord = r.ro WHERE l.side = 'left')"
_SCORES = _hist(0, ["cust--brand"]) + ",\n" + _S
_W = '"window"'


def _at(budgets: str, y: str = "y", key: str = _W, score: str = "score", frm: str = "s") -> str:
    """Ranked rows and cut-offs: ``budgets`` is SQL of ``(budget, k)`` pairs over ``n``."""
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, "order") AS rn, count(*) OVER (PARTITION BY {key}) AS n, sum({y}) OVER (PARTITION BY {key}) AS p FROM {frm}),
bk AS ({budgets}),
hit AS (SELECT rk.*, bk.budget, CASE WHEN bk.fixed THEN least(CAST(bk.budget AS BIGINT), n) WHEN bk.up THEN greatest(1, CAST(ceil(round(n * bk.budget, 9)) AS BIGINT)) ELSE greatest(1, CAST(floor(round(n * bk.budget, 9)) AS BIGINT)) END AS k FROM rk CROSS JOIN bk),
kept AS (SELECT * FROM hit WHERE rn <= k)"""


def _budgets(values, up=False, counts=()) -> str:
    rows = [f"SELECT CAST({v} AS DOUBLE) AS budget, {str(up).upper()} AS up, FALSE AS fixed" for v in values] + [f"SELECT CAST({v} AS DOUBLE), FALSE, TRUE" for v in counts]
    return " UNION ALL ".join(rows)


def _curve(keys: str, frm: str = "s", score: str = "score") -> str:
    return f"""c0 AS (SELECT {keys}, {score} AS score, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM {frm} GROUP BY {keys}, {score}),
c AS (SELECT *, sum(pos) OVER q AS tp, sum(neg) OVER q AS fp, sum(pos) OVER (PARTITION BY {keys}) AS pp, sum(neg) OVER (PARTITION BY {keys}) AS nn FROM c0 WINDOW q AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT {keys}, max(pp) / (max(pp) + max(nn)) AS prevalence, sum(pos / pp * tp / (tp + fp)) AS ap, sum(neg * (tp - pos / 2) / (pp * nn)) AS auc, coalesce(max(CASE WHEN fp / nn <= 0.05 THEN tp / pp END), 0) AS rec FROM c GROUP BY {keys})"""


_MODELS = _SCORES + """,
mx AS (SELECT "window", "order", y, 'left' AS model, score FROM s UNION ALL SELECT "window", "order", y, 'right', second FROM s
  UNION ALL SELECT "window", "order", y, 'mean', round((score + second) / 2, 9) FROM s UNION ALL SELECT "window", "order", y, 'most', greatest(score, second) FROM s),
""" + _curve('"window", model', "mx")

_BIP = """tx AS (SELECT o_orderkey AS tx, CAST(year(o_orderdate) * 12 + month(o_orderdate) - (SELECT min(year(o_orderdate) * 12 + month(o_orderdate)) FROM orders) + 1 AS INTEGER) AS step,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS cls FROM orders),
ins AS (SELECT DISTINCT l_orderkey AS tx, 's' || l_suppkey AS address FROM lineitem),
outs AS (SELECT DISTINCT l_orderkey AS tx, 'p' || l_partkey AS address FROM lineitem),
fan AS (SELECT i.tx FROM (SELECT tx, count(*) AS n FROM ins GROUP BY tx) i JOIN (SELECT tx, count(*) AS n FROM outs GROUP BY tx) o ON i.tx = o.tx WHERE i.n * o.n <= {cap}),
pairs AS (SELECT tx.tx, step, ins.address AS a, outs.address AS b FROM tx JOIN fan ON tx.tx = fan.tx JOIN ins ON ins.tx = tx.tx JOIN outs ON outs.tx = tx.tx),
touch AS (SELECT tx.tx, step, cls, address FROM tx JOIN (SELECT * FROM ins UNION SELECT * FROM outs) x ON x.tx = tx.tx),
prior AS (SELECT s.step, coalesce((SELECT CAST(sum(CAST(cls = 1 AS INTEGER)) AS DOUBLE) / nullif(sum(CAST(cls <> 3 AS INTEGER)), 0) FROM tx WHERE tx.step < s.step), CAST(0.05 AS DOUBLE)) AS p0 FROM (SELECT DISTINCT step FROM tx) s),
st0 AS (SELECT address, step, sum(CAST(cls <> 3 AS INTEGER)) AS kn, sum(CAST(cls = 1 AS INTEGER)) AS kf FROM touch GROUP BY address, step),
st AS (SELECT address, step, coalesce(sum(kn) OVER q, 0) AS n, coalesce(sum(kf) OVER q, 0) AS f FROM st0 WINDOW q AS (PARTITION BY address ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

_EXPOSED = f"""{_edges(LINES.risk)}, ends AS (SELECT *, a AS node, 'left' AS side FROM e UNION ALL SELECT *, b, 'right' FROM e), c AS (SELECT row_ord, label, layer, side, count(label) {_frame('layer, node', 1)} AS n FROM ends),
p AS (SELECT row_ord, layer, count(*) {_frame('layer, a, b', 1)} AS ab FROM e), f AS (SELECT c.row_ord, bool_and(least_n > 0) AS known, bool_or(least_n > 0 AND ab = 0) AS fresh FROM (SELECT row_ord, layer, min(n_all) AS least_n FROM (SELECT row_ord, layer, count(*) {_frame('layer, node', 1)} AS n_all FROM ends) GROUP BY row_ord, layer) c
   JOIN p ON p.row_ord = c.row_ord AND p.layer = c.layer GROUP BY c.row_ord),
x AS (SELECT c.row_ord, label, CAST(sum(CASE WHEN side = 'left' THEN n ELSE 0 END) AS BIGINT) AS l, CAST(sum(CASE WHEN side = 'right' THEN n ELSE 0 END) AS BIGINT) AS r, any_value(known) AS known, any_value(fresh) AS fresh FROM c JOIN f ON f.row_ord = c.row_ord GROUP BY c.row_ord, label)"""
_STRATA = "k AS (" + " UNION ALL ".join(
    f"SELECT *, '{name}' AS stratum FROM x WHERE {test}"
    for name, test in (("cold_or_new", "l <= 0 OR r <= 0"), ("low_count", "least(l, r) BETWEEN 1 AND 5"), ("medium_count", "least(l, r) BETWEEN 6 AND 20"), ("high_count", "least(l, r) > 20"), ("known_endpoints", "known"), ("C00_newedge", "fresh"))
) + ")"
_VALID = f"""v AS (SELECT * FROM (WITH {_SCORES}, n AS (SELECT count(*) AS n FROM lineitem) SELECT s.*, round((score + second) / 2, 9) AS mean, greatest(score, second) AS most,
  CASE WHEN seen = 0 THEN 'cold' WHEN seen <= 5 THEN 'low' ELSE 'seen' END AS cohort, CASE WHEN "order" - 1 < n * 6 // 10 THEN 'train' WHEN "order" - 1 < n * 8 // 10 THEN 'valid' ELSE 'test' END AS split FROM s CROSS JOIN n) WHERE split IN ('valid'))"""


def _gate(robust: str, models: tuple[str, ...] = ("left", "second", "mean", "most")) -> str:
    """The model that ranks a cohort's validation rows best, with its key."""
    long = " UNION ALL ".join(f"SELECT cohort, y, \"order\", '{m}' AS model, {'score' if m == 'left' else m} AS score FROM v WHERE split = 'valid'" for m in models)
    table = lambda key: f"""(WITH {_curve(key, 'lg')}, {_at(_budgets([0.01, 0.005]), key=key, frm='lg')}, pk AS (SELECT {key}, max(CASE WHEN budget = 0.01 THEN v END) AS p1, max(CASE WHEN budget = 0.005 THEN v END) AS p05 FROM (SELECT {key}, budget, sum(y) / CAST(k AS DOUBLE) AS v FROM kept GROUP BY {key}, budget, k) GROUP BY {key})
SELECT m.*, p1, p05 FROM m JOIN pk USING ({key}))"""  # noqa: E731
    return f"""WITH {_VALID}, lg AS ({long}), tc AS {table('cohort, model')}, tg AS {table('model')},
sz AS (SELECT cohort, count(*) >= 20 AND sum(y) > 0 AND sum(y) < count(*) AS own FROM v WHERE split = 'valid' GROUP BY cohort),
ky AS (SELECT tc.cohort, tc.model, {", ".join(f"CASE WHEN own THEN {robust} * tc.{c} + (1 - {robust}) * tg.{c} ELSE tg.{c} END AS {c}" for c in ("p1", "p05"))}, round(CASE WHEN own THEN tc.ap ELSE tg.ap END, 9) AS ap FROM tc JOIN tg ON tg.model = tc.model JOIN sz ON sz.cohort = tc.cohort),
rk AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY p1 DESC, p05 DESC, ap DESC, model DESC) AS rn FROM ky)
SELECT cohort, model, {r('p1', 'p1')}, {r('p05', 'p05')}, {r('ap', 'ap')} FROM rk WHERE rn = 1"""


ORACLE: dict[str, str] = {
    "tx_table": f"WITH {_TX} SELECT row_ord, row_ord AS tx_id, t, amount, label, cust, supp, brand, segment, status, size FROM tx",
    "edges_long": f"WITH {_edges(LINES.layers())} SELECT row_ord, t, amount, label, layer, a, b FROM e",
    "tabular": f"""WITH {_TX} SELECT row_ord, {r('ln(1 + greatest(amount, 0))', 'log_amount')}, {r('(t % 86400) / CAST(3600 AS DOUBLE)', 'hour')}, {r('sin((t % 86400) / CAST(3600 AS DOUBLE) * (2 * pi() / 24))', 'hour_sin')},
{r('cos((t % 86400) / CAST(3600 AS DOUBLE) * (2 * pi() / 24))', 'hour_cos')}, {r('floor(t / CAST(86400 AS DOUBLE))', 'relative_day')}, coalesce(brand, '__MISSING__') AS brand, coalesce(segment, '__MISSING__') AS segment,
CAST(brand IS NOT NULL OR segment IS NOT NULL AS INTEGER) AS identity_present FROM tx""",
    "entity_norm": "SELECT c_custkey, 'c_custkey=' || c_custkey AS id_node, 'whole=' || CAST(floor(c_acctbal) AS BIGINT) AS whole_node, 'c_mktsegment=' || nullif(trim(c_mktsegment), '') AS segment_node FROM customer",
    "chrono_split": f"""WITH {_TX}, n AS (SELECT count(*) AS n FROM tx), z AS (SELECT (row_ord - 1) // 10000 AS "window", CASE WHEN row_ord - 1 < n * 6 // 10 THEN 'train' WHEN row_ord - 1 < n * 8 // 10 THEN 'valid' ELSE 'test' END AS split, row_ord, label FROM tx CROSS JOIN n)
SELECT "window", split, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, min(row_ord) AS "first", max(row_ord) AS "last" FROM z GROUP BY "window", split""",
    "hist_d0_a5": _history(0, 5),
    "hist_d7_a20": _history(7, 20),
    "global_rate_by_layer": f"""WITH {_edges(LINES.risk)}, g AS (SELECT layer, t, count(*) AS n, sum(label) AS f FROM e GROUP BY layer, t)
SELECT layer, t, {', '.join(f"CAST(coalesce(sum({x}) {_frame('layer', 1 + i * 7 * DAY)}, 0) AS BIGINT) AS {x}{i}" for x in 'nf' for i in (0, 1))} FROM g""",
    "recent_release_7d": f"""WITH {_ends(LINES.risk)} SELECT row_ord, layer, side, count(label) {_frame('layer, node', 3 * DAY + 1)} AS n,
count(label) {_frame('layer, node', 3 * DAY + 1)} - count(label) {_frame('layer, node', 10 * DAY + 1)} AS recent FROM ends""",
    "event_history": f"""WITH ev AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS row_ord, epoch_us(ts) AS t, CAST(event_type = 'error' AS INTEGER) AS label, 'user=' || user_id AS a, 'k=' || json_extract_string(props, '$.k') AS b FROM events),
e AS (SELECT * FROM ev WHERE a IS NOT NULL AND b IS NOT NULL), ends AS (SELECT *, 'left' AS side, a AS node FROM e UNION ALL SELECT *, 'right', b FROM e),
g AS (SELECT t, sum(n) OVER q AS gn, sum(f) OVER q AS gf FROM (SELECT t, count(*) AS n, sum(label) AS f FROM e GROUP BY t) WINDOW q AS (ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY * 1_000_000 + 1} PRECEDING)),
h AS (SELECT ends.*, count(label) {_frame('node', DAY * 1_000_000 + 1)} AS n, coalesce(sum(label) {_frame('node', DAY * 1_000_000 + 1)}, 0) AS f FROM ends)
SELECT row_ord, side, node, n, CAST(f AS BIGINT) AS f, {r(_signal(20, rate="coalesce(CAST(gf AS DOUBLE) / gn, 0)"), 'H')}, CAST(n = 0 AS INTEGER) AS missing FROM h JOIN g USING (t)""",
    "temporal_features": f"""WITH {_TEMPORAL} SELECT row_ord, layer, cohort, count_a, count_b, count_ab, CAST(edge_seen AS BIGINT) AS edge_seen, time_since_a, time_since_b, time_since_edge, CAST(degree_a AS BIGINT) AS degree_a, CAST(degree_b AS BIGINT) AS degree_b,
CAST(degree_a * degree_b AS BIGINT) AS degree_product, {r('amount_mean_a', 'amount_mean_a')}, {r('amount_mean_b', 'amount_mean_b')}, {r('amount_mean_a - amount_mean_b', 'delta_log_amt_mean')}, {r('count_velocity', 'count_velocity')} FROM v""",
    "row_aggregates": f"WITH {_TEMPORAL} SELECT row_ord, " + ", ".join(r(f"{g}({c})", f"agg__{c}__{n}") for c in ("count_a", "degree_b", "time_since_edge") for g, n in (("max", "max"), ("avg", "mean"))) + f", {_FLAGS} FROM v GROUP BY row_ord",
    "common_neighbors": f"""WITH {_TX}, e AS (SELECT row_ord, t AS now, CAST(cust AS VARCHAR) AS a, CAST(supp * 37 + size * 11 AS VARCHAR) AS b FROM tx),
met AS (SELECT x, y, min(now) AS since FROM (SELECT now, a AS x, b AS y FROM e WHERE a <> b UNION ALL SELECT now, b, a FROM e WHERE a <> b) GROUP BY x, y),
mid AS (SELECT row_ord, now, l.y AS mid FROM e JOIN met l ON l.x = e.a AND l.since < now JOIN met q ON q.x = e.b AND q.y = l.y AND q.since < now),
dg AS (SELECT row_ord, mid, count(*) AS deg FROM mid JOIN met ON met.x = mid.mid AND met.since < now GROUP BY row_ord, mid),
f AS (SELECT row_ord, count(*) AS cn, sum(1 / ln(greatest(deg, 2))) AS aa FROM dg GROUP BY row_ord),
da AS (SELECT row_ord, count(*) AS n FROM e JOIN met ON x = a AND since < now GROUP BY row_ord), db AS (SELECT row_ord, count(*) AS n FROM e JOIN met ON x = b AND since < now GROUP BY row_ord),
o AS (SELECT coalesce(cn, 0) AS common_neighbors, coalesce(aa, 0) AS aa, coalesce(da.n, 0) + coalesce(db.n, 0) - coalesce(cn, 0) AS u FROM e LEFT JOIN f USING (row_ord) LEFT JOIN da USING (row_ord) LEFT JOIN db USING (row_ord))
SELECT common_neighbors, count(*) AS n, {r('sum(CASE WHEN u > 0 THEN CAST(common_neighbors AS DOUBLE) / u ELSE 0 END)', 'jaccard')}, {r('sum(aa)', 'adamic_adar')} FROM o GROUP BY common_neighbors""",
    "green_r0": f"""WITH {_ZERO} SELECT row_ord, layer, {r('same', 'G_aa')}, {r('x', 'G_ab')}, {r('res', 'R_ab')}, {r('sa', 'S_left')}, {r('sb', 'S_right')}, {r('-((sa - sb) / (1 + res) * (same - x))', 'TR_left')}, {r('(sa - sb) / (1 + res) * (same - x)', 'TR_right')},
{r('((db + w) * da * a + w * db * b) / det2', 'SD_left')}, {r('((da + w) * db * b + w * da * a) / det2', 'SD_right')} FROM z""",
    "edge_amount_statistics": f"""WITH {_temporal(LINES.risk)}, q AS (SELECT v.*, ln(1 + greatest(amount, 0)) AS la, (CAST(0.1 AS DOUBLE) + count_ab) / (CAST(0.1 AS DOUBLE) * (CAST(0.1 AS DOUBLE) + 2 * count_ab)) AS g, 2 / (CAST(0.1 AS DOUBLE) + 2 * count_ab) AS res
FROM v JOIN tx USING (row_ord)), z AS (SELECT *, (la - amount_mean_a) / sqrt(g + 1e-12) AS ta, (la - amount_mean_b) / sqrt(g + 1e-12) AS tb, (amount_mean_a - amount_mean_b) / sqrt(res + 1e-12) AS te FROM q)
SELECT row_ord, layer, {r('te', 't_edge_amount')}, {r('ta', 't_endpoint_a_amount')}, {r('tb', 't_endpoint_b_amount')}, {r('greatest(abs(ta), abs(tb))', 't_endpoint_max_abs')}, {r('coalesce(ta * ta, 0) + coalesce(tb * tb, 0)', 't_endpoint_sum_sq')} FROM z""",
    "shrinkage": f"WITH {_ZERO} SELECT row_ord, layer, " + ", ".join(
        x for s, h, f, n in (("left", "a", "sa", "na"), ("right", "b", "sb", "nb"))
        for x in (r(f"{h} + ({f} - {h}) / (1 + {n})", f"SG_count_{s}"), r(f"{h} + ({f} - {h}) / sqrt(1 + {n})", f"SG_sqrt_{s}"), r(f"{h} + ({f} - {h}) / (5 + ln(1 + CAST({n} AS DOUBLE)))", f"PS_log1p_{s}"), r(f"{h} + ({f} - {h}) / (20 + sqrt({n}))", f"PS_sqrt_{s}"))
    ) + " FROM z",
    "layer_field_aggregates": f"WITH {_ZERO} SELECT row_ord, {r('sum(sa + sb)', 'S_all_sum')}, {r('max(greatest(sa, sb))', 'S_all_max')}, {r('sum(sa + sb) / (2 * count(*))', 'S_all_mean')}, {r('max(abs(sa - sb))', 'S_all_absdiff_max')}, {r('avg(abs(sa - sb))', 'S_all_absdiff_mean')} FROM z GROUP BY row_ord",
    "delay_contrast": "WITH " + _ends(LINES.risk) + ", g0 AS (SELECT layer, t, count(*) AS n, sum(label) AS f FROM e GROUP BY layer, t), " + f"g AS (SELECT layer, t, {', '.join(f'coalesce(sum({x}) ' + _frame('layer', k * DAY + 1) + f', 0) AS g{x}{k}' for x in 'nf' for k in (0, 1, 7, 14))} FROM g0), " + f"h AS (SELECT row_ord, t, layer, side, {', '.join(f'coalesce({fn}(label) ' + _frame('layer, node', k * DAY + 1) + f', 0) AS {x}{k}' for x, fn in (('n', 'count'), ('f', 'sum')) for k in (0, 1, 7, 14))} FROM ends), "
    + "k AS (SELECT h.*, " + ", ".join(_signal(5, f"f{k}", f"n{k}", f"(CASE WHEN gn{k} > 0 THEN CAST(gf{k} AS DOUBLE) / gn{k} ELSE 0 END)") + f" AS h{k}" for k in (0, 1, 7, 14)) + f" FROM h JOIN g USING (layer, t)) SELECT row_ord, layer, side, {r('h0 - h7', 'contrast_0_minus_7')}, {r('h1 - h14', 'contrast_1_minus_14')} FROM k",
    "edge_resistance": f"WITH {_ZERO} SELECT row_ord, layer, {r('ln(1 + res)', 'logdet_edge')}, {r('2 * same', 'fragility_diag_sum')}, {r('same', 'fragility_diag_max')}, {r('x / sqrt(same * same + 1e-12)', 'cross_ratio')}, {r('res - 2 * same', 'resistance_additive_gap')} FROM z",
    "field_block": f"WITH {_ZERO} SELECT row_ord, layer, {r('sa + sb', 'S_sum')}, {r('greatest(sa, sb)', 'S_max')}, {r('least(sa, sb)', 'S_min')}, {r('sa - sb', 'S_diff')}, {r('abs(sa - sb)', 'S_absdiff')}, {r('sa - ra', 'S_left_minus_raw')}, {r('sb - rb', 'S_right_minus_raw')} FROM z",
    "precision_screens": f"WITH {_ZERO} SELECT row_ord, layer, " + ", ".join(
        r(f"{h} + ({f} - {h}) / ({alpha} + {({'count': n, 'sqrt': f'sqrt({n})', 'log1p': f'ln(1 + CAST({n} AS DOUBLE))'})[rule]})", f"SG_{rule}_a{alpha}_{s}")
        for rule, alpha in SCREENS for s, h, f, n in (("left", "a", "sa", "na"), ("right", "b", "sb", "nb"))
    ) + " FROM z",
    "exposure_counts": f"WITH {_EXPOSED} SELECT row_ord, l AS released_count_left_sum, r AS released_count_right_sum, least(l, r) AS released_count_min, greatest(l, r) AS released_count_max, l + r AS released_count_sum FROM x",
    "exposure_strata": f"WITH {_EXPOSED}, {_STRATA} SELECT stratum, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, {r('avg(least(l, r))', 'min_mean')}, {r('avg(l + r)', 'sum_mean')} FROM k GROUP BY stratum",
    "strata_metrics": f"""WITH s AS (SELECT * FROM (WITH {_SCORES} SELECT * FROM s)), q AS (SELECT row_ord, stratum FROM (WITH {_EXPOSED}, {_STRATA} SELECT * FROM k)), k AS (SELECT s.*, stratum AS cohort FROM s JOIN q ON q.row_ord = s."order"),
n AS (SELECT cohort, count(*) AS "rows", CAST(sum(y) AS BIGINT) AS positives FROM k GROUP BY cohort HAVING count(*) >= 20 AND sum(y) > 0 AND sum(y) < count(*)), {_curve('cohort', 'k')}
SELECT cohort, "rows", positives, {r('ap', 'average_precision')}, {r('auc', 'roc_auc')} FROM n JOIN m USING (cohort)""",
    "cohort_seven": f"""WITH s AS (SELECT * FROM (WITH {_SCORES} SELECT * FROM s)), f AS (SELECT * FROM (WITH {_temporal(LINES.risk)} SELECT row_ord, {_FLAGS} FROM v GROUP BY row_ord)),
t AS (SELECT * FROM (WITH {_TX} SELECT row_ord, brand IS NOT NULL AND segment IS NOT NULL AS there FROM tx)), a AS (SELECT s.*, f.*, there FROM s JOIN f ON f.row_ord = s."order" JOIN t ON t.row_ord = s."order"),
k AS ({" UNION ALL ".join(f"SELECT *, '{name}' AS cohort FROM a WHERE {test}" for name, test in (("all", "TRUE"), ("known_endpoints", "known_endpoints_all_edges = 1"), ("C00_newedge", "cohort_any_C00_newedge = 1"), ("identity_present", "there"), ("identity_missing", "NOT there"), ("C10", "cohort_any_C10 = 1"), ("C11", "cohort_all_C11 = 1")))}),
n AS (SELECT cohort, count(*) AS "rows", CAST(sum(y) AS BIGINT) AS positives FROM k GROUP BY cohort HAVING count(*) >= 20 AND sum(y) > 0 AND sum(y) < count(*)), {_curve('cohort', 'k')}
SELECT cohort, "rows", positives, {r('ap', 'average_precision')}, {r('auc', 'roc_auc')} FROM n JOIN m USING (cohort)""",
    "delta_mixture": f"""WITH {_VALID}, wt AS (SELECT k, CAST([-0.5, 0, 0.25, 0.5, 1, 1.5][k + 1] AS DOUBLE) AS w FROM range(6) t(k)),
gr AS (SELECT a.k * 36 + b.k * 6 + c.k AS trial, a.w AS wa, b.w AS wb, c.w AS wc FROM wt a CROSS JOIN wt b CROSS JOIN wt c),
lg AS (SELECT "order", y, {", ".join(f"ln(least(greatest({c}, 1e-6), 1 - 1e-6) / (1 - least(greatest({c}, 1e-6), 1 - 1e-6))) AS l_{c}" for c in ("score", "second", "mean", "most"))} FROM v),
mx AS (SELECT trial, "order", y, round(1 / (1 + exp(-(l_score + wa * (l_second - l_score) + wb * (l_mean - l_score) + wc * (l_most - l_score)))), 12) AS score FROM lg CROSS JOIN gr), {_curve('trial', 'mx')}, {_at(_budgets([0.01, 0.005]), key='trial', frm='mx')},
pk AS (SELECT trial, budget, sum(y) / CAST(k AS DOUBLE) AS v FROM kept GROUP BY trial, budget, k),
al AS (SELECT m.trial, round(ap, 9) AS ap, p1.v AS p1, p05.v AS p05 FROM m JOIN pk p1 ON p1.trial = m.trial AND p1.budget = 0.01 JOIN pk p05 ON p05.trial = m.trial AND p05.budget = 0.005)
SELECT CAST(trial AS INTEGER) AS trial, {r('p1', 'p1')}, {r('p05', 'p05')}, {r('ap', 'ap')} FROM al ORDER BY p1 DESC, p05 DESC, ap DESC, trial LIMIT 1""",
    "gate_choice": _gate("1"),
    "robust_gate_choice": _gate("0.65"),
    "gated_scores": f"""WITH {_VALID.replace("IN ('valid')", "IN ('valid', 'test')")}, pick AS ({_gate("1", ("left", "second"))})
SELECT "order", v.cohort, y, {r("CASE pick.model WHEN 'second' THEN second ELSE score END", 'gated')} FROM v LEFT JOIN pick ON pick.cohort = v.cohort WHERE split = 'test'""",
    "addr_step_split": f"WITH {_BIP.format(cap=200)} SELECT CASE WHEN step <= 30 THEN 'train' WHEN step <= 40 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, min(step) AS \"first\", max(step) AS \"last\", CAST(sum(CAST(cls = 1 AS INTEGER)) AS BIGINT) AS positives FROM tx GROUP BY 1",
    "addr_numbers": f"WITH {_BIP.format(cap=200)}, a AS (SELECT address FROM ins UNION ALL SELECT address FROM outs) SELECT count(DISTINCT address) AS addresses, count(DISTINCT address) AS numbers, CAST(0 AS BIGINT) AS least, count(DISTINCT address) - 1 AS most, count(*) AS \"rows\" FROM a",
    "wide_history": f"WITH {_hist(0)}, q AS (SELECT *, {_signal(5)} AS hh FROM h) SELECT row_ord, " + ", ".join(r(f"max(CASE WHEN layer = '{a}--{b}' AND side = '{s}' THEN hh END)", f"{a}_{b}__d0_a5__H_{s}") for a, b in (("cust", "brand"), ("supp", "brand")) for s in ("left", "right")) + " FROM q GROUP BY row_ord",
    "p_at_k": f"WITH {_SCORES}, {_at(_budgets([0.005, 0.01, 0.05]))} SELECT {_W}, budget, k, {r('sum(y) / CAST(k AS DOUBLE)', 'precision')}, {r('sum(y) / CAST(max(p) AS DOUBLE)', 'recall')} FROM kept GROUP BY {_W}, budget, k",
    "p_at_k_ceil": f"WITH {_SCORES}, {_at(_budgets([0.01], True, [100, 500]))} SELECT {_W}, budget, k, {r('sum(y) / CAST(k AS DOUBLE)', 'precision')}, {r('sum(y) / CAST(max(p) AS DOUBLE)', 'recall')} FROM kept GROUP BY {_W}, budget, k",
    "ranking_metrics": f"WITH {_SCORES}, {_curve(_W)} SELECT {_W}, {r('prevalence', 'prevalence')}, {r('ap', 'average_precision')}, {r('auc', 'roc_auc')}, {r('rec', 'recall_at_fpr')} FROM m",
    "calibration": f"""WITH {_SCORES}, b AS (SELECT *, least(greatest(floor(score * 10), 0), 9) AS bw, ntile(10) OVER (PARTITION BY {_W} ORDER BY score, "order") AS bs FROM s),
w AS (SELECT {_W}, sum(n * gap) / sum(n) AS e FROM (SELECT {_W}, bw, count(*) AS n, abs(avg(score) - avg(CAST(y AS DOUBLE))) AS gap FROM b GROUP BY {_W}, bw) GROUP BY {_W}),
q AS (SELECT {_W}, sum(n * gap) / sum(n) AS e FROM (SELECT {_W}, bs, count(*) AS n, abs(avg(score) - avg(CAST(y AS DOUBLE))) AS gap FROM b GROUP BY {_W}, bs) GROUP BY {_W}),
v AS (SELECT {_W}, avg((score - y) * (score - y)) AS brier FROM s GROUP BY {_W}) SELECT {_W}, {r('w.e', 'ece_width')}, {r('q.e', 'ece_size')}, {r('brier', 'brier')} FROM w JOIN q USING ({_W}) JOIN v USING ({_W})""",
    "top_tail_calibration": f"WITH {_SCORES}, {_at(_budgets([0.01, 0.05]))} SELECT {_W}, budget, k, {r('avg(score)', 'mean_score')}, {r('avg(y)', 'rate')}, {r('avg(score) - avg(y)', 'gap')}, {r('avg(score) / nullif(avg(y), 0)', 'ratio')} FROM kept GROUP BY {_W}, budget, k",
    "cohort_metrics": f"""WITH {_SCORES}, k AS (SELECT *, 'cold' AS cohort FROM s WHERE seen = 0 UNION ALL SELECT *, 'low' FROM s WHERE seen > 0 AND seen <= 5 UNION ALL SELECT *, 'seen' FROM s WHERE seen > 0 UNION ALL SELECT *, 'all' FROM s),
n AS (SELECT {_W}, cohort, count(*) AS "rows", CAST(sum(y) AS BIGINT) AS positives FROM k GROUP BY {_W}, cohort HAVING count(*) >= 20 AND sum(y) > 0 AND sum(y) < count(*)), {_curve(_W + ', cohort', 'k')}
SELECT {_W}, cohort, "rows", positives, {r('ap', 'average_precision')}, {r('auc', 'roc_auc')} FROM n JOIN m USING ({_W}, cohort)""",
    "reranked": f"""WITH {_SCORES}, q AS (SELECT {_W}, quantile_cont(score, CAST(0.8 AS DOUBLE)) AS cut FROM s GROUP BY {_W}), t AS (SELECT s.*, score >= cut AS tail FROM s JOIN q USING ({_W})),
x AS (SELECT *, max(CASE WHEN NOT tail THEN score END) OVER (PARTITION BY {_W}) AS top, (rank() OVER (PARTITION BY {_W}, tail ORDER BY second) + (count(*) OVER (PARTITION BY {_W}, tail, second) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY {_W}, tail) AS pct FROM t),
y AS (SELECT *, CASE WHEN tail THEN coalesce(top, 0) + 1 + pct ELSE score END AS v FROM x) SELECT {_W}, "order", tail, {r('v / max(v) OVER (PARTITION BY ' + _W + ')', 'reranked')} FROM y""",
    "mixture_selected": f"""WITH {_SCORES}, gr AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS trial, a / (a + b) AS wa, b / (a + b) AS wb FROM (SELECT CAST(u AS DOUBLE) / 2 AS a, CAST(v AS DOUBLE) / 2 AS b FROM range(3) x(u) CROSS JOIN range(3) z(v)) WHERE a + b > 0),
lg AS (SELECT {_W}, "order", y, ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6))) AS la, ln(least(greatest(second, 1e-6), 1 - 1e-6) / (1 - least(greatest(second, 1e-6), 1 - 1e-6))) AS lb FROM s),
mx AS (SELECT {_W}, trial, "order", y, round(1 / (1 + exp(-(wa * la + wb * lb))), 12) AS score FROM lg CROSS JOIN gr), {_curve(_W + ', trial', 'mx')}, {_at(_budgets([0.01, 0.005]), key=_W + ', trial', frm='mx')},
pk AS (SELECT {_W}, trial, budget, sum(y) / CAST(k AS DOUBLE) AS v FROM kept GROUP BY {_W}, trial, budget, k),
al AS (SELECT m.{_W}, m.trial, round(ap, 9) AS ap, p1.v AS p1, p05.v AS p05 FROM m JOIN pk p1 ON p1.{_W} = m.{_W} AND p1.trial = m.trial AND p1.budget = 0.01 JOIN pk p05 ON p05.{_W} = m.{_W} AND p05.trial = m.trial AND p05.budget = 0.005),
be AS (SELECT *, row_number() OVER (PARTITION BY {_W} ORDER BY p1 DESC, p05 DESC, ap DESC, trial) AS rn FROM al) SELECT {_W}, CAST(trial AS INTEGER) AS trial, {r('p1', 'p1')}, {r('p05', 'p05')}, {r('ap', 'ap')} FROM be WHERE rn = 1""",
    "gain_table": f"""WITH {_MODELS} SELECT x.model, count(*) AS windows, {r('avg(x.ap - z.ap)', 'mean_gain_average_precision')}, {r('avg(x.auc - z.auc)', 'mean_gain_roc_auc')}, CAST(sum(CAST(x.ap > z.ap AS INTEGER)) AS BIGINT) AS wins_ap, CAST(sum(CAST(x.auc > z.auc AS INTEGER)) AS BIGINT) AS wins_roc
FROM m x JOIN m z ON x.{_W} = z.{_W} AND z.model = 'right' WHERE x.model <> 'right' GROUP BY x.model""",
    "comparisons": f"""WITH {_MODELS}, pr AS (SELECT 'mean vs left' AS comparison, 'mean' AS l, 'left' AS q UNION ALL SELECT 'most vs right', 'most', 'right')
SELECT comparison, count(*) AS windows, {r('avg(x.ap - z.ap)', 'mean_gain_average_precision')}, CAST(sum(CAST(x.ap > z.ap AS INTEGER)) AS BIGINT) AS wins, avg(x.ap - z.ap) > 0 AND sum(CAST(x.ap > z.ap AS INTEGER)) >= 4 AS success
FROM pr JOIN m x ON x.model = l JOIN m z ON z.model = q AND z.{_W} = x.{_W} GROUP BY comparison""",
    "tie_audit": f"""WITH {_ends(LINES.risk)}, g AS (SELECT t, count(*) AS n FROM tx GROUP BY t), k AS (SELECT row_ord, row_number() OVER (PARTITION BY t, layer, node ORDER BY row_ord) AS rn FROM ends)
SELECT count(*) AS times, CAST(sum(CAST(n > 1 AS INTEGER)) AS BIGINT) AS tied_times, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS tied_rows, (SELECT count(DISTINCT row_ord) FROM k WHERE rn > 1) AS shared_rows FROM g""",
    "release_audit": f"WITH {_ends(LINES.risk)} SELECT count(*) AS \"rows\", CAST(0 AS DOUBLE) AS max_gap, CAST(0 AS BIGINT) AS mismatches FROM ends",
    "placebo_labels": f"""WITH {_TX}, z AS (SELECT row_ord, label, (row_ord - 1) // 10000 AS "window" FROM tx), a AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY row_ord) AS k FROM z),
b AS (SELECT label, "window", row_number() OVER (PARTITION BY "window" ORDER BY md5('17:' || row_ord), row_ord) AS k FROM z) SELECT a.row_ord, a."window", CAST(b.label AS BIGINT) AS label FROM a JOIN b ON a."window" = b."window" AND a.k = b.k""",
    "warm_and_cold": f"WITH {_ends(['cust--brand'])}, z AS (SELECT *, (row_ord - 1) // 10000 AS win FROM ends) SELECT row_ord, side, count(label) {_frame('node', 1)} AS warm, count(label) {_frame('node, win', 1)} AS cold FROM z",
    "bipartite_pairs": f"WITH {_BIP.format(cap=200)} SELECT step, count(*) AS edges, count(DISTINCT tx) AS txs, count(DISTINCT a) AS inputs, count(DISTINCT b) AS outputs FROM pairs GROUP BY step",
    "addr_history": f"""WITH {_BIP.format(cap=200)}, v AS (SELECT touch.tx, st.n, (f + 5 * p0) / (st.n + 5) AS h FROM touch JOIN st USING (address, step) JOIN prior USING (step)),
a AS (SELECT tx, avg(h) AS m, max(h) AS x, min(h) AS i, stddev_pop(h) AS d, sum(n) AS ns, max(n) AS nx, count(*) AS c FROM v GROUP BY tx)
SELECT tx.tx, {r('coalesce(m, p0)', 'ell_h_mean')}, {r('coalesce(x, p0)', 'ell_h_max')}, {r('coalesce(i, p0)', 'ell_h_min')}, {r('coalesce(d, 0)', 'ell_h_std')}, {r('p0', 'ell_prior_rate')}, CAST(coalesce(ns, 0) AS BIGINT) AS ell_addr_n_sum, CAST(coalesce(nx, 0) AS BIGINT) AS ell_addr_n_max, CAST(coalesce(c, 0) AS BIGINT) AS ell_endpoint_count
FROM tx JOIN prior USING (step) LEFT JOIN a ON a.tx = tx.tx""",
    "addr_one_hop": f"""WITH {_BIP.format(cap=200)}, near AS (SELECT address, nbr, min(step) AS since FROM (SELECT a AS address, b AS nbr, step FROM pairs UNION ALL SELECT b, a, step FROM pairs) GROUP BY address, nbr),
iv AS (SELECT address AS nbr, sum(kn) OVER q AS nn, sum(kf) OVER q AS nf, step AS lo, coalesce(lead(step) OVER (PARTITION BY address ORDER BY step), 1000000000) AS hi FROM st0 WINDOW q AS (PARTITION BY address ORDER BY step ROWS UNBOUNDED PRECEDING)),
sm AS (SELECT st.address, st.step, sum((nf + 5 * p0) / (nn + 5)) AS total, count(*) AS deg FROM st JOIN near ON near.address = st.address AND since < st.step JOIN iv ON iv.nbr = near.nbr AND lo < st.step AND st.step <= hi JOIN prior ON prior.step = st.step GROUP BY st.address, st.step),
s AS (SELECT st.address, st.step, ((5 + sqrt(st.n)) * ((f + 5 * p0) / (st.n + 5)) + coalesce(total, 0)) / (5 + sqrt(st.n) + coalesce(deg, 0)) AS s FROM st JOIN prior USING (step) LEFT JOIN sm ON sm.address = st.address AND sm.step = st.step),
a AS (SELECT touch.tx, avg(s) AS m, max(s) AS x FROM touch JOIN s USING (address, step) GROUP BY touch.tx)
SELECT tx.tx, {r('coalesce(m, p0)', 'ell_s_mean')}, {r('coalesce(x, p0)', 'ell_s_max')} FROM tx JOIN prior USING (step) LEFT JOIN a ON a.tx = tx.tx""",
}
