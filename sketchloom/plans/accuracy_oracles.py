"""DuckDB SQL for the queries in ``accuracy``."""

from sketchloom.plans.oracles import _EVENT_MOMENTS, _HAZEN, _top

_PROBES = "(VALUES (0.001), (0.01), (0.1), (0.3), (0.5), (0.7), (0.9), (0.99), (0.999)) t(p)"


def _within(key: str) -> str:
    return f"SELECT {key}, CAST(p AS DOUBLE) AS q, true AS quantile_ok, true AS cdf_ok FROM (SELECT DISTINCT {key} FROM lineitem), {_PROBES}"


#: The quantile of weighted points that all stay apart, as in the unweighted case but with half of each point's weight.
_WEIGHTED = """WITH p AS (SELECT l_partkey k, l_extendedprice x, CAST(sum(l_linenumber) AS DOUBLE) w FROM lineitem GROUP BY 1, 2),
c AS (SELECT k, x, w, sum(w) OVER (PARTITION BY k ORDER BY x) - w / 2 m, sum(w) OVER (PARTITION BY k) n FROM p),
g AS (SELECT k, x, m, n, coalesce(lag(m) OVER (PARTITION BY k ORDER BY x), 0) pm, coalesce(lag(x) OVER (PARTITION BY k ORDER BY x), x) px FROM c),
v AS (SELECT k, q, any_value(n) n, coalesce(max(px + (x - px) * (q * n - pm) / (m - pm)) FILTER (m >= q * n AND pm < q * n), max(x)) v FROM g, (VALUES (0.25), (0.5), (0.75)) t(q) GROUP BY 1, 2)"""

_FORMS = """WITH r AS (SELECT user_id, value v, row_number() OVER (PARTITION BY user_id ORDER BY value) i, count(*) OVER (PARTITION BY user_id) n FROM events),
p AS (SELECT user_id, v, max(i) - 0.5 a, min(i) - 0.5 b FROM r GROUP BY 1, 2),
e AS (SELECT user_id, min(v) lo, max(v) hi, any_value(n) n FROM r GROUP BY 1),
x AS (SELECT user_id, 'default' form, i, CASE WHEN i = 3 THEN hi ELSE lo + (hi - lo) * i / 3 END x, lo, hi, n FROM e, range(0, 4) t(i)
 UNION ALL SELECT user_id, 'edges', i, [-1000.0, 50.0, 50.0, 100000.0][i + 1], lo, hi, n FROM e, range(0, 4) t(i)
 UNION ALL SELECT user_id, 'outside', i, -5.0 + i, lo, hi, n FROM e, range(0, 3) t(i)),
l AS (SELECT x.user_id, form, i, x, lo, hi, n, max(p.v) lv, max_by(p.a, p.v) la FROM x LEFT JOIN p ON p.user_id = x.user_id AND p.v <= x.x GROUP BY ALL),
g AS (SELECT x.user_id, form, i, min(p.v) rv, min_by(p.b, p.v) ra FROM x LEFT JOIN p ON p.user_id = x.user_id AND p.v > x.x GROUP BY ALL),
c AS (SELECT l.user_id, l.form, l.i, l.x, l.n, CASE WHEN l.x >= hi THEN 1.0 WHEN l.x <= lo THEN 0.0 ELSE (la + (ra - la) * (l.x - lv) / (rv - lv)) / l.n END c FROM l JOIN g USING (user_id, form, i)),
f AS (SELECT user_id, form, min(x) first_edge, max(x) last_edge FROM c GROUP BY 1, 2)
SELECT a.user_id, a.form, CAST(a.i AS BIGINT) AS bin, round(first_edge, 5) AS first_edge, round(last_edge, 5) AS last_edge, round((b.c - a.c) * a.n, 5) AS w
FROM c a JOIN c b ON b.user_id = a.user_id AND b.form = a.form AND b.i = a.i + 1 JOIN f ON f.user_id = a.user_id AND f.form = a.form"""

_COPIES = """WITH t AS (SELECT l_returnflag k, sum(l_extendedprice * l_linenumber) / sum(l_linenumber) mu FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) n, any_value(mu) mu, max(l_extendedprice) hi, sum(l_linenumber * (l_extendedprice - mu)^2) / sum(l_linenumber) m2, sum(l_linenumber * (l_extendedprice - mu)^3) / sum(l_linenumber) m3, sum(l_linenumber * (l_extendedprice - mu)^4) / sum(l_linenumber) m4 FROM lineitem JOIN t ON k = l_returnflag GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "tdigest_bounds": _within("l_returnflag"),
    "tdigest_merge_bounds": _within("l_linestatus"),
    "tdigest_skewed_bounds": _within("l_returnflag"),
    "tdigest_folds": "SELECT l_returnflag, true AS folded, true AS sorted, CAST(count(*) AS DOUBLE) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1",
    "tdigest_weighted": f"{_WEIGHTED} SELECT k AS l_partkey, any_value(n) AS n, round(max(v) FILTER (q = 0.25), 6) AS q25, round(max(v) FILTER (q = 0.5), 6) AS q50, round(max(v) FILTER (q = 0.75), 6) AS q75 FROM v GROUP BY 1",
    "tdigest_weighted_scaled": f"{_WEIGHTED} SELECT k AS l_partkey, count(*) FILTER (w >= 3) AS n_centroids, max(w) >= 3 AS any_left, CASE WHEN max(w) >= 3 THEN min(x) ELSE -1 END AS lo, CASE WHEN max(w) >= 3 THEN max(x) ELSE -1 END AS hi FROM p GROUP BY 1",
    "tdigest_skips": "SELECT user_id, CAST(count(*) AS DOUBLE) AS n, min(value) AS lo, max(value) AS hi FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 3 <> 0 GROUP BY 1",
    "tdigest_compressions": "SELECT CAST(g AS DOUBLE) AS given, CAST(c AS DOUBLE) AS compression, true AS bounded, (SELECT CAST(count(value) AS DOUBLE) FROM events) AS n FROM (VALUES (1, 20), (20, 20), (100, 100), (1000, 1000), (5000, 1000)) t(g, c)",
    "tdigest_histogram_forms": _FORMS,
    "tdigest_small": "SELECT CAST(k AS BIGINT) AS k, CAST(n AS DOUBLE) AS n, CAST(a AS DOUBLE) AS q50, CAST(b AS DOUBLE) AS c1, CAST(c AS DOUBLE) AS lo, CAST(d AS DOUBLE) AS e0, CAST(e AS DOUBLE) AS e2, CAST(f AS DOUBLE) AS w0, CAST(g AS DOUBLE) AS w1 FROM (VALUES (0, 0, -1, -1, -1, -0.5, 0.5, 0, 0), (1, 1, 1, 0.5, 1, 0.5, 1.5, 0.5, 0.5), (2, 2, 1.5, 0, 1, 1, 2, 1, 1), (3, 0, -1, -1, -1, -0.5, 0.5, 0, 0), (4, 0, -1, -1, -1, -0.5, 0.5, 0, 0)) t(k, n, a, b, c, d, e, f, g)",
    "tdigest_stored": f"{_HAZEN} SELECT user_id, 'tdigest(compression=100.0, size=' || any_value(n) || '.0)' AS text, round(max(v), 6) AS q50 FROM (SELECT user_id, v FROM z WHERE q = 0.5) JOIN (SELECT user_id, count(*) n FROM events GROUP BY 1) USING (user_id) GROUP BY 1",
    "stats_stored": f"{_EVENT_MOMENTS} SELECT event_type, 'stats(count=' || CAST(n AS BIGINT) || ')' AS text, (SELECT round(avg(value), 6) FROM events e WHERE e.event_type = c.event_type) AS mean, round(m4 / m2^2 - 3, 6) AS fisher FROM c",
    "stats_single": "SELECT c_custkey, CAST(1 AS BIGINT) AS n, c_acctbal AS total, c_acctbal AS lo, c_acctbal AS hi, CAST(0 AS DOUBLE) AS var0, true AS var1_undefined, true AS skew_undefined, true AS kurt_undefined FROM customer",
    "stats_frequency": f"{_COPIES} SELECT l_returnflag, n, round(mu, 4) AS mean, round(sqrt(m2), 4) AS std, round(m3 / m2^1.5, 6) AS skew_biased, round(m4 / m2^2 - 3, 6) AS fisher FROM c",
    "stats_merge_weighted": f"{_COPIES} SELECT l_returnflag, n, round(mu, 4) AS mean, round(sqrt(m2), 4) AS std, round(m4 / m2^2 - 3, 6) AS fisher, hi FROM c",
    "spacesaving_bounds": "SELECT l_linenumber % 2 AS half, CAST(20 AS BIGINT) AS n_counters, true AS bounds_hold, count(*) AS n FROM lineitem GROUP BY 1",
    "spacesaving_stored": f"SELECT l_returnflag, true AS sound, 'space_saving(capacity=64, size=' || k || ')' AS text, item, \"count\", error FROM ({_top('lineitem', 'l_quantity', 3, 'l_returnflag')}) JOIN (SELECT l_returnflag, count(DISTINCT l_quantity) k FROM lineitem GROUP BY 1) USING (l_returnflag)",
    "spacesaving_unsound": "SELECT l_returnflag, state, sound FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES ('sound', true), ('repeated', false), ('too many', false)) t(state, sound)",
    "spacesaving_merge_unequal": """WITH e AS (SELECT l_linenumber % 2 h, l_quantity item, count(*) c FROM lineitem GROUP BY 1, 2),
 s AS (SELECT h, item, c FROM e QUALIFY row_number() OVER (PARTITION BY h ORDER BY c DESC, item) <= CASE h WHEN 0 THEN 20 ELSE 30 END),
 m AS (SELECT h, min(c) m FROM s GROUP BY 1),
 j AS (SELECT item, sum(c - m) c, sum(-m) e FROM s JOIN m USING (h) GROUP BY 1), t AS (SELECT sum(m) m FROM m)
 SELECT CAST(30 AS INTEGER) AS capacity, item, CAST(c + m AS BIGINT) AS "count", CAST(e + m AS BIGINT) AS error FROM j, t QUALIFY row_number() OVER (ORDER BY c + m DESC, e + m, item) <= 30""",
    "spacesaving_in_order": "SELECT l_linenumber % 2 AS half, l_quantity AS item, count(*) AS \"count\", CAST(0 AS BIGINT) AS error FROM lineitem GROUP BY 1, 2",
}
