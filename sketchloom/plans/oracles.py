"""DuckDB SQL for the queries that have an exact answer."""

_EVENT_MOMENTS = """WITH m AS (SELECT event_type k, avg(value) mu, count(*) n FROM events GROUP BY 1),
c AS (SELECT event_type, any_value(n)::DOUBLE n, avg((value - mu)^2) m2, avg((value - mu)^3) m3, avg((value - mu)^4) m4 FROM events JOIN m ON k = event_type GROUP BY 1)"""

_HAZEN = """WITH r AS (SELECT user_id, value v, row_number() OVER (PARTITION BY user_id ORDER BY value) i, count(*) OVER (PARTITION BY user_id) n FROM events),
q AS (SELECT * FROM (VALUES (0.1), (0.5), (0.9)) t(q)),
a AS (SELECT user_id, q, n, greatest(1, least(n, floor(q * n + 0.5)))::BIGINT lo, q * n + 0.5 - floor(q * n + 0.5) f FROM (SELECT DISTINCT user_id, n FROM r), q),
z AS (SELECT a.user_id, a.q, x.v + a.f * (y.v - x.v) v FROM a JOIN r x ON x.user_id = a.user_id AND x.i = a.lo JOIN r y ON y.user_id = a.user_id AND y.i = least(a.n, a.lo + 1))"""

#: Points of the distribution function: (min, 0), the last of equal values at (i - 1/2), (max, n).
_CDF = """WITH r AS (SELECT user_id, value v, row_number() OVER (PARTITION BY user_id ORDER BY value) i, count(*) OVER (PARTITION BY user_id) n FROM events),
p AS (SELECT user_id, v, any_value(n) n, max(i) - 0.5 a, min(i) - 0.5 b FROM r GROUP BY 1, 2),
e AS (SELECT user_id, min(v) lo, max(v) hi, any_value(n) n FROM p GROUP BY 1),
x AS (SELECT * FROM (VALUES {xs}) t(x)),
l AS (SELECT e.user_id, x, lo, hi, e.n, max(p.v) lv, max_by(p.a, p.v) la FROM e, x LEFT JOIN p ON p.user_id = e.user_id AND p.v <= x GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT e.user_id, x, min(p.v) rv, min_by(p.b, p.v) ra FROM e, x LEFT JOIN p ON p.user_id = e.user_id AND p.v > x GROUP BY 1, 2),
c AS (SELECT l.user_id, l.x, l.n, CASE WHEN l.x >= hi THEN 1.0 WHEN l.x <= lo THEN 0.0 ELSE (la + (ra - la) * (l.x - lv) / (rv - lv)) / l.n END c FROM l JOIN g ON g.user_id = l.user_id AND g.x = l.x)"""


def _top(src: str, item: str, k: int, key: str = "", n: str = "count(*)") -> str:
    inner = f"SELECT {key + ', ' if key else ''}{item} AS item, {n} AS c FROM {src} GROUP BY ALL"
    return f"SELECT {key + ', ' if key else ''}item, CAST(c AS BIGINT) AS \"count\", CAST(0 AS BIGINT) AS error FROM ({inner}) QUALIFY row_number() OVER ({'PARTITION BY ' + key + ' ' if key else ''}ORDER BY c DESC, item) <= {k}"


ORACLES: dict[str, str] = {
    "stats_basic_by_event": "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "stats_max_negative": "SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer WHERE c_acctbal < 0 GROUP BY 1",
    "stats_variance": """SELECT l_returnflag, l_linestatus, round(var_pop(l_discount), 9) AS var0, round(var_samp(l_discount), 9) AS var1, round(var_pop(l_discount) * count(*) / (count(*) - 2), 9) AS var2,
 round(stddev_pop(l_discount), 9) AS std0, round(stddev_samp(l_discount), 9) AS std1, round(sqrt(var_pop(l_discount) * count(*) / (count(*) - 2)), 9) AS std2 FROM lineitem GROUP BY 1, 2""",
    "stats_skewness": f"{_EVENT_MOMENTS} SELECT event_type, round(m3 / m2^1.5, 6) AS skew_biased, round(m3 / m2^1.5 * sqrt(n * (n - 1)) / (n - 2), 6) AS skew_unbiased FROM c",
    "stats_kurtosis": f"{_EVENT_MOMENTS} SELECT event_type, round(m4 / m2^2 - 3, 6) AS fisher, round(m4 / m2^2, 6) AS pearson, round(((n * n - 1) * m4 / m2^2 - 9 * n + 15) / ((n - 2) * (n - 3)) - 3, 6) AS unbiased FROM c",
    "stats_weighted": """WITH t AS (SELECT l_returnflag k, sum(l_extendedprice) / sum(l_linenumber) mu, sum(l_linenumber) n FROM lineitem GROUP BY 1)
 SELECT l_returnflag, CAST(any_value(n) AS BIGINT) AS n, round(sum(l_extendedprice), 1) AS total, round(any_value(mu), 4) AS mean, round(sqrt(sum(l_linenumber * (l_extendedprice / l_linenumber - mu)^2) / any_value(n)), 4) AS std, max(l_extendedprice) AS hi
 FROM lineitem JOIN t ON k = l_returnflag GROUP BY 1""",
    "stats_merge_partials": """WITH m AS (SELECT l_linestatus k, avg(l_quantity) mu FROM lineitem GROUP BY 1),
 c AS (SELECT l_linestatus, count(*) n, any_value(mu) mu, avg((l_quantity - mu)^2) m2, avg((l_quantity - mu)^3) m3, avg((l_quantity - mu)^4) m4 FROM lineitem JOIN m ON k = l_linestatus GROUP BY 1)
 SELECT l_linestatus, n, round(mu, 6) AS mean, round(m2, 6) AS var0, round(m3 / m2^1.5, 6) AS skew_biased, round(m4 / m2^2 - 3, 6) AS fisher FROM c""",
    "stats_nan_skip": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std0 FROM events WHERE event_id % 7 <> 0 GROUP BY 1",
    "stats_by_window": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    "topk_exact": _top("lineitem", "l_quantity", 5, "l_returnflag"),
    "spacesaving_topk_int": _top("events", "user_id", 10),
    "spacesaving_topk_float": _top("lineitem", "l_quantity", 7, "l_returnflag"),
    "spacesaving_topk_string": _top("orders", "o_orderpriority", 3),
    "spacesaving_counters_size": "SELECT l_linestatus, count(DISTINCT l_discount) AS n_counters, CAST(20 AS INTEGER) AS capacity, count(*) AS n FROM lineitem GROUP BY 1",
    "spacesaving_weighted": _top("lineitem", "l_discount", 20, "l_returnflag", "sum(CAST(l_quantity AS BIGINT))"),
    "spacesaving_merge": _top("lineitem", "l_quantity", 64, "l_returnflag"),
    "spacesaving_merge_truncated": """WITH e AS (SELECT l_linenumber % 2 h, l_quantity item, count(*) c FROM lineitem GROUP BY 1, 2),
 s AS (SELECT h, item, c FROM e QUALIFY row_number() OVER (PARTITION BY h ORDER BY c DESC, item) <= 20),
 m AS (SELECT h, min(c) m FROM s GROUP BY 1),
 j AS (SELECT item, sum(c - m) c, sum(-m) e FROM s JOIN m USING (h) GROUP BY 1), t AS (SELECT sum(m) m FROM m)
 SELECT item, CAST(c + m AS BIGINT) AS "count", CAST(e + m AS BIGINT) AS error FROM j, t QUALIFY row_number() OVER (ORDER BY c + m DESC, e + m, item) <= 20""",
    "tdigest_quantile_user": f"{_HAZEN} SELECT user_id, round(max(v) FILTER (q = 0.1), 6) AS q10, round(max(v) FILTER (q = 0.5), 6) AS q50, round(max(v) FILTER (q = 0.9), 6) AS q90 FROM z GROUP BY 1",
    "tdigest_cdf_user": _CDF.format(xs="(20.0), (50.0), (100.0)") + " SELECT user_id, round(max(c) FILTER (x = 20), 6) AS c20, round(max(c) FILTER (x = 50), 6) AS c50, round(max(c) FILTER (x = 100), 6) AS c100 FROM c GROUP BY 1",
    "tdigest_minmaxsize": "SELECT user_id, min(value) AS lo, max(value) AS hi, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1",
    "tdigest_histogram_user": _CDF.format(xs="(0.0), (50.0), (100.0), (150.0), (200.0)") + " SELECT a.user_id, CAST(a.x / 50 AS BIGINT) AS bin, round((b.c - a.c) * a.n, 5) AS w FROM c a JOIN c b ON b.user_id = a.user_id AND b.x = a.x + 50",
    "tdigest_centroids_user": "SELECT user_id, round(value, 6) AS mean, CAST(1 AS DOUBLE) AS weight FROM events",
    "tdigest_scale": f"{_HAZEN} SELECT user_id, any_value(n) * 2.5::DOUBLE AS n, round(max(v), 6) AS q50, any_value(hi) AS hi FROM (SELECT user_id, v FROM z WHERE q = 0.5) JOIN (SELECT user_id, count(*) n, max(value) hi FROM events GROUP BY 1) USING (user_id) GROUP BY 1",
    "tdigest_merge_user": f"{_HAZEN} SELECT user_id, CAST(any_value(n) AS DOUBLE) AS n, round(max(v), 6) AS q50 FROM (SELECT user_id, v FROM z WHERE q = 0.5) JOIN (SELECT user_id, count(*) n FROM events GROUP BY 1) USING (user_id) GROUP BY 1",
    "tdigest_part": "SELECT l_partkey, round(median(l_extendedprice), 4) AS q50 FROM lineitem GROUP BY 1",
    "tdigest_rollup": "SELECT event_type, CAST(count(*) AS DOUBLE) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1",
}
