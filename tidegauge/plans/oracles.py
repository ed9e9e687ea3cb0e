"""SQL that states the registered queries' results over the same tables."""

from __future__ import annotations

from tidegauge.functions.special import chi2_ppf, kolmogorov_ppf

#: Events in their role; b is the baseline, l is live, s adds slices, f is the long form.
BASE = """
p AS (SELECT event_id AS id, ts, value, CAST(props->>'$.k' AS DOUBLE) AS k, CAST(user_id % 6 AS VARCHAR) AS user_group, event_type, value / (value + 50) AS score, date_trunc('day', ts) AS w FROM events),
sl AS (SELECT *, CAST(NULL AS VARCHAR) AS d, CAST(NULL AS VARCHAR) AS v FROM p UNION ALL SELECT *, 'event_type', event_type FROM p WHERE event_type IS NOT NULL),
lf AS (
  SELECT id, ts, w, d, v, 'value' AS f, value AS num, CAST(NULL AS VARCHAR) AS cat FROM sl WHERE value IS NOT NULL
  UNION ALL SELECT id, ts, w, d, v, 'k', k, NULL FROM sl WHERE k IS NOT NULL
  UNION ALL SELECT id, ts, w, d, v, '__prediction_score__', score, NULL FROM sl WHERE score IS NOT NULL
  UNION ALL SELECT id, ts, w, d, v, 'user_group', NULL, user_group FROM sl WHERE user_group IS NOT NULL
  UNION ALL SELECT id, ts, w, d, v, 'event_type', NULL, event_type FROM sl WHERE event_type IS NOT NULL AND d IS NULL),
q AS (SELECT f, min(num) AS lo, max(num) AS hi, quantile_cont(num, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM lf WHERE d IS NULL AND ts < TIMESTAMP '2024-01-11' AND num IS NOT NULL GROUP BY f),
edges AS (SELECT f, CASE WHEN lo = hi THEN [lo, hi] ELSE list_sort(list_distinct(list_concat([lo], q, [hi]))) END AS e FROM q),
cats AS (SELECT f, list_sort(list(DISTINCT cat)) AS c FROM lf WHERE d IS NULL AND ts < TIMESTAMP '2024-01-11' AND cat IS NOT NULL GROUP BY f),
bins AS (SELECT f, e, CAST(NULL AS VARCHAR[]) AS c, len(e) + 1 AS nb FROM edges UNION ALL SELECT f, NULL, c, len(c) + 1 FROM cats),
bk AS (SELECT lf.*, nb, CASE WHEN e IS NULL THEN coalesce(list_position(c, cat) - 1, len(c)) WHEN num = e[-1] THEN len(e) - 1 ELSE len(list_filter(e, lambda x: x <= num)) END AS bucket FROM lf JOIN bins USING (f)),
bc AS (SELECT d, v, f, bucket, count(*) AS n FROM bk WHERE ts < TIMESTAMP '2024-01-11' GROUP BY ALL),
lc AS (SELECT w, d, v, f, bucket, count(*) AS n FROM bk WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY ALL),
bn AS (SELECT d, v, f, sum(n) AS n FROM bc GROUP BY ALL), ln AS (SELECT w, d, v, f, sum(n) AS n FROM lc GROUP BY ALL),
grid AS (SELECT ln.w, ln.d, ln.v, ln.f, unnest(range(0, nb)) AS bucket, ln.n AS nl, bn.n AS nb FROM ln JOIN bins USING (f) JOIN bn ON ln.f = bn.f AND ln.d IS NOT DISTINCT FROM bn.d AND ln.v IS NOT DISTINCT FROM bn.v),
pr AS (SELECT g.w, g.d, g.v, g.f, g.nl, g.nb, coalesce(b.n, 0) AS cb, coalesce(l.n, 0) AS cl, coalesce(b.n, 0) / g.nb AS pb, coalesce(l.n, 0) / g.nl AS pl
  FROM grid g LEFT JOIN bc b ON g.f = b.f AND g.bucket = b.bucket AND g.d IS NOT DISTINCT FROM b.d AND g.v IS NOT DISTINCT FROM b.v
  LEFT JOIN lc l ON g.w = l.w AND g.f = l.f AND g.bucket = l.bucket AND g.d IS NOT DISTINCT FROM l.d AND g.v IS NOT DISTINCT FROM l.v),
psi AS (SELECT w, d, v, f, nl, nb, sum((greatest(pl, 1e-4) - greatest(pb, 1e-4)) * ln(greatest(pl, 1e-4) / greatest(pb, 1e-4))) AS x FROM pr WHERE f IN ('value', 'k') GROUP BY ALL),
jsd AS (SELECT w, d, v, f, nl, nb, sum((CASE WHEN pb > 0 THEN pb * log2(pb / ((pb + pl) / 2)) ELSE 0 END + CASE WHEN pl > 0 THEN pl * log2(pl / ((pb + pl) / 2)) ELSE 0 END) / 2) AS x FROM pr WHERE f = '__prediction_score__' GROUP BY ALL),
chi AS (SELECT w, d, v, f, nl, nb, sqrt(sum(CASE WHEN cb + cl > 0 THEN power(cb - (cb + cl) * nb / (nb + nl), 2) / ((cb + cl) * nb / (nb + nl)) + power(cl - (cb + cl) * nl / (nb + nl), 2) / ((cb + cl) * nl / (nb + nl)) ELSE 0 END) / (nb + nl)) AS x FROM pr WHERE f IN ('user_group', 'event_type') GROUP BY w, d, v, f, nl, nb),
kv AS (SELECT d, v, f, num, count(*) AS n FROM lf WHERE ts < TIMESTAMP '2024-01-11' AND f IN ('value', 'k') GROUP BY ALL),
lv AS (SELECT w, d, v, f, num, count(*) AS n FROM lf WHERE ts >= TIMESTAMP '2024-01-11' AND f IN ('value', 'k') GROUP BY ALL),
ku AS (SELECT l.w, l.d, l.v, l.f, k.num, k.n AS b, 0 AS l FROM (SELECT DISTINCT w, d, v, f FROM lv) l JOIN kv k ON l.f = k.f AND l.d IS NOT DISTINCT FROM k.d AND l.v IS NOT DISTINCT FROM k.v UNION ALL SELECT w, d, v, f, num, 0, n FROM lv),
kg AS (SELECT w, d, v, f, num, sum(b) AS b, sum(l) AS l FROM ku GROUP BY ALL),
kc AS (SELECT w, d, v, f, sum(b) OVER o AS cb, sum(l) OVER o AS cl, sum(b) OVER t AS tb, sum(l) OVER t AS tl FROM kg WINDOW o AS (PARTITION BY w, d, v, f ORDER BY num ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY w, d, v, f)),
ks AS (SELECT w, d, v, f, max(tl) AS nl, max(tb) AS nb, max(abs(cb / tb - cl / tl)) AS x FROM kc GROUP BY ALL)"""

DAY = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {1}"


def day(c: str, name: str = "window_start") -> str:
    return DAY.format(c, name)


def _q(body: str, extra: str = "") -> str:
    return f"WITH RECURSIVE {BASE}{',' if extra else ''}{extra}\n{body}"


def _stat(name: str, where: str = "TRUE") -> str:
    return _q(f"SELECT {day('w')}, f AS feature_name, d AS segment_dimension, v AS segment_value, round(x, 6) AS statistic, CAST(nb AS BIGINT) AS n_baseline, CAST(nl AS BIGINT) AS n_live FROM {name} WHERE {where}")


#: Labels of events; newest first by (received_at, label_id).
LABELS = """
lb0 AS (SELECT event_id AS id, event_id * 2 AS label_id, CAST((event_id * 7919) % 10 < 3 AS DOUBLE) AS y, ts, ts + to_hours(CAST(event_id % 72 AS INTEGER)) AS received_at FROM events),
lb AS (SELECT * FROM lb0 UNION ALL SELECT id, label_id + 1, 1 - y, ts, received_at + INTERVAL 1 DAY FROM lb0 WHERE id % 10 = 0)"""

_NEWEST = "SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC, label_id DESC) = 1"


def _metrics(tag: str, labels: str) -> str:
    """CTEs m{tag}: metrics of each day and slice."""
    return f"""
nl{tag} AS ({_NEWEST.format(labels)}),
r{tag} AS (SELECT sl.w, sl.d, sl.v, sl.score, n.y FROM sl JOIN nl{tag} n USING (id) WHERE sl.score IS NOT NULL),
g{tag} AS (SELECT w, d, v, score, count(*) AS n, sum(CAST(y = 1 AS INT)) AS pos FROM r{tag} GROUP BY ALL),
c{tag} AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp FROM g{tag} WINDOW o AS (PARTITION BY w, d, v ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
a{tag} AS (SELECT w, d, v, sum(n) AS n, sum(pos) AS p, sum(pos * cp / cn) AS ap, sum(pos * ((cn - cp) - (n - pos) / 2)) AS lost,
  sum(CASE WHEN score >= 0.5 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.5 THEN n ELSE 0 END) AS pp,
  sum(least(greatest(0, least(20 - (cn - n), n)), pos)) AS hit, sum(greatest(0, least(20 - (cn - n), n))) AS took FROM c{tag} GROUP BY ALL),
w{tag} AS (SELECT w, d, v, n, unnest(['pr_auc', 'roc_auc', 'precision_at_threshold', 'recall_at_threshold', 'precision_at_k']) AS metric_name,
  unnest([CASE WHEN p = 0 THEN 0 ELSE ap / p END, CASE WHEN p = 0 OR p = n THEN NULL ELSE 1 - lost / (p * (n - p)) END, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END, CASE WHEN p = 0 THEN 0 ELSE tp / p END, CASE WHEN took = 0 THEN 0 ELSE hit / took END]) AS x FROM a{tag}),
z{tag} AS (SELECT w, NULL AS d, NULL AS v, 0 AS n, unnest(['pr_auc', 'roc_auc', 'precision_at_threshold', 'recall_at_threshold', 'precision_at_k']) AS metric_name, NULL AS x FROM (SELECT DISTINCT w FROM p) WHERE w NOT IN (SELECT w FROM r{tag})),
m{tag} AS (SELECT w, d, v, CAST(n AS BIGINT) AS n, metric_name, CASE WHEN d IS NULL AND n < 50 THEN 'window has ' || CAST(n AS BIGINT) || ' labeled predictions, below configured minimum of 50'
  WHEN d IS NOT NULL AND n < 30 THEN 'segment ' || d || '=''' || v || ''' has ' || CAST(n AS BIGINT) || ' labeled predictions, below configured minimum of 30'
  WHEN x IS NULL THEN 'roc_auc is undefined when only one class is present in y_true' END AS reason, x FROM (SELECT * FROM w{tag} UNION ALL SELECT * FROM z{tag}))"""


_M = "w, d, v, n, metric_name, reason, CASE WHEN reason IS NULL THEN x END AS x"
_EARLY = "le AS (SELECT lb.* FROM lb WHERE received_at < ts + INTERVAL 24 HOUR)"
_SLOTS = "slots AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-09', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)) AS w)"
_SEEN = "seen AS (SELECT DISTINCT w FROM p WHERE ts >= TIMESTAMP '2024-01-11' AND day(w) % 5 <> 0)"
_MISSING = "'not evaluated -- no window exists for this time slot'"
_REASON = (
    "CASE WHEN c > 0.07 THEN format('PSI sampling-noise ceiling {:.3f} (chi-square approximation, null mean {:.3f} at {} baseline vs {} live rows, {} buckets) exceeds the clear threshold 0.07; "
    "a quiet window could not reliably read as clear, so PSI is not gated on at this volume', c, mean, CAST(nb AS BIGINT), CAST(nl AS BIGINT), bu) END"
)


def _mixed(x: str) -> str:
    once = lambda e: f"((xor({e} >> 16, {e}) * 73244475) & 4294967295)"
    return f"list_transform([{x} & 4294967295], lambda e: {once('e')}).list_transform(lambda e: {once('e')}).list_transform(lambda e: xor(e >> 16, e))[1]"


#: Draws without a shift, by counters: nt holds the mean and the ceiling of each signal and live size.
NULLS = f"""
ns AS (SELECT bn.f, bn.d, bn.v, bn.n, list(coalesce(bc.n, 0) ORDER BY g.bucket) AS c FROM bn JOIN (SELECT f, unnest(range(0, nb)) AS bucket FROM bins WHERE c IS NULL) g USING (f)
  LEFT JOIN bc ON bc.f = bn.f AND bc.bucket = g.bucket AND bc.d IS NOT DISTINCT FROM bn.d AND bc.v IS NOT DISTINCT FROM bn.v GROUP BY bn.f, bn.d, bn.v, bn.n),
nk AS (SELECT *, row_number() OVER () AS id, CAST('0x' || substr(md5(CAST(to_json([f, d, v]) AS VARCHAR) || '|0'), 1, 8) AS BIGINT) AS h, list_transform(range(1, len(c) + 1), lambda i: list_sum(c[1:i]) / n) AS upto FROM ns),
nc AS (SELECT *, {_mixed('(h + size)')} AS st, {_mixed('(h + size + 1000003)')} AS sn FROM (SELECT *, unnest([10, 20, 30, 50, 75, 100, 150, 200, 300, 500, 750, 1000, 1500, 2000, 3000, 5000]) AS size FROM nk)),
nd AS (SELECT nc.*, r.range AS draw FROM nc, range(200) r),
n0 AS (SELECT id, size, draw, upto, (st + draw * 5000 + unnest(range(0, size))) & 4294967295 AS x FROM nd),
n1 AS (SELECT id, size, draw, upto, (xor(x >> 16, x) * 73244475) & 4294967295 AS x FROM n0),
n2 AS (SELECT id, size, draw, upto, (xor(x >> 16, x) * 73244475) & 4294967295 AS x FROM n1),
n3 AS (SELECT id, size, draw, upto, (xor(x >> 16, x) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM n2),
n4 AS (SELECT id, size, draw, [{', '.join(f'count(*) FILTER (u < upto[{k}])' for k in range(1, 13))}] AS below FROM n3 GROUP BY ALL),
n5 AS (SELECT nd.*, below, list_transform(range(1, len(c) + 1), lambda i: sn + (draw * 12 + i - 1) * 2) AS s FROM nd JOIN n4 USING (id, size, draw)),
n6 AS (SELECT *, unnest(range(1, len(c) + 1)) AS i, unnest(s) AS s1 FROM n5),
n7 AS (SELECT id, f, d, v, size, draw, i, c[i] / n AS p, n, (below[i] - CASE WHEN i > 1 THEN below[i - 1] ELSE 0 END) / size AS q,
  sqrt(c[i] / n) * sqrt(-2 * ln(({_mixed('s1')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) * cos(2 * pi() * ({_mixed('(s1 + 1)')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE) AS z FROM n6),
n8 AS (SELECT *, greatest(0, p + (z - p * sum(z) OVER (PARTITION BY id, size, draw)) / sqrt(n)) AS b0 FROM n7),
n9 AS (SELECT *, b0 / sum(b0) OVER (PARTITION BY id, size, draw) AS b FROM n8),
nx AS (SELECT f, d, v, size, draw, sum(CASE WHEN f = '__prediction_score__' THEN (CASE WHEN b > 0 THEN b * log2(b / ((b + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((b + q) / 2)) ELSE 0 END) / 2
  ELSE (greatest(q, 1e-4) - greatest(b, 1e-4)) * ln(greatest(q, 1e-4) / greatest(b, 1e-4)) END) AS x FROM n9 GROUP BY ALL),
na AS (SELECT f, d, v, size, avg(x) AS mean, quantile_cont(x, 0.975) AS c FROM nx GROUP BY ALL),
nt AS (SELECT f, d, v, size, mean, max(c) OVER (PARTITION BY f, d, v ORDER BY size DESC) AS ceiling FROM na)"""

GATED = f"""
ss AS (SELECT w, d, v, count(*) AS ns FROM sl WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY ALL), bs AS (SELECT d, v, count(*) AS ns FROM sl WHERE ts < TIMESTAMP '2024-01-11' GROUP BY ALL),
ws AS (SELECT w, count(*) AS n FROM p WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY ALL),
ga AS (SELECT psi.*, ws.n AS nw, ss.ns, bs.ns AS nbs, bins.nb AS bu, (bins.nb - 1) * (1 / psi.nb + 1 / psi.nl) AS mean, (bins.nb - 1) * (1 / psi.nb + 1 / psi.nl) + 2 * sqrt(2 * (bins.nb - 1)) * (1 / psi.nb + 1 / psi.nl) AS c
  FROM psi JOIN bins USING (f) JOIN ws USING (w) JOIN ss ON psi.w = ss.w AND psi.d IS NOT DISTINCT FROM ss.d AND psi.v IS NOT DISTINCT FROM ss.v JOIN bs ON psi.d IS NOT DISTINCT FROM bs.d AND psi.v IS NOT DISTINCT FROM bs.v
  WHERE psi.d IS NULL OR ws.n >= 50),
gb AS (SELECT *, CASE WHEN nw < 50 THEN 'window has ' || nw || ' predictions, below configured minimum of 50'
  WHEN d IS NOT NULL AND ns < 30 THEN 'segment ' || d || '=''' || v || ''' has ' || ns || ' live predictions, below configured minimum of 30' ELSE {_REASON} END AS reason FROM ga)"""

#: Results of every method and slice, classed by the noisy gates, in runs.
NOISY = """
cl AS (SELECT w, m, f, d, v, concat_ws('|', m, f, coalesce(d, ''), coalesce(v, '')) AS id, round(x, 6) AS x, x AS raw, fire, CASE WHEN round(x, 6) >= fire THEN 'breach' WHEN round(x, 6) <= clr THEN 'clear' ELSE 'dead_zone' END AS k FROM (
  SELECT w, d, v, f, x, 'psi' AS m, CAST(0.03 AS DOUBLE) AS fire, CAST(0.02 AS DOUBLE) AS clr FROM psi UNION ALL SELECT w, d, v, f, x, 'ks', 0.05, 0.035 FROM ks
  UNION ALL SELECT w, d, v, f, x, 'chi_square', 0.04, 0.03 FROM chi UNION ALL SELECT w, d, v, f, x, 'jsd', 0.004, 0.003 FROM jsd)),
nm AS (SELECT DISTINCT id, m, f, d, v, fire FROM cl),
ch AS (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY id ORDER BY w) THEN 0 ELSE 1 END AS c FROM cl),
ru AS (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY w) AS run FROM ch),
st AS (SELECT *, least(6, row_number() OVER (PARTITION BY id, run ORDER BY w)) AS streak, row_number() OVER (PARTITION BY id ORDER BY w) AS rn FROM ru)"""

#: The state machine of one signal, a window at a time; a closed alert leaves as status resolved.
FOLD = """
fo AS (
  SELECT id, 0 AS rn, NULL::TIMESTAMP AS w, NULL::VARCHAR AS status, NULL::TIMESTAMP AS opened, NULL::TIMESTAMP AS esc, NULL::TIMESTAMP AS res, 0 AS br, 0 AS cl, NULL::DOUBLE AS e1, NULL::DOUBLE AS e2, NULL::VARCHAR AS k, 0::BIGINT AS streak FROM nm
  UNION ALL
  SELECT o.id, e.rn, e.w,
    CASE WHEN o.status IS NULL OR o.status = 'resolved' THEN CASE WHEN e.k = 'breach' AND e.streak >= 2 THEN 'open' END
         WHEN e.k = 'breach' AND o.status = 'open' AND e.streak >= 3 THEN 'escalated' WHEN e.k = 'clear' AND e.streak >= 2 THEN 'resolved' ELSE o.status END,
    CASE WHEN o.status IS NULL OR o.status = 'resolved' THEN CASE WHEN e.k = 'breach' AND e.streak >= 2 THEN e.w END ELSE o.opened END,
    CASE WHEN o.status IS NULL OR o.status = 'resolved' THEN NULL WHEN e.k = 'breach' AND o.status = 'open' AND e.streak >= 3 THEN e.w ELSE o.esc END,
    CASE WHEN o.status IN ('open', 'escalated') AND e.k = 'clear' AND e.streak >= 2 THEN e.w END,
    CASE WHEN e.k = 'breach' THEN CAST(e.streak AS INT) WHEN e.k IN ('clear', 'dead_zone') THEN 0 ELSE o.br END,
    CASE WHEN e.k = 'clear' THEN CAST(e.streak AS INT) WHEN e.k IN ('breach', 'dead_zone') THEN 0 ELSE o.cl END,
    CASE WHEN o.status IS NULL OR o.status = 'resolved' THEN e.x ELSE o.e1 END,
    CASE WHEN o.status IS NULL OR o.status = 'resolved' THEN NULL WHEN e.k = 'breach' AND o.status = 'open' AND e.streak >= 3 THEN e.x ELSE o.e2 END, e.k, e.streak
  FROM fo o JOIN st e ON e.id = o.id AND e.rn = o.rn + 1),
al AS (SELECT fo.*, fo.w AS seen, m, f, d, v, fire FROM fo JOIN nm USING (id) WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fo.id, opened ORDER BY rn DESC) = 1)"""
_ALERT = "m AS signal_name, f AS feature_name, d AS segment_dimension, v AS segment_value"
_TEST = "m AS test_method, f AS feature_name, d AS segment_dimension, v AS segment_value"

#: Runs of performance rows by their newest revision.
METRIC_RUNS = """
mr AS (SELECT w, d, v, metric_name AS m, reason, CASE WHEN reason IS NULL THEN round(x, 6) END AS x FROM m2 WHERE metric_name = 'pr_auc'
  UNION ALL SELECT w, d, v, metric_name, reason, CASE WHEN reason IS NULL THEN round(x, 6) END FROM m1 WHERE metric_name = 'pr_auc' AND NOT EXISTS (SELECT 1 FROM m2 WHERE m1.w = m2.w AND m1.d IS NOT DISTINCT FROM m2.d AND m1.v IS NOT DISTINCT FROM m2.v AND m1.metric_name = m2.metric_name)),
mk AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'not_computable' WHEN x <= 0.25 THEN 'breach' WHEN x >= 0.32 THEN 'clear' ELSE 'dead_zone' END AS k FROM mr),
mc AS (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY m, d, v ORDER BY w) THEN 0 ELSE 1 END AS c FROM mk),
mu AS (SELECT *, sum(c) OVER (PARTITION BY m, d, v ORDER BY w) AS run FROM mc)"""
#: Events of drift and performance under both kinds: o opens, e escalates, r resolves.
KINDS = """
ea AS (SELECT 'drift' AS src, m, f, d, v, w, k, x, fire, CAST(NULL AS VARCHAR) AS reason FROM cl UNION ALL SELECT 'performance', m, NULL, d, v, w, k, x, 0.25, reason FROM mk),
eb AS (SELECT *, concat_ws('|', src, m, coalesce(f, ''), coalesce(d, ''), coalesce(v, '')) AS id FROM ea),
ec AS (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY id ORDER BY w) THEN 0 ELSE 1 END AS c FROM eb),
ed AS (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY w) AS run FROM ec),
ee AS (SELECT *, CAST(least(6, row_number() OVER (PARTITION BY id, run ORDER BY w)) AS INT) AS streak, row_number() OVER (PARTITION BY id ORDER BY w) AS rn FROM ed),
eg AS (SELECT *, kind || '|' || id AS kid, kind || '|' || src AS g FROM (
  SELECT src AS kind, k = 'breach' AND streak >= 2 AS o, k = 'breach' AND streak >= 3 AS e, k = 'clear' AND streak >= 2 AS r, ee.* FROM ee
  UNION ALL SELECT 'not_computable', k = 'not_computable' AND streak >= 2, FALSE, k <> 'not_computable', ee.* FROM ee))"""
#: Which runs of a group roll up: the open alerts, run by run.
ROLLED = """
gw AS (SELECT g, w, row_number() OVER (PARTITION BY g ORDER BY w) AS n, coalesce(list(kid) FILTER (o), []) AS o_ids, coalesce(list(kid) FILTER (r), []) AS r_ids FROM eg GROUP BY g, w),
de AS (
  SELECT g, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS w, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS fresh, FALSE AS rolled FROM gw WHERE n = 1
  UNION ALL
  SELECT g, n, w, CASE WHEN len(fresh) > {cap} THEN kept ELSE list_concat(kept, fresh) END, fresh, len(fresh) > {cap} FROM (
    SELECT o.g, e.n, e.w, list_filter(o.ids, lambda x: NOT list_contains(e.r_ids, x)) AS kept, list_filter(e.o_ids, lambda x: NOT list_contains(o.ids, x)) AS fresh FROM de o JOIN gw e ON e.g = o.g AND e.n = o.n + 1))"""
#: The state machine of each kind, where runs that roll up open nothing.
MACHINE = """
eh AS ({events}),
mo AS (
  SELECT kid, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS w, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS TIMESTAMP) AS opened, CAST(NULL AS TIMESTAMP) AS esc, CAST(NULL AS TIMESTAMP) AS res, 0 AS br, 0 AS cl, CAST(NULL AS DOUBLE) AS e1, CAST(NULL AS DOUBLE) AS e2, CAST(NULL AS VARCHAR) AS why FROM eh WHERE rn = 1
  UNION ALL
  SELECT p.kid, e.rn, e.w, CASE WHEN p.status IS NULL OR p.status = 'resolved' THEN CASE WHEN e.o THEN 'open' END WHEN e.r THEN 'resolved' WHEN e.e THEN 'escalated' ELSE p.status END,
    CASE WHEN p.status IS NULL OR p.status = 'resolved' THEN CASE WHEN e.o THEN e.w END ELSE p.opened END,
    CASE WHEN p.status IS NULL OR p.status = 'resolved' THEN NULL WHEN e.e AND p.status = 'open' THEN e.w ELSE p.esc END,
    CASE WHEN p.status IN ('open', 'escalated') AND e.r THEN e.w END,
    CASE WHEN e.kind = 'not_computable' THEN 0 WHEN e.k = 'breach' THEN e.streak WHEN e.k IN ('clear', 'dead_zone') THEN 0 ELSE p.br END,
    CASE WHEN e.kind = 'not_computable' THEN 0 WHEN e.k = 'clear' THEN e.streak WHEN e.k IN ('breach', 'dead_zone') THEN 0 ELSE p.cl END,
    CASE WHEN p.status IS NULL OR p.status = 'resolved' THEN e.x ELSE p.e1 END,
    CASE WHEN p.status IS NULL OR p.status = 'resolved' THEN NULL WHEN e.e AND p.status = 'open' THEN e.x ELSE p.e2 END,
    CASE WHEN p.status IS NULL OR p.status = 'resolved' THEN e.reason ELSE p.why END
  FROM mo p JOIN eh e ON e.kid = p.kid AND e.rn = p.rn + 1),
ma AS (SELECT mo.*, mo.w AS seen, kind, src, m, f, d, v, CASE WHEN kind <> 'not_computable' THEN fire END AS fire FROM mo JOIN (SELECT DISTINCT kid, kind, src, m, f, d, v, fire FROM eh) USING (kid) WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mo.kid, opened ORDER BY rn DESC) = 1)"""
#: Windows are named by their end: the day after their start.
_END = "{0} + INTERVAL 1 DAY"

_BOTH = LABELS + ", " + _EARLY + "," + _metrics("1", "le") + "," + _metrics("2", "lb") + "," + NOISY + "," + METRIC_RUNS
_TL = f"CASE WHEN s.w IS NULL THEN 'missing' WHEN g.f IS NULL THEN 'not_configured' WHEN g.reason IS NULL THEN 'computed' ELSE 'not_computable' END"

ORACLES = {
    "baseline_edges": _q("SELECT f AS feature_name, CAST(unnest(range(0, len(e))) AS INT) AS i, round(unnest(e), 6) AS edge FROM edges"),
    "baseline_categories": _q("SELECT f AS feature_name, CAST(unnest(range(0, len(c))) AS INT) AS i, unnest(c) AS category FROM cats"),
    "baseline_slices": _q(
        "SELECT x.f AS feature_name, x.d AS segment_dimension, x.v AS segment_value, CAST(x.n AS BIGINT) AS n_baseline, CAST(x.bucket AS INT) AS bucket, coalesce(bc.n, 0) AS n "
        "FROM (SELECT bn.*, unnest(range(0, nb)) AS bucket FROM bn JOIN bins USING (f)) x LEFT JOIN bc ON x.f = bc.f AND x.bucket = bc.bucket AND x.d IS NOT DISTINCT FROM bc.d AND x.v IS NOT DISTINCT FROM bc.v"
    ),
    "bucket_counts": _q(f"SELECT {day('w')}, f AS feature_name, d AS segment_dimension, v AS segment_value, CAST(bucket AS INT) AS bucket, n FROM lc"),
    "psi_daily": _stat("psi", "d IS NULL"),
    "psi_by_segment": _stat("psi", "d IS NOT NULL"),
    "ks_daily": _stat("ks", "d IS NULL"),
    "ks_by_segment": _stat("ks", "d IS NOT NULL"),
    "cramers_v_daily": _stat("chi", "d IS NULL"),
    "jsd_score_daily": _stat("jsd"),
    "floors_closed_form": f"""
WITH n AS (SELECT date_trunc('day', ts) AS w, CAST(count(*) AS DOUBLE) AS nl, (SELECT CAST(count(*) AS DOUBLE) FROM events WHERE ts < TIMESTAMP '2024-01-11') AS nb FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY 1)
SELECT {day('w')}, round(11 * (1 / nb + 1 / nl), 6) AS psi_mean, round(11 * (1 / nb + 1 / nl) + 2 * sqrt(22) * (1 / nb + 1 / nl), 6) AS psi_ceiling, round({kolmogorov_ppf(0.975)!r} * sqrt((nb + nl) / (nb * nl)), 6) AS ks_ceiling,
  round(sqrt({chi2_ppf(0.975, 6)!r} / (nb + nl)), 6) AS v_ceiling, round({chi2_ppf(0.975, 11)!r} * (1 / nb + 1 / nl) / (8 * ln(2)), 6) AS jsd_ceiling FROM n""",
    "drift_gated": _q(
        f"SELECT {day('w')}, f AS feature_name, d AS segment_dimension, v AS segment_value, CASE WHEN reason IS NULL THEN 'computed' ELSE 'not_computable' END AS status, CASE WHEN reason IS NULL THEN round(x, 6) END AS statistic, "
        "CASE WHEN reason IS NULL THEN x >= 0.1 END AS is_significant, reason AS not_computable_reason, CAST(CASE WHEN nw < 50 THEN 0 WHEN d IS NOT NULL AND ns < 30 THEN nbs ELSE nb END AS BIGINT) AS n_baseline, CAST(CASE WHEN nw < 50 THEN 0 WHEN d IS NOT NULL AND ns < 30 THEN ns ELSE nl END AS BIGINT) AS n_live FROM gb",
        GATED,
    ),
    "null_floor_table": _q(
        "SELECT f AS feature_name, d AS segment_dimension, v AS segment_value, CAST(size AS INT) AS null_sizes, round(mean, 6) AS null_mean, round(ceiling, 6) AS null_ceiling FROM nt",
        NULLS,
    ),
    "bh_correction": _q(
        f"SELECT {day('w')}, f AS feature_name, d AS segment_dimension, v AS segment_value, round(p, 6) AS p_value, round(least(1, min(p * m / r) OVER (PARTITION BY w ORDER BY r DESC)), 6) AS corrected_p_value, coalesce(r <= max(CASE WHEN p <= 0.1 * r / m THEN r END) OVER (PARTITION BY w), FALSE) AS passes_fdr FROM pk",
        "\nlam AS (SELECT *, x * sqrt(nl * nb / (nl + nb)) AS lam FROM ks),"
        "\npv AS (SELECT *, round(CASE WHEN lam < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 21), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * i * i * lam * lam))))) END, 9) AS p FROM lam),"
        "\npk AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY p) AS r, count(*) OVER (PARTITION BY w) AS m FROM pv)",
    ),
    "perf_daily": _q(
        f"SELECT {day('w')}, d AS segment_dimension, v AS segment_value, metric_name, CASE WHEN reason IS NULL THEN 'computed' ELSE 'not_computable' END AS status, CASE WHEN reason IS NULL THEN round(x, 6) END AS metric_value, reason AS not_computable_reason, n AS n_labeled FROM mx",
        LABELS + "," + _metrics("x", "lb"),
    ),
    "perf_regression": f"""
WITH t AS (SELECT time_bucket(INTERVAL 30 DAY, l_shipdate, TIMESTAMP '1970-01-01') AS w, l_returnflag, l_extendedprice - l_quantity * 1500 AS e FROM lineitem),
s AS (SELECT w, e, CAST(NULL AS VARCHAR) AS d, CAST(NULL AS VARCHAR) AS v FROM t UNION ALL SELECT w, e, 'l_returnflag', l_returnflag FROM t WHERE l_returnflag IS NOT NULL)
SELECT {day('w')}, d AS segment_dimension, v AS segment_value, unnest(['rmse', 'mae']) AS metric_name, unnest([round(sqrt(sum(CAST(e AS DOUBLE) * e) / count(*)), 4), round(sum(CAST(abs(e) AS DOUBLE)), 2)]) AS value, count(*) AS n_labeled FROM s GROUP BY w, d, v""",
    "perf_documents": """
WITH t AS (SELECT lang, n_chars / (n_chars + 2000.0) AS score, quality AS y FROM documents JOIN labels USING (doc_id)),
s AS (SELECT score, y, CAST(NULL AS VARCHAR) AS d, CAST(NULL AS VARCHAR) AS v FROM t UNION ALL SELECT score, y, 'lang', lang FROM t WHERE lang IS NOT NULL),
g AS (SELECT d, v, score, count(*) AS n, sum(CAST(y = 1 AS INT)) AS pos FROM s GROUP BY ALL),
c AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp FROM g WINDOW o AS (PARTITION BY d, v ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT d, v, sum(n) AS n, sum(pos) AS p, sum(pos * cp / cn) AS ap, sum(pos * ((cn - cp) - (n - pos) / 2)) AS lost, sum(least(greatest(0, least(50 - (cn - n), n)), pos)) AS hit, sum(greatest(0, least(50 - (cn - n), n))) AS took FROM c GROUP BY ALL)
SELECT d AS segment_dimension, v AS segment_value, unnest(['pr_auc', 'roc_auc', 'precision_at_k']) AS metric_name, round(unnest([CASE WHEN p = 0 THEN 0 ELSE ap / p END, CASE WHEN p = 0 OR p = n THEN NULL ELSE 1 - lost / (p * (n - p)) END, hit / took]), 6) AS value, CAST(n AS BIGINT) AS n_labeled FROM a""",
    "perf_user_metric": _q(
        f"SELECT {day('w')}, d AS segment_dimension, v AS segment_value, 'brier' AS metric_name, round(avg(power(y - score, 2)), 6) AS value, count(*) AS n_labeled FROM sl JOIN n USING (id) GROUP BY ALL",
        LABELS + f", n AS ({_NEWEST.format('lb')})",
    ),
    "latest_label": f"WITH {LABELS.strip()} SELECT id AS prediction_id, label_id, y AS label_value, {day('received_at', 'received_at')} FROM ({_NEWEST.format('lb')})",
    "window_labels": _q(
        f"SELECT {day('w')}, count(*) AS n_predictions, count(n.id) AS n_labels, {day('max(n.received_at)', 'label_watermark')} FROM p LEFT JOIN n USING (id) GROUP BY w", LABELS + f", n AS ({_NEWEST.format('lb')})"
    ),
    "revisions_first_latest": _q(
        "SELECT " + day("w") + ", d AS segment_dimension, v AS segment_value, metric_name, revision, round(x, 6) AS metric_value, n AS n_labeled, late AS is_retroactive FROM ("
        f"SELECT {_M}, 'initial' AS revision, FALSE AS late FROM m1 UNION ALL SELECT {_M}, 'latest', TRUE FROM m2"
        f" UNION ALL SELECT {_M}, 'latest', FALSE FROM m1 WHERE NOT EXISTS (SELECT 1 FROM m2 WHERE m1.w = m2.w AND m1.d IS NOT DISTINCT FROM m2.d AND m1.v IS NOT DISTINCT FROM m2.v AND m1.metric_name = m2.metric_name)"
        f" UNION ALL SELECT {_M}, 'initial', TRUE FROM m2 WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.w = m2.w AND m1.d IS NOT DISTINCT FROM m2.d AND m1.v IS NOT DISTINCT FROM m2.v AND m1.metric_name = m2.metric_name))",
        LABELS + ", " + _EARLY + "," + _metrics("1", "le") + "," + _metrics("2", "lb"),
    ),
    "performance_timeline": _q(
        f"SELECT {day('s.w')}, k.revision, round(CASE WHEN r.reason IS NULL THEN r.x END, 6) AS value, r.n AS n_labeled, CASE WHEN o.w IS NULL THEN 'missing' WHEN r.w IS NULL THEN 'not_configured' WHEN r.reason IS NULL THEN 'computed' ELSE 'not_computable' END AS state, "
        f"CASE WHEN o.w IS NULL THEN {_MISSING} ELSE r.reason END AS reason FROM slots s CROSS JOIN (SELECT unnest(['initial', 'latest']) AS revision) k LEFT JOIN (SELECT DISTINCT w FROM p) o USING (w) "
        "LEFT JOIN (SELECT *, 'initial' AS revision FROM m1 WHERE d IS NULL AND metric_name = 'pr_auc' UNION ALL SELECT *, 'latest' FROM m2 WHERE d IS NULL AND metric_name = 'pr_auc') r ON s.w = r.w AND k.revision = r.revision",
        LABELS + ", " + _EARLY + "," + _metrics("1", "le") + "," + _metrics("2", "lb") + "," + _SLOTS,
    ),
    "drift_timeline": _q(
        f"SELECT {day('t.w')}, {day(_END.format('t.w'), 'window_end')}, CASE WHEN g.reason IS NULL THEN round(g.x, 6) END AS value, CASE WHEN g.reason IS NULL THEN g.x >= 0.1 END AS is_significant, {_TL} AS state, CASE WHEN s.w IS NULL THEN {_MISSING} ELSE g.reason END AS reason "
        "FROM slots t LEFT JOIN seen s ON t.w = s.w LEFT JOIN (SELECT gb.* FROM gb JOIN seen USING (w) WHERE d IS NULL AND f = 'value') g ON t.w = g.w",
        GATED + "," + _SLOTS + "," + _SEEN,
    ),
    "segment_view": _q(
        f"SELECT {day('t.w')}, n.segment, round(g.x, 6) AS value, CASE WHEN s.w IS NULL THEN 'missing' WHEN g.f IS NULL THEN 'not_configured' ELSE 'computed' END AS state, CASE WHEN s.w IS NULL THEN {_MISSING} END AS reason "
        "FROM slots t CROSS JOIN (SELECT DISTINCT coalesce(v, 'Global') AS segment FROM psi JOIN seen USING (w) WHERE f = 'value') n LEFT JOIN seen s ON t.w = s.w LEFT JOIN (SELECT psi.* FROM psi JOIN seen USING (w) WHERE f = 'value') g ON t.w = g.w AND n.segment = coalesce(g.v, 'Global')",
        _SLOTS + "," + _SEEN,
    ),
    "attribution": _q(
        "SELECT feature_name, test_method, round(x, 6) AS statistic, fire AS fire_threshold, round(x / fire, 6) AS ratio, x >= fire AS is_significant, 'computed' AS state FROM ("
        "SELECT f AS feature_name, 'psi' AS test_method, CAST(0.1 AS DOUBLE) AS fire, x FROM psi WHERE d IS NULL AND w = TIMESTAMP '2024-01-17' UNION ALL SELECT f, 'ks', 0.08, x FROM ks WHERE d IS NULL AND w = TIMESTAMP '2024-01-17' "
        "UNION ALL SELECT f, 'chi_square', 0.06, x FROM chi WHERE d IS NULL AND w = TIMESTAMP '2024-01-17' UNION ALL SELECT f, 'jsd', 0.02, x FROM jsd WHERE d IS NULL AND w = TIMESTAMP '2024-01-17')"
    ),
    "streaks": _q(f"SELECT {_TEST}, k AS class, CAST(streak AS INT) AS streak FROM st QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC) = 1", NOISY),
    "suppressed_episodes": _q(
        f"SELECT {_TEST}, {day(_END.format('min(w)'), 'first_window')}, {day(_END.format('max(w)'), 'last_window')}, count(*) AS length, round(max(x), 6) AS peak, 'breach' AS kind FROM st WHERE k = 'breach' GROUP BY id, m, f, d, v, run HAVING count(*) < 3",
        NOISY,
    ),
    "suppressed_report": _q(
        f"SELECT {_TEST}, 'breach' AS kind, {day(_END.format('min(w)'), 'first_window')}, {day(_END.format('max(w)'), 'last_window')}, count(*) AS length, round(max(x), 6) AS peak FROM st WHERE k = 'breach' GROUP BY id, m, f, d, v, run HAVING count(*) < 2 "
        f"UNION ALL SELECT m, NULL, d, v, k, {day(_END.format('min(w)'), 'first_window')}, {day(_END.format('max(w)'), 'last_window')}, count(*), round(max(x), 6) FROM mu WHERE k IN ('breach', 'not_computable') GROUP BY m, d, v, k, run HAVING count(*) < 2",
        LABELS + ", " + _EARLY + "," + _metrics("1", "le") + "," + _metrics("2", "lb") + "," + NOISY + "," + METRIC_RUNS,
    ),
    "alert_lifecycle": _q(
        f"SELECT 'drift' AS kind, {_ALERT}, status, {day(_END.format('opened'), 'opened_window')}, {day(_END.format('seen'), 'last_seen_window')}, {day(_END.format('esc'), 'escalated_window')}, {day(_END.format('res'), 'resolved_window')}, br AS breaching, cl AS clear, round(e1, 6) AS evidence_statistic, fire AS evidence_threshold, round(e2, 6) AS escalation_statistic FROM al",
        NOISY + "," + FOLD,
    ),
    "alert_kinds": _q(
        f"SELECT kind, src AS source, {_ALERT}, status, {day(_END.format('opened'), 'opened_window')}, {day(_END.format('seen'), 'last_seen_window')}, {day(_END.format('esc'), 'escalated_window')}, {day(_END.format('res'), 'resolved_window')}, br AS breaching, cl AS clear, "
        "round(e1, 6) AS evidence_statistic, fire AS evidence_threshold, why AS evidence_reason, round(e2, 6) AS escalation_statistic FROM ma",
        _BOTH + "," + KINDS + "," + MACHINE.format(events="SELECT * FROM eg"),
    ),
    "rolled_up_alerts": _q(
        f"SELECT kind, src AS source, {_ALERT}, status, {day(_END.format('opened'), 'opened_window')}, {day(_END.format('seen'), 'last_seen_window')}, {day(_END.format('esc'), 'escalated_window')}, {day(_END.format('res'), 'resolved_window')}, FALSE AS is_aggregate, CAST(NULL AS INT) AS aggregated_signal_count, CAST(NULL AS VARCHAR) AS signals, why AS evidence_reason FROM ma "
        f"UNION ALL SELECT split_part(g, '|', 1), split_part(g, '|', 2), 'aggregate-' || split_part(g, '|', 1), NULL, NULL, NULL, CASE WHEN res IS NULL THEN 'open' ELSE 'resolved' END, {day(_END.format('opened'), 'opened_window')}, {day(_END.format('seen'), 'last_seen_window')}, NULL, {day(_END.format('res'), 'resolved_window')}, TRUE, CAST(len(last) AS INT), array_to_string(list_sort(last), ','), "
        "len(first) || ' signals opened in one evaluation run, rolled up (cap=2)' FROM (SELECT g, series, min(w) FILTER (rolled) AS opened, max(w) FILTER (rolled) AS seen, max(w) FILTER (NOT rolled) AS res, arg_min(fresh, n) FILTER (rolled) AS first, arg_max(fresh, n) FILTER (rolled) AS last "
        "FROM (SELECT *, coalesce(sum(CAST(NOT rolled AS INT)) OVER (PARTITION BY g ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS series FROM de WHERE n > 0) GROUP BY g, series HAVING bool_or(rolled))",
        _BOTH + "," + KINDS + "," + ROLLED.format(cap=2) + "," + MACHINE.format(events="SELECT eg.* REPLACE (eg.o AND NOT coalesce(de.rolled, FALSE) AS o) FROM eg LEFT JOIN de ON de.g = eg.g AND de.w = eg.w"),
    ),
    "lifecycle_trace": _q(
        f"SELECT {_ALERT}, {day(_END.format('w'), 'window_end')}, k AS class, CAST(streak AS INT) AS streak, CASE WHEN status IN ('open', 'escalated') THEN status WHEN k = 'breach' THEN 'counting' ELSE 'quiet' END AS phase FROM fo JOIN nm USING (id) WHERE rn > 0",
        NOISY + "," + FOLD,
    ),
    "touched_alerts": _q(
        f"SELECT 'drift' AS kind, {_ALERT}, status, {day(_END.format('opened'), 'opened_window')}, {day(_END.format('seen'), 'last_seen_window')} FROM al WHERE seen >= TIMESTAMP '2024-01-26' AND seen IN (SELECT w FROM p)", NOISY + "," + FOLD
    ),
    "run_totals": _q(
        "SELECT 'windows' AS item, count(DISTINCT w) AS n FROM p WHERE ts >= TIMESTAMP '2024-01-11' UNION ALL SELECT 'drift_results', count(*) FROM cl UNION ALL SELECT 'drift_computed', count(*) FROM cl UNION ALL SELECT 'drift_significant', count(*) FROM cl WHERE raw >= fire "
        "UNION ALL SELECT 'performance_results', count(*) FROM mx UNION ALL SELECT 'performance_computed', count(*) FROM mx WHERE reason IS NULL UNION ALL SELECT 'alerts', count(*) FROM al "
        "UNION ALL SELECT 'alerts_' || s, count(id) FROM (SELECT unnest(['open', 'escalated', 'resolved']) AS s) LEFT JOIN al ON status = s GROUP BY s",
        LABELS + "," + _metrics("x", "lb") + "," + NOISY + "," + FOLD,
    ),
    "evaluated_range": _q(
        f"SELECT {day('w')}, f AS feature_name, d AS segment_dimension, v AS segment_value, round(x, 6) AS statistic, CAST(nl AS BIGINT) AS n_live, CASE WHEN w < TIMESTAMP '2024-01-14' THEN 1 WHEN w < TIMESTAMP '2024-01-16' THEN 3 ELSE 2 END AS evaluation FROM psi WHERE w >= TIMESTAMP '2024-01-12' AND w < TIMESTAMP '2024-01-20'"
    ),
    "evaluation_windows": _q(
        f"SELECT 'events' AS model_id, {day('w')}, {day(_END.format('w'), 'window_end')}, 7 AS baseline_id, TRUE AS current_config, '2024-02-10 00:00:00' AS evaluated_at, CASE WHEN late > 0 THEN '2024-02-11 00:00:00' ELSE '2024-02-10 00:00:00' END AS performance_computed_at, "
        "strftime(CASE WHEN late > 0 THEN watermark ELSE early_watermark END, '%Y-%m-%d %H:%M:%S') AS label_watermark, on_time AS n_predictions, CASE WHEN late > 0 THEN labelled ELSE early END AS n_labels, w = TIMESTAMP '2024-01-16' AS performance_stale, n - on_time AS late_prediction_count, "
        "CASE WHEN late > 0 THEN 2 ELSE 1 END AS revisions, CASE WHEN late > 0 THEN 1 ELSE 0 END AS retroactive FROM ("
        "SELECT p.w, count(*) AS n, count(*) FILTER (p.id % 9 <> 0) AS on_time, count(b.id) AS labelled, max(b.received_at) AS watermark, count(a.id) FILTER (p.id % 9 <> 0) AS early, max(a.received_at) FILTER (p.id % 9 <> 0) AS early_watermark, "
        "sum((SELECT count(*) FROM lb x WHERE x.id = p.id AND x.received_at >= x.ts + INTERVAL 24 HOUR)) AS late FROM p LEFT JOIN nb b ON b.id = p.id LEFT JOIN na a ON a.id = p.id WHERE p.w >= TIMESTAMP '2024-01-12' AND p.w < TIMESTAMP '2024-01-20' GROUP BY p.w)",
        LABELS + ", " + _EARLY + f", nb AS ({_NEWEST.format('lb')}), na AS ({_NEWEST.format('le')})",
    ),
    "alert_history": _q(
        f"SELECT 'drift' AS kind, {_ALERT}, status, {day(_END.format('opened'), 'opened_window')}, {day(_END.format('seen'), 'last_seen_window')} FROM al WHERE seen + INTERVAL 1 DAY > TIMESTAMP '2024-01-15' AND opened + INTERVAL 1 DAY < TIMESTAMP '2024-01-20'",
        NOISY + "," + FOLD,
    ),
    "evaluation_totals": _q(
        "SELECT 'windows_evaluated' AS item, CAST(count(o.w) AS BIGINT) AS n FROM slots s LEFT JOIN o USING (w) UNION ALL SELECT 'windows_skipped', count(*) - count(o.w) FROM slots s LEFT JOIN o USING (w) "
        "UNION ALL SELECT 'predictions', count(*) FROM p WHERE w IN (SELECT w FROM o) UNION ALL SELECT 'labelled', count(*) FROM p JOIN n USING (id) WHERE w IN (SELECT w FROM o) AND score IS NOT NULL "
        "UNION ALL SELECT 'labels_early', count(*) FROM lb WHERE received_at < ts + INTERVAL 24 HOUR UNION ALL SELECT 'labels_late', count(*) FROM lb WHERE received_at >= ts + INTERVAL 24 HOUR",
        LABELS + f", n AS ({_NEWEST.format('lb')}), " + _SLOTS + ", o AS (SELECT DISTINCT w FROM p WHERE day(w) % 5 <> 0 AND w >= TIMESTAMP '2024-01-09' AND w < TIMESTAMP '2024-02-02')",
    ),
    "alert_windows": _q(
        f"SELECT 'drift' AS kind, {_ALERT}, status, {day('opened', 'opened_start')}, a.n AS opened_predictions, {day('esc', 'escalated_start')}, b.n AS escalated_predictions, {day('seen', 'last_seen_start')}, c.n AS last_seen_predictions FROM al JOIN wz a ON a.w = opened LEFT JOIN wz b ON b.w = esc JOIN wz c ON c.w = seen",
        NOISY + "," + FOLD + ", wz AS (SELECT w, count(*) AS n FROM p GROUP BY w)",
    ),
    "outbox": _q(
        f"SELECT 'drift' AS kind, {_ALERT}, {day(_END.format('opened'), 'opened_window')}, status, CASE WHEN status = 'open' THEN 'opened' ELSE status END AS event, CASE WHEN opened + INTERVAL 1 DAY < TIMESTAMP '2024-01-16' THEN 6 ELSE 1 END AS attempt FROM al "
        "WHERE NOT (opened + INTERVAL 1 DAY < TIMESTAMP '2024-01-20' AND status = 'open') AND (opened + INTERVAL 1 DAY >= TIMESTAMP '2024-01-16' OR seen >= TIMESTAMP '2024-01-28')",
        NOISY + "," + FOLD,
    ),
    "run_expectations": _q(
        "SELECT 'windows_loaded' AS name, count(DISTINCT w) >= 10 AS passed, CAST(count(DISTINCT w) AS VARCHAR) AS detail FROM p WHERE ts >= TIMESTAMP '2024-01-11' "
        "UNION ALL SELECT 'no_significant_readings', count(*) = 0, CAST(count(*) AS VARCHAR) FROM cl WHERE raw >= fire UNION ALL SELECT 'max_psi_of_value_below_0.25', max(x) < 0.25, CAST(round(max(x), 5) AS VARCHAR) FROM cl WHERE m = 'psi' AND f = 'value' AND d IS NULL "
        "UNION ALL SELECT 'no_unexpected_alerts', count(*) = 0, CAST(count(*) AS VARCHAR) FROM al WHERE NOT (m = 'psi' AND f IN ('value', 'k')) "
        "UNION ALL SELECT 'psi_of_value_opened_escalated_resolved', count(*) = 1 AND count(esc) = 1 AND count(res) = 1, CAST(count(*) AS VARCHAR) FROM al WHERE m = 'psi' AND f = 'value' AND d IS NULL "
        "UNION ALL SELECT 'suppressed_episodes', count(*) = 5, CAST(count(*) AS VARCHAR) FROM (SELECT 1 FROM st WHERE k = 'breach' GROUP BY id, run HAVING count(*) < 3) "
        "UNION ALL SELECT 'pr_auc_drops', coalesce(a >= 0.32 AND b <= 0.25, FALSE), coalesce(printf('%.3f to %.3f', a, b), 'no data') FROM (SELECT avg(x) FILTER (w < TIMESTAMP '2024-01-16') AS a, avg(x) FILTER (w >= TIMESTAMP '2024-01-16') AS b FROM mx WHERE metric_name = 'pr_auc' AND d IS NULL AND reason IS NULL)",
        LABELS + "," + _metrics("x", "lb") + "," + NOISY + "," + FOLD,
    ),
    "policy_backtest": _q(
        "SELECT f AS feature_name, d AS segment_dimension, v AS segment_value, policy, coalesce(max(CASE WHEN k = 'breach' THEN len END), 0) AS longest_breach, coalesce(max(CASE WHEN k = 'breach' THEN len END), 0) >= max(persistence) AS opens, CAST(0 AS BIGINT) AS refused, CAST(sum(CAST(k = 'clear' AS INT)) AS BIGINT) AS clear_windows, round(max(x), 6) AS peak FROM pz GROUP BY f, d, v, policy",
        "\npo AS (SELECT unnest(['loose', 'middle', 'strict']) AS policy, unnest([0.02, 0.03, 0.05]) AS fire, unnest([0.01, 0.02, 0.03]) AS clear, unnest([1, 2, 3]) AS persistence),"
        "\npc AS (SELECT f, d, v, w, round(x, 6) AS x, po.*, CASE WHEN round(x, 6) >= fire THEN 'breach' WHEN round(x, 6) <= clear THEN 'clear' ELSE 'dead_zone' END AS k FROM psi, po),"
        "\npd AS (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY f, d, v, policy ORDER BY w) THEN 0 ELSE 1 END AS c FROM pc),"
        "\npe AS (SELECT *, sum(c) OVER (PARTITION BY f, d, v, policy ORDER BY w) AS run FROM pd),"
        "\npz AS (SELECT *, row_number() OVER (PARTITION BY f, d, v, policy, run ORDER BY w) AS len FROM pe)",
    ),
    "shift_injection": (
        _q(f"SELECT {day('w')}, d AS segment_dimension, v AS segment_value, round(x, 6) AS statistic FROM psi WHERE f = 'value'").replace(
            "SELECT event_id AS id, ts, value,", "SELECT event_id AS id, ts, CASE WHEN ts >= TIMESTAMP '2024-01-20' AND event_type = 'click' THEN value + 30 ELSE value END AS value,"
        )
    ),
    "label_noise": f"""WITH {LABELS.strip()}
SELECT strftime(received_at, '%Y-%m-%d') AS day, count(*) AS n, sum(CASE WHEN received_at >= TIMESTAMP '2024-01-20' AND CAST('0x' || substr(md5('0:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) < {int(0.7 * (1 << 32))} THEN 1 - y ELSE y END) AS positives FROM lb GROUP BY 1""",
    "data_range": "SELECT 'events' AS model_id, strftime(min(date_trunc('day', ts)), '%Y-%m-%d') AS first_day, strftime(max(date_trunc('day', ts)) + INTERVAL 1 DAY, '%Y-%m-%d') AS last_day, count(DISTINCT date_trunc('day', ts)) AS windows FROM events",
    "ingest_predictions": """
WITH e AS (SELECT event_id AS id FROM events)
SELECT id AS prediction_id, CASE WHEN id % 11 = 0 THEN 'reject' WHEN id % 20 = 0 THEN 'conflict' WHEN id % 2 = 0 THEN 'skip' ELSE 'insert' END AS outcome FROM e""",
    "ingest_labels": f"""
WITH {LABELS.strip()}, x AS (SELECT DISTINCT id, label_id, y, id % 13 <> 0 AS known, id % 2 = 0 AND label_id % 2 = 0 AS stored FROM lb)
SELECT id AS prediction_id, 'insert' AS outcome, y AS label_value FROM x WHERE known AND NOT stored
UNION ALL SELECT id, 'skip', y FROM x WHERE known AND stored
UNION ALL SELECT id, 'correction', y FROM x WHERE known AND NOT stored AND id % 2 = 0
UNION ALL SELECT id, 'unknown', y FROM x WHERE NOT known""",
    "bulk_loaded": "SELECT 'events' AS model_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT (event_type, value)) AS payloads FROM events GROUP BY 2",
    "baseline_errors": """
SELECT array_to_string(list_concat(['unknown features: [''extra'']'], CASE WHEN value IS NULL THEN ['feature ''value'' is required'] ELSE [] END, CASE WHEN event_id % 3 = 0 THEN ['feature ''k'' is required'] ELSE [] END,
  CASE WHEN user_id IS NULL THEN ['feature ''user_group'' is required'] ELSE ['feature ''user_group'' must be a string or boolean'] END, CASE WHEN event_id % 5 = 0 OR event_type IS NULL THEN ['feature ''event_type'' is required'] ELSE [] END), '; ') AS errors, count(*) AS n FROM events GROUP BY 1""",
    "late_counts": f"SELECT {day('w')}, count(*) AS late_prediction_count FROM (SELECT date_trunc('day', ts) AS w FROM events WHERE event_id % 9 = 0) WHERE w IN (SELECT date_trunc('day', ts) FROM events WHERE event_id % 9 <> 0) GROUP BY w",
    "stale_windows": f"WITH {LABELS.strip()} SELECT {day('w')} FROM (SELECT DISTINCT date_trunc('day', ts) AS w FROM lb WHERE received_at >= TIMESTAMP '2024-01-15' AND received_at < TIMESTAMP '2024-01-16')",
    "unevaluated_windows": f"SELECT {day('w')} FROM (SELECT DISTINCT date_trunc('day', ts) AS w FROM events) WHERE day(w) % 4 = 0 AND w + INTERVAL 1 DAY + INTERVAL 10 MINUTE <= TIMESTAMP '2024-01-25 00:05:00'",
    "validation_errors": """
WITH e AS (SELECT event_id AS i, event_type FROM events),
x AS (SELECT i, list_concat(
  CASE WHEN i % 7 = 0 THEN ['unknown features: [''extra'']'] ELSE [] END, CASE WHEN i % 5 = 0 THEN ['feature ''value'' must be numeric'] ELSE [] END, CASE WHEN i % 2 <> 0 AND i % 11 = 0 THEN ['feature ''k'' must be numeric'] ELSE [] END,
  CASE WHEN i % 4 = 1 THEN ['feature ''user_group'' must be a string or boolean'] WHEN i % 4 = 3 THEN ['feature ''user_group'' is required'] ELSE [] END,
  CASE WHEN i % 3 = 0 OR event_type IS NULL THEN ['feature ''event_type'' is required'] ELSE [] END) AS errors FROM e)
SELECT i AS event_id, CAST(len(errors) AS INT) AS n_errors, coalesce(array_to_string(errors, '; '), '') AS errors FROM x""",
    "trace_export": _q(
        "SELECT 'events' AS model_id, CAST(row_number() OVER (ORDER BY o.w) - 1 AS INT) AS i, round(x, 4) AS value, count(*) OVER () AS windows, CAST(sum(CAST(x >= 0.1 AS INT)) OVER () AS BIGINT) AS significant "
        "FROM (SELECT DISTINCT w FROM p WHERE ts >= TIMESTAMP '2024-01-11') o LEFT JOIN (SELECT * FROM psi WHERE f = 'value' AND d IS NULL) g ON o.w = g.w"
    ),
    "run_trace": _q(
        "SELECT 'drift' AS section, f AS name, 'psi' AS method, d AS segment_dimension, v AS segment_value, CAST(date_diff('day', t0, w) AS INT) AS i, CASE WHEN reason IS NULL THEN round(x, 4) END AS value, CASE WHEN reason IS NULL THEN 'computed' ELSE 'not_computable' END AS status, "
        "CAST(CASE WHEN nw < 50 THEN 0 WHEN d IS NOT NULL AND ns < 30 THEN ns ELSE nl END AS BIGINT) AS n, CAST(NULL AS INT) AS escalated, CAST(NULL AS INT) AS resolved, CAST(NULL AS INT) AS last_seen FROM gb JOIN seen USING (w), z0 "
        "UNION ALL SELECT section, 'pr_auc', NULL, d, v, CAST(date_diff('day', t0, w) AS INT), CASE WHEN reason IS NULL THEN round(x, 4) END, CASE WHEN reason IS NULL THEN 'computed' ELSE 'not_computable' END, n, NULL, NULL, NULL FROM ("
        "SELECT *, 'initial' AS section FROM m1 UNION ALL SELECT *, 'final' FROM m2 "
        "UNION ALL SELECT *, 'final' FROM m1 WHERE NOT EXISTS (SELECT 1 FROM m2 WHERE m1.w = m2.w AND m1.d IS NOT DISTINCT FROM m2.d AND m1.v IS NOT DISTINCT FROM m2.v AND m1.metric_name = m2.metric_name) "
        "UNION ALL SELECT *, 'initial' FROM m2 WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.w = m2.w AND m1.d IS NOT DISTINCT FROM m2.d AND m1.v IS NOT DISTINCT FROM m2.v AND m1.metric_name = m2.metric_name)) JOIN seen USING (w), z0 WHERE metric_name = 'pr_auc' "
        "UNION ALL SELECT 'alert', 'drift ' || f, m, d, v, CAST(date_diff('day', t0, opened) AS INT), round(e1, 4), status, NULL, CAST(date_diff('day', t0, esc) AS INT), CAST(date_diff('day', t0, res) AS INT), CAST(date_diff('day', t0, seen) AS INT) FROM al, z0 WHERE m = 'psi'",
        GATED + "," + _SEEN + ", z0 AS (SELECT min(w) AS t0 FROM seen), " + LABELS + ", " + _EARLY + "," + _metrics("1", "le") + "," + _metrics("2", "lb") + "," + NOISY + "," + FOLD,
    ),
    "sensitivity_grid": _q(
        "SELECT share, magnitude, count(*) AS signals, CAST(sum(CAST(longest >= 2 AS INT)) AS BIGINT) AS opens, CAST(count(*) - sum(CAST(longest >= 2 AS INT)) - sum(CAST(rw = windows AS INT)) AS BIGINT) AS quiet, CAST(sum(CAST(rw = windows AS INT)) AS BIGINT) AS refused, CAST(sum(rw) AS BIGINT) AS refused_windows, round(max(peak), 6) AS peak, "
        "CASE WHEN share = 0 OR magnitude = 0 THEN round(sum(CAST(longest >= 2 AS INT)) / nullif(count(*) - sum(CAST(rw = windows AS INT)), 0), 6) END AS false_open_rate FROM ("
        "SELECT share, magnitude, d, v, count(*) AS windows, sum(CAST(k = 'not_computable' AS INT)) AS rw, coalesce(max(CASE WHEN k = 'breach' THEN len END), 0) AS longest, max(x) AS peak FROM gz GROUP BY ALL) GROUP BY share, magnitude",
        "\nce AS (SELECT unnest([0.0, 0.5, 0.5, 1.0, 1.0]) AS share, unnest([0.0, 0.25, 1.0, 0.25, 1.0]) AS magnitude),"
        "\nca AS (SELECT CAST(share AS DOUBLE) AS share, CAST(magnitude AS DOUBLE) AS magnitude, round(magnitude * (SELECT stddev_samp(value) FROM p WHERE ts < TIMESTAMP '2024-01-11' AND value IS NOT NULL), 6) AS amount FROM ce),"
        "\nsh AS (SELECT w, d, v, share, magnitude, value + CASE WHEN CAST('0x' || substr(md5('0:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) < share * 4294967296 THEN amount ELSE 0 END AS x FROM sl, ca WHERE ts >= TIMESTAMP '2024-01-11' AND value IS NOT NULL),"
        "\nsb AS (SELECT w, d, v, share, magnitude, CASE WHEN x = e[-1] THEN len(e) - 1 ELSE len(list_filter(e, lambda y: y <= x)) END AS bucket, len(e) + 1 AS bu FROM sh, (SELECT e FROM edges WHERE f = 'value')),"
        "\nsn AS (SELECT w, d, v, share, magnitude, bucket, bu, count(*) AS n FROM sb GROUP BY ALL), st2 AS (SELECT w, d, v, share, magnitude, bu, sum(n) AS nl FROM sn GROUP BY ALL), wn AS (SELECT w, count(*) AS nw FROM p GROUP BY w),"
        "\nsg AS (SELECT t.*, bn.n AS nb, unnest(range(0, bu)) AS bucket FROM st2 t JOIN bn ON bn.f = 'value' AND t.d IS NOT DISTINCT FROM bn.d AND t.v IS NOT DISTINCT FROM bn.v),"
        "\nsq AS (SELECT g.*, greatest(coalesce(sn.n, 0) / g.nl, 1e-4) AS pl, greatest(coalesce(bc.n, 0) / g.nb, 1e-4) AS pb FROM sg g LEFT JOIN sn ON g.w = sn.w AND g.share = sn.share AND g.magnitude = sn.magnitude AND g.bucket = sn.bucket AND g.d IS NOT DISTINCT FROM sn.d AND g.v IS NOT DISTINCT FROM sn.v "
        "LEFT JOIN bc ON bc.f = 'value' AND bc.bucket = g.bucket AND g.d IS NOT DISTINCT FROM bc.d AND g.v IS NOT DISTINCT FROM bc.v),"
        "\nsp AS (SELECT w, d, v, share, magnitude, nl, nb, nw, sum((pl - pb) * ln(pl / pb)) AS x, (bu - 1) * (1 / nb + 1 / nl) + 2 * sqrt(2 * (bu - 1)) * (1 / nb + 1 / nl) AS c FROM sq JOIN wn USING (w) GROUP BY w, d, v, share, magnitude, nl, nb, nw, bu),"
        "\nsk AS (SELECT *, CASE WHEN nw < 50 OR (d IS NOT NULL AND nl < 30) OR c > 0.07 THEN 'not_computable' WHEN x >= 0.1 THEN 'breach' WHEN x <= 0.07 THEN 'clear' ELSE 'dead_zone' END AS k FROM sp WHERE nw >= 50 OR d IS NULL),"
        "\ngx AS (SELECT * REPLACE (CASE WHEN k <> 'not_computable' THEN x END AS x), CASE WHEN k = lag(k) OVER (PARTITION BY d, v, share, magnitude ORDER BY w) THEN 0 ELSE 1 END AS ch FROM sk),"
        "\ngy AS (SELECT *, sum(ch) OVER (PARTITION BY d, v, share, magnitude ORDER BY w) AS run FROM gx),"
        "\ngz AS (SELECT *, row_number() OVER (PARTITION BY d, v, share, magnitude, run ORDER BY w) AS len FROM gy)",
    ),
    "known_segments": _q("SELECT f AS feature_name, m AS test_method, d AS segment_dimension, string_agg(v, ',' ORDER BY v) AS segments FROM (SELECT DISTINCT f, CASE WHEN f IN ('value', 'k') THEN 'psi' ELSE 'chi_square' END AS m, d, v FROM ln WHERE d IS NOT NULL AND f <> '__prediction_score__') GROUP BY ALL"),
    "metric_display": _q(
        f"SELECT {day('w')}, d AS segment_dimension, v AS segment_value, metric_name, CASE WHEN reason IS NOT NULL THEN 'not_computable' WHEN metric_name = 'pr_auc' AND x <= 0.25 THEN 'breach' ELSE 'normal' END AS display FROM mx", LABELS + "," + _metrics("x", "lb")
    ),
}
