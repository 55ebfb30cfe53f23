"""The registered queries in SQL for DuckDB, written independently of the Spark plans.

Pairs and neighbours are found by plain self-joins here; the Spark side never
forms them for large groups.
"""

from __future__ import annotations

from coloom.functions import vocab
from coloom.operators.features import TRANSPORTS, VENUES
from coloom.plans.catalog import CASCADE, SHIP_CUTOVER, SHIP_FESTIVAL, WORDS
from coloom.plans.sweeps import SEEDS, WINDOWS


def r(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def lit(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


VISITS = """visits AS (
  SELECT c_custkey AS case_id, n_name AS province, l_suppkey AS venue, CAST(l_shipdate AS DATE) AS day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

CASES = """cases AS (
  SELECT c_custkey AS case_id, n_name AS province,
    CAST(CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 90 END AS INTEGER) AS age,
    CASE WHEN c_mktsegment = 'BUILDING' THEN NULL
         WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'M' ELSE 'F' END AS gender,
    CAST(c_nationkey < 5 AS INTEGER) AS wuhan_related,
    CAST(c_acctbal < 0 AS INTEGER) AS is_asymptomatic
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

CLICKS = """clicks AS (
  SELECT event_id, user_id AS case_id, event_type AS venue, ts, CAST(ts AS DATE) AS day FROM events)"""


def band(k: int, name: str = "arcs") -> str:
    """Directed distinct neighbours within k days with their smallest distance."""
    return f"""{name} AS (
  SELECT a.case_id AS src, b.case_id AS dst, min(abs(a.day - b.day)) AS gap
  FROM visits a JOIN visits b ON a.province = b.province AND a.venue = b.venue
    AND a.case_id <> b.case_id AND abs(a.day - b.day) <= {k}
  GROUP BY ALL)"""


def label(k: int) -> str:
    return f"""EXISTS (SELECT 1 FROM visits b WHERE b.province = a.province AND b.venue = a.venue
      AND b.case_id <> a.case_id AND abs(b.day - a.day) <= {k})"""


def labels(*ks: int) -> str:
    cols = ", ".join(f"CAST(max(CAST({label(k)} AS INTEGER)) AS INTEGER) AS label_{k}" for k in ks)
    return f"hits AS (SELECT a.case_id, {cols} FROM visits a GROUP BY a.case_id)"


def all_labels(*ks: int) -> str:
    cols = ", ".join(f"coalesce(label_{k}, 0) AS label_{k}" for k in ks)
    return f"{labels(*ks)}, labels AS (SELECT case_id, {cols} FROM cases LEFT JOIN hits USING (case_id))"


# -- numbers SQL lacks: tail probabilities by Simpson's rule ------------------


def simpson(f: str, lo: str, hi: str, steps: int = 4000) -> str:
    """Integral of f(x) from lo to hi; f is written in the lambda variable x."""
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    value = f.replace("{x}", f"(({lo}) + (({hi}) - ({lo})) * i / {steps}.0)")
    return f"((({hi}) - ({lo})) / {steps * 3}.0 * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * ({value}))))"


def t_p(t: str, df: str) -> str:
    """Two-sided p: with t = sqrt(df) tan(a) the density is a power of cos(a)."""
    f = f"pow(cos({{x}}), ({df}) - 1)"
    area = simpson(f, f"atan(abs({t}) / sqrt({df}))", "pi() / 2")
    return f"(2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {area})"


def f_p(f: str, d1: str, d2: str) -> str:
    """Upper tail: incomplete beta of x = d2 / (d2 + d1 f) with x = sin(a)^2."""
    g = f"pow(sin({{x}}), ({d2}) - 1) * pow(cos({{x}}), ({d1}) - 1)"
    area = simpson(g, "0.0", f"asin(sqrt(({d2}) / (({d2}) + ({d1}) * ({f}))))")
    return (
        f"(2 * exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0)) * {area})"
    )


def z_p(z: str) -> str:
    return f"(1 - 2 * {simpson('exp(-{x} * {x} / 2)', '0.0', z)} / sqrt(2 * pi()))"


def stars(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE '' END"


def elimination(k: int, source: str, prefix: str, keep: str) -> tuple[str, str]:
    """CTEs that solve the k x k system a_i_j | b_i of the one-row relation ``source``.

    Gauss-Jordan on the matrix extended by the identity, so the inverse comes too.
    """
    cols = [f"a_{i}_{j}" for i in range(k) for j in range(k)] + [f"b_{i}" for i in range(k)]
    inv = [f"v_{i}_{j}" for i in range(k) for j in range(k)]
    ctes = [
        f"{prefix}0 AS (SELECT {keep}, {', '.join(cols)}, "
        + ", ".join(f"{'1.0' if i == j else '0.0'}::DOUBLE AS v_{i}_{j}" for i in range(k) for j in range(k))
        + f" FROM {source})"
    ]
    for p in range(k):
        parts = []
        for i in range(k):
            for name in [*(f"a_{{}}_{j}" for j in range(k)), "b_{}", *(f"v_{{}}_{j}" for j in range(k))]:
                mine, pivot = name.format(i), name.format(p)
                if i == p:
                    parts.append(f"{mine} / a_{p}_{p} AS {mine}")
                else:
                    parts.append(f"{mine} - a_{i}_{p} * {pivot} / a_{p}_{p} AS {mine}")
        ctes.append(f"{prefix}{p + 1} AS (SELECT {keep}, {', '.join(parts)} FROM {prefix}{p})")
    assert len(inv) == k * k
    return ", ".join(ctes), f"{prefix}{k}"


def design(xs: list[str], y: str, source: str, name: str) -> str:
    """One row with the normal equations of y on xs."""
    a = [f"sum(({x}) * ({z})) AS a_{i}_{j}" for i, x in enumerate(xs) for j, z in enumerate(xs)]
    b = [f"sum(({x}) * ({y})) AS b_{i}" for i, x in enumerate(xs)]
    return f"{name} AS (SELECT {', '.join(a + b)}, count(*) AS n FROM {source})"


# -- weekly series ------------------------------------------------------------

SERIES = f"""span AS (SELECT min(day) AS a, max(day) AS b FROM visits),
wk AS (SELECT visits.*, CAST(floor((day - a) / 7.0) AS INTEGER) AS week_num FROM visits, span),
arcs AS (SELECT DISTINCT x.week_num, x.case_id AS src, y.case_id AS dst
  FROM wk x JOIN wk y ON x.province = y.province AND x.venue = y.venue AND x.day = y.day AND x.case_id <> y.case_id),
reach(week_num, src, node) AS (
  SELECT week_num, src, src FROM arcs
  UNION SELECT reach.week_num, reach.src, arcs.dst FROM reach JOIN arcs
    ON reach.week_num = arcs.week_num AND reach.node = arcs.src),
comp AS (SELECT week_num, src, count(*) AS size FROM reach GROUP BY ALL),
lcc AS (SELECT week_num, max(size) AS lcc FROM comp GROUP BY ALL),
edge AS (SELECT week_num, count(*) AS ends, count(DISTINCT src) AS nodes FROM arcs GROUP BY ALL),
cnt AS (SELECT week_num, count(*) AS n_events, count(DISTINCT case_id) AS n_cases FROM wk GROUP BY ALL),
series AS (
  SELECT CAST(a + 7 * CAST(w.i AS INTEGER) AS DATE) AS week_start, CAST(w.i AS INTEGER) AS week_num,
    CAST(a + 7 * CAST(w.i AS INTEGER) >= DATE '{SHIP_CUTOVER}' AS INTEGER) AS post,
    CAST(a + 7 * CAST(w.i AS INTEGER) >= DATE '{SHIP_FESTIVAL}' AS INTEGER) AS spring_festival,
    CAST(CASE WHEN a + 7 * CAST(w.i AS INTEGER) >= DATE '{SHIP_CUTOVER}'
      THEN (a + 7 * CAST(w.i AS INTEGER) - DATE '{SHIP_CUTOVER}') // 7 ELSE 0 END AS INTEGER) AS post_weeks,
    coalesce(n_events, 0) AS n_events, coalesce(n_cases, 0) AS n_cases,
    CAST(coalesce(ends, 0) / 2 AS BIGINT) AS n_edges,
    CASE WHEN n_cases IS NULL THEN 0.0 ELSE coalesce(ends, 0) / 2.0 / greatest(n_cases * (n_cases - 1) / 2.0, 1.0) END AS density,
    CASE WHEN nodes > 0 THEN ends * 1.0 / nodes ELSE 0.0 END AS avg_degree,
    CASE WHEN n_cases IS NULL THEN 0.0 ELSE coalesce(lcc, 1) * 1.0 / n_cases END AS lcc_ratio
  FROM span, range(0, (SELECT (b - a) // 7 + 1 FROM span)) w(i)
  LEFT JOIN cnt ON cnt.week_num = w.i LEFT JOIN edge ON edge.week_num = w.i LEFT JOIN lcc ON lcc.week_num = w.i),
act AS (SELECT *, CAST(row_number() OVER (ORDER BY week_num) - 1 AS INTEGER) AS t FROM series WHERE n_edges > 0)"""

WITH_SERIES = f"WITH RECURSIVE {VISITS}, {SERIES}"


def its(terms: list[str], xs: list[str]) -> str:
    k = len(xs)
    ctes, last = elimination(k, "norm", "g", "n")
    fit = " + ".join(f"b_{i} * ({x})" for i, x in enumerate(xs))
    picks = " UNION ALL ".join(
        f"SELECT '{t}' AS term, b_{i} AS coef, sqrt(greatest(mse * v_{i}_{i}, 0)) AS se, r2, n, df FROM fitted" for i, t in enumerate(terms)
    )
    return f"""{WITH_SERIES}, {design(xs, 'n_edges', 'act', 'norm')}, {ctes},
    res AS (SELECT sum(pow(n_edges - ({fit}), 2)) AS ss_res,
      sum(pow(n_edges - (SELECT avg(n_edges) FROM act), 2)) AS ss_tot FROM act, {last}),
    fitted AS (SELECT {last}.*, ss_res / greatest(n - {k}, 1) AS mse, 1 - ss_res / (ss_tot + 1e-12) AS r2,
      greatest(n - {k}, 1) AS df FROM {last}, res),
    rows AS ({picks}),
    tested AS (SELECT *, coef / (se + 1e-12) AS t FROM rows),
    done AS (SELECT *, {t_p('t', 'df')} AS p FROM tested)
    SELECT term, {r('coef')} AS coef, {r('se')} AS se, {r('t')} AS t, {r('p')} AS p, {stars('p')} AS sig,
      {r('r2')} AS r2, n, FALSE AS rank_deficient FROM done"""


def granger() -> str:
    parts, picks = [], []
    lags = ", ".join(
        f"lag({c}, {k}) OVER (ORDER BY week_num) AS {c}_{k}" for k in (1, 2, 3) for c in ("y", "x")
    )
    base = f"base AS (SELECT week_num, avg_degree AS y, post * 1.0 AS x FROM series), lagged AS (SELECT *, {lags} FROM base)"
    for lag in (1, 2, 3):
        own = ["1.0", *[f"y_{i}" for i in range(1, lag + 1)]]
        full = own + [f"x_{i}" for i in range(1, lag + 1)]
        parts.append(f"d{lag} AS (SELECT * FROM lagged WHERE y_{lag} IS NOT NULL)")
        for tag, xs in (("r", own), ("u", full)):
            ctes, last = elimination(len(xs), f"n{tag}{lag}", f"g{tag}{lag}_", "n")
            fit = " + ".join(f"b_{i} * ({x})" for i, x in enumerate(xs))
            parts.append(design(xs, "y", f"d{lag}", f"n{tag}{lag}"))
            parts.append(ctes)
            parts.append(f"s{tag}{lag} AS (SELECT sum(pow(y - ({fit}), 2)) AS ss, max(n) AS n FROM d{lag}, {last})")
        picks.append(
            f"""SELECT {lag} AS lag, greatest(sr{lag}.ss - su{lag}.ss, 0) / {lag} / (su{lag}.ss / (su{lag}.n - {len(full)})) AS f,
            {lag} AS df_num, su{lag}.n - {len(full)} AS df_den FROM sr{lag}, su{lag}"""
        )
    return f"""{WITH_SERIES}, {base}, {', '.join(parts)}, t AS ({' UNION ALL '.join(picks)}),
    q AS (SELECT *, {f_p('f', 'df_num', 'df_den')} AS p FROM t)
    SELECT CAST(lag AS INTEGER) AS lag, {r('f')} AS f, {r('p')} AS p, CAST(df_num AS INTEGER) AS df_num,
      CAST(df_den AS BIGINT) AS df_den, '' AS note, {stars('p')} AS sig FROM q"""


# -- reports spelled out from shipped lines -----------------------------------

_VENUE_WORDS = sql_list([w[0] for w in vocab.VENUES.values()])
_TRANSPORT_WORDS = sql_list(list(vocab.TRANSPORTS))
REPORTS = f"""reports AS (
  SELECT l_orderkey || '-' || l_linenumber AS report_id, '区域' || (l_suppkey % 30) AS province,
    '通报如下。第' || l_orderkey || '号确诊病例，' ||
    CASE l_returnflag WHEN 'A' THEN '男' WHEN 'N' THEN '女' ELSE '患者' END || '，' || CAST(l_quantity AS INTEGER) || ' 岁。' ||
    month(l_shipdate) || '月' || day(l_shipdate) || '日到' || {_VENUE_WORDS}[l_suppkey % {len(vocab.VENUES)} + 1] || '；乘坐' ||
    {_TRANSPORT_WORDS}[l_partkey % {len(vocab.TRANSPORTS)} + 1] || '前往' ||
    CASE WHEN l_linenumber % 3 = 0 THEN '武汉' ELSE '外地' END || '。出现' ||
    {sql_list(vocab.SYMPTOMS)}[l_orderkey % {len(vocab.SYMPTOMS)} + 1] || '；好；第' || l_partkey || '号确诊病例，女，' ||
    CASE l_linestatus WHEN 'O' THEN '无症状' ELSE '咳嗽' END || '。' || year(l_shipdate) || '年' || month(l_shipdate) || '月' ||
    day(l_shipdate) || '日至28日在' || {_VENUE_WORDS}[l_partkey % {len(vocab.VENUES)} + 1] || '，之后' AS content
  FROM lineitem),
blocks AS (
  SELECT report_id, province, CAST(i - 1 AS INTEGER) AS case_seq, nos[i] AS case_no,
    left(province, 2) || '_' || nos[i] AS case_id, '第' || nos[i] || '号确诊病例' || parts[i + 1] AS case_text
  FROM (SELECT report_id, province, regexp_extract_all(content, '第([0-9]+)号确诊病例', 1) AS nos,
      string_split_regex(content, '第[0-9]+号确诊病例') AS parts FROM reports), range(1, 3) AS s(i))"""
WITH_BLOCKS = f"WITH {REPORTS}"

DATE_RE = "(?:([0-9]{4})年)?([0-9]{1,2})月([0-9]{1,2})日(?:至(?:([0-9]{1,2})月)?([0-9]{1,2})日?)?"


def _part(mention: str, i: int) -> str:
    return f"nullif(regexp_extract({mention}, '{DATE_RE}', {i}), '')"


def _date(mention: str, end: bool) -> str:
    y = f"coalesce({_part(mention, 1)}, '2020')"
    m = f"coalesce({_part(mention, 4)}, {_part(mention, 2)})" if end else _part(mention, 2)
    d = _part(mention, 5) if end else _part(mention, 3)
    return f"TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"


def mentions(text: str) -> str:
    """List of dates in text order; a mention with an impossible date is dropped."""
    one = f"""CASE WHEN {_part('m', 5)} IS NULL THEN
        CASE WHEN {_date('m', False)} IS NULL THEN [] ELSE [{_date('m', False)}] END
      ELSE CASE WHEN {_date('m', False)} IS NULL OR {_date('m', True)} IS NULL THEN []
        ELSE [{_date('m', False)}, {_date('m', True)}] END END"""
    return f"flatten(list_transform(regexp_extract_all({text}, '{DATE_RE}', 0), lambda m: {one}))"


def any_word(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def classes(text: str, groups) -> str:
    hits = ", ".join(f"CASE WHEN {any_word(text, ws)} THEN {lit(name)} END" for name, ws in groups.items())
    return f"list_sort(list_filter([{hits}], lambda q: q IS NOT NULL))"


def cascade(text: str, rules, other: int) -> str:
    whens = " ".join(f"WHEN {any_word(text, ws)} THEN {code}" for code, ws in rules)
    return f"CAST(CASE {whens} ELSE {other} END AS INTEGER)"


_CODES: dict[str, list[str]] = {}
for _w, _c in vocab.TRANSPORTS.items():
    _CODES.setdefault(_c, []).append(_w)

EVENT_ROWS = f"""sents AS (
  SELECT case_id, province, trim(s) AS sentence FROM blocks, unnest(regexp_extract_all(case_text, '[^。；;]+[。；;]')) AS u(s)
  WHERE length(trim(s)) >= 3),
found AS (
  SELECT *, {classes('sentence', vocab.VENUES)} AS venues, {classes('sentence', _CODES)} AS transports,
    {classes('sentence', {s: [s] for s in vocab.SYMPTOMS})} AS symptoms, {mentions('sentence')} AS ds FROM sents),
ev AS (
  SELECT case_id, province, {cascade('sentence', vocab.EVENT_CASCADE, 9)} AS event_type, ds[1] AS date,
    venues, transports, symptoms, sentence, ds[1] >= DATE '2020-01-23' AS is_lockdown
  FROM found WHERE len(ds) > 0 OR len(venues) > 0 OR len(transports) > 0),
named AS (SELECT ev.*, {sql_list(vocab.EVENT_TYPES.values())}[event_type] AS event_type_name FROM ev)"""

META = f"""meta AS (
  SELECT case_id, province,
    TRY_CAST(nullif(regexp_extract(case_text, '([0-9]+)\\s*岁', 1), '') AS INTEGER) AS age,
    CASE WHEN instr(case_text, '男') > 0 AND (instr(case_text, '女') = 0 OR instr(case_text, '男') < instr(case_text, '女')) THEN 'M' WHEN instr(case_text, '女') > 0 THEN 'F' END AS gender,
    CAST({any_word('case_text', vocab.HOTSPOT_WORDS)} AS INTEGER) AS wuhan_related,
    CAST({any_word('case_text', vocab.ASYMPTOMATIC_WORDS)} AS INTEGER) AS is_asymptomatic,
    ds[1] AS first_date, ds[len(ds)] AS last_date
  FROM (SELECT *, {mentions('case_text')} AS ds FROM blocks))"""

_EITHER = "(?:([0-9]{4})年)?([0-9]{1,2})月([0-9]{1,2})日"
_ONE = (
    f"TRY_CAST(coalesce(nullif(regexp_extract(m, '{_EITHER}', 1), ''), '2020') || '-' || "
    f"lpad(regexp_extract(m, '{_EITHER}', 2), 2, '0') || '-' || lpad(regexp_extract(m, '{_EITHER}', 3), 2, '0') AS DATE)"
)
DETAILS = f"""details AS (
  SELECT province, case_no AS case_id, case_text AS text,
    list_filter(list_transform(regexp_extract_all(case_text, '{_EITHER}', 0), lambda m: {_ONE}), lambda d: d IS NOT NULL) AS dates,
    {classes('case_text', vocab.STAT_VENUES)} AS venues, {classes('case_text', vocab.STAT_SYMPTOMS)} AS symptoms,
    {any_word('case_text', vocab.ASYMPTOMATIC_WORDS)} AS is_asymptomatic, {any_word('case_text', vocab.HOTSPOT_WORDS)} AS wuhan_connection,
    coalesce(TRY_CAST(nullif(regexp_extract(case_text, '([0-9]+)岁', 1), '') AS INTEGER),
      TRY_CAST(nullif(regexp_extract(case_text, '年龄([0-9]+)', 1), '') AS INTEGER),
      TRY_CAST(nullif(regexp_extract(case_text, '约([0-9]+)岁', 1), '') AS INTEGER)) AS age,
    CASE WHEN instr(case_text, '男') > 0 AND (instr(case_text, '女') = 0 OR instr(case_text, '男') < instr(case_text, '女')) THEN '男' WHEN instr(case_text, '女') > 0 THEN '女' END AS gender
  FROM blocks)"""


def coverage(source: str, cutover: str) -> str:
    return f"""cov AS (SELECT min(d) AS first_date, max(d) AS last_date,
    count(*) FILTER (d < {cutover}) AS pre_records, count(*) FILTER (d >= {cutover}) AS post_records FROM {source}),
  verdict AS (SELECT first_date, last_date, CAST(last_date - first_date AS INTEGER) AS days_span, pre_records, post_records,
    CASE WHEN pre_records > 0 AND post_records > 0 AND {cutover} - first_date >= 7 AND last_date - {cutover} >= 14 THEN 'SUFFICIENT'
      WHEN pre_records > 0 AND post_records > 0 THEN 'LIMITED' WHEN pre_records > 0 THEN 'PRE_ONLY'
      WHEN post_records > 0 THEN 'POST_ONLY' ELSE 'UNKNOWN' END AS coverage FROM cov)"""


def share(source: str, col: str, name: str | None = None) -> str:
    name = name or col
    return f"""SELECT {col} AS {name}, count(*) AS n, {r('count(*) * 1.0 / (SELECT count(*) FROM ' + source + ')')} AS share
    FROM {source} GROUP BY 1"""


# -- risk ---------------------------------------------------------------------

RATES = f"""{VISITS}, {labels(3)},
who AS (SELECT DISTINCT venue, province, case_id FROM visits),
cells AS (SELECT venue, province, count(*) AS n_cases, sum(coalesce(label_3, 0)) AS c
  FROM who LEFT JOIN hits USING (case_id) GROUP BY ALL),
rates AS (SELECT venue, province, n_cases, c * 1.0 / n_cases AS rate FROM cells WHERE n_cases >= 5)"""

DEGREES = f"""{VISITS}, {CASES}, {band(3)},
deg AS (SELECT src, count(*) AS degree FROM arcs GROUP BY src),
pos AS (SELECT case_id, is_asymptomatic, coalesce(degree, 0) AS degree FROM cases LEFT JOIN deg ON src = case_id)"""


def mwu(source: str, value: str, prefix: str = "") -> str:
    return f"""{prefix}rk AS (SELECT is_asymptomatic AS y, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0 AS rk FROM {source}),
{prefix}tie AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM {source} GROUP BY {value})),
{prefix}u0 AS (SELECT sum(y) AS n1, sum(1 - y) AS n0, sum(y * rk) AS r1 FROM {prefix}rk),
{prefix}u1 AS (SELECT n1, n0, r1 - n1 * (n1 + 1) / 2.0 AS u_stat, n1 * n0 / 2.0 AS mean_u,
  sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - ties / ((n1 + n0) * 1.0 * (n1 + n0 - 1)))) AS sd_u FROM {prefix}u0, {prefix}tie),
{prefix}u2 AS (SELECT *, greatest(abs(u_stat - mean_u) - 0.5, 0.0) / sd_u AS z FROM {prefix}u1)"""


def cohen(source: str, value: str) -> str:
    return f"""SELECT avg({value}) FILTER (is_asymptomatic = 1) AS mean_1, stddev_pop({value}) FILTER (is_asymptomatic = 1) AS std_1,
    avg({value}) FILTER (is_asymptomatic = 0) AS mean_0, stddev_pop({value}) FILTER (is_asymptomatic = 0) AS std_0 FROM {source}"""


COHEN_D = "(mean_1 - mean_0) / (sqrt((std_1 * std_1 + std_0 * std_0) / 2) + 1e-9)"


def closed() -> str:
    """Transitivity over all edges."""
    return """deg2 AS (SELECT src, count(*) AS degree FROM arcs GROUP BY src),
cl AS (SELECT src, count(*) AS closed FROM arcs ab WHERE EXISTS (
  SELECT 1 FROM arcs ac JOIN arcs cb ON cb.src = ac.dst WHERE ac.src = ab.src AND cb.dst = ab.dst) GROUP BY src)"""


def windows(k: int) -> str:
    """Windows of k days with two people or more, from a day somebody was there: days, people, sizes."""
    return f"""vs AS (SELECT DISTINCT case_id AS node, province, venue, day FROM visits),
days AS (SELECT DISTINCT node, province, venue, s, day FROM vs JOIN (SELECT DISTINCT province, venue, day AS s FROM vs) st USING (province, venue)
  WHERE day BETWEEN s AND s + {k}),
w AS (SELECT DISTINCT node, province, venue, s FROM days),
sizes AS (SELECT province, venue, s, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 1)"""


GCN = """deg AS (SELECT src, count(*) AS k FROM arcs GROUP BY 1),
v AS (SELECT c_custkey AS node, sqrt(1 / (coalesce(k, 0) + 1.0)) AS root, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation
  FROM customer LEFT JOIN deg ON src = c_custkey),
p AS (SELECT src, sum(root * balance) AS b, sum(root * nation) AS n FROM arcs JOIN v ON v.node = dst GROUP BY 1)"""

# Customers of a market segment who ordered in the same quarter: groups of a hundred and more.
CROWD = """visits AS (SELECT o_custkey AS case_id, c_mktsegment AS province, 'all' AS venue, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS day
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


# -- features -----------------------------------------------------------------

SHIP_EVENTS = f"""evt AS (
  SELECT c_custkey AS case_id, n_name AS province,
    CASE WHEN l_tax < 0.08 THEN CAST(l_shipdate AS DATE) END AS date,
    {sql_list(VENUES)}[l_suppkey % {len(VENUES)} + 1] AS venue,
    CASE WHEN l_linenumber % 2 = 1 THEN {sql_list(TRANSPORTS)}[l_partkey % {len(TRANSPORTS)} + 1] END AS transport,
    CASE WHEN l_returnflag = 'R' THEN {sql_list(vocab.SYMPTOMS)}[l_orderkey % {len(vocab.SYMPTOMS)} + 1] END AS symptom
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def clip(col: str, k: int) -> str:
    return f"least(coalesce({col}, 0), {k}) / {k}.0"


_FEATURES = [
    ("age_norm", "coalesce((age - lo) / (hi - lo + 1e-6), 0.0)"),
    ("is_male", "coalesce(CAST(gender = 'M' AS DOUBLE), 0.0)"),
    ("is_female", "coalesce(CAST(gender = 'F' AS DOUBLE), 0.0)"),
    ("wuhan_related", "CAST(wuhan_related AS DOUBLE)"),
    ("is_asymptomatic", "CAST(is_asymptomatic AS DOUBLE)"),
    ("first_day_norm", f"coalesce((first_date - DATE '{SHIP_CUTOVER}') / 100.0, 0.0)"),
    ("duration_norm", "coalesce((last_date - first_date) / 30.0, 0.0)"),
    ("event_count_norm", clip("n_events", 20)),
    *[(f"venue_{i}", clip(f"v{i}", 10)) for i in range(len(VENUES))],
    *[(f"transport_{t}", clip(f"t{i}", 5)) for i, t in enumerate(TRANSPORTS)],
]
_SYMPTOMS = [
    ("has_symptom", "CASE WHEN coalesce(n_symptoms, 0) > 0 THEN 1.0 ELSE 0.0 END"),
    ("symptom_count_norm", clip("n_symptoms", 5)),
]
FEATURES = f"""{CASES}, {SHIP_EVENTS},
per AS (SELECT case_id, count(*) AS n_events, min(date) AS first_date, max(date) AS last_date,
  {', '.join(f"count(*) FILTER (venue = {lit(v)}) AS v{i}" for i, v in enumerate(VENUES))},
  {', '.join(f"count(*) FILTER (transport = {lit(t)}) AS t{i}" for i, t in enumerate(TRANSPORTS))},
  count(DISTINCT symptom) AS n_symptoms FROM evt GROUP BY case_id),
rng AS (SELECT min(age) AS lo, max(age) AS hi FROM cases),
feats AS (SELECT case_id, {', '.join(f'{e} AS {n}' for n, e in _FEATURES + _SYMPTOMS)}
  FROM cases LEFT JOIN per USING (case_id), rng)"""
_V = [f"venue_{i}" for i in range(len(VENUES))]
_VSUM = " + ".join(_V)

SCORED = """scored AS (
  SELECT documents.doc_id AS id, quality AS label,
    round(1 / (1 + exp((1500 - n_chars) / 1000.0)), 3) AS score, round(1 - 1 / (1 + exp((1500 - n_chars) / 1000.0)), 2) AS other
  FROM documents JOIN labels ON documents.doc_id = labels.doc_id)"""




def metric_row(col: str, name: str) -> str:
    """AUC by average rank, AP by distinct threshold, counts at 0.5."""
    return f"""{name}_s AS (SELECT {col} AS s, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1),
{name}_c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
   sum(neg) OVER (ORDER BY s) - neg AS below, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM {name}_s),
{name}_m AS (SELECT sum(pos * (below + neg / 2.0)) / any_value(p) / any_value(n) AS auc,
   sum(pos * tp * 1.0 / (tp + fp)) / any_value(p) AS ap FROM {name}_c),
{name}_k AS (SELECT count(*) FILTER (label = 1 AND {col} >= 0.5) AS tp, count(*) FILTER (label = 0 AND {col} >= 0.5) AS fp,
   count(*) FILTER (label = 1 AND {col} < 0.5) AS fn, count(*) FILTER (label = 0 AND {col} < 0.5) AS tn FROM scored),
{name} AS (SELECT auc AS "AUC-ROC", ap AS "AP", (tp + tn) * 1.0 / (tp + tn + fp + fn) AS "Accuracy",
   CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS "F1",
   CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0.0 END AS "Precision",
   CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0.0 END AS "Recall" FROM {name}_m, {name}_k)"""


METRIC_NAMES = ["AUC-ROC", "AP", "Accuracy", "F1", "Precision", "Recall"]


def split(source: str, key: str, seed: int, name: str) -> str:
    return f"""{name} AS (SELECT {key}, CASE WHEN pos <= floor(n * 0.7) THEN 'train'
    WHEN pos <= floor(n * 0.7) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT {key}, row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) AS pos, count(*) OVER () AS n FROM {source}))"""


SEEDED = ", ".join(split("scored", "id", s, f"split{s}") for s in SEEDS)
SEED_ROWS = " UNION ALL ".join(
    f"""SELECT {s} AS seed, avg(CAST(CAST({c} >= 0.5 AS INTEGER) = label AS DOUBLE)) AS value, '{m}' AS model
    FROM scored JOIN split{s} USING (id) WHERE split = 'test'"""
    for s in SEEDS
    for m, c in (("long", "score"), ("short", "other"))
)
DELTAS = """deltas AS (SELECT seed, max(value) FILTER (model = 'long') - max(value) FILTER (model = 'short') AS delta
  FROM results GROUP BY seed)"""

SLOT = "CAST(floor(epoch(ts) / 3600) AS INTEGER)"

ORACLES: dict[str, str] = {
    "venue_frequency": f"WITH {CLICKS} SELECT venue, count(*) AS n_events, count(DISTINCT case_id) AS n_cases FROM clicks GROUP BY 1",
    "event_type_share": f"WITH {CLICKS} {share('clicks', 'venue')}",
    "top5_venues_per_province": f"""WITH {VISITS} SELECT province, venue, n, CAST(pos AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY province ORDER BY n DESC, venue) AS pos
        FROM (SELECT province, venue, count(*) AS n FROM visits GROUP BY province, venue)) WHERE pos <= 5""",
    "daily_counts": f"""WITH {CLICKS}, c AS (SELECT day, count(*) AS n FROM clicks GROUP BY 1)
        SELECT CAST(d AS DATE) AS date, coalesce(n, 0) AS count, CASE WHEN d < DATE '2024-01-16' THEN 'pre' ELSE 'post' END AS period
        FROM generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY) AS s(d) LEFT JOIN c ON c.day = CAST(s.d AS DATE)""",
    "cutover_coverage": f"WITH {CLICKS}, src AS (SELECT day AS d FROM clicks), {coverage('src', chr(68) + 'ATE ' + lit('2024-01-16'))} SELECT * FROM verdict",
    "province_stats": f"""{WITH_BLOCKS}, {DETAILS} SELECT province, count(*) AS case_count, CAST(sum(len(dates)) AS BIGINT) AS date_count,
        CAST(sum(CAST(is_asymptomatic AS INTEGER)) AS BIGINT) AS asymptomatic, CAST(sum(CAST(wuhan_connection AS INTEGER)) AS BIGINT) AS wuhan_related,
        min(list_min(dates)) AS first_date, max(list_max(dates)) AS last_date FROM details GROUP BY 1""",
    "top5_symptoms_per_province": f"""{WITH_BLOCKS}, {DETAILS}, s AS (SELECT province, unnest(symptoms) AS symptom FROM details)
        SELECT province, symptom, n, CAST(pos AS INTEGER) AS rank FROM (SELECT *,
        row_number() OVER (PARTITION BY province ORDER BY n DESC, symptom) AS pos
        FROM (SELECT province, symptom, count(*) AS n FROM s GROUP BY province, symptom)) WHERE pos <= 5""",
    "dataset_stats": f"""{WITH_BLOCKS}, {DETAILS}, src AS (SELECT unnest(dates) AS d FROM details), {coverage('src', "DATE '2020-01-23'")},
        t AS (SELECT count(*) AS total_cases, count(DISTINCT province) AS province_count, count(*) FILTER (is_asymptomatic) AS asymptomatic_count,
          count(*) FILTER (wuhan_connection) AS wuhan_connection_count FROM details)
        SELECT t.*, {r('asymptomatic_count * 100.0 / total_cases')} AS asymptomatic_ratio,
          {r('wuhan_connection_count * 100.0 / total_cases')} AS wuhan_connection_ratio, verdict.* FROM t, verdict""",
    "extraction_stats": f"""{WITH_BLOCKS}, {EVENT_ROWS}, {META},
        c AS (SELECT count(*) AS total_cases, CAST(sum(is_asymptomatic) AS BIGINT) AS asymptomatic_count FROM meta),
        e AS (SELECT count(*) AS total_events, count(date) AS dated_events, count(*) FILTER (is_lockdown = FALSE) AS pre_lockdown_events,
          count(*) FILTER (is_lockdown) AS post_lockdown_events FROM ev)
        SELECT total_cases, total_events, {r('total_events * 1.0 / total_cases')} AS avg_events_per_case, dated_events,
          {r('dated_events * 100.0 / total_events')} AS dated_ratio, pre_lockdown_events, post_lockdown_events, asymptomatic_count FROM c, e""",
    "event_type_distribution": f"{WITH_BLOCKS}, {EVENT_ROWS} {share('named', 'event_type_name')}",
    "case_blocks": f"{WITH_BLOCKS} SELECT report_id, case_seq, case_no, case_id, CAST(length(case_text) AS INTEGER) AS n_chars FROM blocks",
    "case_metadata": f"{WITH_BLOCKS}, {META} SELECT * FROM meta",
    "json_cases": f"{WITH_BLOCKS}, {META} SELECT * FROM meta",
    "json_events": f"""{WITH_BLOCKS}, {EVENT_ROWS} SELECT event_type_name, date, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS n_chars,
        CAST(sum(len(venues)) AS BIGINT) AS n_venues FROM named GROUP BY ALL""",
    "file_case_blocks": f"{WITH_BLOCKS} SELECT case_no, count(*) AS n_blocks, CAST(sum(length(case_text)) AS BIGINT) AS n_chars FROM blocks GROUP BY 1",
    "extracted_events": f"""{WITH_BLOCKS}, {EVENT_ROWS} SELECT case_id, province, event_type, event_type_name, date,
        array_to_string(venues, '|') AS venues, array_to_string(transports, '|') AS transports, array_to_string(symptoms, '|') AS symptoms,
        sentence, is_lockdown FROM named""",
    "case_details": f"""{WITH_BLOCKS}, {DETAILS} SELECT province, case_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(len(dates) AS INTEGER) AS n_dates,
        list_min(dates) AS first_date, list_max(dates) AS last_date, array_to_string(venues, '|') AS venues,
        array_to_string(symptoms, '|') AS symptoms, is_asymptomatic, wuhan_connection, age, gender FROM details""",
    "document_sentences": """SELECT doc_id, CAST(len(list_filter(list_transform(regexp_extract_all(text, '[^.;]+[.;]'),
        lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) >= 3)) AS INTEGER) AS n_sentences FROM documents""",
    "document_keyword_classes": f"SELECT doc_id, array_to_string({classes('text', WORDS)}, '|') AS classes FROM documents",
    "document_cascade": f"WITH src AS (SELECT {cascade('text', CASCADE, 9)} AS event_type FROM documents) {share('src', 'event_type')}",
    "document_prefixes": f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, md5(text) AS text_md5,
        CAST(coalesce(nullif(regexp_extract(text, '([0-9]{{1,6}}) ', 1), ''),
        nullif(regexp_extract(text, '([0-9]{{1,6}})', 1), '')) AS INTEGER) AS first_number,
        {any_word('text', ['@', 'http'])} AS has_contact FROM documents""",
    "province_labels": f"""WITH {REPORTS} SELECT CASE length(content) % 4 WHEN 0 THEN 'Beijing' WHEN 1 THEN 'Inner Mongolia' WHEN 2 THEN '某某' ELSE 'Unknown' END AS label,
        count(*) AS n FROM reports GROUP BY 1""",
    "label_same_day": f"WITH {VISITS}, {CASES}, {all_labels(0)} SELECT * FROM labels",
    "label_band": f"WITH {VISITS}, {CASES}, {all_labels(*WINDOWS)} SELECT * FROM labels",
    "label_window_sweep": f"WITH {VISITS}, {CASES}, {all_labels(*WINDOWS)} "
    + " UNION ALL ".join(
        f"SELECT {k} AS k, CAST(sum(label_{k}) AS BIGINT) AS positives, {r(f'avg(label_{k})')} AS positive_ratio FROM labels" for k in WINDOWS
    ),
    "label_distribution": f"""WITH {VISITS}, {CASES}, {all_labels(0)} SELECT CAST(sum(label_0) AS BIGINT) AS positive,
        CAST(sum(1 - label_0) AS BIGINT) AS negative, {r('avg(label_0)')} AS positive_ratio FROM labels""",
    "edges_capped_multigraph": f"""WITH g AS (SELECT DISTINCT user_id AS node, event_type AS venue, {SLOT} AS slot FROM events)
        SELECT node, venue, CAST(slot AS INTEGER) AS slot, count(*) OVER (PARTITION BY venue, slot) AS n FROM g QUALIFY n > 1""",
    "edges_same_day": f"WITH {VISITS}, {windows(0)} SELECT node, province, venue, s - DATE '1970-01-01' AS d, n FROM w JOIN sizes USING (province, venue, s)",
    "edges_band_weighted": f"""WITH {VISITS}, {windows(3)} SELECT node, province, venue, s - DATE '1970-01-01' AS d, day - DATE '1970-01-01' AS day, n
        FROM days JOIN sizes USING (province, venue, s)""",
    "edges_offset_expanded": f"WITH {VISITS}, {windows(6)} SELECT node, province, venue, s - DATE '1970-01-01' AS d, n FROM w JOIN sizes USING (province, venue, s)",
    "edge_window_sweep": " UNION ALL ".join(
        f"SELECT * FROM (WITH {VISITS}, {band(k)} SELECT {k} AS k, count(DISTINCT src) AS n_nodes, count(*) // 2 AS n_edges FROM arcs)" for k in WINDOWS
    ),
    "decay_sweep": f"""WITH {VISITS}, {band(3)} SELECT src AS node, CAST(tau AS DOUBLE) AS tau, {r('sum(exp(-gap / tau))')} AS weight
        FROM arcs, (VALUES (3.0), (5.0), (7.0), (14.0)) AS t(tau) GROUP BY ALL""",
    "crowd_edge_count": f"WITH {CROWD}, {band(0)} SELECT count(*) // 2 AS n_edges FROM arcs",
    "crowd_multi_edge_count": f"""WITH {CROWD}, s AS (SELECT province, venue, day, count(DISTINCT case_id) AS n FROM visits GROUP BY ALL)
        SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS n_edges FROM s""",
    "crowd_degree": f"WITH {CROWD}, {band(0)} SELECT src AS node, count(*) AS degree FROM arcs GROUP BY 1",
    "crowd_proximity": f"""WITH {CROWD}, {band(0)}, f AS (SELECT case_id, min(day) AS d FROM visits GROUP BY 1)
        SELECT src AS node, {r('exp(-min(abs(a.d - b.d)) / 30.0)')} AS proximity FROM arcs JOIN f a ON a.case_id = src JOIN f b ON b.case_id = dst GROUP BY 1""",
    "crowd_gcn": f"""WITH {CROWD}, {band(0)}, {GCN}
        SELECT node, {r('root * (coalesce(b, 0) + root * balance)')} AS balance, {r('root * (coalesce(n, 0) + root * nation)')} AS nation
        FROM v LEFT JOIN p ON p.src = node""",
    "crowd_transitivity": f"""WITH {CROWD}, {band(0)}, {closed()} SELECT deg2.src AS node, degree, coalesce(closed, 0) AS closed,
        {r('coalesce(closed, 0) * 1.0 / degree')} AS share FROM deg2 LEFT JOIN cl ON cl.src = deg2.src""",
    "item_edge_counts": f"""WITH {SHIP_EVENTS}, i AS (SELECT 'venue' AS dst_type, venue AS item FROM evt
        UNION ALL SELECT 'date', CAST(date AS VARCHAR) FROM evt WHERE date IS NOT NULL UNION ALL SELECT 'transport', transport FROM evt WHERE transport IS NOT NULL
        UNION ALL SELECT 'symptom', symptom FROM evt WHERE symptom IN ({', '.join(lit(s) for s in vocab.GRAPH_SYMPTOMS)}))
        SELECT dst_type, item, count(*) AS n_edges FROM i GROUP BY ALL""",
    "relation_edge_counts": f"""WITH {VISITS}, {SHIP_EVENTS}, g AS (SELECT DISTINCT * FROM visits),
        s AS (SELECT province, venue, day, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 1)
        SELECT 'case' AS src_type, dst_type, CAST(n AS BIGINT) AS n_edges FROM (
          SELECT 'venue' AS dst_type, count(*) AS n FROM evt UNION ALL SELECT 'date', count(date) FROM evt UNION ALL SELECT 'transport', count(transport) FROM evt
          UNION ALL SELECT 'symptom', count(*) FROM evt WHERE symptom IN ({', '.join(lit(s) for s in vocab.GRAPH_SYMPTOMS)})
          UNION ALL SELECT 'case', sum(n * (n - 1) / 2) FROM s)""",
    "node_map": f"""WITH {CASES}, {SHIP_EVENTS}, raw AS (SELECT DISTINCT 'case' AS node_type, CAST(case_id AS VARCHAR) AS name FROM cases
        UNION SELECT 'date', CAST(date AS VARCHAR) FROM evt WHERE date IS NOT NULL UNION SELECT 'transport', transport FROM evt WHERE transport IS NOT NULL)
        SELECT node_type, name, row_number() OVER (PARTITION BY node_type ORDER BY name) - 1 AS idx FROM raw
        UNION ALL SELECT 'venue', unnest({sql_list(VENUES)}), unnest(range(0, {len(VENUES)}))
        UNION ALL SELECT 'symptom', unnest({sql_list(vocab.GRAPH_SYMPTOMS)}), unnest(range(0, {len(vocab.GRAPH_SYMPTOMS)}))""",
    "degree_by_case": f"WITH {DEGREES} SELECT case_id AS node, degree FROM pos",
    "isolation_rate": f"""WITH {VISITS}, {CASES}, {all_labels(3)} SELECT is_asymptomatic, count(*) AS n, count(*) FILTER (label_3 = 0) AS isolated,
        {r('count(*) FILTER (label_3 = 0) * 1.0 / count(*)')} AS rate FROM cases JOIN labels USING (case_id) GROUP BY 1""",
    "isolation_overlap": f"""WITH {VISITS}, {CASES}, {all_labels(0, 3)} SELECT count(*) FILTER (label_3 = 0) AS isolated_a, count(*) FILTER (label_0 = 0) AS isolated_b,
        count(*) FILTER (label_3 = 0 AND label_0 = 0) AS both, count(*) FILTER (label_3 = 0 AND label_0 <> 0) AS only_a,
        count(*) FILTER (label_3 <> 0 AND label_0 = 0) AS only_b FROM labels""",
    "weekly_network_series": f"""{WITH_SERIES} SELECT week_start, week_num, post, spring_festival, post_weeks, n_events, n_cases, n_edges,
        {r('density')} AS density, {r('avg_degree')} AS avg_degree, {r('lcc_ratio')} AS lcc_ratio FROM series""",
    "active_week_summary": f"{WITH_SERIES} "
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, {r('pre_mean')} AS pre_mean, {r('post_mean')} AS post_mean, n_pre, n_post,
        {r('(post_mean - pre_mean) / (pre_mean + 1e-9) * 100')} AS pct_change FROM (
        SELECT coalesce(avg({m}) FILTER (post = 0), 0.0) AS pre_mean, coalesce(avg({m}) FILTER (post = 1), 0.0) AS post_mean,
        count(*) FILTER (post = 0) AS n_pre, count(*) FILTER (post = 1) AS n_post FROM act)"""
        for m in ("density", "n_edges", "avg_degree")
    ),
    "local_rank": f"""WITH {DEGREES}, s AS (SELECT arcs.src, sum(1.0 / d.degree) AS s FROM arcs JOIN deg d ON d.src = arcs.dst GROUP BY 1),
        q AS (SELECT case_id AS node, degree, 0.85 * coalesce(s, 0) AS q FROM pos LEFT JOIN s ON s.src = case_id)
        SELECT node, degree, {r('1 + q + q * q + q * q * q + q * q * q * q + q * q * q * q * q')} AS rank_times_n FROM q""",
    "two_hop_walks": f"""WITH {VISITS}, {band(3)}, deg AS (SELECT src, count(*) AS degree FROM arcs GROUP BY src)
        SELECT arcs.src AS node, count(*) AS degree, CAST(sum(d.degree) AS BIGINT) AS walks FROM arcs JOIN deg d ON d.src = arcs.dst GROUP BY 1""",
    "transitivity_share": f"""WITH {VISITS}, {band(6)}, {closed()} SELECT deg2.src AS node, degree, coalesce(closed, 0) AS closed,
        {r('coalesce(closed, 0) * 1.0 / degree')} AS share FROM deg2 LEFT JOIN cl ON cl.src = deg2.src""",
    "neighbor_mean_feature": f"""WITH {VISITS}, {band(3)} SELECT src AS node, count(*) AS degree, {r('avg(c_acctbal)')} AS mean_balance
        FROM arcs JOIN customer ON c_custkey = dst GROUP BY 1""",
    "neighbor_max_feature": f"WITH {VISITS}, {band(3)} SELECT src AS node, {r('max(c_acctbal)')} AS max_balance FROM arcs JOIN customer ON c_custkey = dst GROUP BY 1",
    "temporal_neighbor_mean": f"""WITH {VISITS}, {band(3)} SELECT src AS node, {r('sum(exp(-gap / 7.0))')} AS weight,
        {r('sum(exp(-gap / 7.0) * c_acctbal) / sum(exp(-gap / 7.0))')} AS mean_balance FROM arcs JOIN customer ON c_custkey = dst GROUP BY 1""",
    "temporal_proximity": f"""WITH {VISITS}, {band(3)}, f AS (SELECT case_id, min(day) AS d FROM visits GROUP BY 1)
        SELECT src AS node, {r('exp(-min(abs(a.d - b.d)) / 7.0)')} AS proximity FROM arcs JOIN f a ON a.case_id = src JOIN f b ON b.case_id = dst GROUP BY 1""",
    "gcn_propagation": f"""WITH {VISITS}, {band(3)}, {GCN}
        SELECT node, {r('root * (coalesce(b, 0) + root * balance)')} AS balance, {r('root * (coalesce(n, 0) + root * nation)')} AS nation
        FROM v LEFT JOIN p ON p.src = node""",
    "venue_risk_ranking": f"""WITH {RATES}, v AS (SELECT venue, coalesce(avg(c * 1.0 / n_cases) FILTER (n_cases >= 5), 0.0) AS avg_risk,
          sum(c) * 1.0 / sum(n_cases) AS cluster_rate, CAST(sum(n_cases) AS BIGINT) AS n_cases, count(*) FILTER (n_cases >= 5) AS n_provinces FROM cells GROUP BY 1)
        SELECT venue, {r('avg_risk')} AS avg_risk, {r('cluster_rate')} AS cluster_rate, n_cases, n_provinces,
          row_number() OVER (ORDER BY round(avg_risk, 12) DESC, venue) AS rank FROM v""",
    "venue_risk_with_importance": f"""WITH {CASES}, {SHIP_EVENTS} SELECT venue, count(DISTINCT case_id) AS n_cases, TRUE AS has_importance
        FROM evt WHERE date IS NOT NULL GROUP BY 1""",
    "venue_province_rates": f"WITH {RATES} SELECT venue, province, n_cases, {r('rate')} AS rate FROM rates",
    "venue_cluster_rate": f"""WITH {VISITS}, {labels(3)}, who AS (SELECT DISTINCT venue, case_id FROM visits)
        SELECT venue, count(*) AS n_cases, {r('avg(coalesce(label_3, 0))')} AS cluster_rate FROM who LEFT JOIN hits USING (case_id) GROUP BY 1""",
    "anova_venue_risk": f"""WITH {RATES}, g AS (SELECT venue, count(*) AS n, avg(rate) AS m, var_pop(rate) * count(*) AS ss FROM rates GROUP BY 1 HAVING count(*) >= 3),
        t AS (SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS total, sum(n * m) / sum(n) AS gm, sum(ss) AS ss_within FROM g),
        b AS (SELECT sum(n * pow(m - gm, 2)) AS ss_between FROM g, t),
        f AS (SELECT groups, total, ss_between, ss_within, groups - 1 AS df_between, total - groups AS df_within,
          (ss_between / (groups - 1)) / (ss_within / (total - groups)) AS f_stat FROM t, b)
        SELECT groups, total, {r('ss_between')} AS ss_between, {r('ss_within')} AS ss_within, df_between, df_within, {r('f_stat')} AS f_stat,
          {r(f_p('f_stat', 'df_between', 'df_within'))} AS p_value FROM f""",
    "mann_whitney_degree": f"""WITH {DEGREES}, {mwu('pos', 'degree')} SELECT CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, {r('u_stat')} AS u_stat,
        {r('mean_u')} AS mean_u, {r('sd_u')} AS sd_u, {r('z')} AS z, {r(z_p('z'))} AS p_value FROM u2""",
    "cohens_d_degree": f"""WITH {DEGREES}, d AS ({cohen('pos', 'degree')}) SELECT {r('mean_1')} AS mean_1, {r('std_1')} AS std_1, {r('mean_0')} AS mean_0,
        {r('std_0')} AS std_0, {r(COHEN_D)} AS cohens_d FROM d""",
    "its_normal_sums": f"{WITH_SERIES} SELECT count(*) AS n, "
    + ", ".join(
        [
            f"{r(f'sum({a} * 1.0 * {b})')} AS xx_{i}_{j}"
            for i, a in enumerate(["1.0", "t", "post", "post_weeks"])
            for j, b in enumerate(["1.0", "t", "post", "post_weeks"])
            if j >= i
        ]
        + [f"{r(f'sum({a} * n_edges)')} AS xy_{i}" for i, a in enumerate(["1.0", "t", "post", "post_weeks"])]
    )
    + f", {r('sum(n_edges * n_edges)')} AS yy, {r('sum(n_edges)')} AS y_sum FROM act",
    "its_regression": its(["intercept", "time", "level", "trend"], ["1.0", "t", "post", "post_weeks"]),
    "its_with_festival": its(
        ["intercept", "time", "level", "trend", "festival"], ["1.0", "t", "post", "post_weeks", "spring_festival"]
    ),
    "pre_post_slopes": f"""{WITH_SERIES} SELECT post, count(*) AS n, {r('regr_slope(n_edges, t)')} AS slope,
        {r('covar_samp(t, n_edges) / var_pop(t)')} AS slope_as_coded FROM act GROUP BY 1 HAVING count(*) >= 3""",
    "pre_trend": f"""{WITH_SERIES}, p AS (SELECT count(*) AS n, regr_slope(n_edges, t) AS slope, regr_r2(n_edges, t) AS r2 FROM act WHERE post = 0)
        SELECT n, {r('slope')} AS slope, {r('r2')} AS r2, {r(t_p('sqrt(r2 * (n - 2) / (1 - r2))', '(n - 2)'))} AS p FROM p""",
    "granger_lags": f"{WITH_SERIES} SELECT week_num, {r('avg_degree')} AS y, CAST(post AS DOUBLE) AS x, "
    + ", ".join(
        f"{r(f'lag({e}, {k}) OVER (ORDER BY week_num)')} AS {c}_{k}" for k in (1, 2, 3) for c, e in (("y", "avg_degree"), ("x", "post * 1.0"))
    )
    + " FROM series",
    "granger_test": granger(),
    "case_features": f"WITH {FEATURES} SELECT case_id, {', '.join(f'{r(n)} AS {n}' for n, _ in _FEATURES + _SYMPTOMS)} FROM feats",
    "case_features_small": f"WITH {FEATURES} SELECT case_id, {', '.join(f'{r(n)} AS {n}' for n, _ in _FEATURES)} FROM feats",
    "row_stats_features": f"""WITH {FEATURES} SELECT case_id, {r(_VSUM)} AS venue_total, {r(f"greatest({', '.join(_V)})")} AS venue_max,
        {r("sqrt((" + " + ".join(f"pow({v} - ({_VSUM}) / {len(_V)}, 2)" for v in _V) + f") / {len(_V)})")} AS venue_std,
        {r(" + ".join(f"CAST({v} > 0 AS DOUBLE)" for v in _V))} AS venue_diversity,
        {r("(" + " + ".join(f"transport_{t}" for t in TRANSPORTS) + f") / {len(TRANSPORTS)}")} AS transport_mean FROM feats""",
    "date_features": f"""WITH {CLICKS} SELECT DISTINCT day AS date, {r("(day - DATE '2024-01-16') / 100.0")} AS days_norm,
        {r('sin(2 * pi() * (isodow(day) - 1) / 7)')} AS dow_sin, {r('cos(2 * pi() * (isodow(day) - 1) / 7)')} AS dow_cos, 1.0::DOUBLE AS bias FROM clicks""",
    "training_counts": f"""WITH {VISITS}, {CASES}, {all_labels(*WINDOWS)}, {split('cases', 'case_id', 42, 's')}
        SELECT split, count(*) AS n, {", ".join(f"CAST(sum(label_{k}) AS BIGINT) AS positive_{k}" for k in WINDOWS)}
        FROM s JOIN labels USING (case_id) GROUP BY 1""",
    "hash_splits": f"WITH {CASES}, {split('cases', 'case_id', 42, 's')} SELECT * FROM s",
    "auc_ap_confusion": f"WITH {SCORED}, {metric_row('score', 'm')} SELECT "
    + ", ".join(r(f'"{c}"') + f' AS "{c}"' for c in METRIC_NAMES)
    + " FROM m",
    "precision_at_20": f"WITH {SCORED} SELECT {r('avg(label)')} AS \"P@20\" FROM (SELECT label FROM scored ORDER BY score DESC, id LIMIT 20)",
    "seed_metric_summary": f"""WITH {SCORED}, {SEEDED}, results AS ({SEED_ROWS}) SELECT model, 'Accuracy' AS metric, {r('avg(value)')} AS mean,
        {r('stddev_pop(value)')} AS std FROM results GROUP BY 1""",
    "paired_t_over_seeds": f"""WITH {SCORED}, {SEEDED}, results AS ({SEED_ROWS}), {DELTAS},
        s AS (SELECT count(*) AS n, avg(delta) AS mean_delta, stddev_pop(delta) AS std_delta, avg(delta) / (stddev_samp(delta) / sqrt(count(*))) AS t FROM deltas)
        SELECT n, {r('mean_delta')} AS mean_delta, {r('std_delta')} AS std_delta, {r('t')} AS t, {r(t_p('t', '(n - 1)'))} AS p FROM s""",
    "wilcoxon_over_seeds": f"""WITH {SCORED}, {SEEDED}, results AS ({SEED_ROWS}), {DELTAS},
        k AS (SELECT delta, rank() OVER (ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY abs(delta)) - 1) / 2.0 AS rk,
          row_number() OVER (ORDER BY seed) - 1 AS i FROM deltas WHERE delta <> 0),
        w AS (SELECT coalesce(sum(rk) FILTER (delta > 0), 0) AS w, count(*) AS n FROM k),
        m AS (SELECT b, coalesce(sum(rk) FILTER ((b >> CAST(i AS INTEGER)) & 1 = 1), 0) AS s
          FROM range(0, (SELECT 1 << CAST(n AS INTEGER) FROM w)) AS t(b), k GROUP BY b)
        SELECT n, {r('w')} AS w, {r('(SELECT count(*) FILTER (s >= w) * 1.0 / count(*) FROM m)')} AS p FROM w""",
    "delta_to_baseline": f"WITH {SCORED}, {metric_row('score', 'a')}, {metric_row('other', 'b')}, u AS (SELECT 'long' AS variant, * FROM a UNION ALL SELECT 'short', * FROM b) SELECT variant, "
    + ", ".join(r(f'u."{c}"') + f' AS "{c}"' for c in METRIC_NAMES)
    + ", "
    + ", ".join(r(f'u."{c}" - a."{c}"') + f' AS "d_{c}"' for c in METRIC_NAMES)
    + " FROM u, a",
}


def _period_metrics() -> str:
    return f"""{VISITS}, p AS (SELECT *, CASE WHEN day < DATE '{SHIP_CUTOVER}' THEN 'pre' ELSE 'post' END AS period FROM visits),
arcs AS (SELECT DISTINCT x.period, x.case_id AS src, y.case_id AS dst FROM p x JOIN p y ON x.period = y.period
  AND x.province = y.province AND x.venue = y.venue AND x.day = y.day AND x.case_id <> y.case_id),
reach(period, src, node) AS (SELECT period, src, src FROM arcs UNION SELECT reach.period, reach.src, arcs.dst FROM reach
  JOIN arcs ON reach.period = arcs.period AND reach.node = arcs.src),
lcc AS (SELECT period, max(size) AS lcc_size FROM (SELECT period, src, count(*) AS size FROM reach GROUP BY ALL) GROUP BY 1),
e AS (SELECT period, count(*) AS ends, count(DISTINCT src) AS n_connected FROM arcs GROUP BY 1),
n AS (SELECT period, count(DISTINCT case_id) AS n_cases FROM p GROUP BY 1),
per AS (SELECT period, n_cases, CAST(ends / 2 AS BIGINT) AS n_edges, n_connected,
  ends / 2.0 / (n_cases * (n_cases - 1) / 2.0) AS density, ends * 1.0 / n_connected AS avg_degree, lcc_size, lcc_size * 1.0 / n_cases AS lcc_ratio
  FROM n JOIN e USING (period) JOIN lcc USING (period))"""


ORACLES["network_metrics_by_period"] = f"""WITH RECURSIVE {_period_metrics()} SELECT period, n_cases, n_edges, n_connected,
    {r('density')} AS density, {r('avg_degree')} AS avg_degree, lcc_size, {r('lcc_ratio')} AS lcc_ratio FROM per"""
ORACLES["network_change"] = f"WITH RECURSIVE {_period_metrics()} " + " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, {r('pre')} AS pre, {r('post')} AS post, {r('(post - pre) / (pre + 1e-9) * 100')} AS change_pct
    FROM (SELECT max({m}) FILTER (period = 'pre') AS pre, max({m}) FILTER (period = 'post') AS post FROM per)"""
    for m in ("density", "avg_degree", "lcc_ratio")
)
ORACLES["connected_components"] = f"""WITH RECURSIVE {VISITS}, {band(0)}, reach(src, node) AS (
    SELECT src, src FROM arcs UNION SELECT reach.src, arcs.dst FROM reach JOIN arcs ON reach.node = arcs.src)
    SELECT src AS node, min(node) AS component FROM reach GROUP BY 1"""


def _global_rank() -> str:
    steps = ["r0 AS (SELECT case_id AS node, 1.0 AS r FROM cases)"]
    for i in range(5):
        steps.append(
            f"""r{i + 1} AS (SELECT case_id AS node, coalesce(x.pull, 0) + 0.15 AS r FROM cases LEFT JOIN (
            SELECT src, 0.85 * sum(r) / (count(*) + 1e-9) AS pull FROM arcs JOIN r{i} ON r{i}.node = dst GROUP BY 1) x ON x.src = case_id)"""
        )
    return f"WITH {VISITS}, {CASES}, {band(0)}, {', '.join(steps)} SELECT node, {r('r')} AS rank_times_n FROM r5"


ORACLES["global_rank"] = _global_rank()

ORACLES["indexed_edges"] = f"""WITH {CASES}, {SHIP_EVENTS},
    i AS (SELECT case_id, 'venue' AS dst_type, venue AS item FROM evt UNION ALL SELECT case_id, 'date', CAST(date AS VARCHAR) FROM evt WHERE date IS NOT NULL
      UNION ALL SELECT case_id, 'transport', transport FROM evt WHERE transport IS NOT NULL
      UNION ALL SELECT case_id, 'symptom', symptom FROM evt WHERE symptom IN ({', '.join(lit(s) for s in vocab.GRAPH_SYMPTOMS)})),
    cx AS (SELECT case_id, row_number() OVER (ORDER BY CAST(case_id AS VARCHAR)) - 1 AS src FROM cases),
    ix AS (SELECT DISTINCT dst_type, item, CASE dst_type WHEN 'venue' THEN list_position({sql_list(VENUES)}, item) - 1
      WHEN 'symptom' THEN list_position({sql_list(vocab.GRAPH_SYMPTOMS)}, item) - 1
      ELSE dense_rank() OVER (PARTITION BY dst_type ORDER BY item) - 1 END AS dst FROM i)
    SELECT dst_type, CAST(dst AS BIGINT) AS dst, count(*) AS n_edges, CAST(sum(src) AS BIGINT) AS src_sum, count(*) * 1.0::DOUBLE AS weight
    FROM i JOIN cx USING (case_id) JOIN ix USING (dst_type, item) GROUP BY 1, 2"""

_CONTRAST = f"""{DEGREES}, s AS (SELECT arcs.src, sum(1.0 / d.degree) AS s FROM arcs JOIN deg d ON d.src = arcs.dst GROUP BY 1), {closed()},
q AS (SELECT pos.*, 0.85 * coalesce(s.s, 0) AS q, coalesce(closed * 1.0 / deg2.degree, 0.0) AS transitivity, count(*) OVER () AS nn
  FROM pos LEFT JOIN s ON s.src = case_id LEFT JOIN cl ON cl.src = case_id LEFT JOIN deg2 ON deg2.src = case_id),
z AS (SELECT is_asymptomatic, CAST(degree AS DOUBLE) AS degree, transitivity,
  round(1e6 * (1 + q + q * q + q * q * q + q * q * q * q + q * q * q * q * q) / nn, 4) AS local_rank FROM q)"""
ORACLES["group_contrast"] = (
    f"WITH {_CONTRAST}, "
    + ", ".join(mwu("z", m, m[:2]) for m in ("degree", "local_rank", "transitivity"))
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, {r('mean_1')} AS mean_1, {r('std_1')} AS std_1, {r('mean_0')} AS mean_0, {r('std_0')} AS std_0,
        {r(COHEN_D)} AS cohens_d, {r('u_stat')} AS u_stat, {r('z')} AS z, {r(z_p('z'))} AS p_value FROM ({cohen('z', m)}), {m[:2]}u2"""
        for m in ("degree", "local_rank", "transitivity")
    )
)


def _between(top: str = "", k: int = 0) -> str:
    return f"""WITH RECURSIVE {VISITS}, {band(k)}, reach(s, v, d) AS (
      SELECT DISTINCT src, src, 0 FROM arcs UNION SELECT reach.s, arcs.dst, reach.d + 1 FROM reach JOIN arcs ON arcs.src = reach.v WHERE reach.d < 30),
    dist AS (SELECT s, v, min(d) AS d FROM reach GROUP BY ALL),
    sp(s, t, path) AS (SELECT DISTINCT src, src, [src] FROM arcs
      UNION ALL SELECT sp.s, arcs.dst, list_append(path, arcs.dst) FROM sp JOIN arcs ON arcs.src = sp.t
        JOIN dist ON dist.s = sp.s AND dist.v = arcs.dst AND dist.d = len(path)),
    sigma AS (SELECT s, t, count(*) AS n FROM sp GROUP BY ALL),
    inner_nodes AS (SELECT unnest(path[2:len(path) - 1]) AS node, 1.0 / n AS part FROM sp JOIN sigma USING (s, t) WHERE len(path) > 2),
    b AS (SELECT node, sum(part) AS b FROM inner_nodes GROUP BY 1), k AS (SELECT count(*) AS n FROM customer)
    SELECT node, {r('coalesce(b, 0) * 1e6 / ((n - 1.0) * (n - 2.0))')} AS {'betweenness' if top else 'betweenness_ppm'}
    FROM (SELECT DISTINCT src AS node FROM arcs) LEFT JOIN b USING (node), k {top}"""


ORACLES["betweenness"] = _between()
ORACLES["top10_betweenness"] = _between("ORDER BY 2 DESC, 1 LIMIT 10")
ORACLES["label_two_others"] = f"WITH {DEGREES} SELECT case_id, CAST(degree >= 2 AS INTEGER) AS label FROM pos"


def _structure() -> str:
    ranks = _global_rank()
    head = ranks[: ranks.rindex(" SELECT node")]
    return f"""{head}, deg AS (SELECT src, count(*) AS degree FROM arcs GROUP BY 1),
    f AS (SELECT arcs.src, count(*) AS degree, sum(d.degree) AS walks, avg(c_acctbal) AS mb, avg(c_nationkey) AS mn
      FROM arcs JOIN deg d ON d.src = arcs.dst JOIN customer ON c_custkey = arcs.dst GROUP BY 1),
    x AS (SELECT node, r, coalesce(degree, 0) AS degree, coalesce(walks, 0) AS walks, coalesce(mb, 0) AS mb, coalesce(mn, 0) AS mn FROM r5 LEFT JOIN f ON f.src = node)
    SELECT node, {r('degree * 1.0 / (SELECT max(degree) FROM x)')} AS degree_norm, {r('(mb + mn) / 2')} AS nbr_mean, {r('abs(mb - mn) / 2')} AS nbr_std,
      {r('r')} AS global_rank, {r('walks * 1.0 / (SELECT max(walks) FROM x)')} AS walks_norm FROM x"""


ORACLES["structure_features"] = _structure()
ORACLES["temporal_features"] = f"""WITH {VISITS}, {band(3)}, f AS (SELECT case_id, min(day) AS d, CAST(min(day) - DATE '1970-01-01' AS INTEGER) AS day FROM visits GROUP BY 1),
    n AS (SELECT src, count(*) AS degree, avg(c_acctbal) AS mb, avg(c_nationkey) AS mn, max(c_acctbal) AS xb, max(c_nationkey) AS xn,
      exp(-min(abs(a.d - b.d)) / 7.0) AS prox FROM arcs JOIN customer ON c_custkey = dst JOIN f a ON a.case_id = src JOIN f b ON b.case_id = dst GROUP BY 1),
    x AS (SELECT c_custkey AS node, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation, coalesce(day, 0) AS day, n.*
      FROM customer LEFT JOIN n ON src = c_custkey LEFT JOIN f ON case_id = c_custkey)
    SELECT node, {r('balance')} AS balance, {r('nation')} AS nation, {r('coalesce(mb, 0)')} AS mean_balance, {r('coalesce(mn, 0)')} AS mean_nation,
      {r('coalesce(xb, 0)')} AS max_balance, {r('coalesce(xn, 0)')} AS max_nation, {r('balance * balance + nation * nation')} AS self_norm, day,
      {r('sin(2 * pi() * day / 30)')} AS day_sin, {r('cos(2 * pi() * day / 30)')} AS day_cos, {r('coalesce(prox, 0)')} AS proximity,
      {r('coalesce(degree, 0) / ((SELECT max(degree) FROM x) + 1e-9)')} AS degree_norm FROM x"""
ORACLES["bundle_edges"] = ORACLES["relation_edge_counts"]


def _attention(head: str) -> str:
    """One pass of attention over all arcs, weights as literals."""
    from coloom.plans.catalog import ATTENTION

    (w00, w01), (w10, w11) = ATTENTION["project"]
    (m00, m01), (m10, m11) = ATTENTION["mix"]
    a0, a1, b0, b1 = ATTENTION["attend"]
    return f"""WITH {head},
    h AS (SELECT c_custkey AS node, tanh(c_acctbal / 1000.0 * {w00} + c_nationkey / 10.0 * {w10}) AS h0,
                 tanh(c_acctbal / 1000.0 * {w01} + c_nationkey / 10.0 * {w11}) AS h1 FROM customer),
    g AS (SELECT node, h0 * {m00} + h1 * {m10} AS g0, h0 * {m01} + h1 * {m11} AS g1 FROM h),
    st AS (SELECT *, g0 * {a0} + g1 * {a1} AS s, g0 * {b0} + g1 * {b1} AS t FROM g),
    e AS (SELECT a.node, exp(CASE WHEN a.s + b.t > 0 THEN a.s + b.t ELSE 0.2 * (a.s + b.t) END) AS w, b.g0, b.g1
          FROM arcs JOIN st a ON a.node = src JOIN st b ON b.node = dst),
    p AS (SELECT node, sum(w * g0) / sum(w) AS p0, sum(w * g1) / sum(w) AS p1 FROM e GROUP BY 1)
    SELECT node, {r('tanh(coalesce(p0, g0))')} AS att_0, {r('tanh(coalesce(p1, g1))')} AS att_1 FROM st LEFT JOIN p USING (node)"""


ORACLES["graph_attention"] = _attention(f"{VISITS}, {band(3)}")
ORACLES["crowd_attention"] = _attention(f"{CROWD}, {band(0)}")
ORACLES["betweenness_band"] = _between(k=3)


_STEP_ROWS = "x AS (SELECT c_custkey AS node, CAST(c_acctbal < 0 AS INTEGER) AS y, c_custkey % 10 < 7 AS train, c_acctbal / 1000.0 AS x0, c_nationkey / 10.0 AS x1 FROM customer)"
_STEP_ERROR = """CASE WHEN train THEN (1 / (1 + exp(-z)) - y) / (SELECT count(*) FROM x WHERE train) ELSE 0.0 END AS dz,
      CASE WHEN train THEN (greatest(z, 0.0) - z * y + ln(1 + exp(-abs(z)))) / (SELECT count(*) FROM x WHERE train) ELSE 0.0 END AS loss"""


def _step_columns(terms: dict, source: str) -> str:
    """One row (name, i, j, gradient) for each sum."""
    return " UNION ALL ".join(f"SELECT '{n}' AS name, {i} AS i, {j} AS j, {r(f'{scale}sum({e})')} AS gradient FROM {source}" for (n, i, j, scale), e in terms.items())


def _gcn_step() -> str:
    from coloom.plans.catalog import GCN_START as W

    (w00, w01), (w10, w11) = W["W"]
    u, b = W["u"], W["b"][0]
    terms = {("loss", 0, 0, ""): "loss", ("b", 0, 0, "1000 * "): "dz"}
    for k in (0, 1):
        terms["u", k, 0, "1000 * "] = f"h{k} * dp"
        for i in (0, 1):
            terms["W", i, k, "1000 * "] = f"a{i} * dp * {u[k]} * CAST(h{k} > 0 AS INTEGER)"
    return f"""WITH {VISITS}, {band(3)}, {_STEP_ROWS},
    deg AS (SELECT src, count(*) AS k FROM arcs GROUP BY 1),
    v AS (SELECT x.*, sqrt(1 / (coalesce(k, 0) + 1.0)) AS root FROM x LEFT JOIN deg ON src = node),
    loops AS (SELECT src, dst FROM arcs UNION ALL SELECT node, node FROM v),
    a AS (SELECT s.node, any_value(s.y) AS y, any_value(s.train) AS train, any_value(s.root) AS root, sum(s.root * d.root * d.x0) AS a0, sum(s.root * d.root * d.x1) AS a1
      FROM loops JOIN v s ON s.node = src JOIN v d ON d.node = dst GROUP BY 1),
    h AS (SELECT *, greatest(0.0, a0 * {w00} + a1 * {w10}) AS h0, greatest(0.0, a0 * {w01} + a1 * {w11}) AS h1 FROM a),
    z AS (SELECT s.*, q.z FROM h s JOIN (SELECT s.node, sum(s.root * d.root * (d.h0 * {u[0]} + d.h1 * {u[1]})) + {b} AS z
      FROM loops JOIN h s ON s.node = src JOIN h d ON d.node = dst GROUP BY 1) q USING (node)),
    e AS (SELECT *, {_STEP_ERROR} FROM z),
    g AS (SELECT s.*, q.dp FROM e s JOIN (SELECT s.node, sum(s.root * d.root * d.dz) AS dp FROM loops JOIN e s ON s.node = src JOIN e d ON d.node = dst GROUP BY 1) q USING (node))
    {_step_columns(terms, 'g')}"""


def _gat_step() -> str:
    from coloom.plans.catalog import GAT_START as W

    (w00, w01), (w10, w11) = W["W"]
    a1, a2, v, b = W["a1"], W["a2"], W["v"], W["b"][0]
    terms = {("loss", 0, 0, ""): "loss", ("b", 0, 0, "1000 * "): "dz"}
    for k in (0, 1):
        for n, d in (("a1", "ds"), ("a2", "dt"), ("v", "dq")):
            terms[n, k, 0, "1000 * "] = f"h{k} * {d}"
        for i in (0, 1):
            terms["W", i, k, "1000 * "] = f"x{i} * (ds * {a1[k]} + dt * {a2[k]} + dq * {v[k]})"
    return f"""WITH {VISITS}, {band(3)}, {_STEP_ROWS},
    h AS (SELECT *, x0 * {w00} + x1 * {w10} AS h0, x0 * {w01} + x1 * {w11} AS h1 FROM x),
    n AS (SELECT *, h0 * {a1[0]} + h1 * {a1[1]} AS s, h0 * {a2[0]} + h1 * {a2[1]} AS t, h0 * {v[0]} + h1 * {v[1]} AS q FROM h),
    w AS (SELECT src, dst, a.s + d.t > 0 AS up, exp(CASE WHEN a.s + d.t > 0 THEN a.s + d.t ELSE 0.2 * (a.s + d.t) END) AS w, d.q AS q
      FROM arcs JOIN n a ON a.node = src JOIN n d ON d.node = dst),
    m AS (SELECT src, sum(w) AS total, sum(w * q) / sum(w) AS mean FROM w GROUP BY 1),
    z AS (SELECT n.*, total, coalesce(mean, q) AS mean, coalesce(mean, q) + {b} AS z FROM n LEFT JOIN m ON src = node),
    e AS (SELECT *, {_STEP_ERROR} FROM z),
    p AS (SELECT src, dst, w / total * dz AS share, w / total * dz * (w.q - mean) * CASE WHEN up THEN 1.0 ELSE 0.2 END AS score FROM w JOIN e ON node = src),
    ps AS (SELECT src, sum(score) AS ds FROM p GROUP BY 1), pd AS (SELECT dst, sum(score) AS dt, sum(share) AS dq FROM p GROUP BY 1),
    g AS (SELECT e.*, coalesce(ds, 0.0) AS ds, coalesce(dt, 0.0) AS dt, CASE WHEN total IS NULL THEN dz ELSE coalesce(dq, 0.0) END AS dq
      FROM e LEFT JOIN ps ON ps.src = node LEFT JOIN pd ON pd.dst = node)
    {_step_columns(terms, 'g')}"""


ORACLES["gcn_training_step"] = _gcn_step()
ORACLES["gat_training_step"] = _gat_step()
for _name, _k in (("pair_weights", 3), ("pair_weights_same_day", 0)):
    ORACLES[_name] = f"WITH {VISITS}, {band(_k)} SELECT src, dst, gap AS min_gap, {r('exp(-gap / 7.0)')} AS weight FROM arcs WHERE src < dst"
ORACLES["risk_rollup"] = f"""WITH {VISITS}, {labels(3)}, who AS (SELECT DISTINCT venue, province, case_id FROM visits)
    SELECT venue, province, CAST(grouping(venue, province) AS INTEGER) AS level, count(DISTINCT case_id) AS n_cases,
      {r('count(DISTINCT case_id) FILTER (label_3 = 1) * 1.0 / count(DISTINCT case_id)')} AS rate, TRUE AS estimate_near
    FROM who LEFT JOIN hits USING (case_id) GROUP BY ROLLUP (venue, province)"""
