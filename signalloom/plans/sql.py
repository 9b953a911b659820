"""DuckDB building blocks of the SQL twins: the fixtures and the backtest as common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

FIXTURES = """
p_base AS (
  SELECT CAST(l_suppkey AS INTEGER) AS security_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, count(*) AS k,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS dsc,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tx,
         CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS qty,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS px
  FROM lineitem GROUP BY 1, 2
),
p_sup AS (
  SELECT b.*, s.s_nationkey, s.s_acctbal, n.n_regionkey FROM p_base b
  JOIN supplier s ON s.s_suppkey = b.security_id JOIN nation n ON n.n_nationkey = s.s_nationkey
),
risk AS (
  SELECT security_id, date, CAST(s_nationkey AS INTEGER) AS industry_id, CAST(n_regionkey AS INTEGER) AS sector_id,
         CAST(CASE WHEN s_acctbal > 6000 THEN 1 WHEN s_acctbal > 2000 THEN 2 ELSE 3 END AS INTEGER) AS cap,
         px / 100 AS mcap, qty * 1e6 AS adv, CAST(qty AS DOUBLE) AS size, tx / k AS value, CAST(k AS DOUBLE) AS growth,
         dsc / k AS leverage, px / (k * 100) AS volatility, qty / k AS momentum, px / qty AS yield,
         CAST(security_id % 4 <> 0 AS INTEGER) AS universe_flag
  FROM p_sup
),
raw_ret AS (
  SELECT security_id, date, s_nationkey, dsc / (k * 100) - 0.05e0 AS ret, tx / (k * 100) - 0.04e0 AS openret,
         tx / (k * 100) + 0.01e0 AS vol, qty * 1e6 AS adv, px / (qty * 100) AS close_adj
  FROM p_sup
),
ret AS (
  SELECT security_id, date, ret, round(ret - avg(ret) OVER (PARTITION BY date, s_nationkey), 9) AS resret, openret,
         round(openret - avg(openret) OVER (PARTITION BY date, s_nationkey), 9) AS resopenret, vol, adv, close_adj
  FROM raw_ret
),
dates AS (
  SELECT date, CAST(n AS INTEGER) AS n, CAST(n <= 178 AS INTEGER) AS insample, CAST(n % 2 AS INTEGER) AS insample2
  FROM (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM p_base))
),
signal AS (
  SELECT 'quantity' AS signal_name, security_id, date AS date_sig, date AS date_avail, qty / k AS signal FROM p_base
),
price AS (
  SELECT 'price' AS signal_name, security_id, date AS date_sig, date AS date_avail, px / (k * 100) AS signal FROM p_base
),
market AS (SELECT date, sum(dsc) / (sum(k) * 100) - 0.05e0 AS market_ret FROM p_base GROUP BY date),
e_base AS (
  SELECT CAST(user_id AS INTEGER) AS security_id, CAST(ts AS DATE) AS date, count(*) AS k,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents,
         CAST(sum(CAST(event_type = 'click' AS BIGINT)) AS BIGINT) AS clicks, min(ts) AS first_ts
  FROM events GROUP BY 1, 2
),
e_ret AS (SELECT security_id, date, (cents / k - 5000) / 100000 AS ret FROM e_base),
e_risk AS (
  SELECT security_id, date, security_id % 7 AS industry_id, security_id % 3 + 1 AS cap, CAST(k AS DOUBLE) AS value,
         CAST(cents AS DOUBLE) AS size FROM e_base
),
e_dates AS (
  SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS n
  FROM (SELECT DISTINCT date FROM e_base WHERE isodow(date) <= 5)
),
e_signal AS (
  SELECT 'clicks' AS signal_name, security_id, date AS date_sig, CAST(date + 1 AS DATE) AS date_avail, clicks / k AS signal,
         CAST(hour(first_ts) AS INTEGER) AS hour FROM e_base
)
"""


def average_rank(value: str, keys: str) -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY {value})"
    return f"((rank() {w} + count(*) {w}) / 2)"


def percentile(value: str, keys: str) -> str:
    return f"CAST(ceil({average_rank(value, keys)} * 100 / count(*) OVER (PARTITION BY {keys})) AS BIGINT)"


def ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def correlation(x: str, y: str) -> str:
    return ratio(f"covar_pop({x}, {y})", f"stddev_pop({x}) * stddev_pop({y})")


G = "signal_name, config, byvar, grp"
CAP = "CASE WHEN cap = 1 THEN 'LargeCap' WHEN cap = 2 THEN 'MediumCap' WHEN cap IS NOT NULL THEN 'SmallCap' END"
GROUP_OF = {
    "overall": "'overall'",
    "year": "CAST(year(date) AS VARCHAR)",
    "cap": CAP,
    "capyr": f"({CAP}) || '_' || CAST(year(date) AS VARCHAR)",
    "industry_id": "CAST(industry_id AS VARCHAR)",
}
POSITION = "CASE WHEN p <= 20 THEN -1 WHEN p > 80 THEN 1 ELSE 0 END"


def _one_factor(style: str, within: str) -> str:
    """Residuals on one factor, value, both centred by day and within; other columns as they are."""
    day = "PARTITION BY signal_name, lag, date"
    centred = ", ".join(f"{c} - avg({c}) OVER ({day}{within}) AS {n}" for c, n in (("sig", "y"), ("value", "x")))
    fit = f"y - (sum(x * y) OVER ({day})) / (sum(x * x) OVER ({day}) + 1e-10) * x"
    return f"SELECT * EXCLUDE (y, x), 'lag' || lag || '_resid{style}' AS config, round({fit}, 9) AS signal FROM (SELECT *, {centred} FROM attributed)"


def prepared(lags: Sequence[int] = (0,), resid: Sequence[str] = ("off",), signal: str = "signal") -> str:
    values = ", ".join(f"({x})" for x in lags)
    parts = [
        "SELECT *, 'lag' || lag || '_residoff' AS config, sig AS signal FROM attributed",
        "SELECT *, 'lag' || lag || '_residindustry' AS config, "
        "round(sig - avg(sig) OVER (PARTITION BY signal_name, lag, date, industry_id), 9) AS signal FROM attributed",
        _one_factor("factor", ""),
        _one_factor("all", ", industry_id"),
    ]
    chosen = " UNION ALL ".join(p for p, name in zip(parts, ("off", "industry", "factor", "all"), strict=True) if name in resid)
    return f"""
aligned AS (
  SELECT s.signal_name, s.security_id, s.date_sig, s.date_avail, s.signal AS sig, l.lag, o.date AS date_openret, r.date AS date_ret
  FROM {signal} s CROSS JOIN (VALUES {values}) l(lag) JOIN dates d ON d.date = s.date_avail
  JOIN dates o ON o.n = d.n + l.lag JOIN dates r ON r.n = d.n + 1 + l.lag
),
attributed AS (
  SELECT a.signal_name, a.lag, a.security_id, a.date_ret AS date, a.date_sig, a.sig, r.ret, r.resret, k.industry_id, k.cap,
         k.mcap, k.adv, k.value, k.size
  FROM aligned a JOIN ret r ON r.security_id = a.security_id AND r.date = a.date_ret
  LEFT JOIN risk k ON k.security_id = a.security_id AND k.date = a.date_sig
),
prepared AS ({chosen})"""


def backtest(
    lags: Sequence[int] = (0,),
    resid: Sequence[str] = ("off",),
    byvars: Sequence[str] = ("overall",),
    signal: str = "signal",
    mincos: int = 1,
    long_only: bool = False,
) -> str:
    """Common table expressions down to weights, names, changes, traded, daily and summary."""
    sliced = " UNION ALL ".join(f"SELECT *, '{b}' AS byvar, {GROUP_OF[b]} AS grp FROM prepared" for b in byvars)
    weight = "greatest(weight, 0)" if long_only else "weight"
    enough = "n_long" if long_only else "n_min"
    positive = "WHERE weight > 0" if long_only else ""
    return f"""{prepared(lags, resid, signal)},
sliced AS (SELECT * FROM ({sliced}) WHERE grp IS NOT NULL),
ranked AS (SELECT *, {percentile('signal', G + ', date')} AS p FROM sliced),
placed AS (SELECT *, {POSITION} AS position FROM ranked),
weighed AS (
  SELECT *, position / count(*) OVER (PARTITION BY {G}, date, position) AS weight FROM placed WHERE position <> 0
),
weights AS (SELECT w.* EXCLUDE (weight), {weight} AS weight, d.n FROM weighed w JOIN dates d USING (date) {positive}),
all_names AS (
  SELECT {G}, date, n, count(*) FILTER (weight > 0) AS n_long, count(*) FILTER (weight < 0) AS n_short,
         least(count(*) FILTER (weight > 0), count(*) FILTER (weight < 0)) AS n_min
  FROM weights GROUP BY ALL
),
names AS (SELECT * FROM all_names WHERE {enough} >= {mincos}),
held AS (SELECT w.* FROM weights w SEMI JOIN names USING ({G}, date)),
moves AS (
  SELECT security_id, {G}, n, weight AS w, 1 AS held FROM held
  UNION ALL SELECT security_id, {G}, n + 1, -weight, 0 FROM held
),
summed AS (SELECT security_id, {G}, n, abs(sum(w)) AS change, max(held) AS held FROM moves GROUP BY ALL),
firsts AS (SELECT {G}, min(n) AS first_n FROM held GROUP BY ALL),
changes AS (
  SELECT security_id, {G}, n, CASE WHEN n > first_n THEN change ELSE 0 END AS change, held FROM summed JOIN firsts USING ({G})
),
turnover AS (SELECT {G}, n, sum(change) AS turnover FROM changes GROUP BY ALL HAVING max(held) = 1),
traded AS (
  SELECT c.*, d.date, k.cap FROM changes c JOIN dates d USING (n)
  LEFT JOIN risk k ON k.security_id = c.security_id AND k.date = d.date
),
costs AS (
  SELECT {G}, n, sum((CASE WHEN cap = 1 THEN 2.0e0 WHEN cap = 2 THEN 5.0e0 ELSE 10.0e0 END) / 10000 * change) AS tc FROM traded GROUP BY ALL
),
gains AS (
  SELECT {G}, date, round(sum(weight * ret), 12) AS ret, round(sum(weight * resret), 12) AS resret FROM held GROUP BY ALL
),
bounds AS (SELECT {G}, min(date) AS low, max(date) AS high FROM names GROUP BY ALL),
panel AS (SELECT b.* EXCLUDE (low, high), d.date, d.n FROM bounds b JOIN dates d ON d.date BETWEEN b.low AND b.high),
net AS (
  SELECT p.*, coalesce(g.ret, 0) AS ret, coalesce(g.resret, 0) AS resret, coalesce(t.turnover, 0) AS turnover,
         coalesce(c.tc, 0) AS tc, round(coalesce(g.ret, 0) - coalesce(c.tc, 0), 12) AS ret_net,
         round(coalesce(g.resret, 0) - coalesce(c.tc, 0), 12) AS resret_net,
         coalesce(m.n_long, 0) AS n_long, coalesce(m.n_short, 0) AS n_short
  FROM panel p LEFT JOIN gains g USING ({G}, date) LEFT JOIN turnover t USING ({G}, n) LEFT JOIN costs c USING ({G}, n)
  LEFT JOIN names m USING ({G}, date)
),
cumulated AS (
  SELECT *, sum(ret) OVER w AS cumret, sum(ret_net) OVER w AS cumretnet FROM net
  WINDOW w AS (PARTITION BY {G} ORDER BY date ROWS UNBOUNDED PRECEDING)
),
daily AS (
  SELECT *, cumret - max(cumret) OVER (PARTITION BY {G} ORDER BY date ROWS UNBOUNDED PRECEDING) AS drawdown FROM cumulated
),
summary AS (
  SELECT {G}, count(*) FILTER (ret <> 0) AS num_date,
         avg(ret) * 252 AS ret_ann, stddev_samp(ret) * sqrt(252) AS ret_std,
         {ratio('avg(ret) * 252', 'stddev_samp(ret) * sqrt(252)')} AS ret_sharpe, avg((sign(ret) + 1) / 2) AS ret_pos,
         avg(resret) * 252 AS resret_ann, stddev_samp(resret) * sqrt(252) AS resret_std,
         {ratio('avg(resret) * 252', 'stddev_samp(resret) * sqrt(252)')} AS resret_sharpe, avg((sign(resret) + 1) / 2) AS resret_pos,
         avg(ret_net) * 252 AS retnet_ann, stddev_samp(ret_net) * sqrt(252) AS retnet_std,
         {ratio('avg(ret_net) * 252', 'stddev_samp(ret_net) * sqrt(252)')} AS retnet_sharpe, avg((sign(ret_net) + 1) / 2) AS retnet_pos,
         min(drawdown) AS maxdd, avg(turnover) / 4 AS turnover, avg(n_long) AS numcos_l, avg(n_short) AS numcos_s
  FROM daily GROUP BY ALL
),
results AS (
  SELECT {G}, 'signal' AS type, ret_sharpe AS sharpe, ret_ann AS ann_ret, maxdd AS max_dd, turnover FROM summary
)"""
