"""Topic queries over events by day, and query suggestion over user turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from delver.functions.text import tokens
from delver.operators import topics as op

QUERIES, ORACLES = {}, {}
LO, HI = "2024-01-01", "2024-01-30"


def _series(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    t = F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string"))
    return op.daily_series(e.select(t.alias("topic"), F.to_date("ts").alias("day")), LO, HI)


SE = f"""ct AS (SELECT event_type || '-' || CAST(user_id % 4 AS VARCHAR) AS topic, CAST(ts AS DATE) AS day, count(*) AS f FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY ALL),
se AS (SELECT topic, CAST(x.day AS DATE) AS day, coalesce(f, 0) AS freq FROM (SELECT DISTINCT topic FROM ct) CROSS JOIN (SELECT unnest(generate_series(DATE '{LO}', DATE '{HI}', INTERVAL 1 DAY)) AS day) x LEFT JOIN ct USING (topic, day))"""


def _fir(taps):
    return " + ".join(f"coalesce(lag(freq, {i}) OVER w, 0) * CAST({t!r} AS DOUBLE)" for i, t in enumerate(taps))


def _filter(taps, gap=0):
    return f"SELECT topic, day, CASE WHEN row_number() OVER w > {gap} THEN {_fir(taps)} ELSE 0 END AS value FROM se WINDOW w AS (PARTITION BY topic ORDER BY day)"


QUERIES["td_daily_series"] = lambda s, d: _series(s, d).withColumn("day", F.col("day").cast("string"))
ORACLES["td_daily_series"] = f"WITH {SE} SELECT topic, CAST(day AS VARCHAR) AS day, freq FROM se"
for _name, _taps, _gap in (("td_ema", op.ema_taps(5), 0), ("td_macd", op.macd_taps(), 3), ("td_macd_histogram", op.histogram_taps(), 3)):
    QUERIES[_name] = lambda s, d, t=_taps, g=_gap: op.filtered(_series(s, d), t, g).select("topic", F.col("day").cast("string").alias("day"), F.round("value", 6).alias("value"))
    ORACLES[_name] = f"WITH {SE}, f AS ({_filter(_taps, _gap)}) SELECT topic, CAST(day AS VARCHAR) AS day, round(value, 6) AS value FROM f"
BU = f"""{SE}, f AS ({_filter(op.histogram_taps(), 3)}), r AS (SELECT topic, day, value, day - CAST(row_number() OVER (PARTITION BY topic ORDER BY day) AS INTEGER) AS g FROM f WHERE value >= 1),
bu AS (SELECT topic, min(day) AS start, CAST(count(*) AS INTEGER) AS period, sum(value) AS weight FROM r GROUP BY topic, g HAVING count(*) > 1)"""
PK = BU.replace("r AS (SELECT topic, day, value", "pk AS (SELECT topic FROM se GROUP BY topic HAVING max(freq) / avg(freq) >= 13), r AS (SELECT topic, day, value").replace("FROM f WHERE value >= 1)", "FROM f SEMI JOIN pk USING (topic) WHERE value >= 1)")
QUERIES["td_bursts"] = lambda s, d: op.bursts(_series(s, d)).withColumn("weight", F.round("weight", 6)).withColumn("start", F.col("start").cast("string"))
ORACLES["td_bursts"] = f"WITH {PK} SELECT topic, CAST(start AS VARCHAR) AS start, period, round(weight, 6) AS weight FROM bu"
QUERIES["td_runs"] = lambda s, d: op.bursts(_series(s, d), peak=0.0).withColumn("weight", F.round("weight", 6)).withColumn("start", F.col("start").cast("string"))
ORACLES["td_runs"] = f"WITH {BU} SELECT topic, CAST(start AS VARCHAR) AS start, period, round(weight, 6) AS weight FROM bu"
QUERIES["td_topics_in_range"] = lambda s, d: op.in_range(op.bursts(_series(s, d), peak=0.0), "2024-01-10", "2024-01-15")
ORACLES["td_topics_in_range"] = f"WITH {BU} SELECT DISTINCT topic FROM bu WHERE start < DATE '2024-01-15' AND start + period - 1 >= DATE '2024-01-10'"
SB = f"""{SE}, x AS (SELECT topic, day, freq AS x, lag(freq) OVER w AS p, lead(freq) OVER w AS n FROM se WINDOW w AS (PARTITION BY topic ORDER BY day)),
j AS (SELECT a.topic AS a, b.topic AS b, sum(abs(a.x * b.x - CAST(0.5 AS DOUBLE) * (a.p * b.n + a.n * b.p))) AS u, sum(sqrt(power(a.x * a.x - a.p * a.n, 2) + power(b.x * b.x - b.p * b.n, 2))) AS d
  FROM x a JOIN x b ON a.day = b.day AND a.topic < b.topic WHERE a.p IS NOT NULL AND a.n IS NOT NULL AND b.p IS NOT NULL AND b.n IS NOT NULL GROUP BY ALL),
sb AS (SELECT a, b, CASE WHEN d > 0 THEN sqrt(2) * u / d ELSE 0 END AS sim FROM j)"""
QUERIES["td_similb"] = lambda s, d: op.series_similarity(_series(s, d)).withColumn("sim", F.round("sim", 6))
ORACLES["td_similb"] = f"WITH {SB} SELECT a, b, round(sim, 6) AS sim FROM sb"
QUERIES["td_links"] = lambda s, d: op.series_similarity(_series(s, d)).where("sim >= 0.5").select("a", "b")
ORACLES["td_links"] = f"WITH {SB} SELECT a, b FROM sb WHERE sim >= 0.5"


def _log(s, d):
    c = s.read.parquet(f"{d}/conversations.parquet").where("role = 'user'").select((F.col("conv_id") % 10).cast("int").alias("slice"), tokens("text").alias("terms"))
    return c.where("size(terms) > 0").select(F.array_join("terms", " ").alias("query"), "terms", "slice")


LOG = r"""lg AS (SELECT array_to_string(t, ' ') AS query, t, slice FROM (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t, CAST(conv_id % 10 AS INTEGER) AS slice FROM conversations WHERE role = 'user') WHERE len(t) > 0),
tm AS (SELECT term, slice, count(*) AS n FROM (SELECT unnest(t) AS term, slice FROM lg) GROUP BY ALL),
en AS (SELECT term, -sum(p * ln(p)) AS h FROM (SELECT term, n / sum(n) OVER (PARTITION BY term) AS p FROM tm) GROUP BY term),
pe AS (SELECT term, sum(n) AS c FROM tm GROUP BY term)"""
PO = f"""{LOG}, x AS (SELECT term, ln((c + 200 * h) / ((SELECT count(*) FROM pe) + 200 * (SELECT sum(h) FROM en) + 1) + 1) AS x FROM pe JOIN en USING (term)),
q AS (SELECT query, t, count(*) AS freq FROM lg GROUP BY ALL), po AS (SELECT query, freq, sum(x) * sqrt(freq + 0.01) AS score FROM (SELECT query, freq, unnest(t) AS term FROM q) JOIN x USING (term) GROUP BY query, freq)"""
QUERIES["qs_entropy"] = lambda s, d: op.entropy(op.query_terms(_log(s, d))).withColumn("entropy", F.abs(F.round("entropy", 6)))
ORACLES["qs_entropy"] = f"WITH {LOG} SELECT term, abs(round(h, 6)) AS entropy FROM en"
QUERIES["qs_popular"] = lambda s, d: op.popular(_log(s, d)).withColumn("score", F.round("score", 6))
ORACLES["qs_popular"] = f"WITH {PO} SELECT query, freq, round(score, 6) AS score FROM po"
QUERIES["qs_realtime"] = lambda s, d: op.realtime(_log(s, d), 9).withColumn("score", F.round("score", 6))
ORACLES["qs_realtime"] = f"""WITH {LOG}, la AS (SELECT term, n AS s FROM tm WHERE slice = 9), q AS (SELECT query, t, count(*) AS freq FROM lg WHERE slice = 9 GROUP BY ALL),
a AS (SELECT query, freq, avg((s + 1) / (c + 1)) AS nw, sum(ln(s / ((SELECT count(*) FROM la) + 1) + 1)) AS l FROM (SELECT query, freq, unnest(t) AS term FROM q) JOIN la USING (term) JOIN pe USING (term) GROUP BY ALL)
SELECT query, freq, round(nw * sqrt(freq * l + 0.01), 6) AS score FROM a"""
QUERIES["qs_dedup"] = lambda s, d: op.greedy_distinct(op.popular(lg := _log(s, d)), lg, 10).withColumn("score", F.round("score", 6))
