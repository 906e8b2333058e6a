"""The engine's queries on the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import text as T
from tidepanel.operators import audit, dedup, sessions, stats
from tidepanel.plans.registry import query

START, END = "1995-01-02", "2001-08-01"
DOMAINS = ["example.com", "example.net"]
#: Words of the stand-in lexicons.
GOOD, BAD = ["the", "and", "with"], ["of", "is", "that"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calendar(spark):
    return sessions.calendar(spark, START, END)


def dated_documents(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(30)).cast("int"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", T.normalized(F.col("text")).alias("text_norm"), day.alias("day"))
    return docs.where(F.col("text_norm") != "")


def stamped_documents(spark, sf_dir):
    """Documents as rows(id, ts, text_norm, tickers): a stamp made from the identifier; of every seventh a near copy a day later, with a word more."""
    docs = dated_documents(spark, sf_dir).select("doc_id", "text_norm", "day")
    second = F.make_dt_interval(secs=F.pmod(F.col("doc_id") * 7919, F.lit(86400)).cast("decimal(18,6)"))
    tags = F.array(F.concat(F.lit("T"), (F.col("doc_id") % 11).cast("string")), F.concat(F.lit("T"), (F.col("doc_id") % 3).cast("string")))
    rows = docs.select(F.col("doc_id").alias("own"), (F.col("day").cast("timestamp_ntz") + second).alias("ts"), "text_norm", F.array_sort(F.array_distinct(tags)).alias("tickers"))
    copies = rows.where("own % 7 = 0").select(
        (F.col("own") + 1_000_000_000).alias("own"), (F.col("ts") + F.expr("INTERVAL '1' DAY")).alias("ts"), F.concat("text_norm", F.lit(" zz"), (F.col("own") % 5).cast("string")).alias("text_norm"), "tickers"
    )
    return dedup.numbered(rows.unionByName(copies), "ts", "own").withColumnRenamed("source_row_id", "id")


def scored_orders(spark, sf_dir, defer=True):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_totalprice") / 500000.0).alias("score"))
    return sessions.map_dates(orders, calendar(spark), "o_orderdate", defer)


def day_frame(spark, sf_dir, agg="mean"):
    return sessions.daily(scored_orders(spark, sf_dir), calendar(spark), F.col("score"), agg)


def whole_panel(spark, sf_dir):
    trades = read(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    market = sessions.market(sessions.bars(trades, "l_shipdate", price, "l_quantity"), calendar(spark))
    return sessions.panel(day_frame(spark, sf_dir), market).join(F.broadcast(calendar(spark).select("session", "pos")), "session")


def kept_rows(spark, sf_dir):
    rows = whole_panel(spark, sf_dir).where("n > 0 AND d IS NOT NULL AND ret_lag1 IS NOT NULL AND volume_gap IS NOT NULL AND ret_lead1 IS NOT NULL")
    return stats.standardized(rows, ["s", "d", "ret_lag1", "volume_gap"])


XS, LAGS = ["z_s", "z_d", "z_ret_lag1", "z_volume_gap"], 5

NORM_SQL = r"""trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\p{Z}\s\x1c-\x1f\x{85}]', ' ', 'g'), '[\s\p{Z}\x1c-\x1f\x{85}]+', ' ', 'g'))"""
CAL = f"""cal AS (SELECT d::DATE AS session, lag(d::DATE) OVER (ORDER BY d) AS prev, row_number() OVER (ORDER BY d) - 1 AS pos
  FROM generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)"""
DOCS = f"""docs AS (SELECT * FROM (SELECT doc_id, text, {NORM_SQL} AS text_norm, DATE '2024-01-01' + (doc_id % 30)::INT AS day FROM documents) WHERE text_norm <> '')"""
ASSIGNED = "assigned AS (SELECT o_orderkey, o_totalprice / 500000.0::DOUBLE AS score, session FROM orders LEFT JOIN cal ON o_orderdate::DATE >= prev AND o_orderdate::DATE < session)"
DAILY = """daily AS (SELECT cal.session, pos, count(a.o_orderkey) AS n, avg(score) AS s, CASE WHEN count(a.o_orderkey) >= 5 THEN stddev_samp(score) END AS d
  FROM cal LEFT JOIN assigned a ON a.session = cal.session GROUP BY ALL)"""
PANEL = f"""{CAL}, {ASSIGNED}, {DAILY},
bars AS (SELECT l_shipdate::DATE AS session, avg(l_extendedprice / l_quantity) AS close, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume FROM lineitem GROUP BY 1),
market AS (SELECT cal.session, close, ln(close) - lag(ln(close)) OVER (ORDER BY cal.session) AS ret, pow(ln(high / low), 2) / (4 * ln(2.0::DOUBLE)) AS range_var,
  ln(nullif(volume, 0)) AS log_volume FROM cal LEFT JOIN bars USING (session)),
panel AS (SELECT daily.*, m.* EXCLUDE (session),
  CASE WHEN count(log_volume) OVER t = 63 THEN log_volume - avg(log_volume) OVER t END AS volume_gap,
  lag(ret) OVER o AS ret_lag1, lag(range_var) OVER o AS range_var_lag1, lag(log_volume) OVER o AS log_volume_lag1,
  lead(ret, 1) OVER o AS ret_lead1, lead(ret, 2) OVER o AS ret_lead2, lead(ret, 3) OVER o AS ret_lead3, lead(ret, 4) OVER o AS ret_lead4, lead(ret, 5) OVER o AS ret_lead5
  FROM daily JOIN market m USING (session) WINDOW o AS (ORDER BY session), t AS (ORDER BY session ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))"""
KEPT = f"""{PANEL}, kept AS (SELECT *, (s - avg(s) OVER ()) / stddev_samp(s) OVER () AS z_s, (d - avg(d) OVER ()) / stddev_samp(d) OVER () AS z_d,
  (ret_lag1 - avg(ret_lag1) OVER ()) / stddev_samp(ret_lag1) OVER () AS z_ret_lag1, (volume_gap - avg(volume_gap) OVER ()) / stddev_samp(volume_gap) OVER () AS z_volume_gap
  FROM panel WHERE n > 0 AND d IS NOT NULL AND ret_lag1 IS NOT NULL AND volume_gap IS NOT NULL AND ret_lead1 IS NOT NULL)"""
#: Decimals that both engines' sums share; means of prices end after a few more, so fewer are kept, lest a tie is rounded apart.
ROUND, PLACES = 7, {"s": 6, "d": 11}


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES.get(c, ROUND)) for c in cols})


def named_day(day: str):
    """Dates as text, which every reader compares alike."""
    return F.col(day).cast("string").alias(day)


@query("norm_ids", f"""WITH {DOCS} SELECT doc_id, sha1(text_norm || '|' || strftime(day, '%Y-%m-%d') || 'T00:00:00+00:00') AS headline_id, length(text_norm)::INT AS chars FROM docs""")
def norm_ids(spark, sf_dir):
    docs = dated_documents(spark, sf_dir)
    return docs.select("doc_id", T.identity(F.col("text_norm"), F.col("day").cast("timestamp")).alias("headline_id"), F.char_length("text_norm").alias("chars"))


HOST_SQL = "nullif(lower(rtrim(regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1), '.')), '')"


@query("host_filter", f"""SELECT page_id, host FROM (SELECT page_id, {HOST_SQL} AS host FROM pages) WHERE host IN ('example.com', 'example.net') OR host LIKE '%.example.com' OR host LIKE '%.example.net'""")
def host_filter(spark, sf_dir):
    hosts = read(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"))
    return hosts.where(T.host_matches(F.col("host"), DOMAINS))


@query("rejected_hosts", f"""SELECT host, count(*) AS n FROM (SELECT {HOST_SQL} AS host FROM pages)
WHERE host IS NOT NULL AND NOT (host IN ('example.com', 'example.net') OR host LIKE '%.example.com' OR host LIKE '%.example.net') GROUP BY 1 ORDER BY n DESC, host LIMIT 20""")
def rejected_hosts(spark, sf_dir):
    hosts = read(spark, sf_dir, "pages").select(T.host(F.col("url")).alias("host")).where("host IS NOT NULL")
    return hosts.where(~T.host_matches(F.col("host"), DOMAINS)).groupBy("host").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(20)


@query("source_profile", """WITH m AS (SELECT event_type, hour(ts) * 60 + minute(ts) AS minute, count(*) AS n, sum((ts = date_trunc('day', ts))::INT) AS midnight, min(ts) AS f, max(ts) AS l FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, minute) AS k FROM m)
SELECT event_type AS source, sum(n)::BIGINT AS rows, sum(midnight) / sum(n)::DOUBLE AS midnight_share, max(CASE WHEN k = 1 THEN minute END)::INT AS modal_minute,
max(CASE WHEN k = 1 THEN n END) / sum(n)::DOUBLE AS modal_share, count(*) AS minutes, min(f) AS first_ts, max(l) AS last_ts FROM r GROUP BY 1""")
def source_profile(spark, sf_dir):
    return audit.source_profile(read(spark, sf_dir, "events"), "event_type", "ts")


@query("hour_histogram", "SELECT h.hour::INT AS hour, count(e.ts) AS n FROM range(24) h(hour) LEFT JOIN events e ON hour(e.ts) = h.hour GROUP BY 1")
def hour_histogram(spark, sf_dir):
    return audit.hour_histogram(spark, read(spark, sf_dir, "events"), "ts")


@query("large_by_year", """SELECT year(o_orderdate)::INT AS year, avg((o_totalprice > 250000)::INT::DOUBLE) FILTER (o_orderstatus = 'F') AS F,
avg((o_totalprice > 250000)::INT::DOUBLE) FILTER (o_orderstatus = 'O') AS O, avg((o_totalprice > 250000)::INT::DOUBLE) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def large_by_year(spark, sf_dir):
    return audit.share_by_year(read(spark, sf_dir, "orders"), "o_orderdate", F.col("o_totalprice") > 250000, "o_orderstatus", ["F", "O", "P"])


@query("script_profile", r"""SELECT source, count(*) AS rows, avg(coalesce(regexp_matches(text, '[\x{0400}-\x{04FF}]'), false)::INT::DOUBLE) AS cyrillic_share,
avg(coalesce(regexp_matches(text, '[^\x00-\x7F]'), false)::INT::DOUBLE) AS other_share FROM documents GROUP BY 1""")
def script_profile(spark, sf_dir):
    flag = lambda p: F.avg(F.coalesce(F.col("text").rlike(p), F.lit(False)).cast("double"))
    return read(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), flag(r"[Ѐ-ӿ]").alias("cyrillic_share"), flag(r"[^\x00-\x7F]").alias("other_share")
    )


@query("coverage", f"""WITH {CAL}, {ASSIGNED}, {DAILY} SELECT count(*) AS sessions, sum(n)::BIGINT AS events, avg(n) AS mean, median(n) AS median,
avg((n = 0)::INT::DOUBLE) AS zero_share, avg((n < 5)::INT::DOUBLE) AS thin_share FROM daily""")
def coverage(spark, sf_dir):
    return audit.coverage(day_frame(spark, sf_dir))


@query("concentration", """WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) AS r FROM c)
SELECT count(*) AS tags, sum(n) FILTER (r <= 10) / sum(n)::DOUBLE AS top10, sum(n) FILTER (r <= 50) / sum(n)::DOUBLE AS top50, sum(n) FILTER (r <= 100) / sum(n)::DOUBLE AS top100,
sum(n::DOUBLE * n) / (sum(n)::DOUBLE * sum(n)) AS hhi, (sum(n)::DOUBLE * sum(n)) / sum(n::DOUBLE * n) AS effective FROM r""")
def concentration(spark, sf_dir):
    return audit.concentration(read(spark, sf_dir, "orders"), "o_custkey")


STABLE = f"""{CAL}, {ASSIGNED}, {DAILY}, y AS (SELECT year(session)::INT AS year, count(*) AS sessions, sum(n)::BIGINT AS events, avg(n) AS mean, median(n) AS median,
avg((n = 0)::INT::DOUBLE) AS zero_share, avg((n < 5)::INT::DOUBLE) AS thin_share FROM daily GROUP BY 1)"""


@query("window_stability", f"WITH {STABLE} SELECT *, median / (SELECT median(median) FROM y) AS ratio FROM y")
def window_stability(spark, sf_dir):
    return audit.stability(day_frame(spark, sf_dir))


@query("longest_stable_run", f"""WITH {STABLE}, g AS (SELECT year, year - row_number() OVER (ORDER BY year) AS island FROM y WHERE thin_share < 0.3)
SELECT min(year)::INT AS first_year, max(year)::INT AS last_year, count(*) AS years FROM g GROUP BY island ORDER BY years DESC, last_year DESC LIMIT 1""")
def longest_stable_run(spark, sf_dir):
    return audit.longest_run(audit.stability(day_frame(spark, sf_dir)), F.col("thin_share") < 0.3)


@query("repeated_texts", "SELECT md5(text) AS text_md5, n FROM (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, text LIMIT 10)")
def repeated_texts(spark, sf_dir):
    top = audit.repeated_texts(read(spark, sf_dir, "documents").where("text IS NOT NULL"), "text")
    return top.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "n")


STAMPED = f"""{DOCS}, base AS (SELECT doc_id AS own, day::TIMESTAMP + to_seconds(doc_id * 7919 % 86400) AS ts, text_norm, list_sort(list_distinct(['T' || doc_id % 11, 'T' || doc_id % 3])) AS tickers FROM docs),
stamped AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, own) - 1 AS id, * FROM (SELECT * FROM base UNION ALL
  SELECT own + 1000000000, ts + INTERVAL 1 DAY, text_norm || ' zz' || own % 5, tickers FROM base WHERE own % 7 = 0))"""
EXACT = f"""{STAMPED}, f AS (SELECT text_norm, ts, min(id) AS first FROM stamped GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY text_norm ORDER BY ts) AS k FROM f),
walk AS (SELECT text_norm, k, ts, first AS anchor, ts AS since FROM g WHERE k = 1
  UNION ALL SELECT g.text_norm, g.k, g.ts, CASE WHEN g.ts > w.since + INTERVAL 3 DAY THEN g.first ELSE w.anchor END, CASE WHEN g.ts > w.since + INTERVAL 3 DAY THEN g.ts ELSE w.since END
  FROM walk w JOIN g ON g.text_norm = w.text_norm AND g.k = w.k + 1),
exacts AS MATERIALIZED (SELECT id, own, stamped.ts, stamped.text_norm, tickers, anchor, id = anchor AS kept FROM stamped JOIN walk ON walk.text_norm = stamped.text_norm AND walk.ts = stamped.ts)"""
PAIRS = f"""{EXACT}, t AS MATERIALIZED (SELECT id, ts, list_sort(list_distinct(string_split(text_norm, ' '))) AS tokens FROM exacts WHERE kept),
p AS (SELECT a.id AS cur, b.id AS cand, a.tokens AS x, b.tokens AS y FROM t a JOIN t b ON abs(len(a.tokens) - len(b.tokens)) <= 1 AND b.id < a.id AND a.ts <= b.ts + INTERVAL 3 DAY),
q AS (SELECT *, len(list_intersect(x, y)) AS k FROM p),
pairs AS MATERIALIZED (SELECT cur, cand, CASE WHEN len(x) = k THEN 0 ELSE list_position(x, list_filter(x, lambda e: NOT list_contains(y, e))[1]) END::INT AS ordinal
  FROM q WHERE len(x) - k <= 1 AND len(y) - k <= 1 AND 100 * k >= 90 * greatest(len(x), len(y)))"""
#: Rows with candidates one after another, each with the list of those dropped so far.
LINEAGE = f"""{PAIRS}, curs AS (SELECT cur, row_number() OVER (ORDER BY cur) AS k, list(cand) AS cands FROM pairs GROUP BY cur),
fate AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone
  UNION ALL SELECT c.k, CASE WHEN len(list_filter(c.cands, lambda x: NOT list_contains(f.gone, x))) > 0 THEN list_append(f.gone, c.cur) ELSE f.gone END FROM fate f JOIN curs c ON c.k = f.k + 1),
gone AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM fate ORDER BY k DESC LIMIT 1)),
near AS (SELECT cur AS id, arg_min(cand, ordinal * 1000000000000 + cand) AS root FROM pairs WHERE cur IN (FROM gone) AND cand NOT IN (FROM gone) GROUP BY 1),
lineage AS MATERIALIZED (SELECT e.id, own, tickers, text_norm, CASE WHEN NOT kept THEN 'exact' WHEN root IS NOT NULL THEN 'near' END AS step, CASE WHEN NOT kept THEN anchor ELSE root END AS eliminated_by, coalesce(root, anchor) AS cluster
  FROM exacts e LEFT JOIN near ON near.id = e.anchor)"""


@query("exact_dedup", f"WITH RECURSIVE {EXACT} SELECT id, anchor, kept FROM exacts")
def exact_dedup(spark, sf_dir):
    return dedup.exact(stamped_documents(spark, sf_dir).select("id", "ts", "text_norm")).select("id", "anchor", "kept")


@query("near_dup_pairs", f"WITH RECURSIVE {PAIRS} SELECT * FROM pairs")
def near_dup_pairs(spark, sf_dir):
    rows = dedup.exact(stamped_documents(spark, sf_dir).select("id", "ts", "text_norm"))
    return dedup.near_pairs(rows.where("kept").select("id", "ts", "text_norm"))


@query("dedup_lineage", f"WITH RECURSIVE {LINEAGE} SELECT id, step IS NULL AS kept, step, eliminated_by, cluster FROM lineage")
def dedup_lineage(spark, sf_dir):
    return dedup.lineage(stamped_documents(spark, sf_dir))


@query("dedup_clusters", f"""WITH RECURSIVE {LINEAGE} SELECT cluster AS id, count(*) AS members, array_to_string(list_sort(list_distinct(flatten(list(tickers)))), '|') AS tickers FROM lineage GROUP BY 1""")
def dedup_clusters(spark, sf_dir):
    rows = stamped_documents(spark, sf_dir)
    return dedup.clusters(rows, dedup.lineage(rows)).withColumn("tickers", F.array_join("tickers", "|"))


@query("dedup_statistics", f"""WITH RECURSIVE {LINEAGE} SELECT count(*) AS rows, count(*) FILTER (step = 'exact') AS exact_dropped, count(*) FILTER (step = 'near') AS near_dropped, count(*) FILTER (step IS NULL) AS kept,
count(*) FILTER (step = 'exact' AND eliminated_by <> cluster) AS two_steps, avg((len(list_distinct(string_split(text_norm, ' '))) >= 20)::INT::DOUBLE) FILTER (step IS DISTINCT FROM 'exact') AS blind_share, 20 AS missable_length FROM lineage""")
def dedup_statistics(spark, sf_dir):
    rows = stamped_documents(spark, sf_dir)
    return dedup.statistics(rows, dedup.lineage(rows))


@query("article_groups", f"""WITH RECURSIVE w AS (SELECT item_id AS id, list_sort(list_distinct(string_split({NORM_SQL}, ' '))) AS tokens FROM benchmark), b AS (SELECT * FROM w UNION ALL SELECT id + 1000000, list_append(tokens, 'zz') FROM w WHERE id % 3 = 0),
e AS (SELECT x.id AS a, y.id AS b FROM b x JOIN b y ON 100 * len(list_intersect(x.tokens, y.tokens)) >= 90 * greatest(len(x.tokens), len(y.tokens))),
r AS (SELECT a AS id, a AS comp FROM e UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(comp) AS first FROM r GROUP BY 1)
SELECT id, dense_rank() OVER (ORDER BY first) - 1 AS group_id FROM c""")
def article_groups(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.normalized(F.col("text")).alias("text_norm"))
    near = rows.where("id % 3 = 0").select((F.col("id") + 1_000_000).alias("id"), F.concat("text_norm", F.lit(" zz")).alias("text_norm"))
    return dedup.article_groups(rows.unionByName(near))


@query("lexicon_score", f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') AS w FROM documents),
c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN {tuple(GOOD)}))::DOUBLE AS p, len(list_filter(w, lambda x: x IN {tuple(BAD)}))::DOUBLE AS n FROM t)
SELECT doc_id, (CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END)::FLOAT AS score FROM c""")
def lexicon_score(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.lexicon_score(F.col("text"), GOOD, BAD).alias("score"))


@query("map_date_deferred", f"WITH {CAL}, {ASSIGNED} SELECT o_orderkey, session::VARCHAR AS session FROM assigned")
def map_date_deferred(spark, sf_dir):
    return scored_orders(spark, sf_dir).select("o_orderkey", named_day("session"))


@query("map_date_same_day", f"""WITH {CAL} SELECT o_orderkey, session::VARCHAR AS session FROM orders LEFT JOIN cal ON (o_orderdate::DATE > prev AND o_orderdate::DATE <= session) OR (prev IS NULL AND o_orderdate::DATE = session)""")
def map_date_same_day(spark, sf_dir):
    return scored_orders(spark, sf_dir, defer=False).select("o_orderkey", named_day("session"))


INTRA = "ical AS (SELECT d::DATE AS session, lag(d::DATE) OVER (ORDER BY d) AS prev FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)"


@query("map_intraday", f"""WITH {INTRA} SELECT event_id, session::VARCHAR AS session FROM events LEFT JOIN ical ON ts > prev + INTERVAL 16 HOUR AND ts <= session + INTERVAL 16 HOUR""")
def map_intraday(spark, sf_dir):
    days = sessions.calendar(spark, "2024-01-01", "2024-01-31")
    return sessions.map_intraday(read(spark, sf_dir, "events"), days, "ts").select("event_id", named_day("session"))


@query("daily_mean", f"WITH {CAL}, {ASSIGNED}, {DAILY} SELECT session::VARCHAR AS session, n, round(s, 6) AS s, round(d, 11) AS d FROM daily")
def daily_mean(spark, sf_dir):
    return day_frame(spark, sf_dir).select(named_day("session"), "n", F.round("s", 6).alias("s"), F.round("d", 11).alias("d"))


@query("daily_median", f"WITH {CAL}, {ASSIGNED} SELECT cal.session::VARCHAR AS session, count(a.o_orderkey) AS n, median(score) AS s FROM cal LEFT JOIN assigned a ON a.session = cal.session GROUP BY 1")
def daily_median(spark, sf_dir):
    return day_frame(spark, sf_dir, "median").select(named_day("session"), "n", "s")


PANEL_COLS = ["s", "d", "close", "ret", "range_var", "log_volume", "volume_gap", "ret_lag1", "range_var_lag1", "log_volume_lag1", *[f"ret_lead{h}" for h in sessions.HORIZONS]]


@query("daily_panel", f"WITH {PANEL} SELECT session::VARCHAR AS session, n, {', '.join(f'round({c}, {PLACES.get(c, ROUND)}) AS {c}' for c in PANEL_COLS)} FROM panel")
def daily_panel(spark, sf_dir):
    return rounded(whole_panel(spark, sf_dir).select(named_day("session"), "n", *PANEL_COLS), *PANEL_COLS)


_X = ["1.0::DOUBLE", *XS]
NORMAL = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(sum(({a}) * ({b})), 5) + 0.0 AS value FROM kept" for i, a in enumerate(_X) for j, b in [*enumerate(_X), (-1, "ret_lead1")] if j == -1 or j >= i)


@query("normal_equations", f"WITH {KEPT} {NORMAL}")
def normal_equations(spark, sf_dir):
    return stats.normal_equations(kept_rows(spark, sf_dir), XS, "ret_lead1").select("i", "j", (F.round("value", 5) + 0.0).alias("value"))


@query("meat_of_products", f"""WITH {KEPT}, g AS (SELECT pos, ret_lead1 AS g0, z_s * ret_lead1 AS g1, z_d * ret_lead1 AS g2 FROM kept), c AS (SELECT i::INT AS i, j::INT AS j FROM range(3) a(i), range(3) b(j) WHERE i <= j),
l AS (SELECT x.pos - y.pos AS lag, [x.g0, x.g1, x.g2] AS x, [y.g0, y.g1, y.g2] AS y FROM g x JOIN g y ON x.pos - y.pos BETWEEN 0 AND {LAGS})
SELECT i, j, round(sum(CASE WHEN lag = 0 THEN x[i + 1] * y[j + 1] ELSE (1 - lag / {LAGS + 1}.0::DOUBLE) * (x[i + 1] * y[j + 1] + y[i + 1] * x[j + 1]) END), 7) AS value FROM l, c GROUP BY 1, 2""")
def meat_of_products(spark, sf_dir):
    meat = stats.hac_meat(kept_rows(spark, sf_dir), ["z_s", "z_d"], "ret_lead1", [0.0, 0.0, 0.0], LAGS)
    return meat.select("i", "j", F.round("value", 7).alias("value"))


@query("acf", f"""WITH {PANEL}, c AS (SELECT row_number() OVER (ORDER BY session) AS r, s - avg(s) OVER () AS c FROM panel WHERE s IS NOT NULL),
l AS (SELECT (a.r - b.r)::INT AS lag, sum(a.c * b.c) AS s FROM c a JOIN c b ON a.r - b.r BETWEEN 0 AND 20 GROUP BY 1)
SELECT lag, round(s / (SELECT s FROM l WHERE lag = 0), {ROUND}) AS acf FROM l""")
def acf(spark, sf_dir):
    return rounded(stats.autocorrelation(day_frame(spark, sf_dir).where("s IS NOT NULL"), "s", "session"), "acf")


TESTS = "tests AS (SELECT c_custkey AS id, c_nationkey AS family, (('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE AS p FROM customer)"


@query("bh_by", f"""WITH {TESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS r, count(*) OVER (PARTITION BY family) AS m FROM tests),
h AS (SELECT *, (SELECT sum(1.0::DOUBLE / i) FROM range(1, m + 1) q(i)) AS c FROM r)
SELECT id, family, p, round(least(1.0, min(p * m / r) OVER w), 9) AS bh, round(least(1.0, min(p * m / r * c) OVER w), 9) AS by
FROM h WINDOW w AS (PARTITION BY family ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def bh_by(spark, sf_dir):
    p = (F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    tests = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("family"), p.cast("double").alias("p"))
    return stats.adjusted(tests, "p", ["family"]).withColumns({"bh": F.round("bh", 9), "by": F.round("by", 9)})


def judged(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), T.lexicon_score(F.col("text"), GOOD, BAD).cast("double").alias("score"))
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "quality", "toxic", "score", (F.col("chars") > 500).cast("int").alias("long"))


JUDGED = f"""t AS (SELECT doc_id, length(text) AS chars, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') AS w FROM documents),
c AS (SELECT doc_id, chars, len(list_filter(w, lambda x: x IN {tuple(GOOD)}))::DOUBLE AS p, len(list_filter(w, lambda x: x IN {tuple(BAD)}))::DOUBLE AS n FROM t),
judged AS (SELECT doc_id, quality, toxic, (CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END)::FLOAT::DOUBLE AS score, (chars > 500)::INT AS long FROM labels JOIN c USING (doc_id))"""


@query("confusion", f"WITH {JUDGED} SELECT quality, long, count(*) AS n FROM judged GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return stats.confusion(judged(spark, sf_dir), "quality", "long")


@query("mcnemar_cells", f"""WITH {JUDGED}, b AS (SELECT (score > 0) = (quality = 1) AS x, (long = 1) = (quality = 1) AS y FROM judged)
SELECT count(*) FILTER (x AND y) AS "both", count(*) FILTER (x AND NOT y) AS first_only, count(*) FILTER (NOT x AND y) AS second_only, count(*) FILTER (NOT x AND NOT y) AS neither FROM b""")
def mcnemar_cells(spark, sf_dir):
    good = F.col("quality") == 1
    return stats.mcnemar_cells(judged(spark, sf_dir), (F.col("score") > 0) == good, (F.col("long") == 1) == good)


@query("kappa", f"""WITH {JUDGED}, s AS (SELECT count(*) AS rows, avg((quality = long)::INT::DOUBLE) AS po, avg(quality) AS a, avg(long) AS b FROM judged)
SELECT rows, round(po, 9) AS agreement, round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 9) AS kappa FROM s""")
def kappa(spark, sf_dir):
    return stats.kappa(judged(spark, sf_dir), "quality", "long").select("rows", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


STRATA = """strata AS (SELECT lang || '|' || source AS stratum, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1),
e AS (SELECT *, n * 200.0::DOUBLE / sum(n) OVER () AS e FROM strata), f AS (SELECT *, floor(e)::BIGINT AS f FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY round(e - f, 9) DESC, stratum) AS r, 200 - sum(f) OVER () AS spare FROM f), alloc AS (SELECT stratum, n, least(n, f + (r <= spare)::INT) AS take FROM r)"""


def strata(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").withColumn("stratum", F.concat_ws("|", "lang", "source"))
    return docs, stats.allocation(docs.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), 200)


@query("stratum_allocation", f"WITH {STRATA} SELECT stratum, n, take FROM alloc")
def stratum_allocation(spark, sf_dir):
    return strata(spark, sf_dir)[1]


@query("stratified_draw", f"""WITH {STRATA}, d AS (SELECT doc_id, lang || '|' || source AS stratum, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7|' || doc_id), doc_id) AS r FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, stratum FROM d JOIN alloc USING (stratum) WHERE r <= take""")
def stratified_draw(spark, sf_dir):
    from pyspark.sql import Window as W

    docs, alloc = strata(spark, sf_dir)
    rank = F.row_number().over(W.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))), "doc_id"))
    most = docs.select("doc_id", "stratum", rank.alias("r")).where("r <= 200")  # no stratum draws more: ranks stay local top lists
    return most.join(F.broadcast(alloc.select("stratum", "take")), "stratum").where("r <= take").select("doc_id", "stratum")
