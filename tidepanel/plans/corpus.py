"""Queries of audits, score checks, annotation and streams, beside their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidepanel.functions import text as T
from tidepanel.operators import annotate, audit, dedup, evaluate, sessions, stats, studies, work
from tidepanel.plans import queries as Q
from tidepanel.plans.registry import query
from tidepanel.sources import market, scores

SOURCES = [("shop", "shop"), ("wiki", "wiki"), ("example.com", "example")]

#: Documents as articles: sources by identifier, of which a third publish at midnight; every fourth article has no tag.
ARTICLES = """articles AS MATERIALIZED (SELECT doc_id AS id, source, coalesce(text, '') AS text, TIMESTAMP '2024-01-01' + to_days((doc_id % 30)::INT) + to_seconds(CASE WHEN length(coalesce(source, '')) % 3 = 0 THEN 0 ELSE doc_id * 7919 % 86400 END) AS ts,
  CASE WHEN doc_id % 4 = 0 THEN [] ELSE ['T' || doc_id % 17, 'T' || doc_id % 5] END AS tickers FROM documents)"""


def articles(spark, sf_dir):
    second = F.when(F.length(F.coalesce("source", F.lit(""))) % 3 == 0, 0).otherwise(F.col("doc_id") * 7919 % 86400)
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("doc_id") % 30).cast("int"), secs=second.cast("decimal(18,6)"))
    tag = lambda n: F.concat(F.lit("T"), (F.col("doc_id") % n).cast("string"))
    tags = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(tag(17), tag(5)))
    return Q.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.coalesce("text", F.lit("")).alias("text"), ts.alias("ts"), tags.alias("tickers"))


EVIDENCE = f"""{ARTICLES}, m AS (SELECT *, hour(ts) * 60 + minute(ts) AS minute, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS local FROM articles),
k AS (SELECT source, minute, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, minute) AS r FROM m GROUP BY 1, 2),
evidence AS MATERIALIZED (SELECT m.source, count(*) AS rows, avg((m.minute = 0)::INT::DOUBLE) AS midnight_share, any_value(k.minute) AS modal, any_value(k.n) / count(*)::DOUBLE AS modal_share, count(DISTINCT m.minute) AS minutes,
  avg((hour(local) * 60 + minute(local) < 570)::INT::DOUBLE) AS before_share, avg((hour(local) * 60 + minute(local) > 960)::INT::DOUBLE) AS after_share, avg((len(tickers) > 0)::INT::DOUBLE) AS tagged_share,
  avg(regexp_matches(text, '[\\x{{0400}}-\\x{{04FF}}]')::INT::DOUBLE) AS cyrillic_share, avg(regexp_matches(text, '[^\\x00-\\x7F]')::INT::DOUBLE) AS other_share, min(ts) AS first_ts, max(ts) AS last_ts
  FROM m JOIN k ON k.source IS NOT DISTINCT FROM m.source AND k.r = 1 GROUP BY m.source)"""
SHARES = ("midnight_share", "modal_share", "before_share", "after_share", "in_session_share", "tagged_share", "cyrillic_share", "other_share")


@query("source_evidence", f"""WITH {EVIDENCE} SELECT source, rows, minutes, lpad((modal // 60)::VARCHAR, 2, '0') || ':' || lpad((modal % 60)::VARCHAR, 2, '0') AS modal_time, round(1.0 - before_share - after_share, 9) AS in_session_share,
{', '.join(f'round({c}, 9) AS {c}' for c in SHARES if c != 'in_session_share')}, first_ts, last_ts, modal_share >= 0.5 OR minutes < 60 AS date_only, cyrillic_share > 0.05 AS likely_non_english, CASE WHEN modal_share >= 0.5 OR minutes < 60 THEN 'date-only' ELSE 'intraday' END AS verdict FROM evidence""")
def source_evidence(spark, sf_dir):
    return audit.evidence(articles(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in SHARES})


@query("source_screen", f"WITH {EVIDENCE} SELECT source, NOT (modal_share >= 0.5 OR minutes < 60) AS intraday, NOT cyrillic_share > 0.05 AS english, tagged_share >= 0.5 AS tagged FROM evidence WHERE rows >= 20")
def source_screen(spark, sf_dir):
    return audit.screened(audit.evidence(articles(spark, sf_dir)), 20)


@query("coverage_by_year", "SELECT year(o_orderdate)::INT AS year, count(*) AS n, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders GROUP BY 1")
def coverage_by_year(spark, sf_dir):
    return audit.coverage_by_year(Q.read(spark, sf_dir, "orders"), "o_orderdate")


RARE = "rare AS (SELECT session, count(o_orderkey) AS n FROM cal LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 350000) o ON o_orderdate::DATE >= prev AND o_orderdate::DATE < session GROUP BY 1)"


@query("zero_sessions", f"WITH {Q.CAL}, {RARE} SELECT CASE WHEN session = (SELECT min(session) FROM cal) THEN 'boundary' ELSE 'no_news' END AS kind, count(*) AS n FROM rare WHERE n = 0 GROUP BY 1")
def zero_sessions(spark, sf_dir):
    days = Q.calendar(spark)
    large = Q.read(spark, sf_dir, "orders").where("o_totalprice > 350000").select("o_orderdate", F.lit(0.0).alias("score"))
    return audit.zero_sessions(sessions.daily(sessions.map_dates(large, days, "o_orderdate"), days, F.col("score")))


@query("coverage_withheld", f"WITH {Q.CAL}, {Q.ASSIGNED}, {Q.DAILY} SELECT count(*) AS sessions, sum(n)::BIGINT AS events, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS zero_share, NULL::DOUBLE AS thin_share, 'a sample of neighbouring blocks says nothing of the corpus' AS withheld FROM daily")
def coverage_withheld(spark, sf_dir):
    return audit.withheld(audit.coverage(Q.day_frame(spark, sf_dir)), True, ["mean", "median", "zero_share", "thin_share"])


@query("repeated_share", f"WITH {Q.DOCS}, c AS (SELECT text_norm, count(*) AS n FROM docs GROUP BY 1) SELECT sum(n)::BIGINT AS rows, count(*) AS texts, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)::DOUBLE AS repeated_share FROM c")
def repeated_share(spark, sf_dir):
    return audit.repeated_share(Q.dated_documents(spark, sf_dir), "text_norm")


@query("top_tags", f"WITH {ARTICLES} SELECT tag, count(*) AS n FROM (SELECT unnest(tickers) AS tag FROM articles) GROUP BY 1 ORDER BY n DESC, tag LIMIT 15")
def top_tags(spark, sf_dir):
    return audit.top_tags(articles(spark, sf_dir))


@query("tag_concentration", f"""WITH {ARTICLES}, c AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tickers) AS tag FROM articles) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, tag) AS r FROM c)
SELECT count(*) AS tags, sum(n) FILTER (r <= 10) / sum(n)::DOUBLE AS top10, sum(n) FILTER (r <= 50) / sum(n)::DOUBLE AS top50, sum(n) FILTER (r <= 100) / sum(n)::DOUBLE AS top100,
sum(n::DOUBLE * n) / (sum(n)::DOUBLE * sum(n)) AS hhi, (sum(n)::DOUBLE * sum(n)) / sum(n::DOUBLE * n) AS effective FROM r""")
def tag_concentration(spark, sf_dir):
    return audit.concentration(articles(spark, sf_dir).select(F.explode("tickers").alias("tag")), "tag")


@query("content_sample", f"WITH {ARTICLES} SELECT id, md5(text) AS text_md5 FROM articles ORDER BY md5('7|' || id), id LIMIT 25")
def content_sample(spark, sf_dir):
    return audit.content_sample(articles(spark, sf_dir), 25).select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("first_days", f"WITH {ARTICLES} SELECT id FROM articles WHERE ts::DATE IN (SELECT DISTINCT ts::DATE AS d FROM articles ORDER BY d LIMIT 3)")
def first_days(spark, sf_dir):
    return audit.first_days(articles(spark, sf_dir), "ts", 3).select("id")


@query("calendar_difference", f"WITH {Q.CAL}, own AS (SELECT DISTINCT l_shipdate::DATE AS session FROM lineitem) SELECT session::VARCHAR AS session, 'extra' AS side FROM own WHERE session NOT IN (SELECT session FROM cal) UNION ALL SELECT session::VARCHAR, 'lacking' FROM cal WHERE session NOT IN (SELECT session FROM own)")
def calendar_difference(spark, sf_dir):
    own = Q.read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session"))
    return audit.calendar_difference(own, Q.calendar(spark)).withColumn("session", F.col("session").cast("string"))


@query("trailing_means", f"""WITH {Q.CAL}, {Q.ASSIGNED}, {Q.DAILY} SELECT session::VARCHAR AS session, round(s, 6) AS s, round(avg(s) OVER (ORDER BY session ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 6) AS mean21,
round(avg(s) OVER (ORDER BY session ROWS BETWEEN 62 PRECEDING AND CURRENT ROW), 6) AS mean63 FROM daily""")
def trailing_means(spark, sf_dir):
    rows = audit.trailing(Q.day_frame(spark, sf_dir), "s")
    return rows.select(F.col("session").cast("string").alias("session"), *[F.round(c, 6).alias(c) for c in ("s", "mean21", "mean63")])


@query("dispersion_line", f"WITH {Q.CAL}, {Q.ASSIGNED}, {Q.DAILY} SELECT round(regr_slope(d, s), 8) AS slope, round(regr_intercept(d, s), 8) AS intercept, round(corr(d, s), 8) AS corr, regr_count(d, s)::BIGINT AS n FROM daily")
def dispersion_line(spark, sf_dir):
    return audit.line(Q.day_frame(spark, sf_dir), "d", "s").select(*[F.round(c, 8).alias(c) for c in ("slope", "intercept", "corr")], "n")


@query("source_names", f"""SELECT name, count(*) AS n FROM (SELECT CASE WHEN contains(lower(url), 'shop') THEN 'shop' WHEN contains(lower(url), 'wiki') THEN 'wiki' WHEN contains(lower(url), 'example.com') THEN 'example'
ELSE coalesce({Q.HOST_SQL}, '(no url)') END AS name FROM pages) GROUP BY 1""")
def source_names(spark, sf_dir):
    return Q.read(spark, sf_dir, "pages").groupBy(T.source_name(F.col("url"), SOURCES).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("numbered_rows", f"WITH {ARTICLES} SELECT id, row_number() OVER (ORDER BY ts, id) - 1 AS source_row_id FROM articles")
def numbered_rows(spark, sf_dir):
    return dedup.numbered(articles(spark, sf_dir).select("id", "ts")).select("id", "source_row_id")


@query("intraday_in_zone", """WITH ical AS (SELECT d::DATE AS session, lag(d::DATE) OVER (ORDER BY d) AS prev FROM generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
e AS (SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS local FROM events)
SELECT event_id, session::VARCHAR AS session FROM e LEFT JOIN ical ON local > coalesce(prev, DATE '2024-01-01') + INTERVAL 16 HOUR AND local <= session + INTERVAL 16 HOUR""")
def intraday_in_zone(spark, sf_dir):
    """UTC stamps on a calendar whose session before is told, by the closing hour of a zone."""
    days = sessions.calendar(spark, "2024-01-02", "2024-01-31")
    return sessions.map_intraday(Q.read(spark, sf_dir, "events"), days, "ts", prior="2024-01-01", zone="America/New_York").select("event_id", F.col("session").cast("string").alias("session"))


@query("session_closes", f"WITH {Q.CAL} SELECT session::VARCHAR AS session, strftime((session + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS close FROM cal")
def session_closes(spark, sf_dir):
    rows = sessions.session_closes(Q.calendar(spark))
    return rows.select(F.col("session").cast("string").alias("session"), F.date_format("close", "yyyy-MM-dd HH:mm").alias("close"))


@query("complete_sessions", f"WITH {Q.CAL}, {Q.ASSIGNED} SELECT session::VARCHAR AS session, bool_and(o_orderkey % 50 <> 0) AS complete FROM assigned WHERE session IS NOT NULL GROUP BY 1")
def complete_sessions(spark, sf_dir):
    events = Q.scored_orders(spark, sf_dir).withColumn("score", F.when(F.col("o_orderkey") % 50 != 0, F.col("score")))
    return sessions.complete_sessions(events, "score").withColumn("session", F.col("session").cast("string"))


# Scores


@query("score_problems", """WITH h AS (SELECT doc_id FROM documents), s AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 2.0 ELSE 0.5 END AS v FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id, 0.1 FROM documents WHERE doc_id % 101 = 0)
SELECT 'repeated or null ids' AS problem, count(*) AS n FROM (SELECT doc_id FROM s GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'headlines without scores', count(*) FROM h WHERE doc_id NOT IN (SELECT doc_id FROM s)
UNION ALL SELECT 'values of score_x that are null or outside [-1, 1]', count(*) FROM s WHERE v IS NULL OR abs(v) > 1""")
def score_problems(spark, sf_dir):
    ids = Q.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("headline_id"))
    value = F.when(F.col("headline_id") % 13 == 0, F.lit(None)).when(F.col("headline_id") % 17 == 0, 2.0).otherwise(0.5).cast("double")
    found = ids.where("headline_id % 11 <> 0").withColumn("score_x", value).unionByName(ids.where("headline_id % 101 = 0").withColumn("score_x", F.lit(0.1)))
    return scores.check(ids, found, ["score_x"])


@query("score_store", f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN {tuple(Q.GOOD)}))::DOUBLE AS p, len(list_filter(w, lambda x: x IN {tuple(Q.BAD)}))::DOUBLE AS n FROM t)
SELECT 'd' || doc_id AS headline_id, (CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END)::FLOAT AS score_lm FROM c""")
def score_store(spark, sf_dir):
    """A store filled in two steps: half of the documents, then all, of which the first half is only read."""
    docs = Q.read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("headline_id"), "text", "doc_id")
    store = scores.Store(spark, f"{work.shared_dir(spark)}/scores-{uuid.uuid4().hex}", ["lm"])
    scorer = scores.LexiconScorer("lm", Q.GOOD, Q.BAD)
    scores.score_all(docs.where("doc_id % 2 = 0").drop("doc_id"), store, [scorer])
    return scores.score_all(docs.drop("doc_id"), store, [scorer])


@query("score_plan", "SELECT doc_id % 3 = 1 AS changed, doc_id % 3 <> 0 AS todo, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def score_plan(spark, sf_dir):
    """What a store that holds two thirds of the documents, half of them with another text, still needs."""
    docs = Q.read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("headline_id"), "text", "doc_id")
    stored = docs.where("doc_id % 3 <> 2").select("headline_id", F.sha2(F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary"), 256).alias("text_sha256"), F.lit(0.5).cast("float").alias("score_x"))
    plan = scores.lacking(docs.drop("doc_id"), stored, ["x"])
    return plan.groupBy("changed", F.col("score_x").isNull().alias("todo")).agg(F.count(F.lit(1)).alias("n"))


# Labels


@query("text_digests", "SELECT doc_id, sha256(text) AS digest, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS ok FROM documents WHERE text IS NOT NULL")
def text_digests(spark, sf_dir):
    docs = Q.read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return docs.withColumn("ok", T.is_digest(F.col("digest")))


TRUTH = f"""{Q.JUDGED}, truth AS MATERIALIZED (SELECT doc_id, quality - toxic AS truth, score, CASE WHEN long = 1 THEN 1 ELSE -1 END AS other FROM judged),
grid AS (SELECT l.g * 0.025::DOUBLE - 1.0::DOUBLE AS low, h.g * 0.025::DOUBLE - 1.0::DOUBLE AS high FROM range(81) l(g) JOIN range(81) h(g) ON l.g <= h.g)"""


def _f1(truth: str, pred: str) -> str:
    one = lambda v: f"CASE WHEN count(*) FILTER ({truth} = {v}) + count(*) FILTER ({pred} = {v}) > 0 THEN 2.0::DOUBLE * count(*) FILTER ({truth} = {v} AND {pred} = {v}) / (count(*) FILTER ({truth} = {v}) + count(*) FILTER ({pred} = {v})) ELSE 0 END"
    return f"({one(-1)} + {one(0)} + {one(1)}) / 3"


GRID = f"{TRUTH}, cells AS (SELECT low, high, truth, CASE WHEN score <= low + 2e-11 THEN -1 WHEN score > high + 2e-11 THEN 1 ELSE 0 END AS pred FROM grid, truth), f1 AS MATERIALIZED (SELECT low, high, {_f1('truth', 'pred')} AS macro_f1 FROM cells GROUP BY 1, 2)"


def truths(spark, sf_dir):
    rows = Q.judged(spark, sf_dir)
    return rows.select("doc_id", (F.col("quality") - F.col("toxic")).alias("truth"), "score", F.when(F.col("long") == 1, 1).otherwise(-1).alias("other"))


@query("threshold_grid", f"WITH {GRID} SELECT round(low, 9) AS low, round(high, 9) AS high, round(macro_f1, 9) AS macro_f1 FROM f1")
def threshold_grid(spark, sf_dir):
    return stats.threshold_grid(truths(spark, sf_dir), "truth", "score").select(*[F.round(c, 9).alias(c) for c in ("low", "high", "macro_f1")])


@query("threshold_fit", f"WITH {GRID} SELECT round(low, 9) AS low, round(high, 9) AS high, round(macro_f1, 9) AS macro_f1 FROM f1 ORDER BY round(f1.macro_f1, 12) DESC, f1.low, f1.high LIMIT 1")
def threshold_fit(spark, sf_dir):
    best = stats.best_band(stats.threshold_grid(truths(spark, sf_dir), "truth", "score"))
    return best.select(*[F.round(c, 9).alias(c) for c in ("low", "high", "macro_f1")])


LADDER = f"""{TRUTH}, p AS (SELECT 'score' AS scorer, truth, CASE WHEN score <= -0.1 THEN -1 WHEN score > 0.1 THEN 1 ELSE 0 END AS pred FROM truth UNION ALL SELECT 'length', truth, other FROM truth)"""


@query("evaluation_ladder", f"WITH {LADDER} SELECT scorer, round({_f1('truth', 'pred')}, 9) AS macro_f1, round(avg((truth = pred)::INT::DOUBLE), 9) AS accuracy, count(*) AS rows FROM p GROUP BY 1")
def evaluation_ladder(spark, sf_dir):
    rows = truths(spark, sf_dir)
    both = F.array(F.struct(F.lit("score").alias("scorer"), stats.banded(F.col("score"), -0.1, 0.1).alias("pred")), F.struct(F.lit("length").alias("scorer"), F.col("other").alias("pred")))
    cells = rows.select("truth", F.inline(both)).groupBy("scorer", "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    return stats.macro_f1(cells, ["scorer"]).withColumns({c: F.round(c, 9) for c in ("macro_f1", "accuracy")})


@query("confusion_by_group", f"WITH {LADDER} SELECT scorer, truth, pred, count(*) AS n FROM p GROUP BY 1, 2, 3")
def confusion_by_group(spark, sf_dir):
    rows = truths(spark, sf_dir)
    both = F.array(F.struct(F.lit("score").alias("scorer"), stats.banded(F.col("score"), -0.1, 0.1).alias("pred")), F.struct(F.lit("length").alias("scorer"), F.col("other").alias("pred")))
    return rows.select("truth", F.inline(both)).groupBy("scorer", "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


DRAWN = f"""{Q.STRATA}, d AS (SELECT doc_id, text, lang || '|' || source AS stratum, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7|' || doc_id), doc_id) AS r FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
drawn AS MATERIALIZED (SELECT doc_id AS id, list_sort(list_distinct(list_filter(string_split({Q.NORM_SQL}, ' '), lambda t: t <> ''))) AS tokens, text FROM d JOIN alloc USING (stratum) WHERE r <= take),
pair AS (SELECT x.id AS a, y.id AS b FROM drawn x JOIN drawn y ON x.id = y.id OR (len(x.tokens) = 0 AND len(y.tokens) = 0) OR (len(x.tokens) > 0 AND 100 * len(list_intersect(x.tokens, y.tokens)) >= 90 * greatest(len(x.tokens), len(y.tokens)))),
reach AS (SELECT a AS id, a AS comp FROM pair UNION SELECT pair.b, reach.comp FROM reach JOIN pair ON pair.a = reach.id), c AS (SELECT id, min(comp) AS first FROM reach GROUP BY 1),
groups AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY first) - 1 AS group_id FROM c),
sizes AS (SELECT group_id, count(*) AS n FROM groups GROUP BY 1),
taken AS (SELECT group_id, CASE WHEN coalesce(sum(n) OVER (ORDER BY md5('20|' || group_id), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 50 THEN 'calibration' ELSE 'evaluation' END AS part FROM sizes),
assigned AS MATERIALIZED (SELECT id, group_id, part FROM groups JOIN taken USING (group_id))"""


def assigned(spark, sf_dir):
    docs = Q.read(spark, sf_dir, "documents")
    rows = Q.stratified_draw(spark, sf_dir).join(docs.select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("id"), "text", T.normalized(F.col("text")).alias("text_norm"))
    rows = work.saved(rows, "drawn")
    return rows, work.saved(annotate.parts(dedup.article_groups(rows), 50), "parts")


@query("annotation_parts", f"WITH RECURSIVE {DRAWN} SELECT id, group_id, part FROM assigned")
def annotation_parts(spark, sf_dir):
    return assigned(spark, sf_dir)[1].select("id", "group_id", "part")


@query("annotation_pilot", f"WITH RECURSIVE {DRAWN} SELECT 'pilot' AS kind, id FROM (SELECT id FROM assigned WHERE part = 'calibration' ORDER BY md5('21|' || id), id LIMIT 15) UNION ALL SELECT 'second', id FROM (SELECT id FROM assigned ORDER BY md5('22|' || id), id LIMIT (SELECT round(count(*) * 0.2)::BIGINT FROM assigned))")
def annotation_pilot(spark, sf_dir):
    _, own = assigned(spark, sf_dir)
    return annotate.pilot(own, 15).select(F.lit("pilot").alias("kind"), "id").unionByName(annotate.second_annotator(own).select(F.lit("second").alias("kind"), "id"))


@query("blind_sheet", f"WITH RECURSIVE {DRAWN} SELECT (row_number() OVER (ORDER BY md5('23|' || id), id))::INT AS place, id, md5(text) AS text_md5 FROM drawn")
def blind_sheet(spark, sf_dir):
    return annotate.blind(assigned(spark, sf_dir)[0]).select("place", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("label_split", """WITH r AS (SELECT doc_id AS id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('24|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels) SELECT id, toxic, CASE WHEN r <= round(n * 20 / 100.0) THEN 'fit' ELSE 'evaluate' END AS part FROM r""")
def label_split(spark, sf_dir):
    return annotate.split(Q.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic"), "toxic")


@query("label_problems", """WITH a AS (SELECT doc_id AS id FROM documents), l AS (SELECT doc_id + (CASE WHEN doc_id % 10 = 0 THEN 100000000 ELSE 0 END) AS id, toxic FROM labels UNION ALL SELECT doc_id, 7 FROM labels WHERE doc_id % 9 = 0)
SELECT 'repeated or null ids' AS problem, count(*) AS n FROM (SELECT id FROM l GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'ids outside the set', count(*) FROM l WHERE id NOT IN (SELECT id FROM a)
UNION ALL SELECT 'items without a label', count(*) FROM a WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT 'unknown labels', count(*) FROM l WHERE toxic NOT IN (0, 1)""")
def label_problems(spark, sf_dir):
    own = Q.read(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 100_000_000).otherwise(0)).alias("id"), F.col("toxic").alias("label"), "doc_id")
    more = own.where("doc_id % 9 = 0").select(F.col("doc_id").alias("id"), F.lit(7).alias("label"))
    return annotate.label_problems(own.select("id", "label").unionByName(more), Q.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), (0, 1))


@query("per_class", f"""WITH {LADDER}, k AS (SELECT unnest([-1, 0, 1]) AS class) SELECT scorer, class, round(CASE WHEN count(*) FILTER (pred = class) > 0 THEN count(*) FILTER (truth = class AND pred = class) / count(*) FILTER (pred = class)::DOUBLE ELSE 0 END, 9) AS precision,
round(CASE WHEN count(*) FILTER (truth = class) > 0 THEN count(*) FILTER (truth = class AND pred = class) / count(*) FILTER (truth = class)::DOUBLE ELSE 0 END, 9) AS recall,
round(CASE WHEN count(*) FILTER (truth = class) + count(*) FILTER (pred = class) > 0 THEN 2 * count(*) FILTER (truth = class AND pred = class) / (count(*) FILTER (truth = class) + count(*) FILTER (pred = class))::DOUBLE ELSE 0 END, 9) AS f1,
count(*) FILTER (truth = class) AS support FROM p, k GROUP BY 1, 2""")
def per_class(spark, sf_dir):
    rows = truths(spark, sf_dir).select("truth", stats.banded(F.col("score"), -0.1, 0.1).alias("score"), F.col("other").alias("length"))
    return evaluate.per_class(rows, ["score", "length"], "truth").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("annotator_agreement", f"""WITH {Q.JUDGED}, b AS (SELECT quality AS a, long AS b FROM judged WHERE doc_id % 5 <> 0), u AS (SELECT count(*) AS usable, avg((a = b)::INT::DOUBLE) AS po, avg(a) AS x, avg(b) AS y FROM b)
SELECT (SELECT count(*) FROM judged) AS matched, usable, round(po, 9) AS agreement, round((po - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))), 9) AS kappa FROM u""")
def annotator_agreement(spark, sf_dir):
    rows = Q.judged(spark, sf_dir).select(F.col("doc_id").alias("id"), "quality", F.when(F.col("doc_id") % 5 != 0, F.col("long")).alias("second"))
    found = evaluate.agreement(rows.select("id", F.col("quality").alias("label")), rows.select("id", F.col("second").alias("label")))
    return found.withColumns({c: F.round(c, 9) for c in ("agreement", "kappa")})


@query("census", f"""WITH {Q.CAL}, {Q.ASSIGNED}, {Q.DAILY} SELECT 'assigned' AS part, count(session)::DOUBLE AS value FROM assigned UNION ALL SELECT 'unassignable', count(*) FILTER (session IS NULL) FROM assigned
UNION ALL SELECT 'sessions', count(*) FROM daily UNION ALL SELECT 'events', sum(n) FROM daily UNION ALL SELECT 'median', median(n) FROM daily""")
def census(spark, sf_dir):
    found = audit.census(Q.scored_orders(spark, sf_dir).withColumn("tickers", F.array(F.col("o_orderkey").cast("string"))), Q.calendar(spark))
    first = found["assigned"].select(F.inline(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).cast("double").alias("value")) for c in ("assigned", "unassignable")])))
    return first.unionByName(found["coverage"].select(F.inline(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).cast("double").alias("value")) for c in ("sessions", "events", "median")]))))


@query("market_with_warm_up", """WITH cal AS (SELECT d::DATE AS session FROM generate_series(TIMESTAMP '1996-06-01', TIMESTAMP '1997-12-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6 AND d::DATE NOT IN (DATE '1997-01-01', DATE '1996-12-25')),
own AS (SELECT * FROM cal WHERE session >= DATE '1997-01-02' OR session IN (SELECT session FROM cal WHERE session < DATE '1997-01-02' ORDER BY session DESC LIMIT 70)),
bars AS (SELECT l_shipdate::DATE AS session, avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1), vol AS (SELECT o_orderdate::DATE AS session, avg(o_totalprice) AS close FROM orders GROUP BY 1)
SELECT own.session::VARCHAR AS session, own.session >= DATE '1997-01-02' AS in_window, round(ln(b.close) - lag(ln(b.close)) OVER (ORDER BY own.session), 7) AS ret, round(b.volume, 3) AS volume, round(v.close, 8) AS index_close
FROM own LEFT JOIN bars b USING (session) LEFT JOIN vol v USING (session)""")
def market_with_warm_up(spark, sf_dir):
    holidays = spark.createDataFrame([("1997-01-01",), ("1996-12-25",)], "day string")
    days = market.with_warm_up(spark, "1997-01-02", "1997-12-31", holidays, 70)
    bars = sessions.bars(Q.read(spark, sf_dir, "lineitem"), "l_shipdate", F.col("l_extendedprice") / F.col("l_quantity"), "l_quantity")
    index = Q.read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("session")).agg(F.avg("o_totalprice").alias("close"))
    rows = market.load(bars, index, days)
    return rows.select(F.col("session").cast("string").alias("session"), "in_window", F.round("ret", 7).alias("ret"), F.round("volume", 3).alias("volume"), F.round("index_close", 8).alias("index_close"))


# Streams

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@query("stream_daily", f"WITH {Q.CAL}, {Q.ASSIGNED} SELECT session::VARCHAR AS session, count(*) AS n, round(avg(score), 6) AS s FROM assigned WHERE session IS NOT NULL GROUP BY 1")
def stream_daily(spark, sf_dir):
    """Orders as a stream of files, mapped to sessions and summed up; the last state of every session."""
    from tidepanel import streaming

    folder = f"{work.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    orders = streaming.files(spark, sf_dir, ORDERS, "orders.parquet")
    streaming.totals(orders, Q.calendar(spark), "o_orderdate", F.col("o_totalprice") / 500000.0, f"{folder}/out", f"{folder}/checkpoint")
    return streaming.latest(spark, f"{folder}/out").select(F.col("session").cast("string").alias("session"), "n", F.round("s", 6).alias("s"))


# Simulations

_CASES = [f"SELECT 'classical' AS study, '{n}' AS parameter, 0.5::DOUBLE / (1 + {n}) AS predicted UNION ALL SELECT 'no signal', '{n}', 0.0" for n in (0.0, 0.25, 1.0, 4.0)]
_CASES += [f"SELECT 'standardized', '{a} {n}', 0.5::DOUBLE * sqrt({a * a} / ({a * a} + {n}::DOUBLE))" for a in (1.0, 2.0) for n in (0.0, 0.25, 1.0)]
_CASES += [f"SELECT 'aggregated', '{n}', 0.05::DOUBLE * sqrt(0.01 / (0.01 + {n}::DOUBLE / 337))" for n in (0.25, 0.5)]
_CASES += [f"SELECT 'correlated', '{r}', 0.05::DOUBLE * sqrt(0.01 / (0.01 + 0.25::DOUBLE * (1 + 336 * {r}) / 337))" for r in (0.0, 0.01, 0.1, 1.0)]


@query("attenuation_study", f"SELECT study, parameter, round(predicted, 9) AS predicted, TRUE AS met FROM ({' UNION ALL '.join(_CASES)})")
def attenuation_study(spark, sf_dir):
    """Predicted slopes, and whether 200,000 draws give them to 0.02 (the bounded case has no SQL and is tested)."""
    rows = studies.attenuation(spark).where("study <> 'bounded'")
    return rows.select("study", "parameter", F.round("predicted", 9).alias("predicted"), (F.abs(F.col("simulated") - F.col("predicted")) < 0.02).alias("met"))


@query("spacing_study")
def spacing_study(spark, sf_dir):
    return studies.spacing(spark)
