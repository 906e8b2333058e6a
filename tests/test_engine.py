"""Operators against loops and known values."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import text as T
from tidepanel.operators import dedup, sessions, stats
from tidepanel.sources import news


def corpus(spark, n=160, seed=1):
    """Short texts of a few templates with small changes, stamped within some days; ids are in time order."""
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 3)) for _ in range(k)) for k in (1, 2, 12, 24, 30, 70)]
    rows = []
    for _ in range(n):
        words = r.choice(base).split()
        if r.random() < 0.5:
            words[r.randrange(len(words))] = f"x{r.randint(0, 3)}"
        rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randint(0, 24 * 14)), " ".join(words)))
    rows = [(k, ts, t, [f"T{k % 5}"]) for k, (ts, t) in enumerate(sorted(rows))]
    return rows, spark.createDataFrame(rows, "id long, ts timestamp_ntz, text_norm string, tickers array<string>").repartition(5)


def exact_loop(rows, days=3):
    last, out = {}, {}
    for i, ts, t, _ in sorted(rows, key=lambda x: (x[1], x[0])):
        if t not in last or ts > last[t][1] + dt.timedelta(days=days):
            last[t] = (i, ts)
        out[i] = last[t][0]
    return out


def test_exact_fold_is_the_loop(spark):
    rows, df = corpus(spark)
    want = exact_loop(rows)
    for fold in (10_000, 1):  # in one array, and by doubling
        assert {x["id"]: x["anchor"] for x in dedup.exact(df, fold=fold).collect()} == want
    edge = [(0, dt.datetime(2024, 1, 1, 1), "t"), (1, dt.datetime(2024, 1, 4, 1), "t"), (2, dt.datetime(2024, 1, 4, 23), "t")]
    got = {x["id"]: x["kept"] for x in dedup.exact(spark.createDataFrame(edge, "id long, ts timestamp_ntz, text_norm string")).collect()}
    assert got == {0: True, 1: False, 2: True}
    assert dedup.exact(df.limit(0)).count() == 0


def test_near_duplicates_are_those_of_the_loop(spark):
    rows, df = corpus(spark, seed=2)
    anchor = exact_loop(rows)
    kept_rows = [(i, ts, set(t.split())) for i, ts, t, _ in rows if anchor[i] == i]
    pairs, dropped, root = set(), set(), {}
    for k, (i, ts, a) in enumerate(kept_rows):
        own = sorted(a)
        found = []
        for j, tj, b in kept_rows[:k]:
            shared = len(a & b)
            if ts <= tj + dt.timedelta(days=3) and len(a) - shared <= 1 and len(b) - shared <= 1 and 100 * shared >= 90 * max(len(a), len(b)):
                ordinal = 0 if a <= b else 1 + own.index(next(iter(a - b)))
                pairs.add((i, j, ordinal))
                if j not in dropped:
                    found.append((ordinal, j))
        if found:
            dropped.add(i)
            root[i] = min(found)[1]
    assert len(dropped) > 5
    whole = dedup.exact(df)
    got = dedup.near_pairs(whole.where("kept").select("id", "ts", "text_norm"))
    assert {tuple(x) for x in got.collect()} == pairs
    line = {x["id"]: x for x in dedup.lineage(df).collect()}
    for i, *_ in rows:
        want = root.get(anchor[i], anchor[i])
        assert line[i]["cluster"] == want and line[i]["kept"] == (want == i)
        assert line[i]["eliminated_by"] == (None if want == i else anchor[i] if anchor[i] != i else want)
    merged = {x["id"]: x for x in dedup.clusters(df, dedup.lineage(df)).collect()}
    for i, x in merged.items():
        own = [r for r in rows if line[r[0]]["cluster"] == i]
        assert x["members"] == len(own) and x["tickers"] == sorted({t for r in own for t in r[3]})
    assert sum(x["members"] for x in merged.values()) == len(rows) and dedup.missable_length(90) == 20
    assert dedup.resolved(got.limit(0)).count() == 0


def test_article_groups_are_components(spark):
    rows, df = corpus(spark, 80, seed=3)
    sets, comp = [set(r[2].split()) for r in rows], list(range(len(rows)))

    def find(v):
        while comp[v] != v:
            v = comp[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][2] == rows[j][2] or 100 * len(sets[i] & sets[j]) >= 90 * max(len(sets[i]), len(sets[j])):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    firsts = sorted({find(i) for i in range(len(rows))})
    assert {x["id"]: x["group_id"] for x in dedup.article_groups(df).collect()} == {i: firsts.index(find(i)) for i in range(len(rows))}


def test_intraday_edges(spark):
    days = sessions.calendar(spark, "2024-01-01", "2024-01-09")
    rows = [(1, "2024-01-02 16:00:00"), (2, "2024-01-02 16:00:00.000001"), (3, "2024-01-05 17:00:00"), (4, "2024-01-01 09:00:00"), (5, "2024-01-09 16:00:01")]
    events = spark.createDataFrame(rows, "id int, s string").withColumn("ts", F.col("s").cast("timestamp_ntz"))
    got = {x["id"]: str(x["session"]) for x in sessions.map_intraday(events, days, "ts").collect()}
    assert got == {1: "2024-01-02", 2: "2024-01-03", 3: "2024-01-08", 4: "None", 5: "None"}


def test_known_values(spark):
    assert abs(stats.mcnemar_p(124, 95) - 0.0582343) < 1e-6
    p = [0.0507417, 0.6893408, 0.3025052, 0.0217257]
    got = stats.adjusted(spark.createDataFrame([(x,) for x in p], "p double")).collect()
    want = dict(zip(p, [0.1014834, 0.6893408, 0.4033402, 0.0869030], strict=True))
    assert all(abs(x["bh"] - want[x["p"]]) < 1e-6 for x in got)


def test_normalized_and_hosts(spark):
    row = spark.range(1).select(T.normalized(F.lit("  Él-an  X_1! ")).alias("n"), T.normalized(F.lit(None)).alias("e"), T.host(F.lit("https://www.A.example.com./x")).alias("h")).first()
    assert (row["n"], row["e"], row["h"]) == ("él an x_1", "", "a.example.com")
    assert spark.range(1).select(T.host_matches(F.lit("notexample.com"), ["example.com"])).first()[0] is False
    assert spark.range(1).select(T.host_matches(F.lit("a.example.com"), ["Example.COM"])).first()[0] is True


def test_lexicon_patterns_and_lookups_agree(spark):
    words, r = ["good", "it's", "up"], random.Random(4)
    texts = ["".join(r.choice(["good", "it's", "up", " ", "-", "GOOD", "upx", "'", "bad"]) for _ in range(r.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    long_ = words + [f"zzz{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}" for k in range(100)]
    got = df.select("t", T.lexicon_score(F.col("t"), words, ["bad"]).alias("x"), T.lexicon_score(F.col("t"), long_, ["bad"]).alias("y")).collect()
    for row in got:
        found = re.findall(r"[a-z']+", (row["t"] or "").lower())
        p, n = sum(w in words for w in found), sum(w == "bad" for w in found)
        want = (p - n) / (p + n) if p + n else 0.0
        assert abs(row["x"] - want) < 1e-6 and row["x"] == row["y"]


def test_stamps_have_one_form(spark):
    stamps = ["2024-01-02 03:04:05 UTC", "2024-01-02", "2024-01-02 UTC", "2024-01-02 00:00:00", "2024-13-02 00:00:00 UTC", None, "body text"]
    raw = spark.createDataFrame([(s, "a", "x,y", "https://www.example.com/1") for s in stamps], "stamp string, text string, tickers string, url string")
    got = [r["reason"] for r in news.flagged(raw, ["EXAMPLE.com"]).collect()]
    assert got == [None] + ["bad_stamp"] * 6


def test_mapping_with_the_session_before(spark):
    days = sessions.calendar(spark, "2024-01-04", "2024-01-09")
    rows = [(1, "2024-01-03 10:00:00"), (2, "2024-01-02 10:00:00"), (3, "2024-01-04 10:00:00"), (4, "2024-01-09 00:00:00")]
    events = spark.createDataFrame(rows, "id int, s string").withColumn("ts", F.col("s").cast("timestamp_ntz"))
    told = {x["id"]: str(x["session"]) for x in sessions.map_dates(events, days, "ts", prior="2024-01-03").collect()}
    assert told == {1: "2024-01-04", 2: "None", 3: "2024-01-05", 4: "None"}
    same = {x["id"]: str(x["session"]) for x in sessions.map_dates(events, days, "ts", defer=False).collect()}
    assert same == {1: "None", 2: "None", 3: "2024-01-04", 4: "2024-01-09"}
    with pytest.raises(ValueError):
        sessions.trading_calendar(spark, "2024-01-01", "2024-02-01", None)
    with pytest.raises(ValueError):
        sessions.require_same_sessions(days.where("pos <> 1"), days)
    sessions.require_same_sessions(days, days)
