"""Exact and near duplicates of timestamped texts: keep flags, who eliminated whom, clusters, article groups.

Rows are (id, ts, text_norm); time order is (ts, id), and a window is ``days`` whole days of 24 hours, its end included. Rows with an
empty text have no tokens: the exact pass treats them as one text, the near pass leaves them alone. Texts travel as 128-bit hashes.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions import text as T
from tidepanel.operators import work

WINDOW_DAYS, PERCENT = 3, 90
#: Distinct stamps of a text up to which its window is folded in one array; beyond, successors are followed by doubling.
FOLD = 10_000
#: Tokens from which on a set has the hashes of three parts instead of all with one token left out.
LONG = 64


def _window(days: int):
    return F.expr(f"INTERVAL '{days}' DAY")


def _hashed(rows: DataFrame):
    return rows.select("id", "ts", F.unhex(F.md5(F.col("text_norm").cast("binary"))).alias("hash"))


def anchors(stamps: DataFrame, days: int = WINDOW_DAYS, fold: int = FOLD) -> DataFrame:
    """Distinct (hash, ts, first) to the kept ones: the first of a text, and each more than ``days`` after the kept one before it."""
    sizes = stamps.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    few = stamps.join(sizes.where(F.col("n") <= fold).select("hash"), "hash")
    by_text = few.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("ts", "first"))).alias("all"))
    kind = by_text.schema["all"].dataType.simpleString()
    kept = F.aggregate(
        "all", F.expr(f"CAST(array() AS {kind})"),
        lambda done, x: F.when((F.size(done) == 0) | (x["ts"] > F.element_at(done, -1)["ts"] + _window(days)), F.concat(done, F.array(x))).otherwise(done),
    )
    short = by_text.select("hash", F.inline(kept))
    hot = work.saved(sizes.where(F.col("n") > fold).select("hash"), "frequent-texts")
    if hot.limit(1).count() == 0:
        return short
    return short.unionByName(_followed(work.saved(stamps.join(hot, "hash"), "frequent-stamps"), days))


def _followed(stamps: DataFrame, days: int) -> DataFrame:
    """The same for texts of any number of stamps: each stamp's successor is found within a day of a text, and chains by doubling."""
    dated = stamps.select("hash", "ts", F.to_date("ts").alias("day"))
    later = W.partitionBy("hash").orderBy("day").rowsBetween(1, W.unboundedFollowing)  # a row a day
    daily = dated.groupBy("hash", "day").agg(F.min("ts").alias("first_ts"))
    asked = dated.select("hash", (F.col("ts") + _window(days)).alias("ts"), F.col("ts").alias("of"))
    asked = asked.withColumn("day", F.to_date("ts"))
    # Within the day: the first stamp after the asked one.
    both = dated.withColumn("of", F.lit(None).cast(asked.schema["of"].dataType)).unionByName(asked)
    ahead = W.partitionBy("hash", "day").orderBy(F.col("ts").asc(), F.col("of").asc_nulls_first()).rowsBetween(1, W.unboundedFollowing)
    inside = both.withColumn("next", F.min(F.when(F.col("of").isNull(), F.col("ts"))).over(ahead)).where(F.col("of").isNotNull())
    # Else the first stamp of the next day that has any; days without one take part as questions.
    days_of = daily.unionByName(asked.select("hash", "day").distinct(), allowMissingColumns=True).groupBy("hash", "day").agg(F.min("first_ts").alias("first_ts"))
    after = days_of.select("hash", "day", F.min("first_ts").over(later).alias("later"))
    jump = inside.join(after, ["hash", "day"]).select("hash", F.col("of").alias("ts"), F.coalesce("next", "later").alias("to")).where(F.col("to").isNotNull())
    jump = work.saved(jump, "successors")
    reached = work.saved(stamps.groupBy("hash").agg(F.min("ts").alias("ts")), "reached")
    while True:
        more = reached.join(jump, ["hash", "ts"]).select("hash", F.col("to").alias("ts"))
        new = work.saved(reached.unionByName(more).distinct(), "reached")
        if new.count() == reached.count():
            return stamps.join(new, ["hash", "ts"]).select("hash", "ts", "first")
        reached = new
        on = jump.select("hash", F.col("ts").alias("to"), F.col("to").alias("further"))
        jump = work.saved(jump.join(on, ["hash", "to"]).select("hash", "ts", F.col("further").alias("to")), "successors")


def exact(rows: DataFrame, days: int = WINDOW_DAYS, fold: int = FOLD) -> DataFrame:
    """rows(id, ts, text_norm, ...) with anchor and kept: a row at most ``days`` after the last kept row of its text is dropped."""
    hashed = _hashed(rows)
    kept = anchors(hashed.groupBy("hash", "ts").agg(F.min("id").alias("first")), days, fold)
    # A row's anchor is at most the window older, so the days of the window make it an equi-join.
    reach = kept.select("hash", F.col("ts").alias("since"), F.col("first").alias("anchor"), F.explode(F.sequence(F.to_date("ts"), F.date_add(F.to_date("ts"), days))).alias("day"))
    whole = rows.withColumns({"hash": F.unhex(F.md5(F.col("text_norm").cast("binary"))), "day": F.to_date("ts")})
    met = whole.join(reach, ["hash", "day"]).where((F.col("ts") >= F.col("since")) & (F.col("ts") <= F.col("since") + _window(days)))
    return met.drop("hash", "day", "since").withColumn("kept", F.col("id") == F.col("anchor"))


def signatures(sets: DataFrame) -> DataFrame:
    """Long hashes of which any two sets that differ by at most one token on either side share at least one.

    Short sets: the exclusive or of all token hashes, whole and with each left out. Long ones: that of each of three parts by hash, for two
    different tokens leave one part alone; sets of ``LONG`` tokens have both.
    """
    whole = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.xxhash64(t)))
    short = F.concat(F.array("whole"), F.when(F.size("tokens") > 1, F.transform("tokens", lambda t: F.col("whole").bitwiseXOR(F.xxhash64(t)))).otherwise(F.array().cast("array<bigint>")))
    part = lambda p: F.xxhash64(F.lit(p), F.aggregate(F.filter("tokens", lambda t: F.pmod(F.xxhash64(t, F.lit(7)), F.lit(3)) == p), F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.xxhash64(t))))
    size = F.size("tokens")
    every = F.when(size < LONG, short).when(size > LONG, F.array(*map(part, range(3)))).otherwise(F.concat(short, F.array(*map(part, range(3)))))
    return sets.withColumn("whole", whole).withColumn("sig", F.explode(F.array_distinct(every))).drop("whole")


def near_pairs(rows: DataFrame, percent: int = PERCENT, days: int = WINDOW_DAYS) -> DataFrame:
    """rows(id, ts, text_norm) to (cur, cand, ordinal): cand is earlier within ``days``, differs by at most one token on each side, and overlaps enough.

    ordinal is 0 if all of cur's tokens are in cand, else 1 and the place of the one that is not. Candidates share a signature and
    a span of days; every one is verified, so collisions add work and no pairs.
    """
    sets = work.saved(rows.select("id", "ts", T.token_set(F.col("text_norm")).alias("tokens")).where(F.size("tokens") > 0), "token-sets")
    span = F.floor(F.unix_date(F.to_date("ts")) / (days + 1))
    signed = signatures(sets).select("id", "ts", "sig", span.alias("span"))
    a = signed.select(F.col("id").alias("cur"), F.col("ts").alias("cur_ts"), "sig", F.explode(F.array(F.col("span"), F.col("span") - 1)).alias("span"))
    b = signed.select(F.col("id").alias("cand"), F.col("ts").alias("cand_ts"), "sig", "span")
    earlier = (F.col("cand_ts") < F.col("cur_ts")) | ((F.col("cand_ts") == F.col("cur_ts")) & (F.col("cand") < F.col("cur")))
    pairs = a.join(b, ["sig", "span"]).where(earlier & (F.col("cur_ts") <= F.col("cand_ts") + _window(days))).select("cur", "cand").distinct()
    x, y = (sets.select(F.col("id").alias(n), F.col("tokens").alias(f"{n}_tokens")) for n in ("cur", "cand"))
    met = pairs.join(x, "cur").join(y, "cand").withColumn("shared", F.size(F.array_intersect("cur_tokens", "cand_tokens")))
    close = (F.size("cur_tokens") - F.col("shared") <= 1) & (F.size("cand_tokens") - F.col("shared") <= 1)
    enough = 100 * F.col("shared") >= percent * F.greatest(F.size("cur_tokens"), F.size("cand_tokens"))
    other = F.element_at(F.array_except("cur_tokens", "cand_tokens"), 1)
    ordinal = F.when(F.size("cur_tokens") == F.col("shared"), 0).otherwise(F.array_position("cur_tokens", other).cast("int"))
    return met.where(close & enough).select("cur", "cand", ordinal.alias("ordinal"))


def resolved(pairs: DataFrame) -> DataFrame:
    """(cur, cand, ordinal) to (id, eliminated_by) of the dropped: in time order, a row with a kept earlier partner is dropped.

    A row is dropped once a partner is kept, and kept once all its partners are dropped, so rounds are as many as the longest chain of decisions. Of
    several kept partners the one with the least ordinal counts, then the smallest id of the oldest (ids of candidates are in time order).
    """
    pairs = work.saved(pairs, "pairs")
    curs = pairs.select("cur").distinct()
    kept = work.saved(pairs.select(F.col("cand").alias("id")).distinct().join(curs, F.col("id") == F.col("cur"), "left_anti"), "kept")
    open_, dropped = pairs, None
    while open_.limit(1).count():
        gone = work.saved(open_.join(kept, F.col("cand") == F.col("id"), "left_semi").select(F.col("cur").alias("id")).distinct(), "dropped")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        left = open_.join(gone, F.col("cur") == F.col("id"), "left_anti").join(gone, F.col("cand") == F.col("id"), "left_anti")
        # Rows all of whose partners are gone are kept.
        freed = open_.join(gone, F.col("cur") == F.col("id"), "left_anti").select("cur").distinct().join(left.select("cur").distinct(), "cur", "left_anti")
        kept = work.saved(kept.unionByName(freed.select(F.col("cur").alias("id"))), "kept")
        open_ = work.saved(left, "undecided")
    if dropped is None:
        return pairs.limit(0).select(F.col("cur").alias("id"), F.col("cand").alias("eliminated_by"))
    best = pairs.join(dropped, F.col("cur") == F.col("id"), "left_semi").join(kept, F.col("cand") == F.col("id"), "left_semi")
    return best.groupBy(F.col("cur").alias("id")).agg(F.min(F.struct("ordinal", "cand"))["cand"].alias("eliminated_by"))


def lineage(rows: DataFrame, percent: int = PERCENT, days: int = WINDOW_DAYS) -> DataFrame:
    """rows(id, ts, text_norm) to (id, kept, step, eliminated_by, cluster): the exact pass, then the near pass over its survivors.

    Ids have to be in time order (see ``numbered``). eliminated_by is the immediate step; cluster the kept row at the chain's end, which is at most
    two steps away, for an exact anchor can itself be a near duplicate of a kept row.
    """
    with work.Scratch(rows.sparkSession) as scratch:
        first = work.saved(exact(rows.select("id", "ts", "text_norm"), days).select("id", "ts", "text_norm", "anchor", "kept"), "exact")
        near = work.saved(resolved(near_pairs(first.where("kept").select("id", "ts", "text_norm"), percent, days)), "near")
        own = near.select(F.col("id").alias("anchor"), F.col("eliminated_by").alias("root"))
        step = F.when(~F.col("kept"), "exact").when(F.col("root").isNotNull(), "near")
        found = first.join(own, "anchor", "left").select(
            "id", step.isNull().alias("kept"), step.alias("step"),
            F.when(step == "exact", F.col("anchor")).when(step == "near", F.col("root")).alias("eliminated_by"), F.coalesce("root", "anchor").alias("cluster"),
        )
        out = work.saved(found, "lineage")
        scratch.keep(out)
        return out


def numbered(rows: DataFrame, ts: str = "ts", tie: str = "id") -> DataFrame:
    """rows with source_row_id from 0 in the order (ts, tie): counted by range of the order, so no task numbers all rows."""
    dealt = work.saved(rows.repartitionByRange(F.col(ts), F.col(tie)).sortWithinPartitions(ts, tie).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    before = counts.select(F.col("_part"), "_low", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn("source_row_id", F.col("_before") + F.col("_at") - F.col("_low")).drop("_part", "_at", "_before", "_low")


def clusters(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row a kept row: id, members, tickers (the union over its cluster, sorted)."""
    each = found.join(rows.select("id", "tickers"), "id")
    sizes = each.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    tags = each.select("cluster", F.explode("tickers").alias("t")).distinct().groupBy("cluster").agg(F.array_sort(F.collect_list("t")).alias("tickers"))
    return sizes.join(tags, "cluster", "left").select(F.col("cluster").alias("id"), "members", F.coalesce("tickers", F.array().cast("array<string>")).alias("tickers"))


def statistics(rows: DataFrame, found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Counts of both passes, rows whose chain has two steps, and the share of exact survivors with so many tokens that the near pass can miss their duplicates."""
    length = missable_length(percent)
    tokens = found.where("step IS NULL OR step = 'near'").join(rows.select("id", "text_norm"), "id").select(F.size(T.token_set(F.col("text_norm"))).alias("n"))
    blind = tokens.agg(F.avg((F.col("n") >= length).cast("double")).alias("blind_share"))
    sums = found.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("step") == "exact").alias("exact_dropped"), F.count_if(F.col("step") == "near").alias("near_dropped"),
        F.count_if("kept").alias("kept"), F.count_if((F.col("step") == "exact") & (F.col("eliminated_by") != F.col("cluster"))).alias("two_steps"),
    )
    return sums.join(F.broadcast(blind)).withColumn("missable_length", F.lit(length))


def missable_length(percent: int = PERCENT) -> int:
    """The least number of tokens at which two texts can overlap enough and still differ by two tokens on a side."""
    exact_ = Fraction(2) / (1 - Fraction(percent, 100))
    return -(-exact_.numerator // exact_.denominator)


def article_groups(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """rows(id, text_norm) to (id, group_id): groups linked by equal texts or enough overlap, at any distance in time, numbered from 0 by their smallest id.

    Tokens are ordered by frequency, and sets that overlap enough share one of their first size - needed + 1 tokens, so only those are joined.
    """
    with work.Scratch(rows.sparkSession) as scratch:
        sets = work.saved(rows.select("id", T.token_set(F.col("text_norm")).alias("tokens"), F.unhex(F.md5(F.col("text_norm").cast("binary"))).alias("hash")), "token-sets")
        firsts = work.saved(sets.groupBy("hash").agg(F.min("id").alias("rep")), "representatives")
        reps = sets.join(firsts, F.col("id") == F.col("rep"), "left_semi").select("id", "tokens")
        each = work.saved(reps.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("t")), "tokens")
        often = each.groupBy("t").agg(F.count(F.lit(1)).alias("often"))
        # Overlap is over the larger set, so a set of n shares at least percent of n tokens with any partner.
        spare = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        rank = F.row_number().over(W.partitionBy("id").orderBy("often", "t"))
        prefix = work.saved(each.join(often, "t").withColumn("rank", rank).where(F.col("rank") <= spare).select("id", "n", "t"), "prefixes")
        x, y = prefix.select(F.col("id").alias("a"), F.col("n").alias("an"), "t"), prefix.select(F.col("id").alias("b"), F.col("n").alias("bn"), "t")
        close = (F.col("a") < F.col("b")) & (100 * F.least("an", "bn") >= percent * F.greatest("an", "bn"))
        pairs = x.join(y, "t").where(close).select("a", "b").distinct()
        met = pairs.join(reps.select(F.col("id").alias("a"), F.col("tokens").alias("at")), "a").join(reps.select(F.col("id").alias("b"), F.col("tokens").alias("bt")), "b")
        links = met.where(100 * F.size(F.array_intersect("at", "bt")) >= percent * F.greatest(F.size("at"), F.size("bt"))).select("a", "b")
        named = sets.join(firsts, "hash").select("id", "rep")
        comps = work.components(links).withColumnRenamed("node", "rep")
        grouped = work.saved(named.join(comps, "rep", "left").select("id", F.coalesce("comp", "rep").alias("first")), "groups")
        order = numbered(grouped.where("id = first").select("first"), "first", "first").withColumnRenamed("source_row_id", "group_id")
        out = work.saved(grouped.join(order, "first").select("id", "group_id"), "article-groups")
        scratch.keep(out)
        return out
