"""Secret scans with corpus-wide ownership frequency.

Every text gives base spans (assignments, access keys, long hex runs) and further candidates: bare tokens that look
random. The hash of each candidate's value is counted over the whole corpus by distinct owners and distinct
repositories (an owner's repository). A value that many owners hold, or that many repositories hold even of one owner, is a copied
example; one that few of either hold and that looks random is live-looking. Bare candidates become spans only if they are live-looking; base spans stay
in any case and get their label.

Counting is by (hash, owner, repository) first, so a value that a third of the corpus copies is
pre-aggregated before it meets in one place. Labels return to spans by a join that deals the spans of a frequent value over
salts; only documents with spans take part in it, and each is put together again by a number of its own, so copies of a text never meet in one task.

Defined cases: null text counts as empty and has no spans; a null owner is one owner, a null repository one
repository; rows that repeat have the same spans and count once an (owner, repository); an empty table gives no
rows; other columns are not touched, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import common

KINDS = ("assign", "access", "hex", "bare")
#: Owners, and repositories, from which on a value is a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 10
#: Bits a character that a live-looking value has at least.
LIVE_BITS = 2.5

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDER = re.compile(r"example|changeme|placeholder|your|dummy|sample|x{6,}|0{8,}|1234567", re.I)

SPAN = pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("stop", pa.int32()), ("hash", pa.string()), ("random", pa.bool_())])
SPAN_DDL = "array<struct<kind: tinyint, start: int, stop: int, hash: string, random: boolean>>"


def bits(value: str) -> float:
    """Shannon entropy of the characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in map(value.count, set(value)))


def looks_random(value: str) -> bool:
    return bits(value) >= LIVE_BITS and any(c.isdigit() for c in value) and not PLACEHOLDER.search(value)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, stop, value) by start, then kind. Matches by kind are leftmost and don't overlap."""
    found = []
    if ":" in text or "=" in text:
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def bare_spans(text: str, base: list) -> list[tuple[int, int, int, str]]:
    """Tokens that look random and overlap no base span (which come by start)."""
    starts, furthest = [x[1] for x in base], list(accumulate((x[2] for x in base), max))

    def free(m: re.Match) -> bool:
        before = bisect_left(starts, m.end())
        return not before or furthest[before - 1] <= m.start()

    return [(3, m.start(), m.end(), m[0]) for m in BARE.finditer(text) if free(m) and looks_random(m[0])]


def joined(spans) -> str:
    return ",".join(f"{KINDS[s[0]]}:{s[1]}:{s[2]}" for s in spans)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, counts, digests = [], ([], [], []), []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base = base_spans(text)
            for kind in range(3):
                counts[kind].append(sum(s[0] == kind for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            out.append([
                {"kind": k, "start": a, "stop": b, "hash": hashlib.blake2b(v.encode(), digest_size=16).hexdigest(), "random": k == 3 or looks_random(v)}
                for k, a, b, v in base + bare_spans(text, base)
            ])
        keep = batch.schema.names
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in keep] + [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(out, pa.list_(SPAN))],
            names=[*keep, "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates(hash, owner, repository) to hash, owners, repositories (distinct)."""
    once = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("_n"))
    by_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("_repositories"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("_repositories").alias("repositories"))


FOUND = f"n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found {SPAN_DDL}"
COUNTED = ("n_assign", "n_access", "n_hex", "base_sha256")


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _extract(batches):
        yield batch.drop_columns(["text"])


def labelled(found: DataFrame, keep: list[str], copied_owners: int, copied_repositories: int) -> DataFrame:
    """(Saved) found(owner, repository, found, *keep) with labelled instead: spans in order (start, kind, stop, label, owners, repositories).

    label is copied, live or other; base spans all, bare only if live. Null for rows without spans.
    """
    some = found.where(F.size("found") > 0).select("owner", "repository", "found", *keep).withColumn("at", F.monotonically_increasing_id())
    some = common.saved(some, "with-secrets")
    stats = ownership(some.select(F.explode("found.hash").alias("hash"), "owner", "repository"))
    label = F.when((F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories), "copied")
    stats = common.saved(stats.withColumn("label", label), "ownership")
    spans = common.saved(some.select("at", F.explode("found").alias("s")).select("at", "s.*"), "spans")
    named = common.salted_join(spans, stats, "hash", "at").withColumn("label", F.coalesce("label", F.when(F.col("random"), "live").otherwise("other")))
    kept = named.where((F.col("kind") < 3) | (F.col("label") == "live"))
    own = kept.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "label", "owners", "repositories"))).alias("labelled"))
    with_spans = some.select("at", *keep).join(own, "at", "left").drop("at")
    kind = own.schema["labelled"].dataType
    return found.where(F.size("found") == 0).select(*keep, F.lit(None).cast(kind).alias("labelled")).unionByName(with_spans)


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id",
    copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES,
) -> DataFrame:
    """One row a document: key, n_assign, n_access, n_hex, base_sha256, labelled (see there)."""
    read = docs.select(
        F.col(key).alias("key"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    kind = dict(read.dtypes)["key"]
    with common.Scratch(docs.sparkSession) as scratch:
        thin = common.saved(read.mapInArrow(common.sparing(_thin), f"key {kind}, owner string, repository string, {FOUND}"), "secret-spans")
        out = common.saved(labelled(thin, ["key", *COUNTED], copied_owners, copied_repositories), "secrets")
        scratch.keep(out)
        return out.withColumnRenamed("key", key)


def span_string(labelled) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(labelled, lambda s: F.concat_ws(":", F.element_at(names, (s["kind"] + 1).cast("int")), s["start"], s["stop"]))
    return F.coalesce(F.array_join(each, ","), F.lit(""))


def _only(with_spans: bool):
    """Extraction that gives back the rows with spans, or the rows without (row and text alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _extract(batches):
            some = pc.greater(pc.list_value_length(batch.column("found")), 0)
            if with_spans:
                yield batch.filter(some)
            else:
                yield batch.select(["row", "text"]).filter(pc.invert(some))

    return run


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for value, spans in zip(batch.column("text"), batch.column("labelled"), strict=True):
            text, spans = value.as_py(), spans.as_py()
            if text is not None and spans:
                parts, at = [], 0
                for s in spans:
                    if s["stop"] > at:
                        parts += [text[at : max(at, s["start"])], f"<{s['label']}-secret>" if s["start"] >= at else ""]
                        at = s["stop"]
                text = "".join([*parts, text[at:]])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def redact(
    docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id",
    copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES,
) -> DataFrame:
    """docs with every span replaced by its label; columns and their order stay. Only documents with spans are written and joined."""
    cols = docs.columns
    others = [F.col(f"`{c}`") for c in cols if c != text] or [F.lit(0).alias("none")]
    read = docs.select(
        F.struct(*others).alias("row"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.col(text).alias("text")
    )
    row = read.schema["row"].dataType.simpleString()
    with common.Scratch(docs.sparkSession) as scratch:
        found = common.saved(read.mapInArrow(common.sparing(_only(True)), f"row {row}, owner string, repository string, text string, {FOUND}"), "texts-with-spans")
        both = common.saved(labelled(found, ["row", "text"], copied_owners, copied_repositories), "texts-with-labels")
        scratch.keep(both)
    masked = both.mapInArrow(common.sparing(_mask), f"row {row}, text string")
    # The spans are a function of the text, so the texts without any are found again instead of being written.
    plain = read.mapInArrow(common.sparing(_only(False)), f"row {row}, text string")
    return plain.unionByName(masked).select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in cols])


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    count = lambda label: F.coalesce(F.size(F.filter("labelled", lambda s: s["label"] == label)), F.lit(0)).cast("long")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", span_string(F.col("labelled")).alias("spans"),
        count("live").alias("n_live"), count("copied").alias("n_copied"),
    )
