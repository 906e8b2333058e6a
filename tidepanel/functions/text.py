"""Text expressions: normalization, hosts, tokens, lexicon scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of what normalization makes one blank: white space and all that is no letter, number or underscore.
BETWEEN = r"[^\p{L}\p{N}_]+"
#: What a host is in an address, and the form of an identity's stamp.
HOST, STAMP = r"https?://(?:www\.)?([^/]+)", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
#: Words up to which a lexicon is one pattern.
PATTERN_WORDS = 64


def normalized(text: Column) -> Column:
    """Lower case, punctuation to blanks, one blank between words; null gives an empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BETWEEN, " "))


def host(url: Column) -> Column:
    found = F.regexp_extract(url, HOST, 1)
    return F.when(found != "", F.lower(F.rtrim(found, F.lit("."))))


def host_matches(name: Column, domains: list[str]) -> Column:
    """Exactly a domain, or a true subdomain of one."""
    hit = F.lit(False)
    for d in map(str.lower, domains):
        hit = hit | (name == d) | name.endswith(f".{d}")
    return F.coalesce(hit, F.lit(False))


def identity(text_norm: Column, ts: Column) -> Column:
    return F.sha1(F.concat(text_norm, F.lit("|"), F.date_format(ts, STAMP)))


def token_set(text_norm: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(text_norm, " "), lambda t: t != "")))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set's size; 0 when either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def _hits(lower: Column, words: list[str]) -> Column:
    """How often any of the words stands among the [a-z']+ tokens. A short list is one pattern; a long one is looked up token by token."""
    if not words:
        return F.lit(0.0)
    if len(words) <= PATTERN_WORDS:
        return F.regexp_count(lower, F.lit(f"(?<![a-z'])(?:{'|'.join(sorted(words))})(?![a-z'])")).cast("double")
    own = F.array(*map(F.lit, sorted(words)))
    return F.size(F.filter(F.regexp_extract_all(lower, F.lit("([a-z']+)"), 1), lambda t: F.array_contains(own, t))).cast("double")


def lexicon_score(text: Column, positive: list[str], negative: list[str]) -> Column:
    """(positive - negative) / (positive + negative) hits among [a-z']+ tokens, 0 without a hit, as float."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    pos, neg = _hits(lower, positive), _hits(lower, negative)
    return F.coalesce((pos - neg) / F.nullif(pos + neg, F.lit(0.0)), F.lit(0.0)).cast("float")


def source_name(url: Column, names: list[tuple[str, str]]) -> Column:
    """The first name whose part is in the address; else its host; `(no url)` without one."""
    out = F.coalesce(host(url), F.lit("(no url)"))
    for part, name in reversed(names):
        out = F.when(F.contains(F.lower(url), F.lit(part)), name).otherwise(out)
    return out


def clock(minute: Column) -> Column:
    """A minute of the day as HH:MM."""
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))


def is_digest(value: Column) -> Column:
    """64 lower-case hexadecimal digits."""
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))
