"""Url filters: a blocked Bloom filter lets possible hits pass to an exact join with the list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block of the filter is eight longs; a key sets one bit in each. So many bits of the filter stand for a key.
LONGS, BITS_PER_KEY = 8, 16
#: Bytes up to which the filter is broadcast. A larger one is joined by block.
MOST_BROADCAST = 32 << 20

#: The rules of the query: (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of a url.

    The host goes from the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path
    from there to ``?``, ``#`` or the end. All are empty for null and for a url without ``://``.
    """
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path, query


def canonical(url: Column) -> Column:
    """The form in which urls are listed: host without ``www.``, path without a last slash, and the query without ``utm_`` parameters, in order.

    Schemes and fragments don't count. A url without ``://`` has the empty form, which is never listed.
    """
    host, path, query = parts(url)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    form = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))
    return F.when(host == "", F.lit("")).otherwise(F.concat(form, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))))


def _bits(key: Column) -> list[Column]:
    """The bit of ``key`` in each long of its block: six bits of a hash for each."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 7 * k).bitwiseAND(63).cast("int")) for k in range(LONGS)]


def bloom_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the blocks of a Bloom filter of all keys, by partial aggregation."""
    bits = listed.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(_bits(F.col(key)))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(LONGS)])


def possible_hits(rows: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    """The rows of ``rows`` whose ``key`` the Bloom filter of ``listed`` lets pass: all that are listed and a few more."""
    n = listed.count()
    blocks = max(1, -(-n * BITS_PER_KEY // (64 * LONGS)))
    table = bloom_filter(listed, listed_key, blocks)
    if blocks * 8 * (LONGS + 1) <= MOST_BROADCAST:
        table = F.broadcast(table)
    names = [*rows.columns]
    probe = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    met = probe.join(table.select(F.col("block").alias("_block"), *[F.col(f"w{k}").alias(f"_w{k}") for k in range(LONGS)]), "_block")
    for k, bit in enumerate(_bits(F.col(key))):
        met = met.where(F.col(f"_w{k}").bitwiseAND(bit) != 0)
    return met.select(*names)


def listed_rows(rows: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    """The rows of ``rows`` whose key is in ``listed``: those that pass the filter, joined exactly with the list."""
    exact = listed.select(F.col(listed_key).alias(key)).where(F.col(key).isNotNull()).distinct()
    passed = possible_hits(rows.where(F.col(key).isNotNull()), key, exact, key)
    return passed.join(exact, key, "left_semi")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest of ``rules`` that fits, as a struct (rule, action), or null.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest host counts
    first, then the longest path. The rules are a fixed short table, so they are one expression.
    """
    out = None
    for action, of, start in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        value = F.struct(F.lit(of + start).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, is_listed) of every row of ``pages`` (page_id, url).

    ``listed`` has canonical urls to block (column ``canonical``). A rule's action is the verdict where one
    fits; else listed urls are blocked and others allowed. Lookups are made once for each distinct canonical
    url, so that a url that many rows share is no hot key. Null urls have an empty host and path and are
    allowed; repeated rows come back repeated; other columns are ignored; null and empty listed urls count as
    absent.
    """
    host, path, _ = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical"))
    own = listed.select("canonical").where("canonical <> ''")
    hits = listed_rows(rows.select("canonical").where("canonical <> ''").distinct(), "canonical", own, "canonical")
    out = rows.join(hits.withColumn("is_listed", F.lit(True)), "canonical", "left").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", method).alias("verdict"), F.coalesce("is_listed", F.lit(False)).alias("is_listed"))
