"""Operator 2, URL filters: a blocked Bloom filter before an exact hash join, native.

Listed URLs are made canonical and set bits in the filter: a URL picks one block and
sets bits inside that block only, so a block is one row of eight 64-bit words made by
bit_or.  The number of blocks follows the list's, `keys_per_block` to each, up to
`most_blocks` of 72 bytes, which bounds what is broadcast; a list too long for that makes
more false hits and no wrong result, as possible hits go on to an exact hash join on the
canonical URL.  URLs that miss the filter never reach that join.

Rules (host, path) come before the list: a rule fits its host and all subdomains if the
path starts with the rule's; the longest wins (then the longer host, then the name).
They are configuration, and become one expression.

Defined results: a null URL or one without :// has an empty host and path, is never
listed and is allowed unless a rule fits; null entries of the list are ignored and
repeated ones count once; repeated pages are judged one by one; an empty list allows all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.shared import columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only track where a visit came from.
TRACKING = r"(?:utm_[a-z]+|ref|gclid|fbclid|sessionid)=[^&]*"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or a default port, path without a last /, and the query without
    tracking parameters; the scheme and the fragment go. Null if there is no ://."""
    host = F.regexp_replace(host_of(url), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(?:^|&)" + TRACKING, ""), "^&", "")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def mask(key: Column, words: int = 8) -> list[Column]:
    """The bits of a key in its block: one in each word, from 6 bits of a second hash."""
    h = F.xxhash64(key, F.lit(2))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(words)]


def bloom_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7) for the distinct keys; blocks without a bit have no row."""
    bits = listed.select(block_of(F.col(key), blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(mask(F.col(key)))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)))


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", keys_per_block: int = 32, most_blocks: int = 1 << 18) -> DataFrame:
    """rules: (host, path, allow or block). Returns page_id, host, path, rule, verdict,
    canonical, possible (passed the filter), listed."""
    keys = columns(listed, url=listed_col).select(canonical(F.col("url")).alias("listed_url")).where("listed_url is not null").distinct()
    blocks = max(1, min(most_blocks, -(-keys.count() // keys_per_block)))
    url = F.col("url")
    rows = columns(pages, page_id=id_col, url=url_col).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    bits = F.broadcast(bloom_filter(keys, "listed_url", blocks))  # at most `most_blocks` rows of 72 bytes
    key = F.col("canonical")
    hit = F.lit(True)
    for i, m in enumerate(mask(key)):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    rows = rows.withColumn("at", F.when(key.isNotNull(), block_of(key, blocks))).join(bits, F.col("at") == F.col("block"), "left").withColumn("possible", F.coalesce(hit, F.lit(False))).select("page_id", "host", "path", "canonical", "possible")
    # Only possible hits are joined; misses would meet in one partition as null keys.
    hits = rows.where("possible").join(keys.withColumn("listed", F.lit(True)), key == F.col("listed_url"), "left").drop("listed_url")
    out = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(rows.where("not possible").withColumn("listed", F.lit(False)))
    fits = [(len(h) + len(p), len(h), f"{h}{p}", a, ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))) for h, p, a in rules]
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for _, _, name, action, when in sorted(fits, key=lambda f: f[:3]):  # the last that fits is the longest
        rule, verdict = F.when(when, F.lit(name)).otherwise(rule), F.when(when, F.lit(action)).otherwise(verdict)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise("allow")).alias("verdict"), "canonical", "possible", "listed")
