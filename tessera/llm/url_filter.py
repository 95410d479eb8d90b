"""URL filter: allow and block rules first, then a list of canonical URLs.

The list is met in two steps. A blocked Bloom filter of the listed canonical URLs (blocks of eight
32-bit words, one bit a word) lets through all listed URLs and a small share of the others; those
possible hits alone go to an exact hash join with the list, which removes the false ones.
Everything is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, cut

#: Odd multipliers, one a word, that place the bit of a hash in that word.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
BITS_PER_URL = 12
#: A filter or list of at most this many bytes is broadcast; beyond, it is joined by key.
BROADCAST_BYTES = 8 << 20
#: Copies of the list in the keyed join, over which the rows of a hot URL are dealt.
SALT = 16
#: Rules become one CASE expression; more than this many are refused.
MAX_RULES = 2000

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first :// and path up to ? or #. Null or no ://: both empty."""
    part = lambda i: F.coalesce(F.regexp_extract(url, PARTS, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def canonical(url: Column) -> Column:
    """host + path without scheme, query, fragment and slashes at the end; null for null or no ://."""
    host, path = host_path(url)
    return F.when(url.contains("://"), F.concat(host, F.regexp_replace(path, "/+$", "")))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; both null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Of rules of equal
    length the one with the longer host wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are taken, put the rest in the list")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rhost, rpath in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        if what not in ("allow", "block"):
            raise ValueError(f"verdict {what!r}")
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(rpath)
        rule, verdict = F.when(fits, F.lit(rhost + rpath)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _block_and_bits(canon: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(canon)
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))
    bit = [F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in SALTS]
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bit]
    return F.pmod(F.shiftrightunsigned(h, 33), F.lit(n_blocks)), masks


def bloom(listed: DataFrame, n_listed: int) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of listed.canon as rows (block, w0..w7), and its number of blocks."""
    n_blocks = max(1, -(-n_listed * BITS_PER_URL // (32 * len(SALTS))))
    block, masks = _block_and_bits(F.col("canon"), n_blocks)
    rows = listed.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(SALTS))]), n_blocks


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", default: str = "allow", on_list: str = "block") -> DataFrame:
    """All rows and columns of pages with host, path, canon, rule, possible, listed and verdict.

    verdict: of the longest fitting rule, else on_list if the canonical URL is in the list, else
    default. possible: the Bloom filter let the URL through; listed: the exact join confirmed it.
    listed holds one string column of URLs (their canonical forms are taken; nulls and repeats are
    ignored). A null URL or one without :// has empty host and path, is not listed and gets default.
    Repeated rows stay repeated; columns of pages with the names above are replaced.
    """
    new = ("host", "path", "canon", "rule", "possible", "listed", "verdict")
    host, path = host_path(F.col(url))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in new or c == url]).alias("row"), host.alias("host"), path.alias("path"), canonical(F.col(url)).alias("canon"))
    listed = cut(listed.select(canonical(F.col(f"`{listed.columns[0]}`")).alias("canon")).where("canon is not null").distinct(), "url-list")
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("canon") + 32), F.lit(0)).alias("b")).first()
    filt, n_blocks = bloom(listed, size.n)
    block, masks = _block_and_bits(F.col("canon"), n_blocks)
    rows = rows.withColumn("block", F.when(F.col("canon").isNotNull(), block).otherwise(-1 - F.pmod(F.xxhash64("row"), F.lit(4096))))
    on = ["block"]
    if n_blocks * 72 <= BROADCAST_BYTES:
        filt = F.broadcast(filt)
    else:  # the rows of a hot URL, all of one block, are dealt over SALT partitions
        on.append("salt")
        filt = filt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int"))
    hit = F.lit(True)
    for i, m in enumerate(masks):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) != 0)
    rows = rows.join(filt, on, "left").select("row", "host", "path", "canon", F.coalesce(hit, F.lit(False)).alias("possible"))
    exact = listed.withColumn("listed", F.lit(True))
    if size.b <= BROADCAST_BYTES:
        rows = rows.withColumn("key", F.when(F.col("possible"), F.col("canon")))
        rows = rows.join(F.broadcast(exact.withColumnRenamed("canon", "key")), "key", "left").drop("key")
    else:  # only possible hits are dealt by key, a hot URL over SALT partitions
        copies = exact.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hits = rows.where("possible").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int"))
        rows = hits.join(copies, ["canon", "salt"], "left").drop("salt").unionByName(rows.where("not possible").withColumn("listed", F.lit(None).cast("boolean")))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    found = F.coalesce(F.col("listed"), F.lit(False))
    return rows.select(
        "row.*", "host", "path", "canon", rule.alias("rule"), "possible", found.alias("listed"),
        F.coalesce(verdict, F.when(found, F.lit(on_list)).otherwise(F.lit(default))).alias("verdict"),
    )
