"""URL rules, and beyond them exact membership in a list of hosts by a cascade of Bloom filters; SQL functions only.

Level 0 of the cascade encodes the listed keys; each further level encodes those keys of the other kind that the level
before lets through by mistake, over the complete universe of keys, until none is left. A key's kind then follows from
the first level that doesn't hold it: no join, and no mistake for any key of the universe.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import shared
from tallyspark.llm.bloom import Bloom

#: (verdict, host, path) of the query; the longest rule that fits decides.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Hosts of the query's list: a part of the name, between dots and hyphens, is one of these words.
LISTED_WORDS = ("cheap", "pills", "casino", "viagra", "replica", "lottery", "xxx", "warez")
#: A level takes so many bits at most: the hosts are split by hash into as many cascades as that takes, used one after another.
LEVEL_BITS = 1 << 28
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits the host or one above it and the beginning of the path; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


class Cascade:
    """Exact membership of any key of a universe in a list."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @classmethod
    def fit(cls, universe: DataFrame, key: str, listed: str, max_levels: int = 60) -> Cascade | None:
        """universe: one row per key with a boolean column listed. None if the first level would take more than LEVEL_BITS."""
        inside = universe.where(F.col(listed)).select(key)
        outside = universe.where(~F.col(listed)).select(key)
        inside, outside = shared.stored(inside, "cascade-in"), shared.stored(outside, "cascade-out")
        n_in, n_out, levels = inside.count(), outside.count(), []
        while n_in:
            if len(levels) == max_levels:
                raise RuntimeError("the cascade has not settled")
            # the first level lets about as many others through as there are listed keys; further ones halve
            rate = min(0.5, n_in / (math.sqrt(2) * n_out)) if not levels and n_out else 0.5
            hashes = max(1, round(-math.log2(rate)))
            n_bits = math.ceil(n_in * hashes / math.log(2)) + 64
            if n_bits > LEVEL_BITS and not levels:
                return None
            levels.append(Bloom(inside, key, n_bits, hashes, seed=len(levels) + 1))
            if not n_out:
                break
            mistaken = shared.stored(outside.where(levels[-1].holds(F.col(key))), "cascade-level")
            inside, outside = mistaken, inside
            n_in, n_out = mistaken.count(), n_in
        return cls(levels)

    def holds(self, key: Column) -> Column:
        found = F.lit(bool(self.levels) and len(self.levels) % 2 == 1)
        for k, level in reversed(list(enumerate(self.levels))):
            found = F.when(~level.holds(key), F.lit(k % 2 == 1)).otherwise(found)
        return found


def _shard(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(n))


def cascades(universe: DataFrame, key: str, listed: str) -> list[Cascade]:
    """One cascade for each of a number of shards of the keys, doubled until every first level keeps to LEVEL_BITS."""
    n = 1
    while True:
        found = []
        for k in range(n):
            cascade = Cascade.fit(universe if n == 1 else universe.where(_shard(F.col(key), n) == k), key, listed)
            if cascade is None:
                break
            found.append(cascade)
        else:
            return found
        n *= 2


def filter_urls(pages: DataFrame, listed: DataFrame, *, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule and verdict in place of columns of these names, whatever their case.

    listed: the hosts of the list, in its first column; hosts of no page, repeated ones and nulls do nothing. Where no rule
    fits, listed hosts are blocked. Membership is settled once per distinct host of the pages; with more than one shard of
    hosts pages are read once for each. A null url, or one without ://, has an empty host and path and is judged by them;
    repeated rows are judged alike; an empty table gives an empty one.
    """
    names = ("host", "path", "rule", "verdict")
    rest = [c for c in pages.columns if c.lower() not in names]
    found, member, own_host = shared.unused(pages.columns, "__found", "__member", "__host")
    own = pages.select(*[F.col(c) for c in rest], host(F.col(url_col)).alias(own_host), path(F.col(url_col)).alias("path"))
    hosts = own.select(F.col(own_host).alias("host")).distinct()
    inside = listed.select(F.col(listed.columns[0]).cast("string").alias("host")).where("host is not null").distinct().withColumn("listed", F.lit(True))
    universe = shared.stored(hosts.join(inside, "host", "left").select("host", F.coalesce("listed", F.lit(False)).alias("listed")), "hosts")
    shards, out = cascades(universe, "host", "listed"), None
    for k, cascade in enumerate(shards):
        some = own if len(shards) == 1 else own.where(_shard(F.col(own_host), len(shards)) == k)
        judged = some.select(*rest, F.col(own_host).alias("host"), "path", decide(F.col(own_host), F.col("path"), rules).alias(found), cascade.holds(F.col(own_host)).alias(member))
        by_list = F.when(F.col(member), "block").otherwise("allow")
        part = judged.select(*rest, "host", "path", F.col(f"{found}.rule").alias("rule"), F.coalesce(f"{found}.verdict", by_list).alias("verdict"))
        out = part if out is None else out.union(part)
    return out


def listed_hosts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The query's list: the hosts of the pages that LISTED_WORDS name."""
    return pages.select(host(F.col(url_col)).alias("host")).distinct().where(F.col("host").rlike(_listed_pattern()))


def _listed_pattern() -> str:
    return "(^|[.-])(" + "|".join(map(re.escape, LISTED_WORDS)) + ")([.-]|$)"


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's url by RULES, else by the list of hosts that LISTED_WORDS name; odd rows as filter_urls() says."""
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, listed_hosts(pages)).select("page_id", "host", "path", "rule", "verdict")


def op10_sql() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + f" WHEN regexp_matches(host, '{_listed_pattern()}') THEN 'block' ELSE 'allow' END"
    return f"""
        WITH cut AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_UPPER.lower()}') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages)
        SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM cut"""
