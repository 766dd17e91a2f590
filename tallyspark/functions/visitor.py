"""What is known of who made a request, as columns."""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that crawlers have in their user agents.
CRAWLER_WORDS = ("bot", "crawl", "spider", "slurp", "archiver", "fetcher", "scrape", "curl/", "wget/", "python-requests", "headless")

CrawlerTest = Callable[[Column], Column]


def is_crawler(user_agent: Column) -> Column:
    """Whether a user agent names a crawler; null doesn't."""
    return F.coalesce(user_agent.rlike("(?i)" + "|".join(CRAWLER_WORDS)), F.lit(False))


def do_not_track(header: Column) -> Column:
    """Whether a do-not-track header, as text, begins with the number 1 and nothing more."""
    return F.coalesce(F.regexp_extract(header, r"^\s*\+?0*(\d+)", 1) == "1", F.lit(False))


def visitor_id(visitor: Column, *seed: Column) -> Column:
    """The visitor's own id, else 80 characters that follow from the seed columns alone, so a rerun gives the same."""
    told_apart = [F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")) for c in seed]
    made = F.substring(F.concat(F.sha2(F.concat_ws("|", *told_apart), 256), F.sha2(F.concat_ws("|", *told_apart, F.lit("+")), 256)), 1, 80)
    return F.coalesce(visitor, made)


def new_visitor_id() -> str:
    """80 random characters for a visitor that has none yet."""
    return secrets.token_hex(40)


def names_crawler(user_agent: str | None) -> bool:
    """The same as is_crawler() for one request at hand."""
    return bool(user_agent) and bool(re.search("|".join(map(re.escape, CRAWLER_WORDS)), user_agent, re.IGNORECASE))


def asks_not_to_track(header: object) -> bool:
    """The same as do_not_track() for one request at hand; a boolean counts as what it says."""
    if isinstance(header, bool):
        return header
    found = re.match(r"\s*\+?0*(\d+)", str(header)) if header is not None else None
    return bool(found) and found[1] == "1"
