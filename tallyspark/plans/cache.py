"""Keys and a store for counts that are remembered for a while. Nothing that is recorded or removed clears them."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from datetime import datetime, timedelta

from tallyspark.config import EngineConfig
from tallyspark.functions import period as periods
from tallyspark.functions.period import Period
from tallyspark.operators.scopes import counts_as_given


def slug(text: str) -> str:
    """Lower-case letters and digits, words joined by hyphens; other signs are dropped."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    kept = re.sub(r"[^a-z0-9\s_-]", "", plain)
    return re.sub(r"[\s_-]+", "-", kept).strip("-")


def type_slug(text: str) -> str:
    """slug() of a type, and a mark of the whole name where the slug leaves out more than case: so no two types share a key."""
    plain = slug(text)
    return plain if text.lower() == plain else f"{plain}~{hashlib.sha256(text.lower().encode()).hexdigest()[:16]}"


def period_slug(period: Period | None) -> str:
    """A relative period goes by its name, not its bounds, so that its count is found again as time passes."""
    if period is None:
        return "|"
    if period.relative:
        kind, n, unit = period.relative
        return f"{kind}{n}{unit}|"
    start, end = period.start_seconds(), period.end_seconds()
    return f"{'' if start is None else start}|{'' if end is None else end}"


def cache_key(
    config: EngineConfig, table: str, viewable_type: str, viewable_id: object = None, *, period: Period | None = None, unique: bool = False,
    collection: str | None = None,
) -> str:
    parts = [f"{config.cache_key}:{config.connection}:{config.database}:", "type." if viewable_id is None else "", f"{slug(table)}:{type_slug(viewable_type)}."]
    parts += [f"{viewable_id}." if viewable_id is not None else "", period_slug(period), ".unique" if unique else ".normal"]
    return "".join(parts) + (f".{collection}" if counts_as_given(collection) else "")


def until(lifetime: object, now: datetime) -> datetime:
    """When a lifetime ends: minutes from now, a duration from now, or the time itself."""
    if isinstance(lifetime, bool) or not isinstance(lifetime, (int, timedelta, datetime)):
        raise ValueError(f"a lifetime is minutes, a timedelta or a datetime, not {lifetime!r}")
    if isinstance(lifetime, datetime):
        return lifetime
    return now + (lifetime if isinstance(lifetime, timedelta) else timedelta(minutes=lifetime))


class CountCache:
    """Counts by key, each until its time. Any object with get(key) and put(key, count, until) can stand in."""

    def __init__(self, clock: Callable[[], datetime] | None = None):
        self.clock, self.held, self.sweep_at = clock or (lambda: periods.now()), {}, 1024

    def get(self, key: str) -> int | None:
        count, end = self.held.get(key, (None, None))
        if end is not None and end <= self.clock():
            del self.held[key]
            return None
        return count

    def put(self, key: str, count: int, end: datetime) -> None:
        """Keeps a count; now and then what has ended meanwhile goes, asked for or not."""
        if len(self.held) >= self.sweep_at:
            now = self.clock()
            self.held = {k: v for k, v in self.held.items() if v[1] > now}
            self.sweep_at = max(1024, 2 * len(self.held))
        self.held[key] = (int(count), end)
