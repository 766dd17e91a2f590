"""Settings of an engine; the defaults suit a table named views."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    table_name: str = "views"  # the folder of the table, see Engine.at()
    connection: str = "spark"
    database: str = "default"
    cache_key: str = "tallyspark.cache"
    cooldown_key: str = "tallyspark.cooldowns"
    ignore_bots: bool = True
    honor_dnt: bool = False
    visitor_cookie_key: str = "tallyspark"
    visitor_cookie_minutes: int = 2_628_000  # five years of 365 days
    ignored_ip_addresses: tuple[str, ...] = ()
