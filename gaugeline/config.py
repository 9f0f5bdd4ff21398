"""Settings, with the defaults of a small deployment."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


def positive_int(raw: str | None, fallback: int) -> int:
    """The whole number that a setting's text begins with, if it is above 0, or else the fallback."""
    found = re.match(r"\s*\+?([0-9]+)", raw or "")
    return int(found[1]) if found and int(found[1]) > 0 else fallback


@dataclass(frozen=True)
class Settings:
    vendor: str = "vendor"  # prefix of the collector's own attribute keys
    server_limit: int = 300  # requests a minute and key
    client_limit: int = 120
    relay_limit: int = 120  # a minute and address
    body_bytes: int = 1 << 20
    relay_bytes: int = 64 << 10
    sink_attempts: int = 12
    sink_batches: int = 1000
    sink_mb: int = 64
    retention_days: dict = field(default_factory=lambda: {"error_occurrences": 14, "spans": 7, "metrics_1m": 90, "llm_calls": 90})

    @classmethod
    def of(cls, env: dict[str, str]) -> Settings:
        d = cls()
        days = {t: positive_int(env.get(f"{t.upper()}_TTL_DAYS"), n) for t, n in d.retention_days.items()}
        return cls(env.get("VENDOR", d.vendor), positive_int(env.get("SERVER_RATE_LIMIT"), d.server_limit), positive_int(env.get("CLIENT_RATE_LIMIT"), d.client_limit), positive_int(env.get("RELAY_RATE_LIMIT"), d.relay_limit), positive_int(env.get("MAX_BODY_BYTES"), d.body_bytes), d.relay_bytes, positive_int(env.get("SINK_MAX_ATTEMPTS"), d.sink_attempts), positive_int(env.get("SINK_MAX_BATCHES"), d.sink_batches), positive_int(env.get("SINK_MAX_MB"), d.sink_mb), days)
