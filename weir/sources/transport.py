"""Rules by which requests are sent: retries, waiting, rates, keys, names. Pure, so that any transport can use them.

``settled`` applies the retry rule to recorded attempts.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Milliseconds that each further attempt waits longer, seconds that an answer may ask for, and between two requests.
BACKOFF_MS, MOST_WAIT, MOST_INTERVAL = 500, 60, 3600.0
#: Bytes of any response that are read.
RESPONSE_BYTES = 128 << 20


def retryable(status: int | None) -> bool:
    """No answer at all, a server's error, a time-out or too many requests."""
    return status is None or status >= 500 or status in (408, 429)


def retryable_column(status: Column) -> Column:
    return status.isNull() | (status >= 500) | status.isin(408, 429)


def retry_after(header: str | None) -> int | None:
    """Seconds, ``MOST_WAIT`` at most; dates aren't understood."""
    text = (header or "").strip()
    return min(MOST_WAIT, int(text)) if text.isascii() and text.isdigit() else None


def waits(retries: int, headers: tuple[str | None, ...] = ()) -> list[float]:
    """Seconds before each further attempt: longer each time, or what the answer before it asked for."""
    asked = itertools.chain(map(retry_after, headers), itertools.repeat(None))
    return [k * BACKOFF_MS / 1000 if after is None else float(after) for k, after in zip(range(1, retries + 1), asked, strict=False)]


def interval(rate: float | None) -> float:
    """Seconds between two requests at ``rate`` a second; none for rates that make no sense."""
    if rate is None or math.isnan(rate) or rate <= 0:
        return 0.0
    return min(MOST_INTERVAL, 1.0 / rate)


def departures(times: list[float], rate: float | None) -> list[float]:
    """When requests that are ready at ``times`` may leave, one interval after another at least."""
    gap, out, free = interval(rate), [], -math.inf
    for t in sorted(times):
        out.append(max(t, free))
        free = out[-1] + gap
    return out


def rotation(keys: list[str]) -> Iterator[str]:
    """Keys in turn, each but once, one for each attempt; nothing without keys."""
    return itertools.cycle(dict.fromkeys(k for k in map(str.strip, keys) if k))


#: Names that a client gives itself.
POLITE = "weir/0.1"
DESKTOP = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64; rv:133.0) Gecko/20100101 Firefox/133.0",
)
MOBILE = ("Mozilla/5.0 (iPhone; CPU iPhone OS 18_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.1 Mobile/15E148 Safari/604.1",)
DESKTOP_SHARE = 0.65


def user_agent(anyone: bool = False, rng: random.Random | None = None) -> str:
    """Our own name or, for ``anyone``, a browser's: of a desktop in 65 of 100 cases."""
    if not anyone:
        return POLITE
    rng = rng or random.Random()
    return rng.choice(DESKTOP if rng.random() < DESKTOP_SHARE else MOBILE)


@dataclass(frozen=True)
class Client:
    """Settings of one sender; which of them hold depends on the network scope (``for_role``)."""

    timeout: int = 120
    retries: int = 2
    insecure: bool = False
    random_agent: bool = False
    proxy: str | None = None
    proxy_auth: str | None = None
    rate: float | None = None

    def __post_init__(self):
        if self.proxy and not self.proxy.lower().startswith(("http://", "https://", "socks4://", "socks5://", "socks5h://")):
            raise ValueError(f"not a proxy's address: {self.proxy!r}")

    def credentials(self) -> tuple[str, str] | None:
        """The proxy's user and password; without a colon the password is empty."""
        user, _, password = (self.proxy_auth or "").partition(":")
        return (user, password) if user else None


def for_role(settings: Client, scope: str, role: str) -> Client:
    """``settings`` for ``providers`` or ``testers`` if the scope covers them, else those of a new client."""
    return settings if scope == "all" or role in scope.split(",") else Client()


def settled(pages: DataFrame, retries: int = 2) -> DataFrame:
    """Of each request's recorded attempts (column ``attempt``, from 0) the one that counts.

    That is the first that isn't worth another, else the last one allowed. Attempts meet before they move.
    """
    if "attempt" not in pages.columns:
        return pages
    keys = [c for c in ("source", "domain", "scope", "page_no") if c in pages.columns]
    others = [c for c in pages.columns if c not in (*keys, "attempt")]
    again = retryable_column(F.col("http_status"))
    rank = F.struct(again, F.when(again, -F.col("attempt")).otherwise(F.col("attempt")))
    tried = pages.where(F.col("attempt").between(0, retries))
    return tried.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("r")).select(*keys, *[f"r.{c}" for c in others])
