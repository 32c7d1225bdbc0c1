"""Time modifiers such as ``-24h``, ``+30m`` or ``now``."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

# Unit letters of a modifier.
UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def relative_time(modifier: str, now: datetime) -> datetime:
    """Instant meant by ``modifier``, seen from ``now`` (given explicitly: no hidden clock)."""
    now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    text = modifier.strip()
    if text.lower() == "now":
        return now
    step = re.fullmatch(r"([+-])(\d+)([smhdw])", text)
    if step:
        sign, amount, unit = step.groups()
        delta = timedelta(**{UNITS[unit]: int(amount)})
        return now + delta if sign == "+" else now - delta
    moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
