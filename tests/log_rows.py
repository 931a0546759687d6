"""What the fixtures and tests of this folder share."""

from datetime import datetime, timezone


def at(text: str) -> datetime:
    parsed = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)
