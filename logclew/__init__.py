"""Log investigation on Spark: normalise, correlate by explicit keys, redact, report."""

from logclew.schema import JoinPolicy, RedactionRule
from logclew.session import prepare

__all__ = ["JoinPolicy", "RedactionRule", "prepare"]
