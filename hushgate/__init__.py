"""Secret-leak analytics as Spark DataFrame transformations."""

from hushgate.session import build_session

__all__ = ["build_session"]
