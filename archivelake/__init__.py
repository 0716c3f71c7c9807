"""archivelake: message-archive analytics as PySpark DataFrame jobs."""

from archivelake.session import build_session, durable

__all__ = ["build_session", "durable"]
