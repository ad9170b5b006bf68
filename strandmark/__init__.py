"""Base-modification analytics on Spark."""

from .database import Database
from .session import build_session

__all__ = ["Database", "build_session"]
