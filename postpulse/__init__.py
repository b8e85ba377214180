"""postpulse: how the sentiment of forum posts changes over time, as Spark jobs."""

from postpulse.session import build_session

__all__ = ["build_session"]
__version__ = "0.1.0"
