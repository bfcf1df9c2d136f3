"""tabscout: profile, model, check, explain and forecast tables with Spark."""

from tabscout.errors import TabularError

__all__ = ["TabularError"]
