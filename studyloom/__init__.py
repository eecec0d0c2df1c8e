"""Learning-analytics and study-text jobs for Spark."""

from studyloom.session import tune

__all__ = ["tune"]
