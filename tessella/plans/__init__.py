"""Named tasks with dependencies over lazy DataFrames."""

from .flow import Flow, Space, variant

__all__ = ["Flow", "Space", "variant"]
