"""Tessella: partitioned arrays, task graphs and their analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
