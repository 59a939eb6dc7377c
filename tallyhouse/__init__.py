"""Inventory, purchasing and sales analytics as PySpark DataFrame jobs."""

from tallyhouse.tables import Tables

__all__ = ["Tables"]
