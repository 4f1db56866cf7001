"""Curate large tables into typed, versioned and verifiable datasets on Spark."""

from rowsmith.contract import Contract, Field

__all__ = ["Contract", "Field"]
