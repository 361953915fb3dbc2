"""Governance and data-quality audits of tables, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
