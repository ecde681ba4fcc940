"""Tallybrook: request-log analytics as PySpark DataFrame operators."""
