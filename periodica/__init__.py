"""Periodica: analytics over per-entity, per-period performance logs, on Spark."""
