"""Tessera: a PySpark-native engine for prospect data (linkage, signals, scoring, queues, metrics)."""
