"""Kisaran: price-series reconciliation, anomaly detection and data processing on PySpark."""
