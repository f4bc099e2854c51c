"""Spark-native usage ledger and announcement analytics."""
