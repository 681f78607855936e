"""Spark-native reconciliation and fee-audit engine."""
