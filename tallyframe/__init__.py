"""Tallyframe: a PySpark-native engine for financial-statement analytics."""
