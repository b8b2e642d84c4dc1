"""Mnemos: a PySpark-native engine for learning and assessment history."""
