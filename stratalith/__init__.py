"""Stratalith: a PySpark-native engine for layered measurements, their statistics, learners and reports."""
