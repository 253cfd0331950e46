"""Spark-native penalised regression: lazy feature frames, distributed statistics, compact driver solvers."""
