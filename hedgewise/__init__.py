"""Spark-native analytics for judging when recorded model answers can be trusted.

Everything is a DataFrame-to-DataFrame operator or a Column function. Models are
never run here: their logits, log-probabilities and replies are input tables.
"""
