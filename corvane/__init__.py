"""Corvane: Spark-native analytics for corpora of semi-structured documents and the study designs they describe."""
