"""Spark-native engine for entity catalogues, noisy transcripts, event logs and training corpora."""
