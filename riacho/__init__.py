"""Spark-native engine for financial text corpora, labelled text and market analytics."""
