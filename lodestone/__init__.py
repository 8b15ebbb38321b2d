"""Spark-native preparation and evaluation of text, speech-token and page-layout corpora."""
