"""Spark-first analytics over speech transcripts, idea graphs and text corpora."""
