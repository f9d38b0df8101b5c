"""Spark-native analytics over timed media observations: change, timelines, candidates, transcripts, decisions, evaluation."""
