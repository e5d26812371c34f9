"""Spark jobs that collect, prepare, label and evaluate news headlines."""
