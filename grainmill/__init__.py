"""Corpus curation and conversation analytics as composable Spark plans."""
