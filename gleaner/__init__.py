"""Sentence-level page analytics, expressed as Spark DataFrame plans."""
