"""Millrace: curation, scoring and evaluation of structured-extraction data as lazy Spark plans."""
