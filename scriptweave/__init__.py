"""Transcript analytics on Spark: pages to lines to words to reports."""
