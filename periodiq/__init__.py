"""Periodiq: venue-integrity analytics on Spark, DataFrame-first."""
