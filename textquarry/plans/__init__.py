"""Whole plans: the read API, ingestion, crawling."""
