"""Readers of corpora, tables and pages."""
