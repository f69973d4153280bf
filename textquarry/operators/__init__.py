"""Operators on DataFrames: chunking, page text, links, robots rules, search, roll-ups, upserts."""
