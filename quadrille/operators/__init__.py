"""Operators on positions, sections, intervals and shards."""
