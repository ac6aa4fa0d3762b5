"""State-space analytics on Spark: boards, sections, moves, values, shards and intervals as DataFrames."""
