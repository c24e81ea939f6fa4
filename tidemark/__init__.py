"""Activity analytics on Spark DataFrames: sessions, search, interval analytics, clustering of similar work and text rules."""
