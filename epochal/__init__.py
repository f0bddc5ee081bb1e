"""Temporal catalogue analytics on Spark: change points, as-of reads, interval algebra, entity resolution and comparison queries as DataFrame programs."""
