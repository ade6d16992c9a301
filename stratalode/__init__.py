"""Source-tree and text-corpus analytics as DataFrame queries on Spark."""
