"""Evidence analytics on Spark: record linkage, citation matching and bibliometric statistics as DataFrame operators."""
