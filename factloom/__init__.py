"""Evidence analytics on Spark: DataFrame-to-DataFrame operators over append-only facts, claims and logs."""
