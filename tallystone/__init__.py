"""DataFrame operators for record linkage, panel building and social statistics on Spark."""
