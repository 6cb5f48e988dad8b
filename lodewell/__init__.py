"""Evidence analytics on Spark: retrieval, evidence gating, text guards and their statistics as DataFrame plans."""
