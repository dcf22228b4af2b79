"""Multi-scale graph and hierarchy analytics expressed in Spark."""
