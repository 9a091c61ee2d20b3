"""Cell morphometry and phenotype analytics on Spark."""
