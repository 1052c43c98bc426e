"""Structured coalescent with recombination, inversions, demography and sweeps; replicates run as Spark tasks."""
