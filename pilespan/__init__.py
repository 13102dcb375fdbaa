"""Pileup analytics over aligned sequencing reads, as DataFrame transformations."""
