"""Pileups of reads that keep arriving.

Sums of bases add up, so a stream keeps them as its state and sites are worked out from the state. A new
read changes the sites it covers and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import PileupConfig
from ..operators.pileup import filter_columns, sites, sum_bases, with_reference
from ..operators.reads import read_strand
from ..plans.pileups import kept_bases


def stream_sums(reads: DataFrame, config: PileupConfig) -> DataFrame:
    """Running sums by position of a stream of reads; write them in update or complete mode."""
    return sum_bases(kept_bases(reads, config), read_strand(config.strand, config.dna))


def stream_sites(reads: DataFrame, reference: DataFrame, config: PileupConfig) -> DataFrame:
    """Sites of all reads so far, for a sink in complete or update mode."""
    return filter_columns(sites(with_reference(stream_sums(reads, config), reference), config), config)
