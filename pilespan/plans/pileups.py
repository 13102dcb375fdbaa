"""Whole runs: reads and reference to sites, DNA annotation, many samples."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PileupConfig
from ..operators import bases as base_ops
from ..operators import positions as at
from ..operators.annotate import annotate
from ..operators.cigar import aligned_pairs, pick_bases
from ..operators.pileup import filter_columns, sites, sum_bases, with_reference
from ..operators.reads import fetch, filter_reads, read_strand


def kept_bases(reads: DataFrame, config: PileupConfig, pick=pick_bases, targets: DataFrame | None = None) -> DataFrame:
    """The bases that count. pick adds base and qual to aligned pairs; by default from seq and quals.

    targets: reads that surely touch none of these positions go before they become bases.
    """
    pairs = aligned_pairs(at.near(filter_reads(fetch(reads, config.region), config), targets), config.cigar_mode)
    return base_ops.filter_bases(pick(pairs), config)


def column_sites(kept: DataFrame, reference: DataFrame, config: PileupConfig, targets: DataFrame | None = None, excluded: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Sites before the column filters.

    Targets and exclusions meet the sums, which are fewer than the bases; reads far from all targets are gone before.
    """
    sums = at.restrict(sum_bases(at.clip(kept, config.region), read_strand(config.strand, config.dna)), targets)
    for positions in excluded:
        sums = at.exclude(sums, positions)
    return sites(with_reference(sums, reference), config)


def pileup(reads: DataFrame, reference: DataFrame, config: PileupConfig, targets: DataFrame | None = None, excluded: tuple[DataFrame, ...] = (), pick=pick_bases) -> DataFrame:
    """The table of sites of every sample; sample is part of every key, so one run serves many."""
    return filter_columns(column_sites(kept_bases(reads, config, pick, targets), reference, config, targets, excluded), config)


def dna_annotated(rna: DataFrame, dna_reads: DataFrame, reference: DataFrame, config: PileupConfig, homozygous_only: bool = False, pick=pick_bases) -> DataFrame:
    """An RNA table annotated from DNA reads: the DNA is piled up at the RNA's positions only."""
    where = rna.select("region", (F.col("position") - 1).alias("pos0"))
    dna = pileup(dna_reads, reference, replace(config, dna=True, target_file=config.target_file or "rna positions", strict=False), targets=where, pick=pick)
    return annotate(rna, dna, homozygous_only)
