"""Settings of a pileup run."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Region:
    """A chromosome, or a 1-based inclusive stretch of it."""

    name: str
    start: int | None = None
    end: int | None = None

    @classmethod
    def parse(cls, text: str) -> Region:
        """From ``chr`` or ``chr:start-end``; anything else is a ValueError."""
        parts = re.split("[:-]", text)
        if len(parts) == 1 and parts[0]:
            return cls(parts[0])
        if len(parts) != 3 or not parts[0] or not parts[1].isdigit() or not parts[2].isdigit():
            raise ValueError(f"a region is chr or chr:start-end, not {text!r}")
        start, end = int(parts[1]), int(parts[2])
        if start >= end:
            raise ValueError("a region has to end after its start")
        return cls(parts[0], start, end)


@dataclass(frozen=True)
class PileupConfig:
    """One field for each option of a run; the defaults are the usual ones."""

    reads: str | None = None
    reference: str | None = None
    output: str | None = None
    append: bool = False
    remove_header: bool = False
    region: Region | None = None
    strict: bool = False
    strand: int = 0  # 0 unstranded, 1 second strand, 2 first strand
    homopolymer_file: str | None = None
    create_homopolymers: bool = False
    homopolymer_span: int = 5
    splicing_file: str | None = None
    splicing_span: int = 4
    min_read_length: int = 30
    min_read_quality: int = 20  # mapping quality; also the least mean quality of a column unless given
    min_column_quality: int | None = None
    min_base_quality: int = 30
    min_base_position: int = 0
    max_base_position: int = 0
    min_column_length: int = 1
    min_edits_per_nucleotide: int = 1
    min_edits: int = 0
    max_editing_nucleotides: int = 100
    strand_mode: str = "confidence"  # or "max"; 1 and 2 mean confidence
    strand_threshold: float = 0.7
    strand_correction: bool = False
    verbose: bool = False
    debug: bool = False
    dna: bool = False
    target_file: str | None = None
    cigar_mode: str = "compat"  # or "full"
    coverage_file: str | None = None
    coverage_dir: str | None = None
    temp_dir: str | None = None
    sizes_file: str | None = None
    samples_file: str | None = None
    exclude_regions: tuple[str, ...] = field(default=())
    size: int | None = None  # intervals that a depth file is cut into
    restart: bool = False  # leave out the parts that an earlier run finished

    def __post_init__(self) -> None:
        if self.strand not in (0, 1, 2):
            raise ValueError("strand is 0, 1 or 2")
        if self.strand_mode in ("1", "2", 1, 2):
            object.__setattr__(self, "strand_mode", "confidence")
        if self.strand_mode not in ("confidence", "max"):
            raise ValueError("strand_mode is confidence or max")
        if self.cigar_mode not in ("compat", "full"):
            raise ValueError("cigar_mode is compat or full")
        if self.create_homopolymers and not self.homopolymer_file:
            raise ValueError("creating homopolymers needs the file to create")
        if self.dna and not self.target_file:
            raise ValueError("DNA mode needs target positions")

    @property
    def column_quality(self) -> int:
        return self.min_read_quality if self.min_column_quality is None else self.min_column_quality

    def for_files(self) -> PileupConfig:
        """This, after a check that reads and reference are named."""
        if not self.reads or not self.reference:
            raise ValueError("reads and reference have to be given")
        return self

    def default_output(self) -> str:
        """The table's name if none is given: that of the reads, and the region."""
        base = re.sub(r"\.[^./]*$", "", (self.reads or "reads").rsplit("/", 1)[-1])
        where = [str(x) for x in (self.region.name, self.region.start, self.region.end) if x is not None] if self.region else []
        return "_".join([base, *where, "pileup_table.gz"])
