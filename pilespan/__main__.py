"""python -m pilespan COMMAND ...: pileup, annotate, bed, coverage, intervals."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from .config import PileupConfig, Region
from .plans import run
from .sources import sinks

#: option, field of PileupConfig, type (None for a switch)
OPTIONS = [
    ("-f --file", "reads", str),
    ("-r --reference", "reference", str),
    ("-o --output", "output", str),
    ("-a --append", "append", None),
    ("-H --remove-header", "remove_header", None),
    ("-g --region", "region", Region.parse),
    ("-S --strict", "strict", None),
    ("-s --strand", "strand", int),
    ("-m --homopolymer-file", "homopolymer_file", str),
    ("-c --create-homopolymers", "create_homopolymers", None),
    ("-os --homopolymer-span", "homopolymer_span", int),
    ("-sf --splicing-file", "splicing_file", str),
    ("-ss --splicing-span", "splicing_span", int),
    ("-mrl --min-read-length", "min_read_length", int),
    ("-q --min-read-quality", "min_read_quality", int),
    ("-bq --min-base-quality", "min_base_quality", int),
    ("-mbp --min-base-position", "min_base_position", int),
    ("-Mbp --max-base-position", "max_base_position", int),
    ("-l --min-column-length", "min_column_length", int),
    ("-men --min-edits-per-nucleotide", "min_edits_per_nucleotide", int),
    ("-me --min-edits", "min_edits", int),
    ("-Men --max-editing-nucleotides", "max_editing_nucleotides", int),
    ("-T --strand-mode", "strand_mode", str),
    ("-Tv --strand-threshold", "strand_threshold", float),
    ("-C --strand-correction", "strand_correction", None),
    ("-d --debug", "debug", None),
    ("-V --verbose", "verbose", None),
    ("-N --dna", "dna", None),
    ("-B --targets", "target_file", str),
    ("-G --coverage-file", "coverage_file", str),
    ("-D --coverage-dir", "coverage_dir", str),
    ("-t --temp-dir", "temp_dir", str),
    ("-Z --sizes-file", "sizes_file", str),
    ("-F --samples-file", "samples_file", str),
    ("-mcq --min-column-quality", "min_column_quality", int),
    ("-cm --cigar-mode", "cigar_mode", str),
    ("-x --exclude-regions", "exclude_regions", lambda text: tuple(text.split(","))),
    ("-n --size", "size", int),
    ("-R --restart", "restart", None),
]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pilespan")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("pileup", "intervals"):
        own = commands.add_parser(name)
        for flags, field, kind in OPTIONS:
            how = {"action": "store_true"} if kind is None else {"type": kind}
            own.add_argument(*flags.split(), dest=field, default=argparse.SUPPRESS, **how)
    own = commands.add_parser("annotate")
    own.add_argument("-r", dest="rna", required=True)
    own.add_argument("-d", dest="dna", required=True)
    own.add_argument("-R", dest="sizes", required=True)
    own.add_argument("-Z", dest="homozygous", action="store_true")
    own.add_argument("-o", dest="output", required=True)
    for name in ("bed", "coverage"):
        own = commands.add_parser(name)
        own.add_argument("-i", dest="input", required=True)
        own.add_argument("-o", dest="output", required=True)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = vars(parser().parse_args(args))
    command = given.pop("command")
    if spark is None:
        builder = SparkSession.builder.appName("pilespan")
        if given.get("temp_dir"):  # where shuffles and spills go; has to be known before Spark starts
            builder = builder.config("spark.local.dir", given["temp_dir"])
        spark = builder.getOrCreate()
    if command == "pileup":
        config = run.with_coverage_dir(PileupConfig(**given))
        if not config.output:
            config = replace(config, output=config.default_output())
        run.run_pileup(spark, config)
    elif command == "intervals":
        config = run.with_coverage_dir(PileupConfig(**given))
        if not config.size or not config.output:
            raise SystemExit("intervals need --size and --output")
        sinks.write_intervals(run.run_intervals(spark, config, config.size), config.output)
    elif command == "annotate":
        sinks.write_table(run.run_annotation(spark, given["rna"], given["dna"], given["sizes"], given["homozygous"]), given["output"])
    elif command == "bed":
        run.run_bed(spark, given["input"], given["output"])
    else:
        run.run_coverage(spark, given["input"]).write.mode("overwrite").option("sep", "\t").csv(given["output"])


if __name__ == "__main__":
    main()
