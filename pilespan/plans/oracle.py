"""The queries once more as DuckDB's SQL, written against the same tables, from the definitions."""

from __future__ import annotations


def reads_sql(source: str, k: str, c: str, sample: str) -> str:
    cases = " ".join(f"WHEN {n} THEN '{x}'" for n, x in enumerate(("40M", "5S35M", "20M3D20M", "15M2I23M", "18M50N22M", "3H37M", "38M2S", "10M2X28M", "25M", "1S12M1D10M2I15M", "36M4S")))
    return f"""
SELECT {sample} AS sample, k AS read_id, c, 1 + c % 3 AS rno, 'chr' || (1 + c % 3) AS region, start0,
  CAST(CASE k % 20 WHEN 0 THEN 0 WHEN 1 THEN 16 WHEN 2 THEN 77 WHEN 3 THEN 512 WHEN 4 THEN 256 WHEN 5 THEN 2048 WHEN 6 THEN 1024 WHEN 7 THEN 65 ELSE
    CASE (start0 // 500) % 3
      WHEN 0 THEN CASE WHEN k % 20 = 19 THEN 83 WHEN k % 2 = 0 THEN 99 ELSE 147 END
      WHEN 1 THEN CASE WHEN k % 20 = 19 THEN 99 WHEN k % 2 = 0 THEN 83 ELSE 163 END
      ELSE CASE k % 4 WHEN 0 THEN 99 WHEN 1 THEN 147 WHEN 2 THEN 83 ELSE 163 END END END AS INTEGER) AS flag,
  CAST(10 + c % 51 AS INTEGER) AS mapq, CASE k % 11 {cases} END AS cigar,
  CAST(CASE k % 11 WHEN 5 THEN 37 WHEN 8 THEN 25 ELSE 40 END AS BIGINT) AS qlen, k % 97 = 0 AS has_sa
FROM (SELECT {k} AS k, {c} AS c, (37 * {k} + 11 * {c}) % 5000 AS start0 FROM {source})"""


RNA = reads_sql("orders", "o_orderkey", "o_custkey", "'all'")
SAMPLES = reads_sql("orders", "o_orderkey", "o_custkey", "CAST(k % 4 AS VARCHAR)")
DNA = reads_sql("events", "event_id", "user_id", "'all'")

REFERENCE = """
SELECT 'chr' || rno AS region, rno, pos0,
  CASE WHEN pos0 % 997 = 0 THEN 'N' WHEN pos0 % 211 BETWEEN 100 AND 106 THEN 'A'
  ELSE substr('ACGT', CAST(1 + (pos0 * pos0 + 3 * pos0 + 7 * rno + pos0 // 5) % 4 AS INTEGER), 1) END AS base
FROM (SELECT unnest(range(1, 4)) AS rno) CROSS JOIN (SELECT unnest(range(0, 5120)) AS pos0)"""

RULES = {
    "unmapped pair": "flag NOT IN (77, 141)",
    "failed quality control": "flag & 512 = 0",
    "mapping quality": "mapq >= 20",
    "read length": "qlen >= 30",
    "secondary or supplementary": "flag & 2304 = 0",
    "duplicate": "flag & 1024 = 0",
    "improper pair": "(flag & 1 = 0 OR flag IN (99, 147, 83, 163))",
    "chimeric": "NOT has_sa",
}
KEEP = " AND ".join(RULES.values())
REASON = "CASE " + " ".join(f"WHEN NOT ({rule}) THEN '{name}'" for name, rule in RULES.items()) + " END"


def ops_sql(reads: str) -> str:
    """Operations of each read with their offsets."""
    return f"""
SELECT *, sum(CASE WHEN op IN ('M','D','N') THEN n ELSE 0 END) OVER before AS ref_before,
  sum(CASE WHEN op IN ('M','I','S') THEN n ELSE 0 END) OVER before AS read_before,
  sum(CASE WHEN op IN ('M','D','N','=','X') THEN n ELSE 0 END) OVER before AS full_ref_before,
  sum(CASE WHEN op IN ('M','I','S','=','X') THEN n ELSE 0 END) OVER before AS full_read_before,
  max(CASE WHEN op IN ('H','P','=','X') THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY op_index) AS stalled
FROM (SELECT r.*, i AS op_index, right(token, 1) AS op, CAST(regexp_extract(token, '[0-9]+') AS BIGINT) AS n
  FROM (SELECT q.*, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS tokens FROM ({reads}) q) r, unnest(tokens) WITH ORDINALITY AS t(token, i))
WINDOW before AS (PARTITION BY read_id ORDER BY op_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def pairs_sql(reads: str, mode: str = "compat") -> str:
    pre, which = ("full_", "op IN ('M', '=', 'X')") if mode == "full" else ("", "op = 'M' AND stalled = 0")
    return f"""
SELECT sample, read_id, c, rno, region, flag, qlen, CAST(start0 + coalesce({pre}ref_before, 0) + j AS BIGINT) AS pos0, CAST(coalesce({pre}read_before, 0) + j AS BIGINT) AS qpos
FROM (SELECT o.*, unnest(range(0, n)) AS j FROM ({ops_sql(reads)}) o WHERE {which})"""


def bases_sql(reads: str, mode: str = "compat") -> str:
    """Every base of the reads that pass, with reference base, quality and strands."""
    return f"""
SELECT p.*, f.base AS ref,
  CASE WHEN (read_id + p.pos0) % 503 = 0 THEN 'N' WHEN (13 * read_id + 17 * p.pos0) % 29 = 0 THEN translate(f.base, 'ACGT', 'GTAC')
    WHEN (5 * read_id + 3 * p.pos0) % 211 = 0 THEN translate(f.base, 'ACGT', 'CATG') ELSE f.base END AS base,
  24 + (3 * read_id + 7 * qpos + c) % 17 AS qual,
  CASE WHEN (flag & 128 = 128) = (flag & 16 = 16) THEN '+' ELSE '-' END AS strand1,
  CASE WHEN (flag & 128 = 128) = (flag & 16 = 16) THEN '-' ELSE '+' END AS strand2
FROM ({pairs_sql(f"SELECT * FROM ({reads}) WHERE {KEEP}", mode)}) p JOIN ({REFERENCE}) f ON p.rno = f.rno AND p.pos0 = f.pos0"""


SPLICE = """
SELECT DISTINCT region, site + j * CASE WHEN (kind = 'D') = (strand = '+') THEN 1 ELSE -1 END AS pos0
FROM (SELECT 'chr' || (1 + p_partkey % 3) AS region, (p_partkey * 7) % 500 * 10 AS site, CASE WHEN p_partkey % 4 < 2 THEN 'D' ELSE 'A' END AS kind,
  CASE WHEN (p_partkey % 4 < 2) = (p_partkey % 2 = 0) THEN '+' ELSE '-' END AS strand FROM part), (SELECT unnest(range(1, 5)) AS j)"""

TARGETS = """
SELECT DISTINCT region, unnest(range(s - 1, e)) AS pos0 FROM (SELECT 'chr' || (1 + p_partkey % 2) AS region, (p_partkey * 13) % 100 * 50 + 1 AS s,
  (p_partkey * 13) % 100 * 50 + 1 + CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 20 ELSE 0 END AS e FROM part)"""

RUNS = """
SELECT region, min(pos0) AS start0, max(pos0) + 1 AS end0, CAST(count(*) AS BIGINT) AS length, symbol FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY region ORDER BY pos0) AS run FROM (
    SELECT region, pos0, lower(base) AS symbol, CASE WHEN lower(base) = lag(lower(base)) OVER (PARTITION BY region ORDER BY pos0) THEN 0 ELSE 1 END AS fresh FROM ({r}))
) GROUP BY region, run, symbol HAVING count(*) >= 5 AND max(pos0) + 1 < 5120""".replace("{r}", REFERENCE)


def sites_sql(
    reads: str = RNA,
    strand: int = 0,
    correct: bool = False,
    dna: bool = False,
    vote: str = "confidence",
    mode: str = "compat",
    bases_where: str = "qual >= 30",
    position_where: str = "",
    having: str = "",
    min_quality: int = 20,
    min_edits: int = 0,
    men: int = 1,
    changes: int = 100,
    strict: bool = False,
) -> str:
    """The table of sites; position_where speaks of region and pos0."""
    side = f"strand{strand or 1}"
    if vote == "max":
        voted = "CASE WHEN plus + minus = 0 THEN '2' WHEN plus >= minus THEN '1' ELSE '0' END"
    else:
        voted = "CASE WHEN plus + minus = 0 THEN '2' WHEN plus / (plus + minus) >= 0.7 THEN '1' WHEN minus / (plus + minus) >= 0.7 THEN '0' ELSE '2' END"
    v = "'*'" if dna else "'2'" if strand == 0 else voted
    counts = ", ".join(f"CAST(count(*) FILTER (base = '{b}') AS BIGINT) AS n{b}" for b in "ACGT")
    kept = "v NOT IN ('0', '1') OR (v = '1') = (s = '+')" if correct and not dna else "true"
    return f"""
WITH b AS (SELECT *, {side} AS s FROM ({bases_sql(reads, mode)}) WHERE ref <> 'N' AND base <> 'N' AND ({bases_where}) {position_where and f"AND ({position_where})"}),
votes AS (SELECT sample, region, pos0, {v} AS v, edits FROM (SELECT sample, region, pos0, CAST(count(*) FILTER (s = '+') AS DOUBLE) AS plus,
  CAST(count(*) FILTER (s = '-') AS DOUBLE) AS minus, CAST(count(*) FILTER (base <> ref) AS BIGINT) AS edits FROM b GROUP BY ALL)),
kept AS (SELECT b.sample, b.region, b.pos0, v, edits, qual, CASE WHEN v = '0' THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS ref,
  CASE WHEN v = '0' THEN translate(base, 'ACGT', 'TGCA') ELSE base END AS base FROM b JOIN votes USING (sample, region, pos0) WHERE {kept}),
sums AS (SELECT sample, region, pos0 + 1 AS position, ref AS reference, v AS strand, CAST(count(*) AS BIGINT) AS coverage,
  CAST(sum(qual) AS DOUBLE) / count(*) AS mean_q, {counts}, any_value(edits) AS edits_no FROM kept GROUP BY sample, region, pos0, ref, v),
alts AS (SELECT *, list_filter([{{'n': -nA, 'b': 'A'}}, {{'n': -nC, 'b': 'C'}}, {{'n': -nG, 'b': 'G'}}, {{'n': -nT, 'b': 'T'}}], lambda x: x.n < 0 AND x.b <> reference) AS found,
  CASE reference WHEN 'A' THEN nA WHEN 'C' THEN nC WHEN 'G' THEN nG ELSE nT END AS ref_count FROM sums),
sites AS (SELECT *, list_sort(found) AS a FROM alts)
SELECT sample, region, position, reference, strand, coverage, mean_q, nA AS n_a, nC AS n_c, nG AS n_g, nT AS n_t,
  CASE WHEN len(a) = 0 THEN '-' ELSE array_to_string(list_transform(a, lambda x: reference || x.b), ' ') END AS all_subs,
  CASE WHEN len(a) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(-a[1].n AS DOUBLE) / CAST(-a[1].n + ref_count AS DOUBLE) END AS frequency, edits_no
FROM sites WHERE mean_q >= {min_quality} AND edits_no >= {min_edits} AND len(list_filter(a, lambda x: -x.n < {men})) = 0
  AND len(a) + CASE WHEN ref_count > 0 THEN 1 ELSE 0 END <= {changes} {"AND len(a) > 0" if strict else ""} {having}"""


DEPTH = f"SELECT region, pos0 + 1 AS position, CAST(count(*) AS BIGINT) AS depth FROM ({pairs_sql(RNA)}) GROUP BY ALL"
NO_SPLICE = f"(region, pos0) NOT IN (SELECT (region, pos0) FROM ({SPLICE}))"
RUN_POSITIONS = f"SELECT region, unnest(range(start0, end0)) AS pos0 FROM ({RUNS})"
NO_RUNS = f"(region, pos0) NOT IN (SELECT (region, pos0) FROM ({RUN_POSITIONS}))"
ON_TARGET = f"region = 'chr3' OR (region, pos0) IN (SELECT (region, pos0) FROM ({TARGETS}))"


def annotated_sql(homozygous: bool) -> str:
    rna, dna = sites_sql(strand=1), sites_sql(DNA, dna=True)
    turn = lambda own, other: f"CASE WHEN r.strand = '0' THEN d.{other} ELSE d.{own} END"
    pairs = "array_to_string(list_transform(string_split(d.all_subs, ' '), lambda x: translate(x, 'ACGT', 'TGCA')), ' ')"
    return f"""
WITH rna AS ({rna}), dna AS ({dna})
SELECT r.region, r.position, r.reference, r.strand, r.coverage, r.all_subs, d.coverage AS g_coverage, d.mean_q AS g_mean_q,
  {turn('n_a', 'n_t')} AS g_n_a, {turn('n_c', 'n_g')} AS g_n_c, {turn('n_g', 'n_c')} AS g_n_g, {turn('n_t', 'n_a')} AS g_n_t,
  CASE WHEN r.strand = '0' THEN {pairs} ELSE d.all_subs END AS g_all_subs, d.frequency AS g_frequency
FROM rna r LEFT JOIN dna d ON r.region = d.region AND r.position = d.position {"WHERE d.position IS NULL OR d.all_subs = '-'" if homozygous else ""}"""


def intervals_sql(size: int) -> str:
    """The splitter as a recursive walk over numbered positions."""
    return f"""
WITH RECURSIVE depth AS ({DEPTH}), goal AS (SELECT CAST(sum(depth * depth * depth) AS BIGINT) // {size} AS g FROM depth),
rows AS (SELECT region, position, depth * depth * depth AS w, row_number() OVER (PARTITION BY region ORDER BY position) AS n FROM depth),
walk AS (
  SELECT region, n, position AS s, position AS e, w AS c, CAST(NULL AS STRUCT(s BIGINT, e BIGINT, c BIGINT, r VARCHAR)) AS closed FROM rows WHERE n = 1
  UNION ALL
  SELECT r.region, r.n, CASE WHEN c >= g OR e - s > least(3000000, 3000000000 // {size}) THEN position ELSE s END, position,
    CASE WHEN c >= g OR e - s > least(3000000, 3000000000 // {size}) THEN w ELSE c + w END,
    CASE WHEN c >= g THEN {{'s': s, 'e': e, 'c': c, 'r': 'WEIGHT'}} WHEN e - s > least(3000000, 3000000000 // {size}) THEN {{'s': s, 'e': e, 'c': c, 'r': 'MAX_WIDTH'}} END
  FROM walk v JOIN rows r ON r.region = v.region AND r.n = v.n + 1, goal)
SELECT region, closed.s AS start, closed.e AS "end", closed.c AS weight, closed.e - closed.s AS width, closed.r AS reason FROM walk WHERE closed IS NOT NULL
UNION ALL SELECT region, s, e, c, e - s, 'END_OF_CHROMOSOME' FROM walk JOIN (SELECT region, max(n) AS n FROM rows GROUP BY 1) USING (region, n)"""


SPECTRUM = f"""
SELECT sub AS substitution, CAST(count(*) AS BIGINT) AS n_sites, CAST(sum(CASE right(sub, 1) WHEN 'A' THEN n_a WHEN 'C' THEN n_c WHEN 'G' THEN n_g ELSE n_t END) AS BIGINT) AS n_reads
FROM (SELECT *, unnest(string_split(all_subs, ' ')) AS sub FROM ({sites_sql(strand=1)}) WHERE all_subs <> '-') GROUP BY 1"""

ISLANDS = """
SELECT region, min(position) AS start, max(position) AS "end" FROM (
  SELECT region, position, position - row_number() OVER (PARTITION BY region ORDER BY position) AS g FROM (SELECT DISTINCT region, position FROM ({t})))
GROUP BY region, g""".replace("{t}", sites_sql(strict=True))

BASE_RULES = "CASE WHEN NOT qpos >= 2 THEN 'min base position' WHEN NOT qlen - qpos >= 3 THEN 'max base position' WHEN NOT qual >= 30 THEN 'base quality' WHEN base = 'N' THEN 'no base' END"
PLAIN = "sample, read_id, region, start0, flag, mapq, cigar, qlen, has_sa"
FLAGSHIP = sites_sql(strand=1, correct=True, position_where=f"({NO_SPLICE}) AND ({NO_RUNS})")

SQL: dict[str, str] = {
    "read_filter_flags": f"SELECT {PLAIN} FROM ({RNA}) WHERE " + " AND ".join(RULES[x] for x in ("unmapped pair", "failed quality control", "secondary or supplementary", "duplicate", "improper pair")),
    "read_filter_all": f"SELECT {PLAIN} FROM ({RNA}) WHERE {KEEP}",
    "discard_reasons": f"SELECT reason, CAST(count(*) AS BIGINT) AS n_reads FROM (SELECT {REASON} AS reason FROM ({RNA})) GROUP BY 1",
    "base_discard_reasons": f"SELECT reason, CAST(count(*) AS BIGINT) AS n_bases FROM (SELECT {BASE_RULES} AS reason FROM ({bases_sql(RNA)})) GROUP BY 1",
    "cigar_ops": f"SELECT read_id, CAST(op_index - 1 AS INTEGER) AS op_index, op, n AS op_length FROM ({ops_sql(RNA)})",
    "cigar_aligned_pairs": f"SELECT read_id, region, pos0, qpos FROM ({pairs_sql(RNA)})",
    "cigar_full_mode": f"SELECT read_id, region, pos0, qpos FROM ({pairs_sql(RNA, 'full')})",
    "base_filters": f"SELECT read_id, region, pos0, qpos, base, CAST(qual AS INTEGER) AS qual FROM ({bases_sql(RNA)}) WHERE qpos >= 2 AND qlen - qpos >= 3 AND qual >= 30 AND base <> 'N'",
    **{f"read_strand_s{s}": f"SELECT read_id, flag, CASE WHEN (flag & 16 = 16) = {turned} THEN '-' ELSE '+' END AS strand FROM ({RNA})" for s, turned in ((0, "false"), (1, "(flag & 128 = 0)"), (2, "(flag & 128 = 128)"))},
    "pileup_basic": sites_sql(),
    "pileup_strict": sites_sql(strict=True),
    "pileup_region": sites_sql(position_where="region = 'chr2' AND pos0 BETWEEN 999 AND 1999"),
    "pileup_full_cigar": sites_sql(mode="full"),
    "pileup_trimmed": sites_sql(bases_where="qual >= 30 AND qpos >= 5 AND qlen - qpos >= 6"),
    "pileup_stranded": sites_sql(strand=1),
    "pileup_first_strand": sites_sql(strand=2),
    "pileup_strand_max": sites_sql(strand=1, vote="max"),
    "pileup_strand_corrected": sites_sql(strand=1, correct=True),
    "column_min_edits": sites_sql(strand=1, men=2, min_edits=3),
    "column_max_changes": sites_sql(strand=1, changes=2),
    "column_mean_quality": sites_sql(min_quality=35, having="AND coverage >= 5"),
    "pileup_dna": sites_sql(DNA, dna=True, position_where=ON_TARGET),
    "splice_positions": SPLICE,
    "pileup_no_splice": sites_sql(position_where=NO_SPLICE),
    "homopolymer_runs": RUNS,
    "pileup_no_homopolymer": sites_sql(position_where=NO_RUNS),
    "target_positions": TARGETS,
    "pileup_targets": sites_sql(position_where=ON_TARGET),
    "table_to_bed": ISLANDS,
    "annotate_dna": annotated_sql(False),
    "annotate_homozygous": annotated_sql(True),
    "depth": DEPTH,
    "coverage_weight": f"SELECT CAST(sum(depth * depth * depth) AS BIGINT) AS total FROM ({DEPTH})",
    "greedy_intervals": f"SELECT region, start, \"end\", CAST(weight AS BIGINT) AS weight, width, reason FROM ({intervals_sql(16)})",
    "fixed_intervals": "SELECT 'chr' || r AS region, s AS start, least(s + 999, 5120) AS \"end\" FROM (SELECT unnest(range(1, 4)) AS r), (SELECT unnest(range(1, 5121, 1000)) AS s)",
    "interval_overlap_join": f"""SELECT read_id, r.region, r.start0, r.start0 + qlen AS end0, t.start0 AS other_start0, t.end0 AS other_end0
FROM ({RNA}) r JOIN (SELECT DISTINCT 'chr' || (1 + p_partkey % 2) AS region, (p_partkey * 13) % 100 * 50 AS start0,
  (p_partkey * 13) % 100 * 50 + 1 + CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 20 ELSE 0 END AS end0 FROM part) t
ON r.region = t.region AND r.start0 < t.end0 AND t.start0 < r.start0 + r.qlen""",
    "multisample_pileup": sites_sql(SAMPLES, strand=1),
    "sample_summary": f"SELECT sample, CAST(count(*) AS BIGINT) AS n_sites, CAST(count(*) FILTER (all_subs <> '-') AS BIGINT) AS n_edited, CAST(sum(coverage) AS BIGINT) AS n_bases FROM ({sites_sql(SAMPLES, strand=1)}) GROUP BY 1",
    "sample_runtime": "SELECT sample, s AS seconds, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS hms FROM (SELECT CAST(o_orderkey % 4 AS VARCHAR) AS sample, CAST(sum(o_custkey % 60) AS BIGINT) AS s FROM orders GROUP BY 1)",
    "site_table_text": f"""SELECT region AS "Region", CAST(position AS VARCHAR) AS "Position", reference AS "Reference", strand AS "Strand", CAST(coverage AS VARCHAR) AS "Coverage-q30",
printf('%.2f', mean_q) AS "MeanQ", '[' || n_a || ', ' || n_c || ', ' || n_g || ', ' || n_t || ']' AS "BaseCount[A,C,G,T]", all_subs AS "AllSubs", printf('%.2f', frequency) AS "Frequency",
'-' AS "gCoverage-q30", '-' AS "gMeanQ", '-' AS "gBaseCount[A,C,G,T]", '-' AS "gAllSubs", '-' AS "gFrequency" FROM ({sites_sql(strand=1)})""",
    "ordered_sites": f"SELECT region, position, CAST(row_number() OVER (ORDER BY region, position) - 1 AS BIGINT) AS place FROM ({sites_sql(strict=True)})",
    "read_distribution": f"""SELECT region, CAST(count(*) FILTER (flag & 64 <> 0 AND flag & 16 = 0) AS BIGINT) AS r1, CAST(count(*) FILTER (flag & 64 <> 0 AND flag & 16 <> 0) AS BIGINT) AS r1_reverse,
CAST(count(*) FILTER (flag & 64 = 0 AND flag & 16 = 0) AS BIGINT) AS r2, CAST(count(*) FILTER (flag & 64 = 0 AND flag & 16 <> 0) AS BIGINT) AS r2_reverse FROM ({bases_sql(RNA)}) WHERE qual >= 30 AND base <> 'N' GROUP BY 1""",
    "site_discard_reasons": f"""SELECT CASE WHEN NOT mean_q >= 33 THEN 'mean quality' WHEN coverage < 6 THEN 'column length' WHEN least(n1, n2, n3) < 2 THEN 'edits per nucleotide'
WHEN alts + CASE WHEN nr > 0 THEN 1 ELSE 0 END > 2 THEN 'changes' WHEN alts = 0 THEN 'no edits' END AS reason, CAST(count(*) AS BIGINT) AS n_sites FROM (
  SELECT *, coalesce(nullif(a, 0), 99) AS n1, coalesce(nullif(b, 0), 99) AS n2, coalesce(nullif(c, 0), 99) AS n3, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS alts FROM (
    SELECT mean_q, coverage, CASE reference WHEN 'A' THEN n_a WHEN 'C' THEN n_c WHEN 'G' THEN n_g ELSE n_t END AS nr,
      CASE reference WHEN 'A' THEN n_c ELSE n_a END AS a, CASE reference WHEN 'A' THEN n_g WHEN 'C' THEN n_g ELSE n_c END AS b, CASE reference WHEN 'T' THEN n_g ELSE n_t END AS c
    FROM ({sites_sql(strand=1, min_quality=0)}))) GROUP BY 1""",
    "remaining_intervals": "SELECT 'chr' || r AS region, s AS start, least(s + 999, 5120) AS \"end\" FROM (SELECT unnest(range(1, 4)) AS r), (SELECT unnest(range(1, 5121, 1000)) AS s) WHERE r <> 2",
    "substitution_spectrum": SPECTRUM,
    "pileup_from_files": sites_sql(),
    "pileup_flagship": FLAGSHIP,
}
