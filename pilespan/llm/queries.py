"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from .debruijn import op8_substrings
from .language import op5_language
from .licenses import op4_licenses
from .mixing import op9_mixing
from .neighbours import op10_neighbours
from .packing import op6_packing
from .scoring import op7_scoring
from .sharding import op2_sharding
from .simhash import op1_simhash
from .syncmers import op3_fingerprints

QUERIES = {"op1_simhash": op1_simhash, "op2_sharding": op2_sharding, "op3_fingerprints": op3_fingerprints, "op4_licenses": op4_licenses, "op5_language": op5_language, "op6_packing": op6_packing, "op7_scoring": op7_scoring, "op8_substrings": op8_substrings, "op9_mixing": op9_mixing, "op10_neighbours": op10_neighbours}
#: The others hash, learn or search in ways that SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_substrings": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM t, unnest(range(1, len(ws) - 11)) AS u(i)),
least AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN least USING (g), range(0, 13) AS r(j) WHERE d < doc_id),
kept AS (SELECT doc_id, count(*) AS k, string_agg(word, ' ' ORDER BY p) AS s
  FROM (SELECT doc_id, p, ws[p] AS word FROM t, unnest(range(1, len(ws) + 1)) AS u(p)) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)""",
}
