"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op5_line_dedup"] = r"""
WITH split AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM numbered),
common AS (SELECT k, min(struct_pack(d := doc_id, p := pos)) AS first FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.k IS NOT NULL AND c.first <> struct_pack(d := doc_id, p := pos)) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (c.k IS NULL OR c.first = struct_pack(d := doc_id, p := pos)) AS rest
  FROM keyed LEFT JOIN common c USING (k) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       length(CASE WHEN text IS NULL THEN NULL ELSE coalesce(rest, '') END) AS n_chars,
       sha256(CASE WHEN text IS NULL THEN NULL ELSE coalesce(rest, '') END) AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id)"""
