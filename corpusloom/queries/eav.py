"""Attribute-value rows to wide tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators.eav import melt, widen
from corpusloom.sources.tables import table

TYPED = ["int", "double", "timestamp", "boolean"]


def p5_found(spark, d):
    wide = widen(table(spark, d, "urlinfo"), table(spark, d, "sections"), valtypes=TYPED)
    return melt(wide).select(F.col("url_id").cast("int").alias("url_id"), "sname", "val")


def p5_wide(spark, d):
    return widen(table(spark, d, "urlinfo"), table(spark, d, "sections"), others=True)


_ZONE = r"\s*(z|gmt|utc|[+-]\d{2}:?\d{2})?"
_P5 = rf"""
WITH decl AS (SELECT DISTINCT replace(lower(trim(sname)), '_', '-') AS n, valtype FROM sections WHERE valtype IN ('int', 'double', 'timestamp', 'boolean')),
raw AS (SELECT DISTINCT u.url_id, d.n, d.valtype, lower(regexp_replace(u.sval, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')) AS v
        FROM urlinfo u JOIN decl d ON replace(lower(regexp_replace(u.sname, '^\s+|\s+$', '', 'g')), '_', '-') = d.n WHERE u.sval IS NOT NULL),
num AS (SELECT *, regexp_replace(v, '\s*(bytes?|b|octets?)$', '') AS w FROM raw),
cut AS (SELECT *, CASE
    WHEN valtype <> 'timestamp' THEN NULL
    WHEN regexp_full_match(v, '\d{{8,10}}') THEN ['epoch', v]
    WHEN regexp_full_match(v, '\d{{4}}-\d{{1,2}}-\d{{1,2}}(t|\s+)\d{{1,2}}:\d{{2}}:\d{{2}}(\.\d+)?{_ZONE}')
      THEN [regexp_extract(v, '^(\d{{4}})', 1)] || [regexp_extract(v, '^\d{{4}}-(\d{{1,2}})-', 1)] || [regexp_extract(v, '^\d{{4}}-\d{{1,2}}-(\d{{1,2}})', 1)]
    WHEN regexp_full_match(v, '([a-z]+,?\s+)?\d{{1,2}}[\s-]+[a-z]+[\s-]+(\d{{4}}|\d{{2}})\s+\d{{1,2}}:\d{{2}}:\d{{2}}{_ZONE}')
      THEN [regexp_extract(v, '[a-z]+[\s-]+(\d{{4}}|\d{{2}})\s', 1)] || [regexp_extract(v, '\d[\s-]+([a-z]{{3}})', 1)] || [regexp_extract(v, '(\d{{1,2}})[\s-]+[a-z]', 1)]
    WHEN regexp_full_match(v, '[a-z]+\s+[a-z]+\s+\d{{1,2}}\s+\d{{1,2}}:\d{{2}}:\d{{2}}\s+\d{{4}}')
      THEN [v[-4:]] || [regexp_extract(v, '^[a-z]+\s+([a-z]{{3}})', 1)] || [regexp_extract(v, '^[a-z]+\s+[a-z]+\s+(\d+)', 1)]
    END AS p FROM num),
part AS (SELECT *, CASE WHEN length(p[1]) = 2 THEN CASE WHEN p[1] < '70' THEN '20' ELSE '19' END || p[1] ELSE p[1] END AS y,
    coalesce(nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], p[2]), 0), try_cast(p[2] AS INT)) AS m,
    regexp_extract(v, '\d{{1,2}}:\d{{2}}:\d{{2}}') AS clock, regexp_extract(v, ':\d{{2}}(\.\d+)?\s*([+-]\d{{2}}:?\d{{2}})$', 2) AS zone FROM cut),
val AS (SELECT url_id, n, CASE valtype
    WHEN 'int' THEN CAST(try_cast(CASE WHEN regexp_full_match(w, '[+-]?\d{{1,18}}') THEN w
        WHEN regexp_full_match(w, '[+-]?\d{{1,3}}(,\d{{3}})+|[+-]?\d{{1,3}}([\x{{a0}} ]\d{{3}})+|[+-]?\d{{1,3}}(\.\d{{3}})+') THEN regexp_replace(w, '[,. \x{{a0}}]', '', 'g') END AS BIGINT) AS VARCHAR)
    WHEN 'double' THEN CAST(CAST(round(try_cast(CASE WHEN regexp_full_match(v, '[+-]?\d*,\d+') THEN replace(v, ',', '.') WHEN regexp_full_match(v, '[+-]?\d*\.?\d+(e[+-]?\d+)?') THEN v END AS DOUBLE), 3) AS DECIMAL(18, 3)) AS VARCHAR)
    WHEN 'boolean' THEN CASE WHEN v IN ('1', 'true', 't', 'yes', 'y', 'on') THEN 'true' WHEN v IN ('0', 'false', 'f', 'no', 'n', 'off') THEN 'false' END
    ELSE strftime(CASE WHEN p[1] = 'epoch' THEN make_timestamp(CAST(p[2] AS BIGINT) * 1000000)
        WHEN p IS NOT NULL THEN try_cast(y || '-' || m || '-' || p[3] || ' ' || clock AS TIMESTAMP)
          - CASE WHEN zone = '' THEN INTERVAL 0 MINUTE ELSE (CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END) * (CAST(zone[2:3] AS INT) * 60 + CAST(zone[-2:] AS INT)) * INTERVAL 1 MINUTE END END, '%Y-%m-%d %H:%M:%S')
    END AS val FROM part)
SELECT url_id, n AS sname, min(val) AS val FROM val WHERE val IS NOT NULL GROUP BY 1, 2
"""

QUERIES = {"p5_found": p5_found, "p5_wide": p5_wide}
SQL = {"p5_found": _P5}
