"""SQL for the distribution charts, from their definitions."""

from __future__ import annotations


def histogram_sql(cte: str, source: str, x: str, bins: int, log10: bool = True, by: str = "") -> str:
    value = f"log10({x})" if log10 else f"CAST({x} AS DOUBLE)"
    keep = f"{x} > 0" if log10 else f"{x} IS NOT NULL"
    key = f"{by}, " if by else ""
    grid = f"(SELECT DISTINCT {by} FROM hd), " if by else ""
    on = f"e.{by} = c.{by} AND " if by else ""
    key_e = f"e.{by}, " if by else ""
    return f"""{cte},
hd AS (SELECT {key}{value} AS x FROM {source} WHERE {keep}),
ext AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS total FROM hd),
wd AS (SELECT *, CASE WHEN hi = lo THEN 0.1 ELSE (hi - lo) / {bins - 1} END AS width FROM ext),
hb AS (SELECT {key}CASE WHEN hi = lo THEN 0 ELSE greatest(ceil((x - (lo - width / 2)) / width) - 1, 0) END AS bin FROM hd, wd),
hc AS (SELECT {key}bin, count(*) AS n FROM hb GROUP BY ALL),
every AS (SELECT * FROM {grid}wd, range({bins}) AS b(bin) WHERE bin = 0 OR hi > lo)
--
SELECT {key_e}e.bin, lo - width / 2 + e.bin * width AS x_min, lo - width / 2 + (e.bin + 1) * width AS x_max,
       coalesce(n, 0) AS "count", coalesce(n, 0) / total AS frequency
FROM every e LEFT JOIN hc c ON {on}e.bin = c.bin"""


def ecdf_sql(cte: str, source: str, x: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    key = f"{by}, " if by else ""
    return f"""{cte}
--
SELECT DISTINCT {key}{x}, cume_dist() OVER ({part}ORDER BY {x}) AS ecdf FROM {source} WHERE {x} IS NOT NULL"""


def density_sql(cte: str, source: str, x: str, by: str = "'all'", points: int = 512) -> str:
    m = points - 1
    return f"""{cte},
kd AS (SELECT {by} AS g, log10({x}) AS x FROM {source} WHERE {x} > 0),
ext AS (SELECT min(x) AS lo, max(x) AS hi FROM kd),
mo AS (SELECT g, count(*) AS n, stddev_samp(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, min(x) AS x1
       FROM kd GROUP BY 1 HAVING count(*) > 1),
bw AS (SELECT g, n, lo, hi, 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd
       WHEN x1 <> 0 THEN abs(x1) ELSE 1 END * pow(n, -0.2) AS bw FROM mo, ext),
st AS (SELECT *, lo - 4 * bw AS low, (hi + 4 * bw - (lo - 4 * bw)) / {m} AS step FROM bw),
ps AS (SELECT kd.g, (x - low) / step AS p FROM kd JOIN st ON kd.g = st.g),
ms AS (SELECT g, cell, sum(mass) AS mass FROM (SELECT g, floor(p) AS cell, 1 - (p - floor(p)) AS mass FROM ps
       UNION ALL SELECT g, floor(p) + 1, p - floor(p) FROM ps) GROUP BY 1, 2),
pt AS (SELECT st.*, point, lo + point * (hi - lo) / {m} AS xat FROM st, range({points}) AS r(point)),
pp AS (SELECT *, floor((xat - low) / step) AS near, (xat - low) / step - floor((xat - low) / step) AS wt FROM pt),
dn AS (SELECT pp.g, point, any_value(xat) AS x, sum(mass * ((1 - wt) * exp(-0.5 * pow((near - cell) * step / bw, 2))
       + wt * exp(-0.5 * pow((near + 1 - cell) * step / bw, 2)))) / any_value(n * bw * sqrt(2 * pi())) AS density
       FROM pp JOIN ms ON pp.g = ms.g GROUP BY 1, 2)
--
SELECT * FROM dn"""
