"""Fixture views with the engine's shapes over the driver's tables; one SQL text serves Spark and DuckDB.

Float literals are written 1e2, never 100.0, which is a DECIMAL in both engines and divides differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FX = {
    "fx_dem": """select cast(0 as int) as raster_id, cast(floor(event_id/1e2) as int) as px_row, cast(event_id % 100 as int) as px_col,
 case when event_type='error' then null else value end as z, 2e1*(event_id % 100) as x, -2e1*floor(event_id/1e2) as y from events""",
    "fx_vertices": """select cast(floor(s_suppkey/1e2) as int) as river_id, cast(s_suppkey % 100 as int) as seq,
 2e1*(s_suppkey % 100) as x, -1e2 - 2e3*floor(s_suppkey/1e2) + 6e1*(s_suppkey % 7)/7e0 as y, s_acctbal/1e2 as z from supplier""",
    "fx_lines": "select s_suppkey as seg_id, n_name as name, 1e0 + (s_suppkey % 13) as len from supplier join nation on s_nationkey=n_nationkey",
    "fx_catalog": """select p_partkey as ord, concat(case when p_partkey % 11 = 0 then 'USGS Standard 1-meter ' when p_size % 6 = 0 then 'USGS 1 meter '
 when p_size % 6 = 1 then 'USGS 1/9 arc-second ' when p_size % 6 = 2 then 'Alaska 5 meter Mid-Accuracy ' when p_size % 6 = 3 then 'USGS 1/3 arc-second '
 when p_size % 6 = 4 then 'USGS 1 arc-second ' else 'IFSAR ' end, p_name) as title, concat('http://example.org/t', cast(p_partkey % 1500 as string), '.tif') as url,
 cast(cast(o_orderdate as date) as string) as pub_date, -1.2e2 + 5e-1*(p_partkey % 40) as min_x, 3e1 + 5e-1*floor((p_partkey % 1000)/4e1) as min_y,
 -1.192e2 + 5e-1*(p_partkey % 40) as max_x, 3.08e1 + 5e-1*floor((p_partkey % 1000)/4e1) as max_y from part join orders on o_orderkey=p_partkey""",
    "fx_mosaic_src": """select cast(l_orderkey % 100 as int) as px_row, cast(l_partkey % 100 as int) as px_col, case when l_linenumber = 1 then 's1m'
 when l_linenumber = 2 then 'midacc' when l_linenumber = 3 then 'ifsar' else 'project' end as class,
 l_orderkey as ord1, l_suppkey as ord2, case when l_returnflag='R' then null else l_quantity end as z from lineitem""",
    "fx_aoi": "select * from (values (0,2.05e2,-5e0),(1,1.505e3,-2.5e1),(2,1.755e3,-1.305e3),(3,9.05e2,-7.05e2),(4,1.05e2,-1.605e3)) t(seq,x,y)",
    "fx_aoi_edges": """select seq, x as x1, y as y1, coalesce(lead(x) over (order by seq), first_value(x) over (order by seq)) as x2,
 coalesce(lead(y) over (order by seq), first_value(y) over (order by seq)) as y2 from fx_aoi""",
    "fx_roads": "select * from (values (0,5e2,-1e3,5e2,1e2),(1,1.2e3,-1e3,1.3e3,1e2)) t(road_id,x1,y1,x2,y2)",
    "fx_region": "select * from (values (0,-1.19e2,3.1e1),(1,-1.05e2,3.2e1),(2,-1.02e2,4.05e1),(3,-1.1e2,3.6e1),(4,-1.18e2,4.1e1)) t(seq,x,y)",
}


def needs(sql: str) -> list[str]:
    """The fixture views that a text uses, directly or not, in the order of FX's dependencies."""
    found: list[str] = []
    for name in FX:
        if re.search(rf"\b{name}\b", sql) and name not in found:
            found += [x for x in needs(FX[name]) if x not in found] + [name]
    return found


def duck(sql: str) -> str:
    """A DuckDB text with the fixture views that it uses in front."""
    views = ", ".join(f"{n} as ({FX[n]})" for n in needs(sql))
    body = sql.strip()
    if not views:
        return body
    views = f"recursive {views}"
    return f"with {views}, {body[5:]}" if body[:5].lower() == "with " else f"with {views} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame."""
    tables = set(re.findall(r"\b(?:from|join) (events|supplier|nation|part|orders|lineitem)\b", " ".join(FX[n] for n in needs(name))))
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sorted(tables)}
    text = f"with {', '.join(f'{n} as ({FX[n]})' for n in needs(name))} select * from {name}"
    for t in frames:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **frames) if frames else spark.sql(text)
