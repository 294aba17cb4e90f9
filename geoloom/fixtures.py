"""Views that give the test tables the shape of map data.

The SQL is the same for Spark and for other engines: names in braces are
tables or earlier views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "fx_nodes": """
SELECT 'https://www.openstreetmap.org/node/' || cast(n AS string) AS entity_id, n AS num, lon_e5, lat_e5,
       'POINT(4.' || cast(lon_e5 AS string) || ' 45.' || cast(lat_e5 AS string) || ')' AS wkt
FROM (SELECT n, 80000 + (n * 7919) % 10000 AS lon_e5, 74000 + (n * 104729) % 10000 AS lat_e5
      FROM (SELECT 1000000 + s_suppkey AS n FROM {supplier}
            UNION ALL SELECT 2000000 + c_custkey AS n FROM {customer}) k) p""",
    "fx_tags": """
SELECT 'https://www.openstreetmap.org/node/' || cast(n AS string) AS entity_id, key, value, ord
FROM (SELECT 1000000 + s_suppkey AS n, 'amenity' AS key,
             CASE s_suppkey % 5 WHEN 0 THEN 'vending_machine' WHEN 1 THEN 'bicycle_parking'
                  WHEN 2 THEN 'bench' WHEN 3 THEN 'cafe' ELSE 'drinking_water' END AS value, 2 AS ord FROM {supplier}
      UNION ALL SELECT 1000000 + s_suppkey, 'capacity', cast(s_suppkey % 40 AS string),
             CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 3 END FROM {supplier} WHERE s_suppkey % 5 = 1
      UNION ALL SELECT 1000000 + s_suppkey, 'cuisine', 'pizza',
             CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 3 END FROM {supplier} WHERE s_suppkey % 5 = 3
      UNION ALL SELECT 1000000 + s_suppkey, 'ref', s_name, 6 FROM {supplier}
      UNION ALL SELECT 1000000 + s_suppkey, 'tram', 'yes', 4 FROM {supplier} WHERE s_suppkey % 7 = 0
      UNION ALL SELECT 1000000 + s_suppkey, 'level',
             CASE s_suppkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '1;2' ELSE '2' END, 5 FROM {supplier}
      UNION ALL SELECT 2000000 + c_custkey, 'segment', lower(c_mktsegment), 1 FROM {customer}) t""",
    "fx_ways": """
SELECT 'https://www.openstreetmap.org/way/' || cast(a.num + 1000000 AS string) AS entity_id,
       CASE WHEN a.num % 4 = 0 THEN
         'POLYGON((4.' || cast(a.lon_e5 - 50 AS string) || ' 45.' || cast(a.lat_e5 - 50 AS string)
         || ',4.' || cast(a.lon_e5 + 50 AS string) || ' 45.' || cast(a.lat_e5 - 50 AS string)
         || ',4.' || cast(a.lon_e5 + 50 AS string) || ' 45.' || cast(a.lat_e5 + 50 AS string)
         || ',4.' || cast(a.lon_e5 - 50 AS string) || ' 45.' || cast(a.lat_e5 + 50 AS string)
         || ',4.' || cast(a.lon_e5 - 50 AS string) || ' 45.' || cast(a.lat_e5 - 50 AS string) || '))'
       ELSE 'LINESTRING(4.' || cast(a.lon_e5 AS string) || ' 45.' || cast(a.lat_e5 AS string)
         || ',4.' || cast(b.lon_e5 AS string) || ' 45.' || cast(b.lat_e5 AS string) || ')' END AS wkt,
       a.num + 1000000 AS num, a.entity_id AS first_node, b.entity_id AS last_node
FROM {fx_nodes} a JOIN {fx_nodes} b ON b.num = a.num + 1 WHERE a.num >= 2000000""",
    "fx_tag_usage": """
SELECT key, value, count(*) AS n FROM (
      SELECT 'returnflag' AS key, l_returnflag AS value FROM {lineitem}
      UNION ALL SELECT 'part_type', lower(p_type) FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
      UNION ALL SELECT 'event', event_type FROM {events}) u GROUP BY key, value""",
    "fx_wiki_pages": """
SELECT 'Tag:' || source || '=v' || cast(doc_id AS string) AS title,
       '{{{{ValueDescription' || chr(10) || '|description=' || text || chr(10)
       || '|combination={{{{Tag|capacity}}}} {{{{Tag|fee|yes}}}}' || chr(10) || '}}}}' AS wikitext
FROM {documents}""",
    "fx_job_pages": """
SELECT 'Key:' || key AS title, '{{{{KeyDescription' || chr(10) || CASE key WHEN 'event' THEN '' ELSE '|description=About ' || key || chr(10) END
       || '|onNode=' || CASE key WHEN 'part_type' THEN 'yes' ELSE 'no' END || chr(10) || '}}}}' AS wikitext
FROM (SELECT DISTINCT key FROM {fx_tag_usage}) k
UNION ALL SELECT 'Tag:' || key || '=' || value, '{{{{ValueDescription' || chr(10) || '|description=A ' || value || chr(10)
       || '|combination={{{{Tag|fee}}}} {{{{Tag|opening_hours|x}}}}' || chr(10) || '}}}}'
FROM {fx_tag_usage} WHERE length(value) % 2 = 0""",
    "fx_moved_pages": """
SELECT title, CASE WHEN title = 'Key:returnflag' THEN '#REDIRECT [[Key:part type old]]' ELSE wikitext END AS wikitext FROM {fx_job_pages}
UNION ALL SELECT 'Key:part type old', '#redirect: [[Key:part_type#Values]]' FROM {region} WHERE r_regionkey = 0
UNION ALL SELECT 'Tag:' || source || '=v' || cast(doc_id AS string),
       CASE WHEN doc_id % 10 IN (1, 2, 3) THEN '#REDIRECT [[Tag:step=v' || cast(doc_id + 1 AS string) || ']]' WHEN doc_id % 10 = 7 THEN '#REDIRECT [[Tag:gone=v' || cast(doc_id AS string) || ']]' ELSE text END FROM {documents}
UNION ALL SELECT 'Tag:step=v' || cast(doc_id AS string),
       CASE doc_id % 10 WHEN 5 THEN '#REDIRECT [[Tag:step=v' || cast(doc_id + 1 AS string) || ']]' WHEN 6 THEN '#REDIRECT [[Tag:step=v' || cast(doc_id - 1 AS string) || ']]'
         WHEN 4 THEN 'the end' WHEN 9 THEN '#REDIRECT [[Tag:step=v' || cast(doc_id - 3 AS string) || ']]' ELSE '#REDIRECT [[Tag:step=v' || cast(doc_id + 1 AS string) || '|label]]' END
FROM {documents} WHERE doc_id % 10 IN (2, 3, 4, 5, 6, 9)""",
    "fx_way_tags": """
SELECT entity_id, 'building' AS key, 'university' AS value, 1 AS ord FROM {fx_ways} WHERE num % 4 = 0
UNION ALL SELECT entity_id, 'name', 'Hall ' || cast(num AS string), 2 FROM {fx_ways} WHERE num % 4 = 0
UNION ALL SELECT entity_id, 'highway', 'footway', 1 FROM {fx_ways} WHERE num % 4 <> 0
UNION ALL SELECT entity_id, 'level', CASE num % 3 WHEN 0 THEN '0' WHEN 1 THEN '1;2' ELSE '2;3' END, 3 FROM {fx_ways}""",
    "fx_way_nodes": """
SELECT entity_id AS way_id, first_node AS node_id, 1 AS ord FROM {fx_ways}
UNION ALL SELECT entity_id, last_node, 2 FROM {fx_ways}
UNION ALL SELECT w.entity_id, n.entity_id, 3 FROM {fx_ways} w JOIN {fx_nodes} n ON n.num = w.num - 999998""",
    "fx_schemes": """
SELECT iri, osm_key FROM (VALUES ('Amenity','amenity'), ('Building','building'), ('Highway','highway'),
       ('Level','level'), ('Tram','tram'), ('Capacity','capacity'), ('Cuisine','cuisine'), ('Name','name')) v(iri, osm_key)""",
    "fx_concepts": """
SELECT iri, scheme, osm_value FROM (VALUES ('AmenityVendingMachine','Amenity','vending_machine'),
       ('AmenityBicycleParking','Amenity','bicycle_parking'), ('AmenityBench','Amenity','bench'),
       ('AmenityCafe','Amenity','cafe'), ('CuisinePizza','Cuisine','pizza'), ('BuildingUniversity','Building','university'),
       ('HighwayFootway','Highway','footway')) v(iri, scheme, osm_value)""",
    "fx_tuics": """
SELECT property, concept, osm_id FROM (VALUES ('hasBicycleParkingCapacity','AmenityBicycleParking','capacity'),
       ('hasUniversityName','BuildingUniversity','name'), ('hasCafeCuisine','AmenityCafe','cuisine')) v(property, concept, osm_id)""",
}


def names_in(sql: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def sql_on(spark: SparkSession, sf_dir: str, sql: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """The DataFrame of a statement over tables and views named in braces."""
    made = {} if made is None else made
    for name in names_in(sql):
        if name not in made:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet") if name in TABLES else sql_on(spark, sf_dir, VIEWS[name], made)
    return spark.sql(sql, **{name: made[name] for name in names_in(sql)})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql_on(spark, sf_dir, VIEWS[name])


def standalone(sql: str) -> str:
    """The statement for another engine, the views it needs as common table expressions."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in names_in(text):
            if name in VIEWS and name not in needed:
                add(VIEWS[name])
                needed.append(name)

    add(sql)
    plain = lambda text: text.format(**{n: n for n in names_in(text)})
    parts = [f"{n} AS ({plain(VIEWS[n])})" for n in needed]
    body = plain(sql).strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:]]) if parts else body
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
