"""Book records: nested shredding, tree walks and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog.chunks import STRATEGY_VALUES, UNITS_SQL
from quire.catalog.registry import query
from quire.operators import chunking, flatten, metadata, nested, relabel, tei, tree
from quire.plans.runtime import read_table as _t

_NODES = """WITH RECURSIVE start AS (SELECT record_id, source_file, body, json_extract(body, '$.content') AS c FROM book_json WHERE body IS NOT NULL AND json_valid(body) AND json_type(body) = 'OBJECT'),
first AS (SELECT record_id, json_type(c) = 'OBJECT' AS single, CASE json_type(c) WHEN 'ARRAY' THEN json_extract(c, '$[*]') WHEN 'OBJECT' THEN [c] ELSE [] END AS a FROM start),
w AS (
  SELECT record_id, (generate_subscripts(a, 1) - 1)::VARCHAR AS node_path, '' AS parent_path, CASE WHEN single THEN '' ELSE printf('_%02d', generate_subscripts(a, 1)) END AS suffix, single, 1 AS depth, unnest(a) AS node FROM first
  UNION ALL
  SELECT record_id, parent || '/' || (generate_subscripts(a, 1) - 1), parent, suffix || CASE WHEN single THEN '' ELSE printf('_%02d', generate_subscripts(a, 1)) END, single, depth + 1, unnest(a) FROM (
    SELECT record_id, node_path AS parent, suffix, depth, json_type(node, '$.content') = 'OBJECT' AS single, CASE json_type(node, '$.content') WHEN 'ARRAY' THEN json_extract(node, '$.content[*]') WHEN 'OBJECT' THEN [json_extract(node, '$.content')] ELSE [] END AS a
    FROM w WHERE json_type(node) = 'OBJECT') x
), nodes AS (SELECT *, json_extract_string(node, '$.text') AS text FROM w WHERE json_type(node) = 'OBJECT')
"""
_NB = r"[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]"
_ROOT = "SELECT record_id, '' AS node_path, json_extract_string(body, '$.text') AS text FROM start"


@query(_NODES + "SELECT record_id, node_path, parent_path FROM nodes")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.find_nodes(_t(spark, d, "book_json"))


@query("SELECT record_id, source_file, json_extract_string(body, '$.title') AS title, json_extract(body, '$.processing_log.is_collection')::VARCHAR = 'true' AS is_collection FROM book_json WHERE body IS NOT NULL AND json_valid(body)")
def p6_books(spark, d):
    rows = nested.shred(_t(spark, d, "book_json"), "book")["book"]
    return rows.select("record_id", "source_file", "title", "is_collection")


@query("""WITH v AS (SELECT record_id, json_extract(body, '$.epub_metadata') AS m FROM book_json WHERE body IS NOT NULL AND json_valid(body)),
f AS (SELECT record_id, unnest(json_keys(m)) AS name, m FROM v WHERE json_type(m) = 'OBJECT'),
x AS (SELECT record_id, name, json_extract(m, '$."' || name || '"') AS j FROM f),
e AS (SELECT record_id, name, CASE json_type(j) WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'scalar' END AS kind, unnest(CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') WHEN 'NULL' THEN [] ELSE [j] END) AS v,
  unnest(CASE json_type(j) WHEN 'ARRAY' THEN range(json_array_length(j)::BIGINT) WHEN 'NULL' THEN [] ELSE [0] END) AS position FROM x)
SELECT record_id, name || '/' || position AS key, position::BIGINT AS position, name, kind, CASE WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(v, '$') END AS value FROM e""")
def p6_metadata(spark, d):
    """Metadata values; objects, whose JSON text both engines write in another way, are left out of the comparison."""
    rows = nested.shred(_t(spark, d, "book_json"), "metadata")["metadata"]
    return rows.select("record_id", "key", "position", "name", "kind", F.when(~F.col("nested"), F.col("value")).alias("value"))


@query(_NODES + "SELECT record_id, node_path, depth::BIGINT AS depth, json_extract_string(node, '$.type') AS type, json_extract_string(node, '$.href') AS href, json_extract_string(node, '$.title') AS title, json_extract_string(node, '$.inferred-type') AS inferred_type, md5(text) AS text_md5 FROM nodes")
def p6_nodes(spark, d):
    rows = nested.shred(_t(spark, d, "book_json"), "node")["node"]
    return rows.select("record_id", F.col("key").alias("node_path"), "depth", "type", "href", "title", "inferred_type", F.md5("text").alias("text_md5"))


@query(_NODES + "SELECT record_id, node_path, (k - 1)::BIGINT AS position, json_extract_string(i, '$') AS url FROM (SELECT record_id, node_path, unnest(json_extract(node, '$.images[*]')) AS i, generate_subscripts(json_extract(node, '$.images[*]'), 1) AS k FROM nodes WHERE json_type(node, '$.images') = 'ARRAY')")
def p6_images(spark, d):
    rows = nested.shred(_t(spark, d, "book_json"), "image")["image"]
    return rows.select("record_id", F.col("parent_key").alias("node_path"), "position", "url")


@query("""WITH v AS (SELECT record_id, json_extract(body, '$.processing_log.component_log') AS l FROM book_json WHERE body IS NOT NULL AND json_valid(body)),
e AS (SELECT record_id, unnest(json_extract(l, '$[*]')) AS e, unnest(range(json_array_length(l)::BIGINT)) AS position FROM v WHERE json_type(l) = 'ARRAY')
SELECT record_id, position::BIGINT AS position, json_extract_string(e, '$.step') AS step, array_to_string(json_extract_string(e, '$.added_fields[*]'), ',') AS added_fields FROM e""")
def p6_logs(spark, d):
    rows = nested.shred(_t(spark, d, "book_json"), "log")["log"]
    return rows.select("record_id", "position", "step", F.array_join("added_fields", ",").alias("added_fields"))


@query("SELECT record_id FROM book_json WHERE body IS NULL OR NOT json_valid(body)")
def p6_rejects(spark, d):
    return nested.shred(_t(spark, d, "book_json"), "reject")["reject"]


_TREE = r"""WITH v AS (SELECT record_id, body FROM book_json WHERE body IS NOT NULL AND json_valid(body)),
t AS (SELECT record_id, x.key, x.value, x.type, x.id, x.parent, x.fullkey FROM v, json_tree(v.body) x),
k AS (SELECT t.*, u.type AS above, 'root' || regexp_replace(regexp_replace(replace(substr(t.fullkey, 2), '"', ''), '\[\d+\]', '', 'g'), '(\.content)+', '.content', 'g') AS tag,
  t.record_id || replace(replace(replace(replace(substr(t.fullkey, 2), '"', ''), '.', '/'), '[', '/'), ']', '') AS pk
  FROM t LEFT JOIN t u ON u.record_id = t.record_id AND u.id = t.parent),
rows AS (SELECT *, CASE WHEN parent IS NULL THEN NULL WHEN above = 'ARRAY' THEN regexp_replace(pk, '/[^/]+/\d+$', '') ELSE regexp_replace(pk, '/[^/]+$', '') END AS parent_pk, CASE WHEN above = 'ARRAY' THEN regexp_extract(pk, '\d+$')::BIGINT ELSE 0 END AS position
  FROM k WHERE parent IS NULL OR above = 'ARRAY' OR (type = 'OBJECT' AND value::VARCHAR <> '{}'))
"""


@query(_TREE + "SELECT tag, pk, parent_pk, position FROM rows UNION ALL SELECT 'rejects', record_id::VARCHAR, NULL, 0 FROM book_json WHERE body IS NULL OR NOT json_valid(body)")
def p6_flat_links(spark, d):
    """The general form: every object and array entry of the records with the table it is in and its parent."""
    return flatten.emit(_t(spark, d, "book_json"), "record_id", "body").select("tag", "pk", "parent_pk", "position")


@query(_TREE + r""", f AS (SELECT CASE WHEN above = 'ARRAY' THEN tag ELSE regexp_replace(tag, '\.[^.]+$', '') END AS tag, CASE WHEN above = 'ARRAY' THEN 'value' ELSE key END AS field,
  CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'double' ELSE 'bigint' END AS kind FROM k WHERE parent IS NOT NULL AND type NOT IN ('OBJECT', 'ARRAY', 'NULL'))
SELECT tag, field, kind, count(*) AS n FROM f GROUP BY ALL""")
def p6_flat_fields(spark, d):
    """Fields of the general form's tables with their kinds."""
    rows = flatten.emit(_t(spark, d, "book_json"), "record_id", "body").select("tag", F.explode("kinds").alias("k"))
    return rows.groupBy("tag", F.substring_index("k", ":", 1).alias("kind"), F.expr("substring(k, instr(k, ':') + 1)").alias("field")).agg(F.count("*").alias("n"))


@query(_TREE + """SELECT pk, parent_pk, position, json_extract_string(value, '$.href') AS href, json_extract_string(value, '$.title') AS title, md5(json_extract_string(value, '$.text')) AS text_md5 FROM rows WHERE tag = 'root.content' AND type IN ('OBJECT', 'NULL')""")
def p6_flat_content(spark, d):
    """The content table of the general form, with its schema taken from the records."""
    emitted = flatten.emit(_t(spark, d, "book_json"), "record_id", "body")
    rows = flatten.table(emitted, "root.content")
    if "value" in rows.columns:  # entries that are no objects
        rows = rows.where("value IS NULL")
    return rows.select("pk", "parent_pk", "position", F.col("href").cast("string").alias("href"), F.col("title").cast("string").alias("title"), F.md5("text").alias("text_md5"))


@query(_NODES + f"SELECT record_id, node_path, md5(text) AS text_md5 FROM (SELECT record_id, node_path, text FROM nodes UNION ALL {_ROOT}) WHERE text <> ''")
def walk_content(spark, d):
    return tree.walk(_t(spark, d, "book_json"), "content").select("record_id", "node_path", F.md5("text").alias("text_md5"))


@query(_NODES + "SELECT record_id, node_path, md5(text) AS text_md5 FROM nodes WHERE text <> '' AND NOT single")
def walk_lists(spark, d):
    return tree.walk(_t(spark, d, "book_json"), "lists").select("record_id", "node_path", F.md5("text").alias("text_md5"))


@query(_NODES + "SELECT record_id, node_path, md5(text) AS text_md5 FROM nodes WHERE text <> '' AND NOT single AND depth = 1")
def walk_top(spark, d):
    return tree.walk(_t(spark, d, "book_json"), "top").select("record_id", "node_path", F.md5("text").alias("text_md5"))


_FLAT = _NODES + f", flat AS (SELECT record_id, replace(source_file, '.json', '') || suffix AS base_id, source_file, node_path, inferred_type, text FROM (SELECT record_id, suffix, node_path, json_extract_string(node, '$.inferred-type') AS inferred_type, text FROM nodes UNION ALL SELECT record_id, '', '', NULL, text FROM ({_ROOT})) JOIN start USING (record_id) WHERE regexp_matches(text, '{_NB}'))\n"


@query(_FLAT + "SELECT record_id, base_id, inferred_type, md5(text) AS text_md5 FROM flat")
def flatten_tree(spark, d):
    return tree.flatten_with_ids(_t(spark, d, "book_json")).select("record_id", "base_id", "inferred_type", F.md5("text").alias("text_md5"))


_CORPUS = _FLAT + ", c AS (SELECT base_id AS id, source_file, inferred_type, text FROM flat), " + UNITS_SQL.removeprefix("WITH ").replace("FROM chunks", "FROM c")


def _corpus_units(spark: SparkSession, d: str) -> DataFrame:
    return chunking.work_units(tree.flatten_with_ids(_t(spark, d, "book_json")), "base_id", "source_file", "text", "inferred_type")


@query(_CORPUS + "SELECT id, source_file, inferred_type, strategy, status, part_no::BIGINT AS part_no, md5(html) AS html_md5 FROM units")
def corpus_work_units(spark, d):
    """The documented run: records to nodes with ids to work units."""
    return _corpus_units(spark, d).select("id", "source_file", "inferred_type", "strategy", "status", "part_no", F.md5("html").alias("html_md5"))


@query(_CORPUS + f"SELECT s AS strategy, count(units.id) AS chunk_count FROM (VALUES {STRATEGY_VALUES}) v(s) LEFT JOIN units ON strategy = s GROUP BY s UNION ALL SELECT 'total', count(*) FROM units")
def corpus_strategy_aggregate(spark, d):
    return chunking.strategy_aggregate(_corpus_units(spark, d))


@query(_TREE + """, f AS (SELECT CASE WHEN above = 'ARRAY' THEN tag ELSE regexp_replace(tag, '\\.[^.]+$', '') END AS tag, CASE WHEN above = 'ARRAY' THEN 'value' ELSE key END AS field, json_extract_string(value, '$') AS value
  FROM k WHERE parent IS NOT NULL AND type NOT IN ('OBJECT', 'ARRAY', 'NULL'))
SELECT tag, field, count(*) AS n, min(left(value, 80)) AS example FROM f GROUP BY ALL""")
def structure_description(spark, d):
    """Fields of the records at any depth, how often they have a value, and an example."""
    return flatten.describe(flatten.emit(_t(spark, d, "book_json"), "record_id", "body"))


@query(_NODES + """, c AS (SELECT n.record_id, source_file, node_path, depth, json_extract_string(node, '$.inferred-type') AS inferred_type, coalesce(json_extract(s.body, '$.processing_log.is_collection')::VARCHAR = 'true', false) AS coll FROM nodes n JOIN start s USING (record_id) WHERE n.text <> '')
SELECT record_id, source_file || '_' || CASE WHEN coll THEN split_part(node_path, '/', 1)::BIGINT + 1 ELSE 0 END || '_' || CASE WHEN coll THEN split_part(node_path, '/', 2) ELSE node_path END AS chunk_id, inferred_type FROM c WHERE depth = CASE WHEN coll THEN 2 ELSE 1 END""")
def collection_chunks(spark, d):
    return tree.collection_chunks(_t(spark, d, "book_json"))


_PUB = """WITH v AS (SELECT record_id, json_extract(body, '$.epub_metadata.publisher') AS p FROM book_json WHERE body IS NOT NULL AND json_valid(body)),
e AS (SELECT record_id, unnest(CASE json_type(p) WHEN 'ARRAY' THEN json_extract_string(p, '$[*]') WHEN 'NULL' THEN [] ELSE [json_extract_string(p, '$')] END) AS publisher FROM v WHERE p IS NOT NULL), f AS (SELECT * FROM e WHERE publisher <> '')
"""


@query(_PUB + "SELECT publisher, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT '(missing)', count(*) FROM v WHERE record_id NOT IN (SELECT record_id FROM f)")
def publisher_frequency_with_missing(spark, d):
    return metadata.publisher_frequency(_t(spark, d, "book_json"))


@query("""WITH v AS (SELECT record_id, json_extract(body, '$.epub_metadata.publisher') AS p FROM book_json WHERE body IS NOT NULL AND json_valid(body))
SELECT record_id, coalesce(nullif(CASE json_type(p) WHEN 'ARRAY' THEN json_extract_string(p, '$[0]') WHEN 'NULL' THEN NULL ELSE json_extract_string(p, '$') END, ''), '__UNKNOWN_PUBLISHER__') AS publisher FROM v""")
def first_publisher(spark, d):
    return metadata.first_publisher(_t(spark, d, "book_json"))


@query("""WITH v AS (SELECT json_extract(body, '$.epub_metadata') AS m FROM book_json WHERE body IS NOT NULL AND json_valid(body)),
k AS (SELECT unnest(json_keys(m)) AS metadata_key FROM v WHERE json_type(m) = 'OBJECT')
SELECT metadata_key, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT '(none)', count(*) FROM v WHERE m IS NULL OR json_type(m) <> 'OBJECT'""")
def metadata_key_frequency(spark, d):
    return metadata.key_frequency(_t(spark, d, "book_json"))


@query(_NODES + "SELECT 'inferred-type' AS kind, json_extract_string(node, '$.inferred-type') AS value, count(*) AS n FROM nodes WHERE value IS NOT NULL GROUP BY ALL UNION ALL SELECT 'true-type', json_extract_string(node, '$.true-type') AS value, count(*) FROM nodes WHERE value IS NOT NULL GROUP BY ALL UNION ALL SELECT 'metadata', value, count(*) FROM (SELECT unnest(json_keys(body, '$.epub_metadata')) AS value FROM start) GROUP BY ALL UNION ALL SELECT 'added-field', value, count(*) FROM (SELECT unnest(json_extract_string(e, '$.added_fields[*]')) AS value FROM (SELECT unnest(json_extract(body, '$.processing_log.component_log[*]')) AS e FROM start)) GROUP BY ALL")
def record_inventory(spark, d):
    """Distinct types, metadata keys and logged fields, with their counts."""
    t = nested.shred(_t(spark, d, "book_json"), "node", "book", "log")
    parts = [t["node"].select(F.lit("inferred-type").alias("kind"), F.col("inferred_type").alias("value")), t["node"].select(F.lit("true-type").alias("kind"), F.col("true_type").alias("value")), t["book"].select(F.lit("metadata").alias("kind"), F.explode("meta_keys").alias("value")), t["log"].select(F.lit("added-field").alias("kind"), F.explode("added_fields").alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value IS NOT NULL").groupBy("kind", "value").agg(F.count("*").alias("n"))


@query(_NODES + "SELECT s.record_id, coalesce(json_extract(s.body, '$.processing_log.is_collection')::VARCHAR = 'true', false) AS logged, coalesce(sec, false) AS by_section FROM start s LEFT JOIN (SELECT record_id, bool_or(json_extract_string(node, '$.type') = 'Section') AS sec FROM nodes WHERE depth = 1 GROUP BY 1) USING (record_id)")
def collection_detection(spark, d):
    """Collections by the log's flag and by a section among the top-level entries."""
    t = nested.shred(_t(spark, d, "book_json"), "node", "book")
    sections = t["node"].where("depth = 1").groupBy("record_id").agg(F.bool_or(F.coalesce(F.col("type") == "Section", F.lit(False))).alias("s"))
    return t["book"].select("record_id", F.coalesce("is_collection", F.lit(False)).alias("logged")).join(sections, "record_id", "left").select("record_id", "logged", F.coalesce("s", F.lit(False)).alias("by_section"))


@query()
def volume_pages(spark, d):
    return tei.book_volumes(_t(spark, d, "book_json"))


@query()
def label_books(spark, d):
    """Gold labels written back into the records."""
    gold = _t(spark, d, "eval_results").select("id", F.col("gold_label").alias("label"))
    return relabel.label_books(_t(spark, d, "book_json"), gold)


@query(_NODES + r""", ids AS (SELECT DISTINCT id FROM eval_results),
p AS (SELECT id, CASE WHEN regexp_matches(id, '^(.+)_(\d+)_(\d+)$') THEN regexp_extract(id, '^(.+)_(\d+)_(\d+)$', 1) END AS f, try_cast(nullif(regexp_extract(id, '^(.+)_(\d+)_(\d+)$', 2), '') AS BIGINT) AS b, nullif(regexp_extract(id, '^(.+)_(\d+)_(\d+)$', 3), '') AS c FROM ids),
newest AS (SELECT source_file, max(record_id) AS record_id FROM book_json WHERE body IS NOT NULL AND json_valid(body) GROUP BY 1)
SELECT id, json_extract_string(node, '$.inferred-type') AS inferred_type, CASE WHEN f IS NULL THEN 'bad id' WHEN newest.record_id IS NULL THEN 'no file' WHEN nodes.record_id IS NULL THEN 'no position' END AS problem
FROM p LEFT JOIN newest ON source_file = f LEFT JOIN nodes ON nodes.record_id = newest.record_id AND node_path = CASE WHEN b = 0 THEN c::BIGINT::VARCHAR ELSE (b - 1) || '/' || c::BIGINT END""".replace("\\\\d", "\\d"))
def inferred_type_lookup(spark, d):
    return relabel.lookup_types(_t(spark, d, "eval_results"), _t(spark, d, "book_json"))
