"""Structural reports over the markup of the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog.registry import query
from quire.operators import shred, structure, tei
from quire.plans.runtime import read_table as _t

_TAGS = r"""WITH clean AS (SELECT source_file AS doc_id, id AS frag_id, node_ord, part_no,
  regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?</(?:script|style)\s*>', '\1', 'g') AS t
  FROM chunks WHERE contains(text, '<')),
tok AS (SELECT doc_id, frag_id, unnest(regexp_extract_all(t, '<([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>', 0)) AS token FROM clean),
tags AS (SELECT doc_id, frag_id, lower(regexp_extract(token, '<([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>', 1)) AS tag, regexp_extract(token, '<([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>', 2) AS attrs FROM tok),
pairs AS (SELECT doc_id, frag_id, tag, unnest(regexp_extract_all(attrs, '([a-zA-Z_:][a-zA-Z0-9_:.\-]*)="([^"]*)"', 0)) AS pair FROM tags),
attr AS (SELECT doc_id, frag_id, tag, lower(regexp_extract(pair, '([a-zA-Z_:][a-zA-Z0-9_:.\-]*)="([^"]*)"', 1)) AS name, regexp_extract(pair, '([a-zA-Z_:][a-zA-Z0-9_:.\-]*)="([^"]*)"', 2) AS value FROM pairs)
"""
_PUB = "pub AS (SELECT s.source_file AS doc_id, coalesce(p.publisher, 'Unknown') AS publisher FROM (SELECT DISTINCT source_file FROM chunks WHERE text IS NOT NULL) s LEFT JOIN (SELECT id, min(trim(publisher)) AS publisher FROM sample_data GROUP BY id) p ON p.id = left(s.source_file, 8))\n"


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return shred.open_tags(_t(spark, d, "chunks"), "source_file", "id", "text")


def _attrs(spark: SparkSession, d: str) -> DataFrame:
    return shred.attributes(_tags(spark, d))


def _publishers(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "chunks").where("text IS NOT NULL").select(F.col("source_file").alias("doc_id")).distinct()
    names = _t(spark, d, "sample_data").groupBy("id").agg(F.min(F.trim("publisher")).alias("publisher"))
    return files.withColumn("id", F.left("doc_id", F.lit(8))).join(names, "id", "left").select("doc_id", F.coalesce("publisher", F.lit("Unknown")).alias("publisher"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return shred.elements(_t(spark, d, "chunks"), "source_file", "id", "text")


@query(_TAGS + "SELECT tag, count(*) AS n FROM tags GROUP BY tag")
def tag_frequency(spark, d):
    return structure.most_common(structure.frequency(_tags(spark, d), "tag"), "tag")


@query(_TAGS + ", n AS (SELECT count(DISTINCT source_file) AS n_docs FROM chunks) SELECT tag, count(*) AS n, count(DISTINCT doc_id) AS n_with, round(count(DISTINCT doc_id) * 100.0 / any_value(n_docs), 2) AS percent FROM tags, n GROUP BY tag")
def tag_document_frequency(spark, d):
    return structure.document_frequency(_tags(spark, d), _t(spark, d, "chunks").agg(F.count_distinct("source_file").alias("n_docs")))


@query(_TAGS + "," + _PUB + ", tot AS (SELECT publisher, count(DISTINCT doc_id) AS n_docs FROM pub GROUP BY 1) SELECT publisher, tag, count(*) AS n, count(DISTINCT doc_id) AS n_with, round(count(DISTINCT doc_id) * 100.0 / any_value(n_docs), 2) AS percent FROM tags JOIN pub USING (doc_id) JOIN tot USING (publisher) GROUP BY publisher, tag")
def tag_document_frequency_by_publisher(spark, d):
    return structure.document_frequency_by(_tags(spark, d), _publishers(spark, d), "publisher")


@query(_TAGS + "SELECT name, count(*) AS n FROM attr GROUP BY name")
def attribute_frequency(spark, d):
    return structure.frequency(_attrs(spark, d), "name")


@query(_TAGS + "SELECT tag, name, count(*) AS n FROM attr GROUP BY ALL")
def tag_attribute_frequency(spark, d):
    return structure.frequency(_attrs(spark, d), "tag", "name")


@query(_TAGS + "SELECT tag || '@' || name || '=' || value AS entry, count(*) AS n FROM attr GROUP BY ALL")
def attribute_value_frequency(spark, d):
    return structure.frequency(_attrs(spark, d), F.concat("tag", F.lit("@"), "name", F.lit("="), "value").alias("entry"))


_LISTS = "name IN ('class', 'accesskey', 'dropzone') OR (tag IN ('a', 'link') AND name IN ('rel', 'rev')) OR (tag = 'area' AND name = 'rel') OR (tag IN ('td', 'th') AND name = 'headers')"


@query(_TAGS + f"""SELECT name, value, n, rank FROM (SELECT name, value, n, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM (SELECT name, value, count(*) AS n
  FROM (SELECT name, unnest(CASE WHEN {_LISTS} THEN list_filter(string_split_regex(value, '\\s+'), lambda x: x <> '') ELSE [value] END) AS value FROM attr) GROUP BY name, value)) WHERE rank <= 500""")
def attribute_value_topk(spark, d):
    """The commonest values of each attribute, entries of list values counted one by one."""
    return structure.top_per_group(structure.frequency(structure.split_values(_attrs(spark, d)), "name", "value"), "name", "value", 500)


@query(_TAGS + "SELECT tag, part AS class, count(*) AS n FROM (SELECT tag, unnest(string_split_regex(value, '\\s+')) AS part FROM attr WHERE name IN ('class', 'rend')) WHERE part <> '' GROUP BY ALL")
def class_frequency(spark, d):
    rows = _attrs(spark, d).where(F.col("name").isin("class", "rend")).select("tag", F.explode(F.split("value", r"\s+")).alias("class")).where(F.col("class") != "")
    return structure.frequency(rows, "tag", "class")


@query(_TAGS + """SELECT element, count(*) AS n FROM (SELECT '<' || array_to_string(list_prepend(tag, list_sort(regexp_extract_all(attrs, '([a-zA-Z_:][a-zA-Z0-9_:.\\-]*)="([^"]*)"', 0))), ' ') || '>' AS element FROM tags) GROUP BY ALL""".replace("\\\\", "\\"))
def distinct_element_inventory(spark, d):
    tags = _tags(spark, d)
    return structure.frequency(tags.select(structure.element_strings(tags, shred.ATTRIBUTE).alias("element")), "element")


@query(_TAGS + """, kinds AS (SELECT DISTINCT id AS frag_id, source_file AS doc_id, inferred_type AS value FROM chunks WHERE inferred_type IS NOT NULL)
SELECT tag, kind, name, value, count(*) AS n FROM (SELECT tag, CASE name WHEN 'rend' THEN 'rend' ELSE 'attribute' END AS kind, name, value FROM attr
UNION ALL SELECT tag, 'css', 'style', trim(split_part(part, ':', 1)) AS value FROM (SELECT tag, unnest(string_split(value, ';')) AS part FROM attr WHERE name = 'style') WHERE contains(part, ':') AND value <> ''
UNION ALL SELECT tag, 'type', 'inferred-type', value FROM tags JOIN kinds USING (doc_id, frag_id)) GROUP BY ALL""")
def tag_set_inventory(spark, d):
    kinds = _t(spark, d, "chunks").where("inferred_type IS NOT NULL").select(F.col("source_file").alias("doc_id"), F.col("id").alias("frag_id"), F.lit("inferred-type").alias("name"), F.col("inferred_type").alias("value")).distinct()
    return structure.tag_inventory(_tags(spark, d), _attrs(spark, d), kinds)


_GRAM = r"""WITH clean AS (SELECT {doc} AS doc_id, {order} regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?</(?:script|style)\s*>', '\1', 'g') AS t FROM {rows}),
tok AS (SELECT *, unnest(a) AS tag, generate_subscripts(a, 1) AS pos FROM (SELECT *, regexp_extract_all(lower(t), '<([a-z][a-z0-9]*)[^<>]*>', 1) AS a FROM clean) x),
g AS (SELECT {gram} AS ngram FROM tok WINDOW w AS (PARTITION BY {part} ORDER BY {by})) SELECT ngram, count(*) AS n FROM g WHERE ngram IS NOT NULL GROUP BY ALL"""
_ROWS = "(SELECT id, max(source_file) AS source_file, max(text) AS text, max(coalesce(node_ord, -1)) AS node_ord, max(coalesce(part_no, -1)) AS part_no FROM chunks WHERE id IS NOT NULL GROUP BY id)"
_BOOK = {"doc": "source_file", "order": "node_ord, part_no, id,", "rows": _ROWS, "part": "doc_id", "by": "node_ord, part_no, id, pos"}


@query(_GRAM.format(gram="tag || ' -> ' || lead(tag, 1) OVER w", **_BOOK))
def tag_bigram(spark, d):
    return structure.book_ngrams(_t(spark, d, "chunks"), 2)


@query(_GRAM.format(gram="tag || ' -> ' || lead(tag, 1) OVER w || ' -> ' || lead(tag, 2) OVER w", **_BOOK))
def tag_trigram(spark, d):
    return structure.book_ngrams(_t(spark, d, "chunks"), 3)


@query(_GRAM.format(gram="tag || ' -> ' || lead(tag, 1) OVER w", doc="r", order="", rows="(SELECT text, row_number() OVER () AS r FROM chunks)", part="doc_id", by="pos"))
def tag_cooccurrence_by_fragment(spark, d):
    return structure.fragment_ngrams(_t(spark, d, "chunks"), 2)


@query(_TAGS + "," + _PUB + "SELECT publisher, tag, n, rank FROM (SELECT publisher, tag, n, row_number() OVER (PARTITION BY publisher ORDER BY n DESC, tag) AS rank FROM (SELECT publisher, tag, count(*) AS n FROM tags JOIN pub USING (doc_id) GROUP BY publisher, tag)) WHERE rank <= 20")
def top_tags_per_publisher(spark, d):
    counts = structure.frequency(_tags(spark, d).join(_publishers(spark, d), "doc_id"), "publisher", "tag")
    return structure.top_per_group(counts, "publisher", "tag", 20)


@query(_TAGS + "," + _PUB + """, items AS (SELECT doc_id, tag AS item FROM tags UNION ALL SELECT doc_id, tag || '.' || unnest(list_filter(string_split_regex(value, '\\s+'), lambda x: x <> '')) FROM attr WHERE name = 'class')
SELECT * FROM (SELECT publisher, item, count(*) AS n FROM items JOIN pub USING (doc_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY publisher ORDER BY n DESC, item) <= 20""")
def top_items_per_publisher(spark, d):
    """Tags and classes together, the twenty commonest of each publisher."""
    items = structure.tag_and_class(_tags(spark, d), _attrs(spark, d)).join(_publishers(spark, d), "doc_id")
    return structure.top_per_group(structure.frequency(items, "publisher", "item"), "publisher", "item", 20).drop("rank")


@query(_TAGS + "SELECT tag, property, count(*) AS n FROM (SELECT tag, trim(split_part(unnest(string_split(value, ';')), ':', 1)) AS property FROM attr WHERE name = 'style') WHERE property <> '' GROUP BY ALL")
def css_properties(spark, d):
    return structure.css_properties(_attrs(spark, d))


@query(_TAGS + "SELECT tag, count(*) AS n FROM attr WHERE tag IN ('p', 'div') AND name = 'style' AND contains(value, 'text-indent') GROUP BY tag")
def text_indent_count(spark, d):
    return structure.frequency(_attrs(spark, d).where("tag IN ('p', 'div') AND name = 'style' AND contains(value, 'text-indent')"), "tag")


@query(_TAGS + "SELECT kind, value, count(*) AS n FROM (SELECT 'tag' AS kind, tag AS value FROM tags UNION ALL SELECT 'attribute', name FROM attr UNION ALL SELECT 'rend', value FROM attr WHERE name = 'rend') GROUP BY ALL")
def global_inventory(spark, d):
    tags, attrs = _tags(spark, d), _attrs(spark, d)
    parts = tags.select(F.lit("tag").alias("kind"), F.col("tag").alias("value"))
    parts = parts.unionByName(attrs.select(F.lit("attribute").alias("kind"), F.col("name").alias("value"))).unionByName(attrs.where("name = 'rend'").select(F.lit("rend").alias("kind"), "value"))
    return structure.frequency(parts, "kind", "value")


@query(_TAGS + "SELECT tag, count(*) AS n FROM tags GROUP BY tag")
def element_frequency(spark, d):
    """The shredder's count, a cross-check of the native one."""
    return structure.frequency(_elements(spark, d), "tag")


# the given fragments are properly nested, so depths and parents follow from counting open tags
_TREE = r"""WITH RECURSIVE frag AS (SELECT row_number() OVER () AS f, source_file AS doc_id, regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?</(?:script|style)\s*>', '\1', 'g') AS t FROM chunks WHERE contains(text, '<')),
tok AS (SELECT f, doc_id, unnest(regexp_extract_all(t, '</?[a-zA-Z][^<>]*>', 0)) AS k, generate_subscripts(regexp_extract_all(t, '</?[a-zA-Z][^<>]*>', 0), 1) AS pos FROM frag),
kinds AS (SELECT f, doc_id, pos, lower(regexp_extract(k, '^</?([a-zA-Z][a-zA-Z0-9:._-]*)', 1)) AS tag, CASE WHEN starts_with(k, '</') THEN -1 WHEN regexp_matches(k, '/\s*>$') OR tag IN ('area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr') THEN 0 ELSE 1 END AS s FROM tok),
d AS (SELECT *, sum(s) OVER (PARTITION BY f ORDER BY pos) AS after FROM kinds),
e AS (SELECT f, doc_id, pos, tag, CASE s WHEN 1 THEN after ELSE after + 1 END AS depth, s FROM d WHERE s >= 0),
o AS (SELECT f, pos, tag, depth FROM e WHERE s = 1),
el AS (SELECT e.f, e.doc_id, e.pos, e.tag, o.pos AS parent_pos, coalesce(o.tag, '[document]') AS parent FROM e ASOF LEFT JOIN o ON e.f = o.f AND o.depth = e.depth - 1 AND e.pos > o.pos)
"""


@query(_TREE + "SELECT tag AS child, parent, count(*) AS n FROM el WHERE tag IN ('div', 'p', 'head', 'list', 'item', 'table', 'row', 'cell', 'figure') GROUP BY ALL")
def parent_child(spark, d):
    return structure.parent_child(_elements(spark, d))


@query(_TREE + "," + _PUB + "SELECT publisher, tag AS child, parent, count(*) AS n FROM el JOIN pub USING (doc_id) WHERE tag IN ('p', 'img', 'table', 'div', 'span', 'h1') GROUP BY ALL")
def parent_child_by_publisher(spark, d):
    rows = _elements(spark, d).join(_publishers(spark, d), "doc_id")
    return structure.parent_child(rows, structure.STRUCTURAL_BY_PUBLISHER, "publisher")


@query(_TREE + """, up AS (SELECT f, pos, tag, parent_pos AS above FROM el WHERE tag IN ('div', 'list') UNION ALL SELECT up.f, up.pos, up.tag, el.parent_pos FROM up JOIN el ON el.f = up.f AND el.pos = up.above),
inside AS (SELECT DISTINCT up.f, up.pos FROM up JOIN el ON el.f = up.f AND el.pos = up.above WHERE el.tag = up.tag),
down AS (SELECT f, pos AS outer_pos, pos, tag, 1 AS n FROM el WHERE tag IN ('div', 'list') AND (f, pos) NOT IN (SELECT (f, pos) FROM inside) UNION ALL SELECT down.f, outer_pos, el.pos, down.tag, n + 1 FROM down JOIN el ON el.f = down.f AND el.parent_pos = down.pos AND el.tag = down.tag)
SELECT tag, max(m)::BIGINT AS max_depth, round(avg(m), 2) AS mean_depth, count(*) AS n_chains FROM (SELECT f, outer_pos, tag, max(n) AS m FROM down GROUP BY ALL) GROUP BY tag""")
def nesting_depth(spark, d):
    return structure.nesting_depth(_elements(spark, d))


@query()
def heading_context(spark, d):
    return structure.heading_context(_t(spark, d, "chunks"), "source_file", "id", "text")


@query()
def tei_convert(spark, d):
    return tei.convert(_t(spark, d, "chunks"), "id", "text", "inferred_type")


@query()
def tei_divs(spark, d):
    return tei.convert(_t(spark, d, "chunks").where(F.col("text").contains("<div")), "id", "text", None, "divs")


@query()
def tei_books(spark, d):
    return tei.convert(_t(spark, d, "book_json"), "record_id", "body", None, "book")


@query()
def html_books(spark, d):
    return tei.convert(_t(spark, d, "book_json"), "record_id", "body", None, "page")


@query()
def tei_coverage(spark, d):
    return tei.coverage(_t(spark, d, "chunks"), "id", "text")


_SNIPPETS = r"""WITH clean AS (SELECT DISTINCT id, regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?</(?:script|style)\s*>', '\1', 'g') AS t FROM chunks WHERE contains(text, '<')),
tok AS (SELECT id, unnest(regexp_extract_all(t, '<([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>', 0)) AS token, generate_subscripts(regexp_extract_all(t, '<([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>', 0), 1) - 1 AS pos FROM clean),
r AS (SELECT lower(regexp_extract(token, '<([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>', 1)) AS tag, id, pos, token FROM tok)
SELECT tag, id, pos::BIGINT AS pos, token FROM r QUALIFY row_number() OVER (PARTITION BY tag ORDER BY id NULLS FIRST, pos, token) <= 100"""


@query(_SNIPPETS)
def tag_snippets(spark, d):
    """The first hundred opening tags of each name, in order of ids and positions."""
    return structure.snippets(_t(spark, d, "chunks"), 100)
