"""Structural reports over open tags and elements: frequencies, spread, n-grams, nesting, inventories."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.shred import COMMENTS, OPEN_TAG, RAW_BODIES
from quire.operators.tei import Node, markup, parse
from quire.plans.runtime import cut, numbered

#: Tags that count as structure in the parent-child report, those of the report by publisher, and headings.
STRUCTURAL = ("div", "p", "head", "list", "item", "table", "row", "cell", "figure")
STRUCTURAL_BY_PUBLISHER = ("p", "img", "table", "div", "span", "h1")
HEADINGS = ("head", "h1", "h2", "h3", "h4", "h5", "h6")


def frequency(rows: DataFrame, *keys: Column | str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def most_common(counts: DataFrame, *keys: str, count: str = "n") -> DataFrame:
    """Counts from the greatest on, ties in order of the keys."""
    return counts.orderBy(F.desc(count), *(F.asc(k) for k in keys))


#: Attributes whose value is a list, of every tag and of single ones.
LISTS = ("class", "accesskey", "dropzone")
LISTS_OF = {"a": ("rel", "rev"), "link": ("rel", "rev"), "area": ("rel",), "td": ("headers",), "th": ("headers",), "form": ("accept-charset",), "object": ("archive",), "icon": ("sizes",), "iframe": ("sandbox",), "output": ("for",)}


def split_values(attrs: DataFrame) -> DataFrame:
    """Attributes with a row for each entry of a list value; other values are kept whole."""
    a_list = F.col("name").isin(*LISTS)
    for tag, names in LISTS_OF.items():
        a_list = a_list | ((F.col("tag") == tag) & F.col("name").isin(*names))
    parts = F.when(a_list, F.filter(F.split("value", r"(?U)\s+"), lambda x: x != "")).otherwise(F.array("value"))
    return attrs.withColumn("value", F.explode(parts))


def document_frequency(tags: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Documents per tag and their percentage of all documents, of which n_docs has the number as `n_docs`."""
    by = tags.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_with"))
    total = int(n_docs.first()["n_docs"])
    return by.select("tag", "n", "n_with", F.round(F.col("n_with") * 100.0 / max(total, 1), 2).alias("percent"))


def document_frequency_by(tags: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """The same per group; groups has doc_id and the group, the denominator is the group's documents with text."""
    totals = groups.groupBy(group).agg(F.count_distinct("doc_id").alias("n_docs"))
    by = tags.join(groups, "doc_id").groupBy(group, "tag").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_with"))
    return by.join(totals, group).select(group, "tag", "n", "n_with", F.round(F.col("n_with") * 100.0 / F.col("n_docs"), 2).alias("percent"))


def _tag_array(text: str) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.col(text), COMMENTS, ""), RAW_BODIES, "$1")
    return F.regexp_extract_all(F.lower(clean), F.lit(r"<([a-z][a-z0-9]*)[^<>]*>"), F.lit(1))


def _windows(tags: Column, size: int) -> Column:
    """All runs of `size` tags of an array, joined; made in the row, without a window or shuffle."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tags) - size + 1), lambda i: F.array_join(F.slice(tags, i, F.lit(size)), " -> "))
    return F.when(F.size(tags) >= size, runs)


def fragment_ngrams(fragments: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Counts of tag sequences within fragments, in document order."""
    rows = fragments.where(F.col(text).contains("<")).select(_tag_array(text).alias("t"))
    return rows.select(F.explode(_windows(F.col("t"), size)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


def book_ngrams(chunks: DataFrame, size: int) -> DataFrame:
    """Counts of tag sequences over whole books, fragment borders included.

    Texts become arrays of tags where they are read. Sequences are made in the row; of the following fragments only
    the first size - 1 tags are looked up, by the fragment's number in its book, so a book of any size is spread over
    tasks. A repeated id counts once, with the greatest of its tag arrays; fragments without tags are passed over.
    """
    tags = chunks.where("id IS NOT NULL AND text IS NOT NULL").select("id", "source_file", "node_ord", "part_no", _tag_array("text").alias("t"))
    one = tags.groupBy("id").agg(F.max("source_file").alias("doc_id"), F.max("t").alias("t"), F.max(F.coalesce("node_ord", F.lit(-1))).alias("node_ord"), F.max(F.coalesce("part_no", F.lit(-1))).alias("part_no"))
    rows = cut(one.where(F.size("t") > 0), "tags")
    placed = numbered(rows.select("id", "doc_id", "node_ord", "part_no", F.slice("t", 1, size - 1).alias("h"), F.slice("t", F.greatest(F.size("t") - size + 2, F.lit(1)), F.lit(size - 1)).alias("e")), ["doc_id", "node_ord", "part_no", "id"], "place")
    placed = cut(placed.select("place", "doc_id", "h", "e"), "placed")
    border = placed.select("place", "doc_id", "e")
    for k in range(1, size):
        heads = placed.select((F.col("place") - k).alias("place"), F.col("doc_id").alias("d"), F.col("h").alias(f"h{k}"))
        border = border.join(heads, "place", "left").withColumn(f"h{k}", F.when(F.col("doc_id").eqNullSafe(F.col("d")), F.col(f"h{k}"))).drop("d")
    following = F.flatten(F.array_compact(F.array(*(f"h{k}" for k in range(1, size)))))
    border = border.select(F.concat("e", F.slice(following, 1, size - 1)).alias("t"))
    # what starts in a fragment and ends in it, and what ends in a later one
    both = rows.select("t").unionByName(border).select(F.explode(_windows(F.col("t"), size)).alias("ngram"))
    return both.groupBy("ngram").agg(F.count("*").alias("n"))


def element_strings(tags: DataFrame, attribute: str) -> Column:
    """<tag a="x" b="y"> with the attributes sorted by name."""
    pairs = F.array_sort(F.regexp_extract_all("attrs", F.lit(attribute), F.lit(0)))
    return F.concat(F.lit("<"), F.concat_ws(" ", F.array(F.col("tag")), pairs), F.lit(">"))


#: The parent of an element at a fragment's top.
DOCUMENT = "[document]"


def parent_child(elements: DataFrame, tags: tuple[str, ...] = STRUCTURAL, *more: str) -> DataFrame:
    """Child and parent counts of the structural tags; at a fragment's top the parent is '[document]'."""
    rows = elements.where(F.col("tag").isin(*tags)).withColumn("parent", F.coalesce("parent_tag", F.lit(DOCUMENT)))
    return rows.groupBy(*more, F.col("tag").alias("child"), "parent").agg(F.count("*").alias("n"))


def nesting_depth(elements: DataFrame, tags: tuple[str, ...] = ("div", "list")) -> DataFrame:
    """Greatest and mean, over elements that are in none of their own tag, of the chains of direct children of the same tag."""
    rows = elements.where(F.col("tag").isin(*tags) & F.col("nesting").isNotNull())
    return rows.groupBy("tag").agg(F.max("nesting").alias("max_depth"), F.round(F.avg("nesting"), 2).alias("mean_depth"), F.count("*").alias("n_chains"))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, frag, text in zip(*(b.column(k).to_pylist() for k in ("doc_id", "frag_id", "text"))):
            stack, n = [parse(text)], 0
            while stack:
                node = stack.pop()
                for k, c in enumerate(node.content):
                    if isinstance(c, Node) and c.tag in HEADINGS:
                        beside = [node.content[i] if 0 <= i < len(node.content) else None for i in (k - 1, k + 1)]
                        rows.append((doc, frag, n, c.tag, markup(c), *(None if x is None else markup(x) for x in beside)))
                        n += 1
                stack.extend(c for c in reversed(node.content) if isinstance(c, Node))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 7, _CONTEXT.types)], schema=_CONTEXT)


_CONTEXT = pa.schema([("doc_id", pa.string()), ("frag_id", pa.string()), ("pos", pa.int64()), ("tag", pa.string()), ("heading", pa.string()), ("previous_sibling", pa.string()), ("next_sibling", pa.string())])


def heading_context(fragments: DataFrame, doc: str, frag: str, text: str) -> DataFrame:
    """Headings with their markup and that of the siblings before and after them, which may be text; null if there is none."""
    rows = fragments.select(F.col(doc).cast("string").alias("doc_id"), F.col(frag).cast("string").alias("frag_id"), F.col(text).alias("text"))
    found = rows.where(F.col("text").rlike(r"(?i)<(head|h[1-6])[\s/>]"))
    return found.mapInArrow(_contexts, "doc_id string, frag_id string, pos bigint, tag string, heading string, previous_sibling string, next_sibling string")


def top_per_group(counts: DataFrame, group: str, item: str, k: int, count: str = "n") -> DataFrame:
    """The k largest counts of each group, ties by item."""
    w = Window.partitionBy(group).orderBy(F.desc(count), F.asc(item))
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def css_properties(attrs: DataFrame) -> DataFrame:
    """Property names of style attributes: before the first colon of each declaration, trimmed, not empty."""
    parts = F.transform(F.split("value", ";"), lambda x: F.trim(F.substring_index(x, ":", 1)))
    rows = attrs.where(F.col("name") == "style").select("tag", F.explode(parts).alias("property"))
    return rows.where(F.col("property") != "").groupBy("tag", "property").agg(F.count("*").alias("n"))


def tag_inventory(tags: DataFrame, attrs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(tag, kind, name, value, n) of all that occurs with a tag, a row for each distinct value however many there are:
    its attributes' values, the properties of its style, and the types (doc_id, frag_id, name, value) of its fragments."""
    values = attrs.select("tag", F.when(F.col("name") == "rend", "rend").otherwise("attribute").alias("kind"), "name", "value")
    style = F.transform(F.filter(F.split("value", ";"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.trim(F.substring_index(x, ":", 1)))
    css = attrs.where(F.col("name") == "style").select("tag", F.lit("css").alias("kind"), F.lit("style").alias("name"), F.explode(style).alias("value")).where("value <> ''")
    types = tags.select("tag", "frag_id", "doc_id").join(kinds, ["doc_id", "frag_id"]).select("tag", F.lit("type").alias("kind"), "name", "value")
    return values.unionByName(css).unionByName(types).groupBy("tag", "kind", "name", "value").agg(F.count("*").alias("n"))


def tag_and_class(tags: DataFrame, attrs: DataFrame) -> DataFrame:
    """(doc_id, item) of every opening tag, and of every class as tag.class."""
    classes = attrs.where(F.col("name") == "class").select("doc_id", "tag", F.explode(F.split("value", r"(?U)\s+")).alias("c")).where("c <> ''")
    return tags.select("doc_id", F.col("tag").alias("item")).unionByName(classes.select("doc_id", F.concat_ws(".", "tag", "c").alias("item")))


def snippets(chunks: DataFrame, k: int) -> DataFrame:
    """(tag, id, pos, token): the first k opening tags of each name in order of id, place and token; repeated ones count
    once. The rank's limit is a constant, so each task gives away only its own first k ranks of a tag."""
    clean = F.regexp_replace(F.regexp_replace("text", COMMENTS, ""), RAW_BODIES, "$1")
    tokens = F.posexplode(F.regexp_extract_all(clean, F.lit(OPEN_TAG), F.lit(0))).alias("pos", "token")
    rows = chunks.where(F.col("text").contains("<")).select("id", tokens)
    rows = rows.select(F.lower(F.regexp_extract("token", OPEN_TAG, 1)).alias("tag"), "id", F.col("pos").cast("long").alias("pos"), "token")
    w = Window.partitionBy("tag").orderBy("id", "pos", "token")
    return rows.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= k).drop("r").distinct()
