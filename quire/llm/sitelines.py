"""Lines repeated across one site's texts: mined as templates with wildcard slots, then removed.

Every task parses its lines into a fixed-depth token tree: group, number of tokens, first tokens. A leaf is a
template: its first tokens, and a wildcard slot for each further token and for each token with digits. The tree
counts in how many items a template stands. Trees are merged by summing these counts by path, which is exact, as
an item is in one task only. Templates that cover too few of their group's items can't hold a repeated line and
are cut off. In those that are left the slots are filled again, all but the digit runs, and counted in the same
way: the templates that then still cover enough items are removed. (Only lines that agree in all but digits count
as the same.) Texts are cleaned by walking each line down the merged tree.

A full tree is emitted and begun anew, so a task's memory is bounded whatever its partition holds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import source_key
from quire.plans.runtime import cut, join_checked

MIN_LETTERS = 20
MIN_ITEMS = 5
MIN_PERCENT = 3
#: First tokens of a line that are levels of the tree.
DEPTH = 2
#: A task's tree is emitted once it holds so many templates; so is the memory of paths looked up.
MAX_TEMPLATES = 200_000

_DIGITS = re.compile(r"[0-9]+")
_SLOT = "<*>"


def mask_line(line: str) -> str:
    """Runs of whitespace become one blank, outer blanks go, lower case, digit runs become the slot 0."""
    return _DIGITS.sub("0", " ".join(line.split()).lower())


def enough_letters(masked: str, least: int = MIN_LETTERS) -> bool:
    if len(masked) < least:
        return False
    # a line's first characters nearly always decide; the rest is counted only if they don't
    return sum(map(str.isalpha, masked[: 2 * least])) >= least or sum(map(str.isalpha, masked)) >= least


def template_hash(template: str) -> int:
    return xxhash.xxh64_intdigest(template) - (1 << 63)


def path_of(tokens: list[str], depth: int = DEPTH) -> str:
    """A line's path below its group: its number of tokens and the first ones, a token with digits being a slot."""
    head = [_SLOT if _DIGITS.search(t) else t.lower() for t in tokens[:depth]]
    return " ".join([str(len(tokens)), *head])


def path_hash(path: str) -> int:
    """As Spark's xxhash64 of the string."""
    h = xxhash.xxh64_intdigest(path, 42)
    return h - (1 << 64) if h >> 63 else h


class TokenTree:
    """Counts items per template, once per item: by path, or by path and masked line."""

    def __init__(self) -> None:
        self.leaves: dict[tuple, list[int]] = {}

    def add(self, key: tuple, item: int) -> None:
        leaf = self.leaves.get(key)
        if leaf is None:
            self.leaves[key] = [1, item]
        elif leaf[1] != item:
            leaf[0] += 1
            leaf[1] = item

    def drain(self) -> Iterator[tuple]:
        for key, (n, _) in self.leaves.items():
            yield *key, n
        self.leaves = {}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows) if rows else ([],) * len(schema), schema.types)], schema=schema)


_BRANCHES = pa.schema([("grp", pa.string()), ("path", pa.string()), ("n_items", pa.int64())])


def _grow(depth: int, min_letters: int):
    """(grp, path, n_items) of a task's tree; a null path counts the group's items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, paths, items, serial = TokenTree(), {}, {}, 0
        for b in batches:
            for grp, text in zip(b.column("grp").to_pylist(), b.column("text").to_pylist()):
                serial += 1
                items[grp] = items.get(grp, 0) + 1
                for line in text.split("\n"):
                    if len(line) >= min_letters:
                        tokens = line.split()
                        raw = (len(tokens), *tokens[:depth])
                        path = paths.get(raw)
                        if path is None:
                            path = paths[raw] = path_of(tokens, depth)
                        tree.add((grp, path), serial)
                if len(tree.leaves) >= MAX_TEMPLATES:
                    yield _batch(list(tree.drain()), _BRANCHES)
                    paths = {}
        yield _batch([*tree.drain(), *((g, None, n) for g, n in items.items())], _BRANCHES)

    return run


class Known:
    """What is kept of the merged tree in one group: path hashes, and the template hashes below them."""

    def __init__(self, hashes: Iterable[int] | None, depth: int = DEPTH, min_letters: int = MIN_LETTERS):
        self.hashes, self.depth, self.min_letters = frozenset(hashes or ()), depth, min_letters
        self.paths: dict[tuple, bool] = {}

    def masked(self, line: str) -> str | None:
        """The masked line, if its path is kept and it has enough letters."""
        if len(line) < self.min_letters or not self.hashes:
            return None
        tokens = line.split()
        raw = (len(tokens), *tokens[: self.depth])
        kept = self.paths.get(raw)
        if kept is None:
            if len(self.paths) >= MAX_TEMPLATES:
                self.paths.clear()
            kept = self.paths[raw] = path_hash(path_of(tokens, self.depth)) in self.hashes
        if not kept:
            return None
        masked = _DIGITS.sub("0", " ".join(tokens).lower())
        return masked if enough_letters(masked, self.min_letters) else None

    def holds(self, line: str) -> bool:
        masked = self.masked(line)
        return masked is not None and template_hash(masked) in self.hashes


def known_by_group(b: pa.RecordBatch, of: dict, depth: int = DEPTH, min_letters: int = MIN_LETTERS, group: str = "grp") -> list[Known]:
    """Each row's Known; `of` keeps them by group over the batches of a task."""
    column, out = b.column("known"), []
    for i, key in enumerate(b.column(group).to_pylist()):
        if key not in of:
            of[key] = Known(column[i].as_py(), depth, min_letters)
        out.append(of[key])
    return out


_FILLED = pa.schema([
    ("grp", pa.string()), ("path", pa.string()), ("template_hash", pa.int64()), ("template", pa.string()), ("n_items", pa.int64()),
    ("origin", pa.string()), ("item_grp", pa.string()), ("item_id", pa.int64()), ("line_nos", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())),
])
_FILLED_DDL = "grp string, path string, template_hash bigint, template string, n_items bigint, origin string, item_grp string, item_id bigint, line_nos array<bigint>, hashes array<bigint>"


def _fill(depth: int, min_letters: int, with_lines: bool):
    """The task's tree below the kept paths: (grp, path, template_hash, template, n_items); with_lines also each item's lines in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of, serial = TokenTree(), {}, 0

        def emit(lines: list[tuple]) -> pa.RecordBatch:
            counts = [(g, path_of(m.split(" "), depth), template_hash(m), m, n) + (None,) * 5 for g, m, n in tree.drain()]
            return _batch(counts + [(None,) * 5 + x for x in lines], _FILLED)

        for b in batches:
            lines = []
            for origin, grp, item, text, known in zip(*(b.column(k).to_pylist() for k in ("origin", "grp", "item_id", "text")), known_by_group(b, of, depth, min_letters)):
                serial += 1
                numbers, hashes = [], []
                for k, line in enumerate(text.split("\n"), 1):
                    masked = known.masked(line)
                    if masked is not None:
                        tree.add((grp, masked), serial)
                        if with_lines:
                            numbers.append(k)
                            hashes.append(template_hash(masked))
                if numbers:
                    lines.append((origin, grp.split("\x1f")[1], item, numbers, hashes))
            yield emit(lines) if lines or len(tree.leaves) >= MAX_TEMPLATES else _batch([], _FILLED)
        yield emit([])

    return run


def document_items(docs: DataFrame) -> DataFrame:
    """Items of the documents table: those with non-null text, grouped by source; a null source is the group ''."""
    return docs.where(F.col("text").isNotNull()).select(
        F.lit("documents").alias("origin"), F.coalesce(source_key(F.col("source")), F.lit("")).alias("grp"),
        F.col("doc_id").cast("long").alias("item_id"), "text",
    )


def _refuse(name: str):
    raise ValueError(name)


def strict_json(body: str):
    """Parsed JSON, or ValueError; NaN and Infinity are no JSON."""
    try:
        return json.loads(body, parse_constant=_refuse)
    except RecursionError as e:
        raise ValueError("nested too deep") from e


def _description(value) -> str:
    meta = value.get("epub_metadata") if isinstance(value, dict) else None
    d = meta.get("description") if isinstance(meta, dict) else None
    if isinstance(d, list):
        d = "\n".join(x for x in d if isinstance(x, str))
    return d.encode("utf-8", "replace").decode() if isinstance(d, str) else ""


_ITEM = pa.schema([("origin", pa.string()), ("grp", pa.string()), ("item_id", pa.int64()), ("text", pa.string())])


def _descriptions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for grp, record, body in zip(*(b.column(k).to_pylist() for k in ("grp", "item_id", "body"))):
            try:
                rows.append(("book_json", grp, record, _description(strict_json(body))))
            except ValueError:
                pass
        yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows) if rows else ([], [], [], []), _ITEM.types)], schema=_ITEM)


def description_items(book_json: DataFrame) -> DataFrame:
    """Items of book_json: records whose body is valid JSON, grouped by portal; text is the description."""
    rows = book_json.where(F.col("body").isNotNull()).select(
        F.coalesce(source_key(F.col("portal")), F.lit("")).alias("grp"), F.col("record_id").cast("long").alias("item_id"), "body"
    )
    return rows.mapInArrow(_descriptions, "origin string, grp string, item_id bigint, text string")


def _mine(items: DataFrame, min_letters: int, min_items: int, min_percent: float, depth: int, with_lines: bool) -> tuple[DataFrame, DataFrame]:
    """The templates that cover enough items, and the rows of _fill from which they were merged."""
    joint = F.concat_ws("\x1f", "origin", "grp").alias("grp")
    items = items.where(F.col("text").isNotNull())
    grown = items.select(joint, "text").mapInArrow(_grow(depth, min_letters), "grp string, path string, n_items bigint")
    merged = grown.groupBy("grp", "path").agg(F.sum("n_items").alias("n_items")).where(F.col("path").isNull() | (F.col("n_items") >= min_items))
    merged = cut(merged, "tree")
    totals = merged.where("path IS NULL").select("grp", F.col("n_items").alias("n_group"))
    enough = F.col("n_items") * 100 >= F.lit(min_percent) * F.col("n_group")
    kept = merged.where("path IS NOT NULL").join(totals, "grp").where(enough)
    known = cut(kept.groupBy("grp").agg(F.collect_list(F.xxhash64("path")).alias("known")), "known")
    texts = join_checked(items.select(joint, "origin", "item_id", "text"), known, ["grp"], "inner")
    filled = texts.select("grp", "origin", "item_id", "text", "known").mapInArrow(_fill(depth, min_letters, with_lines), _FILLED_DDL)
    if with_lines:
        filled = cut(filled, "filled")
    counts = filled.where("grp IS NOT NULL").groupBy("grp", "path", "template_hash").agg(F.sum("n_items").alias("n_items"), F.max("template").alias("template"))
    counts = counts.where(F.col("n_items") >= min_items).join(totals, "grp").where(enough)
    parts = F.split("grp", "\x1f")
    return cut(counts.select(parts[0].alias("origin"), parts[1].alias("grp"), "path", "template_hash", "template", "n_items", "n_group"), "templates"), filled


def mine_templates(items: DataFrame, min_letters: int = MIN_LETTERS, min_items: int = MIN_ITEMS, min_percent: float = MIN_PERCENT, depth: int = DEPTH) -> DataFrame:
    """(origin, grp, path, template_hash, template, n_items, n_group) of the templates that stand in enough items of their group.

    Items have origin, grp, item_id and text; the origin is part of the group. Null texts are no items;
    empty ones count as items without lines. Few rows: at most lines per item / min_percent in a group.
    """
    return _mine(items, min_letters, min_items, min_percent, depth, with_lines=False)[0]


def with_templates(items: DataFrame, templates: DataFrame) -> DataFrame:
    """Items with what is kept of the merged tree in their group, path and template hashes, as the array column `known`."""
    hashes = templates.select("origin", "grp", F.explode(F.array(F.xxhash64("path"), "template_hash")).alias("h"))
    known = cut(hashes.groupBy("origin", "grp").agg(F.collect_set("h").alias("known")), "known")
    return join_checked(items, known, ["origin", "grp"], "left")


def split_lines(text: str, known: Known) -> tuple[list[str], list[int]]:
    """The lines to keep, and the numbers (from 1) of the lines whose template is known."""
    kept, gone = [], []
    for k, line in enumerate(text.split("\n"), 1):
        if known.holds(line):
            gone.append(k)
        else:
            kept.append(line)
    return kept, gone


_REMOVED = pa.schema([("origin", pa.string()), ("grp", pa.string()), ("item_id", pa.int64()), ("line_nos", pa.list_(pa.int64())), ("own_text", pa.string())])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of: dict = {}
    for b in batches:
        rows = []
        for origin, grp, item, text, known in zip(*(b.column(k).to_pylist() for k in ("origin", "grp", "item_id", "text")), known_by_group(b, of, group="key")):
            kept, gone = split_lines(text, known)
            rows.append((origin, grp, item, gone, "\n".join(kept)))
        yield _batch(rows, _REMOVED)


def remove_repeated(items: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per item with non-null text: numbers of the repeated lines and the text without them.

    Repeated rows give repeated rows; columns beside origin, grp, item_id and text are not carried.
    """
    rows = with_templates(items.where(F.col("text").isNotNull()), templates)
    rows = rows.select("origin", "grp", "item_id", "text", "known", F.concat_ws("\x1f", "origin", "grp").alias("key"))
    return rows.mapInArrow(_remove, "origin string, grp string, item_id bigint, line_nos array<bigint>, own_text string")


def all_items(docs: DataFrame, book_json: DataFrame) -> DataFrame:
    """The items of both tables; the descriptions are written once, as their bodies are costly to parse."""
    return document_items(docs).unionByName(cut(description_items(book_json), "descriptions"))


def find_repeated_lines(docs: DataFrame, book_json: DataFrame) -> DataFrame:
    """(origin, item_id, line_no) of every line to be removed from documents and book descriptions."""
    templates, filled = _mine(all_items(docs, book_json), MIN_LETTERS, MIN_ITEMS, MIN_PERCENT, DEPTH, with_lines=True)
    lines = filled.where("line_nos IS NOT NULL").select("origin", F.col("item_grp").alias("grp"), "item_id", F.explode(F.arrays_zip("line_nos", "hashes")).alias("l"))
    lines = lines.select("origin", "grp", "item_id", F.col("l.line_nos").alias("line_no"), F.col("l.hashes").alias("template_hash"))
    got = join_checked(lines, templates, ["origin", "grp", "template_hash"], "left_semi")
    return got.select("origin", "item_id", "line_no").distinct()
