"""Markup residue in texts: template deduction over sites, and plain text with its structure kept.

The method is equivalence-class template deduction. Each document is scanned once for tokens of HTML, XML/TEI,
Markdown, MediaWiki and LaTeX. A token's occurrences are told apart by role: a pair (its opening and its closing
half are both there), a remnant (one half is missing) or a single sign (a list bullet, a bar at line start), which
also occurs in prose. Tokens of a site with the same occurrence vector (how often they stand in which document)
form an equivalence class; vectors are compared by an order-free 64-bit sum, so none is ever collected. A class is
valid if it holds pairs that are properly nested in most of its documents. Valid classes, each placed under the
class of its usual enclosing token, are the site's template; the template of all sites decides where a site has too
few documents. What is in no valid class belongs to the template

* as a remnant, if pairs of the same token are valid,
* as a single sign, if most documents of the site that hold it hold valid pairs of the same language,

and is prose otherwise. A document has markup if it holds tokens of its site's template. What lies between these
tokens are the slots, which become the plain text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import source_key
from quire.plans.runtime import cut, join_checked

#: A site's own template decides about a class or a single sign seen in at least so many of its documents.
MIN_SUPPORT = 5
#: Share of a single sign's documents that must hold valid pairs of its language.
MIN_NESTED = 0.5

# What may start a construct; everything else is skipped by one C-level search.
_SIGN = re.compile(r"[<&`\[\]{}$*_~'\\|=#]")
_LINE = re.compile(r"^ {0,3}(?:[-+*] +(?=[^\s*\-])|\d{1,3}\. +(?=\S)|> +(?=\S)|-{3,}[ \t]*$)", re.M)
_MAY_LINE = re.compile(r"(?:^|\n) {0,3}[-+*>\d]")
_TAG = re.compile(r"</?([A-Za-z][\w:.\-]*)(?:\s[^<>]*)?/?>")
_CUT_TAG = re.compile(r"</?([A-Za-z][\w:.\-]*)(?:\s[^<>\n]*)?\Z")
_COMMENT = re.compile(r"<!--(?:.*?-->)?", re.S)
_DECL = re.compile(r"<[!?][A-Za-z\[][^<>]*>")
_DROP = re.compile(r"<(style|script)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_ENT = re.compile(r"&(?:amp;)*(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_FENCE = re.compile(r"```[^\n`]*$", re.M)
_CODE = re.compile(r"`[^`\n]+`")
_WIKIHEAD = re.compile(r"={1,6}[ \t]*[^=\n]+?[ \t]*={1,6}[ \t]*$", re.M)
_SETEXT = re.compile(r"={3,}[ \t]*$", re.M)
_ATX = re.compile(r"#{1,6}[ \t]+(?=\S)")
_MDTABLE = re.compile(r"\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$", re.M)
_WIKITABLE = re.compile(r"\{\||\|\}|\|-(?!-)")
_ROW = re.compile(r"\|[^\n]*")
_LINK = re.compile(r"\[[^\[\]\n]*\]\([^()\s]*\)")
_LINKTAIL = re.compile(r"\]\([^()\s]+\)")
_FOOT = re.compile(r"\[\^[^\]\s]+\]:?")
_WIKILINK = re.compile(r"\[\[[^\[\]\n]*\]\]|\[\[")
_TEMPL = re.compile(r"\{\{[^{}\n]*\}\}|\{\{")
_ACCENT = re.compile(r"\{\\[\"'`^~=.uvHcdbtr]\{?\\?[A-Za-z]\}?\}")
_BEGIN = re.compile(r"\\(begin|end)\{([A-Za-z]+)\*?\}")
_CMD_ARG = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\[\]\n]*\])?\{")
_CMD = re.compile(r"\\([A-Za-z]+)")
_PATH = re.compile(r"(?:\\[\w.\-]+)+")
_DRIVE = re.compile(r"\b[A-Za-z]:(?:\\[\w.\-]+)+")
_BREAK = re.compile(r"\\\\(?:\[[^\]\n]*\])?")
_MATHMARK = re.compile(r"\\[()\[\]]")
_MATH = re.compile(r"\$\$.+?\$\$|\$[^\s$\d](?:[^$\n]*[^\s$])?\$(?!\d)|\$\d[^$\n]*[\\^_][^$\n]*\$", re.S)
_STARS = re.compile(r"(\*{1,3})(?=[^\s*])[^*\n]*[^\s*]\1(?![\w*])")
_STARS_OPEN = re.compile(r"\*{2,3}(?=\w)")
_UNDER = re.compile(r"(_{1,3})(?=[^\s_])[^_\n]*[^\s_]\1(?!\w)")
_UNDER_OPEN = re.compile(r"__(?=\w)")
_STRIKE = re.compile(r"~~[^~\n]+~~|~~(?=\w)")
_QUOTES = re.compile(r"'{2,5}")
_VERBATIM = re.compile(
    r"```[^\n`]*\n.*?(?:\n```[ \t]*(?=\n|\Z)|\Z)|\\begin\{(verbatim|lstlisting)\}.*?(?:\\end\{\1\}|\Z)"
    r"|<(pre|source|syntaxhighlight|nowiki|code)\b[^<>]*>.*?(?:</\2\s*>|\Z)",
    re.S | re.I,
)
_FAMILY = {"html": 0, "md": 1, "wiki": 2, "tex": 3}

#: XML declares these five; the rest of the named entities come from html.entities.
_XML_ENTITIES = frozenset(["amp", "lt", "gt", "quot", "apos"])


def _known_entity(name: str) -> bool:
    return name[0] == "#" or name in _XML_ENTITIES or f"{name};" in html.entities.html5


def _at_line_start(text: str, i: int) -> bool:
    while i > 0 and text[i - 1] in " \t":
        i -= 1
    return i == 0 or text[i - 1] == "\n"


def scan(text: str) -> Iterator[tuple[str, str, bool, int, int]]:
    """Yield (token, family, strong, start, end) of every possible construct, in document order.

    Null or empty text yields nothing. Tokens are normalised: tags by name, commands by name.
    """
    if not text:
        return
    lines = _LINE.finditer(text) if _MAY_LINE.search(text) else iter(())
    line = next(lines, None)
    pos, n = 0, len(text)
    search = _SIGN.search
    while True:
        m = search(text, pos)
        i = m.start() if m else n
        while line is not None and line.start() <= i:
            if line.start() >= pos:
                s = line.group().strip()
                token = "1." if s[0].isdigit() else "---" if s.startswith("--") else s
                yield token, "md", False, line.start(), line.end()
                if line.end() > i:
                    pos = line.end()
            line = next(lines, None)
        if m is None:
            return
        if i < pos:
            continue
        c = text[i]
        found = None
        if c == "<":
            if k := _COMMENT.match(text, i):
                found = ("<!-- -->", "html", True, i, k.end())
            elif k := _DROP.match(text, i):
                found = (f"<{k[1].lower()}>", "html", True, i, k.end())
            elif k := _TAG.match(text, i):
                closing = "/" if text[i + 1] == "/" else ""
                found = (f"<{closing}{k[1].lower()}>", "html", True, i, k.end())
            elif k := _DECL.match(text, i):
                found = ("<!>", "html", True, i, k.end())
            elif k := _CUT_TAG.match(text, i):
                found = (f"<{k[1].lower()}>", "html", True, i, k.end())
        elif c == "&":
            if (k := _ENT.match(text, i)) and _known_entity(k[1]):
                found = (f"&{k[1]};", "html", True, i, k.end())
        elif c == "[":
            if k := _WIKILINK.match(text, i):
                found = ("[[", "wiki", True, i, k.end())
            elif k := _LINK.match(text, i):
                found = ("[]()", "md", True, i, k.end())
            elif k := _FOOT.match(text, i):
                found = ("[^]", "md", True, i, k.end())
        elif c == "]":
            if k := _LINKTAIL.match(text, i):
                found = ("]()", "md", True, i, k.end())
            elif text.startswith("]]", i):
                found = ("]]", "wiki", True, i, i + 2)
        elif c == "{":
            if k := _ACCENT.match(text, i):
                found = ("{\\}", "tex", True, i, k.end())
            elif k := _TEMPL.match(text, i):
                found = ("{{", "wiki", True, i, k.end())
            elif k := _WIKITABLE.match(text, i):
                found = ("{|", "wiki", True, i, k.end())
        elif c == "}":
            if text.startswith("}}", i):
                # the end of a LaTeX argument is no template end
                found = ("}}", "wiki", "\\" not in text and "$" not in text, i, i + 2)
        elif c == "\\":
            if k := _BEGIN.match(text, i):
                found = (f"\\{k[1]}{{{k[2]}}}", "tex", True, i, k.end())
            elif k := _CMD_ARG.match(text, i):
                found = (f"\\{k[1]}{{", "tex", True, i, k.end())
            elif k := _BREAK.match(text, i):
                found = ("\\\\", "tex", True, i, k.end())
            elif k := _MATHMARK.match(text, i):
                found = (k[0], "tex", True, i, k.end())
            elif i > 0 and text[i - 1] == ":" and (k := _PATH.match(text, i)):
                found = ("C:\\", "tex", False, i, k.end())
            elif k := _CMD.match(text, i):
                found = (f"\\{k[1]}", "tex", True, i, k.end())
        elif c == "$":
            if k := _MATH.match(text, i):
                found = ("$", "tex", True, i, k.end())
        elif c == "`":
            if k := _FENCE.match(text, i):
                found = ("```", "md", True, i, k.end())
            elif k := _CODE.match(text, i):
                found = ("`", "md", True, i, k.end())
        elif c == "*":
            before = text[i - 1] if i else " "
            if not (before.isalnum() or before in "*_"):
                if k := _STARS.match(text, i):
                    found = (k[1], "md", True, i, k.end())
                elif k := _STARS_OPEN.match(text, i):
                    found = (k[0], "md", True, i, k.end())
        elif c == "_":
            before = text[i - 1] if i else " "
            if not (before.isalnum() or before in "*_/\\"):
                if k := _UNDER.match(text, i):
                    found = (k[1], "md", True, i, k.end())
                elif k := _UNDER_OPEN.match(text, i):
                    found = ("__", "md", True, i, k.end())
        elif c == "~":
            if k := _STRIKE.match(text, i):
                found = ("~~", "md", True, i, k.end())
        elif c == "'":
            if k := _QUOTES.match(text, i):
                found = (k[0], "wiki", True, i, k.end())
        elif c == "|":
            if _at_line_start(text, i):
                if k := _MDTABLE.match(text, i):
                    found = ("|---|", "md", True, i, k.end())
                elif k := _WIKITABLE.match(text, i):
                    found = (k[0], "wiki", k[0] == "|}", i, k.end())
                else:
                    found = ("|", "md", False, i, i + 1)
        elif c == "=":
            if _at_line_start(text, i):
                if k := _SETEXT.match(text, i):
                    found = ("===", "md", i > 0, i, k.end())
                elif k := _WIKIHEAD.match(text, i):
                    found = ("==", "wiki", True, i, k.end())
        elif c == "#" and _at_line_start(text, i):
            if k := _ATX.match(text, i):
                found = (f"{k[0].strip()} ", "md", True, i, k.end())
        if found is None:
            # step over the whole run of one sign, so that *** isn't tried thrice
            pos = i + 1
            while pos < n and text[pos] == c and c in "*_~'=#`":
                pos += 1
            continue
        yield found
        pos = max(found[4], i + 1)


#: Elements that are always empty, of HTML and of TEI.
_EMPTY = frozenset("<br> <hr> <img> <input> <meta> <link> <col> <lb> <pb> <cb> <gb> <milestone>".split())
_PARTNER = {"[[": "]]", "{{": "}}", "{|": "|}", "\\(": "\\)", "\\[": "\\]"}
_OPENER = {v: k for k, v in _PARTNER.items()} | {"]()": "[]()"}
#: Tokens whose two halves are alike.
_ALIKE = frozenset(["''", "'''", "''''", "'''''", "```"])
_BRACE = re.compile(r"[{}]")


def _closer(token: str) -> str | None:
    """The closing half of an opening token."""
    if token.startswith("</") or token == "<!>":
        return None
    if token.startswith("<") and token not in ("<!-- -->", *_EMPTY):
        return f"</{token[1:]}"
    if token.startswith("\\begin{"):
        return f"\\end{token[6:]}"
    return token if token in _ALIKE else _PARTNER.get(token)


def pair_of(token: str) -> str:
    """The token under which the pair of a half is known: that of the opening half."""
    if token.startswith("</"):
        return f"<{token[2:]}"
    if token.startswith("\\end{"):
        return f"\\begin{token[4:]}"
    return _OPENER.get(token, token)


def _whole(text: str, token: str, start: int, end: int, braces: Callable[[], set[int]]) -> bool:
    """Whether one token holds both halves of its construct."""
    if token.startswith("<"):
        return token in _EMPTY or token == "<!>" or text.endswith(("/>", "-->"), start, end) or token in ("<style>", "<script>") and text.startswith("</", text.rfind("<", start, end))
    if token[0] in "*_" or token == "~~":
        return end - start > len(token)
    if token in ("[[", "{{"):
        return end - start > 2
    if token.startswith("\\") and token.endswith("{"):
        return end - 1 in braces()
    return token not in ("]()", "]]", "}}", "|}", "{|", "\\(", "\\)", "\\[", "\\]") and token not in _ALIKE and not token.startswith(("\\begin{", "\\end{"))


PAIR, REMNANT, SINGLE = "pair", "remnant", "single"


def constructs(text: str) -> list[list]:
    """[token, role, family, start, end, enclosing token, crossed] of every possible construct, in document order.

    A closing half pairs with the nearest open one of its kind and ends all that was opened since; a pair is crossed
    if something opened within it is closed only after it. Both halves of a pair have the role pair.
    """
    closed: set[int] | None = None

    def braces() -> set[int]:
        nonlocal closed
        if closed is None:
            closed, open_ = set(), []
            for m in _BRACE.finditer(text):
                if m[0] == "{":
                    open_.append(m.start())
                elif open_:
                    closed.add(open_.pop())
        return closed

    out: list[list] = []
    stack: list[tuple[int, str]] = []  # open halves in order: place in out, closing half
    waiting: dict[str, list[int]] = {}  # places in the stack by closing half
    left_open: dict[str, tuple[list, list]] = {}  # closing halves still missing when the pair around them ended
    for token, family, strong, start, end in scan(text):
        row = [token, PAIR, family, start, end, out[stack[-1][0]][0] if stack else None, False]
        if not strong:
            row[1] = SINGLE
        elif not _whole(text, token, start, end, braces):
            own = waiting.get(token)
            if own:
                place = own[-1]
                opened = out[stack[place][0]]
                for _, missing in stack[place + 1 :]:
                    left_open[missing] = opened, row
                for _, missing in stack[place:]:
                    waiting[missing].pop()
                del stack[place:]
                opened[1], row[5] = PAIR, opened[5]
            else:
                row[1] = REMNANT
                if token in left_open:
                    for half in left_open.pop(token):
                        half[6] = True
                closer = _closer(token)
                if closer:
                    waiting.setdefault(closer, []).append(len(stack))
                    stack.append((len(out), closer))
        out.append(row)
    return out


def _profile(text: str) -> list[tuple[str, str, str, int, str | None, bool, bool]]:
    """(token, role, family, count, most frequent enclosing token, crossed, nested) of one document; nested: other
    tokens are pairs of the same language there."""
    counts: dict[tuple[str, str], list] = {}
    pairs: dict[str, set[str]] = {}
    for token, role, family, _, _, parent, crossed in constructs(text):
        e = counts.get((token, role))
        if e is None:
            e = counts[token, role] = [family, 0, {}, False]
        e[1] += 1
        e[2][parent] = e[2].get(parent, 0) + 1
        e[3] |= crossed
        if role == PAIR:
            pairs.setdefault(family, set()).add(pair_of(token))
    out = []
    for (token, role), (family, n, parents, crossed) in counts.items():
        # Markdown and wiki texts share their list signs, and their bars
        near = (family, "wiki") if family == "md" else (family, "md") if token.startswith("|") else (family,)
        nested = any(pairs.get(f, set()) - {pair_of(token)} for f in near)
        parent = max(parents, key=lambda p: (parents[p], p or ""))
        out.append((token, role, family, n, parent, crossed, nested))
    return out


_TOKENS = pa.schema([
    ("site", pa.string()), ("token", pa.string()), ("role", pa.string()), ("pair", pa.string()), ("family", pa.string()), ("doc_id", pa.int64()),
    ("n", pa.int64()), ("parent", pa.string()), ("crossed", pa.bool_()), ("nested", pa.bool_()),
])
_TOKENS_DDL = "site string, token string, role string, pair string, family string, doc_id bigint, n bigint, parent string, crossed boolean, nested boolean"


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(10)]
        for site, doc, text in zip(*(b.column(k).to_pylist() for k in ("site", "doc_id", "text"))):
            for token, role, family, n, parent, crossed, nested in _profile(text):
                for col, v in zip(cols, (site, token, role, pair_of(token), family, doc, n, parent, crossed, nested)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TOKENS.types)], schema=_TOKENS)


def _docs(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(source_key(F.col(source_col)), F.lit("")).alias("site"),
        F.col(text_col).alias("text"),
    ).where(F.col("text").isNotNull() & (F.col("text") != ""))


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document, token and role; written, as the template and the rows found are both made from it."""
    return cut(_docs(docs, id_col, text_col, source_col).mapInArrow(_token_rows, _TOKENS_DDL), "tokens")


def template_of(rows: DataFrame) -> DataFrame:
    """deduce_templates for the rows of token_rows."""
    tokens = rows.groupBy("site", "token", "role").agg(
        F.first("family").alias("family"),
        F.first("pair").alias("pair"),
        F.sum(F.xxhash64("doc_id", "n").cast("decimal(20,0)")).alias("vector"),
        F.count("*").alias("support"),
        F.sum("n").alias("occurrences"),
        F.count_if(F.col("crossed")).alias("n_crossed"),
        F.count_if(F.col("nested")).alias("n_nested"),
        F.mode("parent").alias("parent"),
    )
    tokens = cut(tokens, "roles")
    is_pair = F.col("role") == PAIR
    classes = tokens.groupBy("site", "vector").agg(
        F.count("*").alias("class_size"),
        (F.bool_or(is_pair) & (F.sum(F.when(is_pair, F.col("n_crossed")).otherwise(0)) * 2 < F.sum(F.when(is_pair, F.col("support")).otherwise(0)))).alias("valid"),
    )
    placed = cut(tokens.join(classes, ["site", "vector"]), "placed")
    # the template of all sites: a pair is valid where its documents mostly stand in valid classes
    everywhere = placed.where(is_pair).groupBy("pair").agg((F.sum(F.when(F.col("valid"), F.col("support")).otherwise(0)) * 2 >= F.sum("support")).alias("pair_valid"))
    overall = tokens.where(F.col("role") == SINGLE).groupBy("token").agg((F.sum("n_nested") / F.sum("support")).alias("nested_overall"))
    joined = placed.join(everywhere, "pair", "left").join(overall, "token", "left")
    parents = tokens.where(is_pair).select("site", F.col("token").alias("parent"), F.col("vector").cast("string").alias("parent_class"))
    joined = joined.join(parents, ["site", "parent"], "left")
    enough = F.col("support") >= MIN_SUPPORT
    known_pair = F.coalesce("pair_valid", F.lit(False))
    nested = F.when(enough, F.col("n_nested") / F.col("support")).otherwise(F.col("nested_overall"))
    is_markup = (
        F.when(is_pair, F.when(enough, F.col("valid")).otherwise(known_pair))
        .when(F.col("role") == REMNANT, F.col("valid") | known_pair)
        .otherwise(nested >= MIN_NESTED)
    )
    return joined.select(
        "site", "token", "role", "family", F.col("vector").cast("string").alias("class_id"), "class_size", "support", "occurrences",
        "valid", "parent", "parent_class", is_markup.alias("is_markup"),
    )


def deduce_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per site, token and role: its equivalence class, validity, place in the template, and whether it is in it.

    Columns: site, token, role, family, class_id (the occurrence vector's sum), class_size, support
    (documents), occurrences, valid, parent, parent_class, is_markup. A null source is the site ''.
    Null and empty texts have no tokens. An empty table gives an empty template.
    """
    return template_of(token_rows(docs, id_col, text_col, source_col))


# ---- slots to plain text -------------------------------------------------------------------

_HEAD = re.compile(r"<(?:h[1-6]|head)\b[^<>]*>(.*?)</(?:h[1-6]|head)\s*>", re.S | re.I)
_CELL = re.compile(r"</(?:td|th|cell)\s*>\s*(?=<(?:td|th|cell)\b)", re.I)
_ITEM = re.compile(r"\s*<(?:li|item)\b[^<>]*>\s*", re.I)
_BLOCK = re.compile(r"[ \t]*</?(?:p|div|ul|ol|list|table|tbody|thead|section|body|html|blockquote|figure|dl)\b[^<>]*>[ \t]*", re.I)
_ROWEND = re.compile(r"(?:\s*</?(?:tr|row)\b[^<>]*>\s*)+", re.I)
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
_BR = re.compile(r"[ \t]*<(?:br|lb|hr)\b[^<>]*>[ \t]*", re.I)
_ANYTAG = re.compile(r"</?[A-Za-z][\w:.\-]*(?:\s[^<>]*)?/?>|</?[A-Za-z][\w:.\-]*(?:\s[^<>\n]*)?\Z|<[!?][A-Za-z\[][^<>]*>")
_MATHTAG = re.compile(r"<math\b[^<>]*>(.*?)(?:</math\s*>|\Z)|<span class=\"math\">\s*\\\((.*?)(?:\\\)\s*</span>|\Z)", re.S)
_EQUATION = re.compile(r"\\begin\{(equation|displaymath|align)\*?\}\s*(.*?)\s*(?:\\end\{\1\*?\}|\Z)", re.S)
_BRMATH = re.compile(r"\\\((.+?)\\\)|\\\[(?!\d)(.+?)\\\]", re.S)
_TABULAR = re.compile(r"\\begin\{tabular\}(?:\{[^{}\n]*\})?\s*(.*?)\s*(?:\\end\{tabular\}|\Z)", re.S)
_SECTION = re.compile(r"^\\(?:part|chapter|section|subsection|subsubsection)\*?\{(.*)\}[ \t]*$", re.M)
_CMDARG1 = re.compile(r"\\(?:text\w+|emph|underline|title|author)\*?\{([^{}]*)\}")
_CMDGONE = re.compile(r"\\(?:footnote|includegraphics|label|ref|cite|pagestyle|documentclass|usepackage|vspace|hspace)\*?(?:\[[^\[\]\n]*\])?(?:\{[^{}]*\})?")
_CMDREST = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})?")
#: The combining marks of LaTeX's accent commands.
_MARKS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327"}
#: LaTeX commands that stand for a character.
_WORD = {"glqq": "„", "grqq": "“", "flqq": "«", "frqq": "»", "ldots": "…", "dots": "…", "textendash": "–", "textemdash": "—", "ss": "ß", "&": "&", "%": "%", "#": "#", "_": "_", "{": "{", "}": "}"}
_WORDS = re.compile(r"\\(glqq|grqq|flqq|frqq|ldots|dots|textendash|textemdash|ss|[&%#_{}])(?![A-Za-z])(?:\{\}|(?<=[gf]lqq) )?")
_ACC = re.compile(r"\{\\([\"'`^~=.uvHc])\{?\\?([A-Za-z])\}?\}")


def _entities(text: str) -> str:
    """Entities decoded, also escaped ones, until nothing changes (three times at most)."""
    for _ in range(3):
        new = _ENT.sub(lambda m: html.unescape(re.sub(r"^&(?:amp;)*", "&", m[0])) if _known_entity(m[1]) else m[0], text)
        if new == text:
            break
        text = new
    return text.replace("\u00ad", "").replace("\u200b", "")


def _accent(m: re.Match) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", m[2] + _MARKS[m[1]])


def render(text: str, template: frozenset[tuple[str, str]] | None = None) -> str:
    """Plain text of one document: the slots, with headings as '# ', list items as '- ', table
    cells joined by ' | ', code between lines of ``` and formulas between dollar signs.

    template has the (token, role) of the site's markup, None means that every token is; what isn't in it is prose
    and stays as it is. Text without markup is returned unchanged.
    """
    found = constructs(text)
    prose = [] if template is None else [c for c in found if (c[0], c[1]) not in template]
    tokens = {c[0] for c in found if template is None or (c[0], c[1]) in template}
    if not tokens:
        return text
    first = next(c for c in map(chr, range(0xFDD0, 0xFDEF)) if c not in text and chr(ord(c) + 1) not in text)
    last, kept = chr(ord(first) + 1), []

    def keep(s: str) -> str:
        kept.append(s)
        return f"{first}{len(kept) - 1}{last}"

    for _, _, _, start, end, _, _ in reversed(prose):
        text = text[:start] + keep(text[start:end]) + text[end:]
    has = lambda *starts: any(t.startswith(starts) for t in tokens)
    html_, tex = has("<", "&"), has("\\", "{\\", "$")
    md = has("*", "_", "~~", "`", "[]", "]()", "[^]", "#", "===", "|", "- ", "1.", "-", "+", ">")
    wiki = has("[[", "]]", "{{", "}}", "{|", "|", "==", "''")
    if "&" in text and re.search(r"&(?:amp;)*(?:lt|#60|#x3[cC]);", text) and not re.search(r"<[A-Za-z/]", text):
        text = _entities(text)  # a text escaped as a whole
        html_ = True

    def verbatim(m: re.Match) -> str:
        s = m[0]
        if m[2] and m[2].lower() in ("source", "syntaxhighlight", "nowiki"):  # their bodies are raw
            body = re.sub(r"\A<[^<>]*>|</[A-Za-z]+\s*>\Z", "", s).strip("\n")
            return keep(body if m[2].lower() == "nowiki" else f"\n```\n{body}\n```\n" if "\n" in body else f"`{body}`")
        if s.lower().startswith("<code") or "\n" not in s and s.startswith("<") and not s.lower().startswith("<pre"):
            body = _ANYTAG.sub("", s)
            return keep(f"`{_entities(body)}`" if "\n" not in body else f"\n```\n{_entities(body).strip(chr(10))}\n```\n")
        body = re.sub(r"\A```[^\n]*\n|\n?```[ \t]*\Z|\\(?:begin|end)\{(?:verbatim|lstlisting)\}", "", s)
        if s.startswith("<"):
            body = _entities(_ANYTAG.sub("", body))
        body = body.strip("\n")
        return keep(f"\n```\n{body}\n```\n" if "\n" in body or not s.startswith("<") else f"`{body}`")

    text = _VERBATIM.sub(verbatim, text)
    if "\\" in text:
        text = _DRIVE.sub(lambda m: keep(m[0]), text)
    if html_:
        text = _REF.sub("", _COMMENT.sub("", _DROP.sub("", text)))
        text = _MATHTAG.sub(lambda m: keep(f"${_entities((m[1] or m[2] or '').strip())}$"), text)
    if tex:
        text = _EQUATION.sub(lambda m: keep(f"\n$${m[2]}$$\n"), text)
        text = _MATH.sub(lambda m: keep(m[0]), text)
        text = _BRMATH.sub(lambda m: keep(f"${m[1] or m[2]}$"), text)
    if html_:
        text = _HEAD.sub(lambda m: "\n\n# " + " ".join(_ANYTAG.sub("", m[1]).split()) + "\n\n", text)
        text = _ROWEND.sub("\n", _CELL.sub(" | ", text))
        text = _BR.sub("\n", _BLOCK.sub("\n\n", _ITEM.sub("\n- ", text)))
        text = _ANYTAG.sub("", text)
        text = _entities(text)
        text = _ANYTAG.sub("", text) if "<" in text else text
    if tex:
        text = _ACC.sub(_accent, text)
        text = _TABULAR.sub(lambda m: "\n" + re.sub(r"[ \t]*\\\\[ \t]*", "", m[1]).replace(" & ", " | ") + "\n", text)
        text = _SECTION.sub(r"# \1", text)
        text = _CMDGONE.sub("", text)
        for _ in range(3):
            text = _CMDARG1.sub(r"\1", text)
        text = re.sub(r"^[ \t]*\\item\b[ \t]*", "- ", text, flags=re.M)
        text = re.sub(r"^[ \t]*\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\{[^{}\n]*\})?[ \t]*\n?", "", text, flags=re.M)
        text = _BREAK.sub("", text)
        text = _WORDS.sub(lambda m: _WORD[m[1]], text)
        text = re.sub(r"(?<=\S)[ \t]*\\(?:par|quad|qquad|newline|smallskip|medskip|bigskip)\b[ \t]*", " ", text)
        text = _CMDREST.sub("", text)
        text = re.sub(r"(?<=\w)~(?=\d)", " ", text)
    if wiki:
        text = re.sub(r"^={1,6}[ \t]*([^=\n]+?)[ \t]*={1,6}[ \t]*$", r"# \1", text, flags=re.M)
        text = re.sub(r"\[\[(?:Kategorie|Category|Datei|File|Bild|Image|Catégorie|Fichier):[^\[\]\n]*\]\]", "", text)
        text = re.sub(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n]*)\]\]", r"\1", text)
        text = re.sub(r"\{\{[^{}\n|]*\|([^{}\n]*)\}\}", r"\1", text)
        text = re.sub(r"\{\{[^{}\n]*\}\}", "", text)
        text = re.sub(r"^\{\|.*$\n?|^\|\}[ \t]*$\n?|^\|-.*$\n?", "", text, flags=re.M)
        text = text.replace("||", "|") if "{|" in tokens else text
        text = re.sub(r"'{2,5}", "", text) if has("''") else text
        text = re.sub(r"\[\[|\]\]|\{\{|\}\}", "", text)
    if md:
        text = re.sub(r"^([^\n]*\S[^\n]*)\n={3,}[ \t]*$", r"# \1", text, flags=re.M)
        text = re.sub(r"^={3,}[ \t]*$\n?", "", text, flags=re.M) if "===" in tokens else text
        text = re.sub(r"^#{1,6}[ \t]+", "# ", text, flags=re.M)
        text = re.sub(r"!\[([^\[\]\n]*)\]\([^()\s]*\)", r"\1", text)
        text = re.sub(r"\[([^\[\]\n]*)\]\([^()\s]*\)", r"\1", text)
        text = _FOOT.sub("", re.sub(r"^\[\^[^\]\s]+\]:[^\n]*$\n?", "", text, flags=re.M))
        text = _LINKTAIL.sub("", text)
        text = re.sub(r"(?<![\w*_])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1(?![\w*])", r"\2", text)
        text = re.sub(r"(?<![\w*_/\\])(_{1,3})(?=[^\s_])([^_\n]*[^\s_])\1(?!\w)", r"\2", text)
        text = re.sub(r"~~([^~\n]*)~~", r"\1", text)
        text = re.sub(r"(?<![\w*])\*{2,3}(?=\w)|(?<![\w_])__(?=\w)|~~(?=\w)", "", text)
        text = re.sub(r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$\n?", "", text, flags=re.M)
        text = re.sub(r"^ {0,3}[-+*] +(?=[^\s*\-])", "- ", text, flags=re.M)
    if (md or wiki) and ("|" in tokens or "|---|" in tokens or "{|" in tokens):
        text = re.sub(r"^\|[ \t]*(.*?)[ \t]*\|?[ \t]*$", r"\1", text, flags=re.M)
    text = re.sub(r"[ \t]+$", "", re.sub(r"(?<=\S)  +(?=\S)", " ", text), flags=re.M)
    text = re.sub(r"\n{3,}", "\n\n", text)
    before = None
    while before != text:  # what was kept may hold what was kept before
        before, text = text, re.sub(f"{first}(\\d+){last}", lambda m: kept[int(m[1])], text)
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n")


_PLAIN_DDL = "doc_id bigint, site string, n_constructs bigint, families string, n_headings bigint, n_items bigint, n_formulas bigint, n_code bigint, plain_text string"
_PLAIN = pa.schema([("doc_id", pa.int64()), ("site", pa.string()), ("n_constructs", pa.int64()), ("families", pa.string()), ("n_headings", pa.int64()), ("n_items", pa.int64()), ("n_formulas", pa.int64()), ("n_code", pa.int64()), ("plain_text", pa.string())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates: dict = {}
    for b in batches:
        cols: list[list] = [[] for _ in range(9)]
        own = b.column("template")
        for i, (doc, site, text) in enumerate(zip(*(b.column(k).to_pylist() for k in ("doc_id", "site", "text")))):
            if site not in templates:
                templates[site] = frozenset((x["token"], x["role"]) for x in own[i].as_py() or ())
            template = templates[site]
            n, families, kinds = 0, set(), [0, 0, 0, 0]
            for token, role, family, *_ in constructs(text):
                if (token, role) not in template:
                    continue
                n += 1
                families.add(family)
                if token[0] in "#=" or token[:2] == "<h" and token != "<hi>" or token[:8] in ("\\chapter", "\\section", "\\subsect"):
                    kinds[0] += 1
                elif token in ("<li>", "<item>", "\\item", "-", "*", "+", "1."):
                    kinds[1] += 1
                elif token in ("$", "\\(", "\\[", "<math>", "\\begin{equation}"):
                    kinds[2] += 1
                elif token in ("```", "`", "<pre>", "<source>", "\\begin{verbatim}"):
                    kinds[3] += 1
            for col, v in zip(cols, (doc, site, n, ",".join(sorted(families)), *kinds, render(text, template) if n else text)):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PLAIN.types)], schema=_PLAIN)


def extract_plain_text(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document with non-empty text: number of markup constructs, families, structure counts, plain text.

    Null and empty texts give no row; repeated rows give repeated rows; other columns of the input are
    not carried, so their names can't clash. Very long texts are processed whole.
    """
    base = _docs(docs, id_col, text_col, source_col)
    if templates is None:
        templates = deduce_templates(docs, id_col, text_col, source_col)
    by_site = cut(templates.where("is_markup").groupBy("site").agg(F.collect_list(F.struct("token", "role")).alias("template")), "template")
    joined = join_checked(base, by_site, ["site"], "left")
    return joined.select("doc_id", "site", "text", "template").mapInArrow(_extract, _PLAIN_DDL)


def find_markup(docs: DataFrame) -> DataFrame:
    """doc_id of the documents that hold at least one token of their site's template."""
    rows = token_rows(docs)
    template = cut(template_of(rows).where("is_markup").select("site", "token", "role"), "template")
    return join_checked(rows, template, ["site", "token", "role"], "left_semi").select("doc_id").distinct()
