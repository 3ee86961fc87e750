"""Texts cut off by field limits or in transfer, and how often each source truncates.

The site's repeated lines are left aside first. Near-copies are found by min-hash banding over shingles of five
words, of the whole text and of its beginnings, so that a copy meets the whole text however much it lost. A pair is
verified if the other text holds at least 0.8 of the open one's shingles; where the alignment of an open text with
another text ends early and inside a sentence or word, it is truncated. Other texts are scored by how terminal
their closing word is: word counts over all texts say how often a word closes a sentence, line or
entry, and whether a line without a final mark reads like whole entries or like prose. All counts
cover all documents. A text that ends with a sentence mark is whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.markup import render
from quire.llm.sitelines import document_items, enough_letters, known_by_group, mask_line, mine_templates, split_lines, template_hash, with_templates
from quire.plans.runtime import cut, join_checked

SHINGLE, SIMILARITY = 5, 0.8
#: 10 bands of 3 least hashes for whole texts: a pair at the similarity meets in some band with a chance of 0.999.
BANDS, BAND_ROWS, BAND_BITS = 10, 3, 5
#: Beginnings of 32, 128, 512 … words have 4 bands of 3: what a cut copy still shares with the whole one is nearly equal.
LEAST_START, START_STEP, START_BANDS, START_BITS = 32, 4, 4, 4
#: Own lines with words at the end that are looked at first for the closing word; all lines are, if these are other sites' lines.
TAIL_LINES = 6
#: A word that closes a unit in less than this share of its uses is no closing word.
NOT_CLOSING = 0.004
#: An ellipsis joined to a word is a trail-off only after a word that closes units this often.
OFTEN_CLOSING = 0.3
#: A task's word counts are emitted once it has so many words.
MAX_WORDS = 300_000
#: Texts profiled at once.
SLICE = 2000
#: A class of more texts is split into parts of about so many, which an open text meets one after the other.
CLASS_TEXTS = 1000

#: Marks around words and after sentences.
_AROUND = "\"'»«”“„’‘‚)(][›‹.!?…,;:*_~`#|=<>&{}$/\\–—-·•©"
_CLOSING = "\"'»«”“’‘)]›‹"
_TAGS = re.compile(r"<[^<>]*>|&lt;/?[A-Za-z][^&<>]*&gt;|&#?\w+;")
_CLOSER = re.compile(r"</[A-Za-z][\w:]*>")
_DOTS = re.compile(r"(?:…|\.\.\.|[\])])[\s<>/\w\"'»«”“’‘)\]]*\Z")
_SENTENCE = re.compile(r"[.!?…][\"'»«”“’‘)\]›‹]*,?\s+(?=\S)")
_BULLET = re.compile(r"\s*(?:[-*+•·–—|]|\d{1,3}[.)])\s+")
_SIGNS = re.compile(r"[<&\[\]{}$*_~'\\|=#`]")
_OPENING = re.compile(r"[<$\\`]")
_MARKER = re.compile(r"[.!?…][\"'»«”“’‘)\]]*\s+(\*{1,3}|_{1,3}|'{2,5}|~~|`)[^*_'`~\s]+\1\s*\Z")
_M = np.uint64(0xFF51AFD7ED558CCD)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M
    return h ^ (h >> np.uint64(29))


def ends_marked(text: str) -> bool:
    """Whether a sentence mark ends the text, whatever quotes, brackets and blanks follow it."""
    while (end := text.rstrip().rstrip(_CLOSING)) != text:
        text = end
    return text.endswith((".", "!", "?", "…"))


def without_closers(line: str) -> str:
    """The line without closing tags at its end."""
    while (line := line.rstrip()).endswith(">") and _CLOSER.fullmatch(line, max(0, line.rfind("<"))):
        line = line[: line.rfind("<")]
    return line


def words_of(text: str) -> list[str]:
    """Blank-separated words without the marks around them."""
    return [w for t in text.split() if (w := t.strip(_AROUND))]


class Tokens(dict):
    """Raw token to number; per number its word, whether a sentence ends with it, and the word's hash."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.word_of: list[int] = []
        self.ends: list[bool] = []
        self.hashes: list[int] = []

    def __missing__(self, token: str) -> int:
        word = token.strip(_AROUND)
        self.word_of.append(self.words.setdefault(word, len(self.words)) if word else -1)
        self.ends.append(token.rstrip(_CLOSING)[-1:] in (".", "!", "?", "…") and bool(token.rstrip(_CLOSING)))
        self.hashes.append(xxhash.xxh64_intdigest(word.lower()))
        self[token] = n = len(self.word_of) - 1
        return n


def _rolled(h: np.ndarray) -> np.ndarray:
    """Hash of the shingle that begins at each position; the last SHINGLE - 1 of a text run into the next one."""
    out = np.zeros(len(h), dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(SHINGLE, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            out = (out + padded[j : j + len(h)]) * _P
    return _mix(out)


def shingle_hashes(words: list[str]) -> np.ndarray:
    """Distinct hashes of the five-word shingles, sorted; a shorter text has one shingle, an empty one none."""
    h = np.asarray([xxhash.xxh64_intdigest(w.lower()) for w in words], dtype=np.uint64)
    return np.unique(_rolled(h)[: max(1, len(h) - SHINGLE + 1)]) if len(h) else h


def band_matrix(hashes: np.ndarray, docs: np.ndarray, n: int, bands: int = BANDS, bits: int = BAND_BITS, salt: int = 0) -> np.ndarray:
    """Band keys of n texts by one-permutation min-hashing: the least hash of each of 2**bits bins, empty bins filled from
    the next. hashes are the texts' shingles, docs their text's number; a text without shingles gets unused keys."""
    top, bins = np.uint64(0xFFFFFFFFFFFFFFFF), 1 << bits
    least = np.full(n * bins, top, dtype=np.uint64)
    np.minimum.at(least, docs * bins + (hashes >> np.uint64(64 - bits)).astype(np.int64), hashes)
    least = least.reshape(n, bins)
    place = np.where(least != top, np.arange(bins), 2 * bins)
    twice = np.concatenate([place, np.minimum(place + bins, 3 * bins)], axis=1)
    nxt = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :bins]
    with np.errstate(over="ignore"):
        value = np.take_along_axis(least, nxt % bins, axis=1) + ((nxt - np.arange(bins)) % (2 * bins)).astype(np.uint64) * _P
        rows = value[:, : bands * BAND_ROWS].reshape(n, bands, BAND_ROWS)
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(salt << 8), (n, bands))
        for j in range(BAND_ROWS):
            key = _mix(key * _P + rows[:, :, j])
    return key.view(np.int64)


def all_keys(rolled: np.ndarray, doc: np.ndarray, place: np.ndarray, own: np.ndarray) -> list[list[int]]:
    """Band keys of each text, of the whole and of its beginnings: rolled are the shingles' hashes, doc and place where
    each begins, own the number of words of each text."""
    keys = [k if n else [] for k, n in zip(band_matrix(rolled, doc, len(own)).tolist(), own.tolist())]
    size = LEAST_START
    while (long := np.flatnonzero(own > size)).size:
        number = np.full(len(own), -1)
        number[long] = np.arange(len(long))
        inside = (number[doc] >= 0) & (place <= size - SHINGLE)
        for d, more in zip(long, band_matrix(rolled[inside], number[doc[inside]], len(long), START_BANDS, START_BITS, size).tolist()):
            keys[d] += more
        size *= START_STEP
    return keys


_TAIL = [("kind", pa.string()), ("closing", pa.string()), ("words", pa.list_(pa.string())), ("after_sentence", pa.bool_())]
_TAIL_DDL = "kind string, closing string, words array<string>, after_sentence boolean"
_PROFILE = pa.schema([
    ("word", pa.string()), ("n_all", pa.int64()), ("n_end", pa.int64()), ("n_entry", pa.int64()), ("n_prose", pa.int64()), ("n_start", pa.int64()),
    ("item_id", pa.int64()), ("grp", pa.string()), ("n_words", pa.int64()), ("keys", pa.list_(pa.int64())), ("digest", pa.int64()), ("last_hash", pa.int64()), *_TAIL,
])
_PROFILE_DDL = f"word string, n_all bigint, n_end bigint, n_entry bigint, n_prose bigint, n_start bigint, item_id bigint, grp string, n_words bigint, keys array<bigint>, digest bigint, last_hash bigint, {_TAIL_DDL}"


def digest_of(lines: list[str]) -> int:
    """Hash of a text's lines that aren't blank: equal for exact copies, as a signed number."""
    h = xxhash.xxh64_intdigest("\n".join(lines))
    return h - (1 << 64) if h >> 63 else h


_HAS_WORD = re.compile(rf"[^\s{re.escape(_AROUND)}]")


def closing_lines(lines: list[str]) -> list[str]:
    """The lines from the TAIL_LINES-th last one with words on."""
    seen = 0
    for k in range(len(lines) - 1, -1, -1):
        line = lines[k]
        if "<" in line or "&" in line:
            line = _TAGS.sub(" ", line)
        seen += _HAS_WORD.search(line) is not None
        if seen == TAIL_LINES:
            return lines[k:]
    return lines


def line_hash(line: str) -> int:
    """The line's template hash, 0 if it has too few letters to be a site's line."""
    masked = mask_line(line)
    return template_hash(masked) if enough_letters(masked) else 0


class Counts:
    """Word counts of a task: all uses, unit-closing uses, uses in unmarked and marked lines, marked line starts."""

    def __init__(self) -> None:
        self.tokens, self.n = Tokens(), np.zeros((5, 0), dtype=np.int64)

    def add(self, row: int, words: np.ndarray) -> None:
        self.n[row] += np.bincount(words[words >= 0], minlength=self.n.shape[1])

    def grow(self) -> None:
        more = len(self.tokens.words) - self.n.shape[1]
        self.n = np.pad(self.n, ((0, 0), (0, more)))

    def rows(self) -> list[tuple]:
        return [(w, *map(int, self.n[:, i])) for w, i in self.tokens.words.items()]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, of = Counts(), {}

    def emit(docs: list[tuple], words: list[tuple]) -> pa.RecordBatch:
        rows = [(None,) * 6 + d for d in docs] + [w + (None,) * 10 for w in words]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 16, _PROFILE.types)], schema=_PROFILE)

    for b in (x.slice(k, SLICE) for x in batches for k in range(0, x.num_rows, SLICE)):
        docs, flat, sizes, last = [], [], [], []
        for item, grp, text, known in zip(*(b.column(k).to_pylist() for k in ("item_id", "grp", "text")), known_by_group(b, of)):
            lines = [x for x in split_lines(text, known)[0] if x and not x.isspace()]
            if not lines:
                continue
            before = len(flat)
            for line in lines:
                if "<" in line or "&" in line:
                    line = _TAGS.sub(" ", line)
                n = len(flat)
                flat += line.split()
                if len(flat) > n:
                    sizes.append(len(flat) - n)
                    last.append(False)
            if len(flat) > before:
                last[-1] = True
            docs.append([item, grp, len(flat) - before, None, digest_of(lines), line_hash(lines[-1]), *analyse_lines(lines)])
        if docs:
            t = counts.tokens
            ids = np.fromiter(map(t.__getitem__, flat), dtype=np.int64, count=len(flat))
            counts.grow()
            word, ends, hashed = np.asarray(t.word_of, dtype=np.int64)[ids], np.asarray(t.ends, dtype=bool)[ids], np.asarray(t.hashes, dtype=np.uint64)[ids]
            line_end = np.cumsum(np.asarray(sizes, dtype=np.int64)) - 1
            line_start = line_end - np.asarray(sizes, dtype=np.int64) + 1
            is_last, marked = np.asarray(last, dtype=bool), ends[line_end] if len(line_end) else np.zeros(0, dtype=bool)
            kind = np.repeat(np.where(is_last, 0, np.where(marked, 2, 1)), sizes)
            inner = np.ones(len(ids), dtype=bool)
            inner[line_end[is_last]] = False  # a text's last word may be cut
            counts.add(0, word[inner])
            counts.add(1, word[inner & ends])
            counts.add(1, word[line_end[~is_last & ~marked]])
            counts.add(2, word[kind == 1])
            counts.add(3, word[kind == 2])
            counts.add(4, word[line_start[~is_last & marked]])
            # shingles over words only, within each text
            length = np.asarray([d[2] for d in docs], dtype=np.int64)
            doc = np.repeat(np.arange(len(docs)), length)
            keep = word >= 0
            doc, hashed = doc[keep], hashed[keep]
            own = np.bincount(doc, minlength=len(docs))
            place = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
            # a text shorter than a shingle is one shingle, cut off from what follows it
            ok = (place <= own[doc] - SHINGLE) | ((own[doc] < SHINGLE) & (place == 0))
            rolled = _rolled(hashed)
            for d in np.flatnonzero((own > 0) & (own < SHINGLE)):
                at = int(np.cumsum(own)[d] - own[d])
                rolled[at] = _rolled(hashed[at : at + own[d]])[0]
            for d, keys, n in zip(docs, all_keys(rolled[ok], doc[ok], place[ok], own), own.tolist()):
                d[2], d[3] = n, keys
        words = counts.rows() if len(counts.tokens) >= MAX_WORDS else []
        if words:
            counts = Counts()
        yield emit([tuple(d) for d in docs], words)
    yield emit([], counts.rows())


_NO_WORDS: tuple[str, str, list[str], bool] = ("whole", "", [], False)


def analyse_tail(lines: list[str]) -> tuple[str, str, list[str], bool]:
    """(kind, closing word, words of the last unit, whether sentences stand before it in its line).

    Kinds: whole (a sentence mark ends the text, or there are no words), broken (a comma or a torn
    character ends it), joined and spaced (an ellipsis joined to the last word, or after a blank), bare (no mark).
    """
    # most texts end with a sentence mark, at most followed by closing tags
    if lines and "`" not in lines[-1] and ends_marked(without_closers(lines[-1])) and not _DOTS.search(lines[-1]):
        return "whole", "", [], False
    raw = "\n".join(lines).rstrip()
    if _MARKER.search(raw):
        return "whole", "", [], False
    # signs before the last line matter only if they may open something that goes on in it
    text = render(raw) if _SIGNS.search(raw[raw.rfind("\n") + 1 :]) or _OPENING.search(raw) else raw
    if text.rstrip().endswith("```"):
        return "whole", "", [], False
    if "$" in text:
        text = re.sub(r"(?:\s*\$[^$\n]*\$)+\s*\Z", "", text)
    last = next((x for x in reversed(text.split("\n")) if _HAS_WORD.search(x)), "").strip()
    if not last:
        return _NO_WORDS
    if last.endswith("�"):
        return "broken", "", [], False
    ellipsis = re.search(r"(\s*)(?:…|\.\.\.|\[…\]|\[\.\.\.\]|\(…\)|\(\.\.\.\))[\"'»«”“’‘)\s]*\Z", last)
    bullet = _BULLET.match(last)
    body = last[bullet.end() :] if bullet else last
    if ellipsis:
        words = words_of(body)
        return ("spaced" if ellipsis[1] else "joined"), (words[-1] if words else ""), words, False
    if ends_marked(last):
        return "whole", "", [], False
    bare = body.rstrip(" \t \"&<>*_~`'’\\/|-–—")
    if re.search(r"[,;(\[„»‚]\s*[»«\"”“]?\Z", bare) or re.search(r"«,\Z", bare):
        return "broken", "", [], False
    cuts = list(_SENTENCE.finditer(body))
    fragment = body[cuts[-1].end() :] if cuts else body
    words = words_of(fragment)
    if not words:
        return "whole", "", [], False
    return "bare", words[-1], words, bool(cuts)


def analyse_lines(lines: list[str]) -> tuple[str, str, list[str], bool]:
    """analyse_tail of the closing lines; of all lines, if those have no words when rendered."""
    tail = closing_lines(lines)
    found = analyse_tail(tail)
    return analyse_tail(lines) if found is _NO_WORDS and len(tail) < len(lines) else found


_LINES = pa.schema([("item_id", pa.int64()), ("tail", pa.list_(pa.string())), ("tail_hashes", pa.list_(pa.int64()))])


def _all_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of: dict = {}
    for b in batches:
        rows = []
        for item, text, known in zip(*(b.column(k).to_pylist() for k in ("item_id", "text")), known_by_group(b, of)):
            lines = [x for x in split_lines(text, known)[0] if x and not x.isspace()]
            rows.append((item, lines, list(map(line_hash, lines))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 3, _LINES.types)], schema=_LINES)


_TAILS = pa.schema([("item_id", pa.int64()), *_TAIL])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The analysis of the lines before other sites' lines at the end."""
    for b in batches:
        rows = []
        for item, tail, foreign in zip(*(b.column(k).to_pylist() for k in ("item_id", "tail", "foreign"))):
            out = frozenset(foreign or ())
            own = list(tail)
            while own and line_hash(own[-1]) in out:
                own.pop()
            rows.append((item, *analyse_lines(own)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 5, _TAILS.types)], schema=_TAILS)


_ALIGNED = pa.schema([("digest", pa.int64()), ("other", pa.int64()), ("early", pa.bool_())])


def aligned_early(short: str, long: str) -> bool | None:
    """None if the long text doesn't hold the short one's shingles; else whether the short one's end is followed, in the long
    one, by the rest of the word or of the sentence. Lines the long one doesn't have may stand behind the short one's end."""
    placed = [(w, k) for k, line in enumerate(short.split("\n")) for w in words_of(line)]
    a, b = [w for w, _ in placed], words_of(long)
    x, y = shingle_hashes(a), shingle_hashes(b)
    common = len(np.intersect1d(x, y, assume_unique=True))
    if not common or common < SIMILARITY * len(x):
        return None
    lines = [(w, k) for k, line in enumerate(long.split("\n")) for w in line.split()]
    tokens = [(w.strip(_AROUND), w, k) for w, k in lines if w.strip(_AROUND)]
    places: dict[tuple, list[int]] = {}
    for i in range(len(b) - SHINGLE):
        places.setdefault(tuple(b[i : i + SHINGLE]), []).append(i)

    def best_place(found: list[int], j: int) -> int:
        """Of a shingle said again the place before which the most words agree, too; the last one after 64 words."""
        for n in range(1, 65):
            if len(found) == 1:
                break
            found = [i for i in found if i >= n and j >= n and b[i - n] == a[j - n]] or found[-1:]
        return found[-1]

    for j in range(len(a) - 1, SHINGLE - 1, -1):
        added = j + 1 < len(a)
        if added and placed[j][1] == placed[j + 1][1]:
            continue
        found = places.get(tuple(a[j - SHINGLE : j]))
        if found is None:
            continue
        i = best_place(found, j - SHINGLE)
        final, (word, raw, line) = a[j], tokens[i + SHINGLE]
        if word != final:
            return word.startswith(final) and not (added and word == final + a[j + 1])
        if raw.rstrip(_CLOSING)[-1:] in (".", "!", "?", "…"):
            return not added and not ends_marked(short)  # only the mark is missing
        more = tokens[i + SHINGLE + 1 : i + SHINGLE + 2]
        return bool(more) and more[0][2] == line and not (added and more[0][0] == a[j + 1])
    return False


_ALIGN = "digest bigint, other bigint, early boolean"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for digest, other, short, long in zip(*(b.column(k).to_pylist() for k in ("digest", "other", "short", "long"))):
            early = aligned_early(short, long)
            if early is not None:
                rows.append((digest, other, early))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), _ALIGNED.types)], schema=_ALIGNED)


_OWN = pa.schema([("digest", pa.int64()), ("own", pa.string())])


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of: dict = {}
    for b in batches:
        rows = []
        for text, known in zip(b.column("text").to_pylist(), known_by_group(b, of)):
            lines = split_lines(text, known)[0]
            rows.append((digest_of([x for x in lines if x and not x.isspace()]), "\n".join(lines).rstrip()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], []), _OWN.types)], schema=_OWN)


def contexts(words: list[str]) -> np.ndarray:
    """Hash of the SHINGLE words before each place from SHINGLE on, in this spelling."""
    h = np.asarray([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    return _rolled(h)[: max(0, len(h) - SHINGLE)].view(np.int64)


_ASKS = pa.schema([("digest", pa.int64()), ("h", pa.int64()), ("final", pa.string()), ("added", pa.bool_()), ("then", pa.string()), ("closed", pa.bool_())])
_ASKS_DDL = "digest bigint, h bigint, final string, added boolean, then string, closed boolean"
_SHOWS = pa.schema([("other", pa.int64()), ("h", pa.int64()), ("w", pa.string()), ("marked", pa.bool_()), ("next", pa.string())])
_SHOWS_DDL = "other bigint, h bigint, w string, marked boolean, next string"


def _asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every place where a text may end: its last word and each line's, with what stands before and behind it."""
    for b in batches:
        rows = []
        for digest, own in zip(b.column("digest").to_pylist(), b.column("own").to_pylist()):
            placed = [(w, k) for k, line in enumerate(own.split("\n")) for w in words_of(line)]
            words, closed = [w for w, _ in placed], ends_marked(own)
            before = contexts(words).tolist()
            for j in range(SHINGLE, len(placed)):
                added = j + 1 < len(placed)
                if not added or placed[j][1] != placed[j + 1][1]:
                    rows.append((digest, before[j - SHINGLE], words[j], added, words[j + 1] if added else "", closed))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 6, _ASKS.types)], schema=_ASKS)


def _shows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word of a text with what stands before it, whether it ends a sentence, and the next word of its line."""
    for b in batches:
        cols: list[list] = [[] for _ in range(5)]
        for digest, own in zip(b.column("digest").to_pylist(), b.column("own").to_pylist()):
            tokens = [(w, t, k) for k, line in enumerate(own.split("\n")) for t in line.split() if (w := t.strip(_AROUND))]
            before = contexts([w for w, _, _ in tokens]).tolist()
            later = [(w if k == line else "") for (w, _, k), (_, _, line) in zip(tokens[1:], tokens)] + [""]
            cols[0] += [digest] * len(before)
            cols[1] += before
            for j in range(SHINGLE, len(tokens)):
                cols[2].append(tokens[j][0])
                cols[3].append(tokens[j][1].rstrip(_CLOSING)[-1:] in (".", "!", "?", "…"))
                cols[4].append(later[j])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SHOWS.types)], schema=_SHOWS)


def _copies(base: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, early) of open texts whose shingles a text holds that goes on where they end; docs has item_id, n_words,
    keys, digest and open.

    Exact copies count as one text. Only buckets with an open text and another one are followed up. Within a bucket an
    open text is aligned only with texts that go on where it, or one of its lines, ends: both sides are joined by bucket
    and by the words before that place, so copies that end alike make no pairs. Texts that go on alike there are a class;
    an open text first meets the longest of each class. Texts that no alignment has ended early yet then meet the
    others: large classes are split into parts by hash, and each round takes twice the parts of the last.
    """
    keyed = docs.select("digest", "n_words", "open", "item_id", F.explode("keys").alias("key"))
    live = keyed.groupBy("key").agg(F.min("digest").alias("a"), F.max("digest").alias("z"), F.bool_or("open").alias("o")).where("o AND a <> z")
    live = cut(live.select("key"), "live")
    held = join_checked(keyed, live, ["key"], "left_semi").groupBy("key", "digest").agg(F.bool_or("open").alias("open"), F.max("n_words").alias("n_words"), F.min("item_id").alias("item_id"))
    held = cut(held, "held")
    # the texts of these buckets, each once
    wanted = held.groupBy("digest").agg(F.min("item_id").alias("item_id")).select("item_id").distinct()
    texts = base.join(wanted, "item_id", "left_semi").select("grp", "text", "known").mapInArrow(_own_text, "digest bigint, own string")
    texts = cut(texts.dropDuplicates(["digest"]), "texts")
    asks = cut(texts.join(held.where("open").select("digest").distinct(), "digest", "left_semi").mapInArrow(_asks, _ASKS_DDL), "asks")
    shows = cut(join_checked(texts.mapInArrow(_shows, _SHOWS_DDL), cut(asks.select("h").distinct(), "contexts"), ["h"], "left_semi"), "shows")
    shown = cut(shows.join(held.select("key", F.col("digest").alias("other"), "n_words"), "other"), "shown")
    alike = ["key", "h", "w", "marked", "next"]
    classes = shown.groupBy(*alike).agg(F.max(F.struct("n_words", "other")).alias("top"), F.ceil(F.count("*") / CLASS_TEXTS).alias("parts"))
    classes = classes.select(*alike, F.col("top.other").alias("other"), "parts")
    # the places that aligned_early takes for an early end
    torn = (F.col("w") != F.col("final")) & F.startswith("w", "final") & ~(F.col("added") & (F.col("w") == F.concat("final", "then")))
    unmarked = F.col("marked") & ~F.col("added") & ~F.col("closed")
    going_on = ~F.col("marked") & (F.col("next") != "") & ~(F.col("added") & (F.col("next") == F.col("then")))
    early = torn | ((F.col("w") == F.col("final")) & (unmarked | going_on))
    asking = asks.join(held.where("open").select("key", "digest"), "digest")
    asking = cut(asking.join(classes, ["key", "h"]).where(early).select("digest", *alike, "other", "parts"), "asking")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select("digest", F.col("own").alias("short")), "digest").join(texts.select(F.col("digest").alias("other"), F.col("own").alias("long")), "other")
        return cut(both.select("digest", "other", "short", "long").mapInArrow(_align, _ALIGN), "aligned")

    tried = cut(asking.where("digest <> other").select("digest", "other").distinct(), "pairs")
    found = verify(tried)
    low, high = 0, 1
    most = int(asking.agg(F.max("parts")).first()[0] or 0)
    while low < most:
        rest = asking.where(F.col("parts") > low).join(found.where("early").select("digest").distinct(), "digest", "left_anti")
        rest = rest.select("digest", *alike, "parts", F.explode(F.sequence(F.lit(low).cast("bigint"), F.least(F.lit(high).cast("bigint"), "parts") - 1)).alias("part"))
        pairs = rest.join(shown.select(*alike, "other"), alike).where(F.pmod(F.xxhash64("other"), "parts") == F.col("part")).where("digest <> other").select("digest", "other").distinct()
        pairs = cut(pairs.join(tried, ["digest", "other"], "left_anti"), "pairs")
        tried, found = tried.union(pairs), found.union(verify(pairs))
        low, high = high, 2 * high + 1
    ended = found.groupBy("digest").agg(F.bool_or("early").alias("early"))
    return docs.where("open").select("item_id", "digest").join(ended, "digest").groupBy("item_id").agg(F.bool_or("early").alias("early"))


def begun_words(words: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The distinct prefixes (column `prefix`) that begin a longer word (column `word`).

    In order of their bytes the words that a prefix begins follow right after it, so each prefix is compared with the
    next word only. The order is made by ranges over all tasks; a range's last prefixes look at the next range's first word.
    """
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = words.select("word", F.col("word").alias("w")).unionByName(prefixes.select(F.col("prefix").alias("word"), F.lit(None).cast("string").alias("w")))
    ranged = cut(both.where("word IS NOT NULL").repartitionByRange(tasks, "word").withColumn("p", F.spark_partition_id()), "ranged")
    firsts = {r["p"]: r["w"] for r in ranged.where("w IS NOT NULL").groupBy("p").agg(F.min("w").alias("w")).collect()}  # one row a task
    after, later = [], None
    for p in range(tasks - 1, -1, -1):
        after.append((p, later))
        later = firsts.get(p, later)
    after = words.sparkSession.createDataFrame(after, "p int, later string")
    # a prefix that is a word, too, stands behind it
    following = ranged.withColumn("next", F.expr("lead(w) IGNORE NULLS OVER (PARTITION BY p ORDER BY word, w NULLS LAST)"))
    asked = following.where("w IS NULL").join(F.broadcast(after), "p").select(F.col("word").alias("prefix"), F.coalesce("next", "later").alias("next"))
    return asked.where(F.startswith("next", "prefix") & (F.col("next") != F.col("prefix"))).select("prefix").distinct()


def judge(docs: DataFrame, explain: bool = False) -> DataFrame:
    """(item_id, grp, kind, closing, near_copy, aligned_early, closing_share, entry_score, truncated) per document.

    Documents with null text are left out, and texts without own words are whole. A doc_id given twice is
    judged by all its rows. Extra columns are not carried; an empty table gives no rows.
    """
    items = document_items(docs)
    templates = mine_templates(items)
    base = with_templates(items, templates)
    profile = cut(base.select("item_id", "grp", "text", "known").mapInArrow(_profile, _PROFILE_DDL), "profile")
    words = profile.where("word IS NOT NULL").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n_all", "n_end", "n_entry", "n_prose", "n_start")))
    words = cut(words, "words")
    totals = words.agg(F.sum("n_entry"), F.sum("n_prose"), F.sum("n_start")).first()
    n_entry, n_prose, n_start = (float(x or 0) + 1 for x in totals)
    rows = profile.where("item_id IS NOT NULL")
    anywhere = cut(templates.select(F.col("template_hash").alias("last_hash")).distinct(), "anywhere")
    # texts that end with another site's line are looked at again, up to the last line that is their own
    again = cut(join_checked(rows.where("last_hash <> 0").select("item_id", "last_hash"), anywhere, ["last_hash"], "left_semi").select("item_id").distinct(), "again")
    lines = cut(join_checked(base, again, ["item_id"], "left_semi").select("item_id", "grp", "text", "known").mapInArrow(_all_lines, "item_id bigint, tail array<string>, tail_hashes array<bigint>"), "lines")
    hashes = lines.select("item_id", F.explode("tail_hashes").alias("last_hash")).where("last_hash <> 0")
    foreign = join_checked(hashes, anywhere, ["last_hash"], "inner").groupBy("item_id").agg(F.collect_set("last_hash").alias("foreign"))
    ended = lines.select("item_id", "tail").join(foreign, "item_id", "left").mapInArrow(_tails, f"item_id bigint, {_TAIL_DDL}")
    tails = join_checked(rows.select("item_id", "kind", "closing", "words", "after_sentence"), again, ["item_id"], "left_anti").union(cut(ended, "tails"))
    open_ = tails.where("kind <> 'whole'")
    # how texts without a final mark begin their last line, against how prose lines begin
    lasts = tails.where("kind = 'bare' AND NOT after_sentence").groupBy(F.col("words")[0].alias("word")).agg(F.count("*").alias("n_last"))
    lasts = cut(lasts, "lasts")
    n_last = float(lasts.agg(F.sum("n_last")).first()[0] or 0) + 1
    is_open = cut(open_.select("item_id").distinct().withColumn("open", F.lit(True)), "open")
    flagged = join_checked(rows.select("item_id", "n_words", "keys", "digest"), is_open, ["item_id"], "left")
    copies = _copies(base, flagged.select("item_id", "n_words", "keys", "digest", F.coalesce("open", F.lit(False)).alias("open")))
    # the closing word and the other words of the last unit, each with its counts
    one = open_.select("item_id", F.posexplode("words").alias("pos", "word"), F.size("words").alias("n"))
    stat = one.join(words, "word", "left").join(lasts, "word", "left").fillna(0, ["n_all", "n_end", "n_entry", "n_prose", "n_start", "n_last"])
    ratio = F.log((F.col("n_entry") + 0.5) / n_entry) - F.log((F.col("n_prose") + 0.5) / n_prose)
    start = F.log((F.col("n_last") + 0.5) / n_last) - F.log((F.col("n_start") + 0.5) / n_start)
    is_last = F.col("pos") == F.col("n") - 1
    score = stat.groupBy("item_id").agg(
        F.sum(F.when(F.col("n_all") > 0, ratio).otherwise(0.0) + F.when(F.col("pos") == 0, start).otherwise(0.0)).alias("entry_score"),
        F.max(F.when(is_last, F.col("n_all"))).alias("closing_uses"),
        F.max(F.when(is_last, F.col("n_end") / F.greatest("n_all", F.lit(1)))).alias("closing_share"),
    )
    # unknown closing words that begin a known one are cut words
    unknown = open_.join(score.where("closing_uses = 0").select("item_id"), "item_id").select(F.col("closing").alias("prefix")).distinct()
    begun = begun_words(words.select("word"), cut(unknown, "unknown")).withColumn("begun", F.lit(True)).withColumnRenamed("prefix", "closing")
    out = rows.select("item_id", "grp").join(tails, "item_id").join(score, "item_id", "left").join(begun, "closing", "left").join(copies, "item_id", "left")
    numeric = F.col("closing").rlike(r"^[\d\-]+$")
    known = F.col("closing_uses") > 0
    no_close = (known & (F.col("closing_share") < NOT_CLOSING)) | (~known & F.coalesce("begun", F.lit(False)))
    entry = F.col("entry_score") - F.when(F.col("after_sentence"), 5.0).otherwise(0.0) >= 0
    bare = F.when(~entry, True).when(numeric, False).otherwise(no_close)
    joined = ~(known & (F.col("closing_share") >= OFTEN_CLOSING) & (F.length("closing") > 2))
    truncated = (
        F.when(F.col("kind") == "whole", False).when(F.col("kind") == "broken", True)
        .when(F.coalesce("early", F.lit(False)) & F.col("kind").isin("bare", "joined"), True)
        .when(F.col("kind") == "joined", joined).when(F.col("kind") == "spaced", no_close).otherwise(bare)
    )
    out = out.select("item_id", "grp", "kind", "closing", F.col("early").isNotNull().alias("near_copy"), F.coalesce("early", F.lit(False)).alias("aligned_early"), "closing_share", "entry_score", F.coalesce(truncated, F.lit(False)).alias("truncated"), *(["words", "closing_uses", "begun"] if explain else []))
    return out


def find_truncated(docs: DataFrame) -> DataFrame:
    """doc_id of the truncated documents."""
    return judge(docs).where("truncated").select(F.col("item_id").alias("doc_id")).distinct()


def truncation_by_source(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_truncated, share) per source, in lower case without outer blanks."""
    judged = judge(docs).groupBy("grp").agg(F.sum(F.col("truncated").cast("long")).alias("n_truncated"))
    total = document_items(docs).groupBy("grp").agg(F.count("*").alias("n_docs"))
    out = total.join(judged, "grp", "left").fillna(0, ["n_truncated"])
    return out.select(F.col("grp").alias("source"), "n_docs", "n_truncated", (F.col("n_truncated") / F.col("n_docs")).alias("share"))
