"""p9: evaluation texts leaking into training text.

One Aho-Corasick automaton over the items' word shingles scans each normalised
text once; its hits are chained, the gaps between them are aligned word by
word, and offsets lead back to the original text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from meridia.session import table

#: A passage of LEAST_WORDS words with one in EDIT_SHARE changed holds a run of SHINGLE unchanged ones.
SHINGLE, LEAST_WORDS, EDIT_SHARE = 4, 15, 6
#: An opening sentence that so many items share is an instruction.
COMMON_OPENING = 3
#: No gap between hits, and no passage's end, need be longer. A passage of more words than this falls into blocks of LEAST_WORDS to 29,
#: and of these one has no more edits for its words than the whole; so if any passage leaks, one of at most 29 words does.
REACH = 30

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--|-->")
_LINK = re.compile(r"\[\[[^\[\]|]*\|")
_BRACES = re.compile(r"\{\{|\}\}")
_ASIDE = re.compile(r"<!--.*?-->|<ref\b[^<>]*(?<!/)>.*?</ref\s*>", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d{1,6}|#x[0-9a-fA-F]{1,5}|[a-zA-Z]{2,8});")
_QUOTE = re.compile("['’‘`´­​]")
_WORD = re.compile(r"[^\W_]+")
# Entities that stand for a letter's mark rather than a blank.
_JOINING = {"&shy;": "", "&zwj;": "", "&zwnj;": "", "&apos;": "", "&#39;": "", "&#039;": "", "&rsquo;": "", "&lsquo;": ""}


def asides(text: str) -> list[str]:
    """The text without what interrupts it, and then each interruption's own text: notes in balanced double braces, of any length and depth, comments and references."""
    spans = [(m.start(), m.end(), m.start() + 4) for m in _ASIDE.finditer(text)] if "<" in text else []
    opened: list[int] = []
    for m in _BRACES.finditer(text) if "{{" in text else ():
        if m[0] == "{{":
            opened.append(m.start())
        elif opened:
            b = opened.pop()
            spans.append((b, m.end(), b + 2))
    if not spans:
        return [text]
    main, inner, at = [], [], 0
    for b, e, begin in sorted(spans, key=lambda s: (s[0], -s[1])):
        if b < at:  # within the last one; it comes with that one's own text
            continue
        main.append(text[at:b])
        inner.append(text[begin:e])
        at = e
    main.append(text[at:])
    return [" ".join(main), *(x for t in inner for x in asides(t))]


def bare(text: str) -> str:
    """The text in lower case without tags and signs of markup; links leave their words."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[[" in text:
        text = _LINK.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: _JOINING.get(m[0].lower(), " "), text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _QUOTE.sub("", text.lower())


def words(text: str) -> list[str]:
    return _WORD.findall(bare(text))


def own_texts(items: list[tuple[int, str]]) -> dict[int, list[str]]:
    """Each item's words, without an opening sentence that it shares with others."""
    opening = lambda t: re.split(r"(?<=[.!?:])\s+", t.strip(), maxsplit=1)[0]
    count = Counter(opening(t) for _, t in items if t)
    out = {}
    for i, t in items:
        if not t:
            continue
        o = opening(t)
        rest = t.strip()[len(o) :]
        out[i] = words(rest if count[o] >= COMMON_OPENING and rest.strip() else t)
    return {i: w for i, w in out.items() if len(w) >= LEAST_WORDS}


class Scanner:
    """The automaton of some items."""

    def __init__(self, items: dict[int, list[str]]):
        self.items = items
        at = defaultdict(list)
        for i, w in items.items():
            for k in range(len(w) - SHINGLE + 1):
                at["".join(w[k : k + SHINGLE])].append((i, k))
        self.automaton = ahocorasick.Automaton()
        for p, where in at.items():
            self.automaton.add_word(p, (len(p), where))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def leaked(self, text: str | None) -> list[int]:
        """The items leaked. What interrupts a passage is read apart from it, and so is itself searched."""
        if not text or self.empty:
            return []
        found: set[int] = set()
        for part in asides(text):
            found.update(self._passages(words(part), found))
        return sorted(found)

    def _passages(self, found: list[str], known: set[int]) -> Iterator[int]:
        """Items with a passage among these words. Letters and digits are scanned without their blanks, so that spacing does not matter."""
        if len(found) < SHINGLE:
            return
        hits = list(self.automaton.iter("".join(found)))
        if not hits:
            return
        ends, n = [], 0
        for w in found:
            n += len(w)
            ends.append(n)
        by_item: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for e, (size, where) in hits:
            j = bisect_right(ends, e - size + 1)
            for i, k in where:
                if i not in known:
                    by_item[i].add((j, k))
        for i, pairs in by_item.items():
            if best_passage(self.items[i], found, sorted(pairs)):
                yield i


def edits(a: list[str], b: list[str]) -> int:
    """Words to change, add or drop between two lists."""
    if not a or not b:
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def reaching(a: list[str], b: list[str]) -> list[int]:
    """For each number of words of a, the least edits to align them with any number of words of b."""
    row = list(range(len(b) + 1))
    out = [0]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
        out.append(min(row))
    return out


def best_passage(item: list[str], doc: list[str], pairs: list[tuple[int, int]]) -> tuple[int, int] | None:
    """(first, last) word of the document in a passage of at least LEAST_WORDS words of the item with at most one edit in EDIT_SHARE, or None."""
    # runs of unbroken words: (doc from, item from, length)
    runs: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    for j, k in pairs:
        r = open_.get(j - k)
        if r and j <= r[0] + r[2]:
            r[2] = max(r[2], j - r[0] + SHINGLE)
        else:
            r = [j, k, SHINGLE]
            open_[j - k] = r
            runs.append(r)
    for r in runs:
        if r[2] >= LEAST_WORDS:
            return r[0], r[0] + r[2] - 1
    runs.sort()

    def gap(p: list[int], r: list[int]) -> int | None:
        """Edits between two runs, or None where the second can't follow the first; runs that overlap share words."""
        dj, dk = r[0] - (p[0] + p[2]), r[1] - (p[1] + p[2])
        if min(dj, dk) <= -SHINGLE or max(dj, dk) > REACH or r[0] <= p[0] or r[1] <= p[1]:
            return None
        back = max(0, -dj, -dk)
        return edits(item[p[1] + p[2] - back : r[1]], doc[p[0] + p[2] - back : r[0]])

    gaps: dict[tuple[int, int], int | None] = {}
    rights: dict[int, list[int]] = {}
    for s, p in enumerate(runs):
        cost = {s: 0}  # the fewest edits from this run to each later one, by any runs between
        left = None
        for e in range(s, len(runs)):
            r = runs[e]
            if r[0] > p[0] + p[2] + 2 * REACH:
                break
            if e > s:
                ways = []
                for m, c in cost.items():
                    if (m, e) not in gaps:
                        gaps[m, e] = gap(runs[m], r)
                    if gaps[m, e] is not None:
                        ways.append(c + gaps[m, e])
                if not ways:
                    continue
                cost[e] = min(ways)
            core = r[1] + r[2] - p[1]
            if core >= LEAST_WORDS and EDIT_SHARE * cost[e] <= core:
                return p[0], r[0] + r[2] - 1
            if left is None:
                left = reaching(item[max(0, p[1] - REACH) : p[1]][::-1], doc[max(0, p[0] - REACH - 8) : p[0]][::-1])
            if e not in rights:
                rights[e] = reaching(item[r[1] + r[2] : r[1] + r[2] + REACH], doc[r[0] + r[2] : r[0] + r[2] + REACH + 8])
            for x, dl in enumerate(left):
                for y, dr in enumerate(rights[e]):
                    span = core + x + y
                    if span >= LEAST_WORDS and EDIT_SHARE * (cost[e] + dl + dr) <= span:
                        return max(0, p[0] - x), r[0] + r[2] - 1 + y
    return None


def leaks(documents: DataFrame, items: list[tuple[int, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, doc_id) of each item whose own text the document holds, at least LEAST_WORDS words of it in order at one place.

    documents: key and text, other columns are not read. Null and empty texts
    leak nothing, as items of fewer words cannot be leaked. Each text is read
    whole and once, by one automaton of all items; nothing is shuffled. The
    items are held-out test material, which does not grow with the corpus; they
    reach each executor as one broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(own_texts(items))
    kind = dict(documents.dtypes)[key]

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # one automaton for a whole partition
        scanner = Scanner(shared.value)
        for part in parts:
            rows = [(i, d) for d, t in zip(part[key], part[text]) for i in scanner.leaked(t)]
            yield pd.DataFrame(rows, columns=["item_id", "doc_id"])

    return documents.select(key, text).mapInPandas(scan, f"item_id long, doc_id {kind}")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "eval_items").select("item_id", "text").collect()]
    return leaks(table(spark, sf_dir, "documents"), items)
