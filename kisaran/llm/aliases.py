"""Free-entered names onto a canonical list.

An Aho-Corasick automaton over the canonical names and all their aliases finds
embedded mentions in the cleaned name; of overlapping mentions the longest wins.
What holds no mention goes to a token-set comparison that knows typing errors,
digits for letters, old spelling, abbreviations, cut words and joined words, and
asks for every word of an alias.  The rest is unmatched.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "unmatched"

#: The reference list is read by the driver and sent to the tasks; beyond this
#: many names the operator refuses.
MAX_NAMES = 200_000

# Digits typed for letters, and pre-1972 Indonesian spelling.
LOOK_ALIKES = str.maketrans({"4": "a", "3": "e", "0": "o", "5": "s", "7": "t", "8": "b"})
OLD_SPELLING = [("oe", "u"), ("dj", "j"), ("tj", "c"), ("nj", "ny"), ("sj", "sy"), ("ch", "kh")]
# Words that say how or where a good is sold, not which good it is.
FILLERS = frozenset(
    "harga hrg rata rata2 ratarata komoditas komoditi eceran grosir pasar pagi siang sore lokal kw super kualitas kwalitas mutu per kg kilo liter ltr ikat butir "
    "jenis nama barang price of the".split()
)


def clean(name: str) -> str:
    """Lower case, one blank between words, no marks, markup or invisible signs."""
    s = html.unescape(re.sub(r"&([A-Za-z]{2,8});", lambda m: m[0].lower(), name))
    s = re.sub(r"<[^>]{0,200}>", " ", s)
    s = unicodedata.normalize("NFKC", s)
    s = "".join(c for c in s if unicodedata.category(c) not in ("Cf", "Mn"))
    s = re.sub(r"\[[^\]]*\]|\([^)]*\)", lambda m: " " if _aside(m[0]) else f" {m[0][1:-1]} ", s)
    s = re.sub(r"[^\w]+|_", " ", s.casefold())
    return s.strip()


def _aside(bracketed: str) -> bool:
    words = re.findall(r"\w+", bracketed.casefold())
    return all(w in FILLERS or w.isdigit() for w in words)


def letters(word: str) -> str:
    """A word with digits read as the letters they resemble."""
    if word.isdigit() or not re.search(r"\d", word):
        return word
    if re.fullmatch(r"\d+[a-z]{1,2}", word):
        return word
    return word.translate(LOOK_ALIKES)


def _readings(word: str) -> list[str]:
    """The word as typed, with its digits as letters (1 may be an i or an l), in
    modern spelling, and with letters held too long taken once."""
    out = {word}
    if re.search(r"\d", word) and not word.isdigit():
        w = word.translate(LOOK_ALIKES)
        out |= {w.replace("1", "i"), w.replace("1", "l")}
    out |= {x for w in list(out) for x in (modern(w), modern(w).replace("dj", "#").replace("j", "y").replace("#", "j"))}
    out |= {re.sub(r"(.)\1+", r"\1", w) for w in list(out)}
    return sorted(out)


def modern(word: str) -> str:
    for old, new in OLD_SPELLING:
        word = word.replace(old, new)
    return word


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, given up beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i]
        for j, cb in enumerate(b, 1):
            cost = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (ca != cb))
            if two is not None and j > 1 and i > 1 and ca == b[j - 2] and a[i - 2] == cb:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def _signature(word: str) -> int:
    """The set of a word's characters as bits; each edit changes at most two."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def close(a: str, b: str, most: int) -> int:
    """:func:`edits`, after two cheap bounds."""
    if abs(len(a) - len(b)) > most or (_signature(a) ^ _signature(b)).bit_count() > 2 * most:
        return most + 1
    return edits(a, b, most)


def _subsequence(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def word_likeness(typed: str, word: str) -> float:
    """0 to 1: how well a typed word stands for a word of the list."""
    if typed == word:
        return 1.0
    best = 0.0
    for t in _readings(typed):
        if t == word:
            return 0.98
        n = len(word)
        if len(t) >= 3 and word.startswith(t):  # cut off
            best = max(best, 0.8 + 0.15 * len(t) / n)
        elif len(t) >= 2 and len(t) < n and t[0] == word[0] and _subsequence(t, word) and not re.search("[aiueo]", t[1:]):  # consonants only
            best = max(best, 0.86)
        most = 1 if n <= 5 else 2 if n <= 9 else 3
        d = close(t, word, most)
        if d <= most:
            best = max(best, 1 - d / max(n, len(t)) * (0.9 if t[0] == word[0] else 1.05))
        if len(t) >= 4 and len(t) < n:  # cut off with a typing error
            d = close(t, word[: len(t)], 1)
            if d <= 1:
                best = max(best, 0.9 - 0.5 / len(t) - 0.1 * (n - len(t)) / n)
    return best


@dataclass
class Matcher:
    """Compiled list: ``names`` are (name, slug) pairs."""

    names: list[tuple[str, str]]
    threshold: float = 0.7
    margin: float = 0.02
    _auto: object = field(init=False, repr=False)
    _sets: list = field(init=False, repr=False)
    _vocabulary: list = field(init=False, repr=False)
    _known: dict = field(init=False, repr=False)

    def __post_init__(self) -> None:
        import ahocorasick

        seen: dict[str, str] = {}
        for name, slug in sorted(self.names):
            key = clean(name or "")
            if key and slug:
                seen.setdefault(key, slug)
        self._auto = ahocorasick.Automaton()
        for key, slug in seen.items():
            self._auto.add_word(f" {key} ", (len(key), slug))
        if seen:
            self._auto.make_automaton()
        self._sets = [(key.split(), slug, key.replace(" ", "")) for key, slug in seen.items()]
        self._vocabulary = sorted({w for words, _, _ in self._sets for w in words})
        self._known = {}

    def mentions(self, text: str) -> list[tuple[int, int, str]]:
        """Longest non-overlapping mentions (start, end, slug) in a cleaned text."""
        if not self._sets:
            return []
        found = []
        for end, (length, slug) in self._auto.iter(f" {text} ".replace("  ", " ")):
            found.append((end - length - 1, end - 1, slug))
        taken: list[tuple[int, int, str]] = []
        for m in sorted(found, key=lambda m: (m[0] - m[1], m[0])):
            if all(m[1] <= t[0] or m[0] >= t[1] for t in taken):
                taken.append(m)
        return sorted(taken)

    def match(self, name: str | None) -> tuple[str, str, float]:
        """(slug or ``unmatched``, how, likeness)."""
        if name is None or not (text := clean(name)):
            return UNMATCHED, "empty", 0.0
        for form in dict.fromkeys([text, " ".join(letters(w) for w in text.split())]):
            if hits := self.mentions(form):
                slug = max(hits, key=lambda m: m[1] - m[0])[2]
                return slug, "mention", 1.0
        return self._similar([w for w in text.split() if w not in FILLERS and not w.isdigit()] or text.split())

    def _likeness(self, typed: str) -> dict[str, float]:
        """Words of the list that ``typed`` may stand for; kept for the task."""
        known = self._known.get(typed)
        if known is None:
            if len(self._known) > 200_000:
                self._known.clear()
            known = self._known[typed] = {w: s for w in self._vocabulary if (s := word_likeness(typed, w)) >= 0.66}
        return known

    def _similar(self, words: list[str]) -> tuple[str, str, float]:
        best: dict[str, float] = {}
        likes = [self._likeness(w) for w in words]
        joined = _readings("".join(words))
        for alias, slug, _ in self._sets:
            s = max(self._set_likeness(words, likes, alias), self._set_likeness(words, likes, alias[::-1]))
            if s > best.get(slug, 0.0):
                best[slug] = s
        if max(best.values(), default=0.0) < 0.8:
            for alias, slug, solid in self._sets:
                turned = (1 - 0.02 * k for k in range(1, len(alias)) if "".join(alias[k:] + alias[:k]) in joined)
                s = max(self._solid_likeness(joined, words, solid, alias), *turned, 0.0)
                if s > best.get(slug, 0.0):
                    best[slug] = s
        if not best:
            return UNMATCHED, "none", 0.0
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))
        slug, top = ranked[0]
        second = ranked[1][1] if len(ranked) > 1 else 0.0
        if top >= self.threshold and top - second >= self.margin:
            return slug, "similar", top
        return UNMATCHED, "below" if top < self.threshold else "ambiguous", top

    @staticmethod
    def _set_likeness(words: list[str], likes: list[dict[str, float]], alias: list[str]) -> float:
        """Least word likeness and mean over the alias's words, each standing for
        another typed word; typed words left over cost a little."""
        free, scores = list(range(len(words))), []
        for a in alias:
            best, at = 0.0, -1
            for i in free:
                s = likes[i].get(a, 0.0)
                if s > best:
                    best, at = s, i
            if at < 0:
                return 0.0
            free.remove(at)
            scores.append(best)
        rest = sum(len(words[i]) for i in free) / max(1, sum(map(len, words)))
        return (0.5 * min(scores) + 0.5 * sum(scores) / len(scores)) * (1 - 0.35 * rest)

    @staticmethod
    def _solid_likeness(readings: list[str], words: list[str], solid: str, alias: list[str]) -> float:
        """Words written together, or with the blank in the wrong place."""
        best = 0.0
        for t in readings:
            most = max(1, len(solid) // 6)
            d = close(t, solid, most)
            if d <= most:
                best = max(best, 1 - 1.6 * d / len(solid))
            elif len(t) >= max(6, len(alias[0]) + 3) and len(t) < len(solid):  # cut off
                d = close(t, solid[: len(t)], 1)
                if d <= 1 and len(t) >= 0.6 * len(solid):
                    best = max(best, 0.88 - d / len(t) - 0.1 * (len(solid) - len(t)) / len(solid))
        if best and len(words) == len(alias) and len(words) > 1:
            # blanks in place: word by word is the sterner test, unless a blank slipped
            slipped = [len(w) for w in words] != [len(a) for a in alias]
            return best if slipped and best > 0.8 else 0.0
        return best


def reference_names(commodities: DataFrame, max_names: int = MAX_NAMES) -> list[tuple[str, str]]:
    """(name, slug) of every slug, display name and alias; ValueError beyond the bound."""
    every = commodities.select(
        "slug", F.explode(F.array_distinct(F.array_compact(F.concat(F.array(F.col("display_name"), F.translate("slug", "-_", "  ")), F.coalesce(F.flatten(F.map_values("source_aliases")), F.array().cast("array<string>")))))).alias("name")
    ).where("slug is not null").distinct()
    rows = every.limit(max_names + 1).collect()
    if len(rows) > max_names:
        raise ValueError(f"more than {max_names} names on the list")
    return [(r["name"], r["slug"]) for r in rows]


_MATCHERS: dict[int, Matcher] = {}


def shared_matcher(reference: list[tuple[str, str]], **settings) -> Matcher:
    """The compiled list, with the words it has met, kept for later tasks of a worker."""
    key = hash((tuple(reference), tuple(sorted(settings.items()))))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(reference, **settings)
    return _MATCHERS[key]


def match_names(names: DataFrame, column: str, reference: list[tuple[str, str]], **settings) -> DataFrame:
    """``entered``, ``slug``, ``how`` and ``likeness`` of each distinct name.

    NULL, empty and blank names come out as ``unmatched``/``empty``.  Very long
    texts are scanned whole by the automaton.  Equal likeness of two slugs is
    ``unmatched``/``ambiguous``.  An empty list leaves everything unmatched.

    Scale: names are reduced to distinct ones with a map-side combine first, so a
    name typed in a third of all rows is matched once; the list is shipped to the
    tasks (bounded by MAX_NAMES) and compiled once per task.
    """
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Matching costs far more per byte than adaptive coalescing assumes, so the number of
    # partitions is given; twice the usual one, as an equal exchange would be left out.
    distinct = names.select(F.col(column).alias("entered")).distinct().repartition(2 * parts, "entered")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = shared_matcher(reference, **settings)
        for pdf in batches:
            out = [matcher.match(x) for x in pdf["entered"]]
            yield pd.DataFrame({"entered": pdf["entered"], "slug": [o[0] for o in out], "how": [o[1] for o in out], "likeness": [o[2] for o in out]})

    return distinct.mapInPandas(run, "entered string, slug string, how string, likeness double")


def map_names(rows: DataFrame, column: str, reference: list[tuple[str, str]], **settings) -> DataFrame:
    """``rows`` with ``slug`` and ``how`` for the name in ``column``; every row is kept."""
    matched = match_names(rows, column, reference, **settings)
    keep = [F.col(f"r.{c}") for c in rows.columns]
    return rows.alias("r").join(matched.alias("m"), F.col(f"r.{column}").eqNullSafe(F.col("m.entered")), "left").select(*keep, F.col("m.slug").alias("_slug"), F.col("m.how").alias("_how"))
