"""Noise in text from scanned pages (problem 3).

Method: headers and footers are found by fuzzy repetition of lines at page
edges, page numbers as sequences that count up, and lines are joined by
dehyphenation rules over the corpus's vocabulary.

* Fuzzy keys: letters without case, marks and digits, with characters that
  recognition confuses mapped to one, so that noisy repetitions agree. A line
  like the text's title away from its start is a running header; other lines must
  repeat and stand at a page edge (form feed, page number, another header).
* Page numbers: lines that are only a number, in one form, chained so that they
  count up over the text. Figures of tables don't chain.
* Vocabulary: counts of all words of all texts, combined map-side. Ordinary
  words are those with at least ``MIN_SHARE`` of all word occurrences (and
  ``MIN_COUNT``); as shares sum to one there are at most 1 / MIN_SHARE of them,
  which bounds what is broadcast at any corpus size. A form that is one confusion
  away from a word ``DOMINANCE`` times as frequent isn't ordinary.
* A line ends inside a word if it ends in a letter and a hyphenation mark and a
  word goes on in the next line of text. At a plain hyphen the corpus decides
  whether the joined word or the compound is known.
* A word is misread if it isn't ordinary but a confusion turns it into one.
  Capitalised words within a sentence, figures and halves of broken words aside.

Null and empty texts have no faults. Equal rows count once. Texts are read
whole. In a text without page edges only the title's repetitions are headers.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.plans.staging import stage

MIN_SHARE = 2e-5
MIN_COUNT = 5
DOMINANCE = 20

HYPHENS = "-­¬‐‑"
SURE_HYPHENS = "­¬"
TOKEN = re.compile(r"[\w@|$]+")  # of texts whose underscores were made blanks
COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐‑][^\W\d_]+)+")
LINE_HYPHEN = re.compile(rf"[{HYPHENS}][ \t]*\n\s*")
FIGURES = re.compile(r"(?<![^\W\d_])[0-9lIO|]+(?![^\W\d_])")
SERIES_SHARE = 2e-3
PARTS = re.compile(r"\s{2,}|\s[—–|]\s")
BROKEN = re.compile(r"((?:[^\W_]|[@|])+(?:[-'’‐](?:[^\W_]|[@|])+)*)([-­¬‐‑])\s*$")
GOES_ON = re.compile(r"\s*((?:[^\W\d_]|[@|0-9])+(?:[-‐](?:[^\W\d_])+)*)")
NUMBER = r"[0-9lIiOoSB|]{1,4}"
FIGURE = rf"(?-i:{NUMBER})"  # in other cases these letters are no figures: "sol", "12b"
PAGE = re.compile(
    rf"^\W*?(?:(?P<word>page|pages|p\.|pg\.?|folio|f\.)\s*(?P<a>{FIGURE})(?:\s*(?:/|sur|of|de)\s*{NUMBER})?|"
    rf"(?P<dash>[-–—]\s*)(?P<b>{FIGURE})\s*[-–—]|(?P<c>{FIGURE})\s*(?P<slash>/|sur|of)\s*{NUMBER}|(?P<d>{FIGURE}))\W*?$",
    re.I,
)
TAIL_PAGE = re.compile(rf"\|\s*p(?:age|\.)?\s*{NUMBER}\s*$", re.I)
# fixed values: characters that recognition confuses; for each the ones that may be meant
CONFUSED = {
    "0": "oO", "1": "liI", "|": "liI", "5": "sS", "6": "bé", "9": "gq", "@": "a", "8": "b", "3": "e", "4": "a", "$": "s",
    "c": "eo", "e": "c", "f": "t", "t": "f", "b": "h", "h": "b", "l": "i", "i": "l", "n": "u", "u": "n", "q": "g", "g": "q",
    "o": "c", "v": "y", "y": "v",
}
# fixed values: groups of characters that recognition confuses, as (read, meant)
GROUPS = (
    ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("m", "in"), ("m", "ni"), ("m", "rn"), ("n", "ri"), ("d", "cl"), ("in", "m"),
    ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("u", "ii"), ("u", "li"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"),
)
ALPHABET = "abcdefghijklmnopqrstuvwxyzàâäçèéêëîïôöùûüÿœæ"


def base(s: str) -> str:
    """The text without combining marks, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


_ACCENTED: dict[str, str] = {}
for _c in ALPHABET:
    _ACCENTED[base(_c)] = _ACCENTED.get(base(_c), "") + _c
_SAME = {"1": "i", "|": "i", "l": "i", "0": "o", "5": "s", "@": "a", "9": "g", "6": "b", "8": "b", "e": "c", "t": "f", "h": "b"}


def _key_table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for i in range(0x2100):
        c = chr(i)
        if c.isalpha() or c in _SAME:
            out[i] = "".join(_SAME.get(x, x) for x in base(c))
        else:
            out[i] = None
    return out


_KEY = _key_table()


def fuzzy_key(line: str) -> str:
    """Letters of a line under which noisy repetitions agree. Separate figures drop out."""
    s = FIGURES.sub("", line).translate(_KEY)
    return s.replace("rn", "m").replace("ri", "n").replace("ci", "d").replace("ii", "u")


def alike(a: str, b: str) -> float:
    """Share of agreeing characters of two keys, allowing one shift; 0 for lengths far apart."""
    n = min(len(a), len(b))
    if n == 0 or abs(len(a) - len(b)) > max(2, n // 8):
        return 0.0
    same = 0
    while same < n and a[same] == b[same]:
        same += 1
    tail = 0
    while tail < n - same and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    straight = sum(map(eq, a, b))
    return max(same + tail, straight) / max(len(a), len(b))


class Vocabulary:
    """Ordinary words and compounds with their counts."""

    def __init__(self, words: dict[str, int], compounds: dict[str, int], series: frozenset[str] = frozenset()):
        self.compounds, self.series = compounds, series
        self.words = {w: n for w, n in words.items() if w.isalpha() and w == unicodedata.normalize("NFKC", w)}
        shadow = [w for w, n in self.words.items() if len(w) >= 4 and any(self.words.get(c, 0) >= DOMINANCE * n for c in self._near(w))]
        for w in shadow:
            del self.words[w]
        self._by_key: dict[str, str] = {}
        for w in sorted(self.words, key=self.words.get):
            if len(w) >= 3:
                self._by_key[fuzzy_key(w)] = w
        self._known: dict[str, str | None] = {}
        self._sound = set(self.words) | {w.capitalize() for w in self.words}

    def sound(self, line: str) -> bool:
        """True if no token of the line can be a misread word, wherever it stands."""
        found = TOKEN.findall(line)
        if self._sound.issuperset(found):
            return True
        for w in found:
            if w not in self._sound:
                if any(c.isalpha() for c in w) and self.meant(w) is not None:
                    return False
                if len(self._sound) > 500_000:
                    self._sound = set(self.words) | {x.capitalize() for x in self.words}
                self._sound.add(w)
        return True

    @staticmethod
    def _near(w: str) -> Iterator[str]:
        """Forms one confusion away from ``w``."""
        for i, c in enumerate(w):
            head, tail = w[:i], w[i + 1 :]
            meant = CONFUSED.get(c, "").lower() + _ACCENTED.get(base(c), "")
            if not c.isalpha():
                meant += ALPHABET if len(w) >= 4 else ""
            for x in meant:
                if x != c:
                    yield head + x + tail
        for read, meant in GROUPS:
            at = w.find(read)
            while at >= 0:
                yield w[:at] + meant + w[at + len(read) :]
                at = w.find(read, at + 1)

    def meant(self, token: str) -> str | None:
        """The ordinary word that a misread token stands for; None if it's ordinary or nothing is near."""
        if token in self._known:
            return self._known[token]
        out, low = None, token.lower()
        if low not in self.words and len(low) >= 2:
            out = self._by_key.get(fuzzy_key(low))
            # names are many: only what can't be one is searched further
            if out is None and (token[0].islower() or not low.isalpha()):
                best = 0
                for c in self._near(low):
                    if self.words.get(c, 0) > best:
                        out, best = c, self.words[c]
                if out is None and len(low) >= 6:
                    for x in self._near(low):
                        for c in self._near(x):
                            if self.words.get(c, 0) > best:
                                out, best = c, self.words[c]
        if len(self._known) > 300_000:
            self._known.clear()
        self._known[token] = out
        return out

    def has(self, word: str) -> int:
        return self.words.get(word.lower(), 0)


def page_number(line: str) -> tuple[str, int] | None:
    """(form, value) of a line that is only a page number."""
    s = line.strip()
    m = PAGE.match(s) if s else None
    if not m:
        return None
    digits = m["a"] or m["b"] or m["c"] or m["d"]
    form = "word" if m["a"] else "dash" if m["b"] else "slash" if m["c"] else "plain"
    plain = digits.translate(str.maketrans("lIi|OoSB", "11110058"))
    if form == "plain" and not any(c.isdigit() for c in digits) and len(digits) < 2:
        return None
    return form, int(plain)


ROMAN = re.compile(r"^\W*(?=[ivxlc]+\W*$|[IVXLC]+\W*$)(m{0,3})(c[md]|d?c{0,3})(x[cl]|l?x{0,3})(i[xv]|v?i{0,3})\W*$", re.I)


def roman_number(line: str) -> int | None:
    """The value of a line that is only a Roman number in one case."""
    s = line.strip()
    if not s or not ROMAN.match(s):
        return None
    value, last = 0, 0
    for c in reversed([c for c in s.lower().replace("ı", "i") if c.isalpha()]):
        n = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c]
        value, last = (value - n, last) if n < last else (value + n, n)
    return value or None


def _longest_chain(own: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """The longest run of (line, value) that counts up by 1 to 3, a page being at least ``gap`` lines."""
    size, before = [1] * len(own), [-1] * len(own)
    # for each value its lines and the longest chain up to each
    lines: dict[int, list[int]] = defaultdict(list)
    best: dict[int, list[int]] = defaultdict(list)
    for k, (i, v) in enumerate(own):
        for step in (1, 2, 3):
            at = bisect_right(lines[v - step], i - gap) - 1
            if at >= 0 and size[best[v - step][at]] + 1 > size[k]:
                before[k] = best[v - step][at]
                size[k] = size[before[k]] + 1
        lines[v].append(i)
        last = best[v][-1] if best[v] else k
        best[v].append(k if size[k] >= size[last] else last)
    at = max(range(len(own)), key=lambda k: size[k], default=-1)
    chain = []
    while at >= 0:
        chain.append(own[at])
        at = before[at]
    return chain[::-1]


def number_chain(found: list[tuple[int, str, int]], gap: int = 8) -> set[int]:
    """Lines of the page numbers in one form that count up over the text.

    Numbers may be missing: chains are joined to the longest one where lines and
    values between them allow for pages of at least ``gap`` lines.
    """
    result: list[tuple[int, int]] = []
    for form in {f for _, f, _ in found}:
        own = sorted((i, v) for i, f, v in found if f == form)
        chains = [_longest_chain(own, gap)]
        while True:
            taken = sorted(x for c in chains for x in c)
            first, last = taken[0], taken[-1]
            fits = lambda x: (x < first and 0 < (first[1] - x[1]) * gap <= first[0] - x[0]) or (
                x > last and 0 < (x[1] - last[1]) * gap <= x[0] - last[0])
            more = _longest_chain([x for x in own if fits(x)], gap)
            if len(more) < 2 or len(chains[0]) < 2:
                break
            chains.append([x for x in more if (x < first) == (more[0] < first)])
        if len(taken) > len(result):
            result = taken
    return {i for i, _ in result}


class Groups:
    """Keys under the first key that is like them; candidates share some letters in place, so none is missed."""

    def __init__(self):
        self.members: dict[str, list[int]] = {}
        self._homes: list[str] = []
        self._at: dict[tuple[int, str], list[int]] = defaultdict(list)

    @staticmethod
    def _parts(key: str) -> list[tuple[int, str]]:
        # alike() at 0.85 asks for an equal start or end of four letters, or for under one difference in four letters
        n = 4 if len(key) > 9 else 3
        parts = [(p, key[p : p + n]) for p in range(0, len(key) - n + 1, n)]
        parts.append((-1, key[-n:]))
        if n == 4 and len(key) < 12:  # as shorter keys of up to two letters less are read
            parts += [(p, key[p : p + 3]) for p in range(0, len(key) - 2, 3)] + [(-1, key[-3:])]
        return parts

    def add(self, key: str, i: int) -> None:
        if key not in self.members:
            near = {h for part in self._parts(key) for h in self._at.get(part, ())}
            for h in sorted(near):
                home = self._homes[h]
                if abs(len(home) - len(key)) <= 2 and alike(home, key) >= 0.85:
                    key = home
                    break
            else:
                self.members[key] = []
                for part in self._parts(key):
                    self._at[part].append(len(self._homes))
                self._homes.append(key)
        self.members[key].append(i)


def furniture(lines: list[str], title: str | None, words: Vocabulary) -> set[int]:
    """Indexes of running headers, footers and page numbers."""
    filled = [i for i, s in enumerate(lines) if s.strip()]
    if not filled:
        return set()
    place = {i: k for k, i in enumerate(filled)}
    feed = {i for i in filled if lines[i].startswith("\f")}
    numbers = []
    for i in filled:
        s = lines[i].strip("\f \t")
        x, r = page_number(s), roman_number(s)
        if r is not None:
            numbers.append((i, "roman", r))
        if x and not (r is not None and x[0] == "plain" and s.strip() not in ("ll", "l", "I", "II")):
            numbers.append((i, *x))
    plain = {i for i, f, _ in numbers if f == "plain"}
    in_table = {i for i in plain if (i - 1 in plain) or (i + 1 in plain)}
    chain = number_chain([x for x in numbers if x[0] not in in_table])
    out = set(chain) if len(chain) > 1 else set()
    out |= {i for i, f, _ in numbers if f in ("word", "dash", "slash")}

    first = lines[filled[0]]
    raw = [x.strip() for x in (title or "", first) if x and x.strip()]
    names = [(fuzzy_key(x), x[:4].lower()) for x in raw]
    names += [(fuzzy_key(p), p[:4].lower()) for p in PARTS.split(first.strip()) if p != first.strip()]
    names = [x for x in names if len(x[0]) >= 8]
    keys: dict[int, str] = {}
    titled: list[int] = []
    suffixed: set[int] = set()
    series: list[int] = []
    for i in filled:
        s = lines[i].strip()
        if i in out or s[-1] in ".;":
            continue
        if s[0].islower():
            h = s[:4].lower()
            if not any(h[:2] == x[:2] or h[2:] == x[2:] or h[1:3] == x[1:3] for _, x in names):
                continue
        keys[i] = key = fuzzy_key(s)
        pieces = PARTS.split(s)
        parts = [key] if len(pieces) == 1 else [key, *filter(None, map(fuzzy_key, pieces))]
        if any(p in words.series for p in parts):
            series.append(i)
        for n, _ in names:
            if any(len(p) >= 8 and alike(p, n[: len(p)] if len(p) < len(n) else n) >= 0.8 for p in parts):
                titled.append(i)
                if len(pieces) > 1:
                    suffixed.add(i)
                break
    out |= set(series)
    # the title stands at the start: of the lines like it before any other text the fullest is the title itself
    start = []
    for i in filled:
        if i in out:
            continue
        if i not in titled:
            break
        if i not in suffixed:
            start.append(i)
    if start:
        real = max(start, key=lambda i: (len(keys[i]), not lines[i].strip().isupper(), i))
        own = {real}
    else:
        own = set()
    out |= {i for i in titled if i not in own}

    groups = Groups()
    for i, key in keys.items():
        if i in out or i in own or len(key) < 4:
            continue
        groups.add(key, i)

    def edge(i: int) -> bool:
        k = place[i]
        near = [filled[j] for j in (k - 1, k + 1) if 0 <= j < len(filled)]
        after = filled[k + 1] if k + 1 < len(filled) else None
        return i in feed or after in feed or any(j in out for j in near)

    for members in groups.members.values():
        at_edge = [i for i in members if edge(i)]
        if len(members) >= 2 and len(at_edge) * 2 >= len(members):
            out |= set(members)
        elif len(members) >= 3:
            gaps = sorted(b - a for a, b in zip(members, members[1:]))
            if gaps[0] >= 15 and gaps[-1] <= 1.5 * gaps[0]:
                out |= set(members)
    width = sorted(len(lines[i].strip()) for i in filled)[len(filled) * 9 // 10]
    for i in filled:
        s = lines[i].strip("\f ")
        if "|" in s and TAIL_PAGE.search(s):
            out.add(i)
        elif i in feed and i not in own and s and not s[0].islower() and len(s) < 0.8 * width and s[-1] not in ".;:!?" + HYPHENS:
            k = place[i]
            if k + 1 < len(filled) and k and lines[filled[k + 1]].strip()[:1].islower() and i in keys:
                out.add(i)
    # a lone number at the end of the text or beside a header is a page number too
    for i, form, _ in numbers:
        if form in ("plain", "roman") and i not in in_table and i not in out:
            k = place[i]
            near = [filled[j] for j in (k - 1, k + 1) if 0 <= j < len(filled)]
            if any(j in feed or (j in out and j in keys) for j in near if j > i) or (k == len(filled) - 1 and (out or k > 10)):
                out.add(i)
    return out


def read_scan(text: str, title: str | None, words: Vocabulary, repaired: bool = True) -> tuple[list[tuple[int, str]], list[str]]:
    """(faults as (line, kind), repaired paragraphs, none if not asked for) of a text."""
    lines = text.replace("_", " ").split("\n")
    gone = furniture(lines, title, words)
    faults = [(i + 1, "furniture") for i in sorted(gone)]
    body = [i for i in range(len(lines)) if i not in gone]
    filled = [i for i in body if lines[i].strip()]
    following = dict(zip(filled, filled[1:]))
    joined: dict[int, tuple[str, int]] = {}  # line -> (text to take over, length of the next line's half)
    half_start: set[int] = set()
    for i in filled:
        s = lines[i].rstrip()
        if s[-1] not in HYPHENS or i not in following:
            continue
        m = BROKEN.search(s)
        j = following[i]
        r = GOES_ON.match(lines[j].lstrip("\f"))
        if not m or not r or lines[j].strip()[:1] in HYPHENS or not any(c.isalpha() for c in m[1]):
            continue
        left, mark, right = m[1], m[2], r[1]
        tail = re.split(r"['’]", left)[-1]
        if mark not in SURE_HYPHENS:
            compound = f"{tail}-{right}".lower().replace("‐", "-")
            together = f"{tail}{right}".lower()
            if words.compounds.get(compound, 0) > words.has(together):
                continue
            last, first = re.split(r"[-‐]", tail)[-1], re.split(r"[-‐]", right)[0]
            if not words.has(together) and not words.compounds.get(together) and words.has(last) and words.has(first) and len(last) > 2 and len(first) > 2:
                if not words.meant(together):
                    continue
        faults.append((i + 1, "hyphen"))
        joined[i] = (s[: m.start(2)], len(lines[j].lstrip("\f")) - len(lines[j].lstrip("\f").lstrip()) + len(right))
        half_start.add(j)
    fixed: dict[int, str] = {}
    ended = True
    for i in filled:
        s = lines[i]
        if words.sound(s):
            ended = s.rstrip()[-1:] in ".!?:"
            continue
        tokens = list(TOKEN.finditer(s))
        wrong = []
        broken = i in joined or s.rstrip()[-1] in HYPHENS
        for k, t in enumerate(tokens):
            w = t[0]
            opens = ended if k == 0 else s[tokens[k - 1].end() : t.start()].strip()[-1:] in (".", "!", "?", ":", "•") or (
                k == 0 and s[: t.start()].strip() != "")
            if not w.strip("@|$") or (k == 0 and i in half_start) or (broken and t.end() >= len(s.rstrip()) - 1):
                continue
            n = sum(c.isalpha() for c in w)
            if n == 0 or (n < len(w) and n * 2 < len(w)) or w.isupper() and len(w) > 1 and not ended:
                continue
            if w in words.words or (w[0].isupper() and not opens):
                continue
            x = words.meant(w)
            if x:
                wrong.append((t.start(), t.end(), x.capitalize() if w[0].isupper() else x))
        ended = s.rstrip()[-1:] in ".!?:"
        if wrong:
            faults.append((i + 1, "misread"))
            for a, b, x in reversed(wrong):
                s = s[:a] + x + s[b:]
            fixed[i] = s
    if not repaired:
        return faults, []
    paragraphs: list[str] = []
    open_text, skip, gap = "", 0, True
    for i in body:
        s = fixed.get(i, lines[i]).strip("\f")
        if not s.strip():
            gap = gap or not open_text.endswith("\u0000")
            gap = True if not open_text.endswith("\u0000") else gap
            continue
        continues = open_text.endswith("\u0000")
        s = s[skip:] if continues else s
        skip = 0
        starts = not continues and (gap and not (open_text and s.lstrip()[:1].islower() and open_text[-1:] not in ".!?:"))
        if not continues and re.match(r"\s*(?:[-•*]|\d+[.)])\s", s):
            starts = True
        if starts and open_text:
            paragraphs.append(open_text)
            open_text = ""
        gap = False
        t = s.strip()
        if i in joined:
            cut = fixed.get(i, lines[i]).rstrip()[:-1].strip("\f ")
            cut = cut[len(fixed.get(i, lines[i]).strip("\f ")) - len(t) :] if continues else cut
            t = cut.strip() + "\u0000"
            skip = joined[i][1]
            j = following[i]
            t = t[:-1] + lines[j].lstrip("\f")[:skip].strip() + "\u0000"
        if continues:
            open_text = open_text[:-1] + (t if t[:1] in ".,;:!?)»" else " " + t if t.strip("\u0000") else t)
        else:
            open_text = f"{open_text} {t}" if open_text else t
    if open_text:
        paragraphs.append(open_text)
    return faults, [re.sub(r"\s+", " ", p.replace("\u0000", "")).strip() for p in paragraphs]


def edge_keys(lines: list[str]) -> Iterator[tuple[str, bool]]:
    """(key, at an edge) of each part of the lines that may be headers of a series."""
    edges = {i for i, s in enumerate(lines) if s.startswith("\f") or page_number(s)}
    for i, s in enumerate(lines):
        t = s.strip()
        if len(t) >= 6 and not t[0].islower() and t[-1] not in ".;,:":
            near = i in edges or not edges.isdisjoint((i - 1, i + 1, i - 2, i + 2))
            parts = PARTS.split(t)
            if near or len(parts) > 1:
                for p in parts:
                    key = fuzzy_key(p)
                    if len(key) >= 8:
                        yield key, near or len(parts) > 1


def without_halves(text: str) -> str:
    """The text without the halves of words at hyphens before line ends."""
    parts = LINE_HYPHEN.split(text)
    for i in range(len(parts) - 1):
        parts[i] = parts[i][: max(parts[i].rfind(" "), parts[i].rfind("\n")) + 1]
        rest = parts[i + 1].split(None, 1)
        parts[i + 1] = rest[1] if len(rest) > 1 else ""
    return " ".join(parts)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words: Counter[str] = Counter()
        compounds: Counter[str] = Counter()
        series: Counter[str] = Counter()
        texts = 0
        for text in b.column(0).to_pylist():
            whole = without_halves(text).lower().replace("_", " ")
            words.update(TOKEN.findall(whole))
            for w in whole.split():
                if "-" in w or "‐" in w:
                    compounds.update(c.replace("‐", "-").replace("‑", "-") for c in COMPOUND.findall(w))
            series.update({k for k, _ in edge_keys(text.split("\n"))})
            texts += 1
        rows = [("total", "", words.total()), ("texts", "", texts)]
        for kind, counts in (("word", words), ("compound", compounds), ("series", series)):
            rows += [(kind, w, n) for w, n in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["kind", "word", "n"]
        )


def vocabulary(texts: DataFrame) -> Vocabulary:
    """Ordinary words and compounds, and parts of headers shared by many texts, of ``texts(text)``.

    All are bounded by their shares: at most 1 / MIN_SHARE words, as many
    compounds, and, a text having few page edges, some 1 / SERIES_SHARE times
    those of headers.
    """
    counts = texts.select("text").where("text is not null").mapInArrow(_count_batches, "kind string, word string, n long")
    counts = stage(counts.groupBy("kind", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT), "p3-counts")
    sizes = {r.kind: r.n for r in counts.where("kind in ('total', 'texts')").collect()}
    least = max(MIN_COUNT, MIN_SHARE * sizes.get("total", 0))
    shared = max(MIN_COUNT, SERIES_SHARE * sizes.get("texts", 0))
    floor = F.when(F.col("kind") == "series", shared).otherwise(least)
    by: dict[str, dict[str, int]] = {"word": {}, "compound": {}, "series": {}}
    for r in counts.where(F.col("kind").isin(*by) & (F.col("n") >= floor)).collect():
        by[r.kind][r.word] = r.n
    return Vocabulary(by["word"], by["compound"], frozenset(by["series"]))


def _read(texts: DataFrame, words: Vocabulary, repaired: bool) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            out: list[tuple] = []
            for item, field, title, text in zip(*(c.to_pylist() for c in b.columns)):
                faults, paragraphs = read_scan(text, title, v, repaired)
                if repaired:
                    out.append((item, field, len(faults), "\n\n".join(paragraphs)))
                else:
                    out.extend((item, field, no, fault) for no, fault in faults)
            if out:
                last = (pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), *last))], ["item", "field", "n", "value"]
                )

    some = texts.select("item", "field", "title", "text").where("text is not null and text <> ''")
    return some.mapInArrow(run, "item string, field string, n int, value string")


def faults(texts: DataFrame) -> DataFrame:
    """(item, field, line_no, fault) of ``texts(item, field, title, text)``."""
    return _read(texts, vocabulary(texts), False).select(
        "item", "field", F.col("n").alias("line_no"), F.col("value").alias("fault")
    ).distinct()


def repair(texts: DataFrame) -> DataFrame:
    """(item, field, n_faults, text) with each text as continuous paragraphs."""
    return _read(texts, vocabulary(texts), True).select(
        "item", "field", F.col("n").alias("n_faults"), F.col("value").alias("text")
    )
