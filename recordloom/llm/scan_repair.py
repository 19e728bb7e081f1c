"""Repair text of scanned pages: broken words, running headers, page numbers and misread characters.

Layout. Lines of a row are judged in pairs by boosted-tree classifiers. One tells furniture (running headers,
footers, page numbers) from the lines around it by how they would flow without it, two more whether furniture holds a
page number and other text; one tells whether a line goes on with the paragraph of the line before, one whether a word
is broken at a line end or owns its hyphen. They are trained on synthetic pages set from at most ``TRAIN_ROWS``
unscanned rows of the same table. Furniture of these pages is drawn from at most ``TRAIN_LINES`` lines that repeat over
the pages of a record, since text does not, and from a few general forms.

Words. Every word of the whole table is counted, once for each distinct content below the record's own header, so
copies of a page do not make its misreadings frequent. Words of scanned rows that are rare are looked up among
frequent words through an inverted join of character q-grams, taken after signs that recognition confuses are
folded together. Grams are ordered from rare to frequent, and only as many of them are joined as two words with
enough common grams must share. A boosted-tree ranking trained on artificial misreadings and on ordinary slips, which
are no misreadings, chooses the replacement or none.

Scale: the lexicon keeps words with a share of at least ``LEXICON_SHARE`` of all words, so it has no more than
1 / LEXICON_SHARE entries whatever the size of the data; rare words, candidates and corrections stay
distributed and are joined by word and row. Lines of all pages of an Arrow batch are scored together.

Defined results: rows without page (``page_number`` null or 0) and null contents are left out, as they are no scans;
every scanned row comes out, unchanged where nothing is wrong. Contents whose lines are not set to a width, empty ones
too, have no line damage but may have misread words; repeated rows count under each id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.boost import Boosted, fit_boosted
from recordloom.session import stage

LEXICON_SHARE = 2e-6
RARE_SHARE = 3e-5
TRAIN_ROWS = 1000
TRAIN_LINES = 1500
LINE_ROWS = 50_000  # rows among whose records repeated lines are looked for
TRAIN_WORDS = 2000
GRAM = 2
LETTERS = re.compile(r"[^\W\d_]+")
_TERMINAL = re.compile(r"[.!?:][\"'”’)\]]*$")
_EDGE = "\"'“”‘’.,;:?)]}»…"
_FRONT = "\"'“”‘’[{«"
# fixed values: what recognition confuses, each as read -> as printed
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("ı", "i"), ("5", "s"), ("$", "s"), ("@", "a"), ("(", "c"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"),
    ("c", "e"), ("e", "c"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ni", "m"), ("in", "m"), ("vv", "w"), ("w", "vv"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"),
    ("li", "h"), ("ii", "u"), ("u", "ii"), ("o", "0"), ("l", "i"), ("i", "l"), ("q", "g"), ("g", "q"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"), ("tl", "d"), ("¢", "c"), ("€", "e"), ("ſ", "f"), ("nn", "m"), ("j", "i"), ("y", "v"), ("m", "in"), ("h", "li"), ("ll", "tt"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("m", "ni"), ("m", "nn"), ("ti", "n"), ("lc", "k"), ("fi", "h"),
]
_FOLD_TWO = {"ﬁ": "fi", "ﬂ": "fl", "tt": "ll", "cl": "d", "rn": "m", "ri": "n", "ni": "m", "in": "m", "vv": "w", "li": "h", "ii": "u", "nn": "m", "tl": "d"}
_FOLD_ONE = str.maketrans({"0": "o", "1": "l", "|": "l", "!": "l", "ı": "l", "i": "l", "j": "l", "5": "s", "$": "s", "@": "a", "(": "c", "¢": "c", "e": "c", "3": "c", "€": "c", "9": "g", "q": "g", "6": "b", "8": "b", "h": "b", "t": "f", "ſ": "f", "v": "u", "y": "u", "n": "u"})
HYPHENS = "\\-\u2010\u00ad\u00ac"
PAGE_NUMBER = r"(?:page|pg|p|seite|página|pagina)?\s*\.?\s*(?:\d{1,4}|[ivxlc]{1,7})(?:\s*(?:/|\||of|von|de|sur)\s*\d{1,4})?\.?"
_PAGE_ALONE = re.compile(rf"^\s*[-–—\[(|]*\s*{PAGE_NUMBER}\s*[-–—\])|]*\s*$", re.I)
_PAGE_END = re.compile(rf"(?:\s{{2,}}|\t|\s[-–—|]\s*)[-–—\[(|]*\s*{PAGE_NUMBER}\s*[-–—\])|]*\s*$", re.I)
_PAGE_FRONT = re.compile(rf"^\s*[-–—\[(|]*\s*{PAGE_NUMBER}\s*[-–—\])|]*(?:\s{{2,}}|\t)", re.I)


def _alone(line: str) -> re.Match | None:
    """A page number alone; no such line is long, so long runs of blanks are not tried."""
    return _PAGE_ALONE.match(line) if len(line) <= 120 else None


def _at_end(line: str) -> re.Match | None:
    return _PAGE_END.search(line[-120:])


def _in_front(line: str) -> re.Match | None:
    return _PAGE_FRONT.match(line[:120])


def has_layout(text: str) -> bool:
    """Whether lines are set to a width: at least four lines, none but a few longer than a page is wide."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 4:
        return False
    body = [len(x) for x in lines if not x.lstrip().startswith(("|", "-", "*", "•"))]
    return len(body) >= 4 and sum(25 < n < 110 for n in body) > 0.5 * len(body) and sum(n > 120 for n in body) <= 0.05 * len(body)


@dataclass
class Page:
    """A row's lines with the facts that judging them needs."""

    lines: list[str]
    width: int
    title: set[str]
    repeats: Counter
    habit: dict[str, float]

    @classmethod
    def of(cls, text: str, title: str | None, habit: dict[str, float] | None = None) -> Page:
        lines = text.split("\n")
        sizes = sorted(len(x) for x in lines if x.strip())
        width = sizes[int(0.9 * (len(sizes) - 1))] if sizes else 0
        return cls(lines, width, {w.lower() for w in LETTERS.findall(title or "") if len(w) > 2}, Counter(_fold_line(x) for x in lines if x.strip()), habit or {})

    def suspect(self, i: int) -> bool:
        """A line that may stand between two lines of running text."""
        x = self.lines[i].strip()
        if not x or _alone(x) or _at_end(x) or _in_front(x) or re.search(r"\S {3,}\S| — | / |^[^.,;]{8,60}\.\w{3,4}$", x):
            return "|" not in x or bool(_alone(x))
        return (len(x) < 0.8 * self.width and not _TERMINAL.search(x) and not x[:1].islower() and x[-1:] not in "-,;\u2010\u00ad\u00ac")

    def _habits(self, s: str) -> tuple[float, float]:
        """Mean habit of the line's words, and the share of them that have one."""
        found = [self.habit.get(w.lower(), 0.0) for w in LETTERS.findall(s)] if self.habit else []
        return (sum(found) / len(found), sum(h > 0 for h in found) / len(found)) if found else (0.0, 0.0)

    def around(self, i: int) -> tuple[str, str]:
        """Nearest lines before and after that are running text."""
        a, b = i - 1, i + 1
        while a >= 0 and self.suspect(a):
            a -= 1
        while b < len(self.lines) and self.suspect(b):
            b += 1
        return (self.lines[a] if a >= 0 else ""), (self.lines[b] if b < len(self.lines) else "")

    def features(self, i: int) -> list[float]:
        x = self.lines[i]
        s = x.strip()
        before, after = self.around(i)
        pb, nb = (self.lines[i - 1] if i else ""), (self.lines[i + 1] if i + 1 < len(self.lines) else "")
        toks = s.split()
        letters = sum(map(str.isalpha, s))
        named = {w.lower() for w in LETTERS.findall(s) if len(w) > 2}
        b_open = bool(before) and not _TERMINAL.search(before.strip())
        a_low = after.strip()[:1].islower()
        first = toks[0] if toks else ""
        return [
            len(s) / max(self.width, 1), float(len(toks)), float(b_open), float(a_low), float(b_open and a_low), float(before.rstrip().endswith(("-", "\u2010", "\u00ad", "\u00ac"))), float(bool(_TERMINAL.search(s))), float(s[:1].islower()),
            float(s[:1].isdigit()), sum(t[:1].isupper() for t in toks) / max(len(toks), 1), sum(t.isupper() and len(t) > 1 for t in toks) / max(len(toks), 1), sum(map(str.isdigit, s)) / max(len(s), 1), letters / max(len(s), 1),
            float(bool(_alone(s))), float(bool(_at_end(s))), float(bool(_in_front(s))), float(bool(re.search(r"\S {3,}\S", s))), float(bool(re.search(r"\.\w{2,4}(\s|$)", s))),
            float(" — " in s or " – " in s), float(" / " in s), float("|" in s), float(s[:2] in ("- ", "* ", "• ")), len(named & self.title) / max(len(named), 1), float(self.repeats[_fold_line(x)]),
            float(not pb.strip()), float(not nb.strip()), float(i == 0), float(i == len(self.lines) - 1), float(len(pb.rstrip()) + 1 + len(first) <= self.width), len(pb.rstrip()) / max(self.width, 1),
            float(s.endswith(",")), float(bool(re.match(r"[\w ]{3,20}:\s", s))), float(x[:1].isspace()), float(len(s)), float(nb.strip()[:1].islower()), float(bool(pb.strip()) and not _TERMINAL.search(pb.strip())),
            float(bool(_alone(pb)) and bool(pb.strip())), float(bool(_alone(nb)) and bool(nb.strip())), float(bool(re.fullmatch(r"(1[89]|20)\d\d[.,;]?", s))),
            *self._habits(s),
        ]


def furniture_habit(learnt: list[tuple[str, bool]], lexicon: dict[str, int]) -> dict[str, float]:
    """For each word of at least three repeated lines how much more often it stands in such lines than in all text, as a logarithm."""
    lines = Counter(w for line, _ in learnt for w in {x.lower() for x in LETTERS.findall(line)})
    total = sum(lexicon.values()) + 1
    return {w: float(np.log(n / len(learnt)) - np.log((lexicon.get(w, 0) + 1) / total)) for w, n in lines.items() if n >= 3}


def _fold_line(x: str) -> str:
    return re.sub(r"\d+|\b[ivxlc]+$", "9", x.strip())


def fold_lexicon(lexicon: dict[str, int]) -> dict[str, int]:
    """Counts of the lexicon by folded word, the largest where several words fold alike."""
    out: dict[str, int] = {}
    for w, n in lexicon.items():
        f = fold(w)
        if n > out.get(f, 0):
            out[f] = n
    return out


def _hyphen_features(first: str, second: str, plain: bool, lexicon: dict[str, int], folded: dict[str, int]) -> list[float]:
    """Whether the parts make a word together, misread or not, whether each is one by itself, and whether the sign is the plain hyphen."""
    a, b = first.lower(), second.lower()
    c = lambda w: float(np.log1p(lexicon.get(w, 0)))
    joined = lexicon.get(a + b) or folded.get(fold(a + b), 0)
    return [float(np.log1p(joined)), c(a), c(b), float(len(a)), float(len(b)), float(second[:1].islower()), float(first.isalpha()), float(joined > 0), float(a in lexicon and b in lexicon), float(plain)]


def _parts(line: str, after: str) -> tuple[str, str] | None:
    """The two parts of a word at a line end, if the line ends with a hyphen after a letter."""
    m = re.search(rf"(\S*\w)[{HYPHENS}]$", line.rstrip())
    n = re.match(r"\s*(\S+)", after)
    if not m or not n or not re.search(r"[^\W\d_]$", m[1]) or "/" in m[1]:
        return None
    first = m[1].lstrip("(\"'[")
    second = re.match(r"[\w@|!(1$]*", n[1])[0] or n[1]
    return (first.rsplit("-", 1)[-1], second) if second else None


_MARK = re.compile(r"([-*•·–]|\d+[.)]|\([a-z0-9]\))\s")


def _join_features(page: Page, i: int, j: int, gap: bool) -> list[float]:
    """How line ``j`` follows line ``i``, with all furniture between them taken out."""
    x, y = page.lines[i], page.lines[j]
    a, b = x.strip(), y.strip()
    width = max(page.width, 1)
    first = b.split(" ", 1)[0]
    return [
        float(gap), len(x.rstrip()) / width, len(y.rstrip()) / width, float(bool(_TERMINAL.search(a))), float(a[-1:] in ",;"), float(a[-1:] == ":"), float(a[-1:] in "-\u2010\u00ad\u00ac"), float(b[:1].islower()), float(b[:1].isupper()), float(b[:1].isdigit()),
        float(len(x.rstrip()) + 1 + len(first) <= page.width), (len(x.rstrip()) + 1 + len(first)) / width, float(bool(_MARK.match(b))), float(bool(_MARK.match(a))), float("|" in b), float("|" in a), float(y[:1].isspace()), float(x[:1].isspace()),
        float(a.isupper()), float(b.isupper()), float(bool(re.match(r"[^.!?]{2,30}:\s", b))), float(bool(re.match(r"[^.!?]{2,30}:\s", a))), float(len(a.split())), float(len(b.split())), float(a[:1].islower()),
    ]


@dataclass
class Layout:
    """The classifiers of lines and line pairs, with the lexicon that judges broken words."""

    furniture: Boosted
    number: Boosted
    text: Boosted
    join: Boosted
    hyphen: Boosted
    lexicon: dict[str, int]
    folded: dict[str, int]
    habit: dict[str, float]


def lay_out(pages: list[Page], m: Layout) -> list[tuple[str, set[str]]]:
    """Paragraphs of each page without furniture and broken words, and the kinds of damage met."""
    rows = [(k, i) for k, page in enumerate(pages) for i, x in enumerate(page.lines) if x.strip()]
    x = np.array([pages[k].features(i) for k, i in rows]).reshape(len(rows), -1)
    drop = m.furniture.probability(x) > 0.5 if len(rows) else np.zeros(0, bool)
    kinds: list[set[str]] = [set() for _ in pages]
    gone = [r for r, d in zip(rows, drop) if d]
    if gone:
        number, text = m.number.probability(x[drop]) > 0.5, m.text.probability(x[drop]) > 0.5
        for (k, _), n, t in zip(gone, number, text):
            kinds[k] |= {"pageno"} if n and not t else {"header", "pageno"} if n else {"header"}
    dropped = set(gone)
    pairs: list[tuple[int, int, int, bool]] = []
    for k, page in enumerate(pages):
        last, gap = -1, False
        for i, line in enumerate(page.lines):
            if not line.strip():
                gap = True
            elif (k, i) not in dropped:
                if last >= 0:
                    pairs.append((k, last, i, gap))
                last, gap = i, False
    follows = m.join.probability(np.array([_join_features(pages[k], i, j, g) for k, i, j, g in pairs])) > 0.5 if pairs else np.zeros(0, bool)
    ends = {n: two for n, (k, i, j, _) in enumerate(pairs) if follows[n] and (two := _parts(pages[k].lines[i], pages[k].lines[j]))}
    facts = [_hyphen_features(*two, pages[pairs[n][0]].lines[pairs[n][1]].rstrip()[-1] == "-", m.lexicon, m.folded) for n, two in ends.items()]
    broken = dict(zip(ends, m.hyphen.probability(np.array(facts)) > 0.5)) if ends else {}
    out: list[list[str]] = [[] for _ in pages]
    for k, i in rows:
        if (k, i) not in dropped and not out[k]:
            out[k].append(pages[k].lines[i].strip())
    for n, (k, _, j, gap) in enumerate(pairs):
        s = pages[k].lines[j].strip()
        if not follows[n]:
            out[k] += ["\n\n" if gap else "\n", s]
        elif broken.get(n, False):
            kinds[k].add("hyphen")
            out[k][-1] = out[k][-1][:-1] + s
        else:
            out[k][-1] += s if n in ends else " " + s
    return [("".join(o), ks) for o, ks in zip(out, kinds)]


# ---- synthetic pages for training -------------------------------------------------------------------------


def _number_line(rng: np.random.Generator, n: int) -> str:
    roman = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]
    forms = [f"{n}", f"{n}.", f"p. {n}", f"Page {n}", f"Page {n} of {n + 20}", f"- {n} -", f"[{n}]", f"— {n} —", f"PAGE   {n}", f"{n} | {n + 30}", f"Pg {n}/{n + 12}", roman[n % 12]]
    return forms[int(rng.integers(len(forms)))]


def _header_line(rng: np.random.Generator, title: str, names: list[str]) -> str:
    pick = lambda: names[int(rng.integers(len(names)))]
    month = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"][int(rng.integers(12))]
    forms = [
        title, f"{pick()} {pick()} — {month} {int(rng.integers(1990, 2030))}".upper(), f"{title.rsplit('.', 1)[0]}{' ' * int(rng.integers(4, 16))}{pick()}",
        f"{pick()} {pick()}, {month} {int(rng.integers(1990, 2030))}", f"{pick()} — Draft {int(rng.integers(1, 9))}", f"{pick()} {pick()} Confidential".upper(), f"{pick()} {pick().lower()} {pick().lower()}",
    ]
    return forms[int(rng.integers(len(forms)))]


@dataclass
class Set:
    """A synthetic page: its lines, what is furniture, with page number, with other text, where paragraphs begin, and the words at line ends."""

    lines: list[str]
    furniture: list[int]
    number: list[int]
    text: list[int]
    begins: list[int]
    ends: list[tuple[str, str, bool, int]]


def synthetic_page(text: str, title: str, names: list[str], rng: np.random.Generator, learnt: list[tuple[str, bool]]) -> Set:
    """A page set from clean text; ``learnt`` holds furniture lines and whether their number changes from page to page."""
    width = int(rng.integers(36, 88))
    lines: list[str] = []
    begins: list[int] = []
    ends: list[tuple[str, str, bool, int]] = []
    sign = "-" if rng.random() < 0.8 else "\u2010\u00ad\u00ac"[int(rng.integers(3))]

    def put(line: str, begin: int) -> None:
        lines.append(line)
        begins.append(begin)

    for para in re.split(r"\n\s*\n", text):
        if rng.random() < 0.12:
            put((title.rsplit(".", 1)[0] if rng.random() < 0.5 else " ".join(names[int(rng.integers(len(names)))] for _ in range(2))).upper(), 1)
        kept = para.split("\n") if re.search(r"^[-*|]|:\s", para, re.M) else [" ".join(para.split())]
        for piece in kept:
            if len(piece) <= width:
                put(piece, 1)
                continue
            todo, cur, begin = piece.split(), "", 1
            while todo:
                w = todo.pop(0)
                if len(cur) + len(w) + bool(cur) <= width:
                    cur = f"{cur} {w}" if cur else w
                    continue
                room = width - len(cur) - 2
                if room >= 3 and len(w) - room >= 2 and w.isalpha() and rng.random() < 0.3:
                    at = int(rng.integers(3, room + 1))
                    ends.append((w[:at], w[at:], sign == "-", 1))
                    put(f"{cur} {w[:at]}{sign}", begin)
                    cur = w[at:]
                elif "-" in w[1:-1] and re.fullmatch(r"[^\W\d_]+-[^\W\d_]+\W*", w) and len(w.split("-")[0]) <= room + 1:
                    a, b = w.split("-", 1)
                    ends.append((a, re.match(r"\w*", b)[0], True, 0))
                    put(f"{cur} {a}-", begin)
                    cur = b
                else:
                    put(cur, begin)
                    cur = w
                begin = 0
            put(cur, begin)
        put("", 0)
    if rng.random() < 0.15:
        for line in ("Yours faithfully,", " ".join(names[int(rng.integers(len(names)))] for _ in range(2)), " ".join(names[int(rng.integers(len(names)))] for _ in range(2))):
            put(line, 1)
    while lines and not lines[-1]:
        lines.pop()
        begins.pop()
    way = rng.random()
    if way < 0.2:  # paragraphs that begin with an indent
        lines = [("    " + x if x and (not i or not lines[i - 1]) else x) for i, x in enumerate(lines)]
    if 0.1 < way < 0.25:  # and paragraphs without a blank line between them
        keep = [i for i, x in enumerate(lines) if x or rng.random() < 0.2]
        lines, begins = [lines[i] for i in keep], [begins[i] for i in keep]
    n = len(lines)
    if rng.random() >= 0.75:
        return Set(lines, [0] * n, [0] * n, [0] * n, begins, ends)
    header, own = _header_line(rng, title, names), False
    if learnt and rng.random() < 0.6:
        header, own = learnt[int(rng.integers(len(learnt)))]
    count, way, style, at = int(rng.integers(1, 60)), int(rng.integers(5)), int(rng.integers(1 << 30)), int(rng.integers(0, 12))
    alone = bool(_alone(header))
    rows: list[tuple[str, int, int, int, int]] = []
    for i, x in enumerate(lines):
        if i == at:
            number = _number_line(np.random.default_rng(style), count)
            if own or alone:
                blocks = [(re.sub(r"\d+", str(count), header, count=1) if alone else header, 1, int(not alone))]
            else:
                blocks = [[(number, 1, 0)], [(header, 0, 1)], [(f"{header}   {number}", 1, 1)], [(number, 1, 0), (header, 0, 1)], [(f"{number}   {header}", 1, 1)]][way]
            block = [(line, 1, a, b, 0) for line, a, b in blocks]
            if rng.random() < 0.25:
                block = [("", 0, 0, 0, 0), *block, ("", 0, 0, 0, 0)]
            rows += block
            at, count = i + int(rng.integers(5, 25)), count + 1
        rows.append((x, 0, 0, 0, begins[i]))
    return Set(*[list(c) for c in zip(*rows)], ends)  # type: ignore[arg-type]


def train_layout(rows: list[tuple[str, str]], plain: list[tuple[str, str]], lexicon: dict[str, int], learnt: list[tuple[str, bool]] | None = None, seed: int = 3) -> Layout:
    """Classifiers from pages set from clean rows, and from rows with layout but no pages, whose lines are no furniture."""
    rng = np.random.default_rng(seed)
    names = [w.capitalize() for w in lexicon if len(w) > 4][:: max(1, len(lexicon) // 400)] or ["Name"]
    x, y, number, has_text, jx, jy, hx, hy = [], [], [], [], [], [], [], []
    folded, habit = fold_lexicon(lexicon), furniture_habit(learnt or [], lexicon)
    for text, title in rows:
        made = synthetic_page(text, title or "Untitled", names, rng, learnt or [])
        page = Page.of("\n".join(made.lines), title, habit)
        last, gap = -1, False
        for i, line in enumerate(page.lines):
            if not line.strip():
                gap = True
                continue
            x.append(page.features(i)), y.append(made.furniture[i])
            number.append(made.number[i]), has_text.append(made.text[i])
            if made.furniture[i]:
                continue
            if last >= 0:
                jx.append(_join_features(page, last, i, gap)), jy.append(1 - made.begins[i])
            last, gap = i, False
        for a, b, sign, z in made.ends:
            hx.append(_hyphen_features(a, b, sign, lexicon, folded)), hy.append(z)
    for text, title in plain:
        page = Page.of(text, title, habit)
        for i, line in enumerate(page.lines):
            if line.strip():
                x.append(page.features(i)), y.append(0), number.append(0), has_text.append(0)
    compounds = [("follow", "up"), ("well", "kept"), ("long", "term"), ("co", "operate"), ("self", "made")]
    frequent = [w for w in lexicon if len(w) > 2]
    for _ in range(max(200, len(hy) // 3)):  # two whole words joined by a hyphen of their own
        a, b = (frequent[int(rng.integers(len(frequent)))] for _ in range(2)) if frequent and rng.random() < 0.9 else compounds[int(rng.integers(len(compounds)))]
        if a + b not in lexicon:
            hx.append(_hyphen_features(a, b, True, lexicon, folded)), hy.append(0)
    fx, fy = np.array(x), np.array(y)
    on = fy == 1 if len(fy) else np.zeros(0, bool)
    of = fx[on] if len(fy) else np.zeros((0, 1))
    return Layout(
        fit_boosted(fx, fy, trees=80, depth=5), fit_boosted(of, np.array(number)[on], trees=20, depth=3), fit_boosted(of, np.array(has_text)[on], trees=20, depth=3),
        fit_boosted(np.array(jx), np.array(jy), trees=50, depth=4), fit_boosted(np.array(hx), np.array(hy), trees=30, depth=3), lexicon, folded, habit,
    )


# ---- words ------------------------------------------------------------------------------------------------


def fold(word: str) -> str:
    """A word with the signs that recognition confuses put together."""
    w = word.lower()
    for two, one in _FOLD_TWO.items():
        w = w.replace(two, one)
    return w.translate(_FOLD_ONE)


def grams(word: str) -> list[str]:
    """Distinct q-grams of the folded word, with its borders."""
    w = "^" + fold(word) + "$"
    return sorted({w[i : i + GRAM] for i in range(len(w) - GRAM + 1)})


_BY_READ: dict[str, list[str]] = {}
for _r, _p in CONFUSIONS:
    _BY_READ.setdefault(_r, []).append(_p)


def misread_cost(read: str, printed: str) -> tuple[float, int, int]:
    """Cheapest way from ``printed`` to ``read``: cost, confusions used, plain edits used."""
    a, b = read.lower(), printed.lower()
    best: dict[tuple[int, int], tuple[float, int, int]] = {(0, 0): (0.0, 0, 0)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            here = best.get((i, j))
            if here is None or here[2] > 2 or here[1] > 4:
                continue
            steps = []
            if i < len(a) and j < len(b) and a[i] == b[j]:
                steps.append((i + 1, j + 1, 0.0, 0, 0))
            for n in (1, 2):
                for p in _BY_READ.get(a[i : i + n], ()) if i + n <= len(a) else ():
                    if b.startswith(p, j):
                        steps.append((i + n, j + len(p), 0.3, 1, 0))
            if i < len(a):
                steps.append((i + 1, j, 1.0, 0, 1))
            if j < len(b):
                steps.append((i, j + 1, 1.0, 0, 1))
            if i < len(a) and j < len(b):
                steps.append((i + 1, j + 1, 1.0, 0, 1))
            for ni, nj, c, k, e in steps:
                new = (here[0] + c, here[1] + k, here[2] + e)
                if (ni, nj) not in best or new[0] < best[ni, nj][0]:
                    best[ni, nj] = new
    return best.get((len(a), len(b)), (9.0, 0, 9))


def _pair_features(read: str, printed: str, n_read: float, n_printed: float, shared: int) -> list[float]:
    cost, confusions, edits = misread_cost(read, printed)
    odd = sum(not c.isalpha() or c == "ı" for c in read)
    return [cost, float(confusions), float(edits), float(np.log1p(n_printed) - np.log1p(n_read)), float(np.log1p(n_read)), float(odd), float(len(printed)), float(len(read) - len(printed)), float(read[:1].lower() == printed[:1]), shared / max(len(grams(read)), 1), float(fold(read) == fold(printed))]


def train_ranking(lexicon: dict[str, int], total: int, seed: int = 4) -> Boosted:
    """Ranking of (word as read, word as printed) from artificial misreadings, ordinary slips and look-alikes."""
    rng = np.random.default_rng(seed)
    strong = sorted((w for w, c in lexicon.items() if c >= RARE_SHARE * total and len(w) >= 3), key=lambda w: (-lexicon[w], w))
    picked = [strong[i] for i in sorted(rng.choice(len(strong), min(len(strong), TRAIN_WORDS), replace=False))] if strong else []
    index: dict[str, list[str]] = {}
    for w in strong:
        for g in grams(w):
            index.setdefault(g, []).append(w)
    x, y = [], []
    for w in picked:
        for kind in range(3):
            if kind < 2:
                ways = [(m.start(), r, p) for r, p in CONFUSIONS for m in re.finditer(re.escape(p), w)]
                if not ways:
                    continue
                at, r, p = ways[int(rng.integers(len(ways)))]
                read = w[:at] + r + w[at + len(p) :]
            else:
                at = int(rng.integers(0, len(w) - 1))
                slip = int(rng.integers(4))
                other = "abdefghklmnoprstuw"[int(rng.integers(18))]
                read = [w[:at] + w[at + 1] + w[at] + w[at + 2 :], w[:at] + w[at + 1 :], w[:at] + other + w[at:], w[:at] + other + w[at + 1 :]][slip]
            if read in lexicon and lexicon[read] > 0.02 * lexicon[w] or read == w:
                continue
            n_read = float(rng.integers(1, 4)) if rng.random() < 0.7 else max(1.0, lexicon[w] * float(rng.uniform(0.0002, 0.01)))
            shared = Counter(v for g in grams(read) for v in index.get(g, ()) if abs(len(v) - len(read)) <= 2)
            for v, s in shared.most_common(6):
                x.append(_pair_features(read, v, n_read, lexicon[v], s)), y.append(int(v == w and kind < 2))
            if w not in dict(shared.most_common(6)):
                x.append(_pair_features(read, w, n_read, lexicon[w], shared.get(w, 0))), y.append(int(kind < 2))
        # real words that look alike stay as they are
        shared = Counter(v for g in grams(w) for v in index.get(g, ()) if v != w and abs(len(v) - len(w)) <= 1)
        for v, s in shared.most_common(2):
            x.append(_pair_features(w, v, lexicon[w], lexicon[v], s)), y.append(0)
    if not x:
        return fit_boosted(np.zeros((2, 11)), np.array([0, 1]), trees=1)
    return fit_boosted(np.array(x), np.array(y), trees=80, depth=4)


def core_word(token: str) -> str:
    """A token without the punctuation around it; a bracket in front stays when the word is not closed by one."""
    t = token.lstrip(_FRONT)
    body = t.rstrip(_EDGE)
    if body[:1] == "(":
        t2 = body[1:]
        return body if t2 and t2.isalpha() and ")" not in token else t2.rstrip(_EDGE)
    return body


def is_word(core: str) -> bool:
    """Words and misread words, but no codes, numbers, addresses or file names."""
    if not 2 <= len(core) <= 40 or any(c in core for c in "/\\-.,:#&+=<>_*'’"):
        return False
    letters, digits = sum(c.isalpha() for c in core), sum(c.isdigit() for c in core)
    return letters >= 2 and letters > 2 * digits and not (digits and core.isupper())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            c.update(LETTERS.findall(text))
        if len(c) > 500_000:
            yield pa.RecordBatch.from_arrays([pa.array([w.lower() for w in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
            c.clear()
    yield pa.RecordBatch.from_arrays([pa.array([w.lower() for w in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])


def _lay_out(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    m: Layout
    m, rare = shared.value
    get = m.lexicon.get
    for batch in batches:
        row, texts, title, page = (c.to_pylist() for c in batch.columns)
        set_ = [k for k, t in enumerate(texts) if has_layout(t)]
        cut = [texts[k].rpartition("--- Document Content ---\n") for k in set_]
        fixed, kinds = list(texts), [[] for _ in texts]
        for k, (head, mark, _), (text, found) in zip(set_, cut, lay_out([Page.of(c[2], title[k], m.habit) for k, c in zip(set_, cut)], m)):
            fixed[k], kinds[k] = head + mark + text, sorted(found)
        odd = []
        for t in fixed:
            body = t.rpartition("--- Document Content ---\n")[2]
            odd.append(sorted({c for t in body.split() if get(t.lower(), 0) < rare and (c := core_word(t)) and is_word(c) and get(c.lower(), 0) < rare}))
        cols = (row, fixed, kinds, odd, page)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()))], names=["id", "text", "kinds", "odd", "page"])


def least_shared(read: int, printed: int) -> int:
    """Grams that words of these lengths must have in common: a confusion may spoil GRAM + 1 beyond what folding mends; half of those of short words."""
    return max(2, max(read, printed) - 3 - (read >= 6))


def _rare_grams(word: str, least: int, common: dict[str, int]) -> list[str]:
    """The rarest grams of a word, as many as one must be among for any partner that shares ``least``."""
    g = sorted(grams(word), key=lambda x: (common.get(x, 0), x))
    return g[: max(0, len(g) - least + 1)]


def _explode_grams(batches: Iterator[pa.RecordBatch], shared, read: bool) -> Iterator[pa.RecordBatch]:
    common = shared.value
    for batch in batches:
        ws, gs = [], []
        for w in batch.column(0).to_pylist():
            # the lowest bound over all lengths of a partner
            g = _rare_grams(w, least_shared(len(w), 0) if read else min(least_shared(n, len(w)) for n in range(len(w) - 2, len(w) + 3)), common)
            ws += [w] * len(g)
            gs += g
        yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array(gs, pa.string())], names=["w", "gram"])


def _rank(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, x = [], []
        of = lru_cache(maxsize=20_000)(lambda w: frozenset(grams(w)))
        for i, (a, b, n, m) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
            common = len(of(a) & of(b))
            if common >= least_shared(len(a), len(b)):
                kept.append(i), x.append(_pair_features(a, b, n, m, common))
        take = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(shared.value.probability(np.array(x)) if x else np.zeros(0))], names=["read", "printed", "p"])


def _corrections(odd: DataFrame, lexicon: DataFrame, words: dict[str, int], ranking, total: int) -> DataFrame:
    """``(read, printed)``: the replacement chosen for each rare word that has one. ``odd`` is ``(read, n)``, ``words`` the lexicon."""
    least = max(5.0, RARE_SHARE * total / 4)
    strong = lexicon.where(F.col("n") >= least).select("word", "n")
    # how common grams are among the words that may be printed; pairs of signs, so few
    common = odd.sparkSession.sparkContext.broadcast(dict(Counter(g for w, n in words.items() if n >= least for g in grams(w))))
    left = odd.select("read").mapInArrow(lambda it: _explode_grams(it, common, True), "w string, gram string").withColumn("lw", F.length("w"))
    right = strong.select("word").mapInArrow(lambda it: _explode_grams(it, common, False), "w string, gram string").withColumn("l", F.length("w"))
    right = right.select(F.col("w").alias("v"), "gram", F.explode(F.sequence(F.col("l") - 2, F.col("l") + 2)).alias("lw"))
    pairs = left.join(right, ["gram", "lw"]).where(F.lower("w") != F.col("v")).select("w", "v").distinct()
    named = pairs.join(odd.select(F.col("read").alias("w"), F.col("n").cast("double").alias("nr")), "w").join(strong.select(F.col("word").alias("v"), F.col("n").cast("double").alias("nv")), "v")
    ranked = named.select("w", "v", "nr", "nv").mapInArrow(lambda it: _rank(it, ranking), "read string, printed string, p double")
    best = Window.partitionBy("read").orderBy(F.desc("p"), "printed")
    return ranked.where("p > 0.5").withColumn("k", F.row_number().over(best)).where("k = 1").select("read", "printed")


def _page_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(u, h, f, x.strip()) for u, h, t in zip(*(c.to_pylist() for c in batch.columns)) if has_layout(t) for x in t.split("\n") if 1 <= len(x.strip()) <= 100 and (f := _fold_line(x))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["record", "page", "form", "line"])


def _repeated_lines(pages: DataFrame, rows: int) -> list[tuple[str, bool]]:
    """At most ``TRAIN_LINES`` lines that stand on several pages of a record, and whether their numbers change; records are chosen by hash.

    ``pages`` is ``(record, page, body)`` of scanned rows.
    """
    share = max(1, rows // LINE_ROWS)
    some = pages.where("record is not null").where(F.pmod(F.xxhash64("record"), F.lit(share)) == 0)
    lines = some.mapInArrow(_page_lines, "record long, page long, form string, line string")
    many = lines.groupBy("record", "form").agg(F.count_distinct("page").alias("pages"), F.count_distinct("line").alias("lines"), F.min("line").alias("line")).where("pages > 1")
    got = [(r["line"], r["lines"] > 1) for r in many.orderBy(F.xxhash64("record", "form"), "form").limit(TRAIN_LINES).collect()]

    def stands_alone(line: str, changes: bool) -> bool:
        """Not the short last line of a sentence, nor a line of text in which only an amount changes."""
        numbered = bool(_alone(line) or _at_end(line) or _in_front(line))
        return numbered or not (changes or line[:1].islower() or _TERMINAL.search(line))

    return [x for x in got if stands_alone(*x)]


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, reads, printed in zip(*(c.to_pylist() for c in batch.columns[1:4])):
            if reads:
                fix = dict(zip(reads, printed))

                def one(m: re.Match, fix=fix, text=text) -> str:
                    t = m[0]
                    c = core_word(t)
                    if c not in fix:
                        return t
                    v = fix[c]
                    starts = not c[:1].isalpha() and bool(re.search(r"(^|[.!?]\s+)$", text[max(0, m.start() - 4) : m.start()]))
                    v = v.upper() if c.isupper() and len(c) > 1 else v[:1].upper() + v[1:] if c[:1].isupper() or starts else v
                    return t.replace(c, v, 1)

                text = re.sub(r"\S+", one, text)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(4)], names=["id", "text", "kinds"])


def repair_scans(chunks: DataFrame, scanned: Column | None = None) -> DataFrame:
    """``(id, text, kinds)`` of every scanned row: repaired text and the kinds of damage found.

    ``scanned`` tells which rows come from scanned files; by default those with a page number. Kinds are hyphen,
    header, pageno and misread.
    """
    spark = chunks.sparkSession
    kept = ["id", "record_title", "chunk_content", "page_number", *(["record_uri"] if "record_uri" in chunks.columns else [])]
    rows = chunks.select(kept).where("chunk_content is not null")
    scan = rows.where(F.col("page_number") > 0 if scanned is None else scanned)
    body = F.substring_index("chunk_content", "--- Document Content ---\n", -1)
    keyed = rows.select("id", F.xxhash64(body).alias("th"), F.length(body).alias("tl"))
    firsts = keyed.groupBy("th", "tl").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1")
    repeats = stage(keyed.join(firsts, ["th", "tl"]).where("id <> first").select("id"), "repeats")
    counts = stage(rows.join(repeats, "id", "left_anti").select("chunk_content").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = stage(counts.where(F.col("n") >= max(3.0, LEXICON_SHARE * total)), "lexicon")
    table = kept.toArrow()  # at most 1 / LEXICON_SHARE words
    lexicon = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))
    # samples by the hash of the id, so that no task sends more than its share and the order of tasks does not matter
    size = rows.count()
    other = rows.where("coalesce(page_number, 0) = 0").where(F.pmod(F.xxhash64("id"), F.lit(max(1, size // (4 * TRAIN_ROWS)))) == 0)
    picked = other.orderBy(F.xxhash64("id"), "id").limit(4 * TRAIN_ROWS).select("chunk_content", "record_title").collect()
    laid = [(r[0], r[1]) for r in picked if has_layout(r[0])][:TRAIN_ROWS]
    clean = [(r[0].rpartition("--- Document Content ---\n")[2], r[1]) for r in picked if not has_layout(r[0])][:TRAIN_ROWS]
    learnt = _repeated_lines(scan.select(F.col("record_uri").cast("long").alias("record"), F.xxhash64(body).alias("page"), body.alias("body")), size) if "record_uri" in chunks.columns else []
    shared = spark.sparkContext.broadcast((train_layout(clean, laid, lexicon, learnt), RARE_SHARE * total))
    ranking = spark.sparkContext.broadcast(train_ranking(lexicon, total))
    laid_out = scan.select("id", "chunk_content", "record_title", F.xxhash64(body).alias("page")).mapInArrow(lambda it: _lay_out(it, shared), "id long, text string, kinds array<string>, odd array<string>, page long")
    laid_out = stage(laid_out, "laid-out")
    words = laid_out.select("id", F.explode("odd").alias("read"))
    odd = laid_out.select("page", F.explode("odd").alias("read")).distinct().groupBy("read").agg(F.count("*").alias("m")).join(counts.withColumnRenamed("word", "low"), F.lower("read") == F.col("low"), "left")
    odd = stage(odd.select("read", F.greatest("m", F.coalesce("n", F.lit(0))).alias("n")), "odd-words")
    fixes = stage(_corrections(odd, kept, lexicon, ranking, total), "corrections")
    by_row = words.join(fixes, "read").groupBy("id").agg(F.collect_list("read").alias("reads"), F.collect_list("printed").alias("printed"))
    joined = laid_out.join(by_row, "id", "left")
    kinds = F.when(F.col("reads").isNotNull(), F.concat("kinds", F.array(F.lit("misread")))).otherwise(F.col("kinds"))
    return joined.select("id", "text", "reads", "printed", kinds.alias("kinds")).mapInArrow(_replace, "id long, text string, kinds array<string>")


def scan_damage(chunks: DataFrame) -> DataFrame:
    """``(id, kind)``: each kind of damage of each row once."""
    return repair_scans(chunks).select("id", F.explode(F.array_distinct("kinds")).alias("kind"))
