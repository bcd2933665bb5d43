"""Reading typed venue and organisation names, and aligning their tokens.

A name is folded (entities, markup, LaTeX, mojibake, marks, case), freed of
what does not name the venue (volume and issue, ISSN, years and ordinals,
`Proceedings of`, its own acronym), and cut into tokens. Two names denote the
same thing if an optimal assignment pairs all tokens that count; a token pairs
with its equal, an abbreviation or initial, or a spelling one edit away.
A word left over on either side (Supplement, Part B, a second place) makes
another venue.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np

# fixed values: words that join names
STOP = frozenset("the of and for on in to at a an de la le les l d du des del der die das den dem und et y e fur fuer para pour von zu zur zum sur el los las with".split())
# fixed values: kinds of body that may also close a name and still be left out
_TAIL = frozenset("journal series society academy institute conference symposium congress meeting association".split())
_OCR = re.compile(r"(?<=[^\W\d_])[0135](?=[^\W\d_])|(?<![\w])[0135](?=[^\W\d_]{3})")
_OCR_LETTER = {"0": "o", "1": "l", "3": "e", "5": "s"}
# fixed values: kinds of venue, which a short form of the name may leave out in front
GENERIC = frozenset(
    "journal international annals archives acta bulletin revista revue review transactions memoirs quarterly communications zeitschrift letters "
    "advances proceedings conference congress symposium workshop meeting annual society institute academy association series national european american "
    "magazine gazette papers studies reports notes cahiers anales archiv archivos rivista giornale jahrbuch".split()
)
_LEAD = re.compile(r"^(?:in|published in|appeared in|appears in|to appear in|presented at|see)\b[:\s]+", re.I)
_PROC = re.compile(r"^(?:the\s+)?(?:proceedings|procs?\b\.?)\s*(?:of\s+)?(?:the\s+)?", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,40}>")
_TEX_ACCENT = re.compile(r"\\[`'^\"~=.uvHcdbrk]\s*\{?\\?([A-Za-z])\}?")
_TEX_WORD = re.compile(r"\\(o|O|l|L|aa|AA|ae|AE|oe|OE|ss|i|j)(?![A-Za-z])\s*")
_MOJIBAKE = re.compile(r"[ÃÂÅÄãâåä][\u0080-\u00bf\u0152-\u0192\u02c6\u02dc\u2010-\u203a\u20ac\u2122]")
_ISSN = re.compile(r"[\(\[,;]?\s*\b[ep]?-?issn(?:-l)?\b[:\s]*\d{4}-?\d{3}[\dx]\)?\s*(?:[\(\[](?:print|online|electronic)[\)\]])?[\)\]]?|\b\d{4}-\d{3}[\dx]\b", re.I)
_VOLUME = re.compile(r"[,(]?\s*\b(?:vols?|volume|bd|band|tome|no|nr|num|number|issue|iss|pp|pages?|heft|jg)\b\.?\s*\d+(?:\s*[-–]\s*\d+)?\)?|\b\d+\s*\(\s*\d+(?:[-–/]\d+)?\s*\)", re.I)
_YEARED = re.compile(r"\b([A-Za-z]{2,10})\s*[-'’]\s*(?:(?:19|20)\d\d|\d\d)\b")
_ORDINAL = re.compile(r"\b\d+\s*(?:st|nd|rd|th|e|eme|er|a|o)\b|\b(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth)\s+(?=annual|international|ieee|acm|\w+\s+(?:conference|symposium|workshop|congress|meeting))", re.I)
_BRACKETED = re.compile(r"[\(\[]\s*([A-Za-z][A-Za-z0-9&.]{1,9})\s*[\)\]]")
_WORD = re.compile(r"[^\W\d_]+\.?")
_SPECIAL = str.maketrans({"ø": "o", "Ø": "O", "đ": "d", "ł": "l", "Ł": "L", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "ð": "d", "þ": "th", "’": "'", "‐": "-", "‑": "-", "–": "-", "—": "-"})


class Name(NamedTuple):
    tokens: tuple[str, ...]  # folded content words in order; a trailing dot marks an abbreviation
    acronym: str  # acronym given beside the name, or the name itself if it is nothing else
    cut: bool  # ends in an ellipsis
    bare: bool  # nothing but an acronym
    joined: tuple[bool, ...] = ()  # whether a small word stands before the token
    open_end: bool = False  # ends in a small word: the rest is missing


def _repair(s: str) -> str:
    """UTF-8 once read as cp1252, also after lower()."""
    if not _MOJIBAKE.search(s):
        return s

    def fix(m: re.Match[str]) -> str:
        first = m.group()[0].upper()
        for code in ("cp1252", "latin-1"):
            try:
                return (first.encode(code) + m.group()[1:].encode(code)).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return m.group()

    return _MOJIBAKE.sub(fix, s)


def fold(s: str) -> str:
    """Entities, markup, LaTeX, mojibake and marks resolved; case kept."""
    if "&" in s:
        s = html.unescape(html.unescape(s))
    if "<" in s:
        s = _TAG.sub(" ", s)
    if not s.isascii():
        s = _repair(s)
    if "\\" in s:
        s = _TEX_WORD.sub(lambda m: {"aa": "a", "AA": "A"}.get(m.group(1), m.group(1)), _TEX_ACCENT.sub(r"\1", s.replace("\\&", "&")))
        s = s.replace("\\", "")
    if "{" in s or "}" in s:
        s = s.replace("{", "").replace("}", "")
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s.translate(_SPECIAL))
        s = "".join(c for c in s if not unicodedata.combining(c))
    return " ".join(s.split())


def initials_fit(acronym: str, words: tuple[str, ...] | list[str]) -> bool:
    """Whether the letters are initials of the words in order, none but small words skipped too freely."""
    a, i, skipped = acronym.lower(), 0, 0
    for w in words:
        if i < len(a) and w[0] == a[i]:
            i += 1
        else:
            skipped += 1
    # one letter more may tell acronyms of the same initials apart
    return i >= 2 and i >= len(a) - 1 and skipped <= 1


def read_name(raw: str) -> Name:
    """The parts of a typed name; a text without letters has no tokens."""
    s = fold(raw).strip(" \t\"'`.,;:")
    cut = s.endswith("…") or raw.rstrip().endswith(("...", "…"))
    s = s.rstrip("….")
    s = _LEAD.sub("", s)
    s = _ISSN.sub(" ", s)
    s = _VOLUME.sub(" ", s)
    acronym = ""
    m = _YEARED.search(s)
    if m and (m.group(1).isupper() or m.group(1).islower()) and len(m.group(1)) <= 10:
        rest = (s[: m.start()] + " " + s[m.end() :]).strip(" ,;:-")
        acronym, s = m.group(1).upper(), rest or m.group(1)
    s = _PROC.sub("", s)
    s = _ORDINAL.sub(" ", s)
    for m in _BRACKETED.finditer(s):
        if m.group(1).isupper() and m.group(1).lower() not in GENERIC:
            acronym = m.group(1)
            s = s[: m.start()] + " " + s[m.end() :]
            break
    s = _OCR.sub(lambda m: _OCR_LETTER[m.group()], s)
    shown = _WORD.findall(s)
    words = [w.lower() for w in shown]
    small = [w.rstrip(".") in STOP for w in words]
    if cut and len(words) > 1 and small[-1] and shown[-1][0].isupper() and not shown[0].islower():
        small[-1] = False  # the beginning of a name, not a small word
    tokens = [w for w, x in zip(words, small, strict=True) if not x]
    joined = [i > 0 and small[i - 1] for i, x in enumerate(small) if not x]
    open_end = bool(small) and small[-1]
    plain = [w.rstrip(".") for w in tokens]
    if len(tokens) > 2:
        # an acronym of the rest, behind or before it
        if 2 <= len(plain[-1]) <= 10 and initials_fit(plain[-1], plain[:-1]) and len(plain[-1]) >= len(plain) - 2:
            acronym = plain.pop().upper()
            tokens.pop()
            joined.pop()
        elif 2 <= len(plain[0]) <= 10 and initials_fit(plain[0], plain[1:]) and len(plain[0]) >= len(plain) - 2:
            acronym = plain.pop(0).upper()
            tokens.pop(0)
            joined.pop(0)
    bare = False
    rest = [p for p in plain if p not in ("j", "journal", "conf", "proc")]
    if not rest and acronym:
        bare, tokens = True, []
    elif len(rest) == 1 and len(plain) <= 2 and 2 <= len(rest[0]) <= 8:
        bare, acronym = True, rest[0].upper()
    return Name(tuple(tokens), acronym, cut, bare, tuple(joined), open_end)


@lru_cache(maxsize=1 << 16)
def near(a: str, b: str) -> bool:
    """Edit distance of at most one, an adjacent swap counting as one edit."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    if la > lb:
        a, b, la, lb = b, a, lb, la
    i = 0
    while i < la and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (a[i + 1 : i + 2] == b[i : i + 1] and a[i : i + 1] == b[i + 1 : i + 2] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


@lru_cache(maxsize=1 << 16)
def near_twice(a: str, b: str) -> bool:
    """Two edits apart in long words that begin and end alike."""
    if min(len(a), len(b)) < 7 or abs(len(a) - len(b)) > 2 or a[0] != b[0] or a[-1] != b[-1]:
        return False
    # what both begin and end with takes no edit
    i = 1
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 1
    while j < min(len(a), len(b)) - i and a[-j - 1] == b[-j - 1]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1] <= 2


def _inside(a: str, b: str) -> bool:
    """Whether the letters of a stand in b in order."""
    it = iter(b)
    return all(c in it for c in a)


@lru_cache(maxsize=1 << 17)
def token_match(a: str, b: str) -> int:
    """3 equal, 2 one edit apart, 1 abbreviation or initial, 0 different words."""
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y:
        return 3
    if len(x) > len(y):
        x, y, a, b = y, x, b, a
    lx, ly = len(x), len(y)
    if (lx >= 5 or (lx == 4 and ly == 5)) and near(x, y):
        # plural forms name other venues; a dotted word may be cut there
        return 0 if y == x + "s" and not a.endswith(".") and ly < 12 and x + "s" in ("workshops", "letters", "reports", "posters") else 2
    if x[0] != y[0]:
        return 0
    if near_twice(x, y):
        return 2
    if lx == ly:
        return 0
    if y.startswith(x):
        return 1
    if lx >= 4 and ly > lx + 1 and (near(x, y[:lx]) or near(x, y[: lx + 1]) or near(x, y[: lx - 1])):
        return 1
    if 3 <= lx <= 6 and ly > lx + 1 and _inside(x, y):
        return 1
    return 0


@lru_cache(maxsize=1 << 16)
def _traits(word: str) -> tuple[int, int, int, int, int]:
    """Length of a word without its dot, its first and last letter, its letters and pairs of letters as bits."""
    codes = [ord(c) for c in word.rstrip(".")]
    letters = pairs = 0
    for c in codes:
        letters |= 1 << (c & 63)
    for c, d in zip(codes, codes[1:], strict=False):
        pairs |= 1 << ((c * 29 + d) & 63)
    return len(codes), codes[0], codes[-1], letters, pairs


def _partners(a: str, b: str) -> bool:
    x, y = a.rstrip("."), b.rstrip(".")
    return token_match(a, b) > 0 or x + "s" == y or y + "s" == x


def word_partners(words: list[str]) -> dict[str, list[str]]:
    """For each of different words, all of them with which an alignment may pair it, itself included.

    What token_match allows changes few letters of the shorter word: one edit
    takes at most one letter and three pairs of letters from it, two edits at
    most two letters. All pairs of words are compared by these bits first, in
    arrays where there are many; only what passes is compared letter by letter.
    """
    out: dict[str, list[str]] = {w: [w] for w in words}

    def meet(a: str, b: str) -> None:
        if _partners(a, b):
            out[a].append(b)
            out[b].append(a)

    traits = [_traits(w) for w in words]
    if len(words) < 24:
        for i, (n, first, last, bits, twos) in enumerate(traits):
            for j in range(i):
                m, f, e, b_bits, b_twos = traits[j]
                apart = m - n
                less, less_twos, least = (bits & ~b_bits, twos & ~b_twos, n) if apart >= 0 else (b_bits & ~bits, b_twos & ~twos, m)
                less = less.bit_count()
                once = less <= 1 and (least <= 6 or less_twos.bit_count() <= 3)
                if (once or less <= 2 and last == e and least >= 7 and -2 <= apart <= 2) if first == f else once and last == e and -1 <= apart <= 1:
                    meet(words[i], words[j])
        return out
    order = sorted(range(len(words)), key=lambda i: traits[i][0])
    words = [words[i] for i in order]
    size, first, last, letters, pairs = (np.array([traits[i][k] for i in order], t) for k, t in enumerate((np.int32, np.int32, np.int32, np.uint64, np.uint64)))
    step = max(1, (1 << 18) // len(words))
    for at in range(0, len(words), step):
        # rows are the shorter words, as words come by length
        row = slice(at, at + step)
        n = size[row, None]
        less = np.bitwise_count(letters[row, None] & ~letters[None, at:])
        ends = last[row, None] == last[None, at:]
        apart = size[None, at:] - n
        once = (less <= 1) & ((np.bitwise_count(pairs[row, None] & ~pairs[None, at:]) <= 3) | (n <= 6))
        twice = (less <= 2) & ends & (n >= 7) & (apart <= 2)
        # another first letter is the one edit
        maybe = np.where(first[row, None] == first[None, at:], once | twice, once & ends & (apart <= 1))
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(maybe, 1))), strict=True):
            meet(words[at + i], words[at + j])
    return out


@lru_cache(maxsize=1 << 14)
def generic(word: str) -> bool:
    """Whether a word is a kind of venue, or short for one."""
    w = word.rstrip(".")
    return w in GENERIC or any(len(g) > len(w) and token_match(w, g) or len(w) > 5 and near(w, g) for g in GENERIC)


@lru_cache(maxsize=1 << 14)
def _closes(word: str) -> bool:
    w = word.rstrip(".")
    return w in _TAIL or any(len(g) > len(w) and token_match(w, g) or len(w) > 5 and near(w, g) for g in _TAIL)


class Fit(NamedTuple):
    kind: str  # full, short (kinds of venue left out), cut, loose (other words left out), or none
    score: float


NO_FIT = Fit("none", 0.0)


def _assign(a: list[str], b: list[str]) -> tuple[list[int], int] | None:
    """Partner in b of every token of a, by augmenting paths, best matches first; None if some token has none."""
    firsts, points = [], 0
    for x in a:
        best = at = 0
        for j, y in enumerate(b):
            m = 3 if x == y else token_match(x, y)
            if m > best:
                best, at = m, j
                if m == 3:
                    break
        if not best:
            return None
        firsts.append(at)
        points += best
    if len(set(firsts)) == len(firsts):
        return firsts, points  # nobody's best is another's
    options = []
    for x in a:
        options.append(sorted((-m, j) for j, y in enumerate(b) if (m := token_match(x, y))))
    owner: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for _, j in options[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    for i in sorted(range(len(a)), key=lambda i: (options[i][0][0], len(options[i]))):
        if not place(i, set()):
            return None
    partner = [0] * len(a)
    for j, i in owner.items():
        partner[i] = j
    return partner, sum(token_match(a[i], b[j]) for i, j in enumerate(partner))


def _begins(x: list[str], b: Name, cut: bool) -> bool:
    """Whether x is the beginning of b, broken off where b goes on."""
    y, n = b.tokens, len(x)
    if n > len(y) or n < 2 or any(x[i] != y[i] and token_match(x[i], y[i]) < 2 for i in range(n - 1)):
        return False
    last = x[-1].rstrip(".")
    if not y[n - 1].startswith(last):
        return False
    if cut or (last != y[n - 1].rstrip(".") and not x[-1].endswith(".")):
        return True
    return n < len(y) and len(b.joined) > n and b.joined[n]


# fixed values: words that are a kind of venue in front of a subject, and a sister's mark behind it
_DOUBLE = frozenset("letters reports notes papers studies".split())


def _is_kind(b: Name, j: int) -> bool:
    """Whether a generic word tells the kind: one that may mark a sister does only if a small word follows it, or in front."""
    w = b.tokens[j].rstrip(".")
    if not any(w == d or (len(w) < len(d) and token_match(w, d)) for d in _DOUBLE):
        return True
    return j == 0 or (j + 1 < len(b.joined) and b.joined[j + 1])


def align(a: Name, b: Name) -> Fit:
    """How the names fit. b is taken as the fuller one if their lengths differ."""
    if not a.tokens or not b.tokens:
        return NO_FIT
    if len(a.tokens) > len(b.tokens):
        a, b = b, a
    x, y = list(a.tokens), list(b.tokens)
    got = _assign(x, y)
    if got is not None and len(x) == len(y):
        return Fit("full", got[1] / (3.0 * len(x)))
    share = len(x) / len(y)
    if _begins(x, b, a.cut or a.open_end):
        return Fit("cut", share)
    if got is None:
        return NO_FIT
    partner, points = got
    left = set(range(len(y))) - set(partner)
    named = max((j for j in range(len(y)) if j not in left), default=-1)
    # kinds of venue may be left out, never a word that makes a sister of it
    if len(x) >= 2 and all(generic(y[j]) and (j < named or _closes(y[j])) and _is_kind(b, j) for j in left) and sum(not generic(t) for t in x) >= 2:
        return Fit("short", points / (3.0 * len(x)) * share)
    # two words that name it, the rest left out: only good if nothing else in reach fits
    if len(x) >= 2 and all(token_match(x[i], y[j]) >= 2 for i, j in enumerate(partner)) and sum(not generic(t) for t in x) >= 2 and any(generic(y[j]) and (j < named or _closes(y[j])) for j in left):
        return Fit("loose", points / (3.0 * len(x)) * share)
    return NO_FIT
