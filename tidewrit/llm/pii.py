"""Problem 4: personal information in free text.

Pieces with a format (mail addresses, phone and identity numbers, street addresses) are found by grammars of their
formats; names of persons by a lexicon of given and family names that is learned from how names are built in the
texts (initials, commas, infixes) and from the gazetteer. Text in ordinary case teaches names and streets, so that
they are also known where case is lost.

Pieces are replaced by typed placeholders (module ``pseudonyms``): equal values get equal ones in all documents.

Batches of texts are first read as one array of code points, which tells which texts have what a grammar or the
lexicon could match; only those are looked at one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded, code_points, written
from .pseudonyms import eleven_proof, replaced

#: Entries of partial counts that a task holds before it sends them on.
MOST_PARTIAL = 300_000
#: Most given names, family names, streets or towns: they are sent to tasks.
MOST_LEARNED = 5_000_000
KINDS = ["email", "phone", "id_number", "street_address", "person_name"]


def _flood(words: str) -> str:
    """An alternation of words in which every letter may be repeated."""
    return "|".join("".join(c + "+" if c.isalpha() else re.escape(c) for c in w) for w in words.split())


# Words for kinds of streets and for parts of an address.
_EN = _flood("street st road rd lane ln drive dr court ct close avenue ave way place square sq terrace crescent boulevard blvd row hill gardens walk mews quay alley path grove park parade view")
_NL = _flood("straat laan weg dreef plein kade hof steeg gracht singel dijk pad baan markt lei vest kaai berg veld park dam wal pleintje straatje")
_DE = _flood("straße strasse str allee weg platz gasse ufer ring damm chaussee steig pfad graben markt")
_FR = _flood("rue avenue av boulevard bd blvd chemin impasse allée place quai ruelle route passage square cours sentier")
_ES = _flood("calle avenida avda plaza paseo camino callejón ronda travesía carretera glorieta pza")
_SMALL = "van|von|de|der|den|du|des|del|di|da|la|le|las|les|los|el|al|zu|zum|zur|ter|ten|te|of|the|und|en|et|y|d'|l'|’t|'t"
_CAP = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][\w'’-]*"
_W = r"[^\W\d_][\w'’-]*"
_UNIT = r"(?:flat|apt\.?|apartment|unit|suite|floor|bus|bte|boîte|appt\.?|top|wohnung|whg\.?)\s?\w{1,4}|(?:bajo|ático|entresuelo)|\d{1,2}\.?\s?[ºª°o]\.?\s?[A-Za-z]?\b"
_POST = r"\d{4}\s?[A-Za-z]{2}\b|\d{4,5}\b"
_UKPOST = r"[A-Za-z]{1,2}\d[A-Za-z\d]?\s\d[A-Za-z]{2}\b|\d{5}\b"
_NUM = r"\d{1,4}(?:\s?(?:bis|ter)\b|\s?[A-Za-z](?![\w])|\s?[-/]\s?\d{1,3})?(?!\d)"
_I = re.I
STREETS = [
    # number, name and kind of street
    re.compile(rf"(?<![\w.,/-])(?P<num>\d{{1,4}}\s?[A-Za-z]?(?:-\d{{1,3}})?)\s+(?P<name>(?:{_W}\s+){{1,3}}(?:{_EN})\b\.?)", _I),
    re.compile(rf"(?<![\w.,/-])(?P<num>\d{{1,4}}(?:\s?(?:bis|ter))?),?\s+(?P<name>(?:{_FR})\b\.?(?:\s+(?:{_SMALL}))*\s*(?:(?:{_W})(?:\s+(?=[A-ZÀ-Þ]))?){{1,3}})", _I),
    # name with its kind and number
    re.compile(rf"(?<![\w-])(?P<name>(?:{_W}\s+){{0,2}}[\w'’-]*(?:{_NL}))\s+(?P<num>{_NUM})", _I),
    re.compile(rf"(?<![\w-])(?P<name>(?:(?:{_W}\s+){{0,2}}|[\w'’-]+)(?:{_DE})\b\.?)\s+(?P<num>{_NUM})", _I),
    re.compile(rf"(?<![\w-])(?P<name>(?:am|an der|an den|auf dem|auf der|im|in der|zum|zur|op de|aan de|aan het)\s+(?:{_W}\s+){{0,2}}{_W})\s+(?P<num>{_NUM})", _I),
    re.compile(rf"(?<![\w-])(?P<name>(?:(?:{_ES})\b\.?|c/)\s*(?:(?:{_SMALL})\s+)*(?:{_W}\s+){{0,2}}{_W}),?\s+(?:n\.?\s?º\s?)?(?P<num>{_NUM})", _I),
]
_TAIL_UNIT = re.compile(rf"\s*,?\s*(?:{_UNIT})", _I)
_TAIL_POST = re.compile(rf"\s*,\s*(?:{_POST})", _I)
_TAIL_TOWN = re.compile(rf"\s*,\s*(?={_W})", _I)
_UK_AFTER = re.compile(rf"\s+(?:{_UKPOST})", _I)
_TOWN_WORD = re.compile(r"\s*([^\W\d_][\w'’-]*)")

_AT = r"(?:\s?[\[({]\s?(?:at|@|arroba|apenstaartje|a)\s?[\])}]\s?|\s(?:arroba|apenstaartje)\s)"
_DOT = r"(?:\s?[\[({]\s?(?:dot|punt|punto|point|\.)\s?[\])}]\s?|\s(?:dot|punt|punto|point)\s)"
_LOCAL = r"(?<![\w.+%-])[\w.+%-]*\w"
EMAIL = re.compile(
    rf"{_LOCAL}\s?@\s?(?:[\w-]+\.)+[A-Za-z]{{2,}}(?![\w@])"
    rf"|{_LOCAL}{_AT}[A-Za-z][\w-]*(?:(?:{_DOT}|\.)[A-Za-z][\w-]*)+"
    rf"|{_LOCAL}(?:\sat\s|@)[A-Za-z][\w-]*{_DOT}[A-Za-z][\w-]*(?:(?:{_DOT}|\.)[A-Za-z][\w-]*)*",
    _I,
)
#: What a spelled-out address must have.
_SPELLED = re.compile(r"[\[({]\s?(?:at|@|arroba|apenstaartje|a)\s?[\])}]|\s(?:at|arroba|apenstaartje)\s", _I)
IBAN = re.compile(r"(?<![\w])([A-Z]{2}\d{2}(?:[ -]?[A-Z]{4})?(?:[ -]?\d{4}){2,6}(?:[ -]?\d{1,3})?)(?![\w])", _I)
PASSPORT = re.compile(r"(?<![\w-])[A-Z]{2}[ -]?\d{7}(?![\w-])", _I)
SOCIAL = re.compile(r"(?<![\w./-])\d{3}-\d{2}-\d{4}(?![\w-]|[./]\d)")
NATIONAL = re.compile(r"(?<![\w.,+/-])(?:\d{4}\.\d{2}\.\d{3}|\d{3}[ .]\d{3}[ .]\d{3}|\d{9}|\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2})(?![\w-]|[.,]\d)")
PHONE = re.compile(
    r"(?<![\w.,+/(-])(?:"
    r"(?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d(?:[ .-]?\d){5,11}"
    r"|\(0?\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}|\(0\d{2,3}\)(?:[ .-]?\d){6,8}"
    r"|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ .-]\d{2,4}[ .-]\d{2,4}(?:[ .-]\d{2,4})?|0\d{1,4}[ -]\d{4,8}|0\d{8,10}"
    r"|\d{3}[ .-]\d{3}[ .-]\d{4}|555-\d{4}"
    r")(?![\w-]|[.,/]\d)"
)
DATE = re.compile(r"(?<![\w.-])(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?![\w-])")


_RUN = re.compile(r"(.)\1+")
_NAME_WORD = re.compile(r"(?<![@#\w])[^\W\d_][\w'’-]*")
_BARE = re.compile(rf"(?:{_EN}|{_NL}|{_DE}|{_FR}|{_ES})\.?", _I)


def _key(word: str) -> str:
    """A word without case, runs of a letter kept once: what words are compared by, not what they are replaced by."""
    return _RUN.sub(r"\1", "".join(c.lower()[0] for c in word).replace("’", "'"))


word_key = Memo(_key, 300_000)


class Lexicon:
    def __init__(self, given: set[str], family: set[str], streets: set[str], towns: set[str]):
        self.given, self.family, self.streets, self.towns = given, family, streets, towns


_NAME_PAIR = re.compile(rf"(?<![\w.@#-])((?:[A-Z]\.)|{_CAP})((?:\s+(?:[A-Z]\.|{_SMALL}(?=\s)))*)\s+({_CAP})(?![\w@])")
_COMMA_PAIR = re.compile(rf"(?<![\w@#-])((?:(?:{_SMALL})\s+)*{_CAP}),\s+((?:[A-Z]\.)|[A-Z][a-z'’-]+(?:-[A-Z]\w+)?)(?![\w@.])", re.UNICODE)


def _word_set(group: str) -> set[str]:
    return {_key(w) for w in group.replace("+", "").replace("\\", "").split("|")}


#: What the last word before a number, or the first word of a street, must be like, by the grammars in STREETS.
_KIND_WORDS = [_word_set(_EN), _word_set(_FR), tuple(sorted(_word_set(_NL))), tuple(sorted(_word_set(_DE))), {"am", "an", "auf", "im", "in", "zum", "zur", "op", "an"}, _word_set(_ES) | {"c"}]
_ANY_WORD = re.compile(r"[^\W\d_][\w'’-]*")


def street_kinds(keys: list[str]) -> list[int]:
    """The grammars in STREETS that a text with such words can match."""
    have = set(keys)
    out = [i for i in (0, 1, 4, 5) if not have.isdisjoint(_KIND_WORDS[i])]
    return out + [i for i in (2, 3) if any(k.endswith(_KIND_WORDS[i]) for k in have)]


_LETTER, _DIGIT, _LINE, _INNER = 1, 2, 3, 4
_tables: list[tuple[np.ndarray, ...]] = []
_POWERS = np.random.default_rng(20240612).integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _char_tables() -> tuple[np.ndarray, ...]:
    """(class, small letter, whether a capital, whether white space) of each code point below 0x30000."""
    if not _tables:
        kind, low, capital, white = np.zeros(0x30000, np.uint8), np.arange(0x30000, dtype=np.uint32), np.zeros(0x30000, bool), np.zeros(0x30000, bool)
        for c in range(0x30000):
            ch = chr(c)
            if ch.isalnum():
                kind[c] = _DIGIT if ch.isdecimal() else _LETTER
                low[c], capital[c] = ord(ch.lower()[0]), ch.isupper()
            white[c] = ch.isspace()
        for ch, k in (("_", _LINE), ("'", _INNER), ("’", _INNER), ("-", _INNER)):
            kind[ord(ch)] = k
        low[ord("’")] = ord("'")
        _tables.append((kind, low, capital, white))
    return _tables[0]


class Words:
    """The words of a batch of texts: text, start and end in the batch, hash of the key, and what surrounds them."""

    def __init__(self, texts: list[str]):
        kinds, small, capitals, white = _char_tables()
        flat, self.first = code_points(texts)
        n = len(flat)
        safe = np.where(flat < 0x30000, flat, 0)
        k = kinds[safe]
        self.digits = np.bincount(np.searchsorted(self.first, np.flatnonzero(k == _DIGIT), "right") - 1, minlength=len(texts))
        at = np.flatnonzero(k)
        owner = np.searchsorted(self.first, at, "right") - 1
        head = np.ones(len(at), bool)
        head[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(head)
        z = np.zeros(0, np.int64)
        self.text = self.start = self.end = self.hash = z
        self.capital = self.shouted = self.hyphen = self.inner = self.blank_before = z.astype(bool)
        if not len(heads):
            return
        ka = k[at]
        before = np.where(at > self.first[owner], safe[np.maximum(at - 1, 0)], 32)
        begins = (ka == _LETTER) & ~np.isin(kinds[before], (_LETTER, _DIGIT, _LINE)) & (before != ord("@")) & (before != ord("#"))
        start = np.minimum.reduceat(np.where(begins, at, n), heads)
        end = np.append(at[heads[1:] - 1], at[-1]) + 1
        ok = start < n
        run = np.cumsum(head) - 1
        keep = (at >= start[run]) & ok[run]
        c, who = small[safe[at[keep]]].astype(np.uint64), run[keep]
        if not len(c):
            return
        new = np.ones(len(c), bool)
        new[1:] = who[1:] != who[:-1]
        once = new.copy()
        once[1:] |= c[1:] != c[:-1]
        h = np.flatnonzero(new)
        nth = np.cumsum(once)
        place = np.minimum(nth - np.repeat(nth[h], np.diff(np.append(h, len(c)))), 63)
        self.hash = np.add.reduceat(np.where(once, (c + np.uint64(77)) * _POWERS[place], np.uint64(0)), h).view(np.int64)
        self.text, self.start, self.end = owner[heads][ok], start[ok], end[ok]
        self.capital = capitals[safe[self.start]]
        letters = ka[keep] == _LETTER
        self.shouted = ~np.logical_or.reduceat(letters & ~capitals[safe[at[keep]]], h) & (self.end - self.start > 2)
        self.hyphen = np.logical_or.reduceat(c == ord("-"), h)
        solid = np.maximum.accumulate(np.where(white[safe], -1, np.arange(n)))
        prev = np.where(self.start > 0, solid[np.maximum(self.start - 1, 0)], -1)
        has = prev >= self.first[self.text]
        self.inner = has & ~np.isin(flat[np.maximum(prev, 0)], np.array([ord(x) for x in ".!?…:\"“„«-"], np.uint32))
        #: Only white space, or a stop after an initial, stands between the word and the one before it.
        self.blank_before = np.zeros(len(self.start), bool)
        same = self.text[1:] == self.text[:-1]
        self.blank_before[1:] = same & ((prev[1:] < self.end[:-1]) | (flat[np.maximum(prev[1:], 0)] == ord(".")) & (self.end[:-1] - self.start[:-1] == 1) & (prev[1:] == self.end[:-1]))

    def of(self, texts: list[str], i: int) -> str:
        lo = self.first[self.text[i]]
        return texts[self.text[i]][self.start[i] - lo : self.end[i] - lo]


def _hash_of(key: str) -> int:
    c = np.array([ord(x) for i, x in enumerate(key) if not i or key[i - 1] != x], np.uint64)
    return int(((c + np.uint64(77)) * _POWERS[np.minimum(np.arange(len(c)), 63)]).sum(keepdims=True).view(np.int64)[0])


def hashes(keys) -> np.ndarray:
    return np.array(sorted(_hash_of(k) for k in keys), np.int64)


_NOT_PROSE = re.compile(r"https?://\S+|[@#]\w+|<LINEBREAK>|\S+@\S+")
_TWO_WORD_TOWN = re.compile(rf"(?:\d{{5}}|\d{{4}} [A-Z]{{2}}) ({_CAP} {_CAP})|, ({_CAP} {_CAP}) (?:\d{{5}}|[A-Z]{{2}}\d \d[A-Z]{{2}})")


def _titled(text: str) -> bool:
    """Whether nearly all words have capitals, so that capitals tell nothing."""
    words = _ANY_WORD.findall(text)
    return sum(w[0].isupper() for w in words) > 0.7 * len(words) and len(words) > 5


def counted(batches: Iterator[list[str]]) -> Iterator[Counter]:
    """What texts in ordinary case tell about names, streets and two-word towns, as partial counts.

    Keys are (what, word, second word or None): words by case, family names after an initial, pairs of a given and a
    family name, streets and towns.
    """
    n: Counter = Counter()
    infixes = hashes(_SMALL.split("|"))
    for texts in batches:
        texts = [t for t in texts if not (t.islower() or t.isupper())]
        texts = [_NOT_PROSE.sub(" . ", t) if "@" in t or "#" in t or "<" in t or "http" in t else t for t in texts]
        w = Words(texts)
        size = np.bincount(w.text, minlength=len(texts))
        capital = np.bincount(w.text, w.capital, len(texts))
        prose = ~((capital > 0.7 * size) & (size > 5))
        told = prose[w.text]
        values, at, ids = np.unique(w.hash[told], return_index=True, return_inverse=True)
        at = np.flatnonzero(told)[at]
        keys = [word_key[w.of(texts, i)] for i in at.tolist()]
        cap = w.capital[told]
        for what, chosen in (("upper", cap), ("lower", ~cap), ("inner", cap & w.inner[told])):
            for i, k in enumerate(np.bincount(ids[chosen], minlength=len(values)).tolist() if len(values) else ()):
                if k:
                    n[what, keys[i], None] += k
        # A capital after a capital, an initial or an infix, and a shouted word before a comma.
        near = np.zeros(len(w.hash), bool)
        near[1:] = w.capital[1:] & w.blank_before[1:] & (w.capital[:-1] | np.isin(w.hash[:-1], infixes))
        pairs = np.zeros(len(texts), bool)
        pairs[w.text[near]] = True
        commas = np.zeros(len(texts), bool)
        commas[w.text[w.shouted]] = True
        for i in np.flatnonzero(prose & pairs).tolist():
            for m in _NAME_PAIR.finditer(texts[i]):
                first, last = m[1], _key(m[3])
                if len(first) == 2 and first[1] == ".":
                    n["initial", last, None] += 1
                else:
                    n["pair", _key(first), last] += 1
        for i in np.flatnonzero(prose & commas).tolist():
            for m in _COMMA_PAIR.finditer(texts[i]) if "," in texts[i] else ():
                if m[1].split()[-1].isupper() and len(m[1].split()[-1]) > 2:
                    n["pair", _key(m[2]), _key(m[1].split()[-1])] += 1
        for i in np.flatnonzero(prose & (capital > 0) & (w.digits > 0)).tolist():
            t = texts[i]
            for s in street_kinds([word_key[x] for x in _ANY_WORD.findall(t)]):
                for m in STREETS[s].finditer(t):
                    if _cased(m["name"], s) and not m["name"].isupper():
                        n["street", _key(m["name"]), None] += 1
            for m in _TWO_WORD_TOWN.finditer(t):
                n["town", _key(m[1] or m[2]), None] += 1
        if len(n) > MOST_PARTIAL:
            yield n
            n = Counter()
    yield n


def _cased(name: str, kind: int) -> bool:
    """Whether a street's name is written with capitals, apart from small words and, in some languages, its kind."""
    words = [w for w in re.split(r"\s+", name.strip()) if w]
    core = [w for w in words if not re.fullmatch(_SMALL, w.lower()) and not re.fullmatch(rf"(?:{_FR}|{_ES})\.?|c/", w, _I)]
    if kind == 4:
        small = re.compile(_SMALL)
        return len(words) > 1 and words[-1][0].isupper() and words[0].lower() not in ("in", "im", "op", "aan") and all(w[0].isupper() and not small.fullmatch(w.lower()) for w in words[1:])
    return bool(core) and all(w[0].isupper() for w in core)


class Finder:
    def __init__(self, lexicon: Lexicon):
        self.lex = lexicon
        self.family = hashes(lexicon.family)

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Of each text (kind, start, end) of each piece, in order, without overlaps; formats that say more win."""
        w = Words(texts)
        named = np.zeros(len(texts), bool)
        named[w.text[np.isin(w.hash, self.family) | w.hyphen]] = True
        out: list[list[tuple[str, int, int]]] = []
        for t, digits, names in zip(texts, w.digits.tolist(), named.tolist()):
            out.append(self._pieces(t, digits, names) if digits or names or "@" in t or _SPELLED.search(t) else [])
        return out

    def _pieces(self, text: str, digits: int, names: bool) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        links = [m.span() for m in re.finditer(r"https?:/\S+|www\.\S+", text)] if "http" in text or "www." in text else []

        def add(kind: str, a: int, b: int) -> None:
            if all(b <= x or a >= y for _, x, y in out) and all(b <= x or a >= y for x, y in links):
                out.append((kind, a, b))

        if "@" in text or _SPELLED.search(text):
            for m in EMAIL.finditer(text):
                add("email", *m.span())
        words = [(m[0], m.start(), m.end()) for m in _NAME_WORD.finditer(text)] if digits or names else []
        keys = [word_key[w] for w, _, _ in words]
        if digits:
            if kinds := street_kinds(keys):
                self._addresses(text, kinds, add)
        if digits >= 7:
            for m in IBAN.finditer(text):
                v = re.sub(r"[ -]", "", m[1])
                if 14 <= len(v) <= 34 and sum(c.isdigit() for c in v) >= 9:
                    add("id_number", m.start(1), m.end(1))
            for rx in (PASSPORT, SOCIAL):
                for m in rx.finditer(text):
                    if rx is not PASSPORT or not m[0][:2].lower() in ("nr", "no", "to", "at", "op", "is", "in", "of", "om"):
                        add("id_number", *m.span())
            for m in NATIONAL.finditer(text):
                d = re.sub(r"\D", "", m[0])
                if len(d) == 11 or eleven_proof(d) or "." in m[0] and len(d) == 9:
                    if not (d[0] == "0" and " " in m[0]):
                        add("id_number", *m.span())
            for m in PHONE.finditer(text):
                if not DATE.fullmatch(m[0]) and sum(c.isdigit() for c in m[0]) >= 7:
                    add("phone", *m.span())
            for m in NATIONAL.finditer(text):
                add("id_number", *m.span())
        if names:
            self._names(text, words, keys, add)
        return sorted(out, key=lambda x: x[1])

    def _addresses(self, text: str, kinds: list[int], add) -> None:
        titled = _titled(text)
        for s in sorted(kinds):
            rx, at = STREETS[s], 0
            while m := rx.search(text, at):
                at = m.end()
                name, start = m["name"], m.start()
                words = name.split()
                # Leading words that aren't part of the street are given back: those in small letters.
                while len(words) > 1 and s in (2, 3) and not self._street(" ".join(words), s, titled):
                    start += len(words[0])
                    start += len(text[start:]) - len(text[start:].lstrip())
                    words = words[1:]
                if not self._street(" ".join(words), s, titled):
                    at = m.start() + max(1, len(m[0].split()[0]))
                    continue
                end = m.end()
                if s == 0 and text[end - 1] == "." and (_key(name[:-1]) in self.lex.streets or not re.match(r"\s*,|\s+[a-z]", text[end:]) and not re.search(r"(?:ave|rd|st|dr|ln|ct|blvd|sq)\.$", name, _I)):
                    end -= 1
                add("street_address", start, self._tail(text, end, s))
                at = max(at, end)

    def _street(self, name: str, kind: int, titled: bool = False) -> bool:
        if _key(name) in self.lex.streets:
            return True
        words = name.split()
        if titled or len(words) == 1 and _BARE.fullmatch(words[0]) or kind == 2 and len(words[-1]) < 5 and len(words) < 2:
            return False
        return _cased(name, kind)

    def _tail(self, text: str, end: int, kind: int) -> int:
        if m := _TAIL_UNIT.match(text, end):
            end = m.end()
        if kind == 0:
            # Town and postcode after it, the town alone only if it is a known one.
            if m := _TAIL_TOWN.match(text, end):
                stop = m.end()
                for n in range(3):
                    w = _TOWN_WORD.match(text, stop)
                    if not w:
                        break
                    stop = w.end()
                    if p := _UK_AFTER.match(text, stop):
                        return p.end()
            return end
        if m := _TAIL_POST.match(text, end):
            end = m.end()
            if w := _TOWN_WORD.match(text, end):
                first = w[1]
                end = w.end()
                if v := re.match(r"\s+([^\W\d_][\w'’-]*)", text[end:]):
                    two = _key(f"{first} {v[1]}")
                    if two in self.lex.towns:
                        end += v.end()
        return end

    def _names(self, text: str, words: list[tuple[str, int, int]], keys: list[str], add) -> None:
        lex = self.lex

        def between(i: int, j: int) -> str:
            return text[words[i][2] : words[j][1]]

        def is_given(i: int) -> bool:
            return keys[i] in lex.given or "-" in keys[i] and all(p in lex.given for p in keys[i].split("-"))

        def is_initial(i: int) -> bool:
            return len(words[i][0]) == 1 and text[words[i][2] : words[i][2] + 1] == "."

        for j, k in enumerate(keys):
            if k not in lex.family and not ("-" in k and all(p in lex.family for p in k.split("-"))):
                continue
            i, found = j - 1, -1
            while i >= 0 and j - i <= 5:
                gap = between(i, i + 1)
                if is_initial(i) and re.fullmatch(r"\.\s*", gap):
                    found = i
                elif re.fullmatch(r"\s+", gap) and is_given(i):
                    found = i
                elif re.fullmatch(r"\s+", gap) and re.fullmatch(_SMALL, keys[i]) and found < 0:
                    pass
                else:
                    break
                i -= 1
            if found >= 0:
                add("person_name", words[found][1], words[j][2])
                continue
            # Family name first: "Family, Given" or "Family Given", with infixes before it.
            if j + 1 < len(keys) and re.fullmatch(r"\s*,\s+|\s+", between(j, j + 1)) and (is_given(j + 1) or is_initial(j + 1)):
                if j + 2 < len(keys) and keys[j + 2] in lex.family and "," not in between(j, j + 1):
                    continue
                a = j
                while a > 0 and re.fullmatch(_SMALL, keys[a - 1]) and re.fullmatch(r"\s+", between(a - 1, a)) and (words[a - 1][0][0].isupper() == words[j][0].isupper() or words[a - 1][0].islower() and not words[j][0].isupper()) and a - 1 > 0:
                    a -= 1
                end = words[j + 1][2] + (1 if is_initial(j + 1) else 0)
                b = j + 2
                while b < len(keys) and is_initial(b) and re.fullmatch(r"\.?\s+", between(b - 1, b)):
                    end, b = words[b][2] + 1, b + 1
                add("person_name", words[a][1], end)


def lexicon(messages: DataFrame, gazetteer: DataFrame) -> Lexicon:
    """Given and family names, streets and two-word towns, from all distinct texts in ordinary case.

    Only entries that pass their thresholds reach the driver.
    """
    spark = messages.sparkSession
    keys = [r[0] for r in bounded(gazetteer.select("key").where("key is not null"), 500_000, "gazetteer")]
    gaz = {_key(g) for g in keys if " " not in g}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n in counted(batch.column(0).to_pylist() for batch in batches):
            what, a, b = zip(*n) if n else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(map(int, n.values())), pa.int64())], names=["what", "a", "b", "n"])

    def one_column(values: set[str], name: str) -> DataFrame:
        return spark.createDataFrame([(v,) for v in values], f"{name} string")

    def some(df: DataFrame, what: str) -> set[str]:
        return {r[0] for r in bounded(df, MOST_LEARNED, what)}

    texts = messages.select("text_orig").where("text_orig is not null").distinct()
    n = written(texts.mapInArrow(run, "what string, a string, b string, n bigint").groupBy("what", "a", "b").agg(F.sum("n").alias("n")))
    known = one_column(gaz, "a").withColumn("gaz", F.lit(True))
    of = {w: F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)) for w in ("upper", "lower", "inner")}
    words = n.where("what in ('upper', 'lower', 'inner')").groupBy("a").agg(*[c.alias(w) for w, c in of.items()]).join(known, "a", "full")
    # Words that are written like names; ``gaz`` tells those of the gazetteer, also short ones.
    words = written(words.where("gaz or length(a) > 2 and upper > 1.5 * lower and inner >= 0.25 * upper").selectExpr("a", "coalesce(gaz, false) gaz"))
    pairs = n.where("what = 'pair'").join(words.where("length(a) > 2").selectExpr("a b", "gaz"), "b")
    pairs = written(pairs.selectExpr("a", "b", "gaz"))
    streetish = n.where("what = 'street'").select(F.explode(F.split("a", "\\s+")).alias("a")).distinct()
    initial = n.where("what = 'initial' and n >= 2").join(words.where("length(a) > 2"), "a", "left_semi").join(streetish, "a", "left_anti")
    family = some(initial.select("a"), "family names")
    given: set[str] = set()
    for _ in range(3):
        parts = pairs.join(one_column(family, "b"), "b", "left_semi").select(F.explode(F.split("a", "-")).alias("a")).groupBy("a").count()
        given = some(parts.join(words, "a").where("gaz or count >= 3 and length(a) > 2").select("a"), "given names") - family
        last = pairs.withColumn("a", F.split("a", "-")[0]).join(one_column(given, "a"), "a", "left_semi").groupBy("b", "gaz").count()
        family |= some(last.where("gaz or count >= 3").select("b"), "family names") - given
    streets = some(n.where("what = 'street' and n >= 2").select("a"), "streets")
    towns = some(n.where("what = 'town' and n >= 2").select("a"), "towns")
    return Lexicon(given, family, {s for s in streets if not _BARE.fullmatch(s)}, towns | {_key(g) for g in keys if " " in g})


def pieces(messages: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(msg_id, kind, start_pos, end_pos) of each piece of each message, each message once.

    Positions count code points. Null and empty texts have no pieces.
    """
    lex = lexicon(messages, gazetteer)
    sent = messages.sparkSession.sparkContext.broadcast((lex.given, lex.family, lex.streets, lex.towns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(Lexicon(*sent.value))
        for batch in batches:
            rows, kinds, a, b = [], [], [], []
            for k, found in enumerate(find.batch(batch.column("text").to_pylist())):
                for kind, s, e in found:
                    rows.append(k)
                    kinds.append(kind)
                    a.append(s)
                    b.append(e)
            yield pa.RecordBatch.from_arrays([batch.column("msg_id").take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["msg_id", "kind", "start_pos", "end_pos"])

    rows = messages.selectExpr("msg_id", "text_orig text").where("text is not null")
    return rows.mapInArrow(run, "msg_id bigint, kind string, start_pos int, end_pos int").distinct()


def anonymized(messages: DataFrame, gazetteer: DataFrame, key: bytes) -> DataFrame:
    """(msg_id, text) of each message with its pieces and dates replaced; null texts stay null. Each message once.

    ``key`` is the secret that the pseudonyms depend on; without it they can't be undone.
    """
    lex = lexicon(messages, gazetteer)
    sent = messages.sparkSession.sparkContext.broadcast((lex.given, lex.family, lex.streets, lex.towns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(Lexicon(*sent.value))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for t, found in zip(texts, find.batch([t or "" for t in texts])):
                if t:
                    dates = [("date", *m.span()) for m in DATE.finditer(t) if all(m.end() <= a or m.start() >= b for _, a, b in found)]
                    t = replaced(t, sorted(found + dates, key=lambda x: x[1]), key)
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("msg_id"), pa.array(out, pa.string())], names=["msg_id", "text"])

    once = messages.selectExpr("msg_id", "text_orig text").where("msg_id is not null").dropDuplicates(["msg_id"])
    return once.mapInArrow(run, "msg_id bigint, text string")
