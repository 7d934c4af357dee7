"""Problem 1: sentence units of texts in many scripts, with careless punctuation or none.

Every character is tagged as the last one of a sentence or as inside of one. Only where a unit (word, stop, emoji ...)
ends can it be the last one, and in runs of letters of scripts without blanks, where every character can. A linear-chain
model scores the tags from the text around each place and from the tag before, and Viterbi decoding picks the best
sequence of tags. The model is trained here, on labels that the texts give themselves: in text with ordinary case and
punctuation most boundaries are plain, and abbreviations show by the small letters that follow them. The sentences so
found are then joined again with punctuation, case and blanks taken away, so that the model learns which words, or
letters of scripts without blanks, begin and end sentences. Transitions are learned from the expected pairs of tags.

Abbreviations and the words that begin and end sentences are counted over all texts; only the weights are fitted on a
sample.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded, hash_bound

#: Messages that the weights are fitted on, the same ones whatever the order of rows: the smallest hashes of their text.
TRAINING = 8_000
#: A word begins or ends sentences if it does so in one of so many texts, or more often.
TEXTS_PER_WORD = 25_000
#: How many times as often as other words single letters must begin sentences.
SINGLE = 10
#: Pairs of tags that independent tags count as, when transitions are learned.
DRAWN = 200.0
#: How often an abbreviation must stand before a small letter.
LEAST_SEEN = 3
#: Words of partial counts that a task holds before it sends them on, and most words that are sent to the driver.
MOST_PARTIAL, MOST_WORDS = 300_000, 2_000_000
BITS = 18
#: What counts against a boundary without stop or tail, beside the model's score.
BARE = 1.5
STOPS = ".!?…。！？｡．؟।॥۔"
_EMOJI = "←-⇿⌀-➿⬀-⯿️‍\U0001f000-\U0001faff\U000e0020-\U000e007f"
_SMILEY = r"(?:[:;=8][-'^o]?[()\[\]DPpdOoSs3/\\|*]+|[xX][-]?[DdPp)]+|[BO]-?\)|<+/?3+|\^[_.]*\^|:'\(|-_+-)(?!\w)"
UNIT = re.compile(
    "|".join([
        r"(?P<line>(?i:<LINEBREAK>))",
        r"(?P<tail>(?:https?:/|www\.)[^\s　-鿿]+|#\w+|•|" + _SMILEY + f"|[{_EMOJI}]+)",
        r"(?P<mail>[\w.+-]+@[\w-]+(?:\.\w+)+)",
        r"(?P<handle>@\w+)",
        r"(?P<number>[.,]?\d+(?:[.,:/-]\d+)*)",
        r"(?P<stop>[.!?…。！？｡．؟।॥۔]+)",
        r"(?P<word>[^\W\d_][\ẁ-ͯऀ-ॣ०-෿ั-๎'’`\-­​-‏⁠﻿]*)",
        r"(?P<open>[(\[{“„«‹「『‘¿¡])",
        r"(?P<close>[)\]}”»›」』])",
        r"(?P<quote>[\"])",
        r"(?P<mark>[^\s\w])",
    ])
)
_SEA = re.compile("[฀-໿က-႟ក-៿]")
_CJK = re.compile("[⺀-鿿]")
_UNSPACED = re.compile("[⺀-鿿฀-໿က-႟ក-៿]")
_RUN = re.compile(r"(.)\1+")


_MASK = (1 << BITS) - 1
text_hash = Memo(lambda s: zlib.crc32(s.encode("utf-8", "replace")), 300_000)


def _shape(w: str) -> str:
    if not w:
        return "-"
    if not w[0].isalpha():
        return "0" if w[0].isdigit() else "."
    if w[0].lower() == w[0].upper():
        return "n"
    if w.isupper():
        return "A" if len(w) > 1 else "I"
    return "U" if w[0].isupper() else "l"


def _word_features(w: str) -> tuple[str, str, int, int, int]:
    """(key, shape, and hashes of key, end and beginning) of a word; scripts without blanks are known by their edges."""
    low = _RUN.sub(r"\1", w.lower())
    if _CJK.match(w) or _SEA.match(w):
        return low, "n", text_hash[low[:24]], text_hash[low[-5:]], text_hash[low[:5]]
    return low, _shape(w), text_hash[low], text_hash[low[-2:]], text_hash[low[:2]]


word_features = Memo(_word_features, 200_000)


class Places:
    """The candidate places of a text: where a sentence could end, with the hashed features of each."""

    __slots__ = ("text", "units", "ends", "starts", "features", "kinds", "silver", "lower")

    def __init__(self, text: str, silver: Silver | None = None):
        self.text = text
        units = [(m.lastgroup, m[0], m.start(), m.end()) for m in UNIT.finditer(text)]
        # Straight quotes open and close in turn; a tail, a closing mark or a stop belongs to what precedes it.
        # Guillemets open in either direction, and a high mark closes what a low one opened.
        out, double, angle, low = [], False, False, False
        for kind, s, a, b in units:
            if kind == "quote":
                kind, double = ("close" if double else "open"), not double
            elif s in "«»":
                kind, angle = ("close" if angle else "open"), not angle
            elif s == "„":
                low = True
            elif s in "“”" and low:
                kind, low = "close", False
            out.append((kind, s, a, b))
        self.units = out
        self.ends, self.starts, self.features, self.kinds, self.silver = [], [], [], [], []
        self.lower = not any(map(str.isupper, re.sub("<LINEBREAK>", "", text))) if silver else False
        n = len(out)
        last_word, last2, depth = "", "", 0
        seen_words = 0
        stop, tail, closed, inner_stop = "", False, False, ""
        for i, (kind, s, a, b) in enumerate(out):
            if kind == "line":
                continue
            if kind == "word" and b - a > 3 and _UNSPACED.match(s):
                self._inside(s, a, silver)
            if kind in ("word", "number", "handle", "mail"):
                last2, last_word = last_word, s
                seen_words += kind != "handle"
                stop, tail, closed = "", False, False
            elif kind == "stop":
                stop = stop + s
            elif kind == "tail":
                tail = True
            elif kind == "open":
                depth += s not in "¿¡"
                stop, tail, closed = "", False, False
            elif kind == "close":
                depth = max(0, depth - 1)
                closed = True
            else:
                stop, tail, closed = stop if closed else "", False, False
                if s in ",;:":
                    stop = ""
            j, line = i + 1, False
            while j < n and out[j][0] == "line":
                line, j = True, j + 1
            if j >= n:
                break
            nk, ns, na, _ = out[j]
            if nk in ("stop", "tail", "close") or nk == "mark" and ns in ",;:)-–—" and not (ns in "-–—" and stop):
                continue
            if kind == "open" or not last_word or not seen_words:
                continue
            glued = na == b
            if glued and not stop and not tail and not (kind == "close") and kind != "word":
                continue
            if glued and kind == "word" and not stop:
                continue
            k = j
            while k < n and out[k][0] in ("open", "mark", "line"):
                k += 1
            nw = out[k][1] if k < n else ""
            nw_kind = out[k][0] if k < n else "-"
            k += 1
            while k < n and out[k][0] not in ("word", "number"):
                k += 1
            nw2 = out[k][1] if k < n else ""
            self._candidate(b, na, kind, stop, tail, closed, glued, line, depth, last_word, last2, nw, nw2, nw_kind, nk, seen_words, silver)

    def _inside(self, s: str, at: int, silver) -> None:
        """Each place within a run of letters without blanks, with its letters to both sides."""
        n = len(s)
        script = "T" if _SEA.match(s) else "C"
        for j in range(2, n - 1):
            if not (s[j - 1].isalnum() and s[j].isalnum()):
                continue
            l1, l2, l3, r1, r2, r3 = s[j - 1], s[j - 2 : j], s[max(0, j - 3) : j], s[j], s[j : j + 2], s[j : j + 3]
            keys = (script, "a" + l1, "b" + l2, "c" + l3, "d" + r1, "e" + r2, "f" + r3, f"g{l1} {r1}", f"h{l2} {r2}", f"i{l1} {r2}", f"j{l2} {r1}", f"k{l3} {r1}", f"l{l1} {r3}", f"m{l3} {r3}", f"{script}{min(j, 6)} {min(n - j, 6)}")
            self.ends.append(at + j)
            self.starts.append(at + j)
            self.kinds.append(("i", False))
            self.features.append([text_hash["~" + k] & _MASK for k in keys])
            if silver is not None:
                self.silver.append(0)

    def _candidate(self, end, start, kind, stop, tail, closed, glued, line, depth, w, w0, nw, nw2, nw_kind, nk, seen, silver):
        if stop:
            p = "..." if "…" in stop or ".." in stop else "!" if stop.strip(".!?") == "" and stop != "." else stop[0] if stop[0] in ".。।" else "S"
        else:
            p = "," if kind == "mark" else "0"
        key, ws, wk, we, _ = word_features[w]
        nkey, ns, nwk, _, nb = word_features[nw] if nw else ("", "-", 1, 1, 1)
        n2k = word_features[nw2][2] if nw2 else 1
        wide = "T" if _SEA.match(nw) and _SEA.match(w) else "C" if _CJK.match(nw) else ""
        base = text_hash[f"{p}{tail}{closed}{glued}{depth > 0}{wide}"]
        shape = text_hash[f"{ws}{ns}"]
        ph = text_hash[p]
        self.ends.append(end)
        self.starts.append(start)
        self.kinds.append((p, tail))
        self.features.append([
            base & _MASK, base * 3 + shape * 7 + 11 & _MASK, base * 5 + 13 * line + text_hash[ns] & _MASK, wk * 9 + ph * 3 + 17 * glued + 19 & _MASK,
            wk * 11 + ph * 5 + shape & _MASK, nwk * 13 + ph * 7 + closed & _MASK, nwk * 15 + shape * 9 + tail & _MASK, nwk * 17 + n2k * 19 + ph & _MASK,
            we * 21 + ph * 9 + shape * 3 + min(len(w), 4) & _MASK, we * 23 + nb * 25 + 29 & _MASK, wk * 27 + text_hash[w0[-6:]] * 29 + ph & _MASK,
            text_hash[nk + nw_kind] * 31 + ph * 11 + shape & _MASK, ph * 33 + shape * 11 + 35 * (seen == 1) + 37 * (kind == "mark") & _MASK, nb * 35 + base & _MASK,
            wk * 39 + nwk * 41 + 43 & _MASK,
        ])
        if silver is not None:
            self.silver.append(silver.label(p, tail, closed, glued, depth, w, key, nkey, nw_kind, nk, ws, ns, kind, seen, wide, self.lower))


class Silver:
    """Labels that a collection of texts gives itself: 1 a boundary, 0 none, -1 not plain."""

    def __init__(self, abbreviations: set[str], starters: set[str], enders: set[str]):
        self.abbreviations, self.starters, self.enders = abbreviations, starters, enders

    @staticmethod
    def of(texts: list[str]) -> Silver:
        total: Counter = Counter()
        for n in counted(iter([texts])):
            total.update(n)
        return Silver.from_counts(total, len(texts))

    @staticmethod
    def from_counts(n: Counter, texts: int) -> Silver:
        """``n``: counts by (what, word) as ``counted`` gives them, of so many texts."""
        least = max(1.0, texts / TEXTS_PER_WORD)
        # Single letters also begin smileys and the second parts of abbreviations.
        chosen = lambda what: {w for (k, w), c in n.items() if k == what and c >= least * (SINGLE if len(w) < 2 else 1)}
        short = {w for (k, w), c in n.items() if k == "stop" and is_abbreviation(w, c, n["small", w], n["bare", w])}
        return Silver({part for w in short for part in (w, w.rsplit(".", 1)[-1])}, chosen("starter"), chosen("ender"))

    def label(self, p, tail, closed, glued, depth, w, key, nkey, nw_kind, nk, ws, ns, kind, seen, wide, lower) -> int:
        if depth:
            return 0 if p in "0," else -1
        if closed and p != "0":
            # A quotation that ends in a stop goes on with its reporting clause if a small letter follows.
            if wide == "C" and glued or nk == "mark" and ns in "ln":
                return 0
            return 0 if ns == "l" and not lower else 1 if ns == "U" and nkey in self.starters else -1
        if nw_kind == "handle" and (p != "0" or tail):
            return 1
        if kind == "mark":
            return 0
        if nk == "mark" and ns == "l" and not lower:
            return 0
        if p in "。।S":
            return -1 if closed else 1
        if wide == "T":
            return 0 if w.endswith("ๆ") or len(w) < 6 or len(nkey) < 4 or nk == "open" else 1 if len(w) > 7 and len(nkey) > 8 else -1
        if tail:
            return 1 if ns in "Un" or lower and nkey in self.starters else -1
        if p == "..." and seen <= 1 and not tail:
            return 0
        if p == "!":
            if ns == "l" and not lower and nkey not in self.starters:
                return 0
            return 1 if ns in "UnI0A" and not glued or ns == "U" or wide == "C" or lower and nkey in self.starters else -1
        if p == ".":
            if glued:
                return 1 if ns == "U" and len(w) > 2 and ws in "lU" and nkey in self.starters else 0
            if ws == "n" and "ऀ" <= w[0] <= "ॿ":
                return 0  # these scripts end sentences with marks of their own
            if key in self.abbreviations or len(w) == 1:
                return 0 if ns in "l0n" or ns in "UI" and nkey not in self.starters else -1
            if ws == "0" and ns == "U":
                return 0 if nkey not in self.starters else -1
            if ns in "Un" or ns == "I" and len(w) > 3:
                return 1
            return 1 if lower and ns == "l" and len(w) > 3 and nkey in self.starters else 1 if ns == "0" and len(w) > 4 else 0 if ns == "l" and not lower and key not in self.enders else -1
        if p == "...":
            return -1 if lower else 0 if ns == "l" else 1 if ns == "U" else -1
        return 0 if ns in "l0An" or key not in self.enders or nkey not in self.starters else -1


#: Classes of places by their marks: a stop or a tail, a comma or nothing, within a run of letters.
_CLASS = {"0": 1, ",": 1, "i": 2}


class Model:
    """Weights of features, and scores (class of place, tag before, tag) of transitions; tag 1 ends a sentence."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray | None = None):
        self.weights, self.trans = weights, np.zeros((3, 2, 2)) if trans is None else trans

    def scores(self, places: Places) -> list[float]:
        """Log odds of tag 1 at each place, by its features alone."""
        return self.weights[np.array(places.features)].sum(1, dtype=np.float64).tolist()

    def boundaries(self, places: Places) -> list[int]:
        """Indices of the places that end a sentence, by Viterbi."""
        if not places.ends:
            return []
        tr = self.trans.tolist()
        stay, cut, back = 0.0, -1e9, []
        for s, (p, tail) in zip(self.scores(places), places.kinds):
            kind = 0 if tail else _CLASS.get(p, 0)
            if kind:
                # Joined training sentences overstate how often a sentence ends without any mark.
                s -= BARE
            (ss, sc), (cs, cc) = tr[kind]
            a, b, c, d = stay + ss, cut + cs, stay + sc, cut + cc
            back.append((a < b, c < d))
            stay, cut = max(a, b), max(c, d) + s
        out, at = [], cut > stay
        for i in range(len(back) - 1, -1, -1):
            if at:
                out.append(i)
            at = back[i][1 if at else 0]
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each sentence of a text, without surrounding white space and line breaks."""
        places = Places(text)
        out, start = [], 0
        cuts = [(places.ends[i], places.starts[i]) for i in self.boundaries(places)]
        for end, nxt in [*cuts, (len(text), len(text))]:
            a, b = _trimmed(text, start, end)
            if a < b:
                out.append((a, b))
            start = end
        return out


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while True:
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if b - a >= 11 and text[a : a + 11].upper() == "<LINEBREAK>":
            a += 11
        elif b - a >= 11 and text[b - 11 : b].upper() == "<LINEBREAK>":
            b -= 11
        else:
            return a, max(a, b)


_BARE_WORD = re.compile(r"\w+(?![\w.])")
_BEFORE_STOP = re.compile(r"(?:^|[\s(])((?:\w+\.)*\w+)\.(?=\s+(\S))")
_FIRST_WORD = re.compile(r"(?:@\w+\s+)?([^\W\d_][\w'’]*)(?=\s)(?!\s*[-,:])")
_AROUND_MARK = re.compile(r"([\w'’]+)[!?]+\s+(?:[\"“„«(]\s?)?([^\W\d_][\w'’]*)")


def counted(batches: Iterator[list[str]]) -> Iterator[Counter]:
    """What texts tell about words, as partial counts by (what, word): those that begin texts and sentences and those that
    end sentences, words before a stop and how often a small letter or digit follows it, and words without a stop."""
    n: Counter = Counter()
    bare: Counter = Counter()
    for texts in batches:
        for t in texts:
            if m := _FIRST_WORD.match(t):
                n["starter", word_features[m[1]][0]] += 1
            if "!" in t or "?" in t:
                for m in _AROUND_MARK.finditer(t):
                    if not m[2][0].islower():
                        n["ender", word_features[m[1]][0]] += 1
                        n["starter", word_features[m[2]][0]] += 1
            if t.islower() or t.isupper():
                continue
            bare.update(_BARE_WORD.findall(t.lower()))
            if ". " in t or ".\t" in t or ".\n" in t or not t.isascii():
                for m in _BEFORE_STOP.finditer(t):
                    w = m[1].lower()
                    if len(w) <= 7:
                        n["stop", w] += 1
                        if m[2].islower() or m[2].isdigit():
                            n["small", w] += 1
        if len(n) + len(bare) > MOST_PARTIAL:
            yield _with_bare(n, bare)
            n, bare = Counter(), Counter()
    yield _with_bare(n, bare)


def _with_bare(n: Counter, bare: Counter) -> Counter:
    """Only words as short as abbreviations matter."""
    for w, k in bare.items():
        if len(w) <= 7:
            n["bare", w] += k
    return n


def is_abbreviation(word: str, stops: int, small: int, bare: int) -> bool:
    """A word that often stands with a stop before a small letter or digit, and either nearly always so or hardly without a
    stop, or a short one that hardly ever stands without one."""
    return small >= max(LEAST_SEEN, 0.4 * stops) and (2 * stops >= bare or small >= 0.8 * stops) or stops >= 5 and stops >= 4 * bare and len(word) <= 4 and not word.isdigit()


def train(texts: list[str], silver: Silver | None = None, rounds: int = 6) -> Model:
    """Fit the model on raw texts; deterministic for a given list. ``silver`` is what all texts tell, by default these."""
    texts = sorted(set(texts))
    rng = random.Random(11)
    silver = silver or Silver.of(texts)
    chains: list[Places] = []
    x, y, sentences = [], [], []

    def add(text: str, forced: set[int] | None = None, inside: bool = False) -> Places:
        p = Places(text, silver)
        for f, label, end in zip(p.features, p.silver, p.ends):
            if forced is not None:
                label = 1 if end in forced else 0 if inside and label != 1 else label
            if label >= 0:
                x.append(f)
                y.append(label)
        return p

    for t in texts:
        p = add(t)
        chains.append(p)
        # The same text without its case has the same boundaries.
        for other in (t.lower(), t.upper()) if rng.random() < 0.5 else (t.lower(),):
            if other != t and len(other) == len(t):
                known = {end: label for end, label in zip(p.ends, p.silver) if label >= 0}
                q = Places(other, None)
                for f, end in zip(q.features, q.ends):
                    if end in known:
                        x.append(f)
                        y.append(known[end])
        start, plain = 0, True
        for end, label in [*zip(p.ends, p.silver), (len(t), 1)]:
            if label == 1:
                a, b = _trimmed(t, start, end)
                if plain and b - a > 8:
                    sentences.append(t[a:b])
                start, plain = end, True
            elif label < 0:
                plain = False
    whole = [t for t in texts if _SEA.search(t)]
    for t in whole:
        body = re.sub(r"^@\w+\s*|\s*(?:#\w+|https?:\S+)\s*$", "", t).strip()
        if body and not re.search(r"\s", body):
            sentences.append(body)
    rng.shuffle(sentences)
    bare = [re.sub(r"^(?:@\w+|\w+\s*[,:-])\s+|\s*(?:#\w+|https?:\S+|" + _SMILEY + f"|[{_EMOJI}]+)+\\s*$", "", s) for s in sentences]
    for a, b in zip(bare, bare[1:]):
        if not a or not b or bool(_SEA.search(a)) != bool(_SEA.search(b)) or bool(_CJK.search(a)) != bool(_CJK.search(b)):
            continue
        body = a.rstrip(STOPS + " ")
        how = rng.random()
        if (_SEA.search(a) or _CJK.search(a)) and body and how < 0.35 and body[-1].isalpha() and b[0].isalpha():
            joined, first = body + b, len(body)
        elif _SEA.search(a):
            joined, first = body + " " + b, len(body)
        elif how < 0.25:
            joined, first = (a + " " + b).lower(), len(a)
        elif how < 0.35:
            joined, first = (a + " " + b).upper(), len((a).upper())
        elif how < 0.5:
            joined, first = body + " " + b, len(body)
        elif how < 0.62:
            joined, first = (body + " " + b).lower(), len(body)
        elif how < 0.72:
            joined, first = a + b, len(a)
        elif how < 0.86:
            joined, first = body + rng.choice(["...", "…", "!", "?", ".", "!!", "?!"]) + " " + b.lower(), 0
            first = len(joined) - len(b.lower()) - 1
        else:
            joined, first = body + " :) " + b.lower(), len(body) + 3
        add(joined, {first}, True)
    weights = np.zeros(1 << BITS)
    if not x:
        return Model(weights)
    xs, ys = np.array(x), np.array(y, float)
    g2 = np.full(1 << BITS, 1e-3)
    order = np.random.default_rng(3)
    for _ in range(rounds):
        perm = order.permutation(len(ys))
        for lo in range(0, len(perm), 512):
            at = perm[lo : lo + 512]
            f = xs[at]
            p = 1 / (1 + np.exp(-np.clip(weights[f].sum(1), -30, 30)))
            e = np.repeat(ys[at] - p, f.shape[1])
            idx = f.ravel()
            g = np.bincount(idx, e, 1 << BITS) if len(idx) > 60_000 else None
            if g is None:
                u, inv = np.unique(idx, return_inverse=True)
                gu = np.bincount(inv, e)
                g2[u] += gu * gu
                weights[u] += 0.25 * gu / np.sqrt(g2[u])
            else:
                g2 += g * g
                weights += 0.25 * g / np.sqrt(g2)
    return Model(weights, transitions(Model(weights), chains))


def transitions(model: Model, chains: list[Places]) -> np.ndarray:
    """How much more often a tag follows another one than it is met, in nats, by class of place; from the labels of the
    places that have one and the model's probabilities of the others."""
    pairs = np.zeros((3, 2, 2))
    for p in chains:
        if not p.ends:
            continue
        q = [float(label) if label >= 0 else 1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s, label in zip(model.scores(p), p.silver)]
        before = 0.0
        for x, (mark, tail) in zip(q, p.kinds):
            k = 0 if tail else _CLASS.get(mark, 0)
            pairs[k] += np.outer((1 - before, before), (1 - x, x))
            before = x
    # Rare pairs are drawn to what independent tags would give.
    share = (pairs + 1) / (pairs + 1).sum((1, 2), keepdims=True)
    share = pairs + DRAWN * share.sum(2, keepdims=True) * share.sum(1, keepdims=True)
    share /= share.sum((1, 2), keepdims=True)
    return np.log(share / (share.sum(2, keepdims=True) * share.sum(1, keepdims=True)))


def training_texts(messages: DataFrame, text_col: str = "text_orig", most: int = TRAINING) -> list[str]:
    """At most ``most`` texts for fitting: those with the smallest hash, whatever the table's size or order."""
    t = F.col(text_col)
    bound = hash_bound(most, messages.count())
    rows = messages.select(t.alias("t"), F.xxhash64(t).alias("h")).where((F.col("h") <= F.lit(bound)) & F.col("t").rlike("\\p{L}")).distinct().orderBy("h", "t").limit(most).collect()
    return [r[0] for r in rows]


def silver_of(messages: DataFrame, text_col: str = "text_orig") -> Silver:
    """What all texts of a table tell; words too rare to matter don't reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n in counted([t for t in batch.column(0).to_pylist()] for batch in batches):
            what, word = zip(*n) if n else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(word, pa.string()), pa.array(list(n.values()), pa.int64())], names=["what", "word", "n"])

    texts = messages.select(F.col(text_col).alias("t")).where("t is not null")
    n = texts.mapInArrow(run, "what string, word string, n bigint").groupBy("what", "word").agg(F.sum("n").alias("n"))
    size = texts.count()
    wide = n.groupBy("word").agg(*[F.sum(F.when(F.col("what") == k, F.col("n")).otherwise(0)).alias(k) for k in ("starter", "ender", "stop", "small", "bare")])
    least = max(1.0, size / TEXTS_PER_WORD)
    short = (F.col("small") >= F.greatest(F.lit(LEAST_SEEN), 0.4 * F.col("stop"))) & ((2 * F.col("stop") >= F.col("bare")) | (F.col("small") >= 0.8 * F.col("stop"))) | (F.col("stop") >= 5) & (F.col("stop") >= 4 * F.col("bare"))
    rows = bounded(wide.where((F.col("starter") >= least) | (F.col("ender") >= least) | (F.col("stop") > 0) & short), MOST_WORDS, "words that begin or end sentences, and abbreviations,")
    total = Counter({(k, r["word"]): r[k] for r in rows for k in ("starter", "ender", "stop", "small", "bare") if r[k]})
    return Silver.from_counts(total, size)


def fitted(messages: DataFrame) -> Model:
    return train(training_texts(messages), silver_of(messages))


def sentence_spans(texts: DataFrame, model: Model, columns: str) -> DataFrame:
    """``columns`` (names of ``texts``, without ``text``), start_pos, end_pos: one row for each sentence of ``text``.

    Positions count code points from 0, end exclusive. Null and blank texts have no sentence; a very long text is one
    chain and is decoded whole. Repeated rows give repeated sentences.
    """
    sent = texts.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.trans))
    names = [c.strip() for c in columns.split(",")]
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            rows, a, b = [], [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                for s, e in own.spans(t):
                    rows.append(k)
                    a.append(s)
                    b.append(e)
            index = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in names), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=[*names, "start_pos", "end_pos"])

    slim = texts.select(*names, "text").where("text is not null")
    return slim.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", start_pos int, end_pos int")


def fields(messages: DataFrame) -> DataFrame:
    """(msg_id, field, text): both text fields of each message that has them."""
    return messages.select("msg_id", F.explode(F.map_from_arrays(F.array(F.lit("text_orig"), F.lit("text_prepro")), F.array("text_orig", "text_prepro"))).alias("field", "text")).where("text is not null")
