"""Problem 7: abusive, hateful or sexually explicit content.

A linear-chain conditional random field tags the toxic tokens of a text; forward-backward marginals of the tags give
the text's score and the offending offsets. Judgements are on whole messages, so tokens get their training tags first:
word sequences that are met in judged-abusive messages and hardly elsewhere, listed terms and disguised words within
such messages are toxic, everything in messages judged harmless is not. Disguises (letters set apart, digits for
letters, stars) are undone before, so that a disguised word is the word. Categories are learned too: toxic sentences
with a listed term have its category, and a naive Bayes model over words and word pairs, refined by
expectation-maximization over the toxic sentences without one, gives it to all others.

Texts are read in batches: words are found, folded and hashed over one array of code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lookalikes
from .common import Memo, bounded, code_points, hash_bound
from .mojibake import CharModel, clean_characters, repaired, suspicious

#: Judged messages that the model is fitted on at most: those with the smallest hash of their id.
TRAINING = 30_000
BITS = 18
MASK = (1 << BITS) - 1
THRESHOLD = 0.5
#: Marginal from which a token is part of an offending span.
TOXIC = 0.2
#: Share of abusive messages among the judged and of wrong judgements, for weighing votes.
PRIOR, ERROR = 0.2, 0.08
CATEGORIES = ["abuse", "hate", "sexual"]
#: Prior of the categories of a toxic sentence, and the nats that a listed term adds for its own.
CATEGORY_PRIOR, TERM_NATS = [0.96, 0.02, 0.02], 3.0
_LEET = str.maketrans("013457$@!", "oieastsai")
_SKIP = re.compile(r"https?:/\S+|www\.\S+|\S+@\S+\.\S+|[@#]\w+|(?i:<LINEBREAK>)")
_SKIP_SIGNS = re.compile(r"[@#<]|http|www\.")
_BREAKS = np.array([ord(c) for c in ".!?…。！？।॥؟"], np.uint32)
_RUN = re.compile(r"(.)\1+")
_rng = np.random.default_rng(20240611)
_POWERS = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Classes of characters: what a word is made of, and the signs that stand for letters in disguised ones.
_LETTER, _DIGIT, _LINE, _SIGN, _AT, _STAR, _QUOTE = range(1, 8)
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, small letter) of each code point below 0x30000; others are no part of words."""
    if not _tables:
        kind, low = np.zeros(0x30000, np.uint8), np.arange(0x30000, dtype=np.uint32)
        for c in range(0x30000):
            ch = chr(c)
            if ch.isalnum():
                kind[c] = _DIGIT if ch.isdigit() else _LETTER
                low[c] = ord(ch.lower()[0])
        for ch, k in zip("_$@*'’", (_LINE, _SIGN, _AT, _STAR, _QUOTE, _QUOTE)):
            kind[ord(ch)] = k
        low[ord("’")] = ord("'")
        _tables.append((kind, low))
    return _tables[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def _key_hash(key: str) -> int:
    """Hash of a key as the reader makes it: of its characters, runs kept once."""
    codes = [c for i, c in enumerate(map(ord, key)) if not i or ord(key[i - 1]) != c]
    place = np.minimum(np.arange(len(codes)), 63)
    return int(_mixed(((np.array(codes, np.uint64) + np.uint64(77)) * _POWERS[place]).sum(keepdims=True)).view(np.int64)[0])


key_hash = Memo(_key_hash, 300_000)


def _plain(word: str) -> tuple[str, int]:
    """A word's key and its kind of disguise: 0 none, 1 digits for letters, 2 stars."""
    low = "".join(c.lower()[0] for c in word).replace("’", "'")
    kind = 0
    if "*" in low:
        kind = 2
    elif len(low) >= 4 and re.search(r"[013457$@]", low) and re.search(r"[^\W\d_]", low) and not re.search(r"[2689]", low):
        undone = low.translate(_LEET)
        if undone.isalpha():
            low, kind = undone, 1
    return _RUN.sub(r"\1", low), kind


plain = Memo(_plain, 300_000)


class Tokens:
    """The tokens of a batch of texts: hashed key, kind of disguise, place in the batch, text and sentence of each."""

    __slots__ = ("word", "kind", "start", "end", "text", "sentence", "first")

    def __init__(self, word, kind, start, end, text, sentence, first):
        self.word, self.kind, self.start, self.end, self.text, self.sentence = word, kind, start, end, text, sentence
        #: Where each text begins in the batch.
        self.first = first

    def bounds(self) -> np.ndarray:
        """Offsets of the sentences."""
        if not len(self.word):
            return np.zeros(1, np.int64)
        return np.append(np.flatnonzero(np.diff(self.sentence, prepend=-1)), len(self.word))


class Reader:
    """Makes texts sequences of tokens; ``known`` are keys that a disguise may stand for."""

    def __init__(self, known: set[str]):
        self.known = known
        self.by_length: dict[int, list[str]] = {}
        for k in sorted(known):
            self.by_length.setdefault(len(k), []).append(k)
        self.starred, self.inside = Memo(self._starred, 50_000), Memo(self._inside, 50_000)

    def _starred(self, key: str) -> str:
        for n in (len(key), len(key) + 1, len(key) - 1):
            pattern = re.compile(re.escape(key).replace("\\*", ".{1,2}" if n > len(key) else "."))
            for k in self.by_length.get(n, ()):
                if pattern.fullmatch(k):
                    return k
        return key

    def _inside(self, letters: str) -> str:
        """The longest known word in letters that were set apart, else all of them."""
        joined = _RUN.sub(r"\1", letters.lower())
        for n in range(len(joined), 3, -1):
            for i in range(len(joined) - n + 1):
                if joined[i : i + n] in self.known:
                    return joined[i : i + n]
        return joined

    def __call__(self, texts: list[str]) -> Tokens:
        """Sentences are rough; a tag, a link or a line break need not end one."""
        kinds, small = tables()
        texts = [_SKIP.sub(lambda m: " " * len(m[0]), t) if _SKIP_SIGNS.search(t) else t for t in texts]
        flat, first = code_points(texts)
        n = len(flat)
        safe = np.where(flat < 0x30000, flat, 0)
        k = kinds[safe]
        at = np.flatnonzero(k)
        if not len(at):
            z = np.zeros(0, np.int64)
            return Tokens(z, z, z, z, z, z, first)
        owner = np.searchsorted(first, at, "right") - 1
        head = np.ones(len(at), bool)
        head[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(head)
        ka = k[at]
        letter = ka == _LETTER
        before_letter = np.append(letter[1:] & ~head[1:], False)
        begins = letter | (ka == _DIGIT) | (ka == _STAR) & before_letter
        ends = (ka != _AT) & (ka != _QUOTE)
        start = np.minimum.reduceat(np.where(begins, at, n), heads)
        end = np.maximum.reduceat(np.where(ends, at + 1, 0), heads)
        text = owner[heads]
        ok = start < end
        start, end, text = start[ok], end[ok], text[ok]
        # The characters of the trimmed words, runs kept once, hashed by their place.
        run = np.cumsum(head) - 1
        rs, re_ = np.full(len(heads), n), np.zeros(len(heads), np.int64)
        rs[ok], re_[ok] = start, end
        keep = (at >= rs[run]) & (at < re_[run])
        c, ck, who = small[safe[at[keep]]].astype(np.uint64), ka[keep], run[keep]
        new = np.ones(len(c), bool)
        new[1:] = who[1:] != who[:-1]
        once = new.copy()
        once[1:] |= c[1:] != c[:-1]
        heads2 = np.flatnonzero(new)
        if not len(heads2):
            z = np.zeros(0, np.int64)
            return Tokens(z, z, z, z, z, z, first)
        nth = np.cumsum(once)
        place = np.minimum(nth - np.repeat(nth[heads2], np.diff(np.append(heads2, len(c)))), 63)
        word = _mixed(np.add.reduceat(np.where(once, (c + np.uint64(77)) * _POWERS[place], np.uint64(0)), heads2)).view(np.int64).copy()
        kind = np.zeros(len(word), np.int64)
        leet = np.isin(c, np.array([ord(x) for x in "013457$@"], np.uint64))
        odd = np.logical_or.reduceat(ck == _STAR, heads2)
        odd |= np.logical_or.reduceat(leet, heads2) & np.logical_or.reduceat(ck == _LETTER, heads2) & ~np.logical_or.reduceat(np.isin(c, np.array([ord(x) for x in "2689"], np.uint64)), heads2) & (end - start >= 4)
        for i in np.flatnonzero(odd).tolist():
            lo = int(first[text[i]])
            key, kind[i] = plain[texts[text[i]][start[i] - lo : end[i] - lo]]
            word[i] = key_hash[self.starred[key] if kind[i] == 2 else key]
        marks = np.zeros(n + 1, np.int64)
        np.cumsum(np.isin(flat, _BREAKS), out=marks[1:])
        breaks = np.ones(len(word), bool)
        breaks[1:] = (marks[start[1:]] > marks[end[:-1]]) | (text[1:] != text[:-1])
        # Four or more single letters, one blank or stop between each two.
        one = (end - start == 1) & (k[start] == _LETTER)
        gap = np.zeros(len(word), bool)
        gap[1:] = one[1:] & one[:-1] & (start[1:] == end[:-1] + 1) & (text[1:] == text[:-1]) & np.isin(flat[np.minimum(end[:-1], n - 1)], np.array([32, 46], np.uint32))
        if gap.any():
            run_no = np.cumsum(~gap)
            size = np.bincount(run_no)[run_no]
            apart = size >= 4
            for i in np.flatnonzero(apart & ~gap).tolist():
                j = i + int(size[i])
                lo, t = int(first[text[i]]), texts[text[i]]
                word[i], kind[i] = key_hash[self.inside["".join(t[start[x] - lo] for x in range(i, j))]], 3
                end[i] = end[j - 1]
            stay = ~(apart & gap)
            word, kind, start, end, text, breaks = (x[stay] for x in (word, kind, start, end, text, breaks))
        return Tokens(word, kind, start, end, text, np.cumsum(breaks) - 1, first)


def feature_rows(t: Tokens, terms: np.ndarray) -> np.ndarray:
    """Hashed features of every token; ``terms`` are the sorted hashes of the listed terms' words."""
    w, kind, n = t.word, t.kind, len(t.word)
    term = np.isin(w, terms).astype(np.int64)
    pad, own = np.zeros(n + 4, np.int64), np.full(n + 4, -1, np.int64)
    pad[2 : n + 2], own[2 : n + 2] = w, t.sentence
    at = lambda d: np.where(own[2 + d : n + 2 + d] == t.sentence, pad[2 + d : n + 2 + d], 7)
    l1, l2, r1, r2 = at(-1), at(-2), at(1), at(2)
    f = np.stack([
        w * 3 + 1, w * 5 + l1 * 7 + 2, w * 11 + r1 * 13 + 3, l1 * 17 + l2 * 19 + w * 23 + 4, r1 * 29 + r2 * 31 + w * 37 + 5, l1 * 41 + w * 43 + r1 * 47 + 6,
        kind * 1009 + 7, kind * 1013 + l1 * 53 + 8, kind * 1019 + r1 * 59 + 9, term * 1021 + 10, term * 1031 + l1 * 61 + 11, term * 1033 + r1 * 67 + 12, l1 * 71 + r1 * 73 + 13,
    ], 1)
    return (f ^ (f >> 17)) & MASK


class Field:
    """The conditional random field: tag weights of features, and transition scores (from, to)."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights, trans

    def marginals(self, f: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability that each token is toxic; expected transitions (2, 2) of all sequences, summed."""
        s = self.weights[f].sum(1, dtype=np.float64) if len(f) else np.zeros(0)
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        starts, n = offsets[:-1][order], lengths[order]
        top = int(n[0]) if len(n) else 0
        total = len(s)
        alpha = np.zeros((total, 2))
        beta = np.zeros((total, 2))
        counts = [int(np.searchsorted(-n, -t, "left")) for t in range(top)]
        tr = self.trans
        for t in range(top):
            at = starts[: counts[t]] + t
            e = np.stack([np.zeros(len(at)), s[at]], 1)
            if t == 0:
                alpha[at] = e
            else:
                prev = alpha[at - 1]
                alpha[at] = e + np.logaddexp(prev[:, :1] + tr[0], prev[:, 1:] + tr[1])
        pair = np.zeros((2, 2))
        z = np.zeros(len(n))
        for t in range(top - 1, -1, -1):
            m = counts[t]
            at = starts[:m] + t
            last = n[:m] == t + 1
            z[:m][last] = np.logaddexp(alpha[at[last], 0], alpha[at[last], 1])
            if t + 1 < top:
                go = ~last
                a = at[go]
                nxt = beta[a + 1] + np.stack([np.zeros(len(a)), s[a + 1]], 1)
                beta[a] = np.logaddexp(tr[:, 0] + nxt[:, :1], tr[:, 1] + nxt[:, 1:])
                lp = alpha[a][:, :, None] + tr + nxt[:, None, :] - z[:m][go][:, None, None]
                pair += np.exp(lp).sum(0)
        zz = np.zeros(len(n))
        zz[order] = z
        own = np.repeat(np.arange(len(n)), lengths)
        p = np.exp(np.minimum(0, alpha[:, 1] + beta[:, 1] - zz[own])) if total else np.zeros(0)
        return p, pair


def train_field(f: np.ndarray, offsets: np.ndarray, tags: np.ndarray, rounds: int = 10, part: int = 2048) -> Field:
    """Maximum likelihood by adaptive gradients over parts of ``part`` sentences in a fixed random order."""
    w, trans = np.zeros(1 << BITS), np.zeros((2, 2))
    g2, t2 = np.full(1 << BITS, 0.1), np.full((2, 2), 1.0)
    rng = np.random.default_rng(5)
    lengths = np.diff(offsets)
    for _ in range(rounds):
        order = rng.permutation(len(lengths))
        for lo in range(0, len(order), part):
            chosen = np.sort(order[lo : lo + part])
            n = lengths[chosen]
            own = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(own[-1]) + np.repeat(offsets[:-1][chosen] - own[:-1], n)
            fp, y = f[at], tags[at]
            p, pair = Field(w, trans).marginals(fp, own)
            inner = np.ones(len(y), bool)
            inner[own[:-1][n > 0]] = False
            i = np.flatnonzero(inner)
            seen = np.bincount(2 * y[i - 1].astype(int) + y[i].astype(int), minlength=4).reshape(2, 2)
            g = np.bincount(fp.ravel(), np.repeat(y - p, fp.shape[1]), 1 << BITS) - 0.02 * len(chosen) / len(order) * w
            g2 += g * g
            w += 0.3 * g / np.sqrt(g2)
            gt = seen - pair
            t2 += gt * gt
            trans += 0.3 * gt / np.sqrt(t2)
    return Field(w, trans)


class Grams:
    """The sequences of one to three words within sentences, as hashes, with the places they begin at."""

    def __init__(self, t: Tokens):
        hashes, places, sizes = [], [], []
        for n in (1, 2, 3):
            m = max(0, len(t.word) - n + 1)
            h = t.word[:m].astype(np.uint64) + np.uint64(n)
            for k in range(1, n):
                h = _mixed(h) + t.word[k : m + k].astype(np.uint64)
            at = np.flatnonzero(t.sentence[:m] == t.sentence[n - 1 : m + n - 1])
            hashes.append(h[at].view(np.int64)), places.append(at), sizes.append(np.full(len(at), n))
        self.hash, self.place, self.size = (np.concatenate(x) for x in (hashes, places, sizes))


def toxic_grams(t: Tokens, y: np.ndarray, terms: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Sorted hashes of the word sequences of up to three words that make messages abusive; ``y`` by text.

    A sequence counts for an abusive message only while nothing better explains it: once some of its tokens are known
    to be toxic, the message's other words no longer gain from it.
    """
    g = Grams(t)
    values, ids = np.unique(g.hash, return_inverse=True)
    if not len(values):
        return values
    k = len(values)
    text, sentence = t.text[g.place], t.sentence[g.place]
    single = np.zeros(k, bool)
    single[ids[g.size == 1]] = True
    listed = np.zeros(k, bool)
    of_terms = (g.size == 1) & np.isin(t.word[g.place], terms)
    listed[ids[of_terms]] = True

    def weight(chosen: np.ndarray, by_text: np.ndarray) -> np.ndarray:
        """Sum over texts that hold a gram at a chosen place, each text once."""
        pair = np.unique(text[chosen] * np.int64(k) + ids[chosen])
        return np.bincount(pair % k, by_text[pair // k], k)

    bad = y > 0.5
    neg = weight(~bad[text], 1 - y)
    strong = listed & (neg < np.maximum(1.0, 0.2 * weight(bad[text], y)))
    for r in range(rounds):
        explained = np.zeros(int(t.sentence[-1]) + 1, bool)
        explained[sentence[strong[ids]]] = True
        has = np.zeros(len(y), bool)
        has[text[explained[sentence]]] = True
        pos = weight(bad[text] & (explained[sentence] | ~has[text]), y)
        strong = (pos >= (4, 3, 2.4)[min(r, 2)]) & (pos >= (9, 7, 6)[min(r, 2)] * (neg + 0.05 * single))
    return values[strong]


def covered(t: Tokens, grams: np.ndarray) -> np.ndarray:
    """1 for each token that lies in one of the grams."""
    g = Grams(t)
    hit = np.isin(g.hash, grams)
    tag = np.zeros(len(t.word) + 3)
    for k in range(3):
        tag[g.place[hit & (g.size > k)] + k] = 1
    return tag[: len(t.word)]


class Categories:
    """Naive Bayes over words and word pairs of toxic sentences."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, prior: np.ndarray):
        self.keys, self.weights, self.prior = keys, weights, prior

    @staticmethod
    def features(word: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = sentence[1:] == sentence[:-1]
        pairs = (_mixed(word[:-1].astype(np.uint64)) + word[1:].astype(np.uint64)).view(np.int64)[same]
        return np.concatenate([word, pairs]), np.concatenate([sentence, sentence[:-1][same]])

    def scores(self, word: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Log scores (n, category) of n sentences."""
        out = np.tile(self.prior, (n, 1))
        if len(word) and len(self.keys):
            f, own = self.features(word, sentence)
            i = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            hit = self.keys[i] == f
            for c in range(len(CATEGORIES)):
                out[:, c] += np.bincount(own[hit], self.weights[i[hit], c], n)
        return out


def learn_categories(word: np.ndarray, sentence: np.ndarray, known: np.ndarray, harmless: np.ndarray, terms: dict[int, int], rounds: int = 8) -> Categories:
    """``known``: the category of each sentence by its listed terms, or -1; those without get theirs by the model.

    ``harmless`` are the hashed words and pairs of sentences that aren't toxic: what is common there says little. A
    sentence in which nothing speaks for hate or sexual content attacks a person.
    """
    n, k = len(known), len(CATEGORIES)
    prior = np.log(np.array(CATEGORY_PRIOR))
    if not n or not len(word):
        return Categories(np.zeros(0, np.int64), np.zeros((0, k)), prior)
    f, own = Categories.features(word, sentence)
    listed = np.array(sorted(terms), np.int64)
    keys, ids = np.unique(np.concatenate([f, listed]), return_inverse=True)
    of_terms, ids = ids[len(f) :], ids[: len(f)]
    post = np.zeros((n, k))
    has = known >= 0
    post[np.flatnonzero(has), known[has]] = 1.0
    model = Categories(keys, np.zeros((len(keys), k)), prior)
    h, m = np.unique(harmless, return_counts=True)
    calm = np.zeros(len(keys))
    shared, a, b = np.intersect1d(keys, h, assume_unique=True, return_indices=True)
    calm[a] = m[b]
    specific = np.bincount(ids, minlength=len(keys))
    specific = (specific / np.maximum(1e-9, specific + 0.3 * calm))[:, None]
    for _ in range(rounds):
        counts = np.stack([np.bincount(ids, post[own, c], len(keys)) for c in range(k)], 1)
        total = counts.sum(0)
        # A pseudo-count by the categories' own sizes: words that say nothing weigh nothing, however sizes differ.
        share = (total + 1) / (total + 1).sum()
        weights = np.log((counts + 2 * share) / (total + 2)) - np.log((counts.sum(1, keepdims=True) + 2) / (total.sum() + 2))
        weights = weights * specific
        weights[of_terms, [terms[w] for w in listed.tolist()]] += TERM_NATS
        model = Categories(keys, weights, prior)
        s = model.scores(word, sentence, n)[~has]
        s = np.exp(s - s.max(1, keepdims=True))
        post[~has] = s / s.sum(1, keepdims=True)
    return model


class Detector:
    """All that scoring needs; small, and sent to the tasks as it is."""

    def __init__(self, known: set[str], terms: dict[str, int], field: Field, categories: Categories):
        self.known, self.terms, self.field, self.categories = known, terms, field, categories
        self.reader = Reader(known)
        self.term_hashes = np.array(sorted(key_hash[k] for k in terms), np.int64)

    def score(self, texts: list[str]) -> list[tuple[float, str, list[tuple[int, int]]]]:
        """(score, category, spans) of each text: the probability that some sentence is toxic, taking sentences as
        independent, the category of the toxic sentences, and the spans of toxic tokens of all sentences."""
        t = self.reader(texts)
        out: list[tuple[float, str, list[tuple[int, int]]]] = [(0.0, "", [])] * len(texts)
        if not len(t.word):
            return out
        offsets = t.bounds()
        p, _ = self.field.marginals(feature_rows(t, self.term_hashes), offsets)
        top = np.maximum.reduceat(p, offsets[:-1])
        own = t.text[offsets[:-1]]
        score = 1 - np.exp(np.bincount(own, np.log1p(-np.minimum(top, 1 - 1e-9)), len(texts)))
        hot = top >= TOXIC
        for i in np.flatnonzero(score > 0).tolist():
            out[i] = (float(score[i]), "", [])
        if not hot.any():
            return out
        inside = hot[t.sentence]
        number = np.cumsum(hot) - 1
        s = self.categories.scores(t.word[inside], number[t.sentence[inside]], int(hot.sum())) * top[hot][:, None]
        votes = np.stack([np.bincount(own[hot], s[:, c], len(texts)) for c in range(len(CATEGORIES))], 1).argmax(1)
        toxic = inside & (p >= np.maximum(TOXIC, 0.5 * top[t.sentence]))
        spans: dict[int, list[tuple[int, int]]] = {}
        last = -2
        for i in np.flatnonzero(toxic).tolist():
            k = int(t.text[i])
            a, b = int(t.start[i] - t.first[k]), int(t.end[i] - t.first[k])
            have = spans.setdefault(k, [])
            if last == i - 1 and have and t.sentence[i] == t.sentence[i - 1]:
                have[-1] = (have[-1][0], b)
            else:
                have.append((a, b))
            last = i
        for k, have in spans.items():
            out[k] = (out[k][0], CATEGORIES[votes[k]], have)
        return out


def fit(judged: list[tuple[str, float]], terms: list[tuple[str, str]]) -> Detector:
    """``judged``: texts with the probability, by their votes, that they are abusive; ``terms``: (term, category)."""
    term_words: dict[str, int] = {}
    for term, cat in sorted(terms):
        words = [_plain(w)[0] for w in term.split()]
        for w in words if len(words) == 1 else [*words, "".join(words)]:
            term_words.setdefault(_RUN.sub(r"\1", w), CATEGORIES.index(cat))
    by_hash = {key_hash[k]: c for k, c in term_words.items()}
    listed = np.array(sorted(by_hash), np.int64)
    texts, y = [t for t, _ in judged], np.array([v for _, v in judged])
    t = Reader(set(term_words))(texts)
    if not len(t.word):
        return Detector(set(term_words), term_words, Field(np.full(1 << BITS, -1.0), np.zeros((2, 2))), learn_categories(t.word, t.sentence, np.zeros(0, np.int64), t.word, {}))
    strong = toxic_grams(t, y, listed)
    # Words that were learned may be disguised elsewhere.
    single = np.flatnonzero(np.isin((t.word.astype(np.uint64) + np.uint64(1)).view(np.int64), strong))
    known = set(term_words)
    for i in single[np.unique(t.word[single], return_index=True)[1]].tolist():
        lo = int(t.first[t.text[i]])
        key = _plain(texts[t.text[i]][t.start[i] - lo : t.end[i] - lo])[0]
        if len(key) > 3 and key_hash[key] == t.word[i]:
            known.add(key)
    t = Reader(known)(texts)
    strong = toxic_grams(t, y, listed)
    tag = covered(t, strong)
    bad = y[t.text] > 0.5
    long = np.isin(t.kind, (1, 2, 3))
    tag[bad & long] = 1
    sentences = int(t.sentence[-1]) + 1
    per_sentence = np.bincount(t.sentence, tag, sentences)
    own = np.zeros(sentences, np.int64)
    own[t.sentence] = t.text
    explained = np.bincount(own, per_sentence, len(texts)) > 0
    # Where nothing tells what in an abusive message is so, the judgement is most likely wrong: it is left out. The same
    # goes for sentences of a harmless message that are abusive wherever else they are met.
    keep = np.where(y[own] > 0.5, explained[own], per_sentence <= 1)[t.sentence]
    tag[~bad] = 0
    part = Tokens(t.word[keep], t.kind[keep], t.start[keep], t.end[keep], t.text[keep], np.unique(t.sentence[keep], return_inverse=True)[1], t.first)
    tag = tag[keep]
    field = train_field(feature_rows(part, listed), part.bounds(), tag) if tag.any() else Field(np.full(1 << BITS, -1.0), np.zeros((2, 2)))
    toxic = np.bincount(part.sentence, tag) > 0 if len(part.sentence) else np.zeros(0, bool)
    at = np.flatnonzero(toxic[part.sentence])
    number = (np.cumsum(toxic) - 1)[part.sentence[at]]
    cats = np.array([by_hash.get(w, -1) for w in part.word[at].tolist()], np.int64)
    seen = np.zeros((int(toxic.sum()), len(CATEGORIES)), bool)
    named = (cats >= 0) & (tag[at] > 0)
    seen[number[named], cats[named]] = True
    which = np.where(seen.sum(1) == 1, seen.argmax(1), -1)
    calm = ~toxic[part.sentence]
    harmless, _ = Categories.features(part.word[calm], part.sentence[calm])
    return Detector(known, term_words, field, learn_categories(part.word[at], number, which, harmless, by_hash))


def training(messages: DataFrame, labels: DataFrame, most: int = TRAINING) -> list[tuple[str, float]]:
    """At most ``most`` judged texts with the probability, by the votes, that they are abusive; smallest hashes of the id."""
    ones, zeros = F.sum(F.col("abusive").cast("int")), F.sum(1 - F.col("abusive").cast("int"))
    # A message has few judgements, so as many times fewer messages than judgements lie below the bound.
    near = F.xxhash64("msg_id") <= F.lit(hash_bound(most, labels.count(), 12.0))
    votes = labels.where("abusive in (0, 1) and msg_id is not null").where(near).groupBy("msg_id").agg(ones.alias("a"), zeros.alias("b"))
    odds = F.lit(PRIOR / (1 - PRIOR)) * F.pow(F.lit((1 - ERROR) / ERROR), F.col("a") - F.col("b"))
    votes = votes.select("msg_id", (odds / (1 + odds)).alias("y"))
    votes = votes.orderBy(F.xxhash64("msg_id"), "msg_id").limit(most)
    rows = messages.select("msg_id", "text_orig").where("text_orig is not null").join(votes, "msg_id").groupBy("msg_id").agg(F.min("text_orig"), F.min("y")).orderBy("msg_id").collect()
    return [(r[1], float(r[2])) for r in rows]


def places_in(original: str, changed: str, look: int = 48) -> list[tuple[int, int]]:
    """For each place of ``changed`` the span of ``original`` that it came from.

    Changes are local, so the texts are walked together; where they differ, the nearest place at which both go on alike
    is sought within ``look`` characters, and what can't be matched belongs to the change as a whole.
    """
    out, i, j = [], 0, 0
    while j < len(changed):
        if i < len(original) and original[i] == changed[j]:
            out.append((i, i + 1))
            i, j = i + 1, j + 1
            continue
        step = None
        for d in range(1, 2 * look):
            for x in range(max(0, d - look), min(d, look) + 1):
                y = d - x
                a, b = original[i + x : i + x + 3], changed[j + y : j + y + 3]
                if a == b and (len(a) == 3 or i + x + len(a) >= len(original) and j + y + len(b) >= len(changed)):
                    step = (x, y)
                    break
            if step:
                break
        x, y = step or (len(original) - i, len(changed) - j)
        out += [(i, max(i + x, i))] * y
        i, j = i + x, j + y
    return out


def scored(messages: DataFrame, labels: DataFrame, terms: DataFrame, lexicon: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(msg_id, channel, score, category, spans) of each message row with text; ``category`` is empty and there are no
    spans where nothing is near toxic. ``spans`` are all the offending ones, with ``start_pos`` and ``end_pos`` in code
    points of the text as delivered. Null texts are dropped, blank ones score 0. Repeated rows give repeated rows.
    """
    model = clean_characters(messages.selectExpr("text_orig text"))
    words = lookalikes.vocabulary(lexicon, gazetteer)
    trie = lookalikes.Trie(words)
    judged = [(lookalikes.consistent(repaired(t, model), trie), y) for t, y in training(messages, labels)]
    listed = [(r[0], r[1]) for r in bounded(terms.select("term", "category").where("term is not null and category is not null"), 100_000, "abuse_term")]
    d = fit(judged, listed)
    sent = messages.sparkSession.sparkContext.broadcast((d.known, d.terms, d.field.weights.astype(np.float32), d.field.trans, d.categories, model.counts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own_terms, w, trans, categories, counts, vocabulary = sent.value
        own = Detector(known, own_terms, Field(w, trans), categories)
        chars, own_trie = CharModel(counts), lookalikes.Trie(vocabulary)
        kind = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32())]))
        for batch in batches:
            texts, before = batch.column("text").to_pylist(), {}
            for k, odd in enumerate(batch.column("odd").to_pylist()):
                if odd:
                    fixed = lookalikes.consistent(repaired(texts[k], chars), own_trie)
                    if fixed != texts[k]:
                        before[k], texts[k] = texts[k], fixed
            scores, cats, spans = [], [], []
            for lo in range(0, len(texts), 4096):
                for k, (score, cat, found) in enumerate(own.score(texts[lo : lo + 4096]), lo):
                    if found and k in before:
                        at = places_in(before[k], texts[k])
                        found = [(at[a][0], max(at[b - 1][1], at[a][0] + 1)) for a, b in found]
                    scores.append(score), cats.append(cat), spans.append([{"start_pos": a, "end_pos": b} for a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column("msg_id"), batch.column("channel"), pa.array(scores, pa.float64()), pa.array(cats, pa.string()), pa.array(spans, kind)], names=["msg_id", "channel", "score", "category", "spans"])

    t = F.col("text")
    odd = t.rlike("[^\\x00-\\x7F]") & (suspicious(t) | t.rlike("[\\x{AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}\\x{FF10}-\\x{FF5A}\\x{FB00}-\\x{FB06}\\x{212A}\\x{300}-\\x{36F}\\x{1D400}-\\x{1D7FF}\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]|[a-zA-Z][\\x{370}-\\x{52F}]|[\\x{370}-\\x{52F}][a-zA-Z]"))
    rows = messages.selectExpr("msg_id", "channel", "text_orig text").where("text is not null").select("msg_id", "channel", "text", odd.alias("odd"))
    return rows.mapInArrow(run, "msg_id bigint, channel string, score double, category string, spans array<struct<start_pos:int,end_pos:int>>")


def found(s: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(msg_id, category) of each message that scores ``threshold`` or more; each message once."""
    return s.where(F.col("score") >= threshold).select("msg_id", "category").dropDuplicates(["msg_id"])


def rates(s: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(channel, n_messages, n_found, rate) over distinct messages; a null channel is its own group."""
    one = s.groupBy("msg_id", "channel").agg(F.max("score").alias("score"))
    hit = F.sum((F.col("score") >= threshold).cast("bigint"))
    return one.groupBy("channel").agg(F.count(F.lit(1)).alias("n_messages"), hit.alias("n_found"), (hit / F.count(F.lit(1))).alias("rate"))
