"""Problem 9: passages of held-out test items inside the documents of a corpus.

Documents and items are reduced to streams of folded letters: no case, accents, blanks or punctuation, a run of one
letter kept once, so that form and flooding don't matter. Every position of a document whose q-gram occurs in an item
gives a hit on a diagonal (document position less item position). Hits are counted in overlapping bands of diagonals
and, along the document, within the length of a passage; by the q-gram lemma a passage of n letters with at most e
edits shares at least n + 1 - q (e + 1) q-grams with its item, so only regions with as many hits are kept, the bound
being computed for the shortest passage of each item and the edit budget that the last test allows. A region is
verified by a banded alignment of words.

The items are sent to the tasks in blocks of a bounded number of letters, and within a task searched in parts, which
bounds the hits that are held at a time.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, code_points

Q = 5
#: Words of an item that a passage must span, and how many of them must be there; a word with spelling noise counts NOISY.
LEAST_WORDS, LEAST_EQUAL, NOISY = 12, 9, 0.8
LEAST_SHARE = LEAST_EQUAL / LEAST_WORDS
#: Edits of a passage, in places where the streams differ: noise in every word, or in fewer if some are changed.
EDITS = 8
#: Width of a band of diagonals, in letters; bands overlap by half of it, which is more than the edits can shift.
BAND = 32
#: Hits that a region must have whatever the bound says: three by chance are rare.
LEAST_SHARED = 3
#: Words by which the aligned parts are widened and the band of the alignment reaches to each side.
MARGIN = 10
#: Letters of items that are sent to the tasks at once, and that are searched at once.
BLOCK_LETTERS, PART_LETTERS = 4_000_000, 400_000


def _fold_table() -> np.ndarray:
    """For each code point below 0x30000 its folded letter, or 0; look-alikes of Latin letters fold to them."""
    t = np.zeros(0x30000, np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        if not ch.isalnum():
            continue
        base = unicodedata.normalize("NFKD", ch).casefold()
        t[c] = next((ord(b) for b in base if b.isalnum()), 0)
    from .lookalikes import LOOKALIKES

    for a, b in LOOKALIKES.items():
        t[ord(a)] = ord(b.lower())
    return t


_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_fold_table())
    return _FOLD[0]


def letter_stream(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded letters of all texts, runs kept once; the text each belongs to; its place in ``flat``."""
    folded = fold_table()[np.minimum(flat, 0x2FFFF)]
    at = np.flatnonzero(folded)
    letters = folded[at]
    owner = np.searchsorted(offsets, at, "right") - 1
    keep = np.ones(len(at), bool)
    keep[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    return letters[keep], owner[keep], at[keep]


def gram_hashes(letters: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the q-gram at each position, and whether it lies within one text."""
    n = max(0, len(letters) - Q + 1)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += letters[k : k + n].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h, owner[:n] == owner[Q - 1 : Q - 1 + n]


class GramIndex:
    """All q-grams of some items: sorted hashes with item and place, behind a bitmap that drops most misses."""

    def __init__(self, texts: list[str]):
        flat, offsets = code_points(texts)
        letters, owner, _ = letter_stream(flat, offsets)
        first = np.searchsorted(owner, np.arange(len(texts)))
        h, valid = gram_hashes(letters, owner)
        where = np.flatnonzero(valid)
        order = np.argsort(h[where], kind="stable")
        self.hash = h[where][order]
        self.item = owner[where][order]
        self.place = where[order] - first[self.item]
        # Sixteen bits a q-gram at least, so that few others pass.
        self.bits = max(20, int(np.ceil(np.log2(16 * len(where) + 1))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.hash >> np.uint64(64 - self.bits)] = True
        self.words = [fold_words(t) for t in texts]
        self.word_ends = [np.cumsum([len(w) for w in ws]) for ws in self.words]
        sizes = [passage_letters(ends) for ends in self.word_ends]
        self.shortest, self.longest = (np.array(x, np.int64) for x in zip(*sizes)) if sizes else (np.zeros(0, np.int64),) * 2
        self.least = np.maximum(LEAST_SHARED, self.shortest + 1 - Q * (EDITS + 1))

    def hits(self, h: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in the documents' letters, entry of the index) of equal q-grams."""
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - self.bits)] & valid)
        lo = np.searchsorted(self.hash, h[at], "left")
        n = np.searchsorted(self.hash, h[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return at, lo
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        return np.repeat(at, n), entry


def passage_letters(ends: np.ndarray) -> tuple[int, int]:
    """Letters of the shortest and the longest run of LEAST_WORDS words of an item, or of the whole item."""
    ends = np.concatenate([[0], ends])
    n = min(LEAST_WORDS, len(ends) - 1)
    sizes = ends[n:] - ends[: len(ends) - n]
    return int(sizes.min()), int(sizes.max())


class _Folded(dict):
    """Folded letter of a code point, a blank for all else."""

    def __missing__(self, c: int) -> str:
        f = fold_table()[c] if c < 0x30000 else 0
        self[c] = out = chr(f) if f else " "
        return out


_FOLDED = _Folded()
_RUN = re.compile(r"(\S)\1+")


def fold_words(text: str) -> list[str]:
    """Words as folded letters, runs kept once."""
    return _RUN.sub(r"\1", unicodedata.normalize("NFC", text).translate(_FOLDED)).split()


def near(a: str, b: str) -> bool:
    """Equal up to spelling noise: one letter dropped, doubled, changed or swapped in a word of four letters or more."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    return ra[1:] == rb[1:] or ra[1:] == rb or ra == rb[1:] or (ra[2:] == rb[2:] and ra[:2] == rb[:2][::-1])


def neighbours(word: str) -> set[str]:
    """A word and, from four letters on, what is left of it without one letter: words that are near share one of these."""
    return {word} if len(word) < 3 else {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


folded = Memo(fold_words, 2_000)
near_keys = Memo(neighbours, 100_000)


def could_hold(item: list[str], part: list[str]) -> bool:
    """Whether the part has a near word for enough of some LEAST_WORDS words of the item in a row.

    An alignment that spans more words than that, with its equal words as far apart as they can be, has one fewer than
    LEAST_EQUAL in its best window, so no passage is lost.
    """
    have: set[str] = set()
    for w in set(part):
        have |= near_keys[w]
    total = np.cumsum([0, *(not near_keys[w].isdisjoint(have) for w in item)])
    n = min(LEAST_WORDS, len(item))
    return int((total[n:] - total[: len(total) - n]).max()) >= LEAST_EQUAL - 1


def holds(item: list[str], part: list[str], band: int) -> bool:
    """Whether a local alignment of words within ``band`` words of the corners spans a passage of the item.

    Gain 1 for a word that is the same up to spelling noise, -1 for one changed, dropped or put in, so that a passage isn't
    drawn out into text that shares less than half of its words with the item. Only pairs of equal words are visited: what
    lies between two of them costs the larger number of words skipped. Each pair holds its best alignment; the first one
    that spans enough words with enough of them equal will do.
    """
    reach = band + max(0, len(part) - len(item))
    alike: dict[str, set[int]] = {}
    for j, b in enumerate(part):
        for k in near_keys[b]:
            alike.setdefault(k, set()).add(j)
    ends: list[tuple[int, int, int, int, float]] = []
    most = 0
    for i, a in enumerate(item):
        row = []
        for j in sorted({j for k in near_keys[a] for j in alike.get(k, ()) if i - band <= j <= i + reach and (part[j] == a or near(a, part[j]))}):
            worth = 1.0 if part[j] == a else NOISY
            best = (1, 1, worth)
            for p, q, s, span, n in reversed(ends):
                if i - p - 1 > most:
                    break
                if q < j:
                    s -= max(i - p, j - q) - 1
                    if s >= 0 and (s + 1, span + i - p, n + worth) > best:
                        best = (s + 1, span + i - p, n + worth)
            s, span, n = best
            if span >= LEAST_WORDS - 1 and n > LEAST_EQUAL - 1e-9 and n > LEAST_SHARE * span - 1e-9:
                return True
            most = max(most, s)
            row.append((i, j, *best))
        ends += row
    return False


def passages(texts: list[str], index: GramIndex) -> list[tuple[int, int]]:
    """Pairs (text, item) whose text holds a passage of the item."""
    flat, offsets = code_points(texts)
    letters, owner, place = letter_stream(flat, offsets)
    h, valid = gram_hashes(letters, owner)
    at, entry = index.hits(h, valid)
    if not len(at):
        return []
    item, diagonal = index.item[entry], at - index.place[entry]
    # Bands of diagonals, each position in two of them; hits of one text, item and band in the order of the text.
    span = len(letters) + int(index.place.max()) + 1
    bands = span // BAND * 2 + 4
    shifted = diagonal + int(index.place.max())
    own = owner[at].astype(np.int64) * len(index.words) + item
    key = np.concatenate([own * bands + shifted // BAND * 2, own * bands + (shifted + BAND // 2) // BAND * 2 + 1])
    at2, place2, item2 = np.concatenate([at, at]), np.concatenate([index.place[entry]] * 2), np.concatenate([item, item])
    order = np.argsort(key, kind="stable")
    key, at2, place2, item2 = key[order], at2[order], place2[order], item2[order]
    # As many hits as the item needs within the length of its longest passage.
    last = np.arange(len(key)) + index.least[item2] - 1
    ok = np.flatnonzero(last < len(key))
    ok = ok[key[last[ok]] == key[ok]]
    ok = ok[at2[last[ok]] - at2[ok] <= index.longest[item2[ok]] + EDITS]
    if not len(ok):
        return []
    # Windows of one text and item that are close to each other make one region.
    pair, lo, hi = owner[at2[ok]].astype(np.int64) * len(index.words) + item2[ok], at2[ok], at2[last[ok]]
    first, final = np.minimum(place2[ok], place2[last[ok]]) - BAND, np.maximum(place2[ok], place2[last[ok]]) + BAND
    order = np.lexsort((lo, pair))
    pair, lo, hi, first, final = pair[order], lo[order], hi[order], first[order], final[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (lo[1:] > lo[:-1] + int(index.longest.max()) + 2 * BAND)
    starts = np.flatnonzero(new)
    regions = zip((pair[starts] // len(index.words)).tolist(), (pair[starts] % len(index.words)).tolist(), lo[starts].tolist(), np.maximum.reduceat(hi, starts).tolist(), np.minimum.reduceat(first, starts).tolist(), np.maximum.reduceat(final, starts).tolist())
    out: set[tuple[int, int]] = set()
    for d, i, lo_, hi_, first_, final_ in regions:
        if (d, i) in out:
            continue
        # The region and its part of the item, both widened.
        end = min(hi_ + Q, len(place) - 1)
        a = max(0, int(place[lo_]) - 8 * MARGIN - int(offsets[d]))
        b = int(place[end]) + 8 * MARGIN - int(offsets[d]) if int(owner[end]) == d else None
        part = folded[texts[d][a:b]]
        ends = index.word_ends[i]
        words = index.words[i][max(0, int(np.searchsorted(ends, first_)) - MARGIN) : int(np.searchsorted(ends, final_ + Q)) + MARGIN]
        if could_hold(words, part) and holds(words, part, 2 * MARGIN):
            out.add((d, i))
    return sorted(out)


#: The index of the last items that a Python worker was sent.
_LAST: dict[str, list[GramIndex]] = {}


def _indexes(name: str, texts: list[str]) -> list[tuple[int, GramIndex]]:
    """(number of the first item, index) of each part of the items; made once in each worker."""
    if name not in _LAST:
        parts, size = [[0, 0]], 0
        for i, t in enumerate(texts):
            if size + len(t) > PART_LETTERS and i > parts[-1][0]:
                parts.append([i, i])
                size = 0
            parts[-1][1], size = i + 1, size + len(t)
        _LAST.clear()
        _LAST[name] = [(lo, GramIndex(texts[lo:hi])) for lo, hi in parts]
    return _LAST[name]


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(doc_id, item_id): each document with each item of which it holds a passage of twelve words or more.

    Null and empty texts hold none; repeated documents give repeated checks but one pair. The items are sent to the
    tasks in blocks of at most ``block_letters`` characters, so what is sent at once is bounded whatever the items are:
    documents are scanned once per block.
    """
    spark = docs.sparkSession
    slim = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").where("doc_id is not null and text is not null")

    def searched(block: list[tuple[int, str]]) -> DataFrame:
        name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = [i for i, _ in sent.value]
            indexes = _indexes(name, [t for _, t in sent.value])
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                texts = batch.column(1).to_pylist()
                pairs, lo = [], 0
                while lo < len(texts):
                    hi, size = lo, 0
                    while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= PART_LETTERS):
                        hi, size = hi + 1, size + len(texts[hi])
                    for first, index in indexes:
                        pairs += [(lo + d, first + i) for d, i in passages(texts[lo:hi], index)]
                    lo = hi
                yield pa.RecordBatch.from_arrays([pa.array([doc_ids[d] for d, _ in pairs], pa.int64()), pa.array([ids[i] for _, i in pairs], pa.int64())], names=["doc_id", "item_id"])

        return slim.mapInArrow(run, "doc_id bigint, item_id bigint")

    found, block, size = None, [], 0
    for r in items.select(item_id, item_text).where(f"`{item_text}` is not null").toLocalIterator():
        if size + len(r[1]) > block_letters and block:
            found = searched(block) if found is None else found.unionByName(searched(block))
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    found = searched(block) if found is None else found.unionByName(searched(block))
    return found.distinct()
