"""Problem 2: the language of each text and of each segment of a text that changes language.

Labelled text of each language is made into a suffix automaton. A text is parsed against each automaton into longest
matches; the language that needs the fewest phrases fits best. A letter that a language's alphabet lacks is a phrase of
its own that costs an escape besides. Phrases are counted per word, so that one run of the automata also tells where a
text changes language: the cheapest sequence of languages over the words is found by dynamic programming, changes being
cheap between sentences and dear where no mark ends one. The automata run over all texts of a batch at once, one
character of each text at a time, each over the texts that have letters of its alphabet.

Labels are partly wrong: after a first fit, training sentences that another language explains clearly better are
dropped, and the automata are built again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookalikes
from .common import code_points, hash_bound
from .mojibake import CharModel, clean_characters, repaired, suspicious
from .sentences import _SMILEY

LANGUAGES = ["en", "nl", "de", "fr", "es", "ru", "zh", "ja", "ar", "hi", "th"]
LATIN = LANGUAGES[:5]
#: How labels name the languages, besides an optional region behind - or _.
NOTATIONS = {
    "en": "en eng english", "nl": "nl nld dut dutch nederlands", "de": "de deu ger german deutsch", "fr": "fr fra fre french français",
    "es": "es spa spanish español", "ru": "ru rus russian русский", "zh": "zh zho chi chinese cmn 中文", "ja": "ja jpn japanese 日本語",
    "ar": "ar ara arabic العربية", "hi": "hi hin hindi हिन्दी", "th": "th tha thai ไทย", "und": "und",
}
BY_NOTATION = {n: lang for lang, names in NOTATIONS.items() for n in names.split()}
#: Labelled messages of each language that the automata are built from at most: those with the smallest hashes.
TRAINING = 1_200
#: A training sentence is dropped if another language needs less than this share of the phrases of its own.
CLEARLY = 0.8
#: Cost, in phrases, of a change of language after a sentence mark, and of one where no mark ends a sentence.
CHANGE, CHANGE_WITHIN = 2.0, 6.0
#: What a letter outside of a language's alphabet costs besides the phrase that it is.
ESCAPE = 0.5
#: Phrases that one word can speak against a language at most, so that a name doesn't change it, and a run of letters
#: without blanks, which is more than a word.
CLIP, CLIP_RUN = 3.0, 8.0
#: What must be gone before parsing: links, handles, tags, addresses, line breaks, smileys.
_noise = re.compile(r"https?:/\S+|www\.\S+|\S+@\S+\.\S+|[@#＠＃]\w+|(?i:<LINEBREAK>)|(?<!\w)" + _SMILEY)

_LATIN_LETTERS = " 'abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
_BREAK, _SPACE, _DIGIT, _OTHER = 60, 0, 61, 62
#: Kinds of other scripts, coded from 64 on: the languages that use them.
_SCRIPTS = [("ru", [(0x400, 0x52F)]), ("zh", [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2FFFF), (0xF900, 0xFAFF)]), ("ja", [(0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]), ("ar", [(0x620, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)]), ("hi", [(0x900, 0x963), (0x971, 0x97F)]), ("th", [(0xE01, 0xE3A), (0xE40, 0xE4E)])]
#: Kinds of letters in each language's alphabet; those of 64 and above are scripts, 1 stands for the Latin letters.
ALPHABETS = {**{lang: [1] for lang in LATIN}, "ru": [64], "zh": [65], "ja": [65, 66], "ar": [67], "hi": [68], "th": [69]}
_UNSPACED = (65, 66, 69)
#: Symbols of the automata: Latin codes as they are, other letters by their code point, rare ideographs folded below this.
_SYMBOLS = 0xA000
_tables: list[np.ndarray] = []


def codes() -> np.ndarray:
    """Code of each code point: 0 a blank, 1..59 a Latin letter, 60 a sentence mark, 61 a digit, 62 other, 64+ a script."""
    if not _tables:
        t = np.full(0x110000, _OTHER, np.uint8)
        for i, c in enumerate(_LATIN_LETTERS):
            t[ord(c)] = i
            if len(c.upper()) == 1 and c != " ":
                t[ord(c.upper())] = i
        for c in " \t\n\r 　":
            t[ord(c)] = _SPACE
        t[ord("’")] = t[ord("`")] = _LATIN_LETTERS.index("'")
        for c in ".!?…。！？｡．؟।॥۔•\n":
            t[ord(c)] = _BREAK
        t[0x1F300:0x1FB00] = t[0x2600:0x27C0] = _BREAK
        t[ord("0") : ord("9") + 1] = _DIGIT
        for k, (_, ranges) in enumerate(_SCRIPTS):
            for lo, hi in ranges:
                t[lo : hi + 1] = 64 + k
        t[0x60C] = t[0x61B] = t[0x640] = _OTHER
        _tables.append(t)
    return _tables[0]


class Automaton:
    """Suffix automaton of a sequence of symbols, its transitions packed into one array of slots.

    The transition of state s by c is in slot ``base[s] + c`` if ``check`` names s there. Most states have one
    transition, so there are hardly more slots than transitions, and a lookup is a few array reads.
    """

    def __init__(self, text: np.ndarray):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text.tolist():
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self._pack(nxt)

    def _pack(self, edges: list[dict[int, int]]) -> None:
        """States with several transitions are laid out one after another where they fit, the others fill the holes."""
        total = sum(map(len, edges))
        used = bytearray(2 * _SYMBOLS + 3 * total + 4096)
        base = np.zeros(len(edges), np.int32)
        slots, states, targets = [], [], []

        def place(s: int, at: int, first: int) -> None:
            base[s] = at - first
            for c, t in edges[s].items():
                used[at + c - first] = 1
                slots.append(at + c - first), states.append(s), targets.append(t)

        at = _SYMBOLS
        several = [s for s, out in enumerate(edges) if len(out) > 1]
        for s in sorted(several, key=lambda s: -len(edges[s])):
            first, *others = sorted(edges[s])
            at = used.index(0, at)
            while any(map(used.__getitem__, [at + c - first for c in others])):
                at = used.index(0, at + 1)
            place(s, at, first)
            if at + _SYMBOLS + 4096 > len(used):
                used.extend(bytes(len(used)))
        free = _SYMBOLS
        for s, out in enumerate(edges):
            if len(out) == 1:
                free = used.index(0, free)
                place(s, free, next(iter(out)))
                if free + 2 > len(used):
                    used.extend(bytes(len(used)))
        size = max(slots, default=0) + _SYMBOLS + 1
        self.base, self.check, self.target = base, np.full(size, -1, np.int32), np.zeros(size, np.int32)
        self.check[slots], self.target[slots] = states, targets


def prepared(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, runs of three or more letters kept once, with offsets and code points."""
    flat, offsets = code_points([t.lower() for t in texts])
    c = codes()[flat]
    same = np.zeros(len(flat), bool)
    same[1:] = (flat[1:] == flat[:-1]) & (c[1:] > 0) & (c[1:] < _BREAK)
    run3 = np.zeros(len(flat), bool)
    run3[2:] = same[2:] & same[1:-1]
    drop = same & (run3 | np.append(run3[1:], False))
    blank = c == _SPACE
    drop[1:] |= blank[1:] & blank[:-1]
    # A stop before a digit is no sentence mark.
    point = (c == _BREAK) & (flat == ord("."))
    c = np.where(point & np.append(c[1:] == _DIGIT, False), _OTHER, c)
    starts = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(~drop, out=starts[1:])
    return c[~drop], starts[offsets], flat[~drop]


def symbols(c: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Symbols of prepared characters; what is no letter or blank has none that matters."""
    wide = np.where(flat < _SYMBOLS, flat, 0x4E00 + flat % 0x5000).astype(np.int32)
    return np.where(c < _BREAK, c, np.where(c >= 64, wide, 0))


class Parser:
    """The automata of all languages; counts the phrases that each needs."""

    def __init__(self, automata: dict[str, Automaton]):
        self.automata = automata

    def _starts(self, languages: list[str], symbol: np.ndarray, known: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """For each of languages with one alphabet, and each character, whether a new phrase starts there; ``known`` are
        the blanks and letters of the alphabet, ``chosen`` the texts to parse."""
        own = [self.automata[x] for x in languages]
        states = np.concatenate([[0], np.cumsum([len(a.base) for a in own])]).astype(np.int64)
        slots = np.concatenate([[0], np.cumsum([len(a.check) for a in own])]).astype(np.int64)
        base = np.concatenate([a.base + k for a, k in zip(own, slots)])
        check = np.concatenate([np.where(a.check >= 0, a.check + k, -1) for a, k in zip(own, states)]).astype(np.int32)
        target = np.concatenate([a.target + k for a, k in zip(own, states)]).astype(np.int32)
        root = states[:-1, None]
        lengths = np.diff(offsets)[chosen]
        order = chosen[np.argsort(-lengths, kind="stable")]
        starts, lens = offsets[:-1][order], np.diff(offsets)[order]
        out = np.zeros((len(own), len(symbol)), bool)
        state = np.repeat(root, len(order), 1)
        active = len(order)
        for t in range(int(lens[0]) if len(lens) else 0):
            while active and lens[active - 1] <= t:
                active -= 1
            at = starts[:active] + t
            c, ok = symbol[at], known[at]
            s = state[:, :active]
            slot = base[s] + c
            hit = (check[slot] == s) & ok
            slot0 = base[root] + c
            fresh = np.where((check[slot0] == root) & ok, target[slot0], root)
            out[:, at] = ~hit & ok
            state[:, :active] = np.where(hit, target[slot], fresh)
        return out

    def word_costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text of each word, cost of each word in each language, whether a sentence mark precedes it, its letters)."""
        c, offsets, flat = prepared(texts)
        letter = ((c > 0) & (c < _BREAK)) | (c >= 64)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        script = np.where(c >= 64, c, np.where(letter, 1, 0))
        first = letter.copy()
        han = (script >= 65) & (script <= 66)
        first[1:] &= ~letter[:-1] | (owner[1:] != owner[:-1]) | (script[1:] != script[:-1]) & ~(han[1:] & han[:-1])
        heads = np.flatnonzero(first)
        if not len(heads):
            z = np.zeros(0, np.int64)
            return z, np.zeros((0, len(LANGUAGES))), z.astype(bool), z
        # A word owns the places from its first letter to the next word's, but for the blank before that.
        size = np.add.reduceat(letter.astype(np.int64), heads)
        symbol = symbols(c, flat)
        before = np.maximum(heads - 1, 0)
        blank = (heads > 0) & (c[before] == _SPACE) & (owner[before] == owner[heads])
        cost = np.empty((len(heads), len(LANGUAGES)))
        groups: dict[tuple[int, ...], list[str]] = {}
        for lang in LANGUAGES:
            groups.setdefault(tuple(ALPHABETS[lang]), []).append(lang)
        for alphabet, languages in groups.items():
            own = np.isin(script, alphabet)
            foreign = np.add.reduceat((letter & ~own) * (1 + ESCAPE), heads)
            chosen = np.flatnonzero(np.bincount(owner[own], minlength=len(texts)))
            starts = self._starts(languages, symbol, own | (c == _SPACE), offsets, chosen)
            for k, lang in enumerate(languages):
                # A phrase that starts with the blank before a word counts for the word.
                n = np.add.reduceat((starts[k] & own).astype(np.int32), heads)
                cost[:, LANGUAGES.index(lang)] = foreign + n + (blank & starts[k][before])
        clip = np.where(np.isin(script[heads], _UNSPACED), CLIP_RUN, CLIP)
        cost = np.minimum(cost, (cost.min(1) + clip)[:, None])
        marks = np.zeros(len(c) + 1, np.int64)
        np.cumsum(c == _BREAK, out=marks[1:])
        prev = np.concatenate([[0], heads[:-1]])
        fresh_text = np.ones(len(heads), bool)
        fresh_text[1:] = owner[heads[1:]] != owner[heads[:-1]]
        breaks = (marks[heads] - marks[prev] > 0) | fresh_text
        return owner[heads], cost, breaks, size

    def segments(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """For each text its segments as (index of the language, confidence); none for a text without words."""
        owner, cost, breaks, size = self.word_costs(texts)
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        if not len(owner):
            return out
        counts = np.bincount(owner, minlength=len(texts))
        begin = np.concatenate([[0], np.cumsum(counts)])
        order = np.argsort(-counts, kind="stable")
        n = counts[order]
        k = len(LANGUAGES)
        dp = np.zeros((len(texts), k))
        came = np.zeros((len(owner), k), np.int8)
        active = len(texts)
        for t in range(int(n[0])):
            while active and n[active - 1] <= t:
                active -= 1
            w = begin[:-1][order[:active]] + t
            d = dp[:active]
            if t:
                low = d.argmin(1)
                jump = d[np.arange(active), low] + np.where(breaks[w], CHANGE, CHANGE_WITHIN)
                stay = d <= jump[:, None]
                came[w] = np.where(stay, np.arange(k), low[:, None])
                d = np.where(stay, d, jump[:, None])
            dp[:active] = d + cost[w]
        final = np.zeros(len(owner), np.int8)
        at = np.zeros(len(texts), np.int64)
        at[:] = dp.argmin(1)
        for t in range(int(n[0]) - 1, -1, -1):
            m = int(np.searchsorted(-n, -t, "left"))  # texts with more than t words
            w = begin[:-1][order[:m]] + t
            final[w] = at[:m]
            at[:m] = came[w, at[:m]] if t else at[:m]
        cut = np.ones(len(owner), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (final[1:] != final[:-1])
        heads = np.flatnonzero(cut)
        total = np.add.reduceat(cost, heads, axis=0)
        letters = np.add.reduceat(size, heads)
        p = np.exp(-(total - total.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        for h, row, m in zip(heads.tolist(), p, letters.tolist()):
            lang = int(final[h])
            out[int(owner[h])].append((lang, float(row[lang]) * m / (m + 1.0)))
        return out


def label_language(label: Column) -> Column:
    """The language that a label names, ``other`` for one not among ours, null for none."""
    plain = F.lower(F.trim(F.regexp_replace(label, "[-_].*$", "")))
    known = F.create_map(*[F.lit(x) for pair in BY_NOTATION.items() for x in pair])[plain]
    none = label.isNull() | plain.isin("", "xx", "unknown", "??", "zxx", "mul", "mis", "none", "null", "n/a") | ~plain.rlike("^[\\p{L}\\p{M}]+$")
    return F.when(~none, F.coalesce(known, F.lit("other")))


def training(messages: DataFrame, most: int = TRAINING) -> dict[str, list[str]]:
    """At most ``most`` texts of each language by label: those with the smallest hash."""
    from pyspark.sql import Window

    label = label_language(F.col("lang"))
    # A bound on the hash keeps what is read closely and sorted small; hashes are uniform, so it holds eight times what
    # is asked. Counting the labels needs no text.
    counts = messages.select(label.alias("l")).where(F.col("l").isin(*LANGUAGES)).groupBy("l").count().collect()
    keep = F.lit(False)
    for r in counts:
        h = hash_bound(most, r["count"], 8.0)
        keep = keep | ((F.col("l") == r["l"]) & (F.col("h") <= F.lit(h)))
    rows = messages.select(label.alias("l"), F.col("text_orig").alias("t"), F.xxhash64("text_orig").alias("h")).where("t is not null").where(keep).where(~suspicious(F.col("t")))
    w = Window.partitionBy("l").orderBy("h", "t")
    top = rows.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    out: dict[str, list[str]] = {lang: [] for lang in LANGUAGES}
    for r in top.select("l", "t", "r").collect():
        out[r["l"]].append((r["r"], _noise.sub(" ", r["t"])))
    return {lang: [t for _, t in sorted(ts)] for lang, ts in out.items()}


_UNSPACED_TEXT = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]{3}")


def _pieces(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"[.!?…:;؟۔।॥]+(?=\s|[A-ZÀ-ÞА-Я])|[。！？｡]|\s[^\w\s]+\s", text) if len(p.strip()) > 6]


def _triples(piece: str) -> set[tuple[str, ...]]:
    """Sequences of three words, or of three letters where words aren't set apart."""
    if _UNSPACED_TEXT.search(piece):
        return {tuple(piece[i : i + 3]) for i in range(max(1, len(piece) - 2))}
    w = re.findall(r"[^\W\d_]+", re.sub(r"(.)\1{2,}", r"\1", piece.lower()))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def _voted(pieces: dict[str, list[str]]) -> dict[str, list[str]]:
    """Pieces at least two thirds of whose word triples are relatively most frequent under their own label."""
    rates: dict[tuple[str, ...], dict[str, float]] = {}
    for lang, ps in pieces.items():
        for p in ps:
            for t in _triples(p):
                r = rates.setdefault(t, {})
                r[lang] = r.get(lang, 0.0) + 1.0 / len(ps)
    best = {t: max(r, key=lambda k: (r[k], k)) for t, r in rates.items()}
    return {lang: [p for p in ps if 3 * sum(best[t] == lang for t in _triples(p)) >= 2 * len(_triples(p))] for lang, ps in pieces.items()}


def _fresh(pieces: list[str]) -> list[str]:
    """Without pieces all of whose word triples have been seen: they would add nothing to an automaton."""
    seen: set[tuple[str, ...]] = set()
    out = []
    for p in pieces:
        triples = _triples(p)
        if not triples <= seen:
            seen |= triples
            out.append(p)
    return out


def _parser(sentences: dict[str, list[str]]) -> Parser:
    automata = {}
    for lang in LANGUAGES:
        c, _, flat = prepared([" " + " ".join(sentences[lang])])
        own = (c == _SPACE) | np.isin(np.where((c > 0) & (c < _BREAK), 1, c), ALPHABETS[lang])
        automata[lang] = Automaton(symbols(c, flat)[own])
    return Parser(automata)


def fit(labelled: dict[str, list[str]]) -> Parser:
    """Build the automata, drop training sentences that another language explains better, build them again."""
    sentences = {lang: _fresh(ps) for lang, ps in _voted({lang: [p for t in labelled[lang] for p in _pieces(t)] for lang in LANGUAGES}).items()}
    # Each half of the sentences is judged by the automata of the other half, which don't hold copies of them.
    halves = [{lang: ps[k::2] for lang, ps in sentences.items()} for k in (0, 1)]
    kept: dict[str, list[str]] = {lang: [] for lang in LANGUAGES}
    for k in (0, 1):
        other = _parser(halves[1 - k])
        for i, lang in enumerate(LANGUAGES):
            if not halves[k][lang] or not halves[1 - k][lang]:
                kept[lang] += halves[k][lang]  # nothing to judge, or to judge by
                continue
            owner, cost, _, _ = other.word_costs(halves[k][lang])
            total = np.zeros((len(halves[k][lang]), len(LANGUAGES)))
            np.add.at(total, owner, cost)
            good = total.min(1) >= CLEARLY * total[:, i]
            kept[lang] += [p for p, g in zip(halves[k][lang], good) if g]
    return _parser(kept)


def labelled_segments(messages: DataFrame, lexicon: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(msg_id, label, named, langs ARRAY<STRING>, confidence ARRAY<DOUBLE>) of each non-blank message row.

    ``named`` is the language that the label names, if any. A text without words has the one segment ``und``. Damaged
    text is repaired first, so it counts as the language it was written in. Repeated rows give repeated rows.
    """
    parser = fit(training(messages))
    model = clean_characters(messages.selectExpr("text_orig text"))
    sc = messages.sparkSession.sparkContext
    sent = sc.broadcast((parser, model.counts, lookalikes.vocabulary(lexicon, gazetteer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, words = sent.value
        chars, trie = CharModel(counts), lookalikes.Trie(words)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k, odd in enumerate(batch.column("odd").to_pylist()):
                if odd:
                    texts[k] = lookalikes.consistent(repaired(texts[k], chars), trie)
            texts = [_noise.sub(" ", t) for t in texts]
            langs, conf = [], []
            for lo in range(0, len(texts), 4096):
                for s in own.segments(texts[lo : lo + 4096]):
                    langs.append([LANGUAGES[i] for i, _ in s] or ["und"])
                    conf.append([c for _, c in s] or [1.0])
            yield pa.RecordBatch.from_arrays([batch.column("msg_id"), batch.column("label"), batch.column("named"), pa.array(langs, pa.list_(pa.string())), pa.array(conf, pa.list_(pa.float64()))], names=["msg_id", "label", "named", "langs", "confidence"])

    t = F.col("text")
    odd = t.rlike("[^\\x00-\\x7F]") & (suspicious(t) | t.rlike("[\\x{AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}\\x{FF10}-\\x{FF5A}\\x{FF66}-\\x{FF9F}\\x{FB00}-\\x{FB06}\\x{212A}\\x{300}-\\x{36F}\\x{1D400}-\\x{1D7FF}]|[a-zA-Z][\\x{370}-\\x{52F}]|[\\x{370}-\\x{52F}][a-zA-Z]"))
    rows = messages.selectExpr("msg_id", "lang label", "text_orig text").where(t.isNotNull() & t.rlike("\\S")).select("msg_id", "label", label_language(F.col("label")).alias("named"), "text", odd.alias("odd"))
    return rows.mapInArrow(run, "msg_id bigint, label string, named string, langs array<string>, confidence array<double>")


def segments(messages: DataFrame, lexicon: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(msg_id, seg_no, lang, confidence) of each segment of each non-blank message, each message once."""
    s = labelled_segments(messages, lexicon, gazetteer)
    return s.select("msg_id", F.posexplode(F.arrays_zip("langs", "confidence")).alias("seg_no", "s")).select("msg_id", "seg_no", F.col("s.langs").alias("lang"), F.col("s.confidence").alias("confidence")).dropDuplicates(["msg_id", "seg_no"])


def mislabelled(messages: DataFrame, lexicon: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(msg_id, seg_no, lang): all segments of each non-blank message whose label is null, names no language or another
    one than the text's, or whose text changes language; each message once."""
    s = labelled_segments(messages, lexicon, gazetteer)
    wrong = (F.size("langs") > 1) | F.col("named").isNull() | (F.col("named") != F.col("langs")[0])
    return s.where(wrong).select("msg_id", F.posexplode("langs").alias("seg_no", "lang")).dropDuplicates(["msg_id", "seg_no"])
