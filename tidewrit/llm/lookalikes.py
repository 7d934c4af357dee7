"""Problem 6: text that looks ordinary but is made of other characters.

A text is first freed of encoding damage (problem 3), whose products are not look-alikes. An expression picks the places
with characters that could be out of place; what decides is the spelling of the word they are in. It is looked up in a
trie of known words by a weighted edit automaton: look-alikes and ignorables cost nothing, a letter of a script that
the word isn't at home in costs one, as does a mark that composes with nothing, and other edits are not allowed. Of the
spellings it reaches within the budget, the cheapest and then most frequent one is chosen and gets the word's case;
words it doesn't reach are normalised by table. A word is affected if it isn't spelled as chosen.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded
from .mojibake import LOSSY, CharModel, clean_characters, repaired

# Letters of other scripts that look like a Latin letter, by that letter.
_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХҮԁԛԜԝаеѕіјорсухһӏүвктмнгпԚҺ", "ABESIJKMHOPCTXYdqWwaesijopcyxhlybktmHrnQh"))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαγεηικνορτυχωϲϱβμϜ", "ABEZHIKMNOPTYXCjayenikvoptuxwcpBuF"))
_OTHER = dict(zip("ɑɡıȷɩʟᴀᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢօսհոցյԼՕՏꜱ", "agijilacdejkmoptuvwzouhngjLOSs"))
_CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᎽᎵ", "ABCDEGHJKLMPRSTVWZYP"))
_COPTIC = dict(zip("ⲀⲂⲈⲌⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲁⲃⲉⲏⲓⲕⲙⲛⲟⲣⲥⲧⲩⲭ", "ABEZHIKMNOPCTYXabehikmnopctyx"))
_LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"))


def _drawn_as() -> dict[str, str]:
    """Letters of phonetic and other alphabets whose Unicode names say which Latin letter they are drawn as."""
    out = {}
    for c in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D80), *range(0xA720, 0xA800), *range(0xAB30, 0xAB70)):
        if m := re.fullmatch(r"LATIN (?:LETTER SMALL CAPITAL|SMALL LETTER (?:SCRIPT|DOTLESS|BLACKLETTER)) ([A-Z])", unicodedata.name(chr(c), "")):
            out[chr(c)] = m[1].lower()
    return out


_DRAWN = _drawn_as()
#: Look-alike -> Latin letter.
LOOKALIKES: dict[str, str] = {**_DRAWN, **_CHEROKEE, **_COPTIC, **_LISU, **_CYRILLIC, **_GREEK, **_OTHER}
#: Latin letter -> Cyrillic letter that it stands in for within a Cyrillic word, and the same for Greek (fixed values).
TO_CYRILLIC = dict(zip("ABEKMHOPCTXYaeopcyxijsSIJkmtbuhgrn", "АВЕКМНОРСТХУаеорсухіјѕЅІЈкмтьиһдгп"))
TO_GREEK = dict(zip("ABEZHIKMNOPTYXaeiknvoptuxy", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικηνορτυχγ"))

#: Characters that are not visible, with those that only join or select within emoji and some scripts apart.
_HIDDEN = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b\u200e\u200f\u202a-\u202e\u2060-\u206f\u3164\ufeff\uffa0\ufff9-\ufffb\x00-\x08\x0b\x0c\x0e-\x1f\x7f"
_BLANKS = "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f"
_LATIN = "A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0250-\u02af\u1d00-\u1d7f\u1e00-\u1eff"
_GREEK_LETTERS, _CYRILLIC_LETTERS, _ARMENIAN = "\u0370-\u03e1\u03f0-\u03ff\u1f00-\u1fff", "\u0400-\u052f\u1c80-\u1c8f", "\u0531-\u0587"
# Other alphabets that share shapes with Latin: Georgian capitals, Cherokee, Coptic, Lisu.
_RARE = "\u10a0-\u10c5\u13a0-\u13fd\uab70-\uabbf\u2c80-\u2cee\ua4d0-\ua4f7"
_FOREIGN = _GREEK_LETTERS + _CYRILLIC_LETTERS + _ARMENIAN + _RARE
_WIDE_HOME = "\u2e80-\u9fff\uf900-\ufaff\uac00-\ud7af\U00020000-\U0003ffff\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_EMOJI = "\u00a9\u00ae\u203c\u2049\u20e3\u2122\u2139\u2190-\u21ff\u2300-\u27bf\u2900-\u297f\u2b00-\u2bff\u3030\u303d\u3297\u3299#*0-9\ufe0f\u200d\U0001f000-\U0001faff\U000e0020-\U000e007f"
# Joiners are at home between letters of Arabic and Indic scripts (and Syriac, Thai, Khmer and Mongolian).
_JOINED = "\u0600-\u08ff\u0900-\u0dff\u0e00-\u0eff\u1000-\u109f\u1780-\u18af\ufb50-\ufdff\ufe70-\ufefe"

_WORD = r"[^\W\d_]"
_LETTER = re.compile(_WORD)
_WORD_PART = re.compile(f"{_WORD}|[\u0300-\u036f\u3099\u309a{_HIDDEN}\u200c\u200d]")
ODD = re.compile("|".join([
    f"[{_HIDDEN}]",
    f"[{_BLANKS}]",
    f"(?<![{_EMOJI}])\u200d|\u200d(?![{_EMOJI}])|\u200c",  # judged again by _joiner
    f"(?<![{_EMOJI}])[\ufe00-\ufe0f]",
    "[\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\uff9f\uffa1-\uffee]",  # wide letters and digits, narrow kana and hangul
    f"(?<![{_WIDE_HOME}])[\u3000\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65](?![{_WIDE_HOME}])",
    "\\w[\u0300-\u036f\u3099\u309a]",
    f"[{_LATIN}][{_FOREIGN}]|[{_FOREIGN}][{_LATIN}]|[{_GREEK_LETTERS}][{_CYRILLIC_LETTERS}]|[{_CYRILLIC_LETTERS}][{_GREEK_LETTERS}]",
    "[\ufb00-\ufb06\u017f\u0132\u0133\u0149\u01c4-\u01cc\u01f1-\u01f3\u212a\u212b\u2126\U0001d400-\U0001d7ff\u24b6-\u24e9\U0001f130-\U0001f149\u2160-\u217f\u2100-\u2115\u2119-\u211d\u2128\u212c-\u2134\u0251\u0261\u0131\u0237\u1d00-\u1d22" + "".join(_DRAWN) + "]",
    f"(?<![{_FOREIGN}{_LATIN}])[{_FOREIGN}]+(?![{_FOREIGN}{_LATIN}])",  # judged again by _disguised
]))
_FOREIGN_RUN = re.compile(f"[{_FOREIGN}]+")
_HOME_TEXT = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\U0010ffff]")
_TURKISH = re.compile("[ğşİ]")


#: Letters of a word that allow one letter of a strange script, or one stray mark, to be read as any.
PER_STRANGER = 3


class Trie:
    """Known words, traversed with a word whose characters may stand for others."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for w, n in words.items():
            node = self.root
            for c in w.lower():
                node = node.setdefault(c, {})
            if n >= node.get("", (-1, ""))[0]:
                node[""] = (n, w.lower())
        self.reached = Memo(self._reach, 100_000)

    def reach(self, word: str) -> str | None:
        """The cheapest and most frequent known word that this one looks like, or None."""
        return self.reached[word]

    def _reach(self, word: str) -> str | None:
        budget = len(word) // (PER_STRANGER + 1)
        home = _dominant(word)
        states: list[tuple[int, dict]] = [(0, self.root)]
        for c in word:
            steps = letters_of(c)
            if steps == ("",):
                continue
            strange, mark = _strange(c, home), "\u0300" <= c <= "\u036f"
            new: dict[int, tuple[int, dict]] = {}
            for cost, node in states:
                ways = [(cost, n) for n in (_walk(node, step) for step in steps) if n is not None]
                if cost < budget and strange:
                    ways += [(cost + 1, n) for letter, n in node.items() if letter]
                if cost < budget and mark:
                    ways.append((cost + 1, node))
                for k, n in ways:
                    if id(n) not in new or k < new[id(n)][0]:
                        new[id(n)] = (k, n)
            states = list(new.values())
            if not states:
                return None
        ends = [(-cost, *n[""]) for cost, n in states if "" in n]
        return max(ends)[2] if ends else None


def _walk(node: dict, letters: str) -> dict | None:
    for c in letters:
        node = node.get(c)
        if node is None:
            return None
    return node


def _strange(c: str, home: str) -> bool:
    """Whether a letter is of an alphabet that the word isn't at home in, and no look-alike by table says what it is."""
    return home == "latin" and c > "\u024f" and c.isalpha() and c not in LOOKALIKES and bool(re.match(f"[{_FOREIGN}\u0250-\u02af]", c))


def _letters_of(c: str) -> tuple[str, ...]:
    if unicodedata.category(c) in ("Cf", "Mn", "Cc") and not "\u0300" <= c <= "\u036f":
        return ("",)
    plain = unicodedata.normalize("NFKC", c).lower()
    alike = LOOKALIKES.get(c) or LOOKALIKES.get(unicodedata.normalize("NFKC", c)[:1])
    out = {plain, unicodedata.normalize("NFC", plain)}
    if alike:
        out.add(alike.lower())
    return tuple(sorted(out))


letters_of = Memo(_letters_of, 100_000).__getitem__


def _dominant(word: str) -> str:
    """The script a word is at home in, by its letters that no other script could lend."""
    latin = sum(c in _latin_set and c not in TO_CYRILLIC for c in word) * 10 + sum(c in _latin_set for c in word)
    foreign = [c for c in word if "\u0370" <= c <= "\u052f"]
    own = sum(c not in LOOKALIKES for c in foreign)
    if own and own * 10 + len(foreign) > latin:
        return "cyrillic" if sum(c >= "\u0400" for c in foreign) * 2 >= len(foreign) else "greek"
    return "latin"


_latin_set = {chr(c) for c in range(0x250) if chr(c).isalpha()} - {"\u0138"}


def by_table(word: str) -> str:
    """A word's ordinary form without a vocabulary: composed, of normal width, in its script, nothing hidden."""
    word = re.sub(f"[{_HIDDEN}\u200c\u200d\ufe00-\ufe0f]", "", word)
    word = "".join(unicodedata.normalize("NFKC", c) if c not in "ªº²³¹" and not "\u0300" <= c <= "\u036f" and _compat(c) else c for c in word)
    word = unicodedata.normalize("NFC", word)
    script = _dominant(word)
    if script == "latin":
        return "".join(LOOKALIKES.get(c, c) for c in word)
    swap = TO_CYRILLIC if script == "cyrillic" else TO_GREEK
    return "".join(swap.get(c, c) for c in word)


def _compat(c: str) -> bool:
    return "\uff00" <= c <= "\uffef" or "\ufb00" <= c <= "\ufb06" or "\U0001d400" <= c <= "\U0001d7ff" or c in "\u017f\u0132\u0133\u0149\u212a\u212b\u2126" or "\u24b6" <= c <= "\u24e9" or "\u2160" <= c <= "\u217f" or "\u2100" <= c <= "\u2134" and c not in "\u2116\u2122"


def _joiner(text: str, at: int) -> bool:
    """Whether a zero-width joiner or non-joiner at a place is at home there."""
    around = text[at - 1 : at] + text[at + 1 : at + 2]
    return bool(around) and all(re.match(f"[{_JOINED}]", c) for c in around)


def _disguised(word: str, text: str, trie: Trie) -> bool:
    """Whether a word wholly of another script's look-alikes stands for a known Latin word amid Latin text."""
    if not all(c in LOOKALIKES for c in word) or trie.reach(word) is None:
        return False
    latin = len(re.findall(f"[{_LATIN}]", text))
    foreign = len(re.findall(f"[{_FOREIGN}]", text))
    return latin > 4 * foreign


def places(text: str, trie: Trie) -> list[tuple[int, int]]:
    """Spans of a text, already freed of encoding damage, in which a character stands in for another or is hidden."""
    out = []
    for m in ODD.finditer(text):
        s = m[0]
        if s in "\u200c\u200d" and _joiner(text, m.start()):
            continue
        if len(s) == 2 and ("\u0300" <= s[1] <= "\u036f" or s[1] in "\u3099\u309a") and len(unicodedata.normalize("NFC", s)) != 1:
            continue
        if s in "ıȷ" and _TURKISH.search(text):
            continue
        if _FOREIGN_RUN.fullmatch(s) and not _mixed(s) and not _disguised(s, text, trie):
            continue
        out.append(m.span())
    return out


def _mixed(s: str) -> bool:
    return len({("g" if c < "\u0400" or c >= "\u1f00" else "a" if c > "\u052f" else "c") for c in s}) > 1


def affected(text: str, trie: Trie) -> bool:
    """Whether a text, already freed of encoding damage, has a place that isn't spelled as it should be.

    Within words the spelling that the trie or the table gives decides; signs, blanks and hidden characters are odd where
    they stand.
    """
    for a, b in places(text, trie):
        if not _LETTER.search(text[a:b]):
            return True
        while a and _WORD_PART.match(text[a - 1]):
            a -= 1
        while b < len(text) and _WORD_PART.match(text[b]):
            b += 1
        if _spelled(text[a:b], trie) != text[a:b]:
            return True
    return False


def consistent(text: str, trie: Trie) -> str:
    """The text in its one consistent form."""
    if not _HOME_TEXT.search(text) or not places(text, trie):
        return text
    text = re.sub(f"[{_BLANKS}]", " ", text)
    text = re.sub(f"(?<![{_WIDE_HOME}])\u3000(?![{_WIDE_HOME}])", " ", text)
    text = re.sub("[\uff66-\uff9f]+", lambda m: unicodedata.normalize("NFKC", m[0]), text)
    out, at = [], 0
    for m in re.finditer(f"(?:[^\\s]|[{_HIDDEN}])+", text):
        word = m[0]
        if not _HOME_TEXT.search(word) or not places(word, trie):
            continue
        out.append(text[at : m.start()])
        out.append(re.sub(f"(?:{_WORD}|[\u0300-\u036f{_HIDDEN}\u200c\u200d])+|[\uff01-\uff5e]", lambda x: _spelled(x[0], trie), word))
        at = m.end()
    return "".join([*out, text[at:]])


def _spelled(word: str, trie: Trie) -> str:
    table = by_table(word)
    if not places(word, trie):
        return word
    known = trie.reach(word)
    if known is None or len(known) != len(table):
        return table
    return "".join(k.upper() if t.isupper() else k for k, t in zip(known, table))


def vocabulary(lexicon: DataFrame, gazetteer: DataFrame, most: int = 500_000) -> dict[str, int]:
    """Known words with their frequency; at most ``most`` (a lexicon is a resource of fixed size, not a corpus)."""
    words: dict[str, int] = {}
    for w, n in bounded(lexicon.selectExpr("word", "coalesce(freq, 1)").where("word is not null"), most, "lexicon"):
        words[w] = max(n, words.get(w, 0))
    for (k,) in bounded(gazetteer.select("key").where("key is not null"), most, "gazetteer"):
        for w in k.split():
            words.setdefault(w, 1)
    return words


def normalized(recs: DataFrame, lexicon: DataFrame, gazetteer: DataFrame, model: CharModel | None = None, keep_text: bool = True) -> DataFrame:
    """(field, rec_id, affected BOOLEAN, text, fixed) of every record of ``recs`` (field, rec_id, text) with unusual characters.

    Records of plain ASCII without control characters are consistent as they are and not returned. Null texts are
    dropped; empty texts are consistent. Repeated rows give repeated rows.
    """
    model = model or clean_characters(recs)
    sc = recs.sparkSession.sparkContext
    sent = sc.broadcast((model.counts, vocabulary(lexicon, gazetteer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = sent.value
        own, trie = CharModel(counts), Trie(words)
        for batch in batches:
            flags, fixed = [], []
            for t in batch.column("text").to_pylist():
                r = repaired(t, own)
                bad = affected(r.replace(LOSSY, ""), trie)
                flags.append(bad)
                fixed.append((consistent(r, trie) if bad else r) if keep_text else None)
            texts = batch.column("text") if keep_text else pa.nulls(len(fixed), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("field"), batch.column("rec_id"), pa.array(flags, pa.bool_()), texts, pa.array(fixed, pa.string())], names=["field", "rec_id", "affected", "text", "fixed"])

    odd = F.col("text").rlike("[^\\t\\n\\r\\x20-\\x7E]") & F.col("text").rlike("[^\\t\\n\\r\\x20-\\x7E\\x{A1}-\\x{AC}\\x{AE}-\\x{C1}\\x{C4}-\\x{130}\\x{2013}-\\x{2026}\\x{20AC}\\x{201A}-\\x{201E}]|[\\x{80}-\\x{BF}]|\\p{M}")
    return recs.select("field", "rec_id", "text").where(odd).mapInArrow(run, "field string, rec_id bigint, affected boolean, text string, fixed string")


def gold_records(messages: DataFrame, gold: DataFrame) -> DataFrame:
    """(field, rec_id, text) of ``messages.text_orig`` and of ``csv_sent.ori``, its elements joined by blanks."""
    a = messages.selectExpr("'text_orig' field", "msg_id rec_id", "text_orig text")
    b = gold.selectExpr("'ori' field", "post_id rec_id", "array_join(ori, ' ') text")
    return a.unionByName(b).where("rec_id is not null and text is not null")


def found(recs: DataFrame, lexicon: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(field, rec_id) of each record with a look-alike, hidden or decomposed character; each once."""
    return normalized(recs, lexicon, gazetteer, keep_text=False).where("affected").select("field", "rec_id").distinct()
