"""Problem 3: text that was decoded with the wrong character encoding.

A chain names how a text was damaged: written in one encoding, read in another, perhaps twice. The chain of a record
is latent. Each chain's inverse is tried on the record's suspicious sequences; the gain in log likelihood under a
model of the corpus's clean characters is the evidence for it. Evidence of single records can be weak, so
expectation-maximization estimates how common each chain is in each source and field, and every record is judged and
repaired by its posterior. The expectation step is a join of the records' evidence, grouped to distinct vectors,
with the priors of their source; nothing but the character counts is collected.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points

#: Single-byte encodings of Cyrillic that are read as each other.
CYRILLIC = ("koi8-r", "cp1251", "cp866", "iso8859-5")
#: The chains: kind, encoding written, encoding it was read in. "utf8" chains undo UTF-8 sequences where they stand,
#: "twice" does so two times, "whole" undoes whole words, "c1" undoes control characters, "cyrillic" undoes runs of
#: words between two encodings of Cyrillic.
CHAINS: list[tuple[str, str, str]] = [
    *[("utf8", "utf-8", r) for r in ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-15", "cp1254")],
    *[("twice", "utf-8", r) for r in ("cp1252", "latin-1", "cp1250", "mac_roman")],
    *[("whole", w, r) for w in (*CYRILLIC, "gbk", "shift_jis", "euc-jp", "big5", "cp1256", "tis-620") for r in ("cp1252", "latin-1")],
    ("c1", "cp1252", "latin-1"),
    *[("cyrillic", w, r) for w, r in itertools.permutations(CYRILLIC, 2)],
]
NAMES = ["clean", *(f"{k}:{w}>{r}" for k, w, r in CHAINS), "lossy"]
LOSSY = "\ufffd"
#: Evidence is rounded to whole nats and held within this bound, so that records fall into few distinct vectors.
MOST_NATS = 30
ROUNDS = 4
#: Nats that the begin of a run of words of a "cyrillic" chain costs.
RUN_NATS = 6.0
#: Nats of a word in capitals and of one in mixed case.
CASE_NATS = (-0.5, -4.0)
#: Most distinct characters of the clean-character model: there are no more code points.
MOST_CHARS = 1_114_112


class _Reader(dict):
    """Translation of characters to chr(byte) of a single-byte encoding; other non-ASCII characters become NUL."""

    def __init__(self, codec: str):
        super().__init__()
        self.high = ""
        for b in range(256):
            try:
                c = bytes([b]).decode(codec)
            except UnicodeDecodeError:
                c = chr(b)
            self[ord(c)] = chr(b)
        if codec == "cp1252":
            for b in range(0x80, 0xA0):
                self.setdefault(b, chr(b))

    def __missing__(self, c: int) -> str:
        return chr(c) if c < 128 else "\0"

    def chars(self, lo: int, hi: int) -> str:
        return "".join(sorted(chr(c) for c, b in self.items() if lo <= ord(b) <= hi and c > 127))


@functools.lru_cache(maxsize=64)
def _bytes_of(text: str, read: str) -> str:
    """The text's bytes in an encoding as characters; the chains of one text share them."""
    return text.translate(READERS[read])


READERS = {r: _Reader(r) for r in sorted({r for _, _, r in CHAINS})}
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_HIGH = re.compile("[\x80-\xff]")
_WORD = re.compile(r"[^\s\0]+")
#: Words of encodings whose letters may be read as no-break spaces or control characters.
_ASCII_WORD = re.compile("[^\t-\r\x1c- \0]+")
_RUSSIAN = "".join(map(chr, [*range(0x410, 0x450), 0x401, 0x451]))
_RUSSIAN_TEXT = {*_RUSSIAN, *"«»“”„‘’…–—№\xa0"}
#: What any letter of one encoding of Cyrillic may look like in another one.
_CYRILLIC_TRACE = re.compile("[\u0400-\u045f\u0490\u0491\u2500-\u25ff]")


def _class(chars: str) -> str:
    """A Java class of characters by ranges: Java asks the members of a class one after the other."""
    codes = sorted(map(ord, set(chars)))
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends)) + "]"


def suspicious_pattern() -> str:
    """A Java pattern of what any chain could have made; rows without a match are clean."""
    seqs = [_class(READERS[r].chars(0xC2, 0xF4)) + _class(READERS[r].chars(0x80, 0xBF)) for k, _, r in CHAINS if k == "utf8"]
    high = "[\\x{80}-\\x{FF}\\x{152}\\x{153}\\x{160}\\x{161}\\x{178}\\x{17D}\\x{17E}\\x{192}\\x{2C6}\\x{2DC}\\x{2013}-\\x{203A}\\x{20AC}\\x{2122}]"
    return "(?=[^\\x00-\\x7F])(?:" + "|".join([f"\\x{{FFFD}}|[\\x{{80}}-\\x{{9F}}]|{high}{{3}}", *dict.fromkeys(seqs), *_cyrillic_patterns()]) + ")"


def _cyrillic_patterns() -> list[str]:
    """What letters of one encoding of Cyrillic look like in another one.

    The cases are swapped, so small letters give capitals in a row, and capitals give words without vowels, with a sign
    first or with long runs of consonants; letters without a counterpart give symbols within words.
    """
    odd = set()
    for w, r in itertools.permutations(CYRILLIC, 2):
        odd |= {c for c in _RUSSIAN.encode(w).decode(r, "ignore") if not c.isspace()}
    odd -= {*_RUSSIAN, *"‚„…†‡€‰‹›‘’“”•–—™«»°·№"}
    # Whole blocks instead of single symbols and foreign letters of Cyrillic, since ranges are cheaper.
    symbols = _class("".join(c for c in odd if c < "\u0400"))[:-1] + "\\x{402}-\\x{40F}\\x{452}-\\x{45F}\\x{490}\\x{491}\\x{2219}-\\x{25A0}]"
    letter, mute = "[\\x{400}-\\x{45F}]", _class("бвгджзйклмнпрстфхцчшщъь")
    return [
        "[\\x{400}-\\x{42F}]{2}",
        f"(?<!{letter})(?:{_class('ъыь')}{letter}|{mute}{{3,}}(?!{letter}))|{mute}{{5}}",
        f"{symbols}{{2}}|{letter}{symbols}{letter}",
    ]


class CharModel:
    """Log probability of non-ASCII characters in clean text: corpus counts over pseudo-counts by kind of character."""

    def __init__(self, counts: dict[int, int]):
        self.counts, self.total = counts, sum(counts.values()) + 50.0
        self.memo: dict[str, float] = {}

    @staticmethod
    def pseudo(c: int) -> float:
        if c < 0xA0:
            return 1e-7
        if c < 0xC0:
            return 0.02 if chr(c) not in "«»°¿¡" else 0.5
        if c < 0x100:
            return 0.5 if chr(c).islower() and chr(c) not in "ðþãåæ" else 0.05
        if 0x2010 <= c <= 0x2027 or c == 0x20AC:
            return 0.5
        if 0x400 <= c < 0x460 or 0x621 <= c < 0x650 or 0x900 <= c < 0x970 or 0xE00 <= c < 0xE60 or 0x3040 <= c < 0x3100:
            return 0.1
        if 0x3000 <= c < 0x3010 or 0x1F300 <= c < 0x1FB00 or c in (0x200D, 0xFE0F, 0x2764):
            return 0.05
        if 0x4E00 <= c < 0xA000:
            return 0.002
        return 1e-4 if c < 0x180 else 1e-7

    def __call__(self, text: str) -> float:
        s = 0.0
        for ch in text:
            if ch > "\x7f":
                v = self.memo.get(ch)
                if v is None:
                    v = self.memo[ch] = math.log((self.counts.get(ord(ch), 0) + self.pseudo(ord(ch))) / self.total)
                s += v
        return s


def undo(text: str, chain: tuple[str, str, str], model: CharModel) -> tuple[str, float]:
    """The text with what the chain explains undone, and the gain in log likelihood. Parts it can't explain stay."""
    kind, written, read = chain
    if kind == "c1":
        gain, out = 0.0, []
        for c in text:
            if "\x80" <= c <= "\x9f":
                d = bytes([ord(c)]).decode("cp1252", "ignore")
                if d:
                    gain += model(d) - model(c)
                    c = d
            out.append(c)
        return "".join(out), gain
    if kind == "cyrillic" and not _CYRILLIC_TRACE.search(text):
        return text, 0.0
    mapped = _bytes_of(text, read)
    if kind == "cyrillic":
        return _undo_runs(text, mapped, written, model)
    if kind == "whole":
        if not _HIGH.search(mapped):
            return text, 0.0
        gain, out, at = 0.0, [], 0
        strong = False
        for m in (_ASCII_WORD if written == "cp866" else _WORD).finditer(mapped):
            w = m[0]
            if w.isascii():
                continue
            try:
                d = w.encode("latin-1").decode(written)
            except UnicodeDecodeError:
                continue
            if not _one_script(d):
                continue
            g = model(d) - model(text[m.start() : m.end()])
            strong |= sum(c > "\x7f" for c in w) >= 3 and g > 0
            gain += g
            out += [text[at : m.start()], d]
            at = m.end()
        return ("".join([*out, text[at:]]), gain) if strong else (text, 0.0)
    gain, out, at = 0.0, [], 0
    for m in _UTF8.finditer(mapped):
        try:
            d = m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        g = model(d) - model(text[m.start() : m.end()])
        if g > 0 or kind == "twice":
            gain += g
            out += [text[at : m.start()], d]
            at = m.end()
    once = "".join([*out, text[at:]])
    if kind == "twice":
        again, more = undo(once, ("utf8", written, read), model)
        return (again, gain + more) if more > 0 else (text, 0.0)
    return once, gain


def _as_russian(word: str, model: CharModel) -> float:
    """Log likelihood of a word without case, so that text in capitals is no damage, and of its case apart.

    The letter io counts as ie: its sequences look like UTF-8 read as cp1251, so the counts lack it.
    """
    letters = "".join(filter(str.isalpha, word))
    case = 0.0 if letters.islower() or letters[1:].islower() else CASE_NATS[0] if letters.isupper() else CASE_NATS[1]
    return model(word.lower().replace("ё", "е")) + case * (len(letters) > 1)


def _undo_runs(text: str, mapped: str, written: str, model: CharModel) -> tuple[str, float]:
    """The runs of words undone that are worth the most together, and their gain.

    A record may be damaged in some of its sentences only, and any word can be decoded, so a run ends where the words
    get worse.
    """
    words: list[tuple[int, int, str, float]] = []
    for m in _ASCII_WORD.finditer(mapped):
        if m[0].isascii():
            continue
        d, was = m[0].encode("latin-1").decode(written, "replace"), text[m.start() : m.end()]
        if all(c in _RUSSIAN_TEXT or c < "\x80" and not c.isalpha() for c in d):
            words.append((*m.span(), d, _as_russian(d, model) - _as_russian(was, model)))
        elif _CYRILLIC_TRACE.search(was):
            words.append((*m.span(), was, -RUN_NATS))
    # The best value of the words so far, outside of a run and within one.
    outside, within = 0.0, -math.inf
    ways: list[tuple[bool, bool]] = []
    for *_, g in words:
        opens, closes = outside - RUN_NATS > within, within > outside
        ways.append((opens, closes))
        outside, within = max(outside, within), max(outside - RUN_NATS, within) + g
    inside, chosen = within > outside, []
    for i in range(len(words) - 1, -1, -1):
        opens, closes = ways[i]
        if inside:
            chosen.append(i)
            inside = not opens
        else:
            inside = closes
    chosen.reverse()
    if not any(sum(c > "\x7f" for c in words[i][2]) >= 3 and words[i][3] > 0 for i in chosen):
        return text, 0.0
    out, at = [], 0
    for i in chosen:
        a, b, d, _ = words[i]
        out += [text[at:a], d]
        at = b
    return "".join([*out, text[at:]]), max(outside, within)


def _one_script(word: str) -> bool:
    """Whether a decoded word has foreign letters and no accented or plain Latin letters between them."""
    foreign = sum(c > "\u036f" for c in word)
    latin = sum(c.isalpha() and c < "\u0370" for c in word)
    return foreign > 0 and latin == 0 and not any("\x80" <= c <= "\x9f" or c == "\ufffd" or "\ue000" <= c <= "\uf8ff" for c in word)


def evidence(text: str, model: CharModel) -> list[float]:
    """Gain of each chain over clean, in the order of NAMES.

    A chain that finds nothing to undo can't have made the record: it gets the lower bound, as the lossy entry does
    where no replacement character stands.
    """
    gains = [g if g > 0 else -MOST_NATS for g in (undo(text, c, model)[1] for c in CHAINS)]
    lossy = MOST_NATS + max([0.0, *gains]) if LOSSY in text else -MOST_NATS
    return [0.0, *gains, lossy]


_PREFILTER = suspicious_pattern()
_SUSPICIOUS = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U%08X" % int(m[1], 16), _PREFILTER))
#: Prior of the chains where no estimate is at hand.
LOG_CLEAN, LOG_CHAIN = math.log(0.95), math.log(0.05 / len(CHAINS))


def repaired(text: str, model: CharModel, log_prior: list[float] | None = None) -> str:
    """The text by its most probable chain, and again while another chain explains more; the rest stays."""
    # Chains are judged by different measures, so one could bring back what another one has undone: a text met before ends it.
    seen: set[str] = set()
    while True:
        seen.add(text)
        if text.isascii() or not _SUSPICIOUS.search(text):
            return text
        best, out = (log_prior[0] if log_prior else LOG_CLEAN), text
        for i, chain in enumerate(CHAINS):
            t, gain = undo(text, chain, model)
            p = gain + (log_prior[i + 1] if log_prior else LOG_CHAIN)
            if gain > 0 and p > best:
                best, out = p, t
        if out in seen:
            return text
        text = out


def suspicious(text: Column) -> Column:
    return text.rlike("[^\\x00-\\x7F]") & text.rlike(_PREFILTER)


def clean_characters(texts: DataFrame) -> CharModel:
    """Counts of non-ASCII characters in all texts (column ``text``) that no chain could have made.

    One row per distinct character reaches the driver; there are at most MOST_CHARS.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            flat, _ = code_points([t for t in batch.column(0).to_pylist() if t])
            c, n = np.unique(flat[flat > 127], return_counts=True)
            for k, v in zip(c.tolist(), n.tolist()):
                total[k] = total.get(k, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["c", "n"])

    text = F.col("text")
    rows = texts.select("text").where(text.rlike("[^\\x00-\\x7F]") & ~text.rlike(_PREFILTER)).mapInArrow(count, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return CharModel({r[0]: r[1] for r in rows})


def records(messages: DataFrame, gold: DataFrame) -> DataFrame:
    """(field, rec_id, source, text) of both fields; a gold target is its elements joined by blanks. Nulls are dropped."""
    a = messages.selectExpr("'text_orig' field", "msg_id rec_id", "coalesce(channel, '') source", "text_orig text")
    b = gold.selectExpr("'tgt' field", "post_id rec_id", "'' source", "array_join(tgt, ' ') text")
    return a.unionByName(b).where("rec_id is not null and text is not null")


def with_evidence(recs: DataFrame, model: CharModel) -> DataFrame:
    """Suspicious records with ``gains``: rounded evidence for each chain."""
    sent = recs.sparkSession.sparkContext.broadcast(model.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CharModel(sent.value)
        for batch in batches:
            gains = [[min(MOST_NATS * 2, max(-MOST_NATS, round(g))) for g in evidence(t, own)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gains, pa.list_(pa.int32()))], names=[*batch.schema.names, "gains"])

    return recs.where(suspicious(F.col("text"))).mapInArrow(run, "field string, rec_id bigint, source string, text string, gains array<int>")


def priors(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(field, source, pi ARRAY<DOUBLE>): how common each chain is, by expectation-maximization over ``seen``."""
    k = len(NAMES)
    vectors = seen.groupBy("field", "source", "gains").agg(F.count(F.lit(1)).alias("n"))
    pi = vectors.select("field", "source").distinct().withColumn("pi", F.array_repeat(F.lit(1.0 / k), k))
    for _ in range(rounds):
        e = vectors.join(pi, ["field", "source"]).withColumn("w", F.zip_with("gains", "pi", lambda g, p: F.exp(g.cast("double") - F.array_max("gains")) * p))
        e = e.withColumn("z", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
        e = e.select("field", "source", "n", F.posexplode(F.transform("w", lambda x: x / F.col("z"))).alias("c", "r"))
        m = e.groupBy("field", "source", "c").agg(F.sum(F.col("n") * F.col("r")).alias("s"))
        # One pseudo-record per chain keeps every chain possible.
        pi = m.groupBy("field", "source").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("cs"), F.sum("s").alias("all")).select(
            "field", "source", F.transform("cs", lambda x: (x["s"] + F.lit(1.0 / k)) / (F.col("all") + F.lit(1.0))).alias("pi")
        )
    return pi


def judged(recs: DataFrame) -> DataFrame:
    """Suspicious records with ``chain``, the most probable one of NAMES, its posterior ``confidence``, and ``pi``."""
    from .common import written

    seen = written(with_evidence(recs, clean_characters(recs)))
    w = F.zip_with("gains", "pi", lambda g, p: g.cast("double") + F.log(p))
    top = F.array_max("w")
    return (
        seen.join(priors(seen), ["field", "source"])
        .withColumn("w", w)
        .withColumn("chain", F.element_at(F.array(*map(F.lit, NAMES)), F.array_position("w", top).cast("int")))
        .withColumn("confidence", F.lit(1.0) / F.aggregate("w", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    )


def garbled(recs: DataFrame) -> DataFrame:
    """(field, rec_id) of every record with a garbled sequence, recoverable or not; each once."""
    return judged(recs).where(f"chain <> 'clean' or instr(text, '{LOSSY}') > 0").select("field", "rec_id").distinct()


def restored(recs: DataFrame) -> DataFrame:
    """(field, rec_id, chain, confidence, text, fixed) of every garbled record, ``fixed`` being the repaired text."""
    model = clean_characters(recs)
    sent = recs.sparkSession.sparkContext.broadcast(model.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CharModel(sent.value)
        for batch in batches:
            fixed = []
            for t, pi in zip(batch.column("text").to_pylist(), batch.column("pi").to_pylist()):
                fixed.append(repaired(t, own, [math.log(p) for p in pi]))
            keep = [batch.column(c) for c in ("field", "rec_id", "chain", "confidence", "text")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(fixed, pa.string())], names=["field", "rec_id", "chain", "confidence", "text", "fixed"])

    bad = judged(recs).where(f"chain <> 'clean' or instr(text, '{LOSSY}') > 0").select("field", "rec_id", "chain", "confidence", "text", "pi")
    return bad.mapInArrow(run, "field string, rec_id bigint, chain string, confidence double, text string, fixed string")
