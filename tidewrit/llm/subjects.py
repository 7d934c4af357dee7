"""Problem 10: the subjects of documents.

A complement naive Bayes model over words scores each sentence for each subject. It is trained on labelled documents
and refined by expectation-maximization over the sentences of all documents: which subject a sentence is about is
latent, a label only says which subjects a document has. Test passages (problem 9) are a class of their own and don't
count. Each round of the refinement is a distributed pass: tasks get the weights and give expected counts of words per
class, which are summed by word.

The posterior of each subject for a sentence is calibrated by itself (Platt) on labelled documents; a document's
confidence in a subject is the probability that at least a third of its sentences are about it, its sentences being
independent.

Words are hashed from code points for a whole batch at once, so no step handles single words; documents are read once
and kept as lists of hashed words in the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, code_points, hash_bound, list_array, list_parts, written
from .leaks import fold_table

#: Labelled documents that the model is fitted on at most: those with the smallest hashes of their id.
LABELLED = 12_000
BITS = 18
SHARE = 1 / 3
EVERYDAY, PASSAGE = "everyday", "(test passage)"
#: Rounds on the labelled documents, and rounds over all documents after them.
ROUNDS, ROUNDS_ALL = 6, 2
#: How much all documents together weigh in a round, as a multiple of the labelled ones.
WEIGHT_ALL = 2.0
#: Sentence posteriors beyond these are taken as certain when a document's sentences are counted.
CERTAIN = 0.02
#: Share of a word's labelled documents that must have one subject for the word to vote for it, and the least number.
VOTE, VOTE_LEAST = 0.65, 4
_NOISE = re.compile(r"https?:/\S+|www\.\S+|[@#]\w+|<LINEBREAK>")
_rng = np.random.default_rng(20240607)
_POWERS = (_rng.integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_STOPS = np.array([ord(c) for c in "!?…。！？\n؟।"], np.uint32)


def sentence_words(texts: list[str], part: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each word, sentence of each word, text of each sentence); sentences without a word are left out.

    Works in parts of ``part`` texts, since the arrays over code points are much larger than the result.
    """
    parts, sentences = [], 0
    for lo in range(0, len(texts), part):
        f, s, t = _part_words(texts[lo : lo + part])
        parts.append((f.astype(np.int32), (s + sentences).astype(np.int32), (t + lo).astype(np.int32)))
        sentences += len(t)
    if not parts:
        z = np.zeros(0, np.int32)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*parts))


def _part_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat, offsets = code_points([_NOISE.sub(" ", t) for t in texts])
    f = fold_table()[np.minimum(flat, 0x2FFFF)]
    n = len(flat)
    if not n or not f.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    letter = f > 0
    wide = (f >= 0x3040) & (f <= 0x9FFF)
    new_text = np.ones(n, bool)
    new_text[1:] = owner[1:] != owner[:-1]
    prev_letter = np.zeros(n, bool)
    prev_letter[1:] = letter[:-1] & ~new_text[1:]
    same = np.zeros(n, bool)
    same[1:] = (f[1:] == f[:-1]) & prev_letter[1:] & ~wide[1:]
    prev_wide = np.zeros(n, bool)
    prev_wide[1:] = wide[:-1]
    head = letter & (~prev_letter | wide | prev_wide)
    # A stop ends a sentence before a blank or the end, unless the word before it has up to three letters.
    run = np.arange(n) - np.maximum.accumulate(np.where(head, np.arange(n), 0))
    dot = flat == ord(".")
    before = np.zeros(n, np.int64)
    before[1:] = np.where(letter[:-1], run[:-1] + 1, 4)
    blank_next = np.ones(n, bool)
    blank_next[:-1] = ~letter[1:] & (flat[1:] != ord(".")) | new_text[1:]
    upper_next = np.zeros(n, bool)
    upper_next[:-1] = (flat[1:] >= 65) & (flat[1:] <= 90)
    ends = np.isin(flat, _STOPS) | dot & (before > 3) & (blank_next | upper_next) | (flat >= 0x1F300)
    number = np.cumsum(ends | new_text)
    keep = letter & ~same
    k = np.flatnonzero(keep)
    heads = np.flatnonzero(head[k])
    place = np.minimum(np.arange(len(k)) - np.repeat(heads, np.diff(np.append(heads, len(k)))), 63) if len(heads) else np.zeros(0, int)
    h = np.add.reduceat((f[k].astype(np.uint64) + np.uint64(77)) * _POWERS[place], heads)
    at = k[heads]
    nxt = np.zeros(n + 1, np.uint64)
    nxt[: n - 1] = np.where(wide[1:], f[1:], 0)
    h = np.where(wide[at], h + nxt[at] * _POWERS[63], h)
    h ^= h >> np.uint64(31)
    feature = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    ids, sentence = np.unique(number[at], return_inverse=True)
    first = np.zeros(len(ids), np.int64)
    first[sentence[::-1]] = owner[at][::-1]
    return feature, sentence, first


def complement_weights(counts: np.ndarray, alpha: float = 0.2) -> np.ndarray:
    """Weights (feature, class) of complement naive Bayes from weighted counts (feature, class)."""
    seen = counts.sum(1, keepdims=True) > 0
    rest = counts.sum(1, keepdims=True) - counts + alpha
    w = -np.log(rest / rest.sum(0))
    w -= w.mean(1, keepdims=True)
    return np.where(seen, w, 0.0)


def sentence_scores(weights: np.ndarray, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, weights.shape[1]))
    for c in range(weights.shape[1]):
        out[:, c] = np.bincount(sentence, weights[feature, c], n)
    return out


def posteriors(scores: np.ndarray, text: np.ndarray, prior: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Class posteriors of sentences and the mixture of each text, by expectation-maximization within texts."""
    mix = prior / prior.sum(1, keepdims=True)
    p = None
    for _ in range(rounds):
        s = scores + np.log(mix[text])
        s -= s.max(1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(1, keepdims=True)
        mix = prior.copy()
        for c in range(prior.shape[1]):
            mix[:, c] += np.bincount(text, p[:, c], len(prior))
        mix /= mix.sum(1, keepdims=True)
    return p, mix


class Model:
    """Weights of words, and the calibration (slope, offset) of each subject's log odds."""

    def __init__(self, subjects: list[str], weights: np.ndarray, calibration: np.ndarray):
        self.subjects, self.weights, self.calibration = subjects, weights, calibration

    def sentence_posteriors(self, feature: np.ndarray, sentence: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        scores = sentence_scores(self.weights, feature, sentence, len(text))
        return posteriors(scores, text, np.full((texts, len(self.subjects) + 1), 0.3))[0]

    def judged(self, feature: np.ndarray, sentence: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(share, confidence) of each subject in each text: its expected share of the sentences, and the probability that
        it has a third of them; test passages are not counted. Zero where there is no sentence."""
        k = len(self.subjects)
        share, confidence = np.zeros((texts, k)), np.zeros((texts, k))
        if not len(text):
            return share, confidence
        p = self.sentence_posteriors(feature, sentence, text, texts)
        kept = p.argmax(1) < k
        own = text[kept]
        q = calibrated(p[kept, :k], self.calibration)
        n = np.bincount(own, minlength=texts)
        need = np.ceil(n * SHARE - 1e-9)
        for c in range(k):
            share[:, c] = np.bincount(own, q[:, c], texts) / np.maximum(1, n)
            sure = np.bincount(own, q[:, c] > 1 - CERTAIN, texts)
            open_ = (q[:, c] >= CERTAIN) & (q[:, c] <= 1 - CERTAIN)
            left = need - sure
            could = np.bincount(own, open_, texts)
            confidence[:, c] = (n > 0) & (left <= 0)
            for d in np.flatnonzero((n > 0) & (left > 0) & (left <= could)).tolist():
                lo, hi = np.searchsorted(own, (d, d + 1))
                confidence[d, c] = at_least(int(left[d]), q[lo:hi, c][open_[lo:hi]])
        return share, confidence


def at_least(m: int, p: np.ndarray) -> float:
    """Probability that at least m of independent events happen."""
    ways = np.zeros(m + 1)
    ways[0] = 1.0
    for x in p.tolist():
        ways[m] += ways[m - 1] * x
        ways[1:m] += x * (ways[: m - 1] - ways[1:m])
        ways[0] *= 1 - x
    return float(ways[m])


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def calibrated(p: np.ndarray, calibration: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(calibration[0] * log_odds(p) + calibration[1])))


def platt(p: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """(slope, offset) by which the log odds of ``p`` fit ``y`` best, with a pull to (1, 0) that counts as 20 sentences."""
    x, w = log_odds(p), np.array([1.0, 0.0])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-(w[0] * x + w[1])))
        e, v = q - y, q * (1 - q)
        g = np.array([(e * x).sum(), e.sum()]) + 20 * (w - [1.0, 0.0])
        h = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 20 * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return np.array([max(0.2, w[0]), w[1]])


def first_guess(feature: np.ndarray, sentence: np.ndarray, text: np.ndarray, labels: list[list[int]], k: int, everyday: int | None) -> np.ndarray:
    """Posteriors of sentences to begin with: words that nearly only occur in documents of one subject vote for it.

    What is said in documents of any subject, in languages with many labels or few, votes for none: it is daily life.
    """
    known = text[sentence] < len(labels)
    pairs = np.unique(np.stack([feature[known], text[sentence][known]]), axis=1)
    docs = np.bincount(pairs[0], minlength=1 << BITS)
    has = np.zeros((len(labels), k))
    for d, own in enumerate(labels):
        has[d, own] = 1
    by = np.stack([np.bincount(pairs[0], has[pairs[1], c], 1 << BITS) for c in range(k)], 1)
    share = by / np.maximum(1, docs)[:, None]
    if everyday is not None:
        share[:, everyday] = 0
    strength = np.where((share >= VOTE) & (docs >= VOTE_LEAST)[:, None], share - 0.5, 0.0)
    n = len(text)
    votes = np.stack([np.bincount(sentence, strength[feature, c], n) for c in range(k)], 1)
    p = np.full((n, k + 1), 0.02)
    best = votes.argmax(1)
    voted = votes[np.arange(n), best] > 0
    p[np.flatnonzero(voted), best[voted]] = 1.0
    if everyday is not None:
        p[~voted, everyday] = 1.0
    return p / p.sum(1, keepdims=True)


class Sample:
    """The labelled documents on the driver: their words, their labels, and the class counts that they give."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray, np.ndarray], labels: list[list[str]], passages: list[str], subjects: list[str]):
        self.feature, self.sentence, self.text = words
        self.subjects, self.k, self.n = subjects, len(subjects), len(words[2])
        index = {s: i for i, s in enumerate(subjects)}
        self.labels = [[index[s] for s in own if s in index] for own in labels]
        self.everyday = index.get(EVERYDAY)
        self.prior = np.full((len(labels), self.k + 1), 0.05)
        for d, own in enumerate(self.labels):
            self.prior[d, own] = 8.0 / max(1, len(own))
            if self.everyday is not None:
                self.prior[d, self.everyday] += 2.0
            self.prior[d, self.k] = 0.3
        self.passage_words = np.bincount(sentence_words(passages)[0], minlength=1 << BITS)

    def counts(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros((1 << BITS, self.k + 1))
        for c in range(self.k + 1):
            out[:, c] = np.bincount(self.feature, p[self.sentence, c], 1 << BITS)
        return out

    def weights(self, counts: np.ndarray) -> np.ndarray:
        counts = counts.copy()
        counts[:, self.k] += 3.0 * self.passage_words
        return complement_weights(counts).astype(np.float32)

    def expected(self, weights: np.ndarray) -> np.ndarray:
        scores = sentence_scores(weights, self.feature, self.sentence, self.n)
        return posteriors(scores, self.text, self.prior, 2)[0]

    def first_weights(self) -> np.ndarray:
        if not self.n:
            return self.weights(np.zeros((1 << BITS, self.k + 1)))
        p = first_guess(self.feature, self.sentence, self.text, self.labels, self.k, self.everyday)
        if self.passage_words.any():
            # Sentences made of words that hardly occur outside of the test passages.
            rare = (self.passage_words > 0) & (np.bincount(self.feature, minlength=1 << BITS) <= 12 + 0.002 * self.n)
            share = np.bincount(self.sentence, rare[self.feature], self.n) / np.maximum(1, np.bincount(self.sentence, minlength=self.n))
            p[share > 0.6] = np.eye(self.k + 1)[self.k]
        weights = self.weights(self.counts(p))
        for _ in range(ROUNDS - 1):
            weights = self.weights(self.counts(self.expected(weights)))
        return weights

    def calibrate(self, weights: np.ndarray) -> Model:
        """Each subject's posterior without knowledge of the label against the one with it."""
        model = Model(self.subjects, weights, np.array([[1.0] * self.k, [0.0] * self.k]))
        if self.n:
            told, blind = self.expected(weights), model.sentence_posteriors(self.feature, self.sentence, self.text, len(self.labels))
            model.calibration = np.stack([platt(blind[:, c], told[:, c]) for c in range(self.k)], 1)
        return model


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, words ARRAY<INT>, lengths ARRAY<INT>): hashed words of each non-blank document, and of each sentence their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            feature, sentence, text = sentence_words(texts)
            per_sentence = np.bincount(sentence, minlength=len(text)).astype(np.int32)
            words = list_array(pa.array(feature, pa.int32()), np.bincount(text, per_sentence, len(texts)).astype(np.int64))
            lengths = list_array(pa.array(per_sentence, pa.int32()), np.bincount(text, minlength=len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), words, lengths], names=["doc_id", "words", "lengths"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null").where(F.col("text").rlike("\\S"))
    return texts.mapInArrow(run, "doc_id bigint, words array<int>, lengths array<int>")


def decoded(words: pa.ListArray, lengths: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each word, sentence of each word, text of each sentence) of a batch of encoded documents."""
    feature, _ = list_parts(words)
    per_sentence, sentences = list_parts(lengths)
    per_sentence = per_sentence.to_numpy(zero_copy_only=False)
    return feature.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(per_sentence)), per_sentence), np.repeat(np.arange(len(sentences)), sentences)


def sampled(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[list[str]]]:
    """The bounded fitting sample: encoded documents with a label, those with the smallest hashes of their id."""
    key = F.xxhash64("doc_id")
    near = key <= F.lit(hash_bound(most, labels.count(), 8.0))
    per_doc = labels.where("doc_id is not null and subject is not null").where(near).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    top = per_doc.orderBy(key, "doc_id").limit(most)
    t = docs.join(F.broadcast(top), "doc_id").orderBy(key, "doc_id").select("words", "lengths", "subjects").toArrow().combine_chunks()  # at most ``most`` rows
    one = lambda c: t.column(c).combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type)
    words, lengths = one("words"), one("lengths")
    if isinstance(words, pa.ChunkedArray):
        words, lengths = words.chunk(0), lengths.chunk(0)
    return decoded(words, lengths), t.column("subjects").to_pylist()


def all_counts(docs: DataFrame, weights: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """The expected counts (word, class) of all documents under the weights, and their number of words.

    Each task sums its own documents' counts; a word has one row a task, and 2^BITS rows at most reach the driver.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    names = [f"c{c}" for c in range(k + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Model([""] * k, sent.value, np.zeros((2, k))), np.zeros((1 << BITS, k + 1))
        for batch in batches:
            feature, sentence, text = decoded(batch.column("words"), batch.column("lengths"))
            if len(feature):
                p = own.sentence_posteriors(feature, sentence, text, batch.num_rows)
                for c in range(k + 1):
                    total[:, c] += np.bincount(feature, p[sentence, c], 1 << BITS)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(total[at, c]) for c in range(k + 1))], names=["f", *names])

    rows = docs.mapInArrow(run, "f int, " + ", ".join(f"{c} double" for c in names)).groupBy("f").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((1 << BITS, k + 1))
    if rows.num_rows:
        out[rows.column("f").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in names], 1)
    return out, float(out.sum())


def fit(docs: DataFrame, labels: DataFrame, passages: list[str], subjects: list[str]) -> Model:
    """The model of encoded documents and their labels, some of them wrong; ``subjects`` in order."""
    sample = Sample(*sampled(docs, labels), passages, subjects)
    weights = sample.first_weights()
    for _ in range(ROUNDS_ALL if sample.n else 0):
        told = sample.counts(sample.expected(weights))
        rest, size = all_counts(docs, weights, sample.k)
        # All documents weigh alike whatever their number, so that they can't drown the labelled ones.
        weights = sample.weights(told + rest * min(1.0, WEIGHT_ALL * told.sum() / max(1.0, size)))
    return sample.calibrate(weights)


def subject_shares(docs: DataFrame, labels: DataFrame, areas: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, s ARRAY<STRUCT<subject, share, confidence>>) of each non-blank document row, in the order of the sorted
    subjects. Null and blank documents have no row, one without words has shares of zero; repeated rows give repeated rows.
    """
    subjects = sorted(r[0] for r in bounded(areas.select("subject").where("subject is not null").distinct(), 10_000, "subject_area"))
    # Only which words test passages are made of is kept, so their number has no bound.
    tests = [r[0] for r in passages.select("text").where("text is not null").toLocalIterator()]
    kept = written(encoded(docs))
    model = fit(kept, labels, tests, subjects)
    sent = docs.sparkSession.sparkContext.broadcast((subjects, model.weights, model.calibration))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind = Model(*sent.value), pa.list_(pa.float64())
        for batch in batches:
            share, confidence = own.judged(*decoded(batch.column("words"), batch.column("lengths")), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(share.tolist(), kind), pa.array(confidence.tolist(), kind)], names=["doc_id", "shares", "confidences"])

    names = F.array(*map(F.lit, subjects))
    return kept.mapInArrow(run, "doc_id bigint, shares array<double>, confidences array<double>").select("doc_id", F.arrays_zip(names.alias("subject"), F.col("shares").alias("share"), F.col("confidences").alias("confidence")).alias("s"))


def found(shares: DataFrame) -> DataFrame:
    """(doc_id, subject): every subject that more likely than not has a third of a document's sentences or more;
    ``everyday`` if there is no other."""
    subject = F.filter("s", lambda x: (x["confidence"] >= 0.5) & (x["subject"] != EVERYDAY))
    names = F.transform(subject, lambda x: x["subject"])
    return shares.select("doc_id", F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(EVERYDAY)))).alias("subject")).dropDuplicates(["doc_id", "subject"])


def composition(shares: DataFrame, docs: DataFrame) -> DataFrame:
    """(source, subject, n_docs): how many documents of each source have each subject."""
    kept = docs.select("doc_id", "source").dropDuplicates(["doc_id"])
    return found(shares).join(kept, "doc_id").groupBy("source", "subject").agg(F.count(F.lit(1)).alias("n_docs"))
