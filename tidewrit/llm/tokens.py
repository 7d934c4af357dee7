"""Problem 8: exact token ids of a whole corpus by a public byte-level BPE tokenizer.

The JVM splits each text into pieces with the tokenizer's pattern; a batch's pieces are dictionary-encoded by
Arrow and only distinct pieces are encoded. A piece is encoded by dynamic programming over its prefixes: every
prefix of a byte string has exactly one last token in its BPE encoding. Candidates for it are the vocabulary
tokens that end at the prefix, found by walking an automaton of all vocabulary suffixes backwards from that
position; the one that is compatible with the last token of the remaining prefix is stored. Following the stored
tokens back from the end gives the ids. Two tokens are compatible if BPE leaves their concatenation as these two.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Memo, list_array, list_parts, ragged_take

#: Where the public vocabulary files are; a parameter, the files are never copied.
TOKENIZERS = "/opt/tokenizers"
#: The public pre-tokenizer pattern of byte_bpe_50k (fixed values).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


class PrefixEncoder:
    """Encodes one piece; ``ranks`` maps token bytes to id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = {i: len(t) for t, i in ranks.items()}
        self.token = {i: t for t, i in ranks.items()}
        # The automaton of suffixes: state 0 is the empty suffix, edges prepend a byte, final[state] is a token's id.
        self.edges: dict[int, int] = {}
        self.final = [-1]
        for t, i in ranks.items():
            state = 0
            for b in reversed(t):
                nxt = self.edges.get(state << 8 | b)
                if nxt is None:
                    nxt = self.edges[state << 8 | b] = len(self.final)
                    self.final.append(-1)
                state = nxt
            self.final[state] = i
        self.compatible = Memo(self._compatible, 1_000_000)

    def _merge(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, pair: tuple[int, int]) -> bool:
        a, b = self.token[pair[0]], self.token[pair[1]]
        return self._merge(a + b) == [a, b]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None and self.reachable(whole):
            return [whole]
        last = [-1] * (len(data) + 1)
        edges, final, compatible, size = self.edges, self.final, self.compatible, self.size
        for end in range(1, len(data) + 1):
            state, start = 0, end
            found = []
            while start:
                state = edges.get(state << 8 | data[start - 1], -1)
                if state < 0:
                    break
                start -= 1
                if final[state] >= 0:
                    found.append((start, final[state]))
            for start, t in reversed(found):  # longer tokens first
                if (self.reachable(t) if start == 0 else compatible[last[start], t]):
                    last[end] = t
                    break
        ids, end = [], len(data)
        while end:
            ids.append(last[end])
            end -= size[last[end]]
        return ids[::-1]

    def reachable(self, token: int) -> bool:
        """Whether BPE makes this token of its own bytes; asked of a piece that starts with it."""
        return self.compatible[token, -1] if (token, -1) in self.compatible else self._remember(token)

    def _remember(self, token: int) -> bool:
        t = self.token[token]
        self.compatible[token, -1] = self._merge(t) == [t]
        return self.compatible[token, -1]


_loaded: dict[str, tuple[PrefixEncoder, Memo]] = {}


def encoder(path: str) -> tuple[PrefixEncoder, Memo]:
    """The encoder of a rank file and its memo of pieces, made once per Python worker."""
    if path not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
        e = PrefixEncoder(ranks)
        _loaded[path] = e, Memo(lambda piece: e.encode(piece.encode()), 300_000)
    return _loaded[path]


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, ids ARRAY<INT>) of each row, without special tokens; an empty list for a null or empty text.

    Names of special tokens in a text are ordinary text. Rows stay as they are (repeated ids stay repeated). Texts
    with characters that this JVM's Unicode tables don't know are split by Python's newer tables instead.
    """
    path = os.path.join(folder, f"{name}.tiktoken")
    text = F.col(text_col)
    unknown = text.rlike(r"\p{Cn}")
    pieces = df.select(
        F.col(id_col).alias(id_col),
        F.when(~unknown, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("pieces"),
        F.when(unknown, text).alias("odd"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        _, memo = encoder(path)
        for batch in batches:
            values, lengths = list_parts(batch.column("pieces"))
            coded = values.dictionary_encode()
            each = [memo[p] for p in coded.dictionary.to_pylist()]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.fromiter((i for ids in each for i in ids), np.int32, int(sizes.sum()))
            starts = np.zeros(len(each), np.int64)
            np.cumsum(sizes[:-1], out=starts[1:]) if len(each) else None
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n_of = sizes[index] if len(each) else np.zeros(0, np.int64)
            out = ragged_take(flat, starts[index], n_of) if len(each) else flat
            ends = np.zeros(len(n_of) + 1, np.int64)
            np.cumsum(n_of, out=ends[1:])
            bounds = np.zeros(len(lengths) + 1, np.int64)
            np.cumsum(lengths, out=bounds[1:])
            per_row = ends[bounds[1:]] - ends[bounds[:-1]]
            odd = batch.column("odd")
            if odd.null_count < len(odd):
                split = np.split(out, np.cumsum(per_row)[:-1])
                for k, t in enumerate(odd.to_pylist()):
                    if t is not None:
                        split[k] = np.array([i for p in own.findall(t) for i in memo[p]], np.int32)
                per_row = np.fromiter(map(len, split), np.int64, len(split))
                out = np.concatenate(split)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), list_array(pa.array(out, pa.int32()), per_row)], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return pieces.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
