"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The distinct words of a batch form a trie (in sorted order, so that a depth-first walk is a scan and
the path from the root is a stack). The state of a node is the last token of its prefix's encoding.
Since an encoding is right exactly if each two neighbouring tokens are what BPE makes of their joint
bytes, a node's last token is the one suffix token that is compatible with the state of the ancestor
where that token starts. Words share the states of their common prefixes; an encoding is read off by
walking back from the leaf, token by token.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import slices, table, whole_text

#: The public byte-level pattern that splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same cuts over texts of Latin letters, where the standard library's faster engine can make them;
#: a text with any character that SIMPLE_MISSES finds goes to the full pattern.
LETTER = "a-zA-ZÀ-ÖØ-öø-ÿ"
SIMPLE = rf""" ?[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+"""
SIMPLE_MISSES = r"[^ -~\n\tÀ-ÿ]"


#: Above any token's id.
PAIR = 1 << 32


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: bytes that print stand for themselves,
    the others for the code points from 256 on, in order."""
    printing = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder of one vocabulary file. The limits bound memory and change no result: a full memo
    of pairs is emptied and refilled; one of words is set aside, words that come again return from it, and the
    rest goes when the next one is full. With ``max_states`` the last tokens of short prefixes
    are kept from batch to batch; on prose that saves as much time as it costs."""

    def __init__(self, path: str, max_words: int = 120_000, max_pairs: int = 250_000, max_states: int = 0) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: raw(s) for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank = {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(a), raw(b)] = n
        self.longest = max(map(len, self.id_of))
        #: The token lengths to try at each depth, the usual ones first; only one token can fit.
        self.tries = [sorted(range(1, d + 1), key=lambda n: (abs(n - 2.9), n)) for d in range(self.longest + 1)]
        self.length = {i: len(b) for i, b in self.bytes_of.items()}
        full, simple, misses = regex.compile(SPLIT).findall, re.compile(SIMPLE).findall, re.compile(SIMPLE_MISSES).search
        self.split = lambda text: (full if misses(text) else simple)(text)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.forget()
        self.pairs: dict[int, bool] = {}  # by first x PAIR + second
        self.max_words, self.max_pairs, self.max_states = max_words, max_pairs, max_states

    def merged(self, word: bytes) -> list[int]:
        """Plain BPE: join the neighbours of lowest rank, leftmost first, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id_of[p] for p in parts]

    def compatible(self, first: int, second: int) -> bool:
        """Whether BPE leaves these two neighbours as they are. A first of -1 stands for the word's start."""
        known = self.pairs.get(first * PAIR + second)
        if known is None:
            both = [x for x in (first, second) if x >= 0]
            known = self.merged(b"".join(self.bytes_of[x] for x in both)) == both
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            self.pairs[first * PAIR + second] = known
        return known

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """The words' encodings, by a depth-first walk over their trie."""
        if len(self.states) >= self.max_states:
            self.states.clear()
        states, near = self.states, 10 if self.max_states else 0
        pairs, id_of, longest, length, tries = self.pairs, self.id_of, self.longest, self.length, self.tries
        last, path = [-1], b""  # last[d]: the last token of the encoding of path[:d]
        for word in sorted(words):
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                state = states.get(word[:depth]) if depth <= near else None
                if state is None:
                    for size in tries[min(depth, longest)]:
                        start = depth - size
                        state = id_of.get(word[start:depth])
                        if state is None:
                            continue
                        fits = pairs.get(last[start] * PAIR + state)
                        if fits or (fits is None and self.compatible(last[start], state)):
                            break
                    else:
                        raise ValueError(f"no token ends the prefix {word[:depth]!r}")
                    if depth <= near:
                        states[word[:depth]] = state
                last.append(state)
            path, ids, depth = word, [], len(word)
            while depth:
                ids.append(last[depth])
                depth -= length[last[depth]]
            yield word, ids[::-1]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Strings of special tokens become those tokens."""
        cut = []
        for text in texts:
            if self.cut and any(s in text for s in self.special):
                pieces = self.cut.split(text)
                pieces[::2] = map(self.split, pieces[::2])
                cut.append([w for p in pieces for w in ([p] if isinstance(p, str) else p)])
            else:
                cut.append(self.split(text))
        words, older = self.words, self.older
        new = []
        for word in set().union(*cut).difference(words):
            known = older.get(word)
            if known is None:
                new.append(word.encode("utf-8"))
            else:
                words[word] = known
        for word, ids in self.walk(new):
            words[word.decode("utf-8")] = array("i", ids).tobytes()
        found = [np.frombuffer(b"".join(map(words.__getitem__, parts)), np.int32) for parts in cut]
        if len(words) > self.max_words:
            self._empty(words)
        return found

    def _empty(self, older: dict[str, bytes]) -> None:
        #: The ids of words, as the bytes of 32-bit numbers: of the latest words, and of those before.
        self.words: dict[str, bytes] = {s: array("i", [i]).tobytes() for s, i in self.special.items()}
        self.older = older

    def forget(self) -> None:
        """Empties the memos of words and prefixes; what is known of pairs stays."""
        self._empty({})
        self.states: dict[bytes, int] = {}

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _bpe(path: str) -> TrieBpe:
    """One coder for each Python worker; its later tasks find what is known of pairs."""
    return TrieBpe(path)


def _coder(path: str, most_bytes: int = 3_000_000) -> Callable:
    def run(batches):
        bpe = _bpe(path)
        for batch in batches:
            doc_id, text = batch.column("doc_id"), batch.column("text")
            for part in slices(pc.binary_length(text).to_pylist(), most_bytes):
                ids = bpe.encode_batch(text[part.start : part.stop].to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                back = [bpe.decode(x.tolist()) for x in ids]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                columns = [doc_id[part.start : part.stop], lists, pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "token_ids", "decoded"])
        bpe.forget()  # the worker may go on to other work

    return run


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, token_ids and decoded (the ids' text again) of each row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file in the tokenizers library's JSON format, at the
    same place on each executor. Null text counts as empty and gives no ids. Rows stay as they come:
    repeated rows and null ids too; other columns are ignored. One pass, no shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
    return rows.mapInArrow(_coder(vocabulary), "doc_id long, token_ids array<int>, decoded string")


def op8_trie_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
