"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of all words that a batch has not met before stand in one flat array. A round looks every adjacent pair up
by binary search over the sorted pair keys, finds the lowest rank of each word, and merges that pair everywhere in the
word. Words longer than ``LONG_WORD`` symbols are merged with a heap, which costs n log n for one word.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexaline.llm.memory import give_back

#: Words of more symbols than this are merged one by one with a heap.
LONG_WORD = 200
#: Words whose encoding a worker remembers at most; then it forgets all and starts again. Stages that share their workers
#: with others remember less than a query that encodes alone.
CACHE = 100_000
LARGE_CACHE = 400_000
#: Characters of text whose new words are merged together.
GROUP_CHARS = 300_000
#: Rows with token ids that leave a worker at a time.
ROWS_OUT = 100

RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer file's BPE with word ends over bytes: NFC, one space for white space, lower case, split into words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: s for s, i in (self.vocab | self.special).items()}
        self.split = regex.compile(next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.inner = np.array([self.vocab[c] for c in alphabet], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in alphabet], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = max(self.vocab.values()) + 1
        keys = np.array([self.vocab[a] * self.base + self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.by_pair = {int(k): (r, int(m)) for r, (k, m) in enumerate(zip(keys.tolist(), made.tolist()))}
        #: Of each known piece of text: number of tokens, the ids as text, the tokens as text.
        self.known: dict[str, tuple[int, str, str]] = {}
        self.cache = CACHE

    def pieces(self, text: str) -> list[str]:
        """The text between white space, in order, special tokens as pieces of their own; no word spans two pieces."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        found: list[str] = []
        for part in parts:
            if part in self.special:
                found.append(part)
            elif part:
                plain = part if part.isascii() else unicodedata.normalize("NFC", part)
                # each character by itself is put in lower case: no final sigma
                plain = plain.replace("Σ", "σ").lower()
                # str.split() also cuts at these four, which the tokenizer takes as symbols
                found += [p for p in regex.split(r"[^\S\x1c-\x1f]+", plain) if p] if any(c in plain for c in "\x1c\x1d\x1e\x1f") else plain.split()
        return found

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, all words merged together round by round."""
        out: list[list[int]] = [[] for _ in words]
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG_WORD]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._merge_long(w)
        if not short:
            return out
        lengths = np.array([len(words[i]) for i in short])
        raw = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(short)), lengths)
        none = len(self.keys)
        while len(symbols):
            same = owner[:-1] == owner[1:]
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.full(len(symbols), none)
            rank[:-1] = np.where(same & (self.keys[at] == key), self.ranks[at], none)
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            done = best == none
            if done.any():  # words that nothing merges any more leave the array
                leave = np.repeat(done, size)
                for i, a, n in zip(owner[first[done]].tolist(), first[done].tolist(), size[done].tolist()):
                    out[short[i]] = symbols[a : a + n].tolist()
                keep = ~leave
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                at = np.append(at, 0)[keep]
                best, size = best[~done], size[~done]
                if not len(symbols):
                    break
            else:
                at = np.append(at, 0)
            hit = rank == np.repeat(best, size)
            where = np.flatnonzero(hit)
            # in a run of one symbol the pairs overlap: every second one counts, from the left
            start = np.concatenate(([True], np.diff(where) > 1))
            nth = np.arange(len(where)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            where = where[nth % 2 == 0]
            symbols[where] = self.made[at[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        raw = np.frombuffer(word, np.uint8)
        symbols = self.inner[raw].tolist()
        symbols[-1] = int(self.last[raw[-1]])
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (found := self.by_pair.get(symbols[i] * self.base + symbols[j])):
                heap.append((found[0], i, symbols[i] * self.base + symbols[j])) if not started else heapq.heappush(heap, (found[0], i, symbols[i] * self.base + symbols[j]))

        started = False
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        started = True
        while heap:
            _, i, key = heapq.heappop(heap)
            j = right[i] if symbols[i] >= 0 else n
            if j >= n or symbols[i] * self.base + symbols[j] != key:
                continue
            symbols[i], symbols[j] = self.by_pair[key][1], -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [s for s in symbols if s >= 0]

    def _learn(self, texts: list[list[str]]) -> None:
        """Encode the pieces that are not known yet, all their new words together."""
        if len(self.known) > self.cache:
            self.known.clear()
        fresh = {p for pieces in texts for p in pieces}.difference(self.known)
        new, mixed = set(), []
        for piece in fresh:
            if piece in self.special:
                self.known[piece] = (1, str(self.special[piece]), piece)
            elif piece.isascii() and piece.isalpha():
                new.add(piece)
            elif len(words := self.split.findall(piece)) == 1 and words[0] == piece:
                new.add(piece)
            else:
                new.update(words)
                mixed.append((piece, "\n".join(words)))
        new = list(new.difference(self.known))
        for word, ids in zip(new, self.merge_words([w.encode("utf-8", "replace") for w in new])):
            self.known[word] = (len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]))
        for piece, words in mixed:
            entries = [self.known[w] for w in words.split("\n") if w]
            self.known[piece] = (sum([e[0] for e in entries]), " ".join([e[1] for e in entries]), " ".join([e[2] for e in entries]))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        found = []
        for group in self._groups(texts):
            for pieces in group:
                ids = " ".join([e[1] for p in pieces if (e := self.known[p])[0]])
                found.append(np.array(ids.split(), np.int32))
        return found

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a space: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of tokens, digest of the ids, digest of the decoded text) of each text."""
        found = []
        for group in self._groups(texts):
            known = self.known
            for pieces in group:
                entries = [e for p in pieces if (e := known[p])[0]]
                ids = " ".join([e[1] for e in entries])
                text = " ".join([e[2] for e in entries])
                found.append((sum([e[0] for e in entries]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return found

    def _groups(self, texts: list[str]):
        """The pieces of each text, some texts at a time, once all of them are known."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < GROUP_CHARS:
                group.append(self.pieces(texts[at]))
                size += len(texts[at])
                at += 1
            self._learn(group)
            yield group


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The tokenizer of a file, read once by each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encoded(docs: DataFrame, keep: list[str], path: str, text_col: str = "text") -> DataFrame:
    """Rows (keep, n_tokens, input_ids, decoded): token ids of every text and what they decode to.

    Null and empty texts have no tokens; repeated rows come back as often as they occur, columns that aren't kept are left
    out, an empty table stays empty. Batches leave ``ROWS_OUT`` rows at a time, which bounds a worker's memory.
    """
    fields = [docs.schema[c] for c in keep]
    schema = StructType([*fields, *StructType.fromDDL("n_tokens bigint, input_ids array<int>, decoded string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        bpe.cache = CACHE
        batch = part = ids = sizes = offsets = lists = decoded = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                ids = bpe.encode_all([t or "" for t in part.column(len(keep)).to_pylist()])
                sizes = np.array([len(i) for i in ids], np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                decoded = pa.array([bpe.decode(i.tolist()) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(sizes), lists, decoded], names=schema.names)
        # the worker lives on, for other stages
        bpe.known.clear()
        del batch, part, ids, sizes, offsets, lists, decoded
        give_back()

    return docs.select(*keep, text_col).mapInArrow(run, schema)


def round_trip(texts: Column, path: str) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of every text; null and empty texts have no tokens."""

    @F.pandas_udf(RESULT)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        bpe.cache = LARGE_CACHE
        for batch in batches:
            yield pd.DataFrame(bpe.digests([t or "" for t in batch]), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(texts)
