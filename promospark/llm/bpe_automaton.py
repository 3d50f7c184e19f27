"""Byte-level BPE as a deterministic automaton over tokens.

The automaton starts with one state and an arc for each byte. The merges are added
in order, each by a gadget: where token ``a`` and then ``b`` could be read, an arc
for the merged token leads past both, and ``b`` may no longer follow ``a``. What
may follow a token depends on that token alone, so states are last tokens. A new
token's state copies what may follow ``b`` at that time, and the arcs that lead to
it copy those of ``a``. Tables hold these copies as default rows: ``right`` names
the state copied from, ``left`` the arc copied from, ``born`` when, and
``banned`` the pairs that a gadget has taken away and when.

Each word has one path of valid arcs that spells it, found by transitions from
its start, the longest arcs first.
Decoding emits the arcs' labels, their bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promospark.llm.common import Remembered, ship_package, text_or_empty

#: The pattern that cuts text into words before the merges (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bounds of a worker's memory; work beyond them is done anew, not left out.
CACHED_WORDS = 400_000
WORDS_AT_ONCE = 100_000
CACHED_ARCS = 1_000_000


def byte_symbols() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary: printable ones for
    themselves, the others by characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def disputed_characters() -> dict[int, str]:
    """Characters that the two pattern libraries class by different Unicode versions,
    each with one that stands for its class in the tokenizers library."""
    from tokenizers.pre_tokenizers import ByteLevel
    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    of_pattern = dict.fromkeys(map(ord, regex.findall(r"\p{L}", every)), "L")
    of_pattern |= dict.fromkeys(map(ord, regex.findall(r"\p{N}", every)), "N")
    found = {}
    for c in map(ord, every):
        kind = unicodedata.category(chr(c))[0]
        if of_pattern.get(c, "-") != (kind if kind in "LN" else "-"):
            found[c] = next((x for x in "a1" if len(cut(x + chr(c))) == 1), "!")
    return found


class TokenAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        symbols = byte_symbols()
        size = max([*vocab.values(), *special.values()], default=-1) + 1
        self.labels: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.labels[i] = bytes(symbols[c] for c in token)
        for token, i in special.items():
            self.labels[i] = token.encode()
        self.left, self.right = list(range(size)), list(range(size))
        self.born = [-1] * size
        self.banned: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.by_label = {bytes([b]): vocab[c] for c, b in symbols.items() if c in vocab}
        for time, (a, b) in enumerate(merges):
            self._add_gadget(time, vocab[a], vocab[b], vocab[a + b])
        self.longest = max(map(len, self.by_label), default=1)
        self.special = special
        self.special_pattern = re.compile("(" + "|".join(
            re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.words = regex.compile(WORDS)
        self.stand_ins = disputed_characters()
        self.disputed = frozenset(map(chr, self.stand_ins))
        self.paths = _Paths(self)
        self.first_chunks, self.later_chunks = _Chunks(self, ""), _Chunks(self, " ")

    def _add_gadget(self, time: int, a: int, b: int, merged: int) -> None:
        if not self._follows(a, b):
            return  # no path reads a and then b any more
        self.left[merged], self.right[merged], self.born[merged] = a, b, time
        self.banned[a, b] = time
        if a == b:  # merged from the left: a run of three is the merged token and then one
            self.banned[a, merged] = time
        self.by_label[self.labels[merged]] = merged

    def _follows(self, u: int, v: int) -> bool:
        """Whether token v has an arc from the state of token u."""
        before = len(self.banned) * 2 + 1
        banned, born = self.banned, self.born
        while True:
            if banned.get((u, v), before) < before:
                return False
            bu, bv = born[u], born[v]
            if bu < 0 and bv < 0:
                return True
            before = max(bu, bv)
            if bu == before:
                u = self.right[u]
            if bv == before:
                v = self.left[v]

    def arc(self, u: int, v: int) -> bool:
        known = self.arcs.get((u, v))
        if known is None:
            if len(self.arcs) >= CACHED_ARCS:
                self.arcs.clear()
            known = self.arcs[u, v] = self._follows(u, v)
        return known

    def path(self, word: bytes) -> tuple[int, ...]:
        """The tokens on the one valid path that spells ``word``.

        From each place the longest arcs are tried first. The valid path to a place is
        unique, so a place from which the end can't be reached is left for good.
        """
        n, by_label, longest, arcs = len(word), self.by_label.get, self.longest, self.arcs.get
        tokens, ends, dead, last, i = [], [], set(), -1, 0
        j = n if n < longest else longest  # the next end to try from place i
        while True:
            while j > i:
                token = by_label(word[i:j])
                if token is not None and j not in dead:
                    if last < 0:
                        break
                    valid = arcs((last, token))
                    if self.arc(last, token) if valid is None else valid:
                        break
                j -= 1
            if j > i:
                tokens.append(token)
                ends.append(j)
                if j == n:
                    return tuple(tokens)
                last, i = token, j
                j = n if n - i < longest else i + longest
            elif not tokens:
                if n == 0:
                    return ()
                raise ValueError("no path: a byte is missing from the vocabulary")
            else:
                dead.add(ends.pop())
                tokens.pop()
                last, j, i = (tokens[-1], i - 1, ends[-1]) if tokens else (-1, i - 1, 0)

    def _pieces(self, text: str) -> Iterator[str]:
        return (p for p in self.special_pattern.split(text) if p) if self.special_pattern else iter([text] if text else [])

    def encode_parts(self, text: str) -> Iterator[list[int]]:
        """The ids of ``text``, some words at a time."""
        for piece in self._pieces(text):
            if piece in self.special:
                yield [self.special[piece]]
                continue
            classed = piece
            if not piece.isascii() and not self.disputed.isdisjoint(piece):
                classed = piece.translate(self.stand_ins)
            if classed is piece and len(piece) < 8 * WORDS_AT_ONCE:
                yield list(chain.from_iterable(map(self.paths.__getitem__, self.words.findall(piece))))
                continue
            found = (piece[m.start():m.end()] for m in self.words.finditer(classed))
            while some := list(islice(found, WORDS_AT_ONCE)):
                yield list(chain.from_iterable(map(self.paths.__getitem__, some)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_parts(text)))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def emitted(self, ids: tuple[int, ...] | list[int]) -> tuple[str, int, bytes]:
        """Ids as text, their number, and the labels that they emit."""
        return ",".join(map(str, ids)), len(ids), self.decode_bytes(ids)

    def _emitted_parts(self, text: str) -> Iterator[list[tuple[str, int, bytes]]]:
        if self._plain(text):
            try:
                yield self._by_chunks(text)
                return
            except _NotPlain:
                pass
        for ids in self.encode_parts(text):
            if ids:
                yield [self.emitted(ids)]

    def _plain(self, text: str) -> bool:
        return bool(text) and len(text) < 8 * WORDS_AT_ONCE and not any(s in text for s in self.special) and (
            text.isascii() or self.disputed.isdisjoint(text))

    def _by_chunks(self, text: str) -> list[tuple[str, int, bytes]]:
        """Lines of words with one space between them need no pattern: a word's
        paths do not depend on its neighbours, and a line end is a word."""
        out: list[tuple[str, int, bytes]] = []
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if k:
                out.append(self.later_chunks.line_end)
            out.append(self.first_chunks[first])
            out += map(self.later_chunks.__getitem__, rest)
        return out

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of what they decode to."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for parts in self._emitted_parts(text):
            ids, counts, labels = zip(*parts)
            ids_hash.update((("," if n else "") + ",".join(ids)).encode())
            n += sum(counts)
            text_hash.update(decoder.decode(b"".join(labels)).encode())
        text_hash.update(decoder.decode(b"", True).encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


class _NotPlain(Exception):
    """White space that the pattern has to see in its context."""


class _Chunks(Remembered):
    """What the chunks between spaces emit, behind ``lead``."""

    def __init__(self, automaton: TokenAutomaton, lead: str):
        super().__init__(CACHED_WORDS)
        self.automaton, self.lead = automaton, lead
        self.space = regex.compile(r"\s")
        self.line_end = automaton.emitted(automaton.path(b"\n"))

    def make(self, chunk: str) -> tuple[str, int, bytes]:
        if not chunk or self.space.search(chunk):
            raise _NotPlain
        a = self.automaton
        return a.emitted([i for word in a.words.findall(self.lead + chunk) for i in a.path(word.encode())])


class _Paths(Remembered):
    """Paths of the words met lately."""

    def __init__(self, automaton: TokenAutomaton):
        super().__init__(CACHED_WORDS // 4)
        self.automaton = automaton

    def make(self, word: str) -> tuple[int, ...]:
        return self.automaton.path(word.encode())


_COMPILED: dict[str, TokenAutomaton] = {}


def compile_automaton(path: str) -> TokenAutomaton:
    """The automaton of a byte-level BPE file; kept per process."""
    if path not in _COMPILED:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        if (model["type"] != "BPE" or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut["add_prefix_space"]
                or not cut["use_regex"] or model.get("ignore_merges") or model.get("end_of_word_suffix")):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        _COMPILED[path] = TokenAutomaton(model["vocab"], merges, special)
    return _COMPILED[path]


def _digester(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_automaton(path)
        for batch in batches:
            rows = [automaton.digests(t) for t in batch.column("body").to_pylist()]
            n, ids, text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row; null text counts as empty."""
    ship_package(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("body"))
            .mapInArrow(_digester(tokenizer_path),
                        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"))


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_automaton(path)
        for batch in batches:
            ids = [automaton.encode(t) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["doc_id", "ids"])
    return run


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) per row."""
    ship_package(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("body"))
            .mapInArrow(_encoder(tokenizer_path), "doc_id bigint, ids array<int>"))


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_automaton(path)
        for batch in batches:
            texts = [None if ids is None else automaton.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])
    return run


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text per row of ``encode``'s result; null ids give null text."""
    ship_package(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(tokenizer_path), "doc_id bigint, text string")
