"""Exact byte-level BPE encoding of whole texts, at the cost of a dictionary look-up per word.

The pattern that splits text before the merges never lets a piece cross from a non-space to " x" (one blank between
two characters that are not white space): the blank always starts a new piece. So a text can be cut there, equal cuts
need to be encoded once, and the ids are those of the whole text.
"""
from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers

#: White space other than blank and line feed, by any Unicode version: texts that hold it are cut the careful way.
RARE_WHITE = re.compile(
    "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
#: Latin letters, full stops and commas, single line feeds: pieces never cross between these three.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
PLAIN_PART = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,]+|\n")


def cuts(text: str) -> list[str]:
    """The text cut before each safe blank. The cuts but the first are given without that blank."""
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts and " \n" not in text and "\n " not in text and not RARE_WHITE.search(text):
        return parts

    def black(c: str) -> bool:
        return not (c.isspace() or RARE_WHITE.match(c))

    joined = [[parts[0]]]
    for before, part in zip(parts, parts[1:]):
        if before and part and black(before[-1]) and black(part[0]):
            joined.append([part])
        else:
            joined[-1].append(part)
    return [" ".join(x) for x in joined]


class CutEncoder:
    """Encodes texts; `encode` maps a list of distinct strings to their ids, as little-endian 32-bit numbers each.

    `limit` bounds the cuts that a worker remembers (not what it encodes); over it, the memory starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 600_000):
        self.encode, self.limit = encode, limit
        self.spaced: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _learn(self, wanted: list[str]) -> list[bytes]:
        """Ids of whole cuts, by way of their parts where those are plain."""
        split = []
        for w in wanted:
            bare = w[1:] if w[0] == " " else w
            parts = PLAIN_PART.findall(bare)
            if not parts or sum(map(len, parts)) < len(bare) or "\n\n" in bare:
                parts = [w]
            elif bare is not w:
                parts[0] = f" {parts[0]}"
            split.append(parts)
        if len(self.parts) > self.limit:
            self.parts.clear()
        new = list({x for p in split for x in p if x not in self.parts})
        self.parts.update(zip(new, self.encode(new), strict=True))
        get = self.parts.__getitem__
        return [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in split]

    def raw(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids, as little-endian 32-bit numbers."""
        cut = [cuts(t) for t in texts]
        first = [c.pop(0) if c else "" for c in cut]
        for cache, wanted, blank in ((self.spaced, cut, " "), (self.first, [first], "")):
            if len(cache) > self.limit:
                cache.clear()
            new = list({x for c in wanted for x in c if x not in cache})
            cache.update(zip(new, self._learn([blank + x for x in new]) if blank else [
                self._learn([x])[0] if x else b"" for x in new], strict=True))
        get = self.spaced.__getitem__
        for f, c in zip(first, cut, strict=True):
            yield self.first[f] + b"".join(map(get, c))

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        for raw in self.raw(texts):
            yield np.frombuffer(raw, "<u4")


_ENCODERS: dict[tuple, object] = {}


def worker_keeps(key: tuple, make: Callable[[], object]) -> object:
    """One encoder for each Python worker, kept over its tasks."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = make()
    return _ENCODERS[key]


def forget() -> None:
    """Frees what a worker keeps, before a stage that needs its memory."""
    _ENCODERS.clear()


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def load_tokenizer(path: str | None = None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task on each core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return tok


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself if printable Latin-1, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


#: Characters whose classes no Unicode version changes: ASCII, Latin letters, common punctuation.
UNUSUAL = re.compile("[^ -~\nÀ-ÖØ-öø-ſ‘’“”–—…€«»¿¡]")
#: Two white characters in a row, among the usual ones.
GAPS = ("  ", "\n\n", " \n", "\n ")


class LibraryIds:
    """Ids as the tokenizers library gives them for a byte-level BPE file, special strings read as plain text.

    Where the file's merges are numbered in the order of their ids, tiktoken merges alike, several times faster. So
    it takes the texts of usual characters, for which both libraries split alike; the pattern's look-ahead is needed
    only where white space meets white space. Other texts, and other files, go to the tokenizers library itself.
    """

    def __init__(self, path: str | None = None):
        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.library = load_tokenizer(path)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        known = {t: i for t, i in vocabulary.items() if all(c in byte_of for c in t)}
        #: Bytes of each token.
        self.lengths = np.zeros(max(vocabulary.values()) + 2, np.int64)
        for t, i in known.items():
            self.lengths[i] = len(t)
        self.fast = self._same_merges(path, {bytes(map(byte_of.__getitem__, t)): i for t, i in known.items()})

    @staticmethod
    def _same_merges(path: str, ranks: dict[bytes, int]) -> tuple | None:
        """Encoders with and without look-ahead, or None if the file is not of the kind that they merge alike."""
        import tiktoken

        with open(path) as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"] or {}
        pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
        made = [model["vocab"][p] for p in pairs]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if (not plain or file["normalizer"] or made != sorted(set(made)) or len(ranks) != len(model["vocab"])
                or len(ranks) != len(made) + 256):
            return None
        simple = public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", "")
        return tuple(tiktoken.Encoding("file", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
                     for p in (public_tokenizers.PATTERN, simple))

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each whole text."""
        for text in texts:
            if self.fast is None or UNUSUAL.search(text):
                ids = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
            else:
                ids = self.fast[not any(g in text for g in GAPS)](text)
            yield np.array(ids, "<u4")


def library_ids(path: str | None = None) -> LibraryIds:
    return worker_keeps(("library", path), lambda: LibraryIds(path))


def slices(columns: list, rows: int = 256) -> Iterator[list[list]]:
    """Arrow columns as Python lists, some rows at a time, so that very long texts don't meet in memory."""
    for at in range(0, len(columns[0]), rows):
        yield [c.slice(at, rows).to_pylist() for c in columns]
