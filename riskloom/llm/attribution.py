"""Token counts per section: whole texts are encoded once, token spans are then joined to the sections' spans."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.common import mapped, table
from riskloom.llm.encoding import library_ids, slices

#: Where a token goes that covers characters of several sections.
RULES = ("first", "last", "most")


def spans(ids: np.ndarray, token_bytes: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character starts and ends of a whole text's tokens: their byte lengths summed, bytes mapped to characters.

    A token that holds some bytes of a character spans all of it.
    """
    ends = np.cumsum(token_bytes[ids])
    starts = ends - token_bytes[ids]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character each byte belongs to
    return character[starts], character[ends - 1] + 1


def line_ends(text: str) -> np.ndarray:
    """Sections of a text: its lines, each with its line feed. A text has one section at least."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array(ends, np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, ...]:
    """Tokens and crossing tokens of each section. Crossing tokens: a section of the rule's choice owns all of it.

    first / last: the section of its first / last character. most: the one with most of its characters, the earlier
    on a tie. Tokens that share one character (its bytes were split) count where the character is.
    """
    n = len(section_ends)
    first = np.minimum(np.searchsorted(section_ends, starts, side="right"), n - 1)
    last = np.maximum(first, np.minimum(np.searchsorted(section_ends, ends - 1, side="right"), n - 1))
    crossing = first != last
    owner = first if rule != "last" else last
    if rule == "most" and crossing.any():
        owner = first.copy()
        for i in np.flatnonzero(crossing):
            edges = np.concatenate([[starts[i]], section_ends[first[i]:last[i]], [ends[i]]])
            owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: str = "first",
                   path: str | None = None) -> DataFrame:
    """(key, section, start, n_chars, n_tokens, n_crossing) for each line of each whole text.

    The sum over a document's sections is its token count. Null and empty texts have one section without tokens.
    Null and repeated keys stay as they are; an empty table gives no rows; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = library_ids(path)
        for batch in batches:
            for keys, texts in slices(batch.columns):
                texts = [t or "" for t in texts]
                owners, parts = [], []
                for k, t, ids in zip(keys, texts, library.ids(texts), strict=True):
                    starts, ends = spans(ids, library.lengths, t)
                    cut = line_ends(t)
                    counts, crossing = attribute(starts, ends, cut, rule)
                    begin = np.concatenate([[0], cut[:-1]])
                    owners += [k] * len(cut)
                    parts.append(np.stack([np.arange(len(cut)), begin, cut - begin, counts, crossing]))
                yield pa.record_batch([pa.array(owners, batch.schema.field(0).type), *map(
                    pa.array, np.concatenate(parts, axis=1).astype(np.int64))],
                    [key, "section", "start", "n_chars", "n_tokens", "n_crossing"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).transform(mapped,
        run, f"`{key}` {kind}, section long, start long, n_chars long, n_tokens long, n_crossing long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_counts(table(spark, sf_dir, "documents"))
