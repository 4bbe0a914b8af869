"""Byte-level BPE by a sentencepiece model that is written straight from the rank file.

Pieces are the vocabulary's byte strings mapped to printable characters, scored by negative rank, with identity
normalisation: joining the best-scored pair of neighbours first is then joining the lowest rank first.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.common import mapped, table
from riskloom.llm.encoding import CutEncoder, as_bytes, byte_alphabet, slices, worker_keeps

UNKNOWN = "<unk>"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


ALPHABET = byte_alphabet()
TO_PIECE = {b: c for b, c in enumerate(ALPHABET)}


def as_piece(raw: bytes) -> str:
    return raw.decode("latin-1").translate(TO_PIECE)


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in rank order."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def sentencepiece_model(vocabulary: list[bytes]) -> bytes:
    """A serialised BPE model whose piece i is the vocabulary's i-th byte string; the unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for rank, raw in enumerate(vocabulary):
        model.pieces.add(piece=as_piece(raw), score=-float(rank))
    model.pieces.add(piece=UNKNOWN, score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type = pb.TrainerSpec.BPE
    spec.vocab_size = len(vocabulary) + 1
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(vocabulary), -1, -1, -1
    spec.unk_piece = UNKNOWN
    spec.treat_whitespace_as_suffix = False
    norm = model.normalizer_spec
    norm.name = "identity"
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes texts piece by piece of the pattern, and decodes ids by the inverse mapping."""

    def __init__(self, path: str | None = None, pattern: str = public_tokenizers.PATTERN):
        import regex
        import sentencepiece

        self.vocabulary = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.vocabulary))
        self.split = regex.compile(pattern).findall
        # A piece that is in the vocabulary is one token, whatever its merges would give.
        self.whole = {raw: i for i, raw in enumerate(self.vocabulary)}
        self.numbers = [str(i) for i in range(len(self.vocabulary))]
        self.encoder = CutEncoder(self._encode_cuts)

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        merged = iter(self.model.encode([as_piece(p) for p in pieces if p not in self.whole], num_threads=1))
        return [as_bytes([self.whole[p]] if p in self.whole else next(merged)) for p in pieces]

    def _encode_cuts(self, new: list[str]) -> list[bytes]:
        split = [[p.encode() for p in self.split(x)] for x in new]
        pieces = list({p for ps in split for p in ps})
        codes = dict(zip(pieces, self._encode_pieces(pieces), strict=True))
        return [b"".join([codes[p] for p in ps]) for ps in split]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for ids in self.encoder.ids(texts):
            yield ids.tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def worker_codec(path: str | None) -> Codec:
    return worker_keeps(("codec", path), lambda: Codec(path))


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every whole text. Null and empty texts have no ids; null keys stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path)
        for batch in batches:
            for keys, texts in slices(batch.columns):
                yield pa.record_batch([pa.array(keys, batch.schema.field(0).type), pa.array(
                    list(codec.encode([t or "" for t in texts])), pa.list_(pa.int32()))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).transform(mapped, run, f"`{key}` {kind}, ids array<int>")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and checksums of ids and of decoded bytes, without moving the ids. Null and empty texts: no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for keys, texts in slices(batch.columns):
                rows = [(len(ids), sha(" ".join(map(codec.numbers.__getitem__, ids)).encode()),
                         sha(codec.decode(ids))) for ids in codec.encode([t or "" for t in texts])]
                n, coded, decoded = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(coded),
                                       pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").transform(mapped, run, SCHEMA)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
