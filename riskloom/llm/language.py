"""Language identification by unigram models of a public vocabulary's pieces, summed over all segmentations.

Training counts the pieces of each language's words; the models are tables of piece probabilities. The likelihood of
a word is the sum over every way to cut it into pieces of the vocabulary (forward algorithm), that of a text the
product over its words; the prediction is the language of greatest posterior under equal priors.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskloom.llm.common import mapped, spare, table
from riskloom.llm.encoding import slices, worker_keeps
from riskloom.llm.hashing import BASE, mix, powers

UNKNOWN = "und"
#: Added to every count, so that no piece is impossible in any language.
SMOOTHING = 0.1
#: Positions of a run of letters that are looked up at once.
BLOCK = 512
#: Positions after which forward sums are scaled, so that they stay within a double.
SCALED = 8
#: Numbers that the forward sums of one group of words may hold.
CELLS = 1_000_000
#: A text is not in a language if a letter of it is explained worse than the median of that language's labelled texts
#: by more than FAR times the distance of their lowest share LOWEST, and by more than NATS.
LOWEST, FAR, NATS = 0.001, 2.0, 1.0
#: The word start that the vocabulary marks.
START = "▁"
#: Tokens a worker remembers the scores of, and their characters.
REMEMBERED, REMEMBERED_CHARS = 500_000, 32_000_000
_LETTERS = re.compile(r"[^\W\d_]+")


def tokens_of(text: str) -> list[str]:
    """What white space, full stops and commas separate, lower-cased: few distinct strings, quickly counted."""
    return text.lower().replace(".", " ").replace(",", " ").split()


def words_of(token: str) -> list[str]:
    """The runs of letters in a token, whole; the start mark stands before each run."""
    return [START + run for run in _LETTERS.findall(token)]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and how many each has."""
    return (np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"),
            np.fromiter(map(len, texts), np.int64, len(texts)))


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + BASE) * up[:len(codes)], out=sums[1:])
    return sums, down


class Vocabulary:
    """The pieces of a sentencepiece file. Letters that no piece covers get one number for all of them."""

    def __init__(self, path: str | None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(
            "piece_bpe_32k.model"))
        n = self.model.get_piece_size()
        self.pieces = {self.model.id_to_piece(i): i for i in range(n) if not (
            self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))}
        self.size, self.other = n + 1, n
        # Hashes of every beginning of a piece, sorted, with its number if it is a piece itself, else -1.
        beginnings = {piece[:j]: -1 for piece in self.pieces for j in range(1, len(piece))} | self.pieces
        texts = sorted(beginnings)
        codes, lengths = _codes(texts)
        sums, down = _sums(codes)
        first = np.cumsum(lengths) - lengths
        hashes = (sums[first + lengths] - sums[first]) * down[first]
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.array([beginnings[t] for t in texts])[order]
        self.longest = int(lengths.max())

    def counts(self, words: Counter) -> Counter:
        """How often each piece occurs in the vocabulary's own segmentation of the words."""
        found: Counter = Counter()
        keys = list(words)
        # The file marks word starts itself.
        for w, parts in zip(keys, self.model.encode([k.removeprefix(START) for k in keys], out_type=str), strict=True):
            for p in parts:
                found[self.pieces.get(p, self.other)] += words[w]
        return found

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(end, word, start, piece) of every piece found in every word, and of single uncovered letters.

        All words at once, by length: a substring goes on growing while it begins some piece. Substrings are looked up
        by 64-bit hashes.
        """
        codes, lengths = _codes(words)
        sums, down = _sums(codes)
        word = np.repeat(np.arange(len(words)), lengths)
        start = np.arange(len(codes)) - (np.cumsum(lengths) - lengths)[word]
        room = lengths[word] - start
        at, found = np.arange(len(codes)), []
        for n in range(1, self.longest + 1):
            hashes = (sums[at + n] - sums[at]) * down[at]
            k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[k] == hashes
            piece = np.where(known, self.numbers[k], -1)
            if n == 1:
                found.append((at, np.where(piece < 0, self.other, piece), n))
            else:
                found.append((at[piece >= 0], piece[piece >= 0], n))
            at = at[known & (room[at] > n)]
            if not len(at):
                break
        place = np.concatenate([p for p, _, _ in found])
        size = np.repeat([n for _, _, n in found], [len(p) for p, _, _ in found])
        return start[place] + size, word[place], start[place], np.concatenate([x for _, x, _ in found])


@dataclass(frozen=True)
class Model:
    """Piece probabilities (pieces x languages) and the languages, sorted by name."""

    languages: tuple[str, ...]
    probabilities: np.ndarray


class Scorer:
    """Log-likelihoods of tokens under each language, remembered by token."""

    def __init__(self, model: Model, path: str | None):
        self.model, self.vocabulary = model, Vocabulary(path)
        self.known: dict[str, int] = {}
        self.chars = 0
        self.scores = np.zeros((0, len(model.languages)))
        self.letters = np.zeros(0, np.int64)

    def forward(self, words: list[str]) -> np.ndarray:
        """log P(word) for each language, summed over all segmentations of the whole word, however long."""
        out = np.zeros((len(words), len(self.model.languages)))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            # Words of about one length go together, as many as the sums of the longest of them leave room for.
            width = (np.minimum(lengths[order[at:at + CELLS]], BLOCK) + self.vocabulary.longest + 1) * out.shape[1]
            n = max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), CELLS, "right")))
            group = order[at:at + n]
            out[group] = self._forward([words[i] for i in group], lengths[group])
            at += n
        return out

    def _forward(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        """Of words sorted by length: alpha[j] = sum over pieces that end at j of alpha[start] * P(piece).

        Only the sums that a piece can still start from are kept: words go by in blocks of positions, each with the
        letters before it that a piece may begin with. Every few positions all kept sums of a word are divided by the
        newest, and its logarithm is carried; every position ends some piece (a letter without one counts as `other`),
        so the newest is never 0.
        """
        back = self.vocabulary.longest
        last = int(lengths[-1])
        out = np.zeros((len(words), len(self.model.languages)))
        carried = np.zeros_like(out)
        # Column back holds position `base`; the ones before it hold the positions before.
        alpha = np.zeros((len(words), back + min(last, BLOCK) + 1, out.shape[1]))
        alpha[:, back] = 1
        for base in range(0, last, BLOCK):
            if base:
                alpha[:, :back + 1] = alpha[:, BLOCK:BLOCK + back + 1]
                alpha[:, back + 1:] = 0
            live = int(np.searchsorted(lengths, base, "right"))
            from_ = max(0, base - back)
            end, word, start, piece = self.vocabulary.edges([w[from_:base + BLOCK] for w in words[live:]])
            new = end > base - from_
            end, word, start, piece = end[new], word[new] + live, start[new], piece[new]
            order = np.lexsort((word, end))
            word, start, piece = word[order], start[order] + from_ - base + back, piece[order]
            stop = min(last - base, BLOCK)
            edges = np.searchsorted(end[order], base - from_ + np.arange(1, stop + 2))
            for j in range(1, stop + 1):
                a, b = edges[j - 1], edges[j]
                w = word[a:b]
                terms = alpha[w, start[a:b]] * self.model.probabilities[piece[a:b]]
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                alpha[w[first], back + j] = np.add.reduceat(terms, first)
                ends = slice(*np.searchsorted(lengths, [base + j, base + j + 1]))
                out[ends] = np.log(alpha[ends, back + j]) + carried[ends]
                if j % SCALED == 0 and ends.stop < len(words):
                    newest = alpha[ends.stop:, back + j].copy()
                    carried[ends.stop:] += np.log(newest)
                    alpha[ends.stop:, j:back + j + 1] /= newest[:, None]
        return out

    def learn(self, tokens: list[str]) -> None:
        """Scores of tokens that were not met before."""
        words = [words_of(t) for t in tokens]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        logs = self.forward(list(distinct))
        scores = np.zeros((len(tokens), len(self.model.languages)))
        at = np.repeat(np.arange(len(tokens)), [len(ws) for ws in words])
        np.add.at(scores, at, logs[[distinct[w] for ws in words for w in ws]])
        base = len(self.known)
        self.known.update(zip(tokens, range(base, base + len(tokens)), strict=True))
        self.scores = np.concatenate([self.scores, scores])
        self.letters = np.concatenate([self.letters, np.array([sum(map(len, ws)) for ws in words], np.int64)])
        self.chars += sum(map(len, tokens))

    def predict(self, texts: list[str]) -> Iterator[tuple[str, float, float | None, int]]:
        """(language, posterior, log-likelihood a letter, letters) of each whole text, word marks counted as letters.

        `und`, 0, null and 0 for texts without a letter.
        """
        counted = [Counter(tokens_of(t)) for t in texts]
        new = set().union(*counted)
        if len(self.known) + len(new) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.known, self.scores, self.letters, self.chars = {}, self.scores[:0], self.letters[:0], 0
        self.learn([t for t in new if t not in self.known])
        for c in counted:
            at = np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))
            if not len(self.model.languages) or not self.letters[at].sum():
                yield UNKNOWN, 0.0, None, 0
                continue
            times = np.fromiter(c.values(), np.float64, len(c))
            log, letters = times @ self.scores[at], int(times @ self.letters[at])
            best = int(np.argmax(log))
            yield (self.model.languages[best], float(1 / np.exp(log - log[best]).sum()), float(log[best] / letters),
                   letters)


def held_out(key: Column) -> Column:
    """True where crc32 of the key as text leaves 2 by 4. A null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, text: str = "text", lang: str = "lang", path: str | None = None,
          smoothing: float = SMOOTHING) -> Model:
    """Piece probabilities from every row of docs with a text and a language.

    Each task sums its words and sends piece counts, so a language that most rows have is reduced before the shuffle.
    What reaches the driver is one number for each language and piece: as much as the vocabulary times the languages
    labelled, however many documents there are. Without any labelled row there are no languages, and all is `und`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker_keeps(("vocabulary", path), lambda: Vocabulary(path))
        pieces: dict[str, Counter] = {}
        tokens: dict[str, Counter] = {}

        def fold() -> None:
            for name, counted in tokens.items():
                words: Counter = Counter()
                for token, n in counted.items():
                    for w in words_of(token):
                        words[w] += n
                pieces.setdefault(name, Counter()).update(vocabulary.counts(words))
            tokens.clear()

        for batch in batches:
            for texts, names in slices(batch.columns):
                for t, name in zip(texts, names, strict=True):
                    tokens.setdefault(name, Counter()).update(tokens_of(t))
                if sum(map(len, tokens.values())) > 200_000:
                    fold()
        fold()
        rows = [(name, piece, n) for name, found in pieces.items() for piece, n in found.items()]
        names, numbers, counts = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(numbers, pa.int32()),
                               pa.array(counts, pa.int64())], ["lang", "piece", "n"])

    labelled = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    rows = (labelled.transform(mapped, run, "lang string, piece int, n long")
            .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow().to_pydict())
    languages = tuple(sorted(set(rows["lang"])))
    number = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((Vocabulary(path).size, len(languages)))
    counts[rows["piece"], [number[x] for x in rows["lang"]]] = rows["n"]
    counts += smoothing
    return Model(languages, counts / counts.sum(axis=0, keepdims=True))


def predicted(docs: DataFrame, model: Model, text: str = "text", path: str | None = None,
              lang: str = "lang_pred", score: str = "lang_score", fit: str | None = None,
              letters: str | None = None) -> DataFrame:
    """docs with the predicted language and its posterior (0 to 1), from the text alone.

    fit and letters, if named, are two more columns: the log-likelihood a letter under the predicted language, and the
    letters it is taken over. Null and empty texts and texts without a letter get `und`, 0, null and 0. All rows and
    columns stay; columns that have the names of the new ones are replaced. Ties go to the language whose name sorts
    first.
    """
    spark = docs.sparkSession
    added = [(lang, "string", 0), (score, "double", 1), (fit, "double", 2), (letters, "long", 3)]
    added = [x for x in added if x[0] is not None]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n, _, _ in added}])
    at = docs.columns.index(text)
    shared = spark.sparkContext.broadcast(model)  # as large as the vocabulary times the languages
    key = ("scorer", path, zlib.crc32(model.probabilities.tobytes()))
    arrow = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_keeps(key, lambda: Scorer(shared.value, path))
        for batch in batches:
            found = [x for (texts,) in slices([batch.column(at)]) for x in scorer.predict([t or "" for t in texts])]
            yield pa.record_batch([*batch.columns, *[pa.array([x[i] for x in found], arrow[t]) for _, t, i in added]],
                                  [*batch.schema.names, *[n for n, _, _ in added]])

    schema = T.StructType([*docs.schema.fields])
    for name, kind, _ in added:
        schema = schema.add(name, kind)
    return docs.transform(mapped, run, schema)


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
               path: str | None = None) -> DataFrame:
    """docs with `held_out`, `lang_pred` and `lang_score`; learned from the labelled rows that are not held out."""
    model = train(docs.filter(~held_out(F.col(key))).select(text, lang), text, lang, path)
    flag = spare("held_out", docs.columns)
    return predicted(docs.withColumn(flag, held_out(F.col(key))), model, text, path)


def floors(labelled: DataFrame, model: Model, text: str = "text", lang: str = "lang",
           path: str | None = None) -> dict[str, float]:
    """The least log-likelihood a letter with which a text counts as one of a language: see LOWEST, FAR and NATS.

    Taken over all rows whose label is the language predicted. A language of which no row is predicted right has no
    floor. One row for each language comes to the driver.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    found = predicted(rows, model, path=path, fit="fit").filter("lang = lang_pred")
    low, middle = F.percentile_approx("fit", LOWEST), F.percentile_approx("fit", 0.5)
    floor = middle - F.greatest(FAR * (middle - low), F.lit(NATS))
    return {r["lang"]: r["floor"] for r in found.groupBy("lang").agg(floor.alias("floor")).collect()}


def recognised(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
               path: str | None = None) -> DataFrame:
    """The rows of docs that are in a language learned from docs, columns as they are.

    A text is kept if its language is more likely than all others together and explains its letters about as well as
    that language's labelled texts. So null, empty and letterless texts go, and so do random letters and languages
    that no label names, of which the posterior alone says nothing: it only compares learned languages. Without any
    labelled row nothing is recognised. Repeated rows are judged alike and stay.
    """
    model = train(docs.filter(~held_out(F.col(key))), text, lang, path)
    least = floors(docs, model, text, lang, path)
    taken = list(docs.columns)
    pred, score, fit = (spare(c, taken) for c in ("lang_pred", "lang_score", "lang_fit"))
    found = predicted(docs, model, text, path, pred, score, fit)
    floor = F.lit(None).cast("double")
    for name, value in sorted(least.items()):  # one for each language
        floor = F.when(F.col(pred) == name, F.lit(value)).otherwise(floor)
    return found.filter((F.col(score) >= 0.5) & (F.col(fit) >= floor)).drop(pred, score, fit)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identified(docs).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
