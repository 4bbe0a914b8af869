"""String similarities Spark has no builtin for, as Arrow-batched UDFs over candidate pairs.

Public algorithms: Jaro-Winkler (prefix boost of 0.1 per letter up to four, only above 0.7) and the indel
ratio 200 * LCS / (len a + len b), with the LCS length found bit-parallel.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Executors need not have this package: the functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def jaro_winkler_py(a: str, b: str) -> float:
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used = bytearray(lb)
    left = []
    for i, ch in enumerate(a):
        j = b.find(ch, max(0, i - reach), i + reach + 1)
        while j >= 0 and used[j]:
            j = b.find(ch, j + 1, i + reach + 1)
        if j >= 0:
            used[j] = 1
            left.append(ch)
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(lb) if used[j]]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3.0
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1.0 - jaro)


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence; one machine-word-parallel step per letter of b."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio_py(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def sort_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio_py(a: str, b: str) -> float:
    return indel_ratio_py(sort_tokens(a), sort_tokens(b))


def match_score_py(a: str, b: str) -> float:
    """The better of the plain and the token-sorted ratio; 0 when either name is empty."""
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    return max(indel_ratio_py(a, b), token_sort_ratio_py(a, b))


#: Letters of one side that lcs_batch lays out at once.
BATCH_LETTERS = 1 << 20


def lcs_batch(a: list[str], b: list[str]) -> np.ndarray:
    """lcs_length of many pairs at once: pairs of like length share the bit-parallel steps."""
    out = np.zeros(len(a), dtype=np.int64)
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64)
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        ends = np.arange(1, len(order) - at + 1) * np.maximum(size[order[at:]], 1)
        some = order[at:at + max(1, int(np.searchsorted(ends, BATCH_LETTERS, "right")))]
        place = np.arange(len(some))
        out[some] = _lcs_of(_Form([a[k] for k in some]), _Form([b[k] for k in some]))(place, place)
        at += len(some)
    return out


def ratio_batch(a: list[str], b: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], dtype=np.float64)
    return np.where(total == 0, 100.0, 200.0 * lcs_batch(a, b) / np.maximum(total, 1))


def score_batch(a: list[str], b: list[str]) -> np.ndarray:
    ordered: dict[str, str] = {}
    for x in (*a, *b):
        if x not in ordered:
            ordered[x] = sort_tokens(x)
    best = np.maximum(ratio_batch(a, b), ratio_batch([ordered[x] for x in a], [ordered[x] for x in b]))
    return np.where([bool(x) and bool(y) for x, y in zip(a, b)], best, 0.0)


def _batched(fn):
    """UDF over two text columns; null when either is null."""
    @F.pandas_udf(T.DoubleType())
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        if known.any():
            out[known] = fn(list(a[known]), list(b[known]))
        return pd.Series(out).where(known, None)

    return scored


jaro_winkler = _batched(lambda a, b: np.array([jaro_winkler_py(x, y) for x, y in zip(a, b)]))
indel_ratio = _batched(ratio_batch)
token_sort_ratio = _batched(lambda a, b: ratio_batch([sort_tokens(x) for x in a], [sort_tokens(x) for x in b]))
match_score = _batched(score_batch)


def ratio_can_reach(len_a, len_b, floor: float):
    """Upper bound of the indel ratio from lengths alone: 200 * min / (a + b) >= floor."""
    return F.least(len_a, len_b) * F.lit(200.0) >= (len_a + len_b) * F.lit(float(floor))


TILE = (128, 8_192)  # names of either side that are compared at once
PAIRS = 16_384  # pairs that the later steps take at once


def _letters(names: list[str]) -> np.ndarray:
    """Code points, one row for each name, 0 after its end."""
    a = np.array(names, dtype=np.str_)
    return a.view(np.uint32).reshape(len(names), -1) if a.dtype.itemsize else np.zeros((len(names), 0), np.uint32)


def _counts(codes: np.ndarray) -> np.ndarray:
    """How often each of 64 classes of letters occurs. Letters of one class count as equal: an upper bound."""
    out = np.zeros((len(codes), 64), np.int32)
    row, col = np.nonzero(codes)
    np.add.at(out, (row, codes[row, col] & 63), 1)
    return out


def _levels(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Counts in unary, up to `most` for each class, so that a product of two rows is the overlap of their letters."""
    return np.concatenate([counts[:, c, None] >= np.arange(1, m + 1) for c, m in enumerate(most) if m] or
                          [np.zeros((len(counts), 1), bool)], axis=1).astype(np.float32)


#: A name on the bits' side has at most so many 64-bit words; longer ones are measured pair by pair.
MOST_WORDS = 8


def _words(size: np.ndarray) -> np.ndarray:
    return np.maximum((size + 63) // 64, 1)


class _Form:
    """One way of writing the names of a block: code points and lengths."""

    def __init__(self, names: list[str]):
        self.names, self.codes = names, _letters(names)
        self.size = (self.codes != 0).sum(axis=1)
        self.words = _words(self.size)

    def letters(self, alphabet: np.ndarray) -> np.ndarray:
        """Each name's letters by their place in the alphabet, which holds them all; its size after the name's end."""
        return np.where(self.codes != 0, np.searchsorted(alphabet, self.codes), len(alphabet))

    def masks(self, some: np.ndarray, letters: np.ndarray, n: int) -> list[np.ndarray]:
        """For each word of some names a table (letter, name) of the places where it stands, letter n standing nowhere."""
        out = []
        for w in range(int(self.words[some].max(initial=1))):
            part = letters[some, 64 * w:64 * w + 64]
            table = np.zeros((n + 1, len(some)), np.uint64)
            for k in range(part.shape[1]):  # one place of each name at a time, so that none is written twice
                table[part[:, k], np.arange(len(some))] |= np.uint64(1) << np.uint64(k)
            table[n] = 0
            out.append(table)
        return out


def _lcs_of(a: _Form, b: _Form):
    """LCS lengths of pairs (i, j): masks of the names are made once, the bit-parallel step runs over many pairs."""
    alphabet = np.union1d(a.codes, b.codes)
    alphabet = alphabet[alphabet != 0]
    n = len(alphabet)
    letters = [f.letters(alphabet) for f in (a, b)]
    texts = [np.ascontiguousarray(x.T) for x in letters]
    forms, made = (a, b), {}

    def tables(side: int, words: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Masks of the names of one side that have so many words, and where each name is in them."""
        if (side, words) not in made:
            some = np.flatnonzero(forms[side].words == words)
            place = np.zeros(len(forms[side].names), np.int64)
            place[some] = np.arange(len(some)) * (n + 1)
            made[side, words] = [np.ascontiguousarray(t.T).ravel() for t in forms[side].masks(some, letters[side], n)], place
        return made[side, words]

    def run(side: int, words: int, bits: np.ndarray, text: np.ndarray) -> np.ndarray:
        masks, place = tables(side, words)
        base, steps = place[bits], texts[1 - side]
        state = [np.full(len(bits), np.iinfo(np.uint64).max, np.uint64) for _ in masks]
        for t in range(int(forms[1 - side].size[text].max())):
            at = base + steps[t][text]
            carry = None
            for w, table in enumerate(masks):
                hit = state[w] & table[at]
                total = state[w] + hit
                if words > 1:  # what one word's sum carries is added to the next
                    over = total < hit
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                state[w] = total | (state[w] - hit)
        return sum(np.bitwise_count(~x).astype(np.int64) for x in state)

    def lcs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        kind = 2 * np.minimum(a.words[i], b.words[j]) + (b.words[j] < a.words[i])
        for k in np.flatnonzero(np.bincount(kind)):
            at = np.flatnonzero(kind == k)
            words, side = divmod(int(k), 2)
            if words > MOST_WORDS:
                out[at] = [lcs_length(a.names[x], b.names[y]) for x, y in zip(i[at], j[at])]
            else:
                out[at] = run(side, words, *((i[at], j[at]) if side == 0 else (j[at], i[at])))
        return out

    return lcs


class _Common:
    """Which pairs of a block's names have a common subsequence of so many letters at least."""

    def __init__(self, a: _Form, b: _Form):
        self.a, self.b, self.lcs = a, b, _lcs_of(a, b)
        alphabet = np.union1d(a.codes, b.codes)
        alphabet = alphabet[alphabet != 0]
        self.letters, of_b = a.letters(alphabet), b.letters(alphabet)
        self.place, self.masks = np.zeros(len(b.names), np.int64), {}
        for w in np.unique(b.words).tolist():
            if w <= MOST_WORDS:
                some = np.flatnonzero(b.words == w)
                self.place[some] = np.arange(len(some))
                self.masks[w] = b.masks(some, of_b, len(alphabet))

    def reaching(self, i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Of the pairs (sorted by i), those with need letters in common."""
        ok = np.minimum(self.a.size[i], self.b.size[j]) >= need
        first = np.flatnonzero(np.diff(i, prepend=-1))
        loose = []
        for x, y in zip(first, [*first[1:], len(i)]):
            if y - x < MANY:
                loose.append(np.arange(x, y))
                continue
            words = self.b.words[j[x:y]]
            for w in np.flatnonzero(np.bincount(words)).tolist():
                at = x + np.flatnonzero((words == w) & ok[x:y])
                if w > MOST_WORDS:
                    loose.append(at)
                elif len(at):
                    ok[at] = self._one(int(i[x]), j[at], need[at], w)
        loose = np.concatenate(loose) if loose else np.zeros(0, np.int64)
        for k in range(0, len(loose), PAIRS):
            at = loose[k:k + PAIRS]
            at = at[ok[at]]
            ok[at] = self.lcs(i[at], j[at]) >= need[at]
        return ok

    def _one(self, i: int, j: np.ndarray, need: np.ndarray, words: int) -> np.ndarray:
        """One left name, whose letters are the same for all its pairs; pairs that miss too many of them are left."""
        size, ok = int(self.a.size[i]), np.zeros(len(j), bool)
        used, letter = np.unique(self.letters[i, :size], return_inverse=True)
        rows = [np.take(t[used], self.place[j], axis=1) for t in self.masks[words]]
        state = [np.full(len(j), np.iinfo(np.uint64).max, np.uint64) for _ in rows]
        sel, hit = np.arange(len(j)), np.empty(len(j), np.uint64)
        for t in range(size):
            carry = None
            for w, row in enumerate(rows):
                x, near = state[w], row[letter[t]]
                np.bitwise_and(x, near, out=hit)
                total = x + hit
                if words > 1:  # what one word's sum carries is added to the next
                    over = total < hit
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                np.subtract(x, hit, out=x)
                np.bitwise_or(total, x, out=x)
            if t % 8 == 7 and 2 * t > size or t == size - 1:
                found = sum(np.bitwise_count(~x).astype(np.int64) for x in state)
                keep = np.flatnonzero(found + (size - 1 - t) >= need[sel])
                if t == size - 1 or not len(keep):
                    ok[sel[keep]] = True
                    break
                if len(keep) < 0.7 * len(sel):
                    sel, rows, state = sel[keep], [np.take(r, keep, axis=1) for r in rows], [x[keep] for x in state]
                    hit = np.empty(len(sel), np.uint64)
        return ok


PREFIX = 4  # leading letters that Jaro-Winkler counts


class _Jaro:
    """Jaro-Winkler of pairs of a block's names: the left name's letters are dealt to the right name's places one after
    another, for many pairs at once, the places being bits. Pairs that cannot reach the floor are left on the way."""

    def __init__(self, a: _Form, b: _Form, floor: float):
        self.a, self.b, self.floor = a, b, floor
        alphabet = np.unique(b.codes[b.codes != 0])
        self.n = len(alphabet)
        of_a = np.searchsorted(alphabet, a.codes)
        known = alphabet[np.minimum(of_a, self.n - 1)] == a.codes if self.n else np.zeros(a.codes.shape, bool)
        self.letters = np.where(known, of_a, self.n)  # a letter that the right side lacks stands nowhere
        self.texts = np.ascontiguousarray(self.letters.T)
        of_b, self.place, self.masks = b.letters(alphabet), np.zeros(len(b.names), np.int64), {}
        for w in np.unique(b.words).tolist():
            if w <= MOST_WORDS:
                some = np.flatnonzero(b.words == w)
                self.place[some] = np.arange(len(some))
                self.masks[w] = b.masks(some, of_b, self.n)
        self.heads = [np.zeros((len(f.names), PREFIX), np.uint32) for f in (a, b)]
        for head, f in zip(self.heads, (a, b)):
            head[:, :f.codes.shape[1]] = f.codes[:, :PREFIX]

    def prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many leading letters the names have in common, PREFIX at most."""
        out, same = np.zeros(len(i), np.int64), np.ones(len(i), bool)
        for k in range(PREFIX):
            x = self.heads[0][i, k]
            same &= (x == self.heads[1][j, k]) & (x != 0)
            out += same
        return out

    def reaching(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs (sorted by i) that reach the floor, and their Jaro-Winkler."""
        found = []
        for w in np.flatnonzero(np.bincount(self.b.words[j])).tolist():
            at = np.flatnonzero(self.b.words[j] == w)
            if w > MOST_WORDS:
                value = np.array([jaro_winkler_py(self.a.names[x], self.b.names[y]) for x, y in zip(i[at], j[at])])
                found.append((at[value >= self.floor], value[value >= self.floor]))
                continue
            first = np.flatnonzero(np.diff(i[at], prepend=-1))
            loose = []
            for x, y in zip(first, [*first[1:], len(at)]):
                if y - x >= MANY:  # one left name: its letters are the same for all its pairs
                    for z in range(x, y, PAIRS):
                        found.append(self._some(i, j, at[z:min(z + PAIRS, y)], w, True))
                else:
                    loose.append(at[x:y])
            loose = np.concatenate(loose) if loose else at[:0]
            for z in range(0, len(loose), MANY * 16):
                found.append(self._some(i, j, loose[z:z + MANY * 16], w, False))
        return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, t)]) for k, t in ((0, np.int64), (1, np.float64)))

    def _some(self, i: np.ndarray, j: np.ndarray, at: np.ndarray, words: int, one: bool) -> tuple[np.ndarray, np.ndarray]:
        """reaching() for the pairs at these places, whose right names have so many words."""
        i, j, steps = i[at], j[at], int(self.a.size[i[at]].max())
        if len(at) > 1 and len(at) * steps * words > MOST_PLACES:
            parts = [self._some(i, j, p, words, one) for p in np.array_split(np.arange(len(at)), 2)]
            return tuple(np.concatenate([at[p[0]] if not k else p[1] for p in parts]) for k in (0, 1))
        la, lb = self.a.size[i], self.b.size[j]
        tables, place = self.masks[words], self.place[j]
        if one:
            used, letter = np.unique(self.letters[i[0], :steps], return_inverse=True)
            rows = [np.take(t[used], place, axis=1) for t in tables]
        else:
            flat, wide = [t.ravel() for t in tables], tables[0].shape[1]
        every = slice(None)

        def masks(t: int, w: int, of: np.ndarray | slice = every) -> np.ndarray:
            """Where the letter t of the left names stands in word w of the right ones."""
            if one:
                return rows[w][letter[t]] if of is every else np.take(rows[w][letter[t]], of)
            return flat[w][self.texts[t][i[of]] * wide + place[of]]

        # Letters are equal ones within reach of each other; every letter of the left takes the first place left over.
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        kinds = np.arange(reach.min(), reach.max() + 1)
        kind = reach - kinds[0]
        top, time = int(lb.max()), np.arange(steps)[:, None]
        until, since = np.minimum(time + kinds + 1, top), np.clip(time - kinds, 0, top)
        below = [np.array([(1 << min(max(k - 64 * w, 0), 64)) - 1 for k in range(top + 1)], np.uint64) for w in range(words)]
        within = [x[until] & ~x[since] for x in below]
        bound = (since.max(axis=1) > 0) | (until.min(axis=1) < top)
        free = [np.full(len(at), np.iinfo(np.uint64).max, np.uint64) for _ in tables]
        took = np.empty((words, steps, len(at)), np.uint64)
        some, taken = np.empty(len(at), np.uint64), None
        for t in range(steps):
            for w in range(words):
                x = np.bitwise_and(masks(t, w), free[w], out=took[w, t])
                if bound[t]:
                    np.bitwise_and(x, within[w][t, 0] if len(kinds) == 1 else np.take(within[w][t], kind, out=some), out=x)
                np.bitwise_and(x, np.negative(x, out=some), out=x)
                if words > 1:
                    if w:
                        x[taken] = 0
                    taken = taken | (x != 0) if w else x != 0
                np.bitwise_xor(free[w], x, out=free[w])
        m = sum(np.bitwise_count(~f).astype(np.int64) for f in free)
        head = self.prefix(i, j)
        shares = m / la + m / lb - np.array(jaro_sums(self.floor))[head]  # what transpositions may take, as t / m
        sel = np.flatnonzero((shares >= -1e-9) & (m > 0))
        # Letters in the order of either name: a pair may differ at so many places, an odd one counting nothing.
        most = 2 * np.floor(m * shares + 1e-6).astype(np.int64) + 1
        rest, swaps = [~f[sel] for f in free], np.zeros(len(sel), np.int64)
        for t0 in range(0, steps, STEPS_BETWEEN):
            if not len(sel):
                break
            here = range(t0, min(t0 + STEPS_BETWEEN, steps))
            part = took[:, t0:here.stop] if len(sel) == len(at) else np.take(took[:, t0:here.stop], sel, axis=2)
            there = part[0] != 0
            for x in part[1:]:
                there |= x != 0
            fill = np.negative(there.astype(np.uint64))  # all bits for the pairs whose letter took a place
            some, equal = np.empty(len(sel), np.uint64), np.zeros(there.shape, bool)
            for k, t in enumerate(here):
                for w in range(words):
                    x = np.bitwise_and(rest[w], np.negative(rest[w], out=some), out=some)
                    np.bitwise_and(x, fill[k], out=x)
                    np.bitwise_xor(rest[w], x, out=rest[w])
                    if words > 1:
                        fill[k][x != 0] = 0
                    np.bitwise_and(x, masks(t, w, sel), out=part[w, k])
            for x in part:
                equal |= x != 0
            swaps += (there & ~equal).sum(axis=0, dtype=np.uint8)
            keep = np.flatnonzero(swaps <= most[sel])
            if len(keep) < 0.8 * len(sel):
                sel, rest, swaps = sel[keep], [r[keep] for r in rest], swaps[keep]
        la, lb, m = la[sel], lb[sel], m[sel]
        value = (m / la + m / lb + (m - swaps // 2) / np.maximum(m, 1)) / 3.0
        value = np.where(value > 0.7, value + head[sel] * 0.1 * (1.0 - value), value)
        ok = value >= self.floor
        return at[sel[ok]], value[ok]


#: Pairs of one left name from which on they are taken alone; places (letters by pairs) that are kept at once.
MANY = 256
MOST_PLACES = 1 << 21
STEPS_BETWEEN = 12  # letters after which pairs with too many transpositions are left


def jaro_sums(floor: float) -> list[float]:
    """For names with 0 to PREFIX leading letters in common: how large m / la + m / lb must be (m letters in common, within
    reach) for Jaro-Winkler to reach a floor above 0.7. The prefix counts only for a Jaro similarity above 0.7."""
    return [3 * max((floor - 0.1 * k) / (1 - 0.1 * k), 0.7 if k else 0.0) - 1 for k in range(PREFIX + 1)]


def scored_pairs(left: list[str], right: list[str], floor: float, winkler: float = 0.0, part: str = "all",
                 ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs whose plain or token-sorted indel ratio is >= floor and whose Jaro-Winkler is >=
    winkler, with both figures; exact, in bounded memory. Without a winkler (0, else above 0.7) its figure is 0.

    Tiles of the two lists meet as one matrix product, which gives the letters that each two names have in common: no
    common subsequence is longer, and no more letters match. Part "near" gives only the pairs with enough of them for
    any prefix, "far" only the others, for names that begin alike.
    """
    if not (left and right):
        return
    a, b = _Form(left), _Form(right)
    sorted_a, sorted_b = (_Form([sort_tokens(x) for x in side]) for side in (left, right))
    common = [_Common(a, b), _Common(sorted_a, sorted_b)]
    jaro = _Jaro(a, b, winkler) if winkler else None
    sums = jaro_sums(winkler) if winkler else [0.0]
    least = (sums[0] if part == "near" else min(sums)) - 1e-4
    ca, cb = _counts(a.codes), _counts(b.codes)
    most = np.minimum(ca.max(axis=0), cb.max(axis=0))
    # The sorted form may be shorter, by blanks; it has no letters that the plain one lacks.
    la, lb = (s.size.astype(np.float32) * np.float32(floor / 200.0) for s in (sorted_a, sorted_b))
    pa, pb = (np.float32(1) / f.size.astype(np.float32) for f in (a, b))
    for c in range(0, len(right), TILE[1]):
        ub = _levels(cb[c:c + TILE[1]], most).T.copy()
        for r in range(0, len(left), TILE[0]):
            over = _levels(ca[r:r + TILE[0]], most) @ ub
            fits = over >= la[r:r + TILE[0], None] + (lb[None, c:c + TILE[1]] - np.float32(1e-3)) if floor else None
            if jaro:
                over *= pa[r:r + TILE[0], None] + pb[None, c:c + TILE[1]]
                enough = over >= np.float32(least)
                if part == "far":
                    enough &= over < np.float32(sums[0] - 1e-4)
                fits = enough if fits is None else np.logical_and(fits, enough, out=fits)
            i, j = np.nonzero(fits)
            if jaro and part != "near":
                share = over[i, j]
                i, j = i + r, j + c
                ok = share >= np.float32(sums[0])
                rest = np.flatnonzero(~ok)
                ok[rest] = share[rest] >= np.array(sums, np.float32)[jaro.prefix(i[rest], j[rest])] - np.float32(1e-4)
                i, j = i[ok], j[ok]
            else:
                i, j = i + r, j + c
            if floor:  # the plain form, then the sorted one for the others
                ok = np.zeros(len(i), bool)
                for form, x, y in zip(common, (a, sorted_a), (b, sorted_b)):
                    rest = np.flatnonzero(~ok)
                    need = np.ceil(floor / 200.0 * (x.size[i[rest]] + y.size[j[rest]]) - 1e-9).astype(np.int64)
                    ok[rest] = form.reaching(i[rest], j[rest], need)
                i, j = i[ok], j[ok]
            if jaro:
                at, value = jaro.reaching(i, j)
                i, j = i[at], j[at]
            else:
                value = np.zeros(len(i))
            for k in range(0, len(i), PAIRS):
                pi, pj, w = i[k:k + PAIRS], j[k:k + PAIRS], value[k:k + PAIRS]
                score = np.zeros(len(pi))
                for form, x, y in zip(common, (a, sorted_a), (b, sorted_b)):
                    total = x.size[pi] + y.size[pj]
                    found = 200.0 * form.lcs(pi, pj) / np.maximum(total, 1)
                    score = np.maximum(score, np.where(total, found, 100.0))
                ok = score >= floor
                if ok.any():
                    yield pi[ok], pj[ok], score[ok], w[ok]


def close_pairs(left: list[str], right: list[str], floor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs whose plain or token-sorted indel ratio is >= floor; exact, in bounded memory."""
    for i, j, *_ in scored_pairs(left, right, floor):
        yield i, j


#: Record names up to this length are searched by their one-letter cuts, of which a name has as many as letters.
CUT_UP_TO = 256
CUT_ROWS = 4_096  # record names whose cuts are looked up at once


def _cut_sums(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sum for each whole name, and for each name without the letter at each place (with the name's place). Equal texts
    have equal sums: letter k counts times the k-th power of an odd number, modulo 2 ** 64."""
    size = np.array([len(x) for x in names], np.int64)
    codes = _letters(names) if names else np.zeros((0, 0), np.uint32)
    width = codes.shape[1]
    there = np.arange(width) < size[:, None]
    base = 0x9E3779B97F4A7C15
    powers = np.array([pow(base, k, 2 ** 64) for k in range(width)], np.uint64)
    part = np.where(there, (codes.astype(np.uint64) + np.uint64(1)) * powers, np.uint64(0))
    until = np.cumsum(part, axis=1, dtype=np.uint64)
    whole = until[:, -1] if width else np.zeros(len(names), np.uint64)
    # What follows the missing letter moves one place forward: a power less.
    cut = (until - part) + (whole[:, None] - until) * np.uint64(pow(base, -1, 2 ** 64))
    row, col = np.nonzero(there)
    return whole, cut[row, col], row


def _equal(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (ia, ib) of the equal values; b is sorted."""
    lo, hi = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    n = hi - lo
    before = np.cumsum(n) - n
    return np.repeat(ia, n), ib[np.arange(n.sum()) - np.repeat(before - lo, n)]


def one_letter_apart(left: list[str], right: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs whose plain or token-sorted forms are equal or become equal by one letter more on
    either side. Sums are compared, so a few other pairs may come with them; forms of more than CUT_UP_TO letters (one
    more at the right) are left out."""
    met = []
    for form in (list, lambda names: [sort_tokens(x) for x in names]):
        a, b = form(left), form(right)
        at = [np.array([i for i, x in enumerate(side) if len(x) <= limit], np.int64)
              for side, limit in ((a, CUT_UP_TO), (b, CUT_UP_TO + 1))]
        whole, cut, row = _cut_sums([b[j] for j in at[1]])
        places = (at[1], at[1][row])
        order = [np.argsort(x, kind="stable") for x in (whole, cut)]
        (whole, wj), (cut, cj) = ((x[o], j[o]) for x, j, o in zip((whole, cut), places, order))
        for r in range(0, len(at[0]), CUT_ROWS):
            some = at[0][r:r + CUT_ROWS]
            sums, less, of = _cut_sums([a[i] for i in some])
            met += [_equal(sums, some, whole, wj), _equal(sums, some, cut, cj), _equal(less, some[of], whole, wj)]
    i, j = (np.concatenate([m[k] for m in met] or [np.zeros(0, np.int64)]) for k in (0, 1))
    pairs = np.unique(i * len(right) + j)
    yield pairs // max(len(right), 1), pairs % max(len(right), 1)
