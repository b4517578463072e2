"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

Strings are words: what lies between white space, where letters set apart one by one ("i d i o t")
count as one word. The kernel counts common subsequences of ORDER letters, each occurrence
weighted by DECAY**span, within a span of SPAN places (Lodhi et al. 2002, gaps bounded), so letters
put between those of an insult, or left out, cost weight and not the match. Letters are folded
to SYMBOLS classes; other characters inside a word are passed over.

With landmarks l the machine is f(w) = sum_j a_j k(w, l_j) / |w|. Because k is an inner product over
subsequences, the sum folds into one weight for each, a table of SYMBOLS**3 numbers: a text is
scored letter by letter, at the same cost per letter however many landmarks there are.

Labels are of documents and insults are words, so training is multiple-instance (Andrews et al.
2003): a document scores as its highest word, each round takes the highest words of every toxic
document as positive examples and the highest ones of the others as negatives. The first round's
words come from subsequences' document frequencies; words that are themselves 20 times as frequent in
toxic documents are positive in every round; each positive word is joined by an altered form of it, with
a letter or two put in or one left out. Near copies count once. A logistic curve over the highest
f, the number of high words and the number of words turns scores to probabilities.

The fit takes MAX_TRAIN labelled documents of each class at most (those with the least hash of
doc_id, and of them those of up to MAX_TRAIN_BYTES), one of each group of near copies of a class, and from them in each round
MAX_WORDS words of each class at most, of fewer than MAX_WORD_BYTES bytes: documented bounds of the fit alone. Every document is scored,
over its whole text and all its words, however long both are.

Defined results: null and empty texts have no word and score as a text of harmless words does;
with no labelled rows of both classes every score is 0.0; rows without doc_id are scored too;
labels that repeat with one value count once, contradicting ones count as toxic; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .frames import map_arrow

ORDER, SPAN, DECAY, SYMBOLS = 3, 6, 0.7, 64
MAX_TRAIN, LANDMARKS, ROUNDS = 2500, 192, 5
#: Longer texts don't serve as examples, so that the examples fit the driver; they are scored like all others.
MAX_TRAIN_BYTES = 1 << 15
#: f from which a word is one that the machine is sure of.
STRONG = 0.7
#: Words of each class in a round's machine, a sample of more; bytes of words that serve as examples.
MAX_WORDS, MAX_WORD_BYTES = 4000, 200
CHUNK = 1 << 19

_FOLD = np.zeros(256, np.int32)  # 0: no letter
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789", 1):
    _FOLD[_c] = _i
_FOLD[ord("A") : ord("Z") + 1] = _FOLD[ord("a") : ord("z") + 1]
_FOLD[0x80:] = 37 + (np.arange(128) * 11 + 5) % 27
_STEPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
_WEIGHT = np.array([DECAY ** (k + 1) for _, k in _STEPS], np.float32)


def word_spans(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the words; runs of single characters are one word."""
    start, end = T.spans(chunk.data > 32, chunk.bounds)
    row = np.searchsorted(chunk.bounds, start, "right") - 1
    if len(start) > 1:
        single = end - start == 1
        glued = single[1:] & single[:-1] & (row[1:] == row[:-1])
        keep = np.concatenate([[True], ~glued])
        end = end[np.append(np.flatnonzero(keep)[1:] - 1, len(end) - 1)]
        start, row = start[keep], row[keep]
    return row, start, end


def _norms(n: int = 4096) -> np.ndarray:
    """Length of the vector of a word of n letters with no subsequence twice; a constant keeps the shortest words from weighing most."""
    sizes = np.arange(n + 1)
    return np.sqrt(sum(float(w) ** 2 * np.maximum(sizes - k, 0) for (_, k), w in zip(_STEPS, _WEIGHT, strict=True)) + 0.1)


_NORM = _norms()


def letters_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of words data[start:end], side by side, and where each word's begin. What is no letter is left out: it costs nothing."""
    size = end - start
    kind = np.int32 if len(data) < 1 << 31 else np.int64  # half the memory and time where it does
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1], dtype=kind) + np.repeat((start - first[:-1]).astype(kind), size)
    folded = _FOLD[data[at]]
    some = folded > 0
    counts = np.concatenate([np.zeros(1, kind), np.cumsum(some, dtype=kind)])
    return folded[some], counts[first]


def subsequences(letters: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(position, code, weight) for every step pattern: letters i, i+j, i+k of one word."""
    n = len(letters)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    for (j, k), w in zip(_STEPS, _WEIGHT, strict=True):
        at = np.flatnonzero(left > k)
        yield at, (letters[at] * SYMBOLS + letters[at + j]) * SYMBOLS + letters[at + k], float(w)


def word_scores(chunk: T.Chunk, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, f) of every word of a chunk."""
    row, start, end = word_spans(chunk)
    if not len(start):
        return row, np.zeros(0, np.float32)
    return row, _scored(*letters_of(chunk.data, start, end), table)


def _scored(letters: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """f of every word."""
    n = len(letters)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n, dtype=first.dtype)
    gained = np.zeros(n, np.float32)
    pairs = letters * SYMBOLS
    for (j, k), w in zip(_STEPS, _WEIGHT, strict=True):
        if n > k:
            gained[: n - k] += np.where(left[: n - k] > k, table[(pairs[: n - k] + letters[j : n - k + j]) * SYMBOLS + letters[k:]], 0) * w
    total = np.concatenate([[0], np.cumsum(gained, dtype=np.float64)])
    return ((total[first[1:]] - total[first[:-1]]) / _NORM[np.minimum(np.diff(first), len(_NORM) - 1)]).astype(np.float32)


@dataclass
class Model:
    table: np.ndarray
    curve: np.ndarray  # weights of what rows() gives
    bias: float = 0.0

    def rows(self, chunk: T.Chunk) -> np.ndarray:
        """Of every row: 1, the highest f, and on a log scale how many words have f above 0, above STRONG, and at all."""
        row, f = word_scores(chunk, self.table)
        f = f + self.bias
        n = chunk.high - chunk.low
        best = np.full(n, -2.0)
        np.maximum.at(best, row, np.clip(f, -2, 1.2))
        count = lambda which: np.log1p(np.bincount(row[which], minlength=n))
        return np.stack([np.ones(n), best, count(f > 0), count(f > STRONG), np.log1p(np.bincount(row, minlength=n))], 1)

    def scores(self, chunk: T.Chunk) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.rows(chunk) @ self.curve, -30, 30)))


def _features(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of subsequence weights: (string, code, weight), scaled to length 1."""
    ends = np.cumsum([len(x) for x in strings])
    letters, first = letters_of(np.frombuffer(b"".join(strings), np.uint8), ends - [len(x) for x in strings], ends)
    word = np.repeat(np.arange(len(strings)), np.diff(first))
    owner, code, value = [], [], []
    for at, k, w in subsequences(letters, first):
        owner.append(word[at])
        code.append(k)
        value.append(np.full(len(at), w))
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    owner, code, value = (np.concatenate(x) for x in (owner, code, value))
    key, where = np.unique(owner * SYMBOLS**3 + code, return_inverse=True)
    value = np.bincount(where, value)
    owner, code = key // SYMBOLS**3, key % SYMBOLS**3
    return owner, code, value / _NORM[np.minimum(np.diff(first), len(_NORM) - 1)][owner]


def _svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 30) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * c
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        inside = y * (x @ w) < 1
        xs = x[inside] * weight[inside, None]
        new = np.linalg.solve(keep + x[inside].T @ xs, xs.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _table(positive: list[bytes], negative: list[bytes]) -> tuple[np.ndarray, float]:
    """The machine that tells the positive from the negative strings, folded into one weight per subsequence."""
    half = LANDMARKS // 2
    strings = [*positive, *negative]
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    owner, code, value = _features(strings)
    spread = lambda n, m: np.unique(np.linspace(0, n - 1, min(n, m)).astype(int)) if n else np.zeros(0, int)
    often = Counter(x.lower() for x in positive)
    common = {w for w, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[: half // 2]}
    once = {x.lower(): i for i, x in enumerate(positive)}
    rest = np.array(sorted(i for x, i in once.items() if x not in common), int)
    chosen = np.concatenate([sorted(once[x] for x in common), rest[spread(len(rest), half - len(common))], len(positive) + spread(len(negative), half)]).astype(int)
    is_landmark = np.zeros(len(strings), bool)
    is_landmark[chosen] = True
    codes = np.unique(code[is_landmark[owner]])
    use = np.isin(code, codes)
    owner, code, value = owner[use], np.searchsorted(codes, code[use]), value[use]
    number = np.full(len(strings), -1)
    number[chosen] = np.arange(len(chosen))
    landmarks = np.zeros((len(chosen), len(codes)))
    mark = number[owner] >= 0
    landmarks[number[owner[mark]], code[mark]] = value[mark]
    kernel = np.zeros((len(strings), len(chosen)))  # k(string, landmark)
    for low in range(0, len(strings), 512):
        lo, hi = np.searchsorted(owner, [low, low + 512])
        dense = np.zeros((min(512, len(strings) - low), len(codes)))
        dense[owner[lo:hi] - low, code[lo:hi]] = value[lo:hi]
        kernel[low : low + 512] = dense @ landmarks.T
    values, basis = np.linalg.eigh(kernel[chosen] + 1e-6 * np.eye(len(chosen)))
    root = basis / np.sqrt(np.maximum(values, 1e-6)) @ basis.T
    w = _svm(kernel @ root, y)
    table = np.zeros(SYMBOLS**3, np.float32)
    table[codes] = (root @ w[:-1]) @ landmarks
    return table, float(w[-1])


def fit(texts: list[bytes], toxic: np.ndarray, seed: int = 5) -> Model:
    """The model of labelled documents."""
    toxic = np.asarray(toxic, bool)
    empty = Model(np.zeros(SYMBOLS**3, np.float32), np.array([-30.0, 0, 0, 0, 0]))
    if not toxic.any() or toxic.all():
        return empty
    kept = _unlike(texts, toxic)
    texts, toxic = [texts[i] for i in kept], toxic[kept]
    column = pa.array(texts, pa.binary())
    row, word, strings = _vocabulary(column)
    bad = toxic[row]
    seen = np.stack([np.bincount(word, ~bad, len(strings)), np.bincount(word, bad, len(strings))])  # in how many documents of each class a word is
    ends = np.cumsum([len(x) for x in strings])
    letters, first = letters_of(np.frombuffer(b"".join(strings), np.uint8), ends - [len(x) for x in strings], ends)
    table, bias = _odds(letters, first, seen, toxic), 0.0
    # words that are in at least a hundredth of the toxic documents, and 20 times as often as in the others
    share = (seen[1] + 0.5) / (toxic.sum() + 1) / ((seen[0] + 0.5) / ((~toxic).sum() + 1))
    telling = np.flatnonzero((share > 20) & (seen[1] >= max(3, toxic.sum() / 100)))
    sure = word[bad & np.isin(word, telling)]
    usable = np.array([0 < len(x) < MAX_WORD_BYTES for x in strings], bool)
    rng = np.random.default_rng(seed)
    for step in range(ROUNDS):
        f = _scored(letters, first, table) + bias
        order = np.lexsort((word, -f[word], row))
        row, word, bad = row[order], word[order], bad[order]
        place = np.arange(len(row)) - np.repeat(*_heads(row))
        # the highest word of each toxic document, and from the second round all that the machine takes for insults
        high = bad & (((place == 0) & ((f[word] > -1) | (step == 0))) | ((f[word] > 0.5) & (step > 0)))
        low = ~bad & ((place < 2) | (rng.random(len(row)) < 0.01))
        positive, negative = np.sort(np.concatenate([sure, word[high]])), np.unique(word[low])
        positive, negative = (x[usable[x]] for x in (positive, negative))
        positive, negative = (x if len(x) <= MAX_WORDS else x[np.sort(rng.choice(len(x), MAX_WORDS, replace=False))] for x in (positive, negative))
        if not len(positive) or not len(negative):
            return empty
        found = [strings[i] for i in positive]
        table, bias = _table(found + [_altered(x, rng) for x in found], [strings[i] for i in negative])
    return _calibrated(table, bias, column, toxic)


def _altered(word: bytes, rng: np.random.Generator) -> bytes:
    """The word as those write it who hide it: a letter or two put in, or one left out."""
    kind, out = rng.integers(4), bytearray(word)
    for _ in range(1 + (kind == 2)):
        out.insert(int(rng.integers(1, len(out) + 1)), int(rng.integers(97, 123)))
    if kind == 3 and len(word) > 4:
        out = bytearray(word)
        del out[int(rng.integers(1, len(out)))]
    return bytes(out)


def _heads(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal numbers begins, and its length."""
    at = np.flatnonzero(np.diff(row, prepend=-1))
    return at, np.diff(np.append(at, len(row)))


def _vocabulary(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The distinct (row, word) pairs, and the words, lower-cased."""
    rows, hashes, known = [], [], {}
    for c in T.chunks(column, CHUNK):
        row, start, end = word_spans(c)
        h = T.span_hash(T._BYTE[T.LOWER[c.data]], start, end)
        order = np.lexsort((h, row))
        order = order[np.concatenate([[True], (np.diff(row[order]) != 0) | (h[order][1:] != h[order][:-1])])] if len(order) else order
        rows.append((row[order] + c.low).astype(np.int32))
        hashes.append(h[order])
        for x, i in zip(*(y.tolist() for y in np.unique(h, return_index=True)), strict=True):
            if x not in known:
                known[x] = T.LOWER[c.data[start[i] : end[i]]].tobytes()
    words = np.array(sorted(known), np.uint64)
    return np.concatenate(rows), np.searchsorted(words, np.concatenate(hashes)).astype(np.int32), [known[x] for x in words.tolist()]


def _odds(letters: np.ndarray, first: np.ndarray, seen: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For a start, each subsequence weighs how much more often words of toxic documents have it, if they do."""
    counts = np.zeros((2, SYMBOLS**3))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for at, code, _ in subsequences(letters, first):
        for k in (0, 1):
            counts[k] += np.bincount(code, seen[k][owner[at]], SYMBOLS**3)
    odds = np.log((counts[1] + 0.5) / (toxic.sum() + 1)) - np.log((counts[0] + 0.5) / ((~toxic).sum() + 1))
    odds[counts.sum(0) < 2] = 0
    return np.maximum(odds, 0).astype(np.float32)


def _unlike(texts: list[bytes], toxic: np.ndarray) -> np.ndarray:
    """One of each group of copies and near copies of a class: a word of theirs isn't telling for being in many of them."""
    marks = np.concatenate([_marks(c) for c in T.chunks(pa.array(texts, pa.binary()), CHUNK // 2)])
    return np.sort(np.unique(np.stack([marks, toxic.astype(np.uint64)], 1), axis=0, return_index=True)[1])


def _marks(c: T.Chunk) -> np.ndarray:
    w = T.words(c)
    out = T.span_hash(T._BYTE[c.data], c.bounds[:-1], c.bounds[1:])
    grams, whole = T.grams(w.hash, 5), T.whole(w.first, len(w.hash), 5)
    at = np.flatnonzero(whole[: len(grams)])
    least = np.full(len(out), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, w.row()[at], grams[at])
    return np.where(w.counts >= 5, least, out)


def _calibrated(table: np.ndarray, bias: float, column: pa.Array, toxic: np.ndarray) -> Model:
    model = Model(table, np.zeros(5), bias)
    x = np.concatenate([model.rows(c) for c in T.chunks(column, CHUNK)])
    y, w = toxic.astype(float), np.zeros(5)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(5), x.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Model(table, w, bias)


def labelled(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> tuple[list[bytes], np.ndarray]:
    """At most max_train documents of each class, those with the least hash of doc_id; of them, those of at most max_bytes."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(3))
    picked = [marks.where(F.col("toxic") == k).orderBy(order).limit(max_train) for k in (0, 1)]
    ids = {r["doc_id"]: r["toxic"] for p in picked for r in p.collect()}  # 2 * max_train numbers
    chosen = docs.sparkSession.createDataFrame(list(ids.items()) or [], "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long"), "text").where(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").collect()
    return [r["text"].encode() for r in rows], np.array([r["toxic"] > 0 for r in rows], bool)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batch.column("text"), CHUNK):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(c.low, c.high - c.low), column: pa.array(shared.value.scores(c))})

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, {column} double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in T.chunks(batch.column("text"), CHUNK):
            yield batch.slice(c.low, c.high - c.low).filter(pa.array(shared.value.scores(c) < threshold))

    return map_arrow(docs, run, docs.schema)
