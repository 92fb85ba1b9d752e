"""Toxicity: a support vector machine over a gapped subsequence string kernel, with Nyström landmarks.

The kernel of two words counts the three-letter subsequences that both hold
within a span, each weighted by DECAY to the power of its span, so inserted
characters cost a little and do not hide a word; it is normalised by the words'
lengths as vectors and raised to POWER, which keeps weak likenesses from adding up. A
sentence's kernel sums over its different words. Landmark strings span the
Nyström feature space in which a linear machine is trained on labelled
sentences; a document's score comes from its worst sentences.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import saved, slices, widened

DECAY, SPAN, LETTERS, POWER = 0.7, 8, 32, 2
DIMENSION = LETTERS**3
#: Sentences end at blanks after a full stop, and at line ends; a longer one is read as several of so many words.
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
SENTENCE_WORDS = 24
#: Letters spelled apart are one word.
APART = re.compile(r"(?<!\S)(?:\w[ ._*-]){3,}\w(?!\S)")
EDGES = ".,;:!?\"'()[]{}<>|#%&*$~`_-+=/\\"
#: Signs that stand for letters within a word.
SIGNS = dict(zip("0134578@$!|", "oieastbasil", strict=True))
#: Words whose part among the landmarks' subsequences is shorter than this have kernel 0 with all.
FLOOR = 0.3
#: Class of the mark before a word, and that mark in strings; a string without it is an inner one.
START, MARK = 31, "^"
#: Word scores that a worker remembers.
MEMORY = 500_000


def code_table() -> dict[int, int]:
    """Code point to class: the letters a to z each their own, signs by SIGNS."""
    out = {ord(c): ord(c) - 96 for c in "abcdefghijklmnopqrstuvwxyz"}
    return out | {ord(k): ord(v) - 96 for k, v in SIGNS.items()}


CODES = code_table()


def classes(word: str) -> list[int]:
    """The word's letter classes after a mark for its start; 0 for characters that only make gaps.

    All other letters share four classes: an accent may make another word, and where it disguises one, the kernel skips the letter.
    """
    return [START] + [CODES.get(ord(c)) or (27 + ord(c) % 4 if c.isalpha() else 0) for c in word]


def normalised(token: str) -> str:
    return token.strip(EDGES)


def strings(token: str) -> set[str]:
    """The word's strings of four letters, and its beginnings of three to six, marked."""
    word = normalised(token)
    return {word[i : i + 4] for i in range(len(word) - 3)} | {MARK + word[:n] for n in range(3, min(6, len(word)) + 1)}


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words of each sentence; none for null and blank texts."""
    if not text:
        return []
    text = APART.sub(lambda m: re.sub(r"[ ._*-]", "", m[0]), text.lower().replace(", ", " "))
    out = []
    for part in SENTENCE.split(text):
        words = part.rstrip(EDGES).split()
        out += [words[i : i + SENTENCE_WORDS] for i in range(0, len(words), SENTENCE_WORDS)]
    return out


PAIRS = [(j, k, DECAY ** (k + 1)) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]


def triples(words: list[str], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' subsequences that ``place`` knows: word, place and value. Work grows with the letters, however long a word is.

    Values are divided by the length of the vector of all subsequences of the word, repeats apart.
    """
    codes = [classes(w) for w in words]
    codes = [w if words[i][:1] != MARK else w[:1] + w[2:] for i, w in enumerate(codes)]
    # Seven zeros after each word keep a triple from reaching into the next one.
    sizes = np.array([len(w) + SPAN - 1 for w in codes])
    flat = np.zeros(int(sizes.sum()) + SPAN, dtype=np.int32)
    ends = np.cumsum(sizes)
    for w, end, size in zip(codes, ends.tolist(), sizes.tolist(), strict=True):
        flat[end - size : end - SPAN + 1] = w
    first = np.flatnonzero(flat)
    owner = np.searchsorted(ends, first, side="right")
    head = flat[first] * (LETTERS * LETTERS)
    squares = np.zeros(len(words))
    rows, at, values = [], [], []
    for j, k, weight in PAIRS:
        b, c = flat[first + j], flat[first + k]
        good = (b > 0) & (c > 0)
        squares += weight * weight * np.bincount(owner[good], minlength=len(words))
        found = place[head + b * LETTERS + c]
        known = np.flatnonzero(good & (found >= 0))
        rows.append(owner[known])
        at.append(found[known])
        values.append(np.full(len(known), weight))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    row = row[order]
    return row, np.concatenate(at)[order], np.concatenate(values)[order] / np.sqrt(squares[row])


class Landmarks:
    """Landmark strings by their subsequences: ``place`` of each one that any landmark holds, and a row of values there."""

    def __init__(self, words: list[str]):
        row, key, value = triples(words, np.arange(DIMENSION))
        held, at = np.unique(key, return_inverse=True)
        self.place = np.full(DIMENSION, -1, dtype=np.int32)
        self.place[held] = np.arange(len(held))
        self.rows = np.zeros((len(held), len(words)))
        np.add.at(self.rows, (at, row), value)

    def kernels(self, words: list[str]) -> np.ndarray:
        """Kernels of words (rows) with the landmarks (columns)."""
        out, width = np.zeros((len(words), self.rows.shape[1])), len(self.rows)
        if not out.size or not width:
            return out
        for i in range(0, len(words), 2_000):
            row, at, value = triples(words[i : i + 2_000], self.place)
            # Words that share too little with all landmarks together are unlike each of them.
            common = np.sqrt(np.bincount(row, weights=value**2, minlength=len(words[i : i + 2_000])))
            near = np.flatnonzero(common >= FLOOR)
            index = np.full(len(common), -1)
            index[near] = np.arange(len(near))
            kept = index[row] >= 0
            sparse = np.bincount(index[row[kept]] * width + at[kept], weights=value[kept], minlength=len(near) * width)
            out[i + near] = sparse.reshape(-1, width) @ self.rows
        return out**POWER


class Machine:
    """The fitted machine: landmarks with their coefficients, bias, and the sigmoid's figures."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, slopes: tuple[float, ...] = (1.0, 0.0, 0.0), shift: float = 0.0):
        self.landmarks, self.weights, self.bias, self.slopes, self.shift = landmarks, weights, bias, slopes, shift
        self.base: Landmarks | None = None

    def figures(self) -> tuple:
        """What the machine is made of, to be sent to executors: ``Machine(*figures)`` is the machine again."""
        return self.landmarks, self.weights, self.bias, self.slopes, self.shift

    def words(self, words: list[str]) -> np.ndarray:
        """Each word's part in a decision: its kernels with all landmarks, times the machine's coefficients."""
        if self.base is None:
            self.base = Landmarks(self.landmarks)
        return self.base.kernels(words) @ self.weights

    def worst(self, texts: Iterable[str | None], memory: dict[str, float]) -> Iterator[tuple[list[float] | None, list[str]]]:
        """Of each text the evidence of its sentences' decision values, and the worst sentence; None for texts without words.

        Evidence: the highest value, the mean of the three highest, and the share of values above 0.
        """
        cut = [sentences(t) for t in texts]
        fresh = list({w: 0 for s in cut for words in s for w in words if w not in memory})
        if len(memory) + len(fresh) > MEMORY:
            memory.clear()
            fresh = list({w: 0 for s in cut for words in s for w in words})
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            memory.update(zip(part, self.words([normalised(w) for w in part]).tolist(), strict=True))
        get = memory.__getitem__
        for found in cut:
            if not found:
                yield None, []
                continue
            values = [sum(map(get, dict.fromkeys(words))) + self.bias for words in found]
            top = sorted(values, reverse=True)[:3]
            yield [top[0], sum(top) / len(top), sum(v > 0 for v in values) / len(values)], found[values.index(top[0])]

    def probability(self, evidence: list[float] | None) -> float:
        z = float(np.dot(self.slopes, evidence if evidence else [self.bias, self.bias, float(self.bias > 0)])) + self.shift
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))


def train(examples: list[list[str]], labels: np.ndarray, landmarks: list[str], cost: float = 4.0, rounds: int = 25) -> Machine:
    """A linear machine in the landmarks' Nyström space, by dual coordinate descent."""
    base = Landmarks(landmarks)
    gram = base.kernels(landmarks)
    roots, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = roots > 1e-6 * roots.max()
    whiten = vectors[:, good] / np.sqrt(roots[good])
    different = [list(dict.fromkeys(map(normalised, s))) for s in examples]
    words = list(dict.fromkeys(w for s in different for w in s))
    place = {w: i for i, w in enumerate(words)}
    each = base.kernels(words)
    kernel = np.array([each[[place[w] for w in s]].sum(axis=0) for s in different])
    x = np.hstack([kernel @ whiten, np.ones((len(examples), 1))])
    sign = np.where(labels > 0, 1.0, -1.0)
    limit = np.where(labels > 0, cost * max(1.0, (labels <= 0).sum() / max(1, (labels > 0).sum()) / 2), cost)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    square = (x**2).sum(1) + 1e-12
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            gradient = sign[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), limit[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x[i]
                alpha[i] = new
    return Machine(landmarks, whiten @ w[:-1], float(w[-1]))


def sigmoid(evidence: np.ndarray, labels: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and shift of a logistic model of the evidence, by Newton steps on Platt's smoothed targets."""
    n1, n0 = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([evidence, np.ones((len(evidence), 1))])
    theta, ridge = np.zeros(x.shape[1]), np.diag([0.1] * evidence.shape[1] + [1e-6])

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float((np.logaddexp(0, z) - target * z).sum() + t @ ridge @ t / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        gradient = x.T @ (p - target) + ridge @ theta
        step, size = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(theta)), gradient), 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return tuple(theta[:-1].tolist()), float(theta[-1])


def spread(words: list[str], n: int, alike: float = 0.7) -> list[str]:
    """The first ``n`` words that have features and are not too much like one before them."""
    words = [w for w in words if sum(c > 0 for c in classes(w)) >= 3]
    if not words:
        return []
    near = Landmarks(words).kernels(words)
    chosen: list[int] = []
    for i in range(len(words)):
        if len(chosen) < n and (near[i, chosen] < alike).all():
            chosen.append(i)
    return [words[i] for i in chosen]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    where: Column | None = None,
    sample_docs: int = 1_500,
    doc_sentences: int = 4,
    landmarks: int = 96,
) -> Machine:
    """The machine, from a bounded sample: ``sample_docs`` labelled documents of each class, the first by hash of their id.

    Documents are read whole, and ``doc_sentences`` different sentences of each
    train the machine: a positive one's most telling, a negative one's by hash.

    ``where`` filters labels by their id. A document is positive if any of its
    labels is 1; null ids and labels teach nothing. Documents carry labels, not
    sentences: positive sentences are first those with the four-letter strings
    most telling of positive documents, then each positive document's worst; negative ones
    come from negative documents, their worst among them. Without both classes
    the machine gives the one class's probability to all.
    """
    known = labels if where is None else labels.where(where)
    known = known.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("i").agg(F.max("y").alias("y"))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(sample_docs) for y in (0, 1)]
    # Twice sample_docs ids at most: a proven bound.
    sample = saved(
        docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "i").select("i", "y", F.coalesce("t", F.lit("")).alias("t"))
    )
    totals = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(totals) < 2:
        prior = float(max(totals)) if totals else 0.0
        return Machine([], np.zeros(0), 0.0, shift=20.0 if prior else -20.0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, words = batch.column("y").to_pylist(), [sorted({u for s in sentences(t) for w in s for u in strings(w)}) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([y for y, ws in zip(ys, words, strict=True) for _ in ws], pa.int32()), pa.array([w for ws in words for w in ws], pa.string())], names=["y", "w"]
            )

    counts = sample.mapInArrow(split, "y int, w string").groupBy("w").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    counts = saved(counts.withColumn("lift", F.col("n1") / totals[1] - F.col("n0") / totals[0]))
    # In standard deviations of the difference between two shares.
    both = F.col("n1") + F.col("n0") + 2.0
    rated = counts.withColumn("z", F.col("lift") / F.sqrt(both * (1 / totals[0] + 1 / totals[1]) / (totals[0] + totals[1]))).where("n1 >= 3 AND z >= 4")
    telling = [(r.w, r.z if r.n1 * totals[0] >= 4 * r.n0 * totals[1] else 0.0) for r in rated.orderBy(F.col("z").desc(), "w").limit(4 * landmarks).collect()]
    usual = [r.w for r in counts.where("n0 >= 2").orderBy(F.xxhash64("w"), "w").limit(landmarks).collect()]
    marks = spread([w for w, _ in telling], landmarks)
    marks = [*marks, *spread([w for w in usual if w not in marks], landmarks // 8)]
    strong = {w: z for w, z in telling if z}
    if not marks:
        return Machine([], np.zeros(0), 0.0, shift=float(np.log(totals[1] / totals[0])))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for y, t in zip(batch.column("y").to_pylist(), batch.column("t").to_pylist(), strict=True):
                # Each sentence by how much it tells, or by chance where none tells anything.
                each = {tuple(s): (-sum(strong.get(g, 0.0) for g in {g for w in s for g in strings(w)}) if y else 0.0, xxhash.xxh3_64_intdigest(" ".join(s))) for s in sentences(t)}
                able = [s for s in each if not y or not strong or each[s][0] < 0]
                out += [(y, list(s)) for s in heapq.nsmallest(doc_sentences, able, key=each.__getitem__)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[], []], (pa.int32(), pa.list_(pa.string())), strict=True)], names=["y", "s"])

    # Bounded by the sample; sorted here, as a distributed sort would read it twice.
    rows = sorted(sample.mapInArrow(drawn, "y int, s array<string>").collect(), key=lambda r: (r.y, r.s))
    examples, marked = [r.s for r in rows], [r.y for r in rows]
    machine = train(examples, np.array(marked), marks)
    worst = worst_sentences(sample, machine)
    kept = [(s, 0) for s, y in zip(examples, marked, strict=True) if not y]
    kept += [(s, y) for _, y, s in worst if s]
    machine = train([s for s, _ in kept], np.array([y for _, y in kept]), marks)
    worst = [x for x in worst_sentences(sample, machine) if x[0] is not None]
    machine.slopes, machine.shift = sigmoid(np.array([d for d, _, _ in worst]), np.array([y for _, y, _ in worst]))
    return machine


def worst_sentences(sample: DataFrame, machine: Machine) -> list[tuple[list[float] | None, int, list[str]]]:
    """For each document of the sample its worst sentence, in the order of ids."""
    shared = sample.sparkSession.sparkContext.broadcast(machine.figures())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = Machine(*shared.value), {}
        for batch in batches:
            found = list(model.worst(batch.column("t").to_pylist(), memory))
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), batch.column("y"), pa.array([d for d, _ in found], pa.list_(pa.float64())), pa.array([s for _, s in found], pa.list_(pa.string()))],
                names=["i", "y", "d", "s"],
            )

    kind = sample.schema["i"].dataType.simpleString()
    rows = sorted(sample.mapInArrow(run, f"i {kind}, y int, d array<double>, s array<string>").collect(), key=lambda r: (r.i, r.s))
    return [(r.d, r.y, r.s) for r in rows]


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text") -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5).

    Whole texts are read. Null, empty and blank texts get the machine's value
    for a sentence without words. Repeated rows are scored each; an empty table
    gives no rows. Columns named like a result are replaced.
    """
    results = ["score", "predicted"]
    docs = docs.drop(*results)
    keep = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(machine.figures())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = Machine(*shared.value), {}
        for batch in slices(batches, 500):
            values = [model.probability(d) for d, _ in model.worst(batch.column(text_col).to_pylist(), memory)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32())], names=[*keep, *results]
            )

    return docs.mapInArrow(run, widened(docs, "score double, predicted int"))
