"""Language-model scoring with a weighted backoff automaton over word bigrams.

Training counts become an automaton: a state for each context, an arc for each
smoothed bigram, and a failure arc with a backoff weight to the state that knows
no context, whose arcs are the smoothed words. A text is scored in one traversal
from left to right that carries the state and adds up log10 probabilities.

The model is as large as the corpus, so no task holds all of it. Documents are
cut into blocks; a block asks for the counts of its own different words and
bigrams only, and builds the part of the automaton that its texts can reach.
Counts are summed in buckets of hash ranges: a block sends each bucket one
packed, sorted list, and gets the corpus counts back in the same order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import mixed, pack, pack_sorted, plain_words, saved, slices, unpack, unpack_sorted

#: Words of a block and entries of a bucket: what a task holds at once, besides one document.
BLOCK_TOKENS, BUCKET_ENTRIES = 1_000_000, 2_000_000
#: Hashes of the end of a text and of the state before its first word.
END, BEGIN = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
#: Bits of a bigram's hash; words keep all 64.
PAIR_BITS = 56
#: Strengths of the words' part that are tried, an eighth of a decade apart.
STRENGTHS = [10 ** (i / 8) for i in range(33)]
#: How many words a task remembers the hash of.
REMEMBERED = 250_000


class WordHashes(dict):
    """Word to 64-bit hash, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def token_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    """The text's words as hashes, then one end."""
    words = plain_words(text)
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    out[-1] = END
    return out


def small(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def large(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


def blocks(docs: DataFrame, id_col: str, text_col: str, train_col: str, block_tokens: int) -> DataFrame:
    """Blocks of documents: ids, training flags, token numbers and the vocabulary they point into; stored."""
    schema = f"block long, n_tokens long, ids array<{docs.schema[id_col].dataType.simpleString()}>, train array<boolean>, lengths binary, vocabulary binary, tokens binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size, number = WordHashes(), [], 0, 0
        kind = None

        def block() -> pa.RecordBatch:
            lengths = np.array([len(t) for _, _, t in held])
            vocabulary, tokens = np.unique(np.concatenate([t for _, _, t in held]), return_inverse=True)
            name = (TaskContext.get().partitionId() << 32) + number
            row = [name, int(lengths.sum()), [i for i, _, _ in held], [f for _, f, _ in held], small(lengths), pack_sorted(vocabulary), small(tokens)]
            types = [pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["block", "n_tokens", "ids", "train", "lengths", "vocabulary", "tokens"]
            )

        for batch in slices(batches):
            kind = batch.column(id_col).type
            for row in zip(*(batch.column(c).to_pylist() for c in (id_col, train_col, text_col)), strict=True):
                held.append((row[0], bool(row[1]), token_hashes(row[2], known)))
                size += len(held[-1][2])
                if size >= block_tokens:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    return saved(docs.select(id_col, text_col, train_col).mapInArrow(run, schema))


class Block:
    """A stored block, and its different bigrams in the order of their hashes."""

    def __init__(self, train: list[bool], lengths: bytes, vocabulary: bytes, tokens: bytes):
        self.vocabulary, self.tokens, self.lengths = unpack_sorted(vocabulary), large(tokens), large(lengths)
        self.ends = np.cumsum(self.lengths)
        self.width = len(self.vocabulary) + 1  # the last state is the one before a text
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[0] = self.width - 1
        before[self.ends[:-1]] = self.width - 1
        self.learned = np.repeat(np.array(train), self.lengths)
        pairs, self.pair_of = np.unique(before * self.width + self.tokens, return_inverse=True)
        states = np.append(self.vocabulary, BEGIN)
        hashes = mixed(states[pairs // self.width], self.vocabulary[pairs % self.width]) >> np.uint64(64 - PAIR_BITS)
        self.order = np.argsort(hashes, kind="stable")
        self.pairs, self.hashes = pairs, hashes[self.order]

    def counted(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Order, sorted hashes, and counts in the block's training documents."""
        yield 1, self.vocabulary, np.bincount(self.tokens[self.learned], minlength=len(self.vocabulary))
        yield 2, self.hashes, np.bincount(self.pair_of[self.learned], minlength=len(self.pairs))[self.order]


class Automaton:
    """The part of the model that a block's texts can reach.

    Words: P(w) = (c(w) + 1) / (N + V + 1). Bigrams, smoothed with the words as
    prior of weight ``strength``: P(w | h) = (c(h w) + strength P(w)) / (c(h) +
    strength); the failure arc of h weighs strength / (c(h) + strength).
    """

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, total: int, distinct: int, strength: float):
        place = total + distinct + 1
        chance = (words + 1) / place
        logs = {int(c): math.log10((c + 1) / place) for c in np.unique(words)}
        self.root = [logs[c] for c in words.tolist()]
        # The state before a text is left once for each training text, as often as texts end.
        at_end = np.searchsorted(block.vocabulary, END)
        left = np.append(words, words[at_end] if at_end < len(words) and block.vocabulary[at_end] == END else 0)
        self.failure = [math.log10(strength / (c + strength)) for c in left.tolist()]
        keys = block.pairs[block.order]
        seen = pairs > 0
        state, word = keys[seen] // block.width, keys[seen] % block.width
        weights = np.log10((pairs[seen] + strength * chance[word]) / (left[state] + strength))
        self.arcs = dict(zip(keys[seen].tolist(), weights.tolist(), strict=True))
        self.start, self.width = block.width - 1, block.width

    def walk(self, tokens: list[int]) -> float:
        """log10 probability of the tokens, from the state before a text."""
        arc, root, failure, width, state = self.arcs.get, self.root, self.failure, self.width, self.start
        steps = []
        for w in tokens:
            weight = arc(state * width + w)
            steps.append(failure[state] + root[w] if weight is None else weight)
            state = w
        return math.fsum(steps)


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    train: Column | None = None,
    strength: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
    bucket_entries: int = BUCKET_ENTRIES,
) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are lower-cased (A-Z) words between ASCII blanks, then one end.
    ``train`` (a condition on the documents; null counts as false) tells those
    that are learned from; ``held_out`` the others. ``base_score`` is the words'
    part alone, ``score`` the automaton's. ``strength`` is fitted to the
    training documents unless one is given: Good and Turing's estimate of the
    share of unseen bigrams is that of the bigrams that occurred once, and the
    strength is the one at which failure arcs have just that weight over all
    training tokens (of STRENGTHS, the nearest). Null texts are empty: one end.
    Repeated rows are learned from and scored each; an empty table gives no
    rows; without training documents every token is unknown. Other columns are
    ignored. Words are told apart by 64-bit hashes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    flag = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    stored = blocks(docs.select(F.col(id_col), F.col(text_col), flag.alias("_train")), id_col, text_col, "_train", block_tokens)
    total = stored.agg(F.sum("n_tokens").alias("n")).collect()[0].n or 0
    bits = max(0, math.ceil(math.log2(max(1, 2 * total / bucket_entries))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *parts in zip(*(batch.column(c).to_pylist() for c in ("block", "train", "lengths", "vocabulary", "tokens")), strict=True):
                rows: list[tuple] = []
                for order, hashes, counts in Block(*parts).counted():
                    top = 64 if order == 1 else PAIR_BITS
                    edges = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(top - bits)) if bits else np.zeros(1, dtype=int)
                    for bucket, (a, b) in enumerate(zip(edges, [*edges[1:], len(hashes)], strict=True)):
                        if b > a:
                            rows.append((bucket, order, name, pack_sorted(hashes[a:b]), pack(counts[a:b])))
                types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "grams", "block", "hashes", "counts"])

    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        rows = sorted(zip(*(asked.column(c).to_pylist() for c in ("grams", "block", "hashes", "counts")), strict=True), key=lambda r: r[:2])
        for order in (1, 2):
            mine = [r for r in rows if r[0] == order]
            if not mine:
                continue
            hashes = [unpack_sorted(r[2]) for r in mine]
            _, place = np.unique(np.concatenate(hashes), return_inverse=True)
            # A sum for each different word or bigram of the bucket.
            sums = np.bincount(place, weights=np.concatenate([unpack(r[3]) for r in mine])).astype(np.int64)
            at = 0
            for r, h in zip(mine, hashes, strict=True):
                out.append((r[1], order, key[0].as_py(), pack(sums[place[at : at + len(h)]]), 0, 0, 0, None))
                at += len(h)
            fails = [float((sums * (s / (sums + s))).sum()) for s in STRENGTHS] if order == 1 else None
            out.append((-order, 0, key[0].as_py(), b"", int(sums.sum()), int((sums > 0).sum()), int((sums == 1).sum()), fails))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
        names = ["block", "grams", "bucket", "sums", "total", "distinct", "once", "fails"]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    asked = stored.mapInArrow(ask, "bucket int, grams int, block long, hashes binary, counts binary")
    answers = saved(asked.groupBy("bucket").applyInArrow(answer, "block long, grams int, bucket int, sums binary, total long, distinct long, once long, fails array<double>"))
    size = answers.where("block = -1").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).collect()[0]
    n_words, n_distinct = size.n or 0, size.v or 0
    if strength is None:
        once = answers.where("block = -2").agg(F.sum("once").alias("n")).collect()[0].n or 0
        fails = answers.where("block = -1").select(F.posexplode("fails").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        weight = {r.i: r.x for r in fails}
        strength = STRENGTHS[min(range(len(STRENGTHS)), key=lambda i: abs(weight.get(i, 0.0) - once))]

    def traverse(key: tuple, own: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("held_out", "n_tokens", "n_known", "base_score", "score")}
        ids: list = []
        for row in own.to_pylist():
            block = Block(row["train"], row["lengths"], row["vocabulary"], row["tokens"])
            sums = {o: [unpack(r) for _, r in sorted((b, r) for g, b, r in zip(*(replies.column(c).to_pylist() for c in ("grams", "bucket", "sums")), strict=True) if g == o)] for o in (1, 2)}
            words, pairs = (np.concatenate(sums[o]).astype(np.int64) for o in (1, 2))
            machine = Automaton(block, words, pairs, n_words, n_distinct, strength)
            known = np.add.reduceat((words > 0)[block.tokens].astype(np.int64), block.ends - block.lengths)
            for flag, end, n in zip(row["train"], block.ends.tolist(), block.lengths.tolist(), strict=True):
                tokens = block.tokens[end - n : end].tolist()
                out["held_out"].append(not flag)
                out["n_tokens"].append(n)
                out["base_score"].append(math.fsum(map(machine.root.__getitem__, tokens)))
                out["score"].append(machine.walk(tokens))
            out["n_known"] += known.tolist()
            ids += row["ids"]
        types = [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        id_type = own.schema.field("ids").type.value_type
        return pa.table({id_col: pa.array(ids, id_type)} | {c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})

    replies = answers.where("block >= 0").select("block", "grams", "bucket", "sums")
    found = stored.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        traverse, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return found.select(id_col, "held_out", "n_tokens", "n_known", F.lit(n_words).cast("long").alias("train_tokens"), "base_score", "score")
