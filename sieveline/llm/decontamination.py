"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.
The automaton's alphabet is the benchmark's vocabulary, one symbol a word, and
its patterns are the windows of consecutive item words; a document is scanned
once, word by word, and every hit carries its offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import ALNUM, saved, slices, widened

#: Words of one automaton; larger benchmarks are scanned for in several passes.
BLOCK_WORDS = 1_000_000
#: Symbols of an automaton's alphabet, one a word; and the column that carries hits from pass to pass.
OTHER, FIRST_SYMBOL, HITS = "\x01", 0xE000, "_hits"
MOST_SYMBOLS = 0x110000 - FIRST_SYMBOL
RUN = re.compile(rb"[^\x20]+")


def windows(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """All runs of ``width`` words; a shorter list is one window, an empty one none."""
    if len(words) <= width:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


class Matcher:
    """The automaton of a block of items: ``(item_id, text)`` pairs."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.symbols: dict[bytes, str] = {}
        patterns: dict[str, list[str]] = {}
        for item_id, text in items:
            for window in windows((text or "").encode("utf-8", "replace").translate(ALNUM).split(), width):
                key = "".join(self.symbols.setdefault(w, chr(len(self.symbols) + FIRST_SYMBOL)) for w in window)
                owners = patterns.setdefault(key, [])
                if not owners or owners[-1] != item_id:
                    owners.append(item_id)
        self.automaton = ahocorasick.Automaton()
        for key, owners in patterns.items():
            self.automaton.add_word(key, (len(key), tuple(owners)))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """Hits as (first word, word after the last, item ids)."""
        if self.empty or not words:
            return []
        get = self.symbols.get
        line = "".join([get(w, OTHER) for w in words])
        return [(end + 1 - n, end + 1, owners) for end, (n, owners) in self.automaton.iter(line)]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, width: int) -> Iterator[list[tuple[str, str]]]:
    """The items, in blocks of bounded size; the driver holds two at a time.

    An item longer than a block is cut into pieces that overlap by all but one word of a window. No items are one empty block.
    """
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    block, size = [], 0
    for row in rows.where("t is not null").orderBy("i", "t").toLocalIterator():
        words = row.t.encode("utf-8", "replace").translate(ALNUM).split()
        step = max(block_words, width)
        for start in range(0, max(1, len(words) - width + 1), step):
            piece = words[start : start + step + width - 1]
            if block and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append((row.i, b" ".join(piece).decode()))
            size += len(piece)
    yield block


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``items`` and ``spans`` (code-point offsets of hit stretches).

    A word inside any occurrence of a window counts as hit once, however many
    windows, items or blocks cover it. A null or empty text has no words and no
    hits; so has any text against an empty benchmark. Null item ids count as
    the empty string; repeated items and repeated documents are each reported
    as they stand. Columns named like a result are replaced. A benchmark of
    more than ``block_words`` words takes a pass over the documents for each
    block, whose result is stored; one block at a time goes to every task.
    """
    if block_words + width > MOST_SYMBOLS:
        raise ValueError(f"an automaton tells {MOST_SYMBOLS} different words apart")
    found = docs.drop(*(f.name for f in RESULTS), HITS)
    ahead = None
    for block in blocks(benchmark, item_id_col, item_text_col, block_words, width):
        # A pass for each block, so that a task holds one automaton, and a stored result between, so that passes don't run at once.
        if ahead is not None:
            found = saved(scanned(found, ahead, text_col, width, last=False))
        ahead = block
    return scanned(found, ahead, text_col, width, last=True)


#: What the last pass adds; and the hits that the others carry along.
RESULTS = pa.schema(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
CARRIED = pa.schema([(HITS, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("items", pa.list_(pa.string()))])))])
DDL = {True: "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>", False: f"{HITS} array<struct<start:long,end:long,items:array<string>>>"}


def scanned(docs: DataFrame, block: list[tuple[str, str]], text_col: str, width: int, last: bool) -> DataFrame:
    """The documents with the hits of a block of items added to those of earlier ones, or, in the last pass, what all hits tell."""
    # One block of a checked size; the automaton is built once a worker and kept beside the items it was built from.
    shared = docs.sparkSession.sparkContext.broadcast({"items": block})
    keep = [c for c in docs.columns if c != HITS]
    schema = widened(docs.drop(HITS), DDL[last])
    added = RESULTS if last else CARRIED

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "matcher" not in held:
            held["matcher"] = Matcher(held["items"], width)
        matcher = held["matcher"]
        for batch in slices(batches):
            before = batch.column(HITS).to_pylist() if HITS in batch.schema.names else [()] * batch.num_rows
            rows: list[tuple] = []
            for text, old in zip(batch.column(text_col).to_pylist(), before, strict=True):
                raw = text.encode("utf-8", "replace") if text else b""
                words = raw.translate(ALNUM).split()
                hits = [*((h["start"], h["end"], h["items"]) for h in old), *matcher.scan(words)]
                if last:
                    stretches = merged(hits)
                    rows.append((len(words), sum(e - s for s, e in stretches), sorted({i for *_, own in hits for i in own}), offsets(raw, stretches)))
                else:
                    rows.append(([{"start": s, "end": e, "items": own} for s, e, own in hits],))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), added, strict=True)] if rows else [pa.array([], f.type) for f in added]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *added.names])

    return docs.mapInArrow(scan, schema)


def merged(hits: list[tuple]) -> list[tuple[int, int]]:
    """The union of the hits' word ranges."""
    out: list[tuple[int, int]] = []
    for s, e in sorted({h[:2] for h in hits}):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def offsets(raw: bytes, stretches: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as code-point ranges of the original text."""
    if not stretches:
        return []
    at = [m.span() for m in RUN.finditer(raw.translate(ALNUM))]
    return [
        {"start": (a := len(raw[: at[s][0]].decode())), "end": a + len(raw[at[s][0] : at[e - 1][1]].decode())}
        for s, e in stretches
    ]

