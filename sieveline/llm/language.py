"""Language identification by compression with per-language dictionaries.

A text is cut into blocks, and each block is encoded with zstandard once for
every language's raw-content dictionary; the language with the smallest sum of
sizes wins. A narrow margin between the best two is a rejection.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sieveline.llm.common import slices, widened

UNKNOWN = "und"
#: Languages whose dictionaries a task may hold.
MOST_LANGS = 500
LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes of a block, so that a long text's own history can't hide the dictionary; and a run that is no language's before
#: each: the library stores a very short block as it is, at the same size under every dictionary, but not one that the run opens.
BLOCK, RUN = 1_000, b"a" * 200


def normalised(text: str | None) -> str:
    """Lower-cased runs of letters, one blank between them; empty if there is none."""
    return " ".join(LETTERS.findall(text.lower())) if text else ""


def fit(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    where: Column | None = None,
    sample_docs: int = 100,
    most_langs: int = MOST_LANGS,
) -> dict[str, bytes]:
    """A raw-content dictionary for each language of ``lang_col``.

    Bounded sample: ``sample_docs`` labelled texts a language, the first by a
    hash of text and language; each is learned whole. Null texts and languages
    teach nothing; repeated texts count once, however many rows repeat them. No
    labelled row gives no dictionary. The most frequent language comes first.
    More than ``most_langs`` languages are refused, as every task holds a
    dictionary of each.
    """
    rows = docs if where is None else docs.where(where)
    rows = rows.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.where("l IS NOT NULL AND t IS NOT NULL").withColumn("h", F.xxhash64("t", "l"))
    # Two numbers a language; the dictionaries that follow from them take far more of the driver.
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts")).limit(most_langs + 1)
    counts = {r.l: r for r in sizes.collect()}
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not counts:
        return {}
    shares = {lang: min(1.0, 4.0 * sample_docs / max(1, r.texts)) for lang, r in counts.items()}
    texts = sampled(rows, shares, sample_docs)
    # Numbers of texts are estimates: a language whose share gave too few is drawn again from all its texts.
    got = Counter(r.l for r in texts)
    short = {lang: 1.0 for lang, share in shares.items() if share < 1 and got[lang] < sample_docs}
    if short:
        texts = [r for r in texts if r.l not in short] + sampled(rows, short, sample_docs)
    found: dict[str, list[str]] = {}
    for row in sorted(texts, key=lambda r: (-counts[r.l].n, r.l, r.h)):
        found.setdefault(row.l, []).append(normalised(row.t))
    out = {}
    for lang, parts in found.items():
        joined = "\n".join(dict.fromkeys(parts)).encode()
        if len(joined) >= 8:  # the library's least
            out[lang] = joined
    return out


def sampled(rows: DataFrame, shares: dict[str, float], sample_docs: int) -> list[Row]:
    """l, h and t of the ``sample_docs`` texts with the lowest hashes of each language, among the given share of its hashes."""
    # Only hashes are ranked, and only those low enough to stand a chance; the few chosen texts are fetched afterwards.
    bounds = F.create_map(*(F.lit(x) for lang, share in shares.items() for x in (lang, int(2**63 * (2 * share - 1)) - 1)))
    low = rows.select("l", "h").where(F.col("h") <= F.element_at(bounds, F.col("l"))).distinct()
    chosen = low.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= sample_docs).drop("r")
    # sample_docs pairs of language and hash for each language: a proven bound, so they are broadcast.
    # A row of its own before the next shuffle, however many rows repeat a text.
    return rows.join(F.broadcast(chosen), ["l", "h"], "left_semi").groupBy("l", "h").agg(F.min("t").alias("t")).collect()


class Classifier:
    """Sizes under each dictionary, and the decision they give."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 10, sharpness: float = 50.0):
        self.langs = list(dictionaries)
        self.sharpness = sharpness
        self.coders = [self.coder(d, level) for d in dictionaries.values()]

    @staticmethod
    def coder(content: bytes, level: int):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def sizes(self, letters: str) -> list[int]:
        raw = letters.encode("utf-8", "replace")
        parts = [RUN + raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(code(p)) for p in parts) for code in self.coders]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin; unknown without letters or languages.

        The margin is how much smaller the best size is than the next, as a share of the next. The score falls with the
        same shares of all other languages, so a margin of 0.05 to one other language is a score of 0.93, and a tie one of 0.5.
        """
        letters = normalised(text)
        if not letters or not self.langs:
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(letters)
        best, *rest = sorted(range(len(sizes)), key=sizes.__getitem__)
        score = 1 / sum(math.exp(self.sharpness * (sizes[best] - s) / s) for s in sizes)
        margin = (sizes[rest[0]] - sizes[best]) / sizes[rest[0]] if rest else 1.0
        return self.langs[best], score, margin


def classify(docs: DataFrame, dictionaries: dict[str, bytes], *, text_col: str = "text", min_margin: float = 0.05) -> DataFrame:
    """The documents with ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``accepted``.

    Whole texts are encoded, however short or long, in the same way. A text
    that is null, empty or without letters is ``und``, has score 0 and is
    rejected; so is every text without dictionaries. ``accepted`` is false when
    the best two languages are less than ``min_margin`` apart, as a share of the
    second's size; ties go to the more frequent language and are rejected, and
    a single language is never rejected. Repeated rows are classified each, an
    empty table gives no rows, columns named like a result are replaced.
    """
    results = ["lang_pred", "score", "margin", "accepted"]
    docs = docs.drop(*results)
    keep = docs.columns
    schema = widened(docs, "lang_pred string, score double, margin double, accepted boolean")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # sample_docs texts of at most MOST_LANGS languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in slices(batches):
            found = [model.classify(t) for t in batch.column(text_col).to_pylist()]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())]
            columns.append(pa.array([x[0] != UNKNOWN and x[2] >= min_margin for x in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *results])

    return docs.mapInArrow(run, schema)
