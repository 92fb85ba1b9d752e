"""Secret scans with corpus-wide ownership frequency.

Candidate spans are found with regular expressions; the hashes of their values
are counted by distinct repositories and owners over the whole corpus. A value
that many owners hold is a widely copied example; one that few hold is a
live-looking credential. Everything here is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import saved

#: The words before an assigned secret, and the kinds of spans in order.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
KINDS = ("assign", "access", "hex", "block", "url", "opaque")
#: Kinds before this one are base spans; and spans that may be sent to every task.
BASE, MOST_SENT = 3, 1_000_000


def either_case(word: str) -> str:
    """The word as a pattern that takes ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Added by the method, where few owners hold them: private keys, passwords in URLs, and long strings without a name before them.
BLOCK = r"-----BEGIN[A-Z ]*PRIVATE KEY-----[^-]+-----END[A-Z ]*PRIVATE KEY-----"
URL = r"""://[^\x20\x09-\x0D/:@"'<>]+:[^\x20\x09-\x0D/@"'<>]+@"""
OPAQUE = "[A-Za-z0-9+/_-]{20,}"
#: An opaque string goes from letter to digit three times at least; words and dates joined by dashes don't.
MIXED = "[A-Za-z][0-9].*[A-Za-z][0-9].*[A-Za-z][0-9]"
PATTERNS = (ASSIGN, ACCESS, HEX, BLOCK, URL, OPAQUE)


def matches(text: Column, kind: int) -> Column:
    """All leftmost non-overlapping matches as array of (kind, i, found, gap): gap is the distance from the match before."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m.alias("found"), F.element_at(gaps, i + 1).alias("gap")))
    # The cheap test first: most texts hold no candidate, and are not split.
    return F.when(text.rlike(pattern), zipped).otherwise(F.array().cast("array<struct<kind:int,i:int,found:string,gap:int>>"))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """A row for each document: row, id, owner, text_hash and its hits; no text, and stored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hits = F.concat(*(matches(text, k) for k in range(len(PATTERNS))))
    return saved(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.col(owner_col).cast("string").alias("owner"),
            F.xxhash64(text).alias("text_hash"),
            hits.alias("hits"),
        )
    )


def located(rows: DataFrame) -> DataFrame:
    """One row a span that passes its kind's test, or one with kind null for a document without any: start, end, value_hash."""
    spread = rows.select("row", "id", "owner", "text_hash", F.explode_outer("hits").alias("hit")).select("row", "id", "owner", "text_hash", "hit.*")
    along = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spread = spread.withColumn("end", F.sum((F.col("gap") + F.length("found")).cast("long")).over(along))
    spread = spread.withColumn("start", F.col("end") - F.length("found"))
    spread = spread.withColumn("value", F.when(F.col("kind") == 0, F.regexp_extract("found", ASSIGN, 2)).otherwise(F.col("found")))
    passes = F.when(F.col("kind") == 0, F.length("value") >= 6).when(F.col("kind") == 5, F.col("value").rlike(MIXED)).otherwise(F.lit(True))
    around = Window.partitionBy("row").orderBy("start", "kind")

    def touched(upto: int) -> Column:
        """Whether a span of a kind before ``upto`` shares a character."""
        other = (F.col("kind") < upto) & passes
        return F.coalesce(F.max(F.when(other, F.col("end"))).over(around.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start"), F.lit(False)) | F.coalesce(
            F.min(F.when(other, F.col("start"))).over(around.rowsBetween(1, Window.unboundedFollowing)) < F.col("end"), F.lit(False)
        )

    # What touches a span of an earlier kind is that span's; private keys stay whatever they hold.
    keep = passes & F.when(F.col("kind") == 4, ~touched(4)).when(F.col("kind") == 5, ~touched(5)).otherwise(F.lit(True))
    kind = F.when(keep, F.col("kind"))
    digest = F.coalesce(F.when(keep, F.sha2("value", 256)), F.concat(F.lit("row"), F.col("row").cast("string")))
    return spread.select("row", "id", "owner", "text_hash", kind.alias("kind"), "start", "end", digest.alias("value_hash"))


def ownership(spans: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repos, top_repos: distinct owners, repositories (documents by owner), and those of the owner with most.

    Duplicates go before each shuffle, so that a value copied a billion times
    arrives as one row an owner from each task.
    """
    held = spans.where("kind IS NOT NULL").select("value_hash", "owner", "id").distinct()
    by_owner = held.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.max("repos").alias("top_repos"))


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    copied_owners: int = 3,
    own_tenths: int = 9,
    most_sent: int = MOST_SENT,
) -> DataFrame:
    """Per document: id, text_hash, ``spans``, n_live and n_copied; spans are (start, kind, end, live, at) by start and kind.

    A value is a copied example if ``copied_owners`` owners or more hold it and
    none of them has ``own_tenths`` tenths of the repositories that do; else it
    is live-looking: few have it, or it is one owner's own that leaked into
    others' repositories. Base spans (assign, access, hex) always stay, and
    ``live`` tells the verdict; spans of the other kinds are added only if they
    are live. ``n_live`` and ``n_copied`` count both, added candidates that were
    judged copied among them. ``at`` is how far live spans before reach.

    Offsets are code points, end exclusive. A null text is empty; a null owner
    counts as one owner, a null id as one repository. Repeated rows are reported
    each, other columns are ignored, an empty table gives no rows. Only values
    that many owners hold are looked up; their list goes to every task if it has
    at most ``most_sent`` values.
    """
    rows = candidates(docs, id_col, text_col, owner_col)
    spans = located(rows)
    wide = (F.col("n_owners") >= copied_owners) & (10 * F.col("top_repos") < own_tenths * F.col("n_repos"))
    copied = saved(ownership(spans).where(wide).select("value_hash", F.lit(True).alias("copied")))
    copied = F.broadcast(copied) if copied.limit(most_sent + 1).count() <= most_sent else copied.hint("merge")
    judged = spans.join(copied, "value_hash", "left").withColumn("live", F.col("kind").isNotNull() & F.col("copied").isNull())
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    judged = judged.withColumn("at", F.coalesce(F.max(F.when(F.col("live"), F.col("end"))).over(before), F.lit(0).cast("long")))
    span = F.when(F.col("kind").isNotNull() & ((F.col("kind") < BASE) | F.col("live")), F.struct("start", "kind", "end", "live", "at"))
    return (
        judged.groupBy("row", "id", "text_hash")
        .agg(F.sort_array(F.collect_list(span)).alias("spans"), F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_copied"))
        .drop("row")
        .withColumnRenamed("id", id_col)
    )


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """The documents with each live span's text replaced by ``[kind]``; texts without one stay as they are.

    Overlapping spans are replaced once, under the first one's kind. Documents
    meet their spans by id and text, so repeated ids with other texts are safe.
    Only documents with live spans are looked up; up to ``most_sent`` spans go
    to every task, so that texts stay where they are, and more meet them in a shuffle.
    """
    live = found.select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"), F.filter("spans", lambda s: s["live"]).alias("_spans"))
    live = saved(live.where(F.size("_spans") > 0).dropDuplicates(["_id", "_hash"]))
    n = live.agg(F.sum(F.size("_spans")).alias("n")).collect()[0].n or 0
    live = F.broadcast(live) if n <= most_sent else live.hint("merge")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    both = docs.join(live, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left")
    kinds = F.array(*map(F.lit, KINDS))
    # A span that starts within those before it is already gone with them.
    pieces = F.transform(
        F.filter("_spans", lambda s: s["start"] >= s["at"]),
        lambda s: F.concat(F.substring(text, (s["at"] + 1).cast("int"), (s["start"] - s["at"]).cast("int")), F.lit("["), F.element_at(kinds, s["kind"] + 1), F.lit("]")),
    )
    rest = F.substring(text, (F.array_max(F.transform("_spans", lambda s: s["end"])) + 1).cast("int"), F.length(text))
    clean = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return both.withColumn(text_col, clean).select(docs.columns)
