"""Line dedup: lines that stand in several documents stay in one of them, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_tag, unused

#: White space that is stripped (0x20 and 0x09-0x0D), and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    """The lines of a text, split at \\n; a null or empty text is one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line stripped at both ends, A-Z in lower case and every other character as it is."""
    bare = F.btrim(line, F.lit(BLANKS))
    # for pure ASCII `lower` changes A-Z alone, and is much faster than a translation
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, CAPITALS, CAPITALS.lower()))


def _keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, tag, pos, h, h2) of every line whose key is long enough; 96 bits of hash stand for the key."""
    lines = docs.select("id", text_tag("text").alias("tag"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("id", "tag", "pos", line_key(F.col("line")).alias("line_key")).where(F.char_length("line_key") >= min_chars)
    return keys.select("id", "tag", "pos", F.xxhash64("line_key").alias("h"), F.hash("line_key").alias("h2"))


def _dropped(docs: DataFrame, min_documents: int, min_chars: int) -> DataFrame:
    """(id, tag, gone): positions of the lines a text loses, for texts that lose any."""
    lines = _keyed_lines(docs, min_chars)
    # null ids sort before all others inside the struct
    holders = lines.select("h", "h2", F.struct("id").alias("holder")).distinct()
    common = (
        holders.groupBy("h", "h2")
        .agg(F.count(F.lit(1)).alias("documents"), F.min("holder").alias("first"))
        .where(F.col("documents") >= min_documents)
    )
    # one row per key on this side, so that AQE may split the lines of a hot key over many tasks
    repeated = lines.join(common, ["h", "h2"]).where(F.struct("id") > F.col("first"))
    return repeated.groupBy("id", "tag").agg(F.collect_set("pos").alias("gone"))


def kept_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_documents: int = 2, min_chars: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept), a row for each row.

    Lines are told apart by their key (`line_key`). Keys of at least `min_chars` code points that
    stand in at least `min_documents` documents stay only in the document with the smallest id,
    there with all their lines; the other lines are joined again by \\n in their order.

    A null or empty text is one empty line. Rows that share an id are one document when documents
    are counted, and each is put together on its own; a null id is one more document, before all
    others. An empty table gives an empty one; other columns are ignored.
    """
    docs = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    gone = _dropped(docs, min_documents, min_chars).select(F.col("id").alias("its_id"), F.col("tag").alias("its_tag"), "gone")
    whole = docs.select("id", text_tag("text").alias("tag"), lines_of(F.col("text")).alias("lines"))
    both = whole.join(gone, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("tag") == F.col("its_tag")), "left")
    n_lines = F.size("lines")
    # a hash set difference and a look-up per kept line: linear in the lines, however many go
    left = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.coalesce("gone", F.array().cast("array<int>")))
    rows = both.select("id", n_lines.cast("long").alias("n_lines"), "lines", "gone", left.alias("left"))
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    )
    return rows.select(
        F.col("id").alias("doc_id"), "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), kept.alias("kept")
    )


def without_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_documents: int = 2, min_chars: int = 10) -> DataFrame:
    """The rows with all their columns, and in `text` only the lines `kept_lines` keeps.

    Nulls, repeated and missing ids as there; a text that loses nothing stays as it is, null included.
    """
    names = {n: unused(df, n) for n in ("gone", "its_id", "its_tag", "lines")}
    docs = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    gone = _dropped(docs, min_documents, min_chars).toDF(names["its_id"], names["its_tag"], names["gone"])
    same = F.col(f"`{key}`").eqNullSafe(F.col(names["its_id"])) & (text_tag(text) == F.col(names["its_tag"]))
    both = df.withColumn(names["lines"], lines_of(F.col(f"`{text}`"))).join(gone, same, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(names["lines"]) - 1), F.col(names["gone"]))
    kept = F.array_join(F.transform(left, lambda i: F.get(names["lines"], i)), "\n")
    content = F.when(F.col(names["gone"]).isNull(), F.col(f"`{text}`")).otherwise(kept)
    return both.withColumn(text, content).select(*[f"`{c}`" for c in df.columns])


def kept_digests(df: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) from `kept_lines`; its cases hold."""
    kept = kept_lines(df, **options)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
