"""Line dedup: drops lines whose normalised form occurs in many documents. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import ascii_lower, checkpointed, unwrapped, wrapped

#: What is stripped at both ends of a line: [\x20\x09-\x0D].
STRIPPED = " \t\n\x0b\x0c\r"
MADE = ("kept_text", "n_lines", "n_dropped")


def line_keys(text: Column) -> Column:
    """The normalised lines of a text: A-Z lower-cased, white space stripped at both ends."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.trim(x, F.lit(STRIPPED)))


def _hash(key: Column) -> Column:
    """128 bits of a line's key: at 10^12 different lines a collision anywhere has a chance below 10^-14."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Adds to docs the columns kept_text (string), n_lines and n_dropped (long); `text` (string) is read, all columns stay.
    Columns of docs with those names, in any case, are replaced; any other names do no harm.

    A line's key is the line with [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased; keys of at least min_chars
    code points found in at least min_docs documents lose all their lines in every row. A document is a doc_id: rows
    that share one count once, rows without one, or all if docs has no such column, count each. Every row is
    reassembled by itself. Null and empty texts are one empty line and stay as an empty text. A very long text is a row
    of one task, and a place for each of its lines that goes; time grows with its lines.

    Lines are exploded only as 128-bit hashes. The places to drop come back a document, in order, keyed by a 128-bit hash
    of its doc_id, if it has one, and its text, and what stands between them is put together in place.
    """
    named = "doc_id" in (c.lower() for c in docs.columns)
    # the text is read from the row, so that it is shuffled once
    text = F.coalesce(F.col("row").getField(_name(docs, "text")).cast("string"), F.lit(""))
    own = [F.col("row").getField(_name(docs, "doc_id"))] if named else []
    # the row's key: of all it is known by, so that copies of a text under other ids are dealt to different tasks
    rows = wrapped(docs, MADE).withColumns({"ka": F.xxhash64(*own, text), "kb": F.xxhash64(F.lit(11), *own, text)})
    ids, by = [c.alias("doc_id") for c in own], ["doc_id"] * named
    # a row for each document and key, so that partial sums leave one row a key and task, however hot the key
    # (outer: a plain explode would have the optimizer compute all lines once more, to see that there are any)
    keys = rows.select("ka", "kb", *ids, F.explode_outer(F.array_distinct(line_keys(text))).alias("key"))
    keys = keys.where(F.length("key") >= min_chars).select("ka", "kb", *by, _hash(F.col("key")).alias("h")).select("ka", "kb", *by, "h.a", "h.b")
    counted = keys
    if named and not rows.select(*ids).where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).isEmpty():
        # only where ids repeat do lines have to be told apart by document; else a row is one
        counted = keys.where("doc_id is not null").select("doc_id", "a", "b").distinct().unionByName(keys.where("doc_id is null").select("doc_id", "a", "b"))
    # cut off, so that both sides of the join are plain shuffles and a hot key's rows can be split over tasks
    often = checkpointed(counted.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("a", "b"))
    # all lines with their places, repeats included: what comes back of a document are the places to drop
    places = rows.select("ka", "kb", F.posexplode_outer(line_keys(text)).alias("at", "key")).where(F.length("key") >= min_chars).select("ka", "kb", "at", _hash(F.col("key")).alias("h"))
    gone = places.select("ka", "kb", "at", "h.a", "h.b").join(often, ["a", "b"]).groupBy("ka", "kb").agg(F.sort_array(F.collect_set("at")).alias("drop"))
    out = rows.join(gone, ["ka", "kb"], "left").withColumn("lines", F.split(text, "\n", -1))
    # what stands between two places to drop stays, so a document takes time in proportion to its lines
    n_lines, n_dropped = F.size("lines"), F.coalesce(F.size("drop"), F.lit(0))
    after, before = F.concat(F.array(F.lit(-1)), F.col("drop")), F.concat(F.col("drop"), F.array(n_lines))
    kept = F.flatten(F.zip_with(after, before, lambda a, b: F.slice("lines", a + 2, b - a - 1)))
    kept_text = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return unwrapped(out.withColumns({"kept_text": kept_text, "n_lines": n_lines.cast("long"), "n_dropped": n_dropped.cast("long")}), docs, MADE)


def _name(docs: DataFrame, name: str) -> str:
    return next(c for c in docs.columns if c.lower() == name)
