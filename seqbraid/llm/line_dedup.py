"""Line de-duplication across documents, with DataFrame functions only.

Lines are exploded, their keys hashed, and the documents of every hash counted
with map-side partial aggregates, so a line that half of all documents hold costs
each task one row. What travels is (hash, document, position), never the text;
the text moves once, to meet the list of its dropped positions.

A key that occurs very often would put all its rows into one task when the verdict
is joined back. Such keys are counted rows, not guesses: every key with at least
`hot_rows` lines is looked up in a broadcast table of at most lines / hot_rows
rows, and only the rest meets its verdict by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbraid.llm.common import lookup, materialise, text_of

MIN_CHARS = 10
MIN_DOCS = 2
HOT_ROWS = 10_000
_BLANK = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    stripped = F.trim(line, F.lit(_BLANK))
    # lower() works on bytes where a line is ASCII and equals translate() there only.
    return F.when(F.octet_length(line) == F.length(line), F.lower(stripped)).otherwise(
        F.translate(stripped, _UPPER, _UPPER.lower())
    )


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, version, pos, hash of every line whose key has at least `min_chars` code points.

    `version` is a hash of the text: it tells rows apart that have one id and two texts.
    """
    version = F.xxhash64(text_of()).alias("version")
    lines = docs.select("doc_id", version, F.posexplode(_lines(text_of())).alias("pos", "line"))
    keyed = lines.select("doc_id", "version", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.length("key") >= min_chars).select(
        "doc_id", "version", "pos", F.unhex(F.md5("key")).alias("hash")
    )


def repeated_keys(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """hash, first_doc, n_lines of every key found in at least `min_docs` documents."""
    if min_docs == 2:
        # Two documents or more: the smallest and the largest id differ.
        found = rows.groupBy("hash").agg(
            F.min("doc_id").alias("first_doc"),
            F.max("doc_id").alias("_last"),
            F.count(F.lit(1)).alias("n_lines"),
        )
        return found.filter("first_doc < _last").drop("_last")
    per_doc = rows.groupBy("hash", "doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_doc.groupBy("hash")
        .agg(
            F.min("doc_id").alias("first_doc"),
            F.sum("_n").alias("n_lines"),
            F.count(F.lit(1)).alias("_docs"),
        )
        .filter(F.col("_docs") >= min_docs)
        .drop("_docs")
    )


def dropped_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """doc_id, version and `gone` of the documents that lose any line.

    `gone` has a bit for every position, 64 to a word, so that looking one up takes the
    same time in a text of any number of lines.
    """
    rows = materialise(line_rows(docs, min_chars))
    keys = materialise(repeated_keys(rows, min_docs))
    later = F.col("doc_id") > F.col("first_doc")
    lost = lookup(rows, keys, "hash", "n_lines", hot_rows).filter(later)
    word = F.shiftright("pos", 6)
    words = lost.groupBy("doc_id", "version", word.alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits")
    )
    sparse = words.groupBy("doc_id", "version").agg(
        F.max("word").alias("last"), F.collect_list(F.struct("word", "bits")).alias("words")
    )
    dense = F.expr(
        "transform(sequence(0, last), w -> coalesce(get(filter(words, x -> x.word = w), 0).bits, 0L))"
    )
    return sparse.select("doc_id", "version", dense.alias("gone"))


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`docs` with `text` reassembled from the lines that stay, plus n_lines and n_dropped.

    Keys of at least `min_chars` code points found in at least `min_docs` documents
    lose all their lines except those in the smallest doc_id that holds the key.
    A null or empty text is one empty line and comes back as an empty text. A
    document that loses all lines stays, with an empty text. Rows with one doc_id are
    one document: each loses its lines that a smaller id holds. Rows without an id
    count as no document and keep all lines. Other columns, whatever their names, pass
    through, except that `n_lines` and `n_dropped` are replaced. An empty table gives
    an empty table.
    """
    gone = materialise(dropped_lines(docs, min_chars, min_docs, hot_rows))
    gone = gone.select(
        F.col("doc_id").alias("_gone_id"), F.col("version").alias("_gone_of"), F.col("gone").alias("_gone")
    )
    # The list grows with the documents, so it is merged at every size.
    same = (docs["doc_id"] == gone["_gone_id"]) & (F.xxhash64(text_of()) == gone["_gone_of"])
    joined = docs.join(gone.hint("merge"), same, "left").drop("_gone_id", "_gone_of")
    breaks = F.octet_length(text_of()) - F.octet_length(F.replace(text_of(), F.lit("\n"), F.lit("")))
    kept = F.when(
        F.col("_gone").isNull(), text_of()
    ).otherwise(
        F.array_join(
            F.expr(
                "filter(split(coalesce(text, ''), '\\n', -1), (line, i) -> "
                "(coalesce(get(_gone, shiftright(i, 6)), 0L) & shiftleft(1L, i & 63)) = 0)"
            ),
            "\n",
        )
    )
    return joined.withColumns(
        {
            "n_lines": (breaks + 1).cast("long"),
            "n_dropped": F.coalesce(
                F.expr("aggregate(_gone, 0L, (n, bits) -> n + bit_count(bits))"), F.lit(0)
            ).cast("long"),
            "text": kept,
        }
    ).drop("_gone")
