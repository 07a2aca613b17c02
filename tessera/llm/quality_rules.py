"""Quality rules from cross-document line frequency (DataFrame functions only).

Every line with a word is normalised (white space at the ends off and inside as one space, lower
case) and hashed.  For each host, here ``source``, the distinct documents (rows) that hold a line
are counted.  A line is boilerplate of the host if more than max(min_docs, share * documents of the
host) hold it: the limit is a share, so it means the same at every size.  Documents that keep less
than ``min_left`` of their words without boilerplate are depleted and rejected, and so are those
that fail the base rules: under 50 words, or more than half of the words in 3-word windows that
occur twice or more in the text.

Defined results: a null text has no words and fails the base rules; a null host is a host of its
own; repeated rows are documents of their own; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Workspace, even_join

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def window_hashes(hashes: str) -> Column:
    """A hash of each 3-word window, of the column of the words' hashes; null for fewer than two windows."""
    n = F.size(hashes) - 2
    windows = F.transform(F.slice(hashes, F.lit(1), n), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return F.when(n >= 2, windows)


def without(text: Column, characters: str, put: str = "") -> Column:
    """The text with each of the characters replaced: by bytes, so much faster than translate()."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(put))
    return text


def base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Words in repeated windows: only a text with two equal windows has them sorted, n log n for n
    words, by hash and place.  There equal neighbours are the repeated windows, and in order of
    place each covers the words that the one before didn't.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(without(text, "\t\n\x0b\x0c\r", " "), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    rows = docs.withColumns({"_words": words, "_lines": lines})
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_windows", window_hashes("_hashes"))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("_sorted", F.when(some, F.sort_array(placed)))
    last = F.size("_sorted")
    repeated = F.sort_array(
        F.transform(
            F.filter(
                F.col("_sorted"),
                lambda x, k: ((k > 0) & (F.get("_sorted", k - 1)["h"] == x["h"]))
                | ((k < last - 1) & (F.get("_sorted", k + 1)["h"] == x["h"])),
            ),
            lambda x: x["i"],
        )
    )
    rows = rows.withColumn("_twice", repeated)
    covered = F.aggregate(
        F.transform(
            F.col("_twice"), lambda i, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), i - F.get("_twice", k - 1)))
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("_words", "_hashes", "_windows", "_sorted", "_twice")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.withColumn("base_failed", failed)


def judge(
    docs: DataFrame,
    share: float = 0.02,
    min_docs: int = 10,
    min_left: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """One row for each document: doc_id, the base columns, boilerplate_words and kept."""
    ws = Workspace(docs.sparkSession, "rules")
    rows = base(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("_host")))

    def line(x: Column) -> Column:
        norm = F.lower(F.btrim(F.regexp_replace(x, "[\\x20\\x09-\\x0D]+", " "), F.lit(" ")))
        gaps = F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))
        return F.struct(F.xxhash64(F.lit(3), norm).alias("h"), (gaps + 1).alias("w"))

    hashed = F.sort_array(F.transform("_lines", line))  # equal lines of a document stand together
    rows = rows.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("_host").cast("string")), F.lit("null")).alias("_host"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        hashed.alias("_lines"),
    )
    rows = ws.save(rows, "rows")
    lines = rows.select("_row", "_host", F.inline("_lines").alias("_h", "_w"))
    first = F.transform(
        "_lines", lambda x, k: F.struct(x["h"].alias("_h"), ((k == 0) | (F.get("_lines", k - 1)["h"] != x["h"])).cast("int").alias("_new"))
    )
    counts = rows.select("_host", F.inline(first)).groupBy("_host", "_h")
    counts = counts.agg(F.sum("_new").alias("_docs"), F.count("*").alias("_n")).filter(F.col("_docs") > min_docs)
    hosts = rows.groupBy("_host").agg(F.count("*").alias("_all"), F.sum(F.size("_lines")).alias("_of"))
    total = rows.agg(F.sum(F.size("_lines"))).first()[0] or 0
    often = even_join(counts, hosts, ["_host"], "_of", total).filter(F.col("_docs") > F.col("_all") * F.lit(share))
    often = ws.save(often.select("_host", "_h", "_n"), "often")
    lost = even_join(lines, often, ["_host", "_h"], "_n", total).groupBy("_row").agg(F.sum("_w").alias("_lost"))
    return (
        rows.drop("_lines", "_host")
        .join(lost, "_row", "left")
        .withColumn("boilerplate_words", F.coalesce(F.col("_lost"), F.lit(0)).cast("long"))
        .withColumn(
            "kept",
            ~F.col("base_failed") & (F.col("n_words") - F.col("boilerplate_words") >= F.col("n_words") * F.lit(min_left)),
        )
        .drop("_row", "_lost")
    )
