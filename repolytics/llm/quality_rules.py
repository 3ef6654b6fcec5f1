"""Quality rules in DataFrame functions alone: base rules and cross-document line frequency.

Lines are normalised (lower case, runs of white space one space, trimmed) and hashed.
For every host the distinct documents that hold a line are counted; lines above a limit,
which is the same for every host, are removed from all its documents, and a document that
loses more than half of its words that way is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repolytics.llm.common import checkpointed, heavy_join

SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50
MOST_DOCS = 20
MOST_REMOVED = 0.5
MOST_BROADCAST = 500_000  # line hashes, about 25 MB


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def repeat_words(parts: Column) -> Column:
    """How many words lie in three-word windows that the text holds twice or more.

    Window hashes are sorted with their places; equal neighbours are the repeats.  Their
    places, sorted, cover min(3, distance to the next) words each.  Texts whose window
    hashes all differ skip the sort.
    """

    def places(found: Column) -> Column:
        same = F.filter(
            F.transform(
                found,
                lambda x, i: F.when((x["h"] == F.get(found, i + 1)["h"]) | (x["h"] == F.get(found, i - 1)["h"]), x["i"]),
            ),
            lambda x: x.isNotNull(),
        )
        return let(
            F.sort_array(same),
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda total, n: total + n.cast("long"),
            ),
        )

    def counted(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
                let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)
            ),
        )

    return let(parts, counted)


def normal_lines(text: Column) -> Column:
    """The lines of a text in lower case, white space collapsed, without those that are blank."""
    return F.filter(F.split(F.trim(F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "))), " ?\n ?", -1), lambda x: x != "")


def base(docs: DataFrame) -> DataFrame:
    """The counts of every text and whether the base rules reject it."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CHAR))
    counted = docs.select(
        "doc_id",
        "line_host",
        F.xxhash64("text").alias("text_key"),
        F.size(words(text)).cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words(text)).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def common_lines(docs: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """line_key, line_docs, line_rows of the lines that more than most_docs distinct documents of a host hold.

    Rows with one text are one document, so that a text is not condemned by its own copies.
    Lines are counted straight from the scan, by (line, document) before they meet by line.
    """
    held = docs.select(
        F.xxhash64("text").alias("text_key"),
        F.explode(F.array_distinct(F.transform(normal_lines(F.col("text")), lambda x: F.xxhash64("line_host", x)))).alias("line_key"),
    )
    counted = held.groupBy("line_key").agg(F.count_distinct("text_key").alias("line_docs"), F.count(F.lit(1)).alias("line_rows"))
    return counted.filter(F.col("line_docs") > most_docs)


def line_words_removed(docs: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """doc_id, line_host, text_key, words in lines of which the host has too many.

    Only the hashes of such lines are written; they are broadcast up to MOST_BROADCAST of
    them, and joined by key beyond that, the most frequent ones apart.  Rows that repeat a
    document count each of its lines once.
    """
    common = checkpointed(common_lines(docs, most_docs)).withColumn("over", F.lit(True))
    placed = docs.select("doc_id", "line_host", F.xxhash64("text").alias("text_key"), F.posexplode(normal_lines(F.col("text"))).alias("place", "line"))
    lines = placed.select("doc_id", "line_host", "text_key", "place", F.xxhash64("line_host", "line").alias("line_key"), (F.length("line") - F.length(F.translate("line", " ", "")) + 1).cast("long").alias("n"))
    if common.count() <= MOST_BROADCAST:
        found = lines.join(F.broadcast(common.select("line_key")), "line_key")
    else:
        found = heavy_join(lines, common, "line_key", "line_rows", "over")
    once = found.groupBy("doc_id", "line_host", "text_key", "place").agg(F.max("n").alias("n"))
    return once.groupBy("doc_id", "line_host", "text_key").agg(F.sum("n").alias("n_words_removed"))


def judge(docs: DataFrame, host: str = "source", most_docs: int = MOST_DOCS, most_removed: float = MOST_REMOVED) -> DataFrame:
    """doc_id, counts, base_failed, n_words_removed and kept of every row.

    Null texts count as empty; a null host is the host of no name; rows with one host and
    text count as one document, and each row is judged by its own host; an empty table
    gives an empty result; of further columns of docs only the host is looked at.
    """
    own = docs.select("doc_id", "text", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("line_host"))
    judged, gone = base(own), line_words_removed(own, most_docs).select(F.col("doc_id").alias("gone_id"), F.col("line_host").alias("gone_host"), F.col("text_key").alias("gone_key"), "n_words_removed")
    same = judged["doc_id"].eqNullSafe(gone["gone_id"]) & (judged["line_host"] == gone["gone_host"]) & (judged["text_key"] == gone["gone_key"])
    removed = F.coalesce("n_words_removed", F.lit(0).cast("long"))
    return judged.join(gone, same, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        removed.alias("n_words_removed"),
        (~F.col("base_failed") & (removed <= most_removed * F.col("n_words"))).alias("kept"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host, md5(coalesce(text, '')) AS body FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, unnest(range(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))) AS i FROM d),
t AS (SELECT rid, i, w AS a, lead(w, 1) OVER x AS b, lead(w, 2) OVER x AS c FROM w WINDOW x AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, host, body, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM (SELECT rid, host, body, unnest(string_split(text, chr(10))) AS x FROM d)),
h AS (SELECT host, rid, body, line, sum(len(string_split(line, ' '))) AS n FROM l WHERE line <> '' GROUP BY ALL),
k AS (SELECT host, line FROM h GROUP BY ALL HAVING count(DISTINCT body) > 20),
q AS (SELECT rid, sum(n)::BIGINT AS n FROM h JOIN k USING (host, line) GROUP BY rid),
s AS (SELECT d.rid, doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 (SELECT count(*) - count(DISTINCT x) FROM (SELECT unnest(string_split(text, chr(10))) AS x) WHERE regexp_matches(x, '[^\x20\x09-\x0D]'))::BIGINT AS n_dup_lines,
 coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(q.n, 0)::BIGINT AS n_words_removed FROM d LEFT JOIN r USING (rid) LEFT JOIN q USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, n_words_removed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_removed <= 0.5::DOUBLE * n_words AS kept FROM s
"""
