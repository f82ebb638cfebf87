"""Operator 9: quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text.  The line rule counts, for each host and normalised line, the
distinct documents that hold it; exact copies of a text count once, since copies are for
the near-duplicate stage to judge.  A line is boilerplate if more than `min_docs` documents
and more than `max_share` of the host's hold it; a document of which less than `min_left`
of the words remain without such lines is depleted and rejected.  `rules` and `keep` judge
by these limits alone, as the SQL does; `apply` takes the lower of the share and `MAX_DOCS`
documents, so that large hosts are cleaned like small ones, and removes the lines from the
texts that it keeps.

Counts are pre-aggregated where the rows are read, first by (host, line, text), so neither
a hot host nor a hot line gathers in a task.  Line and text identities are 64-bit hashes.

Null texts count as empty, null hosts as one host; an empty text fails the base rule; texts of any
length are read whole; rows repeated with any key get the same verdict, so there are no ties; an
empty table gives an empty table; other columns are passed over (`rules`, whose own replace those
of the same name) or kept as they are (`keep`, `apply`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: White space between words, and the characters counted as symbols.
BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_DOCS, MAX_SHARE, MIN_LEFT = 10, 0.10, 1 / 3
#: Documents of a host that may hold a line, however large the host.
MAX_DOCS = 100


def let(value: Column, body) -> Column:
    """`body(value)`, with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def without_blanks(text: Column) -> Column:
    return F.translate(text, BLANKS + " ", "")


def repeated_words(found: Column) -> Column:
    """Words inside windows of three that occur twice or more: windows sorted by hash stand
    beside their equals; the union of the repeated ones' spans is summed in text order."""
    # windows of equal hash need a sort only where there are any
    windows = F.when(
        F.size(found) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(found) - 3),
            lambda i: F.struct(F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)).alias("h"), i.alias("i")),
        ),
    )

    def union(ordered: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            beside = lambda k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
            return beside(i - 1) | beside(i + 1)

        places = F.array_sort(F.transform(F.filter(ordered, twin), lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n")),
            lambda acc: acc["n"],
        )

    def counted(made: Column) -> Column:
        hashes = F.transform(made, lambda x: x["h"])
        return F.when(F.size(F.array_distinct(hashes)) < F.size(made), let(F.array_sort(made), union))

    return F.coalesce(let(windows, counted), F.lit(0).cast("long"))


def base(frame: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the counts of the base rules and their verdict."""
    t = F.coalesce(F.col(text), F.lit(""))

    def counts(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_words"), repeated_words(found).alias("n_repeat_words"))

    lines = F.filter(F.split(t, "\n"), lambda line: without_blanks(line) != "")
    return (
        frame.withColumn("__counts", let(words(t), counts))
        .withColumn("n_words", F.col("__counts.n_words"))
        .withColumn("word_chars", F.length(without_blanks(t)).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", F.col("__counts.n_repeat_words"))
        .drop("__counts")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def normal_line(line: Column) -> Column:
    """Lower case; digits, punctuation and white space of ASCII become single spaces."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x00-\x60\x7B-\x7F]+", " "))


def judged(frame: DataFrame, host: str, text: str, min_docs: int, max_share: float, max_docs: int | None) -> DataFrame:
    """host, text_hash, line_hash, n (words) and boilerplate (null: none) of all lines.  The texts are
    cut into lines once; counts and joins read the narrow table of those."""
    t = F.coalesce(F.col(text), F.lit(""))
    texts = frame.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64(t).alias("text_hash"), t.alias("t"))

    def of_line(x: Column) -> Column:
        return let(normal_line(x), lambda line: F.struct(F.when(line != "", F.xxhash64(line)).alias("line_hash"), F.size(words(x)).alias("n")))

    found = F.filter(F.transform(F.split("t", "\n"), of_line), lambda x: x["line_hash"].isNotNull())
    # a row without line stands for the text itself
    itself = F.array(F.struct(F.lit(None).cast("long").alias("line_hash"), F.lit(0).alias("n")))
    every = written(texts.select("host", "text_hash", F.inline(F.concat(itself, found))), "lines")
    lines = every.filter("line_hash IS NOT NULL")
    hosts = every.filter("line_hash IS NULL").groupBy("host").agg(F.count_distinct("text_hash").alias("host_docs"))
    share = max_share * F.col("host_docs")
    frequent = (
        lines.groupBy("host", "line_hash")
        .agg(F.count_distinct("text_hash").alias("docs"))
        .filter(F.col("docs") > min_docs)
        .join(hosts, "host")
        .filter(F.col("docs") > (share if max_docs is None else F.least(share, F.lit(float(max_docs)))))
        .select("host", "line_hash", F.lit(1).alias("boilerplate"))
    )
    return lines.join(frequent, ["host", "line_hash"], "left")


def left() -> list[Column]:
    """Words of a text, and those outside its host's boilerplate."""
    return [F.sum("n").alias("all_words"), F.sum(F.when(F.col("boilerplate").isNull(), F.col("n")).otherwise(0)).alias("left_words")]


def depleted(frame: DataFrame, host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int | None = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """Host and text hash of the texts that consist mostly of their host's boilerplate."""
    # copies of a text add the same lines each: shares do not depend on their number
    return (
        judged(frame, host, text, min_docs, max_share, max_docs)
        .groupBy("host", "text_hash")
        .agg(*left())
        .filter(F.col("left_words") < min_left * F.col("all_words"))
        .select("host", "text_hash", F.lit(True).alias("depleted"))
    )


def rules(frame: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The frame with the base counts, base_failed and kept."""
    marked = base(frame, text).withColumn("__host", F.coalesce(F.col(host), F.lit(""))).withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    marked = marked.drop(text)
    poor = depleted(frame, host, text).withColumnsRenamed({"host": "__host", "text_hash": "__hash", "depleted": "__depleted"})
    return marked.join(poor, ["__host", "__hash"], "left").withColumn("kept", ~F.col("base_failed") & F.col("__depleted").isNull()).drop("__host", "__hash", "__depleted")


def keep(frame: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of the frame that the rules keep, with their columns as they were."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = frame.select(F.struct(*frame.columns).alias("__row"), t.alias("__t"), F.coalesce(F.col(host), F.lit("")).alias("__host"), F.xxhash64(t).alias("__hash"))
    passed = base(rows, "__t").filter(~F.col("base_failed")).select("__row", "__host", "__hash")
    poor = depleted(frame, host, text).select(F.col("host").alias("__host"), F.col("text_hash").alias("__hash"))
    return passed.join(poor, ["__host", "__hash"], "left_anti").select("__row.*")


def apply(
    frame: DataFrame, host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int | None = MAX_DOCS, min_left: float = MIN_LEFT
) -> DataFrame:
    """The rows that pass, their texts without their host's boilerplate lines; the rules judge
    the texts as they came.  A column n_chars follows the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = frame.select(F.struct(*frame.columns).alias("__row"), t.alias("__t"), F.coalesce(F.col(host), F.lit("")).alias("__host"), F.xxhash64(t).alias("__hash"))
    passed = base(rows, "__t").filter(~F.col("base_failed")).select("__row", "__host", "__hash")
    touched = (
        judged(frame, host, text, min_docs, max_share, max_docs)
        .groupBy("host", "text_hash")
        .agg(*left(), F.collect_set(F.when(F.col("boilerplate").isNotNull(), F.col("line_hash"))).alias("__lines"))
        .filter(F.size("__lines") > 0)
        .select(F.col("host").alias("__host"), F.col("text_hash").alias("__hash"), "__lines", (F.col("left_words") < min_left * F.col("all_words")).alias("__depleted"))
    )
    found = passed.join(touched, ["__host", "__hash"], "left").filter(~F.coalesce("__depleted", F.lit(False)))
    whole = F.col(f"__row.`{text}`")
    rest = F.array_join(F.filter(F.split(whole, "\n"), lambda x: ~F.array_contains("__lines", F.xxhash64(normal_line(x)))), "\n")
    cleaned = found.select("__row", "__lines", F.when(F.col("__lines").isNull(), whole).otherwise(rest).alias("__text"))

    def column(name: str) -> Column:
        old = F.col(f"__row.`{name}`")
        if name == text:
            return F.col("__text").alias(name)
        if name == "n_chars":
            return F.when(F.col("__lines").isNull(), old).otherwise(F.length("__text").cast(frame.schema[name].dataType)).alias(name)
        return old.alias(name)

    return cleaned.select(*map(column, frame.columns))


SQL = """
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), pos AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w
), win AS (
  SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c
  FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), marked AS (
  SELECT doc_id, i, CASE WHEN c IS NULL THEN 0 WHEN count(*) OVER (PARTITION BY doc_id, word, b, c) > 1 THEN 1 ELSE 0 END AS r FROM win
), reps AS (
  SELECT doc_id, sum(hit) AS n FROM (
    SELECT doc_id, greatest(r, lag(r, 1, 0) OVER o, lag(r, 2, 0) OVER o) AS hit FROM marked
    WINDOW o AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM w
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g') <> '' GROUP BY doc_id
), base AS (
  SELECT w.doc_id, host, t, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dups ON dups.doc_id = w.doc_id LEFT JOIN reps ON reps.doc_id = w.doc_id
), normal AS (
  SELECT doc_id, host, t, trim(regexp_replace(lower(line), '[\\x00-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') AS line,
         len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n
  FROM lines
), frequent AS (
  SELECT n.host, n.line FROM normal n
  JOIN (SELECT host, count(DISTINCT t) AS d FROM w GROUP BY host) h ON h.host = n.host
  WHERE n.line <> '' GROUP BY n.host, n.line, h.d
  HAVING count(DISTINCT n.t) > {min_docs} AND count(DISTINCT n.t) > least({max_share} * h.d, {max_docs})
), poor AS (
  SELECT n.doc_id FROM normal n LEFT JOIN frequent f ON f.host = n.host AND f.line = n.line
  WHERE n.line <> '' GROUP BY n.doc_id
  HAVING sum(CASE WHEN f.line IS NULL THEN n.n ELSE 0 END) < {min_left} * sum(n.n)
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND p.doc_id IS NULL AS kept
FROM base b LEFT JOIN poor p ON p.doc_id = b.doc_id
""".format(min_docs=MIN_DOCS, max_share=MAX_SHARE, max_docs=MAX_DOCS, min_left=MIN_LEFT)
