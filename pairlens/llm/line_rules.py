"""Cross-document line frequency: find lines that many documents of a host share, and reject
documents of which too little is left without them. DataFrame functions only.

Lines are normalised (lower case, single blanks, trimmed) and hashed with their host. A line's
frequency is the number of distinct documents of the host that hold it. Copies and near copies are
not distinct documents: the text of a much-copied page is not mistaken for boilerplate. Frequencies
count near-copy classes of a host. A document's sketch is the ``SKETCH_SIZE`` smallest hashes of its
five-word windows; equal sketches are one node. Nodes whose sketches agree in one of ``BANDS`` parts
meet in a bucket, each bucket has one of its nodes as representative, and a node is linked with the
representative if the Jaccard similarity of their window sets, as the sketches tell it, is at least
``NEAR``. Components of these links are candidates: they hold variants of one text, and just as well
documents that are nearly all boilerplate. What tells them apart is the rest of each document. A
line is marked by the smallest hashes of its word pairs; a line that shares less than half of its
marks with the component's first member is a line of the document's own, while an edited line keeps
most of them. Documents whose own lines have ``OWN_WORDS`` words or more together are distinct if their
own lines differ; all others of a component are variants and count as one. Sketches of up to
``SKETCH_SIZE`` windows are whole sets; of longer texts the similarity is an estimate with a standard
error of 0.04. So a page in hundreds of variants is kept, and documents of a host with a notice around
a line of their own count one by one, however large the notice is.

A line is common if its frequency exceeds ``min_documents`` and either ``share`` of the distinct
documents of its host or ``enough`` documents, so no host is too large for its boilerplate. A document is depleted if, without its common lines, fewer than
``min_words`` words or less than ``min_left`` of its words remain.

Defined results: a null text has no words and fails the base rules; a null host is a host of its
own; repeated rows get the same verdict each; a null id is kept as null. Tables without rows give
no rows. Texts of any length are measured whole; every step is linear in the text but for sorting
its windows, and only if some window repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage
from pairlens.llm.common import BLANK_RUN, BLANKS, KEY, OWN, let, whole, with_key, words
from pairlens.operators.split import component_of_edges

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

LINE_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
HOST, NODE, SKETCH, LINES = OWN + "host", OWN + "node", OWN + "sketch", OWN + "lines"
SKETCH_SIZE = 128
BANDS, BAND_ROWS = 6, 4
NEAR = 0.75
ENOUGH = 1000
MARKS, OWN_WORDS = 4, 4


def window_hashes(w: Column, size: int = WINDOW) -> Column:
    """Hashes of all windows of ``size`` consecutive words; empty if there are fewer words."""
    starts = F.sequence(F.lit(0), F.size(w) - size)
    at = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(F.size(w) >= size, at).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column, size: int) -> Column:
    """Number of words inside windows whose hash occurs at least twice."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(r: Column) -> Column:
        def equal(x: Column, other: Column) -> Column:
            return F.coalesce(x["h"] == other["h"], F.lit(False))

        hits = F.filter(r, lambda x, k: equal(x, F.get(r, k - 1)) | equal(x, F.get(r, k + 1)))
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeated, let(let(pairs, twice), total)).otherwise(F.lit(0).cast("long"))


def _sketch(hashes: Column) -> Column:
    """The upper halves of the smallest distinct hashes, in ascending order."""
    least = F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH_SIZE)
    return F.transform(least, lambda h: F.shiftright(h, 32).cast("int"))


def _bands(sketch: Column) -> Column:
    """A hash of the smallest members of each part of a sketch; parts without members have none."""

    def band(j: Column) -> Column:
        part = F.slice(F.filter(sketch, lambda x: F.pmod(x, F.lit(BANDS)) == j), 1, BAND_ROWS)
        return let(part, lambda p: F.when(F.size(p) > 0, F.xxhash64(HOST, j, p)))

    return F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band))


def _similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two window sets by the smallest members of their union."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH_SIZE)
    return let(union, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))


def normalised_line(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(line, F.lit(BLANKS))), BLANK_RUN, " ")


def _marked_line(line: Column) -> Column:
    """Hash, number of words and marks of a line: the smallest hashes of its word pairs (and last word)."""

    def of_words(w: Column) -> Column:
        pairs = F.transform(w, lambda x, i: F.shiftright(F.xxhash64(x, F.get(w, i + 1)), 32).cast("int"))
        return F.struct(F.size(w).alias("words"), F.slice(F.sort_array(F.array_distinct(pairs)), 1, MARKS).alias("marks"))

    def of_line(x: Column) -> Column:
        return let(
            let(F.split(x, " "), of_words),
            lambda m: F.struct(F.xxhash64(x).alias("line"), m["words"].alias("words"), m["marks"].alias("marks")),
        )

    return let(normalised_line(line), of_line)


def measure(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One narrow row per document: key, id, hashed host, base measures, sketch, node and lines."""
    w, h, spoken = OWN + "words", OWN + "windows", OWN + "spoken"
    t = whole(F.col(text))
    narrow = with_key(docs.select(id, text, host), id, text)
    split = narrow.select(
        *KEY,
        id,
        F.xxhash64(F.col(host), F.col(host).isNull()).alias(HOST),
        words(F.col(text)).alias(w),
        F.length(F.regexp_replace(t, BLANK_RUN, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias(spoken),
    )
    windows = split.withColumn(h, window_hashes(F.col(w))).withColumn(SKETCH, _sketch(F.col(h)))
    return windows.select(
        *KEY,
        id,
        HOST,
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size(spoken) - F.size(F.array_distinct(spoken))).cast("long").alias("n_dup_lines"),
        _covered(F.col(h), WINDOW).alias("n_repeat_words"),
        F.when(F.size(SKETCH) > 0, F.xxhash64(HOST, SKETCH)).otherwise(F.xxhash64(HOST, w)).alias(NODE),
        SKETCH,
        F.transform(spoken, _marked_line).alias(LINES),
    )


def near_copies(measured: DataFrame) -> DataFrame:
    """(node, component) of the nodes that are near copies of another node of their host.

    No pairs of a bucket are listed: each node meets the representative only, and sketches move
    only for nodes that share a bucket.
    """
    held = cut_lineage(measured.select(NODE, F.explode(_bands(F.col(SKETCH))).alias("_bucket")).distinct())
    # Crossed with the bucket, nodes come in another order in each, so buckets differ in whom they take.
    crossed = F.min(F.col(NODE).bitwiseXOR(F.col("_bucket")))
    buckets = held.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_m"), crossed.alias("_least")).filter("_m > 1")
    met = held.join(buckets, "_bucket").select(NODE, F.col("_least").bitwiseXOR(F.col("_bucket")).alias("_rep"))
    pairs = cut_lineage(met.filter(F.col(NODE) != F.col("_rep")).distinct())
    some = pairs.select(F.explode(F.array(NODE, "_rep")).alias(NODE)).distinct()
    one = measured.select(NODE, SKETCH).groupBy(NODE).agg(F.first(SKETCH).alias(SKETCH))
    sketches = cut_lineage(one.join(some, NODE, "left_semi"))
    other = sketches.select(F.col(NODE).alias("_rep"), F.col(SKETCH).alias("_other"))
    alike = pairs.join(sketches, NODE).join(other, "_rep").filter(_similarity(F.col(SKETCH), F.col("_other")) >= NEAR)
    return component_of_edges(alike.select(F.col(NODE).alias("u"), F.col("_rep").alias("v")))


def document_classes(measured: DataFrame) -> DataFrame:
    """(node, class) of the nodes that are near copies of another node: variants of a text share a class,
    and so do documents whose own lines agree, see the module's description.

    Lines are compared with the first member once per component and line, so the lines that a large
    group of copies shares are few.
    """
    classes = cut_lineage(near_copies(measured).select(F.col("node").alias(NODE), F.col("component").alias("_c")))
    one = measured.select(NODE, LINES).join(classes, NODE).groupBy(NODE, "_c").agg(F.first(LINES).alias(LINES))
    lines = cut_lineage(one.select(NODE, "_c", F.explode(LINES).alias("l")).select(NODE, "_c", "l.*").distinct())
    first = lines.filter(F.col(NODE) == F.col("_c")).select("_c", F.explode("marks").alias("_mark")).distinct()
    marked = lines.groupBy("_c", "line").agg(F.first("marks").alias("marks")).select("_c", "line", F.explode("marks").alias("_mark"))
    known = marked.join(first.withColumn("_known", F.lit(1)), ["_c", "_mark"], "left")
    own = (
        known.groupBy("_c", "line")
        .agg(F.count(F.lit(1)).alias("_n"), F.count("_known").alias("_k"), F.min("_mark").alias("_least"))
        .filter(2 * F.col("_k") < F.col("_n"))
        .select("_c", "line", "_least")
    )
    rest = (
        lines.join(own, ["_c", "line"])
        .groupBy(NODE, "_c")
        .agg(F.sum("words").alias("_words"), F.sort_array(F.collect_set("_least")).alias("_rest"))  # a document's lines
        .filter(F.col("_words") >= OWN_WORDS)
        .select(NODE, F.xxhash64("_c", "_rest").alias("_own"))
    )
    return classes.join(rest, NODE, "left").select(NODE, F.coalesce("_own", "_c").alias("_class"))


def common_lines(measured: DataFrame, min_documents: int, share: float, enough: int = ENOUGH) -> DataFrame:
    """(host, line, n_documents) of the lines above the limits.

    Counted in steps, by (host, line, node), (host, line, class) and (host, line), all combined on
    the map side, so a line that a third of all documents hold is spread over all tasks.
    """
    classes = cut_lineage(document_classes(measured))
    lines = measured.select(HOST, NODE, F.explode(LINES).alias("l")).select(HOST, NODE, "l.line")

    def distinct_documents(rows: DataFrame, by: list[str], out: str) -> DataFrame:
        named = rows.select(*by, NODE).distinct().join(classes, NODE, "left")
        each = named.select(*by, F.coalesce("_class", NODE).alias("_class")).distinct()
        return each.groupBy(*by).agg(F.count(F.lit(1)).alias(out))

    frequency = distinct_documents(lines, [HOST, "line"], "n_documents").filter(F.col("n_documents") > min_documents)
    hosts = distinct_documents(measured, [HOST], "_host_documents")
    return (
        frequency.join(hosts, HOST)
        .filter(F.col("n_documents") > F.least(F.col("_host_documents") * share, F.lit(float(enough))))
        .select(HOST, "line", "n_documents")
    )


def judge_documents(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_documents: int = 20,
    share: float = 0.005,
    enough: int = ENOUGH,
    min_words: int = MIN_WORDS,
    min_left: float = 1 / 3,
) -> DataFrame:
    """One row per row of ``docs``: key, id, measures, base_failed, n_common_lines,
    n_common_words and kept.

    The measured table and the table of common lines are written once to the shared folder; the
    second is small, and Spark broadcasts it only if its file size is below its threshold.
    """
    measured = cut_lineage(measure(docs, id, text, host))
    common = cut_lineage(common_lines(measured, min_documents, share, enough))
    hits = (
        measured.select(*KEY, HOST, F.posexplode(LINES).alias("_at", "l"))
        .select(*KEY, HOST, "_at", "l.line", "l.words")
        .join(common.select(HOST, "line"), [HOST, "line"])
        .groupBy(*KEY, "_at")
        .agg(F.max("words").alias("words"))  # repeated rows count once
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("n_common_lines"), F.sum("words").alias("n_common_words"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    left = F.col("n_words") - F.col("n_common_words")
    most = 2 * left < F.col("n_words")
    depleted = (left < min_left * F.col("n_words")) | (most & (left < min_words))
    return (
        measured.drop(HOST, NODE, SKETCH, LINES)
        .join(hits, KEY, "left")
        .fillna(0, ["n_common_lines", "n_common_words"])
        .withColumn("base_failed", failed)
        .withColumn("kept", ~(F.col("base_failed") | ((F.col("n_common_words") > 0) & depleted)))
    )


def without_common_lines(
    docs: DataFrame, common: DataFrame, text: str = "text", host: str = "source"
) -> DataFrame:
    """``docs`` with the lines of ``common`` (as of ``common_lines``) removed from the texts.

    The other lines keep their order and their own blanks. Common lines of a host are gathered
    into one array per host; each stands in more than ``share`` of its documents or in more than
    ``enough``, so there are at most 1/share of them per average line of a document, or one for
    each ``enough`` lines of the host if that is more.
    """
    lists = common.groupBy(HOST).agg(F.collect_set("line").alias(OWN + "common"))
    known = F.coalesce(F.col(OWN + "common"), F.array().cast("array<bigint>"))
    left = F.filter(
        F.split(F.col(text), "\n"), lambda x: ~F.array_contains(known, F.xxhash64(normalised_line(x)))
    )
    return (
        docs.withColumn(HOST, F.xxhash64(F.col(host), F.col(host).isNull()))
        .join(lists, HOST, "left")
        .withColumn(text, F.array_join(left, "\n"))
        .drop(HOST, OWN + "common")
    )


def drop_rejected(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged and with all their columns.

    The keys of rejected rows grow with the table, so they are joined by a shuffle at every size
    and never broadcast.
    """
    id, text = options.get("id", "doc_id"), options.get("text", "text")
    rejected = cut_lineage(judge_documents(docs, **options).filter("not kept").select(*KEY).distinct())
    return with_key(docs, id, text).join(rejected.hint("merge"), KEY, "left_anti").drop(*KEY)
