"""Quality rules: per-document counts and cross-document line frequency, in Spark expressions only.

A line is its lower-cased text with runs of space and digits folded, and is known by its hash. A line
that stands in many distinct documents of a host is boilerplate there: it is removed, and a
document that loses most of its words this way is rejected. Exact copies of a text count as one document, so
a text is not boilerplate because it was copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.tables import SPACE, col, fresh
from paylens.session import stored

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
# a line is above the limits if it is in more than so many documents of its host, and in more than this share of them
# or in so many that the share of a large host does not matter
LINE_DOCUMENTS = 20
LINE_PERCENT = 1
LINE_MANY = 1000
# a document is depleted if it keeps less than this share of its words
KEEP_PERCENT = 25


def _words(text: str) -> str:
    return f"filter(split({text}, r'{SPACE}+'), w -> w <> '')"


def _repeats(words: str, window: int) -> list[dict[str, str]]:
    """Stages that count the words in windows found twice or more.

    Window hashes are built by doubling; equal ones meet after sorting (hash, position), and the
    repeated positions in order cover min(window, distance to the next) words each.
    """
    hashes = {"_h1": f"transform({words}, w -> xxhash64(w))"}
    stages, width = [hashes], 1
    while width < window:
        last = f"greatest(size(_h{width}) - {width}, 0)"
        stages.append(
            {f"_h{2 * width}": f"transform(slice(_h{width}, 1, {last}), (h, i) -> xxhash64(h, _h{width}[i + {width}]))"}
        )
        width *= 2
    h = f"_h{width}"
    stages.append(
        {
            "_sorted": f"CASE WHEN size(array_distinct({h})) < size({h})"
            f" THEN array_sort(transform({h}, (h, i) -> struct(h AS h, i AS i))) END"
        }
    )
    stages.append(
        {
            "_starts": "array_sort(transform(filter(_sorted, (x, k) -> (k > 0 AND _sorted[k - 1].h = x.h)"
            " OR (k + 1 < size(_sorted) AND _sorted[k + 1].h = x.h)), x -> x.i))"
        }
    )
    stages.append(
        {
            "n_repeat_words": "coalesce(aggregate(transform(_starts, (s, k) -> "
            f"if(k + 1 < size(_starts), least({window}, _starts[k + 1] - s), {window})), 0L, (a, x) -> a + x), 0L)"
        }
    )
    return stages


def base_counts(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Counts of words, symbols, repeated lines and repeated windows of every document.

    `window` is a power of two. A null text counts as empty: all counts are 0. Columns of the same
    names are replaced. Long texts are taken whole.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if c.lower() not in names]
    df = docs.select(F.struct(*[col(c) for c in kept]).alias("_row"), F.coalesce(col(text), F.lit("")).alias("_text"))
    stages = [
        {"_words": _words("_text"), "_lines": r"filter(split(_text, '\n'), x -> x RLIKE r'[^\x20\x09-\x0D]')"},
        {
            "n_words": "CAST(size(_words) AS BIGINT)",
            "word_chars": "CAST(char_length(array_join(_words, '')) AS BIGINT)",
            "n_symbols": "CAST(regexp_count(_text, '[#*$%&|<>]') AS BIGINT)",
            "n_dup_lines": "CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)",
        },
        *_repeats("_words", window),
    ]
    drop: dict[str, list[str]] = {"_h1": ["_words", "_lines", "_text"]}
    for stage in stages:
        df = df.selectExpr("*", *[f"{e} AS {c}" for c, e in stage.items()])
        df = df.drop(*[x for c in stage for x in drop.get(c, [])])
    return df.select("_row.*", *names)


def line_hashes(text: Column) -> Column:
    """(position, hash, words) of every line with a word; positions count all lines from 0."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x, i: F.struct(i.alias("pos"), F.trim(F.regexp_replace(F.lower(x), SPACE + "+", " ")).alias("t")),
    )
    return F.transform(
        F.filter(lines, lambda x: x["t"] != ""),
        lambda x: F.struct(
            x["pos"].alias("pos"),
            F.xxhash64(F.regexp_replace(x["t"], "[0-9]+", "0")).alias("h"),
            (F.length(x["t"]) - F.length(F.replace(x["t"], F.lit(" "), F.lit(""))) + 1).cast("long").alias("w"),
        ),
    )


def boilerplate_lines(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    key: str = "doc_id",
    line_documents: int = LINE_DOCUMENTS,
    line_percent: float = LINE_PERCENT,
    line_many: int = LINE_MANY,
) -> DataFrame:
    """(key, host, txt) of documents with lines above the limits, those lines' positions and their words."""
    base = docs.select(
        col(key).alias("key"), col(host).cast("string").alias("host"), F.xxhash64(col(text)).alias("txt"), line_hashes(col(text)).alias("lines")
    )
    lines = base.select("key", "host", "txt", F.explode("lines").alias("line")).select("key", "host", "txt", "line.*")
    # both counts take a text once per host, however many copies it has there
    seen = lines.groupBy("host", "h", "txt").agg(F.lit(1).alias("one"))
    counted = seen.groupBy("host", "h").agg(F.count("one").alias("n")).where(f"n > {line_documents}")
    copies = base.groupBy("host", "txt").agg(F.lit(1).alias("one"))
    texts = copies.groupBy(F.col("host").alias("host2")).agg(F.count("one").alias("texts"))
    above = counted.join(texts, F.col("host").eqNullSafe(F.col("host2"))).where(f"n * 100 > texts * {line_percent} OR n > {line_many}")
    # stored, so that the join stands on plain shuffles and a line of very many documents can be split
    above = stored(above.select(F.col("host").alias("host3"), F.col("h").alias("h3")))
    cut = lines.join(above, F.col("host").eqNullSafe(F.col("host3")) & (F.col("h") == F.col("h3")), "left_semi")
    # repeated rows share a key and a text; each line counts once
    once = cut.groupBy("key", "host", "txt", "pos").agg(F.max("w").alias("w"))
    return once.groupBy("key", "host", "txt").agg(F.sum("w").alias("w"), F.collect_set("pos").alias("cut"))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    key: str = "doc_id",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    keep_percent: int = KEEP_PERCENT,
    **limits,
) -> DataFrame:
    """Base counts, `n_removed_words`, `clean_text`, `base_failed` and `kept` of every document.

    `clean_text` has the lines above the limits removed and the others in order. A null text has no words, fails the
    base and stays null; a null host is a host of its own; repeated rows get the same result each. Columns of
    the result's names are replaced, all others are kept.
    """
    names = ["n_removed_words", "clean_text", "base_failed", "kept"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    txt, k2, h2, t2, w, cut = fresh(docs, "_txt", "_key2", "_host2", "_txt2", "_removed", "_cut")
    removed = boilerplate_lines(docs, text, host, key, **limits).toDF(k2, h2, t2, w, cut)
    counts = base_counts(docs.withColumn(txt, F.xxhash64(col(text))), text)
    same = col(key).eqNullSafe(F.col(k2)) & col(host).cast("string").eqNullSafe(F.col(h2)) & (F.col(txt) == F.col(t2))
    rest = F.filter(F.split(col(text), "\n"), lambda x, i: ~F.array_contains(F.col(cut), i))
    failed = f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words"
    return (
        counts.join(removed, same, "left")
        .withColumn("n_removed_words", F.coalesce(F.col(w), F.lit(0).cast("long")))
        .withColumn("clean_text", F.when(F.col(cut).isNull(), col(text)).otherwise(F.array_join(rest, "\n")))
        .withColumn("base_failed", F.expr(failed))
        .withColumn("kept", F.expr(f"NOT base_failed AND 100 * (n_words - n_removed_words) >= {keep_percent} * n_words"))
        .drop(txt, k2, h2, t2, w, cut)
    )
