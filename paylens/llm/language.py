"""Language by Bayesian fusion of evidence.

Each language's log posterior is the sum of the text's log likelihood, the log likelihoods of the declared
language and of the address hint, and the log prior of the host. How far declarations and addresses can be
trusted, and the priors, come from grouped counts of what the texts alone say: a host's counts are smoothed
towards its domain's, a domain's towards all. A row's own text is taken out of its host's counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from paylens.llm.hashing import blocks
from paylens.llm.tables import col
from paylens.session import stored

SAMPLE = 4000
# languages of the model, at most
LANGUAGES = 200
SLOTS = 1 << 16
# a text counts for at most so many letter triples, however long it is: they are far from independent
WEIGHT = 60.0
PRIOR = 5.0
CONFIDENT = 0.65

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[0x41:0x5B] += 32
_LOWER[[c for c in range(128) if not chr(c).isalpha()]] = 0x20


def triples(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed slot of the three bytes from each position, letters lowered; SLOTS where a row ends before."""
    x = _LOWER[data]
    slot = np.full(len(x), SLOTS, dtype=np.int64)
    if len(x) > 2:
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        slot[:-2] = (code * np.uint32(2654435761)) >> np.uint32(16)
    for back in (1, 2):
        ends = offsets[1:] - back
        slot[ends[ends >= offsets[:-1]]] = SLOTS
    return slot


def _count(languages: Sequence[str]):
    """Rows (lang, text) to one row of counts per language and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), SLOTS + 1), dtype=np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, data, offsets in blocks(batch.column("text")):
                slot = triples(data, offsets)
                for i in range(len(offsets) - 1):
                    total[place[langs[first + i]]] += np.bincount(slot[offsets[i] : offsets[i + 1]], minlength=SLOTS + 1)
        for i, x in enumerate(languages):
            used = np.flatnonzero(total[i, :SLOTS])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(used), type=pa.string()), pa.array(used), pa.array(total[i, used])], names=["lang", "slot", "n"]
            )

    return run


def fit_text(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of every slot, from at most `sample` labelled texts.

    The languages are the LANGUAGES most frequent labels at most; any other label counts as no language of the model. Each has
    the same share of the sample, the texts with the least hash, so that a rare one is not left without; less where most of its texts are
    copies. Rows without text or label are left out.
    """
    rows = docs.select(col(lang).alias("lang"), col(text).cast("binary").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    frequent = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    sizes = {r["lang"]: r["count"] for r in frequent.collect()}
    languages = sorted(sizes)
    each = max(1, sample // max(1, len(languages)))
    # hashes are even, so few of a large language need to be ordered: those below this are some four times as many as are drawn
    below = {x: min((1 << 63) - 1, -(1 << 63) + (4 * each << 64) // n) for x, n in sizes.items()}
    limits = F.create_map(*[F.lit(v) for pair in below.items() for v in pair]) if below else F.lit(None).cast("map<string,bigint>")
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    hashed = rows.select("lang", F.xxhash64("text").alias("h"))
    drawn = hashed.where(F.col("h") <= F.try_element_at(limits, F.col("lang"))).distinct()
    # `sample` rows at most
    drawn = drawn.withColumn("place", place).where(f"place <= {each}").select("lang", "h")
    part = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(drawn.toDF("l2", "h2")), F.expr("h = h2 AND lang = l2"))
    counted = part.select("lang", "text").mapInArrow(_count(languages), "lang string, slot long, n long")
    table = np.full((len(languages), SLOTS), 0.5)
    for r in counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toLocalIterator():  # SLOTS rows a language at most
        table[languages.index(r["lang"]), r["slot"]] += r["n"]
    logs = np.log(table / table.sum(axis=1, keepdims=True)) if languages else table
    return languages, np.concatenate([logs - logs.mean(axis=0, keepdims=True), np.zeros((len(languages), 1))], axis=1) if languages else table


def _score(logs: np.ndarray, weight: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, data, offsets in blocks(batch.column("_text")):
                slot = triples(data, offsets)
                sums = np.empty((len(logs), len(offsets) - 1))
                for i, one in enumerate(logs):
                    run_ = np.concatenate([[0.0], np.cumsum(one[slot])])
                    sums[i] = run_[offsets[1:]] - run_[offsets[:-1]]
                n = np.maximum(np.diff(offsets) - 2, 1)
                parts.append((sums * np.minimum(1.0, weight / n)).T)
            like = np.concatenate(parts) if parts else np.zeros((0, len(logs)))
            lists = pa.array(list(like), type=pa.list_(pa.float64()))
            kept = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists], names=[*kept, "_like"])

    return run


def declared_language(html: Column) -> Column:
    """The two-letter language of the html element, null if it has none."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2})(?![a-z])", 1))
    return F.when(found != "", found)


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, its domain (last two labels), and the language hint: a two-letter path start, else a two-letter suffix."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    hint = F.when(path != "", path).when(suffix != "", suffix)
    return F.when(host != "", host), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), hint


def visible_text(html: Column) -> Column:
    """Markup, scripts and styles taken out."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#a-zA-Z0-9]+;", " ")


def identify(
    rows: DataFrame, languages: Sequence[str], logs: np.ndarray, weight: float = WEIGHT, prior: float = PRIOR
) -> DataFrame:
    """Rows with columns host, domain, declared, hint and body to their language and its posterior.

    body is dropped; `text_lang`, `lang`, `confidence` are added and all other columns are kept. Every evidence
    may be null: a null or empty text says nothing, a null declaration or hint is a value of its own, as is a code that is
    none of the languages; rows without host share one. Extra columns may have any name. Without languages the result is null.
    """
    kept = [c for c in rows.columns if c not in ("body", "text_lang", "lang", "confidence")]
    if not languages:
        return rows.select(*[col(c) for c in kept], *[F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")], F.lit(None).cast("double").alias("confidence"))
    n = len(languages)
    known = F.array(*[F.lit(x) for x in languages])
    value = lambda c: F.when(col(c).isNull(), "none").when(F.array_contains(known, col(c)), col(c)).otherwise("other")
    # helper names for all columns, as any name may be taken
    inner = [f"c{i}" for i in range(len(kept))]
    told = rows.select(
        *[col(c).alias(k) for c, k in zip(kept, inner)], col("host").alias("_host"), col("domain").alias("_domain"),
        value("declared").alias("_decl"), value("hint").alias("_hint"), col("body").cast("binary").alias("_text"),
    )
    slim = T.StructType([*told.drop("_text").schema.fields, T.StructField("_like", T.ArrayType(T.DoubleType()))])
    scored = told.mapInArrow(_score(logs, weight), slim)
    top = F.array_position(F.col("_like"), F.array_max("_like")) - 1
    says = F.when(F.array_max("_like") > F.array_min("_like"), top.cast("int"))
    scored = stored(scored.withColumn("_says", says))

    # what the texts say, counted by each kind of evidence in one pass
    counts = [F.count(F.when(F.col("_says") == i, 1)).cast("double").alias(f"n{i}") for i in range(n)]
    every = scored.groupBy().agg(*counts)
    share = lambda own, up, strength: [(F.col(f"{own}{i}") + strength * F.col(f"{up}{i}")) for i in range(n)]
    total = lambda p: sum((F.col(f"{p}{i}") for i in range(1, n)), F.col(f"{p}0"))
    every = every.select(*[((F.col(f"n{i}") + 1) / (total("n") + n)).alias(f"g{i}") for i in range(n)], *[F.col(f"n{i}").alias(f"a{i}") for i in range(n)])

    def likelihood(column: str, out: str) -> DataFrame:
        """(column, log likelihood of this value under each language); at most languages + 2 rows."""
        table = scored.groupBy(F.col(column).alias(out + "v")).agg(*counts)
        return table.select(
            out + "v",
            F.array(*[F.log((F.col(f"n{i}") + 0.5) / (F.lit(0) + every.select(f"a{i}").scalar() + 0.5 * (n + 2))) for i in range(n)]).alias(out),
        )

    hosts = scored.groupBy(F.col("_host").alias("_h"), F.col("_domain").alias("_d")).agg(*counts)
    domains = hosts.groupBy("_d").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(n)])
    up = [(F.col(f"d{i}") + prior * every.select(f"g{i}").scalar()) / (total("d") + prior) for i in range(n)]
    domains = domains.select(F.col("_d").alias("_d2"), *[u.alias(f"d{i}") for i, u in enumerate(up)])
    # stored, so that the join stands on plain shuffles and a large host can be split
    priors = hosts.join(domains, F.col("_d").eqNullSafe(F.col("_d2"))).select(
        F.col("_h"), F.col("_d"), F.array(*[F.col(f"n{i}") for i in range(n)]).alias("_n"), F.array(*[F.col(f"d{i}") for i in range(n)]).alias("_p")
    )
    joined = (
        scored.join(stored(priors), F.col("_host").eqNullSafe(F.col("_h")) & F.col("_domain").eqNullSafe(F.col("_d")), "left")
        .join(F.broadcast(likelihood("_decl", "_ld")), F.col("_decl") == F.col("_ldv"), "left")
        .join(F.broadcast(likelihood("_hint", "_lh")), F.col("_hint") == F.col("_lhv"), "left")
    )
    own = lambda i: F.when(F.col("_says") == i, 1.0).otherwise(0.0)
    logs_of = [
        F.col("_like")[i] + F.col("_ld")[i] + F.col("_lh")[i] + F.log(F.col("_n")[i] - own(i) + prior * F.col("_p")[i])
        for i in range(n)
    ]
    post = joined.withColumn("_post", F.array(*logs_of)).withColumn("_max", F.array_max("_post"))
    best = F.array_position(F.col("_post"), F.col("_max")).cast("int")
    mass = sum((F.exp(F.col("_post")[i] - F.col("_max")) for i in range(1, n)), F.exp(F.col("_post")[0] - F.col("_max")))
    return post.select(
        *[F.col(k).alias(c) for c, k in zip(kept, inner)],
        F.when(F.col("_says").isNotNull(), F.element_at(known, F.col("_says") + 1)).alias("text_lang"),
        F.element_at(known, best).alias("lang"),
        (1 / mass).alias("confidence"),
    )
