"""Language ID: Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, own_columns, unpacked, with_columns

#: Buckets of byte triples, and bytes that the text models of all languages may take in each process.
TRIPLES, TABLE_BYTES = 4096, 64 << 20
#: A text counts as at most so many independent triples, as its overlapping ones are not.
EFFECTIVE = 150.0
#: Chance that a declared language, and that an address suffix, is the text's.
DECLARED, SUFFIX = 0.9, 0.8
#: Pseudo-counts of a domain's prior in its hosts', and of the corpus' in a domain's.
HOST_SMOOTHING, DOMAIN_SMOOTHING = 20.0, 50.0


def triples(text: str | None) -> np.ndarray:
    b = np.frombuffer(f" {text or ''} ".lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    # Runs of digits and ASCII marks say nothing of a language: they count as one space.
    b = np.where((b < 97) | ((b > 122) & (b < 128)), np.uint32(32), b)
    b = b[(b != 32) | (np.append(np.uint32(0), b[:-1]) != 32)]
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    return ((((b[:-2] * np.uint32(31) + b[1:-1]) * np.uint32(131) + b[2:]) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``text, declared, host, suffix`` of raw web pages, appended: the inputs of ``identify``.

    The declared language is the ``lang`` of the markup; the suffix is a two-letter first
    path segment, else a two-letter end of the host name.
    """
    markup, address = F.coalesce(F.col(f"`{html}`"), F.lit("")), F.coalesce(F.col(f"`{url}`"), F.lit(""))
    bare = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract(address, r"^[^:/?#]*://([^/?#]*)", 1))
    segment = F.regexp_extract(address, r"^[^:/?#]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)
    ending = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return with_columns(pages, {
        "text": F.regexp_replace(bare, r"&[a-zA-Z#0-9]+;", " "), "declared": F.nullif(F.lower(F.regexp_extract(markup, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]{2,3})", 1)), F.lit("")),
        "host": host, "suffix": F.nullif(F.lower(F.coalesce(F.nullif(segment, F.lit("")), ending)), F.lit("")),
    })


def identify(docs: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source", suffix: str | None = None, languages: list[str] | None = None, keep_above: float = 0.5, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Names the language of every row from four kinds of evidence, fused by Bayes' rule.

    The languages are ``languages``, or all that any row declares, however few do; the text
    model of a rare one is smoothed towards equal chances.  Their models go to every process;
    where they would take more than ``table_bytes`` (2,048 languages; the world has 7,000, tables
    of web pages declare some hundred), an error says so before any is built, and the caller
    names the languages or grants more: none is dropped in silence.  The model counts byte triples by
    declared language over all rows: tasks
    sum their own, and one sum a language and bucket follows.  With it each row's text has a
    likelihood of every language, tempered as triples overlap.  Grouped aggregation of the
    likeliest languages gives a prior for each host, smoothed by its domain's, which is
    smoothed by the corpus' (a row's own count is taken out again, so that it does not confirm
    itself).  The posterior is likelihood x declared x suffix x host prior; evidence that is
    null, blank or names no known language is neutral.

    Host priors are joined by host: Catalyst broadcasts them if small, AQE splits hot hosts
    otherwise.  Returns the columns of ``docs``, then ``language, language_probability,
    text_language, keep``; columns of these names in ``docs`` give way, all others stay,
    whatever their names.  Every row is judged, on its whole text, repeated rows and null ids
    too; of equally likely languages the first by name is taken.  ``keep`` is false
    where the text has no letters at all, or the probability is under ``keep_above``.  Null
    and empty texts have only their other evidence, and are not kept.  If no language is
    known, ``language`` is null and nothing is kept.  An empty table gives an empty table.
    """
    null = F.lit(None).cast("string")
    of = lambda c: F.col(f"`{c}`").cast("string") if c else null
    taken = ("language", "language_probability", "text_language", "keep")
    base = docs.select(own_columns(docs, *taken).alias("own"), of(text).alias("text"), F.nullif(F.trim(F.lower(of(declared))), F.lit("")).alias("declared"), F.lower(of(host)).alias("host"), F.lower(of(suffix)).alias("suffix"))
    most = max(1, table_bytes // (8 * TRIPLES))
    if languages is None:
        languages = sorted(r[0] for r in base.where("declared IS NOT NULL").select("declared").distinct().limit(most + 1).collect())  # a language a row
    if len(languages) > most:
        raise ValueError(f"more than {most} languages, whose models exceed {table_bytes} bytes: name the languages, or grant more table_bytes")
    size = len(languages)
    names = F.array(*map(F.lit, languages)).cast("array<string>")
    sums = base.where(F.col("declared").isin(languages)).select("text", "declared").mapInArrow(_counted, "lang string, bucket int, n long")
    table, at = np.full((max(1, size), TRIPLES), 0.0), {lang: i for i, lang in enumerate(languages)}
    for r in sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas().itertuples():  # languages x buckets at most
        table[at[r.lang], r.bucket] = r.n
    smooth = table + 0.5
    logs = docs.sparkSession.sparkContext.broadcast(np.log(smooth / smooth.sum(axis=1, keepdims=True)))

    carried = ["own", "declared", "host", "suffix"]
    schema = base.select(*carried).schema.add("loglik", T.ArrayType(T.DoubleType())).add("letters", "boolean")
    seen = base.select(*carried, "text").mapInArrow(lambda it: _likelihoods(it, logs, carried, size), schema)

    best = F.array_position("loglik", F.array_max("loglik")) - 1
    votes = base.select("host", "text").mapInArrow(lambda it: _votes(it, logs, size), "host string, best int, n long").groupBy("host", "best").agg(F.sum("n").alias("n"))
    votes = materialize(votes, "language-votes")
    priors = _priors(votes, size)
    joined = seen.join(priors, F.col("host").eqNullSafe(F.col("prior_host")), "left").withColumn("best", F.when(F.col("letters"), best))

    def named(column: str, chance: float) -> Column:
        """Log chance of the evidence under each language."""
        other = float(np.log((1 - chance) / max(1, size - 1)))
        known = F.coalesce(F.array_contains(names, F.col(column)), F.lit(False))
        return F.transform(names, lambda x: F.when(~known, 0.0).when(x == F.col(column), float(np.log(chance))).otherwise(other))

    # A row's vote is one of its host's: out of the counts, with the smoothing kept.
    flat = F.array_repeat(F.lit(1.0 / max(1, size)), size)
    smoothed = F.coalesce("prior", flat)
    mine = F.transform(smoothed, lambda p, i: F.log(F.greatest(F.lit(1e-6), (p * F.coalesce("weight", F.lit(1.0)) - F.when(i == F.col("best"), 1.0).otherwise(0.0)))))
    fused = joined.withColumn("score", F.zip_with(F.zip_with("loglik", named("declared", DECLARED), lambda a, b: a + b), F.zip_with(named("suffix", SUFFIX), mine, lambda a, b: a + b), lambda a, b: a + b))
    top = F.array_max("score")
    fused = fused.withColumns({"top": top, "sum": F.aggregate(F.transform("score", lambda s: F.exp(s - top)), F.lit(0.0), lambda a, b: a + b)})
    language = F.try_element_at(names, F.array_position("score", F.col("top")).cast("int")) if size else null
    chance = (1 / F.col("sum")) if size else F.lit(0.0)
    out = fused.select(
        "own", language.alias("language"), chance.alias("language_probability"),
        (F.when(F.col("letters"), F.get(names, F.col("best").cast("int"))) if size else null).alias("text_language"), "letters",
    )
    keep = F.col("letters") & (F.col("language_probability") >= keep_above) & F.col("language").isNotNull()
    return unpacked(out.withColumn("keep", keep), "own", *taken)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch["text"].to_pylist(), batch["declared"].to_pylist(), strict=True):
            counts.setdefault(lang, np.zeros(TRIPLES, dtype=np.int64))
            counts[lang] += np.bincount(triples(text), minlength=TRIPLES)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at])})


def _loglik(text: str | None, logs: np.ndarray, size: int) -> tuple[np.ndarray, bool]:
    """Log chances of the text under each language, and whether it has letters at all."""
    t = triples(text)
    if not len(t) or not size:
        return np.zeros(size), len(t) > 0
    return logs @ (np.bincount(t, minlength=TRIPLES) * (min(len(t), EFFECTIVE) / len(t))), True


def _likelihoods(batches: Iterator[pa.RecordBatch], shared, carried: list[str], size: int) -> Iterator[pa.RecordBatch]:
    logs = shared.value
    for batch in batches:
        read = [_loglik(t, logs, size) for t in batch["text"].to_pylist()]
        flat = np.concatenate([row for row, _ in read]) if read else np.zeros(0)
        lists = pa.ListArray.from_arrays(np.arange(0, len(read) * size + 1, max(1, size), dtype=np.int32) if size else np.zeros(len(read) + 1, dtype=np.int32), flat)
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in carried], lists, pa.array([letters for _, letters in read], pa.bool_())], [*carried, "loglik", "letters"])


def _votes(batches: Iterator[pa.RecordBatch], shared, size: int) -> Iterator[pa.RecordBatch]:
    logs, counts = shared.value, {}
    for batch in batches:
        for text, host in zip(batch["text"].to_pylist(), batch["host"].to_pylist(), strict=True):
            row, letters = _loglik(text, logs, size)
            if size and letters:
                key = host, int(np.argmax(row))
                counts[key] = counts.get(key, 0) + 1
        if len(counts) > 50_000:  # the sums of a task stay small, whatever its hosts
            yield _vote_rows(counts)
            counts = {}
    if counts:
        yield _vote_rows(counts)


def _vote_rows(counts: dict) -> pa.RecordBatch:
    return pa.record_batch({"host": pa.array([h for h, _ in counts], pa.string()), "best": pa.array([b for _, b in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})


def _priors(votes: DataFrame, size: int) -> DataFrame:
    """``prior_host, prior, weight``: smoothed shares of the languages, and the count behind them.

    Counts are lists of the languages that occur, so the plan does not grow with ``size``.
    """
    host = F.coalesce("host", F.lit(""))
    domain = F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)
    hosts = votes.groupBy("host", domain.alias("domain")).agg(F.collect_list("best").alias("best"), F.collect_list("n").alias("n"))
    shares = votes.groupBy(domain.alias("of_domain"), "best").agg(F.sum("n").alias("n"))
    domains = shares.groupBy("of_domain").agg(F.collect_list("best").alias("domain_best"), F.collect_list("n").alias("domain_n"))
    corpus = np.zeros(size)
    for r in votes.groupBy("best").agg(F.sum("n").alias("n")).collect():  # a language a row
        corpus[r.best] = r.n
    top = (corpus + 1.0) / (corpus.sum() + size)
    joined = hosts.join(domains, F.col("domain") == F.col("of_domain")).select("host", "best", "n", "domain_best", "domain_n")
    return joined.mapInArrow(lambda it: _smoothed(it, top), "prior_host string, prior array<double>, weight double")


def _smoothed(batches: Iterator[pa.RecordBatch], top: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, weights = [], []
        for best, n, domain_best, domain_n in zip(*(batch[c].to_pylist() for c in ("best", "n", "domain_best", "domain_n")), strict=True):
            prior = DOMAIN_SMOOTHING * top
            prior[domain_best] += domain_n
            prior *= HOST_SMOOTHING / (sum(domain_n) + DOMAIN_SMOOTHING)
            prior[best] += n
            weights.append(sum(n) + HOST_SMOOTHING)
            rows.append(prior / weights[-1])
        yield pa.record_batch({"prior_host": batch["host"], "prior": pa.array(rows, pa.list_(pa.float64())), "weight": pa.array(weights, pa.float64())})
