"""Quality rules with host-level verdicts.

Every text is measured whole; its rule failures are added up by host (the column `source`; null counts as the host "").
Hosts' failure rates are shrunk towards each other with a beta prior fitted to all hosts by moments (an empirical Bayes
estimate), so that a host with a handful of documents isn't condemned by one of them.  A host whose shrunken rate is
above HOST_LIMIT loses all its documents; the verdicts are joined back to the documents.  A document that fails the base
rule itself always goes.

Words are runs of characters other than space and \\t \\n \\v \\f \\r; null counts as a text without words.  Rows that
repeat are measured and counted each time; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, checked_join, staged, texts_of, tidy
from .wordhash import SPACE, Batch

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
MOST_SYMBOLS = 10  # symbols for 100 words
MOST_DUPLICATE_LINES = 5
#: Shrunken share of failing documents above which a host goes.
HOST_LIMIT = 0.5
#: Limits for the prior's weight in documents; the upper one also holds where all hosts are alike.
PRIOR_WEIGHT = (1.0, 1000.0)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACES = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    batch = Batch(data)
    b = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[batch.offset])

    h, who, at = batch.ngrams(WINDOW)
    order = np.lexsort((h, who))
    hs, ws = h[order], who[order]
    same = (hs[1:] == hs[:-1]) & (ws[1:] == ws[:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = at[order[twice]]
    steps = np.zeros(len(batch.hash) + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(steps[:-1]) > 0)))
    lines = [[x for x in t.split("\n") if x.strip(_SPACES)] for t in texts]
    return {
        "n_words": batch.counts.astype(np.int64),
        "word_chars": per_text(~SPACE[b] & ((b & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[b]),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": np.diff(covered[batch.bounds]),
    }


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(2)
        for start, stop in byte_chunks(text):
            found = measure(texts_of(text, start, stop))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start), *(pa.array(found[c], pa.int64()) for c in COUNTS)],
                names=["_id", "_host", *COUNTS],
            )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) of the hosts' true failure rates, by the analysis of variance of the beta-binomial model: what the
    observed rates vary by within hosts, from few documents each, is taken out.  One row of sums reaches the driver."""
    n, f = F.col("host_docs"), F.col("host_failed")
    k, docs, squares, failed, within, spread = hosts.agg(F.count(F.lit(1)), F.sum(n), F.sum(n * n), F.sum(f), F.sum(f * (n - f) / n), F.sum(f * f / n)).first()
    if not k:
        return PRIOR_WEIGHT[0] / 2, PRIOR_WEIGHT[0] / 2
    m, weight = failed / docs, PRIOR_WEIGHT[1]
    if k > 1:
        between = (spread - failed * failed / docs) / (k - 1)
        inside = within / (docs - k) if docs > k else 0.0
        alike = between - inside
        if alike > 0:
            weight = (docs - squares / docs) / (k - 1) * inside / alike
    weight = min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    return m * weight, (1 - m) * weight


def judge(df: DataFrame, text: str = "text", id_col: str = "doc_id", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per row of df: the id, the counts, base_failed, failed (any rule), the host's documents and failures,
    its shrunken failure rate and verdict, kept."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.col(text).alias("_text"))
    counted = rows.mapInArrow(tidy(_measure_batches), f"_id {kind}, _host string, " + ", ".join(f"{c} long" for c in COUNTS))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    other = (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words")) | (F.col("n_dup_lines") > MOST_DUPLICATE_LINES)
    counted = staged(counted.withColumns({"base_failed": base, "failed": base | other}), "rules")
    hosts = staged(counted.groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed")), "hosts")
    alpha, beta = beta_prior(hosts)
    rate = (F.col("host_failed") + F.lit(alpha)) / (F.col("host_docs") + F.lit(alpha + beta))
    verdicts = hosts.withColumn("host_rate", rate).withColumn("host_kept", F.col("host_rate") <= limit)
    out = checked_join(counted, verdicts, "_host")
    return out.select(
        F.col("_id").alias(id_col),
        *COUNTS,
        "base_failed",
        "failed",
        F.col("_host").alias("host"),
        "host_docs",
        "host_failed",
        "host_rate",
        "host_kept",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
    )


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
win AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM (
    SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n >= 2),
cov AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
c AS (
  SELECT w.r, doc_id, host, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.r = cov.r),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words OR n_dup_lines > 5 AS failed
  FROM c),
h AS (SELECT host, count(*) AS host_docs, count(*) FILTER (WHERE failed) AS host_failed FROM f GROUP BY host),
p AS (
  SELECT count(*) AS k, sum(host_docs) AS docs, sum(host_docs * host_docs) AS squares, sum(host_failed) AS failed,
    sum(host_failed * (host_docs - host_failed) / host_docs) AS within, sum(host_failed * host_failed / host_docs) AS spread FROM h),
v AS (
  SELECT *, (spread - failed * failed / docs) / nullif(k - 1, 0) AS between_hosts,
    CASE WHEN docs > k THEN within / (docs - k) ELSE 0 END AS inside FROM p),
k AS (
  SELECT failed / docs AS m,
    CASE WHEN between_hosts > inside
      THEN least(greatest((docs - squares / docs) / (k - 1) * inside / (between_hosts - inside), 1.0), 1000.0) ELSE 1000.0 END AS s
  FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (host_failed + m * s) / (host_docs + s) <= 0.5 AS kept, host_docs, host_failed
FROM f JOIN h USING (host), k
"""
