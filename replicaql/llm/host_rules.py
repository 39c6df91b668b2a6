"""Quality rules (8): document rules, aggregated by host with an empirical beta prior, joined back.

Each document gets word, symbol, duplicate-line and repetition counts. Failing a hard rule (too few words, mostly
repeated three-word windows) rejects the document itself. Soft rules (symbols, duplicate lines, odd word lengths) count
for its host: the host's failure rate is shrunk towards the corpus by a beta prior fitted by moments, and a host whose
rate lies so far below the corpus's that doubts standard deviations of its posterior fit in between is trusted, one that lies as far
above it is distrusted. The soft rules are waived on trusted hosts and held at two thirds of their limits on distrusted ones, where
borderline documents go too; a host of few documents earns neither. Clean documents of any host stay.

Defined results: a null text has no words and fails; a null host is a host of its own; repeated rows are separate
rows; an empty table gives an empty result. Extra columns are passed through by filter_documents().
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"

def measure(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode()
    words = raw.split()
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        seen, last = Counter(windows), 0  # last: the first word not yet counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, last)
                last = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(x) for x in b.column(b.schema.get_field_index("text")).to_pylist()]
        keep = [i for i, n in enumerate(b.schema.names) if n != "text"]
        cols = [b.column(i) for i in keep] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays(cols, names=[b.schema.names[i] for i in keep] + list(COUNTS))


def counts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source") -> DataFrame:
    """One row of rule counts for each document: id, host, text_key and COUNTS."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.xxhash64("text").alias("text_key"), F.col("text"))
    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, host string, text_key long, " + ", ".join(f"{c} long" for c in COUNTS)
    return slim.mapInArrow(_measured, kinds)


def verdicts(measured: DataFrame, min_words: int = 50, max_repeat: int = 50, doubts: float = 1.0) -> DataFrame:
    """Adds base_failed, soft_failed, borderline, host_rate (shrunk), trusted, distrusted and kept."""
    n = F.col("n_words")
    many = lambda k: (F.col("n_symbols") * k > n) | (F.col("n_dup_lines") * k > F.col("n_lines"))
    odd = (F.col("word_chars") > 20 * n) | (F.col("word_chars") < 2 * n)
    rules = measured.withColumn("base_failed", (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat * n)).withColumns({"soft_failed": many(2) | odd, "borderline": many(3) | odd})
    hosts = rules.groupBy("host").agg(F.count("*").alias("docs"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failed"))
    hosts = written(hosts, "hosts")
    m, v = hosts.agg(F.sum("failed") / F.sum("docs"), F.var_pop(F.col("failed") / F.col("docs"))).first()
    m = min(max(m or 0.0, 1e-6), 1 - 1e-6)
    strength = min(max(m * (1 - m) / max(v or 0.0, 1e-9) - 1, 2.0), 1e4)  # pseudo-documents of the prior
    rate = F.col("host_rate")
    hosts = hosts.withColumn("host_rate", (F.col("failed") + strength * m) / (F.col("docs") + strength))
    doubt = doubts * F.sqrt(rate * (1 - rate) / (F.col("docs") + strength + 1))
    hosts = hosts.select(F.col("host").alias("host_"), "host_rate", (rate + doubt < m).alias("trusted"), (rate - doubt > m).alias("distrusted"))
    # beyond the size of a broadcast a hot host is split by the engine: only the left side is large
    joined = rules.join(small(hosts, F.lit(48) + F.coalesce(F.octet_length("host_"), F.lit(0))), rules["host"].eqNullSafe(F.col("host_")), "left").drop("host_")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("soft_failed") & ~F.col("trusted")) & ~(F.col("borderline") & F.col("distrusted")))


def filter_documents(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source") -> DataFrame:
    """The documents that pass, all columns kept. Rows with the same id and text share one verdict."""
    judged = verdicts(written(counts(docs, id_col, host_col), "rules"))
    bad = judged.where(~F.col("kept")).select(F.col("id").alias("bad_id"), F.col("text_key").alias("bad_key"), F.col("host").alias("bad_host")).distinct()
    same = docs[id_col].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_key"]) & docs[host_col].cast("string").eqNullSafe(bad["bad_host"])
    return docs.join(bad, same, "left_anti")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = verdicts(written(counts(table(spark, sf_dir, "documents")), "rules"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op8_host_rules": op8_host_rules}
_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1) GROUP BY r),
c AS (SELECT w.r, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.r = rep.r),
rules AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_symbols * 2 > n_words OR n_dup_lines * 2 > n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words AS soft_failed,
  n_symbols * 3 > n_words OR n_dup_lines * 3 > n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words AS borderline FROM c),
hosts AS (SELECT source, count(*)::DOUBLE AS docs, (count(*) FILTER (base_failed OR soft_failed))::DOUBLE AS failed FROM rules GROUP BY source),
mean AS (SELECT least(greatest(sum(failed) / sum(docs), 1e-6), 1 - 1e-6) AS m, var_pop(failed / docs) AS v FROM hosts),
prior AS (SELECT m, least(greatest(m * (1 - m) / greatest(v, 1e-9) - 1, 2.0), 1e4) AS s FROM mean),
rates AS (SELECT source, docs, m, s, (failed + s * m) / (docs + s) AS rate FROM hosts, prior),
trust AS (SELECT source, rate + sqrt(rate * (1 - rate) / (docs + s + 1)) < m AS trusted, rate - sqrt(rate * (1 - rate) / (docs + s + 1)) > m AS distrusted FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (soft_failed AND NOT trusted) AND NOT (borderline AND distrusted) AS kept
FROM rules JOIN trust ON rules.source IS NOT DISTINCT FROM trust.source"""
ORACLE_SQL = {"op8_host_rules": _SQL}
