"""Host-level quality rules.

Every document is held against ``RULES``, plain expressions over its whole
text. Documents that fail any rule are counted for each host (``source``). A host's
rate of failures is shrunk towards the rates of all hosts by a beta prior that is
fitted to them by moments, so a host of few documents is judged mostly by
what is usual, one of many by its own. Host verdicts are joined back: in a host
whose shrunken rate is over ``POOR`` one failed rule rejects a document, in another
``FAILED`` rules do. A document that fails no rule is always kept.

The prior: with n documents and f failures of each of k hosts, m is the sum of f
over the sum of n, v the variance of f/n weighted by n less what chance alone
gives, and a + b = m(1-m)/v - 1, within [1, 1e6]; with one host, or no variance,
it is 1e6, and every host gets m.

Defined cases: a null or empty text fails the rule ``empty`` and no other;
documents with a null source are a host of their own (null); repeated rows
count each; an empty table gives no rows; texts are taken whole; ties don't
arise, as nothing is ranked; further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, pick, table

POOR, FAILED = 0.5, 3
#: Name, and when a document fails, in SQL that Spark and others read alike. Inputs: n characters, words, letters
#: (a to z in any case and all beyond ASCII), capitals and small letters (ASCII), marks (ASCII other than letters, digits, blanks),
#: bars, distinct words, lines, distinct lines.
RULES = {
    "empty": "n = 0",
    "few_letters": "n > 0 AND letters < 0.6 * n",
    "many_marks": "n > 0 AND marks > 0.1 * n",
    "shouting": "n > 0 AND capitals > 20 AND capitals > 0.5 * (capitals + smalls)",
    "one_word": "words >= 20 AND distinct_words < 0.1 * words AND distinct_words < 20",
    "long_words": "words > 0 AND letters > 20 * words",
    "short_words": "words >= 5 AND letters < 2 * words",
    "repeated_lines": "lines >= 4 AND distinct_lines < 0.5 * lines",
    "bars": "words >= 5 AND bars > 0.3 * words",
}


def _measured(text: Column) -> dict[str, Column]:
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    tokens = F.filter(F.split(text, "[ \\t\\r\\n]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")
    return {
        "n": F.length(text),
        "letters": without(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+"),
        "capitals": without(r"[^A-Z]+"),
        "smalls": without(r"[^a-z]+"),
        "marks": without(r"[^\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+"),
        "bars": without(r"[^|]+"),
        "words": F.size(tokens),
        "distinct_words": F.size(F.array_distinct(tokens)),
        "lines": F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)),
    }


def failures(text: Column) -> tuple[dict[str, Column], Column]:
    """Columns to measure, and the names of the rules that these fail."""
    measured = _measured(F.coalesce(text, F.lit("")))
    failed = F.filter(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items()]), lambda x: x.isNotNull())
    return measured, failed


def judge_hosts(checked: DataFrame) -> DataFrame:
    """One row for each host of ``checked`` (host, failed): documents, failures, shrunken rate, whether it is poor."""
    hosts = checked.groupBy("host").agg(F.count("*").alias("documents"), F.count(F.when(F.size("failed") > 0, 1)).alias("failing"))
    total = hosts.agg(F.sum("documents").alias("all_n"), F.sum("failing").alias("all_f"), F.count("*").alias("k"))
    spread = hosts.crossJoin(F.broadcast(total)).withColumn("m", F.col("all_f") / F.col("all_n"))
    spread = spread.groupBy("all_n", "k", "m").agg(F.round(F.sum(F.col("documents") * F.pow(F.col("failing") / F.col("documents") - F.col("m"), F.lit(2.0))) / F.first("all_n"), 12).alias("seen"))
    chance = F.col("k") * F.col("m") * (1 - F.col("m")) / F.col("all_n")
    v = F.col("seen") - chance
    size = F.when((F.col("k") < 2) | (v <= 1e-9), F.lit(1e6)).otherwise(F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / v - 1)))
    prior = spread.select("m", size.alias("size"))
    rate = (F.col("failing") + F.col("m") * F.col("size")) / (F.col("documents") + F.col("size"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "documents", "failing", F.round(rate, 6).alias("host_rate")).withColumn("host_poor", F.col("host_rate") > POOR)


def judge(docs: DataFrame) -> DataFrame:
    """One row for each document: its failed rules, its host's rate and verdict, and whether it stays."""
    docs = pick(docs, doc_id="long", source="string", text="string").withColumnRenamed("source", "host")
    measured, failed = failures(F.col("text"))
    checked = docs.select("doc_id", "host", *[c.alias(n) for n, c in measured.items()]).select("doc_id", "host", failed.alias("failed"))
    checked = checkpoint(checked)  # used twice, and the texts are read once
    hosts = judge_hosts(checked)
    # AQE broadcasts the hosts if they are few; else the documents (ids, hosts and failed rules, no texts) shuffle
    joined = checked.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "inner")
    n = F.size("failed")
    return joined.select("doc_id", F.col("host").alias("source"), F.concat_ws(",", "failed").alias("failed_rules"), "host_rate", "host_poor", (~((n >= FAILED) | (F.col("host_poor") & (n > 0)))).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_LENGTH = "length(regexp_replace(t, '{}', '', 'g'))"
_PARTS = {
    "letters": r"[\x00-\x40\x5b-\x60\x7b-\x7f]+",
    "capitals": "[^A-Z]+",
    "smalls": "[^a-z]+",
    "marks": r"[^\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+",
    "bars": "[^|]+",
}
SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, [x for x in string_split_regex(t, '[ \\t\\r\\n]+') if x <> ''] AS ws, [x for x in string_split(t, chr(10)) if x <> ''] AS ls FROM d),
m AS (SELECT doc_id, source, length(t) AS n, {', '.join(f"{_LENGTH.format(p)} AS {k}" for k, p in _PARTS.items())},
      len(ws) AS words, len(list_distinct(ws)) AS distinct_words, len(ls) AS lines, len(list_distinct(ls)) AS distinct_lines FROM s),
c AS (SELECT doc_id, source, [x for x in [{', '.join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in RULES.items())}] if x IS NOT NULL] AS failed FROM m),
h AS (SELECT source, count(*) AS n, count(CASE WHEN len(failed) > 0 THEN 1 END) AS f FROM c GROUP BY source),
a AS (SELECT sum(n)::DOUBLE AS n, sum(f)::DOUBLE / sum(n) AS m, count(*) AS k FROM h),
v AS (SELECT a.m, a.k, round(sum(h.n * pow(h.f::DOUBLE / h.n - a.m, 2)) / a.n, 12) - a.k * a.m * (1 - a.m) / a.n AS v FROM h, a GROUP BY a.m, a.k, a.n),
p AS (SELECT m, CASE WHEN k < 2 OR v <= 1e-9 THEN 1e6 ELSE least(1e6, greatest(1.0, m * (1 - m) / v - 1)) END AS size FROM v),
r AS (SELECT source, round((f + m * size) / (n + size), 6) AS host_rate FROM h, p)
SELECT doc_id, c.source, array_to_string(failed, ',') AS failed_rules, host_rate, host_rate > {POOR} AS host_poor,
       NOT (len(failed) >= {FAILED} OR (host_rate > {POOR} AND len(failed) > 0)) AS keep
FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
"""
