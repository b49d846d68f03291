"""Quality rules judged per document and per host, in DataFrame functions only.

Each document gets counts and rule failures inside its own row: no shuffle of
text or words. Hosts (``source``) collect the failures, their rates are shrunk
towards a beta prior fitted over all hosts, and the verdict of a host goes back
to its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.words import A_WORD, SPACES
from nightframe.session import cut_lineage

SYMBOLS = "[#*$%&|<>]"
WHITE = " \t\n\x0b\f\r"
#: Rule name and its condition over the counts.
RULES = {
    "short": "n_words < 50",
    "repeat": "100 * n_repeat_words > 50 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("short", "repeat")
#: Host verdicts that may be broadcast (about 200 bytes each); more are joined by shuffle.
BROADCAST_HOSTS = 100_000


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; drop the text.

    A null text has no words: all counts are 0. Lines without a word are not
    counted. Repeated rows are counted row by row.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (text, *names)]
    full = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        *keep,
        F.split(F.expr(f"trim(BOTH '{WHITE}' FROM `{text}`)"), SPACES).alias("_w"),
        F.length(F.regexp_replace(full, SPACES, "")).alias("word_chars"),
        (F.length(full) - F.length(F.regexp_replace(full, SYMBOLS, ""))).alias("n_symbols"),
        F.filter(F.split(full, "\n"), lambda x: x.rlike(A_WORD)).alias("_lines"),
    )
    # A window is first known by its hash, with its place in the low bits: one sort of plain numbers.
    places = split.select(
        *keep,
        "_w",
        F.when(F.col("word_chars") > 0, F.size("_w")).otherwise(0).alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.expr("length(bin(coalesce(size(_w), 0)))").alias("_bits"),
    ).withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1"))
    hashed = places.withColumn(
        "_h",
        F.expr(
            "CASE WHEN n_words < 3 THEN array() ELSE sort_array(transform(sequence(0, n_words - 3),"
            " i -> (xxhash64(_w[i], _w[i + 1], _w[i + 2]) & ~_mask) | i)) END"
        ),
    )
    # Windows whose hashes meet are compared as text, so that only equal ones count.
    texts = hashed.withColumn(
        "_s",
        F.expr(
            "sort_array(transform(filter(_h, (x, k) ->"
            " (k > 0 AND shiftright(_h[greatest(k - 1, 0)], _bits) = shiftright(x, _bits)) OR"
            " (k < size(_h) - 1 AND shiftright(_h[least(k + 1, size(_h) - 1)], _bits) = shiftright(x, _bits))),"
            " x -> struct(concat_ws(' ', _w[int(x & _mask)], _w[int(x & _mask) + 1], _w[int(x & _mask) + 2]) AS g,"
            " int(x & _mask) AS i)))"
        ),
    )
    # A flagged window adds the words that the flagged one before it did not cover.
    flagged = texts.withColumn(
        "_p",
        F.expr(
            "sort_array(transform(filter(_s, (x, k) -> (k > 0 AND _s[greatest(k - 1, 0)].g = x.g)"
            " OR (k < size(_s) - 1 AND _s[least(k + 1, size(_s) - 1)].g = x.g)), x -> x.i))"
        ),
    )
    covered = F.expr(
        "aggregate(_p, named_struct('n', 0L, 'last', -3),"
        " (a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x), a -> a.n)"
    )
    counts = [F.col(c).cast("bigint").alias(c) for c in names[:-1]]
    return flagged.select(*keep, *counts, covered.alias("n_repeat_words"))


def host_verdicts(counted: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rates and ``host_rejected``.

    For each rule the hosts' failure rates give a beta prior by their mean and
    variance (strength between 1 and 1,000); the shrunk rate is the posterior
    mean. A host is rejected when a shrunk rate passes ``limit``. Documents
    without a host form one host of their own.
    """
    hosts = counted.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("host_docs"),
        *[F.sum(F.expr(f"CAST({rule} AS BIGINT)")).alias(f"host_{name}") for name, rule in RULES.items()],
    )
    rate = {name: F.col(f"host_{name}") / F.col("host_docs") for name in RULES}
    moments = hosts.agg(
        *[F.avg(r).alias(f"m_{n}") for n, r in rate.items()],
        *[F.coalesce(F.var_samp(r), F.lit(0.0)).alias(f"v_{n}") for n, r in rate.items()],
    ).first()  # one row of eight numbers
    shrunk = {}
    for name in RULES:
        mean, var = moments[f"m_{name}"] or 0.0, moments[f"v_{name}"] or 0.0
        strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1000.0) if var > 0 else 1000.0
        shrunk[name] = (F.col(f"host_{name}") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.select(
        "*",
        *[F.round(r, 6).alias(f"host_rate_{n}") for n, r in shrunk.items()],
        (F.greatest(*shrunk.values()) > limit).alias("host_rejected"),
    )


def judged(counted: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """Add the host's figures, ``base_failed`` and ``kept`` to counted documents."""
    failed = F.expr(" OR ".join(f"({RULES[name]})" for name in BASE))
    hosts = cut_lineage(host_verdicts(counted, host, limit), "host-verdicts")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    return (
        counted.join(hosts, F.col(host).eqNullSafe(F.col("_host")), "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .drop("_host")
    )


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float = 0.5
) -> DataFrame:
    """Counts, base failures, host verdict and ``kept`` for every row of ``docs``.

    ``kept`` is false where the document fails a base rule (fewer than 50
    words, or more than half of its words in repeated three-word windows) or
    its host is rejected. Rows with null ids, hosts or texts stay in the result.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("source"), F.col(text).alias("text"))
    return judged(cut_lineage(document_counts(narrow), "quality-counts"), "source", limit)
