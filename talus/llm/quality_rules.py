"""Quality rules with host verdicts, in DataFrame functions only.

Each document's rule measures come from array functions over its words. Of two hard rules (``short``, ``repeated``: together
``base_failed``) each rejects a document by itself; two soft ones (``symbols``, ``dup_lines``) only raise a doubt. Failures of
each rule are summed by host (``source`` here), and the host's rate is shrunk with an empirical beta prior of that rule. The verdicts:

* a host whose shrunk rate of a hard rule is over ``host_max_rate`` rejects all its documents;
* a document that fails a soft rule is rejected where its host's shrunk rate of that rule is over ``soft_factor`` times the
  mean of the hosts; on better hosts it stays. Documents that fail no rule stay on every host of the first kind's good side.

Null texts have no words; a null or empty host has no verdict; repeated rows count as rows each; nothing is ranked, and a rate
equal to its bound does not reject; very long texts take memory in proportion to their words; an empty table gives an empty
result; extra columns are ignored by name, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.common import WS, fresh, materialize, small

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
#: Soft rules: signs in a hundred characters of words, repeated lines in a hundred lines.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 5, 30
HARD, SOFT = ("short", "repeated"), ("symbols", "dup_lines")
HOST_MAX_RATE, SOFT_FACTOR = 0.8, 1.0
#: Hosts with at most this many verdict rows are sent to all executors; beyond it the join is a shuffle.
BROADCAST_HOSTS = 10_000


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def _covered(places: Column) -> Column:
    """Words in the union of the windows that start at the sorted ``places``."""
    gaps = F.aggregate(
        F.sequence(F.lit(0), F.size(places) - 2),
        F.lit(WINDOW).cast("long"),
        lambda n, k: n + F.least(F.lit(WINDOW), F.get(places, k + 1) - F.get(places, k)).cast("long"),
    )
    return F.when(F.size(places) == 0, F.lit(0).cast("long")).when(F.size(places) == 1, F.lit(WINDOW).cast("long")).otherwise(gaps)


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed and a flag for each rule.

    Windows of three words are compared by 64-bit hash within one document.
    """
    p = prefix
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(
        *kept,
        _words(t).alias(f"{p}_w"),
        F.char_length(F.translate(t, WS, "")).cast("long").alias(f"{p}word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias(f"{p}n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "").alias(f"{p}_l"),
    )
    w, lines = F.col(f"{p}_w"), F.col(f"{p}_l")
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    out = out.select(
        *kept,
        F.size(w).cast("long").alias(f"{p}n_words"),
        f"{p}word_chars",
        f"{p}n_symbols",
        F.size(lines).cast("long").alias(f"{p}n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(f"{p}n_dup_lines"),
        F.when(F.size(w) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")).alias(f"{p}_h"),
    )
    h = F.col(f"{p}_h")
    order = F.when(
        F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    measures = [f"{p}{c}" for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")]
    out = out.select(*kept, *measures, order.alias(f"{p}_o"))
    o = F.col(f"{p}_o")
    same = F.filter(o, lambda x, k: (x["h"] == F.get(o, k - 1)["h"]) | (x["h"] == F.get(o, k + 1)["h"]))
    out = out.select(*kept, *measures, F.sort_array(F.transform(same, lambda x: x["i"])).alias(f"{p}_r"))
    r = F.col(f"{p}_r")
    out = out.select(*kept, *measures, _covered(r).alias(f"{p}n_repeat_words"))
    value = lambda c: F.col(f"{p}{c}")
    rules = {
        "short": value("n_words") < MIN_WORDS,
        "repeated": 100 * value("n_repeat_words") > MAX_REPEAT_PERCENT * value("n_words"),
        "symbols": 100 * value("n_symbols") > MAX_SYMBOL_PERCENT * value("word_chars"),
        "dup_lines": 100 * value("n_dup_lines") > MAX_DUP_LINE_PERCENT * value("n_lines"),
    }
    out = out.withColumns({f"{p}{rule}": failed for rule, failed in rules.items()})
    return out.withColumn(f"{p}base_failed", value("short") | value("repeated"))


def host_stats(measured: DataFrame, host: str = "source", prefix: str = "") -> DataFrame:
    """host, n_docs and the failures of each rule; a hot host is summed before the shuffle."""
    h = F.col(f"`{host}`")
    failures = [F.sum(F.col(f"{prefix}{r}").cast("long")).alias(r) for r in HARD + SOFT]
    return measured.where(h.isNotNull() & (h != "")).groupBy(h.alias("host")).agg(F.count("*").alias("n_docs"), *failures)


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and strength of each rule's beta prior, by the method of moments over the hosts' rates; one row comes to the driver."""
    rate = {r: F.col(r) / F.col("n_docs") for r in HARD + SOFT}
    row = hosts.agg(*[f(x).alias(f"{k}_{r}") for r, x in rate.items() for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    out = {}
    for r in HARD + SOFT:
        m, v = row[f"m_{r}"], row[f"v_{r}"]
        m = min(max(0.5 if m is None else m, 1e-6), 1 - 1e-6)
        out[r] = m, m * (1 - m) / v - 1 if v and v < m * (1 - m) else 1e6 if not v else 1e-6
    return out


def host_verdicts(hosts: DataFrame, host_max_rate: float = HOST_MAX_RATE, soft_factor: float = SOFT_FACTOR) -> DataFrame:
    """``hosts`` with each rule's shrunk rate, ``rejects_all`` and a flag ``rejects_<rule>`` for each soft rule."""
    priors = beta_priors(hosts)
    shrunk = {r: (F.col(r) + F.lit(m * s)) / (F.col("n_docs") + F.lit(s)) for r, (m, s) in priors.items()}
    out = hosts.withColumns({f"rate_{r}": x for r, x in shrunk.items()})
    out = out.withColumn("rejects_all", F.greatest(*[F.col(f"rate_{r}") for r in HARD]) > F.lit(host_max_rate))
    # the margin keeps rates that equal the mean but for rounding on its good side
    return out.withColumns({f"rejects_{r}": F.col(f"rate_{r}") > F.lit(soft_factor * priors[r][0] * (1 + 1e-9)) for r in SOFT})


def with_verdict(measured: DataFrame, host: str = "source", prefix: str = "", host_max_rate: float = HOST_MAX_RATE, soft_factor: float = SOFT_FACTOR) -> DataFrame:
    """``measured`` (a written table, since it is read twice) with ``<prefix>host_rejected``."""
    verdicts = host_verdicts(host_stats(measured, host, prefix), host_max_rate, soft_factor)
    names, q = ["rejects_all", *[f"rejects_{r}" for r in SOFT]], fresh("_verdict_", measured.columns)
    bad = verdicts.where(" or ".join(names)).select(F.col("host").alias(f"{q}host"), *[F.col(n).alias(f"{q}{n}") for n in names])
    if small(bad, BROADCAST_HOSTS):
        bad = F.broadcast(bad)
    joined = measured.join(bad, F.col(f"`{host}`") == F.col(f"{q}host"), "left")
    doubts = [F.col(f"{prefix}{r}") & F.col(f"{q}rejects_{r}") for r in SOFT]
    verdict = F.coalesce(F.col(f"{q}rejects_all") | doubts[0] | doubts[1], F.lit(False))
    return joined.withColumn(f"{prefix}host_rejected", verdict).drop(f"{q}host", *[f"{q}{n}" for n in names])


def quality_rules(docs: DataFrame, host_max_rate: float = HOST_MAX_RATE, soft_factor: float = SOFT_FACTOR) -> DataFrame:
    """Per row: doc_id, the measures, base_failed, host_rejected and kept."""
    measured = materialize(measure(docs.select("doc_id", "text", "source")).drop("text"), "rules")
    out = with_verdict(measured, host_max_rate=host_max_rate, soft_factor=soft_factor)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def filter_documents(docs: DataFrame, host_max_rate: float = HOST_MAX_RATE, soft_factor: float = SOFT_FACTOR) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    p = fresh("_own_", docs.columns)
    own = [F.col(f"`{c}`") for c in docs.columns]
    flags = [f"{p}{c}" for c in (*HARD, *SOFT, "base_failed")]
    measured = materialize(measure(docs, prefix=p).select(*own, *flags), "ruled")
    out = with_verdict(measured, prefix=p, host_max_rate=host_max_rate, soft_factor=soft_factor)
    return out.where(~F.col(f"{p}base_failed") & ~F.col(f"{p}host_rejected")).select(*own)
