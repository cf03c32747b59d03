"""Evaluation: retrieval metrics, exact paired statistics, summaries, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import fixed as X
from talus.operators.ranks import first_rows, quantiles


def recall_at_k(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of a query's relevant chunks among its first ``k``; queries without any are an error of the caller."""
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    total = relevant.groupBy("query_id").agg(F.count("*").alias("total"))
    return total.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("recall"), "total")


def recall_of_hits(found: DataFrame, total: DataFrame, k: int) -> DataFrame:
    """As ``recall_at_k``, from the best rows with a flag ``hit`` and each query's number of relevant chunks."""
    hits = found.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum("hit").alias("hits"))
    return total.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("recall"), "total")


def missing_runs(ledger: DataFrame, most: int = 1000) -> DataFrame:
    """(model, id) that ``ledger(model, id)`` lacks, of all its models (``most`` at most) and ids."""
    models = sorted(r[0] for r in ledger.select("model").distinct().limit(most + 1).collect())
    if len(models) > most:
        raise ValueError(f"more than {most} models")
    have = ledger.groupBy("id").agg(F.collect_set("model").alias("have"))
    return have.select("id", F.explode(F.array_except(F.array(*map(F.lit, models)) if models else F.array().cast("array<string>"), "have")).alias("model"))


def unit_recall_at_k(ranked: DataFrame, relevant: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """As ``recall_at_k`` over units: the first ``k`` distinct units by their best rank."""
    best = ranked.join(units, "vec_id").groupBy("query_id", "unit").agg(F.min("rank").alias("rank"))
    place = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k)
    wanted = relevant.join(units, "vec_id").select("query_id", "unit").distinct()
    hits = place.join(wanted, ["query_id", "unit"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return wanted.groupBy("query_id").agg(F.count("*").alias("total")).join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("recall"))


def reciprocal_rank(ranked: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    first = ranked.join(relevant, ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    return queries.select("query_id").join(first, "query_id", "left").select("query_id", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def recall_ceiling(total: DataFrame, k: int) -> DataFrame:
    """The best mean recall there is, from each query's number of relevant chunks."""
    return total.agg(F.round(F.avg(F.least("total", F.lit(k)) / F.col("total")), 6).alias("ceiling"))


def wilson(successes: Column, n: Column, z: float = X.Z95) -> Column:
    """struct(low, high) of the Wilson interval; (0, 1) without observations."""
    p, z2 = successes / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return F.struct(low.alias("low"), high.alias("high"))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of the discordant counts: binomial terms one from another, from 0.5**n on (logarithms beyond 1000)."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    # terms are kept as logarithms: 0.5**n is no double any more for thousands of pairs
    start = F.struct((n * F.log(F.lit(0.5))).alias("log"), F.exp(n * F.log(F.lit(0.5))).alias("sum"))
    step = lambda s, i: F.struct((s["log"] + F.log((n - i + 1) / i)).alias("log"), (s["sum"] + F.exp(s["log"] + F.log((n - i + 1) / i))).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), k), start, step)["sum"]
    none = F.exp(n * F.log(F.lit(0.5)))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.when(k == 0, none).otherwise(total)))


def summary(df: DataFrame, *keys: str) -> DataFrame:
    """Runs by ``keys``: how many, mean precision and coverage, median, p90 by nearest rank and longest of the seconds; groups of any size."""
    means = [F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "coverage")], F.round(F.max("seconds"), 6).alias("longest")]
    ranks = quantiles(df, list(keys), "seconds", {"median": 0.5}, {"p90": 0.9})
    rounded = ranks.select(*[F.col(k).alias(f"_{k}") for k in keys], F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))
    base = df.groupBy(*keys).agg(*means)
    return base.join(rounded, reduce(lambda a, b: a & b, [base[k].eqNullSafe(rounded[f"_{k}"]) for k in keys])).drop(*[f"_{k}" for k in keys])


def latencies(df: DataFrame, key: str, order: str, value: str, warm: int = 5) -> DataFrame:
    """(key, median, p90) of the values, each key's first ``warm`` ones left out; p90 between ranks."""
    first = first_rows(df.select(key, order), [key], [order], warm)
    kept = df.select(key, order, value).join(first, [key, order], "left_anti")
    out = quantiles(kept, [key], value, {"median": 0.5, "p90": 0.9})
    return out.select(key, F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


def store_verdicts(measures: DataFrame, filters: DataFrame) -> DataFrame:
    """(store, threshold, verdict) of what was measured, a row for each threshold that can be judged.

    ``measures(store, fidelity, median_ms, memory_mb, returned, asked, all_fit)``, the last three null where no filtered search was made;
    ``filters(store, got, expected, false_positives)``, a row a case. Fidelity must be exactly 1, each filter must return exactly what it should,
    the median is held against a limit, memory falls into one of three bands, and a filtered search must return as many as were asked for, all of them fitting.
    """
    said = lambda ok, yes="met", no="not met": F.when(ok, yes).otherwise(no)
    exact = filters.groupBy("store").agg(F.bool_and((F.col("false_positives") == 0) & (F.col("got") == F.col("expected"))).alias("exact"))
    m = measures.join(exact, "store", "left")
    memory = F.when(F.col("memory_mb") <= X.MEMORY_MB[0], "met").when(F.col("memory_mb") <= X.MEMORY_MB[1], "between").otherwise("ruled out")
    verdicts = {
        "fidelity": said(F.col("fidelity") == 1), "filters": F.when(F.col("exact").isNotNull(), said(F.col("exact"))), "latency": said(F.col("median_ms") <= X.LATENCY_MS), "memory": memory,
        "prefilter": F.when(F.col("asked").isNotNull(), said((F.col("returned") == F.col("asked")) & F.col("all_fit"), "before", "after, or loses rows")),
    }
    listed = F.array(*[F.struct(F.lit(k).alias("threshold"), v.alias("verdict")) for k, v in verdicts.items()])
    return m.select("store", F.inline(listed)).where("verdict is not null")


def stratified(rows: DataFrame, family: str, key: str, per_family: int, total: int, seed: int) -> DataFrame:
    """An equal quota from each family in seeded hash order, filled up from the rest; ``position`` keeps the original order."""
    hashed = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))))
    quota = first_rows(hashed, [family], ["_h", key], per_family)
    # as many rows in hash order as the quota may take away still hold what fills up
    rest = hashed.orderBy("_h", key).limit(total + quota.count()).join(quota.select(key), key, "left_anti")
    both = quota.withColumn("_q", F.lit(0)).unionByName(rest.withColumn("_q", F.lit(1)))
    return both.orderBy("_q", "_h", key).limit(total).drop("_h", "_q")


def paired(ledger: DataFrame, a: str, b: str) -> DataFrame:
    """Two graders on the items both judged: wins, losses and the exact p."""
    both = ledger.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = both.agg(F.count("*").alias("n"), F.count_if((F.col(a) >= 1) & (F.col(b) < 1)).alias("only_a"), F.count_if((F.col(a) < 1) & (F.col(b) >= 1)).alias("only_b"))
    return s.withColumn("p", F.round(mcnemar(F.col("only_a"), F.col("only_b")), 9))


def run_models(pairs: DataFrame, answer) -> DataFrame:
    """(model, id, answer, seconds) for ``pairs(model, id, question)``: an injected model in batches; a failure is a null answer."""
    import time

    import pandas as pd

    def run(batches):
        for rows in batches:
            out = []
            for model, key, question in zip(rows["model"], rows["id"], rows["question"], strict=True):
                start = time.perf_counter()
                try:
                    said = answer(model, question)
                except Exception:  # noqa: BLE001 - the run goes on, the ledger shows what is missing
                    said = None
                out.append((model, key, said, time.perf_counter() - start))
            yield pd.DataFrame(out, columns=["model", "id", "answer", "seconds"])

    return pairs.select("model", "id", "question").mapInPandas(run, "model string, id bigint, answer string, seconds double")


def follow_up(turns: DataFrame, prepared: DataFrame) -> DataFrame:
    """(conv_id, turn, strategy, text): a question alone, after the one before it, and with the state of its conversation."""
    before = F.lag("question").over(Window.partitionBy("conv_id").orderBy("turn"))
    plain = turns.withColumn("_b", before).where("_b is not null")
    alone = plain.select("conv_id", "turn", F.lit("alone").alias("strategy"), F.col("question").alias("text"))
    after = plain.select("conv_id", "turn", F.lit("concatenated").alias("strategy"), F.concat_ws(" ", "_b", "question").alias("text"))
    stateful = plain.select("conv_id", "turn").join(prepared, ["conv_id", "turn"]).select("conv_id", "turn", F.lit("stateful").alias("strategy"), F.concat_ws(" ", "text", F.array_join("scope", " ")).alias("text"))
    return alone.union(after).union(stateful)


def plain_number(number: Column) -> Column:
    """With a point, and without zeros after it."""
    pointed = F.replace(number, F.lit(","), F.lit("."))
    return F.regexp_replace(F.regexp_replace(pointed, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")


def scalar_right(answer: Column, family: Column, expected: Column) -> Column:
    """Whether an answer says what is expected: the number of credits, or, in any other family, a year that the label admits."""
    from talus.functions import text as T

    said = F.transform(F.regexp_extract_all(answer, F.lit("(?i)([0-9]+(?:[.,][0-9]+)?)[ \\t]*(?:ECTS|cr[ée]ditos?)"), 1), plain_number)
    normal = T.normalize(answer)
    year = F.exists(T.admissible_years(expected), lambda y: F.contains(normal, y))
    return F.coalesce(F.when(family == "creditos", F.array_contains(said, plain_number(expected))).otherwise(year), F.lit(False))


def rescore(ledger: DataFrame, bank: DataFrame, known: DataFrame) -> DataFrame:
    """(run, right, precision, coverage, invented, omitted) of stored answers, anew, without a model.

    ``ledger(run, id, answer)``; ``bank(id, kind, family, expected)`` with an array of what is expected; ``known(name)``. Scalars
    (kind ``escalar``) are right or not, the other answers are compared as lists. Null answers are empty.
    """
    from talus.operators import verify as V

    rows = ledger.join(bank, "id").withColumn("answer", F.coalesce("answer", F.lit("")))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("precision", "double"), ("coverage", "double"), ("invented", "bigint"), ("omitted", "bigint"))]
    scalar = rows.where("kind = 'escalar'").select("run", scalar_right(F.col("answer"), F.col("family"), F.get("expected", F.lit(0))).alias("right"), *none)
    lists = rows.where("kind <> 'escalar'")
    scored = V.score_lists(V.listed_names(lists, "run", "answer").distinct(), lists.select("run", F.explode("expected").alias("name")), known, "run")
    both = lists.select("run").join(scored, "run", "left").select("run", F.lit(None).cast("boolean").alias("right"), "precision", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("invented", F.lit(0)).alias("invented"), F.coalesce("omitted", F.lit(0)).alias("omitted"))
    return scalar.unionByName(both)


def grade(answers: DataFrame, bank: DataFrame, known: DataFrame, catalogue: DataFrame, refusals: list[str] = (), withdrawn: str = "") -> DataFrame:
    """(run, criterion, passed) of ``answers(run, id, answer)`` by what the bank asks of each item.

    ``bank(id, criterion, family, expected, forbidden)``. ``conjunto``: a list without anything false (one that lists nothing has nothing false) that holds
    all expected; ``escalar``: the value; ``fija``: exactly the expected reply; ``sin_invencion``: degrees are named, and only real ones, and the answer was not
    withdrawn; ``rechazo``: a fixed refusal, or no invented degree and a denial in the first two sentences; ``ambito``: all expected degrees are named by
    themselves and no forbidden one. Null answers are empty.
    """
    from talus.functions import text as T
    from talus.operators import verify as V
    from talus.operators.contain import named_by_itself, unknown_names

    scored = bank.where("criterion in ('conjunto', 'escalar')").select("id", F.col("criterion").alias("kind"), "family", "expected")
    lists = rescore(answers, scored, known).select("run", F.coalesce("right", (F.coalesce("precision", F.lit(1.0)) == 1) & (F.col("coverage") == 1)).alias("passed"))
    rows = answers.join(bank.where("criterion not in ('conjunto', 'escalar')"), "id").withColumn("answer", F.coalesce("answer", F.lit("")))
    named = rows.select("run", F.explode(V.named_degrees(F.col("answer"))).alias("name"))
    some = named.groupBy("run").agg(F.count("*").alias("_named"))
    bad = unknown_names(named, catalogue, "run").groupBy("run").agg(F.count("*").alias("_invented"))
    said = named_by_itself(rows.where("criterion = 'ambito'"), "run", "answer", catalogue).where("by_itself").groupBy("run").agg(F.collect_set("name").alias("_said"))  # names of the catalogue
    both = rows.join(some, "run", "left").join(bad, "run", "left").join(said, "run", "left")
    none = F.array().cast("array<string>")
    real, told = F.col("_invented").isNull(), F.coalesce("_said", none)
    opening = F.array_join(F.slice(F.split("answer", "[.!?\n]"), 1, 2), " ")
    ways = {
        "fija": F.col("answer") == F.get("expected", 0),
        "sin_invencion": real & (F.col("answer") != withdrawn) & F.col("_named").isNotNull(),
        "rechazo": F.col("answer").isin(list(refusals)) | (real & F.arrays_overlap(T.tokens(opening), T.strings(X.NEGATIONS))),
        "ambito": (F.size(F.array_except("expected", told)) == 0) & ~F.arrays_overlap(F.coalesce("forbidden", none), told),
    }
    passed = F.raise_error(F.concat(F.lit("unknown criterion: "), "criterion")).cast("boolean")
    for way, ok in ways.items():
        passed = F.when(F.col("criterion") == way, F.coalesce(ok, F.lit(False))).otherwise(passed)
    named_ones = answers.select("run", "id").join(bank.select("id", "criterion"), "id").select("run", "criterion")
    return lists.join(named_ones, "run").select("run", "criterion", "passed").union(both.select("run", "criterion", passed))
