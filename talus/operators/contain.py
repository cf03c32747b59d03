"""Which names stand in which texts, without a condition join.

Few names (``most`` bytes of them at most, which is counted first) go to all tasks as an Aho-Corasick automaton and each text is read once, whatever
the number of names. More names meet the texts by their grams: a name is listed under the one of its trigrams that the fewest texts hold, texts under all of
theirs, and what meets is verified. Equal texts and equal names are compared once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions import text as T

MOST, GRAM = 8 << 20, 3
_HITS = "text string, name string, n int"


def hits(texts: DataFrame, names: DataFrame, most: int = MOST) -> DataFrame:
    """(text, name, n) for ``texts(text)`` and ``names(name)``: how often a name stands in a text, not overlapping itself.

    The empty name stands before every character and at the end. Nulls are in nothing.
    """
    texts = texts.select("text").where("text is not null").distinct()
    names = names.select("name").where("name is not null").distinct()
    size = names.agg(F.sum(F.octet_length("name") + 1)).first()[0] or 0
    return _by_automaton(texts, names) if size <= most else _by_grams(texts, names)


def _by_automaton(texts: DataFrame, names: DataFrame) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast([r.name for r in names.collect()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for name in sent.value:
            if name:
                automaton.add_word(name, name)
        empty = "" in sent.value
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            rows: list[tuple[str, str, int]] = []
            for text in batch.column("text").to_pylist():
                count: dict[str, int] = {}
                free: dict[str, int] = {}
                for end, name in automaton.iter(text) if len(automaton) else ():
                    if end - len(name) >= free.get(name, -1):
                        count[name] = count.get(name, 0) + 1
                        free[name] = end
                rows += [(text, name, n) for name, n in count.items()]
                if empty:
                    rows.append((text, "", len(text) + 1))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32()))], ["text", "name", "n"])

    return texts.mapInArrow(run, _HITS)


def _grams(text: Column, length: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - (length - 1))), lambda i: F.substring(text, i, F.lit(length))))


def occurrences(text: Column, name: Column) -> Column:
    """How often ``name`` stands in ``text``, not overlapping itself."""
    return F.when(name == "", F.char_length(text) + 1).otherwise((F.char_length(text) - F.char_length(F.replace(text, name, F.lit("")))) / F.greatest(F.char_length(name), F.lit(1))).cast("int")


def _by_grams(texts: DataFrame, names: DataFrame) -> DataFrame:
    # names shorter than a trigram are grams themselves
    lengths = [r.k for r in names.select(F.least(F.char_length("name"), F.lit(GRAM)).alias("k")).distinct().collect()]
    grams = F.concat(*[F.when(F.char_length("text") >= k, _grams(F.col("text"), k)).otherwise(F.array().cast("array<string>")) for k in lengths if k], F.array().cast("array<string>"))
    listed = texts.select("text", F.explode(F.when(F.lit(0 in lengths), F.array_append(grams, "")).otherwise(grams)).alias("gram"))
    own = F.when(F.char_length("name") < GRAM, F.array("name")).otherwise(_grams(F.col("name"), GRAM))
    asked = names.select("name", F.explode(own).alias("gram"))
    held = listed.groupBy("gram").agg(F.count("*").alias("texts"))
    # a gram that no text holds leaves the name out
    rare = asked.join(held, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("x")).where("x.texts > 0").select("name", F.col("x.gram").alias("gram"))
    return rare.join(listed, "gram").where(F.contains("text", F.col("name"))).select("text", "name", occurrences(F.col("text"), F.col("name")).alias("n"))


def found_names(texts: DataFrame, key: str, text: str, catalogue: DataFrame, most: int = MOST, n: str = "n") -> DataFrame:
    """(key, name, n): the names of ``catalogue(name)`` that a text holds, both normalised. A key called ``name`` becomes ``_in``."""
    left = texts.select(F.col(key).alias("_in"), T.normalize(F.col(text)).alias("text"))
    right = catalogue.select(F.col("name").alias("_name"), T.normalize(F.col("name")).alias("name")).distinct()
    both = hits(left, right, most).join(right, "name").select("text", F.col("_name").alias("name"), "n")
    return left.join(both, "text").select("_in" if key == "name" else F.col("_in").alias(key), "name", F.col("n").alias(n))


def named_by_itself(texts: DataFrame, key: str, text: str, catalogue: DataFrame, most: int = MOST) -> DataFrame:
    """(key, name, by_itself): whether a name that a text holds stands there oftener than other names that hold it explain."""
    found = found_names(texts, key, text, catalogue, most)
    inside = found_names(catalogue.select("name").distinct(), "name", "name", catalogue, most, "_times").where("_in <> name")
    taken = found.select(key, F.col("name").alias("_in"), "n").join(inside, "_in").groupBy(key, "name").agg(F.sum(F.col("n") * F.col("_times")).alias("_taken"))
    return found.join(taken, [key, "name"], "left").select(key, "name", (F.col("n") > F.coalesce("_taken", F.lit(0))).alias("by_itself"))


def prefixes(name: Column) -> Column:
    """The beginnings of a name, itself included."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(name))), lambda i: F.substring(name, F.lit(1), i))


def unknown_names(named: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Rows of ``named(key, name)`` whose name no name of the catalogue starts with, is started by, or holds all words of; by equi-joins on beginnings and on a name's rarest word."""
    said = named.select("name").distinct().select("name", T.normalize(F.col("name")).alias("n"), T.tokens(F.col("name")).alias("words"))
    real = catalogue.select(T.normalize(F.col("name")).alias("n"), T.tokens(F.col("name")).alias("held")).distinct()
    begun = real.select(F.explode(prefixes(F.col("n"))).alias("n")).distinct()
    known = said.join(begun, "n", "left_semi").select("name")
    begins = said.select("name", F.explode(prefixes(F.col("n"))).alias("n")).join(real.select("n"), "n", "left_semi").select("name")
    posted = real.select("held", F.explode("held").alias("word"))
    held = posted.groupBy("word").agg(F.count("*").alias("names"))
    rare = said.select("name", "words", F.explode("words").alias("word")).join(held, "word", "left").groupBy("name").agg(F.first("words").alias("words"), F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "word")).alias("x"))
    within = rare.where("x.names > 0").select("name", "words", F.col("x.word").alias("word")).join(posted, "word").where(F.size(F.array_except("words", "held")) == 0).select("name")
    # a name without words is part of any, and an empty name in the catalogue begins all
    bare = said.where(F.size("words") == 0).select("name")
    if real.isEmpty():
        return named.select(key, "name")
    if not real.where("n = ''").isEmpty():
        return named.select(key, "name").where(F.lit(False))
    return named.select(key, "name").join(known.union(begins).union(within).union(bare).distinct(), "name", "left_anti").select(key, "name")


def bounded(text: Column, name: Column) -> Column:
    """Whether ``name`` stands in ``text`` as words of its own; one constant pattern for all rows."""
    return F.when(name == "", False).otherwise(F.regexp_like(F.replace(text, name, F.lit("\x01")), F.lit("(?U)(?:^|[^\\w\\x01])\\x01(?:$|[^\\w\\x01])")))
