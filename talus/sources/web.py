"""Pages: links, headings, lists, tables and text by regular expressions, since tags may be left open.

Tables need state from row to row and are read in Arrow batches; the rest are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import fixed as X
from talus.functions import text as T

TAG = "<[^>]*>"


def strip_tags(html: Column) -> Column:
    return T.squeeze(F.regexp_replace(html, TAG, " "))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(…, pos, href, label) of every anchor."""
    found = F.regexp_extract_all(html, F.lit("<a href=\"[^\"]*\"[^>]*>[^<]*</a>"), 0)
    out = pages.select(*[c for c in pages.columns if c != html], F.posexplode(found).alias("pos", "_a"))
    return out.withColumn("href", F.regexp_extract("_a", "<a href=\"([^\"]*)\"", 1)).withColumn("label", F.regexp_extract("_a", ">([^<]*)</a>", 1)).drop("_a")


def degree_links(anchors: DataFrame, wanted: str = "Grado", unwanted: str = "en extincion") -> DataFrame:
    """Anchors whose label holds ``wanted`` and, normalised, not ``unwanted``."""
    return anchors.where(F.contains("label", F.lit(wanted)) & ~F.contains(T.normalize_label(F.col("label")), F.lit(unwanted)))


def first_link(html: Column, *patterns: str) -> Column:
    """The first href that matches the first pattern that any matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(html, f"<a href=\"([^\"]*{p}[^\"]*)\"", 1), F.lit("")) for p in patterns])


def list_items(html: Column) -> Column:
    """Distinct texts of list items, first seen first."""
    items = F.regexp_extract_all(html, F.lit("<li>(.*?)</li>"), 1)
    return F.array_distinct(F.filter(F.transform(items, strip_tags), lambda x: x != ""))


def paragraphs(html: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit("<p>([^<]*)"), 1), T.squeeze), lambda x: x != "")


def careers(html: Column) -> Column:
    """Paragraphs and bullets; nothing without list items."""
    items = list_items(html)
    return F.when(F.size(items) > 0, F.array_join(F.concat(paragraphs(html), F.transform(items, lambda x: F.concat(F.lit("- "), x))), "\n"))


def text_or_fallback(structured: Column, whole: Column, least: int = 200) -> Column:
    """Structured text unless it is too short."""
    return F.when(F.char_length(structured) < least, whole).otherwise(structured)


#: Header labels by prefix, as fields; any other label with ``CREDITS`` in it is one of credits too.
FIELDS = {"codigo": "code", "asignatura": "name", "tipo": "kind", "caracter": "kind", "mencion": "mention", "credito": "ects"}
CREDITS = "ects"


def field_of(label: Column) -> Column:
    """The field that a column heading stands for, or null."""
    bare = T.normalize_label(label)
    out = F.when(F.lit(False), F.lit(""))
    for prefix, name in FIELDS.items():
        out = out.when(F.startswith(bare, F.lit(prefix)), F.lit(name))
    return out.when(F.contains(bare, F.lit(CREDITS)), F.lit("ects"))


def header_map(cells: DataFrame, key: str, position: str, label: str) -> DataFrame:
    """(key, field, position): the first column of each field."""
    return cells.withColumn("field", field_of(F.col(label))).where("field is not null").groupBy(key, "field").agg(F.min(position).alias(position))


_ROW, _CELL = re.compile(r"<tr[^>]*>(.*?)(?=<tr|</table|\Z)", re.S | re.I), re.compile(r"<t[hd][^>]*>(.*?)(?=<t[hd]|</tr|\Z)", re.S | re.I)
_TABLE, _TAGS = re.compile(r"<table[^>]*>(.*?)(?:</table>|\Z)", re.S | re.I), re.compile(TAG)


def read_tables(html: str) -> list[tuple[int, dict[str, str]]]:
    """(table number, fields) of each row: columns by the first row's labels; tables without type or mention, name
    or credits are left out, and so are rows that are too short."""
    from talus.functions.plain import normalize

    out = []
    for number, table in enumerate(_TABLE.findall(html)):
        rows = [[" ".join(unescape(_TAGS.sub(" ", c)).split()) for c in _CELL.findall(r)] for r in _ROW.findall(table)]
        if not rows:
            continue
        place: dict[str, int] = {}
        for i, label in enumerate(rows[0]):
            bare = normalize(label)
            name = next((f for p, f in FIELDS.items() if bare.startswith(p)), "ects" if CREDITS in bare else None)
            if name:
                place.setdefault(name, i)
        if not {"name", "ects"} <= place.keys() or not place.keys() & {"kind", "mention"}:
            continue
        out += [(number, {f: r[i] for f, i in place.items()}) for r in rows[1:] if len(r) > max(place.values())]
    return out


def table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, table, code, name, kind, mention, ects) of ``pages(page_id, html)``."""
    names = ["code", "name", "kind", "mention", "ects"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, n, *[f.get(c) for c in names]) for p, h in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True) for n, f in read_tables(h or "")]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.string()] * 5]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "table", *names])

    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, table int, code string, name string, kind string, mention string, ects string")


def nearest_labels(sequence: DataFrame, key: str, position: str, label: str) -> DataFrame:
    """With the term and the year that the headings up to a row say.

    Seen from the row, the nearest heading that says a term or a year or ``ELECTIVE`` counts. One that says a term gives it, and the
    next such heading before it gives the year; a year alone leaves the term open; an elective leaves both open. Each heading
    thus settles what the rows after it get, with one look at the headings before it. A year may be two ("tercer o cuarto"): both stay.
    """
    low = T.normalize_label(F.col(label))
    found = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit(""))
    elective = F.contains(low, F.lit(X.ELECTIVE_SAID))
    own = F.when(elective | found(X.YEAR_SAID).isNotNull(), F.struct(F.when(~elective, found(X.YEAR_SAID)).alias("year")))
    w = Window.partitionBy(key).orderBy(position)
    out = sequence.withColumn("_own", own).withColumn("_before", F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    said = F.when(found(X.TERM_SAID).isNotNull(), F.struct(found(X.TERM_SAID).alias("term"), F.col("_before.year").alias("year")))
    said = said.when(F.col("_own").isNotNull(), F.struct(F.lit(None).cast("string").alias("term"), F.col("_own.year").alias("year")))
    out = out.withColumn("_said", F.last(said, ignorenulls=True).over(w))
    return out.withColumns({"term": F.col("_said.term"), "year": F.col("_said.year")}).drop("_own", "_before", "_said")


def is_pdf(content_type: Column, body: Column) -> Column:
    """By content type or first bytes, never by name."""
    return F.contains(F.coalesce(content_type, F.lit("")), F.lit("application/pdf")) | F.startswith(body, F.lit(b"%PDF-"))
