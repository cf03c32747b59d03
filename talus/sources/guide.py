"""Course guides as lines: noise, sections, personal data, what is missing and why."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions import fixed as X
from talus.functions import text as T


def pdf_text(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, text) of ``files(path, content)``: the page texts that ``extract`` returns, or '' if it fails."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body in b.column("content").to_pylist():
                try:
                    out.append("\n".join(extract(body)))
                except Exception:  # noqa: BLE001 - an unreadable file has no text
                    out.append("")
            yield pa.record_batch([b.column("path"), pa.array(out)], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def clean_lines(text: Column) -> Column:
    """Trimmed lines without blanks and page headers."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x))
    noise = lambda x: F.exists(T.strings(X.PAGE_NOISE), lambda p: F.regexp_like(x, p))
    return F.filter(lines, lambda x: (x != "") & ~noise(x))


def section(lines: Column, label: str, labels: list[str] | None = None) -> Column:
    """The lines between a label and the next known one; null without the label."""
    at = F.array_position(lines, label).cast("int")
    after = F.slice(lines, at + 1, F.size(lines))
    ends = F.filter(F.transform(after, lambda x, i: F.when(x.isin(labels or X.SECTION_LABELS), i)), lambda i: i.isNotNull())
    upto = F.when(F.size(ends) > 0, F.get(ends, F.lit(0))).otherwise(F.size(after))
    return F.when(at > 0, F.array_join(F.slice(after, F.lit(1), upto), "\n"))


def guide(text: Column) -> Column:
    """struct(summary, contents) without personal data; null if both are empty."""
    lines = clean_lines(text)
    part = lambda label: T.redact_personal(F.coalesce(section(lines, label), F.lit("")))
    a, b = part(X.SECTION_SUMMARY), part(X.SECTION_CONTENTS)
    return F.when((a != "") | (b != ""), F.struct(a.alias("summary"), b.alias("contents")))


def no_guide_reason(text: Column, readable: Column) -> Column:
    """Why a file gives no guide; null if it gives one."""
    lines = clean_lines(F.coalesce(text, F.lit("")))
    known = F.arrays_overlap(lines, T.strings([X.SECTION_SUMMARY, X.SECTION_CONTENTS]))
    return (
        F.when(~readable, "ilegible").when(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \n\t\r")) == "", "sin_texto")
        .when(~known, "rotulos_desconocidos").when(guide(text).isNull(), "secciones_vacias")
    )


def chars_by_section(guides: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, chars): characters under each known label."""
    lines = guides.select(key, F.posexplode(clean_lines(F.col(text))).alias("pos", "line"))
    from pyspark.sql import Window

    label = F.last(F.when(F.col("line").isin(X.SECTION_LABELS), F.col("line")), ignorenulls=True).over(Window.partitionBy(key).orderBy("pos"))
    out = lines.withColumn("label", label).where("label is not null and line <> label")
    return out.groupBy(key, "label").agg(F.sum(F.char_length("line")).alias("chars"))
