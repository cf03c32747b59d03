"""A polite crawl as a batch data source, and the crawl's items as typed tables.

``fetch`` is injected, so that tests need no network. One reader partition a site keeps the delay between requests.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from talus.store import stored

MAX_BYTES = 2 * 1024 * 1024
SCHEMAS = {
    "asignatura": "tipo string, grado string, codigo string, nombre string, tipo_asignatura string, menciones array<string>, ects string, ofertada boolean, url_guia string, tiene_guia boolean, curso string, cuatrimestre string",
    "guia": "tipo string, codigo string, nombre string, grado string, curso string, formato string, fallback boolean, resumen string, temario string, cuerpo_general string",
    "salidas": "tipo string, grado string, texto string",
    "grado": "tipo string, nombre string, es_doble_grado boolean, url_asignaturas string, url_salidas string",
    "procedencia": "tipo string, fecha_extraccion string, origen string",
}


class Site(InputPartition):
    def __init__(self, host: str, urls: list[str]) -> None:
        self.host, self.urls = host, urls


def crawl_source(fetch: Callable[[str], tuple[str, bytes]], allowed: Callable[[str], bool] = lambda url: True, delay: float = 1.0, max_bytes: int = MAX_BYTES) -> type[DataSource]:
    """A data source class to register: option ``urls`` lists pages between spaces; larger ones than allowed are cut."""

    class Reader(DataSourceReader):
        def __init__(self, urls: list[str]) -> None:
            self.urls = urls

        def partitions(self) -> list[Site]:
            by: dict[str, list[str]] = {}
            for u in self.urls:
                by.setdefault(urlsplit(u).netloc, []).append(u)
            return [Site(h, u) for h, u in sorted(by.items())]

        def read(self, partition: Site) -> Iterator[tuple]:
            for i, url in enumerate(partition.urls):
                if not allowed(url):
                    continue
                if i:
                    time.sleep(delay)
                kind, body = fetch(url)
                yield url, kind, body[:max_bytes], len(body) > max_bytes

    class Crawl(DataSource):
        @classmethod
        def name(cls) -> str:
            return "talus_crawl"

        def schema(self) -> str:
            return "url string, content_type string, content binary, truncated boolean"

        def reader(self, schema) -> Reader:
            return Reader(self.options["urls"].split())

    return Crawl


def read_items(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One typed table for each kind of item in a JSON array; what an item lacks is null, ``ofertada`` is true.

    The file is parsed once, into a table that is parted by kind; each kind reads its own part of it.
    """
    fields = {f: None for schema in SCHEMAS.values() for f in schema.split(", ")}
    items = stored(spark.read.schema(", ".join(fields)).json(path, multiLine=True).where(F.col("tipo").isin(list(SCHEMAS))), "items", "tipo")
    out = {}
    for kind, schema in SCHEMAS.items():
        own = items.where(F.col("tipo") == kind).select(*[f.split()[0] for f in schema.split(", ")[1:]])
        out[kind] = own.withColumn("ofertada", F.coalesce("ofertada", F.lit(True))) if kind == "asignatura" else own
    return out


def write_items(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)


def replace_block(document: str, name: str, body: str) -> str:
    """The text with what stands between two markers replaced."""
    start, end = f"<!-- {name} -->", f"<!-- /{name} -->"
    head, found, rest = document.partition(start)
    _, closed, tail = rest.partition(end)
    if not found or not closed:
        raise ValueError(f"no block {name}")
    return f"{head}{start}\n{body.strip()}\n{end}{tail}"


def markdown_table(rows: DataFrame, order: str, most: int = 10_000) -> str:
    """A small result as a Markdown table, the best first; raises where it has more than ``most`` rows."""
    names = rows.columns
    found = rows.orderBy(F.desc(order)).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: a report holds summaries")
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found]
    return "\n".join(lines)
