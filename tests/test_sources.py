"""Sources: items, crawl, tables, files."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from talus.operators import quality
from talus.sources import crawl, guide, web


def test_items(spark, tmp_path):
    items = [{"tipo": "asignatura", "grado": "G", "codigo": "", "nombre": "Física", "menciones": [], "ects": "4,5"}, {"tipo": "salidas", "grado": "G", "texto": "- a\n- b"}, {"tipo": "guia", "codigo": "1", "fallback": True, "cuerpo_general": "x"}]
    (tmp_path / "items.json").write_text(json.dumps(items, indent=2))
    got = crawl.read_items(spark, str(tmp_path / "items.json"))
    assert [r.ofertada for r in got["asignatura"].collect()] == [True]
    assert got["salidas"].first().texto == "- a\n- b" and got["guia"].first().temario is None and got["grado"].count() == 0
    crawl.write_items(got["salidas"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_crawl(spark):
    def fetch(url):
        return "text/html", url.encode() * 3

    source = crawl.crawl_source(fetch, lambda u: "secret" not in u, 0.0, 40)
    spark.dataSource.register(source)
    got = spark.read.format("talus_crawl").option("urls", "http://a.es/1 http://a.es/secret http://b.es/a-long-address").load().collect()
    assert sorted((r.url, r.truncated) for r in got) == [("http://a.es/1", False), ("http://b.es/a-long-address", True)]
    assert all(len(r.content) <= 40 for r in got)


def test_tables():
    page = "<table><tr><th>Código<th>Asignatura<th>x<th>Mención<th>Créditos ECTS<tr><td>1<td>F&iacute;sica<td>y<td>M<td>6<tr><td>short</table><table><tr><th>Asignatura</th><th>ECTS</th></tr><tr><td>a</td><td>6</td></tr></table>"
    assert web.read_tables(page) == [(0, {"code": "1", "name": "Física", "mention": "M", "ects": "6"})]


def test_pdf_text(spark):
    def extract(body):
        if body == b"bad":
            raise ValueError
        return [body.decode(), "end"]

    files = spark.createDataFrame([("a", b"one"), ("b", b"bad")], "path string, content binary")
    assert {r.path: r.text for r in guide.pdf_text(files, extract).collect()} == {"a": "one\nend", "b": ""}


def test_blocks_and_tables(spark):
    assert crawl.replace_block("a<!-- t -->old<!-- /t -->b", "t", "new") == "a<!-- t -->\nnew\n<!-- /t -->b"
    with pytest.raises(ValueError):
        crawl.replace_block("a", "t", "new")
    assert crawl.markdown_table(spark.createDataFrame([("a", 1), ("b", 2)], "m string, n int"), "n").splitlines()[2:] == ["| b | 2 |", "| a | 1 |"]


def test_require(spark):
    df = spark.range(3)
    assert quality.require(df, F.col("id") < 5, F.lit("no")).count() == 3
    with pytest.raises(PySparkException, match="row 2"):
        quality.require(df, F.col("id") < 2, F.concat(F.lit("row "), F.col("id").cast("string"))).collect()
