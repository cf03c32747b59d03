"""The crawl that follows links against a plain one; regions of pages; the items of the catalogue site."""

import time
from collections import Counter
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from talus.sources import catalogue, frontier
from talus.sources import regions as R

HOST = "https://eps.uni.es"
GUIDE = (
    '<div id="fichadocenteasignatura"><div id="resumen"><div class="fdoca_valor_cuadro_ambito">{0}<div class="fdoca_valor_cuadro_ambito">inner</div></div>'
    '<div class="fdoca_valor_cuadro_ambito">-</div></div><div id="descripcioncontenidos"><p class="x fdoca_valor_cuadro_ambito">Tema 1 &amp; 2<b>bold<p class="fdoca_valor_cuadro_ambito">Tema 3</div>'
    '<div id="coordinador"><div class="fdoca_valor_cuadro_ambito">A person</div></div><div id="clausulas">Legal<div>more legal</div></div><p>Notice.</div><p>Outside'
)
TABLE = """
<h3>Tercer o cuarto curso</h3><h4>Primer cuatrimestre</h4>
<table><caption>x</caption><tr><th>Código<th>Asignatura<th>Tipo<th>Créditos ECTS
<tr><td>111<td><a href="https://uv.uni.es/2024-25/g111.html?x=1.html">Física*</a><td>obligatoria<td>6
<tr><td>112<td>Química (no ofertada este curso)<td>FB<td>4,5
<tr><td>short</table>
<h3>Asignaturas optativas</h3>
<table><tr><th>Asignatura<th>Código<th>Mención<th>ECTS<tr><td><a href="/g113">Redes</a><td>113<td><p>Uno / Dos<p>Uno<td>6<tr><td>Optativa 3<td>9<td>x<td>6</table>
<table><tr><th>Nombre<th>Valor<tr><td>a<td>b</table>
<table><tr><th>Código<th>Asignatura<th>Mención<th>ECTS<tr><td>113<td>Redes<td>Tres<td>6<tr><td><td>Física<td>Uno<td>3</table>
"""
SITE = {
    f"{HOST}/robots.txt": "User-agent: *\nDisallow: /privado\nCrawl-delay: 0",
    f"{HOST}/grados": '<aside class="layout-sidebar-first"><nav><ul class="menu x"><li><a href="/gi">Grado en Informática</a><li><a href="gm#top">Grado en Minas (en extinción)</a>'
    '<li><a href="/dg?b=2&a=1">Doble Grado en A y B</a></li><li><a href="/otro">PARS</a></ul></nav></aside><a href="/gz">Grado en Nada</a>',
    f"{HOST}/gi": '<a href="x/plan-de-estudios">p</a><a href="/gi/asignaturas-y-profesorado">a</a><a href="/gi/salidas-profesionales">s</a><a href="/otro">o</a>',
    f"{HOST}/dg?a=1&b=2": '<a href="/dg/plan-de-estudios">p</a>',
    f"{HOST}/gi/asignaturas-y-profesorado": TABLE,
    f"{HOST}/dg/plan-de-estudios": TABLE.replace("/g113", "/privado/g113").replace("Primer cuatrimestre", "Optativas"),
    f"{HOST}/gi/salidas-profesionales": '<div class="field--name-body"><p>Intro<ul><li>One<li>Two</li><li>One</ul></div><ul><li>menu</ul>',
    "https://uv.uni.es/2024-25/g111.html": GUIDE.format("Long summary. " * 20),
    f"{HOST}/g113": GUIDE.format("short"),
    f"{HOST}/otro": "never",
}


def plain_crawl(site):
    """Breadth first, one page after the other."""
    import re

    rules = RobotFileParser()
    rules.parse(site[f"{HOST}/robots.txt"].splitlines())
    got, todo = {}, [(f"{HOST}/grados", "start")]
    while todo:
        url, role = todo.pop(0)
        if url in got:
            continue
        got[url] = role if "uv." in url or rules.can_fetch("talus", url) else "disallowed"
        html = site.get(url, "") if got[url] == role else ""
        hrefs = [(frontier.canonical(url, h), t) for h, t in re.findall(r'<a href="([^"]*)">([^<]*)', html)]
        if role == "start":
            todo += [(u, "degree") for u, t in hrefs[:-1] if "Grado" in t and "extinci" not in t]
        elif role == "degree":
            plan = [u for u, _ in hrefs if "asignaturas-y" in u] or [u for u, _ in hrefs if "plan-de" in u]
            todo += [(u, "subjects") for u in plan[:1]] + [(u, "careers") for u, _ in hrefs if "salidas" in u]
        elif role == "subjects":
            todo += [(u.split("?")[0], "guide") for u, _ in hrefs]
    return got


def fetcher(asked=None):
    site = SITE

    def fetch(url):
        if url not in site:
            raise OSError(url)
        return "text/html", site[url].encode()

    return frontier.by_host(fetch, 0.0)


def crawled(spark, **more):
    return frontier.crawl(spark, [f"{HOST}/grados#x"], catalogue.RULES, fetcher(), ["uni.es"], **more)


@pytest.fixture(scope="module")
def pages(spark):
    return crawled(spark).cache()


def test_crawl_equals_a_plain_one(pages):
    rows = pages.collect()
    assert max(Counter(r.url for r in rows).values()) == 1
    assert {r.url: "disallowed" if r.status == "disallowed" else r.role for r in rows} == plain_crawl(SITE)
    assert {r.url for r in rows if r.status == "disallowed"} == {f"{HOST}/privado/g113"}
    assert {r.url: r["round"] for r in rows}[f"{HOST}/g113"] == 3


def test_few_pages_a_host_and_round_give_the_same_pages(spark, pages):
    few = crawled(spark, per_host=2)
    assert {r.url for r in few.select("url").collect()} == {r.url for r in pages.select("url").collect()}
    assert few.groupBy("host", "round").count().where("count > 2").isEmpty() and few.count() == pages.count()


def test_without_a_limit_rounds_are_depths(spark, pages):
    """Where nothing waits for a host's turn, a page's round is its depth, however many pages its host has."""
    rounds = lambda p: {r.url: r["round"] for r in p.select("url", "round").collect()}
    assert rounds(crawled(spark, per_host=None)) == rounds(pages)


def test_other_domains_failures_and_sizes(spark):
    site = {"http://a.es/": '<a href="/big">1</a><a href="http://b.org/">2</a><a href="http://c.a.es:80/none">3</a><a href="mailto:x@a.es">4</a><a href="http://[bad">5</a>', "http://a.es/big": "x" * 500}

    def fetch(url):
        return "text/html", site[url].encode()

    got = frontier.crawl(spark, ["http://a.es", "ftp://a.es"], {"start": frontier.linked("a", "page")}, frontier.by_host(fetch, 0.0, 400), ["a.es"])
    assert sorted((r.url, r.status) for r in got.collect()) == [("http://a.es/", "ok"), ("http://a.es/big", "too_large"), ("http://c.a.es/none", "failed")]
    assert frontier.crawl(spark, [], {}, frontier.by_host(fetch, 0.0)).count() == 0


def test_delay_within_a_host(spark):
    def fetch(url):
        return str(time.time()), b""

    hosts = spark.createDataFrame([(f"http://h{i % 2}.es/{i}", f"h{i % 2}.es", "User-agent: talus\nCrawl-delay: 1" if i % 2 else "") for i in range(6)], "url string, host string, robots string")
    got = frontier.by_host(fetch, 0.2)(hosts).collect()
    for h, least in (("h0", 0.2), ("h1", 1.0)):
        at = sorted(float(r.content_type) for r in got if f"//{h}." in r.url)
        assert min(b - a for a, b in zip(at, at[1:])) >= least - 0.01


def test_items(pages):
    got = {r.codigo or r.nombre: r.asDict() for r in catalogue.subjects(pages).where("grado like '%Inform%'").collect()}
    assert sorted(got) == ["111", "112", "113", "Física"]
    assert got["111"] == {
        "grado": "Grado en Informática", "codigo": "111", "nombre": "Física", "tipo_asignatura": "OB", "menciones": [], "ects": "6", "ofertada": True,
        "url_guia": "https://uv.uni.es/2024-25/g111.html", "tiene_guia": True, "curso": "Tercer o cuarto curso", "cuatrimestre": "Primer cuatrimestre",
    }
    assert (got["112"]["nombre"], got["112"]["ofertada"], got["112"]["url_guia"], got["112"]["tipo_asignatura"]) == ("Química", False, None, "FB")
    assert got["113"]["menciones"] == ["Uno", "Dos", "Tres"] and got["113"]["tipo_asignatura"] == "OP" and got["113"]["curso"] == ""
    assert {tuple(r) for r in catalogue.degrees(pages).collect()} == {
        ("Grado en Informática", False, f"{HOST}/gi/asignaturas-y-profesorado", f"{HOST}/gi/salidas-profesionales"), ("Doble Grado en A y B", True, f"{HOST}/dg/plan-de-estudios", None),
    }
    assert [tuple(r) for r in catalogue.careers(pages).collect()] == [("Grado en Informática", "Intro\n- One\n- Two")]
    guides = {r.nombre: r for r in catalogue.html_guides(pages).collect()}
    assert guides["Física"].resumen.endswith("Long summary. inner\n\ninner") and guides["Física"].temario == "Tema 1 & 2 bold\n\nTema 3" and guides["Física"].curso == "2024-25"
    assert guides["Redes"].fallback and guides["Redes"].cuerpo_general == "short inner - Tema 1 & 2 bold Tema 3 Notice." and guides["Redes"].grado == "Grado en Informática"


def test_canonical_addresses():
    c = frontier.canonical
    assert c("https://A.es/x/y", "../z?b=2&a=1#f") == "https://a.es/z?a=1&b=2" and c("http://a.es", "//B.es:80") == "http://b.es/" and c("http://a.es/", "https://a.es:8443/") == "https://a.es:8443/"
    assert c("http://a.es", "javascript:x()") is None and c("http://a.es", "http://a.es:port/") is None and c(None, None) is None


CASES = [
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "ul ul li", ["b", "c"]),
    ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", "li", ["a b c", "b", "d"]),
    ("<p>one<div>two</div></p>three", "p", ["one"]),
    ("<p>one<b>two<p>three</b>four", "p", ["one two", "three four"]),
    ("<div id=a><div>x</span></div>y</div>z", "#a", ["x y"]),
    ("<table><tr><td>a<table><tr><td>b</table>c<td>d</table>", "table table td", ["b"]),
    ("<table><tr><td>a<td>b<tr><th>c<tbody><tr><td>d</table>e", "tr", ["a b", "c", "d"]),
    ("<dl><dt>a<dd>b<dt>c</dl>", "dd", ["b"]),
    ("<select><option>a<option>b</select>", "option", ["a", "b"]),
    ("<a class='x y' class=z href=q>l</a><img class=x><br/>m", ".x", ["l", ""]),
    ("<script>if (a<b) '</p>'</script><!-- <p>no --><p>yes", "p", ["yes"]),
    ("<div id=a>open", "#a", ["open"]),
    ("a &lt; b &amp;c", "p", []),
    ("<p", "p", []),
]


def test_regions(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(CASES)], "k int, html string").select("k", R.regions(F.col("html")).alias("r"))
    for k, (_, path, want) in enumerate(CASES):
        row = df.where(F.col("k") == k).select(F.transform(R.select(F.col("r"), path), lambda e: R.text_of(F.col("r"), e)).alias("x")).first()
        assert row.x == want, CASES[k]
    with pytest.raises(ValueError):
        R.select(F.col("r"), "a > b")


def test_open_ids(spark):
    df = spark.createDataFrame([("<div id=a>1<p id=b>2<p>3</div>4",), (None,)], "html string").select(R.regions(F.col("html")).alias("r"))
    got = [[(x.text, x.ids) for x in r.o] for r in df.select(R.open_ids(F.col("r")).alias("o")).collect()]
    assert got == [[("1", ["a"]), ("2", ["a", "b"]), ("3", ["a"]), ("4", [])], []]
    assert R.read_regions("<div>" * 3000 + "deep")["elements"][0]["last"] == 1
