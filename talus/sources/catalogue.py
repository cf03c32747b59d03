"""The catalogue site: which links lead to degrees, subjects, careers and guides, and the items that these pages give.

``RULES`` are what ``frontier.crawl`` follows. The items come from the crawled pages by joins on addresses; a subject or guide belongs to the degree
whose page led to it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import fixed as X
from talus.functions import text as T
from talus.sources import regions as R
from talus.sources import web as P
from talus.sources.frontier import Follow, addresses, linked


def _page() -> Column:
    return F.col("page")


def is_degree(label: Column) -> Column:
    return F.contains(label, F.lit(X.DEGREE_WORD)) & ~F.contains(T.normalize_label(label), F.lit(X.ENDING_DEGREE))


def preferred(role: str, *parts: str) -> Follow:
    """Follow the first link with the first of ``parts`` in its address that any link has; the page keeps the name of the one before it."""

    def find(pages: DataFrame) -> DataFrame:
        page = _parsed(pages)
        return page.select(F.col("url").alias("parent"), F.lit(0).alias("pos"), _link(*parts).alias("href"), F.lit(role).alias("role"), "name").where("href is not null")

    return find


def _parsed(pages: DataFrame) -> DataFrame:
    return pages.withColumn("page", R.regions(F.col("content").cast("string")))


def _link(*parts: str) -> Column:
    return F.coalesce(*[F.get(R.select(_page(), f"a[href*={p}]"), 0).href for p in parts])


def guide_links(pages: DataFrame) -> DataFrame:
    """Follow the guides of the subjects; the name is the subject's."""
    return subject_rows(pages).where("href is not null").select(F.col("url").alias("parent"), "pos", T.repair_url(F.col("href")).alias("href"), F.lit("guide").alias("role"), F.col("nombre").alias("name"))


RULES: dict[str, Follow] = {
    "start": linked(X.MENU_PATH, "degree", is_degree),
    "degree": lambda pages: preferred("subjects", *X.SUBJECTS_LINKS)(pages).union(preferred("careers", X.CAREERS_LINK)(pages)),
    "subjects": guide_links,
}


def _cells(row: Column, tags: tuple[str, ...]) -> Column:
    """The cells of a table row with their text, first link and paragraphs."""
    inside = lambda o, *names: F.filter(F.slice(_page().elements, o.n + 2, o.end - o.n - 1), lambda e: e.tag.isin(*names))
    numbered = F.transform(_page().elements, lambda e, n: F.struct(n.alias("n"), *[e[c].alias(c) for c in ("tag", "href", "first", "last", "end")]))
    cells = F.filter(F.slice(numbered, row.n + 2, row.end - row.n - 1), lambda e: e.tag.isin(*tags))

    def cell(c: Column) -> Column:
        link = F.get(inside(c, "a"), 0)
        return F.struct(
            R.text_of(_page(), c).alias("text"), F.when(link.isNotNull(), R.text_of(_page(), link)).alias("link"), link.href.alias("href"),
            F.filter(F.transform(inside(c, "p"), lambda p: R.text_of(_page(), p)), lambda x: x != "").alias("paragraphs"),
        )

    return F.transform(cells, cell)


def subject_rows(pages: DataFrame) -> DataFrame:
    """The valid rows of the tables of subjects, as they stand: url, name (of the degree), pos, codigo, nombre, tipo_asignatura, menciones, ects, ofertada, href, curso, cuatrimestre."""
    page = _parsed(pages).select("url", "name", "page")
    sequence = page.select("url", F.explode(F.concat(*[
        F.transform(R.select(_page(), tag), lambda e: F.struct(e.n.alias("at"), F.when(e.tag != "table", R.text_of(_page(), e)).alias("label"))) for tag in ("h2", "h3", "h4", "strong", "caption", "table")
    ])).alias("x")).select("url", "x.at", "x.label")
    # a caption stands inside its table, so the table comes after it
    places = P.nearest_labels(sequence.withColumn("label", F.coalesce("label", F.lit(""))), "url", "at", "label").select("url", "at", "term", "year")
    rows = R.select(_page(), "table tr")
    tables = R.select(_page(), "table")
    # the innermost table around a row, and whether the row is the first of it
    of = lambda r: F.array_max(F.transform(F.filter(tables, lambda t: (t.n < r.n) & (r.n < t.end)), lambda t: t.n))
    found = page.select("url", "name", F.explode(F.transform(rows, lambda r: F.struct(r.n.alias("pos"), of(r).alias("at"), _cells(r, ("th",)).text.alias("heads"), _cells(r, ("td",)).alias("cells")))).alias("r"))
    found = found.select("url", "name", "r.*")
    heads = F.first("heads").over(Window.partitionBy("url", "at").orderBy("pos"))
    fields = F.transform(heads, P.field_of)
    found = found.withColumn("fields", fields)
    place = lambda f: F.array_position("fields", f).cast("int")
    text = lambda f: F.when(place(f) > 0, F.get("cells", place(f) - 1).text).otherwise("")
    has = lambda f: F.array_contains("fields", f)
    found = found.where((has("kind") | has("mention")) & has("name") & has("ects"))
    found = found.where(F.size("cells") >= F.greatest(*[place(f) for f in ("code", "name", "kind", "mention", "ects")]))
    cell = F.get("cells", place("name") - 1)
    raw = F.coalesce(F.nullif(cell.link, F.lit("")), cell.text)
    mention = F.get("cells", place("mention") - 1)
    parts = F.when(F.size(mention.paragraphs) > 0, F.array_join(mention.paragraphs, "/")).otherwise(mention.text)
    out = found.select(
        "url", "name", "pos", "at", text("code").alias("codigo"), T.strip_footnote(T.split_offer(raw)["name"]).alias("nombre"),
        F.when(has("mention"), "OP").otherwise(T.normalize_type(text("kind"))).alias("tipo_asignatura"),
        F.when(has("mention"), T.split_mentions(parts)).otherwise(F.array().cast("array<string>")).alias("menciones"),
        text("ects").alias("ects"), T.split_offer(cell.text)["offered"].alias("ofertada"), F.nullif(cell.href, F.lit("")).alias("href"),
    )
    out = out.where(T.is_valid_subject(F.col("nombre"), F.col("tipo_asignatura"))).join(_last_heading(places, out), ["url", "at"], "left")
    said = lambda c, end: F.coalesce(F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.char_length(c)), F.lit(end)), F.lit(""))
    return out.withColumns({"curso": said(F.col("year"), " curso"), "cuatrimestre": said(F.col("term"), " cuatrimestre")}).drop("at", "year", "term")


def _last_heading(places: DataFrame, rows: DataFrame) -> DataFrame:
    """What the headings before each table say; one row a table."""
    return places.dropDuplicates(["url", "at"]).join(rows.select("url", "at").distinct(), ["url", "at"], "left_semi")


def subjects(pages: DataFrame) -> DataFrame:
    """One row a degree and code (name, where there is no code): first values, mentions united in order, blank year and term filled by later rows."""
    rows = subject_rows(pages.where("role = 'subjects' and status = 'ok'")).withColumn("key", F.coalesce(F.nullif("codigo", F.lit("")), "nombre"))
    facts = ["codigo", "nombre", "tipo_asignatura", "ects", "ofertada", "href", "url"]
    listed = F.array_sort(F.collect_list(F.struct("pos", *facts, "menciones", "curso", "cuatrimestre"))).alias("r")
    filled = lambda f: F.coalesce(F.get(F.filter(F.transform("r", lambda x: x[f]), lambda v: v != ""), 0), F.lit("")).alias(f)
    out = rows.groupBy(F.col("name").alias("grado"), "key").agg(listed)
    out = out.select("grado", *[F.element_at("r", 1)[f].alias(f) for f in facts], F.array_distinct(F.flatten(F.transform("r", lambda x: x["menciones"]))).alias("menciones"), filled("curso"), filled("cuatrimestre"))
    out = out.withColumn("url_guia", T.repair_url(addresses(F.col("url"), F.col("href")))).withColumn("tiene_guia", F.col("href").isNotNull())
    return out.select("grado", "codigo", "nombre", "tipo_asignatura", "menciones", "ects", "ofertada", "url_guia", "tiene_guia", "curso", "cuatrimestre")


def degrees(pages: DataFrame) -> DataFrame:
    page = _parsed(pages.where("role = 'degree' and status = 'ok'"))
    out = page.select(F.col("name").alias("nombre"), F.contains("name", F.lit(X.DOUBLE_DEGREE)).alias("es_doble_grado"), "url", _link(*X.SUBJECTS_LINKS).alias("a"), _link(X.CAREERS_LINK).alias("b"))
    return out.select("nombre", "es_doble_grado", addresses(F.col("url"), F.col("a")).alias("url_asignaturas"), addresses(F.col("url"), F.col("b")).alias("url_salidas"))


def careers(pages: DataFrame) -> DataFrame:
    """Paragraphs, then distinct list items as bullets; nothing where there is no list."""
    page = _parsed(pages.where("role = 'careers' and status = 'ok'"))
    lines = lambda path: F.filter(F.transform(R.select(_page(), path), lambda e: R.text_of(_page(), e)), lambda x: x != "")
    items = F.array_distinct(lines(".field--name-body ul li"))
    text = F.array_join(F.concat(lines(".field--name-body p"), F.transform(items, lambda x: F.concat(F.lit("- "), x))), "\n")
    return page.where(F.size(items) > 0).select(F.col("name").alias("grado"), text.alias("texto"))


def guide_parts(page: Column) -> Column:
    """struct(resumen, temario, cuerpo_general, fallback): the two sections, or all text but excluded sections where these are too short."""
    part = lambda i: R.section(page, f"#{i} .{X.VALUE_CLASS}")
    a, b = part(X.SUMMARY_ID), part(X.CONTENTS_ID)
    short = F.char_length(a) + F.char_length(b) < X.LEAST_GUIDE
    general = R.text_without(page, X.SHEET, *[f"#{i}" for i in X.LEFT_OUT_IDS])
    blank = lambda c: F.when(short, "").otherwise(c)
    return F.struct(blank(a).alias("resumen"), blank(b).alias("temario"), F.when(short, general).alias("cuerpo_general"), short.alias("fallback"))


def html_guides(pages: DataFrame) -> DataFrame:
    """Guides served as pages; PDF files are read by ``guide.pdf_text``."""
    page = _parsed(pages.where("role = 'guide' and status = 'ok'").where(~P.is_pdf(F.col("content_type"), F.col("content"))))
    out = page.select("url", "parent", F.col("name").alias("nombre"), T.year_of_url(F.col("url")).alias("curso"), F.lit("html").alias("formato"), guide_parts(_page()).alias("g"))
    degree = pages.where("role = 'subjects'").select(F.col("url").alias("parent"), F.col("name").alias("grado"))
    return out.join(degree, "parent", "left").select("url", "nombre", "grado", "curso", "formato", "g.*")
