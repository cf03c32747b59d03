"""Text functions as column expressions; regular expressions use ASCII classes so that engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.functions import fixed as X

WS = "[ \\t\\n\\x0B\\f\\r]+"
LETTER = "[A-Za-z0-9ß]"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def one_of(value: Column, table: dict[str, str], default: Column) -> Column:
    """A small literal map."""
    out = F.when(F.lit(False), default)
    for k, v in table.items():
        out = out.when(value == k, F.lit(v))
    return out.otherwise(default)


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, WS, " "))


def normalize(text: Column) -> Column:
    """Lower case, marks dropped, white space collapsed; signs stay."""
    return squeeze(F.translate(F.lower(text), X.ACCENTED, X.PLAIN))


def normalize_label(text: Column) -> Column:
    """As ``normalize``, without anything that is not ASCII."""
    return squeeze(F.regexp_replace(F.translate(F.lower(text), X.ACCENTED, X.PLAIN), "[^\\x00-\\x7F]", ""))


def tokens(text: Column) -> Column:
    """Distinct normalised words, stripped to letters and digits."""
    bare = F.transform(F.split(normalize(text), " "), lambda w: F.regexp_replace(w, "[^a-z0-9ß]", ""))
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


def clean(text: Column) -> Column:
    """No-break spaces as spaces, zero-width ones gone, white space collapsed; null as empty."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "\\x{00A0}", " ")
    return squeeze(F.regexp_replace(spaced, "\\x{200B}", ""))


def repair_url(url: Column) -> Column:
    """Cut after the first ``.html``."""
    return F.when(F.instr(url, ".html") > 0, F.substring(url, F.lit(1), F.instr(url, ".html") + 4)).otherwise(url)


def strip_footnote(name: Column) -> Column:
    return F.when(name == "", name).otherwise(F.btrim(F.regexp_replace(name, "[ \\t]*\\*+[ \\t]*$", "")))


NOT_OFFERED = "(?i)[ \\t]*\\([ \\t]*no[ \\t]+ofertad[ao][^)]*\\)[ \\t]*$"


def split_offer(name: Column) -> Column:
    """struct(name, offered)."""
    marked = F.coalesce(F.regexp_like(name, F.lit(NOT_OFFERED)), F.lit(False))
    return F.struct(F.when(marked, F.btrim(F.regexp_replace(name, NOT_OFFERED, ""))).otherwise(name).alias("name"), (~marked).alias("offered"))


def normalize_type(kind: Column) -> Column:
    kind = F.btrim(F.coalesce(kind, F.lit("")))
    return one_of(F.lower(kind), X.TYPE_SYNONYMS, kind)


def is_placeholder(name: Column) -> Column:
    return F.regexp_like(F.btrim(F.coalesce(name, F.lit(""))), F.lit("(?i)^optativa[ \\t]+[0-9]+$"))


def is_valid_subject(name: Column, kind: Column) -> Column:
    bare = F.btrim(F.coalesce(name, F.lit("")))
    return (bare != "") & ~is_placeholder(name) & F.upper(F.btrim(F.coalesce(kind, F.lit("")))).isin(X.VALID_TYPES)


def year_of_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "/([0-9]{4}-[0-9]{2})/", 1), F.lit(""))


def split_mentions(cell: Column) -> Column:
    """Parts between slashes, first seen first."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), "/"), lambda x: F.btrim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def core(name: Column) -> Column:
    """Without parentheses, normalised, words that are abbreviations written out."""
    words = F.split(normalize(F.regexp_replace(name, "[ \\t]*\\([^)]*\\)", " ")), " ")
    return F.array_join(F.transform(words, lambda w: one_of(w, X.ABBREVIATIONS, w)), " ")


def without_study_type(name: Column) -> Column:
    return F.regexp_replace(name, "^(doble +)?grado +en +", "")


def credits(ects: Column) -> Column:
    """The credits in parentheses, as a listing says them."""
    ects = F.coalesce(ects, F.lit(""))
    return F.when(ects == "", F.lit(X.NO_CREDITS_LISTED)).otherwise(F.concat(F.lit(" ("), ects, F.lit(" ECTS)")))


def placement(term: Column, year: Column) -> Column:
    """Where in the plan a subject stands; empty if neither is published, and a term alone says that the year is missing."""
    term, year = (squeeze(F.lower(F.coalesce(x, F.lit("")))) for x in (term, year))
    both = F.concat_ws(" de ", F.nullif(term, F.lit("")), F.nullif(year, F.lit("")))
    return F.when(both == "", "").otherwise(F.concat(F.lit("el "), both, F.when((year == "") & (term != ""), F.lit(X.NO_YEAR_SAID)).otherwise("")))


def subject_header(name: Column, kind: Column, ects: Column, degrees: Column, mentions: Column, term: Column, year: Column, offered: Column) -> Column:
    """A header that names its unit by itself; mentions only where there is one degree, and what is not published is said."""
    single, ects, place = F.size(degrees) == 1, F.coalesce(ects, F.lit("")), placement(term, year)
    label = one_of(kind, X.TYPE_LABELS, F.concat(F.lit("asignatura ("), kind, F.lit(")")))
    several = F.concat(F.lit("impartida en "), F.size(degrees).cast("string"), F.lit(" titulaciones: "), F.array_join(degrees, "; "))
    first = [
        F.concat(F.lit("«"), name, F.lit("», "), label),
        F.when(ects != "", F.concat(F.lit("de "), ects, F.lit(" ECTS"))),
        F.when(single, F.concat(F.lit("del "), degrees[0])).otherwise(several),
        F.when(single & (F.size(mentions) > 0), F.concat(F.lit("(mención: "), F.array_join(mentions, ", "), F.lit(")"))),
    ]
    said = [F.when(place != "", F.concat(F.lit(". Se imparte en "), place)), F.when(~F.coalesce(offered, F.lit(True)), F.lit(X.NOT_OFFERED_SAID)), F.when(ects == "", F.lit(X.NO_CREDITS_SAID))]
    return F.concat(F.concat_ws(" ", *first), F.concat_ws("", *said), F.lit("."))


def plain_header(name: Column, degrees: Column) -> Column:
    """The header of a guide without a subject."""
    where = F.when(F.size(degrees) == 1, F.concat(F.lit(" del "), degrees[0])).otherwise(F.concat(F.lit(" impartida en: "), F.array_join(degrees, "; ")))
    return F.concat(F.lit("«"), name, F.lit("», asignatura"), where, F.lit("."))


def year_order(label: Column) -> Column:
    """0 to 5 by the first ordinal, 98 unknown, 99 blank."""
    bare = F.lower(F.btrim(F.coalesce(label, F.lit(""))))
    out = F.when(bare == "", 99)
    for i, o in enumerate(X.YEAR_ORDER):
        out = out.when(F.startswith(bare, F.lit(o)), i)
    return out.otherwise(98)


def highest_year(label: Column) -> Column:
    """The highest ordinal a label holds, 0 if none."""
    low = F.lower(F.coalesce(label, F.lit("")))
    return F.greatest(*[F.when(F.contains(low, F.lit(o)), i + 1).otherwise(0) for i, o in enumerate(X.YEAR_ORDER)])


def year_of_listing(name: Column) -> Column:
    """The year that a listing's name says, from 1 on; one more than the last if it says none."""
    low = F.lower(name)
    out = F.when(F.lit(False), 0)
    for i, o in enumerate(X.YEAR_ORDER, start=1):
        out = out.when(F.contains(low, F.lit(f"de {o}")), i)
    return out.otherwise(len(X.YEAR_ORDER) + 1)


def expand(question: Column) -> Column:
    return F.concat(question, F.lit(" "), F.lit(X.DOMAIN_SENTENCE))


def asks_advice(question: Column) -> Column:
    bare = F.regexp_replace(question, X.QUOTED, " ")
    said = normalize(bare)
    phrase = F.exists(strings(X.ADVICE_PHRASES), lambda p: F.contains(said, p))
    return F.arrays_overlap(tokens(bare), strings(X.ADVICE)) | phrase


def _subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def courtesy(text: Column) -> Column:
    """'farewell', 'greeting' or null; all words must be courtesy."""
    said = tokens(text)
    pair = F.lit(False)
    for p in X.GREETING_PAIRS:
        pair = pair | _subset(strings(p), said)
    return F.when(
        (F.size(said) > 0) & _subset(said, strings(X.COURTESY)),
        F.when(F.arrays_overlap(said, strings(X.FAREWELL)), "farewell").when(F.arrays_overlap(said, strings(X.GREETING)) | pair, "greeting"),
    )


def closes(text: Column) -> Column:
    """A farewell without a question."""
    said = tokens(text)
    return F.arrays_overlap(said, strings(X.FAREWELL)) & ~F.contains(text, F.lit("?")) & ~F.arrays_overlap(said, strings(X.INTERROGATIVES))


def courtesy_without_context(text: Column) -> Column:
    """The reply to messages that found nothing: thanks without a question mark, any greeting, or two words at most that ask nothing."""
    said = tokens(text)
    asks = F.contains(text, F.lit("?"))
    thanks = F.arrays_overlap(said, strings(X.FAREWELL)) & ~asks
    short = (F.size(said) <= 2) & ~asks & ~F.arrays_overlap(said, strings(X.INTERROGATIVES))
    return F.when(thanks, "farewell").when(F.arrays_overlap(said, strings(X.GREETING)) | short, "greeting")


def other_centre(text: Column) -> Column:
    """Whether a university, school, faculty or campus elsewhere is named."""
    places = F.regexp_extract_all(normalize(text), F.lit(X.CENTRE), 1)
    return F.exists(places, lambda p: ~F.array_contains(strings(X.OWN_PLACES), p))


def fixed_reply(text: Column) -> Column:
    return F.coalesce(courtesy(text), F.when(closes(text), "farewell"), F.when(other_centre(text), "other_centre"))


def narrows(text: Column) -> Column:
    """Whether the question cuts down what was just said."""
    said = normalize(text)
    return F.exists(strings(X.ANAPHORA), lambda p: F.contains(said, p))


def content(text: Column, catalogue_tokens: Column | None = None) -> Column:
    """Words that carry a topic."""
    left = F.array_except(F.array_except(tokens(text), strings(X.STOPWORDS)), strings(X.ORDINALS))
    return left if catalogue_tokens is None else F.array_except(left, catalogue_tokens)


def close_sentence(text: Column) -> Column:
    """Cut after the last boundary, without white space at the end; unchanged if there is none."""
    cut = F.regexp_extract(text, "(?s)^.*[.!?\\n]", 0)
    return F.when(cut == "", text).otherwise(F.rtrim(cut, F.lit(" \t\n\x0b\f\r")))


def units(text: Column) -> Column:
    """Sentences with their boundary, and what remains."""
    return F.array_remove(F.split(text, "(?<=[.!?\\n])"), "")  # cut behind each boundary: a long rest without one is looked at once


def admissible_years(label: Column) -> Column:
    """The ordinals of a label, normalised and without the word for year."""
    bare = F.btrim(F.replace(normalize(label), F.lit(" curso"), F.lit("")))
    return F.filter(F.transform(F.split(bare, " o "), lambda x: F.btrim(x)), lambda x: x != "")


def as_written(name: Column) -> Column:
    """Sentence case for names in capitals; words in parentheses stay."""
    words = F.transform(F.split(squeeze(name), " "), lambda w: F.when(F.startswith(w, F.lit("(")), w).otherwise(F.lower(w)))
    said = F.array_join(words, " ")
    return F.when((F.upper(name) == name) & (F.lower(name) != name), F.concat(F.upper(F.substr(said, F.lit(1), F.lit(1))), F.substr(said, F.lit(2)))).otherwise(name)


def looks_binary(text: Column) -> Column:
    signs = F.length(text) - F.length(F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""))
    return F.contains(text, F.lit("%PDF")) | (signs > 0.02 * F.length(text))


def position_of_id(key: Column) -> Column:
    return F.split(key, "-")[1].cast("int")


def label(name: Column, degrees: Column) -> Column:
    return F.concat(name, F.lit(" — "), F.array_join(degrees, " · "))


SOURCE_LABELS = {"guia": "Guía docente", "salidas": "Salidas profesionales", "plan": "Plan de estudios"}


def source_label(origin: Column) -> Column:
    return one_of(origin, SOURCE_LABELS, origin)


def list_prefix(line: Column) -> Column:
    """The prefix a heading such as ``Grado en:`` takes out of its list, or empty."""
    return F.regexp_extract(F.btrim(line), "(?i)^[ *_#>-]*((?:doble +)?grado +en) *: *[*_]*$", 1)


def from_capital(text: Column) -> Column:
    """From the first word with a capital on."""
    return F.coalesce(F.nullif(F.regexp_extract(text, "(?:^| )([A-ZÁÉÍÓÚÑ].*)$", 1), F.lit("")), text)


def unadorned(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "[*_`]+", ""))


def redact_personal(text: Column) -> Column:
    """E-mail addresses and separate numbers of nine digits become empty, whatever stands beside them."""
    mail = F.regexp_replace(text, "(?U)[\\w.-]+@[\\w.-]+\\.\\w+", "")
    return F.regexp_replace(mail, "(?U)(?<!\\w)\\d{9}(?!\\w)", "")


def safe_name(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_-]", ""), F.lit("")), F.lit("sin_codigo"))
