"""Text helpers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are neither indexed nor asked for.
STOPWORDS = (
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will "
    "would could should may might shall can not this that these those it its we our you your he she they their my his "
    "her which who what when where how if then so than more also about into up out no all each any some other new one "
    "two such only over after before between through during including without within along following across behind "
    "beyond plus except however therefore thus hence while although because since unless until whether both either "
    "neither per via etc ie eg"
).split()

#: What counts as blank where texts are trimmed: Unicode white space and the byte order mark.
BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def token_count(c: Column) -> Column:
    """A quarter of the characters, rounded up; the default counter."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int")


def pad_start(c: Column, width: int, fill: str = "0") -> Column:
    """Never shortens, unlike lpad."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, fill))


def pad_end(c: Column, width: Column) -> Column:
    return F.when(F.length(c) >= width, c).otherwise(F.concat(c, F.repeat(F.lit(" "), (width - F.length(c)).cast("int"))))


def tokens(c: Column) -> Column:
    """Lower case words of a-z, digits, underscore and inner hyphens; any other sign separates."""
    raw = F.split(F.regexp_replace(F.lower(c), r"[^\w\s-]", " "), r"\s+")
    return F.filter(F.transform(raw, lambda t: F.regexp_replace(t, "^-+|-+$", "")), lambda t: t != "")


def index_term(t: Column, min_length: int) -> Column:
    """Whether a token is indexed."""
    return (F.length(t) >= min_length) & ~t.isin(STOPWORDS) & ~t.rlike("^[0-9]+$")


def query_term(t: Column) -> Column:
    """Whether a token of a query is looked up; digits are."""
    return (F.length(t) >= 2) & ~t.isin(STOPWORDS)


def page_tag(no: Column, text: Column) -> Column:
    tag = F.concat(F.lit("<physical_index_"), no.cast("string"), F.lit(">"))
    return F.concat(tag, F.lit("\n"), text, F.lit("\n"), tag, F.lit("\n\n"))


def without_leaders(c: Column) -> Column:
    """Rows of dots of a table of contents become a colon."""
    return F.regexp_replace(F.regexp_replace(c, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def physical_index(c: Column) -> Column:
    """The number of a page tag, else null."""
    return F.regexp_extract(c, r"physical_index_(\d+)", 1).try_cast("int")


def page_number(c: Column) -> Column:
    """The leading integer of a string, else null."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")


def json_content(c: Column) -> Column:
    """What stands between the first json fence and the last fence after it; without fences, all. Trimmed."""
    begin = F.locate("```json", c)
    rest = F.substring(c, begin + 7, F.length(c))
    inside = F.when(rest.contains("```"), F.regexp_replace(rest, r"(?s)```(?!.*```).*$", "")).otherwise(rest)
    return trimmed(F.when(begin > 0, inside).otherwise(c))


def repaired_json(c: Column) -> Column:
    """Text of a model's JSON with Python constants, line breaks and trailing commas put right; null if it stays broken."""
    fixed = json_content(c)
    for word, json in (("None", "null"), ("True", "true"), ("False", "false")):
        fixed = F.regexp_replace(fixed, rf"\b{word}\b", json)
    fixed = F.regexp_replace(fixed, r"\s+", " ")
    looser = F.regexp_replace(F.regexp_replace(fixed, r",\s*\]", "]"), r",\s*\}", "}")
    ok = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(ok(fixed), fixed).when(ok(looser), looser)


def json_array(c: Column) -> Column:
    """The strings of the widest bracketed array in free text."""
    return F.from_json(F.regexp_extract(c, r"(?s)\[.*\]", 0), "array<string>")


def band(total: Column) -> Column:
    """How relevant a search score is."""
    percent = F.floor(total * 100 + 0.5)
    return F.when(percent >= 80, "High").when(percent >= 50, "Medium").otherwise("Low")


def file_type(name: Column, web: bool = False) -> Column:
    """The format by the last part of a file name, else null. web: also html, htm and txt."""
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    out = F.when(ext.isin("pdf", "docx", "csv", "xlsx", "md"), ext).when(ext.isin("xls", "ods"), "xlsx").when(ext == "markdown", "md")
    return out.when(ext.isin("html", "htm"), "html").when(ext == "txt", "txt") if web else out


def suggested_questions(name: Column) -> Column:
    """Opening questions by a document's name."""
    n = F.lower(F.coalesce(name, F.lit("")))
    has = lambda *w: F.greatest(*(n.contains(x) for x in w), F.lit(False))
    return (
        F.when(has("farmer", "crop"), F.array(*map(F.lit, ("What crops are grown in clay soil?", "Which states have high risk?", "List crops suited for sandy soil"))))
        .when(has("annual", "report", "earnings"), F.array(*map(F.lit, ("What was the revenue?", "What are the key risks?", "Summarise the highlights"))))
        .otherwise(F.array(*map(F.lit, ("What is this document about?", "List the main topics", "What are the key findings?"))))
    )
