"""Parsers of model answers, bibliographies and author lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import SPACE, clean_content, strip


def strip_think(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>|<thought>.*?</thought>", "")


def tag_body(text: Column, tag: str) -> Column:
    """The first body of the tag, trimmed; empty if there is none."""
    return strip(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def tolerant_json(text: Column, tag: str) -> Column:
    """The JSON text in the tag, else in a fenced block, else between the outermost braces; null if there is none."""
    t = strip_think(text)
    found = F.coalesce(F.nullif(tag_body(t, tag), F.lit("")), F.nullif(strip(F.regexp_extract(t, r"(?s)```json\s*(.*?)\s*```", 1)), F.lit("")), F.nullif(strip(F.regexp_extract(t, r"(?s)\{.*\}", 0)), F.lit("")))
    return strip(F.replace(F.replace(found, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def json_record(text: Column, tag: str, schema: str) -> Column:
    """``tolerant_json`` read with a schema; null where it is no JSON."""
    body = tolerant_json(text, tag)
    return F.when(F.expr("true") & F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def query_keys(text: Column) -> Column:
    """Lines of the answer without list marks, of 3 to 100 characters."""
    inside = F.regexp_extract(text, r"(?s)<sub_queries>(.*?)</sub_queries>", 0) != ""
    body = F.when(inside, tag_body(text, "sub_queries")).otherwise(strip(F.regexp_replace(text, r"(?s)<.*?>", "")))
    lines = F.filter(F.transform(F.split(body, "\n"), strip), lambda x: x != "")
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(F.regexp_replace(x, rf"^\d+\.?{SPACE}*", ""), rf"^[-•*]{SPACE}*", "")))
    return F.filter(bare, lambda x: F.length(x).between(3, 100))


def bib_entries(text: Column) -> Column:
    """array(struct(id, title)) of a bibliography; a title may hold one level of braces."""
    pattern = r"(?is)@\w+\{([^,]+),.*?title\s*=\s*\{((?:[^{}]|\{[^{}]*\})+)\}"
    keys, titles = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(keys.alias("k"), titles.alias("t")), lambda e: F.struct(strip(e["k"]).alias("id"), strip(e["t"]).alias("title")))


def author_names(parsed: Column) -> Column:
    """[[last, first, more ...]] as ['first last more ...']; empty parts and authors go."""
    kept = F.filter(F.transform(parsed, lambda a: F.filter(F.transform(a, strip), lambda p: p != "")), lambda a: F.size(a) > 0)
    return F.transform(kept, lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))).otherwise(F.array_join(F.concat(F.array(F.get(a, F.lit(1)), F.get(a, F.lit(0))), F.slice(a, F.lit(3), F.size(a))), " ")))


def normalised_entry(title: Column, abstract: Column, authors: Column, parsed: Column, arxiv_id: Column) -> list[Column]:
    """Columns of a cleaned metadata record: parsed authors if there are any, else the text split at commas."""
    names = F.when(F.size(parsed) > 0, author_names(parsed)).otherwise(F.filter(F.transform(F.split(F.coalesce(authors, F.lit("")), ","), strip), lambda x: x != ""))
    return [clean_content(title).alias("title"), clean_content(abstract).alias("abstract"), names.alias("authors"), F.concat(F.lit("http://arxiv.org/pdf/"), arxiv_id).alias("url")]


def citation_parts(metas: Column) -> Column:
    """struct(authors, title, journal): three parts as they are, else split at the first full stops."""
    metas = F.transform(metas, lambda m: F.replace(m, F.lit("\n"), F.lit(" ")))
    whole = F.array_join(metas, " ")
    text = F.regexp_replace(whole, r"\.\s\d{4}[a-z]?\.", ".")
    a, t, j = (F.trim(F.regexp_extract(text, r"(?s)^(.*?\.\s)(.*?)(\.\s.*|$)", i)) for i in (1, 2, 3))
    three = F.size(metas) == 3
    pick = lambda i, other: F.when(three, F.get(metas, F.lit(i))).otherwise(other)
    return F.struct(pick(0, a).alias("authors"), pick(1, t).alias("title"), pick(2, F.regexp_replace(j, r"^\. ", "")).alias("journal"))


def candidate_line(paper_id: Column, score: Column, date: Column, title: Column, abstract: Column, summary: Column, browsed: Column) -> Column:
    """The line by which a selector sees a paper; browsed text goes before a summary, a summary before the abstract."""
    own = F.coalesce(F.nullif(summary, F.lit("")), abstract)
    text = F.when(F.coalesce(browsed, F.lit("")) != "", F.concat(F.lit("browser_summary="), browsed)).otherwise(F.concat(F.lit("abstract="), own))
    return F.concat(F.lit("- id="), paper_id, F.lit(" | "), F.when(score.isNotNull(), F.format_string("score=%.4f", score)).otherwise("score=N/A"), F.lit(" | year="), date, F.lit(" |title="), title, F.lit("|  "), text)


def summary_key(name: Column) -> Column:
    """A metric's name without any 'avg_'."""
    return F.replace(name, F.lit("avg_"), F.lit(""))
