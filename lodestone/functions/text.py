"""Text cleaning and tokenising, as Column functions.

White space is Unicode white space and a word character is a letter, digit or
underscore of any script, whatever the regex dialect's own classes are.  The
patterns of tokens and cleaners, and their order, are fixed values: results
must match them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
#: Substrings that article text loses, in this order.
ARTICLE_NOISE = ["=-1", "\t", " ", "[]", "()", "mathbb", "mathcal", "bm", "mathrm", "mathit", "mathbf", "mathbfcal", "textbf", "textsc", "langle", "rangle", "mathbin"]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column) -> Column:
    """Maximal runs of word characters that consist of a to z only, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t.rlike("^[a-z]+$"))


def index_text(title: Column, abstract: Column) -> Column:
    """The text that the term index sees; its two labels are tokens of every document."""
    return F.concat(F.lit("title: "), F.coalesce(title, F.lit("")), F.lit(" abstract: "), F.coalesce(abstract, F.lit("")))


def embedding_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(title, F.lit("")), F.lit("\n abstract: "), F.coalesce(abstract, F.lit("")))


def letters_key(text: Column) -> Column:
    """Letters only, lower-cased: joins titles across sources."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}]", ""))


def clean_content(text: Column) -> Column:
    """Line breaks at hyphens close up, other white space becomes one space; null becomes empty."""
    t = F.coalesce(text, F.lit(""))
    for pattern, to in ((rf"-\n{SPACE}*", "-"), (rf"\n{SPACE}*-", "-"), (r"\n+", " "), (f"{SPACE}+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return strip(t)


def clean_common(text: Column) -> Column:
    """One space for white space, no braces, no LaTeX commands, words joined over a hyphen and white space."""
    t = F.coalesce(text, F.lit(""))
    for pattern, to in ((f"{SPACE}+", " "), (r"[{}]", ""), (r"\\[a-zA-Z]+", ""), (rf"({WORD})-{SPACE}+({WORD})", "$1$2")):
        t = F.regexp_replace(t, pattern, to)
    return strip(t)


def clean_title(title: Column) -> Column:
    """For title search: no leading year, no trailing punctuation, plain symbols only."""
    t = clean_common(title)
    for pattern, to in ((rf"^\p{{Nd}}{{4}}[a-zA-Z]?\.{SPACE}*", ""), (r"[.,:;]+$", ""), (r"[^\p{L}\p{N}_\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}\-:().,?!]", " "), (f"{SPACE}+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return strip(t)


def clean_filename(name: Column, length: int = 200) -> Column:
    return F.substring(strip(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', ""), f"{SPACE}+", " ")), 1, length)


def paper_filename(arxiv_id: Column, title: Column, extension: str = "pdf") -> Column:
    return F.concat(F.lit("[arXiv-"), arxiv_id, F.lit("]"), clean_filename(title), F.lit("." + extension))


def citation_filename(stem: Column) -> Column:
    return F.concat(F.lit("cited_"), stem, F.lit(".json"))


def clean_article(text: Column) -> Column:
    """Article text without markup remains; a full stop is followed by a space unless by a digit."""
    t = text
    for noise in ARTICLE_NOISE:
        t = F.replace(t, F.lit(noise), F.lit(""))
    for pattern, to in ((" +", " "), (r"[\[\],]+", ""), (r"\.(?!\d)", ". "), ("bib. bib", "bib.bib")):
        t = F.regexp_replace(t, pattern, to)
    return t
