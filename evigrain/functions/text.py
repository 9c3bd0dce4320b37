"""Scalar functions on bibliographic text, as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]+"
#: The prefixes of a DOI, in the order in which they are taken off.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi.org/", "doi:")
KEYED_PREFIXES = ("https://doi.org/", "http://doi.org/", "http://dx.doi.org/", "doi:")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once a row, however often f names it; a column named twice is computed twice."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def normalise_doi(x: Column) -> Column:
    """Trimmed, in lower case, without each prefix in turn (any number of times)."""
    out = ascii_lower(F.trim(x))
    for prefix in DOI_PREFIXES:
        out = F.regexp_replace(out, rf"^(?:\Q{prefix}\E)+", "")
    return F.trim(out)


def valid_doi(x: Column) -> Column:
    """Of a normalised DOI: starts with ``10.``, has a slash, no white space."""
    return x.rlike(r"^10\.[^\s]*/[^\s]*$")


def valid_pmid(x: Column) -> Column:
    return x.rlike(r"^[0-9]+$")


def normalise_trimmed(x: Column) -> Column:
    return ascii_lower(F.trim(x))


def extract_doi(x: Column) -> Column:
    """The DOI of a tagged line; only where it starts with ``10.``. Without a resolver prefix the line stays as it is."""
    trimmed = F.trim(x)
    bare = F.regexp_replace(trimmed, r" \[doi\]$", "")
    found = F.when(bare.startswith("https://doi.org/"), F.regexp_replace(bare, "^https://doi\\.org/", "")).otherwise(trimmed)
    return F.when(found.startswith("10."), found)


def keyed_doi(x: Column) -> Column:
    """The DOI key of the keyed deduplication: each prefix goes once, trailing dots and spaces too; null if nothing is left."""
    out = F.lower(F.trim(x))
    for prefix in KEYED_PREFIXES:
        out = F.regexp_replace(out, rf"^\Q{prefix}\E", "")
    return F.nullif(F.regexp_replace(out, r"[. ]+$", ""), F.lit(""))


def keyed_title(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), NOT_ALNUM, " "))


def title_tokens(x: Column) -> Column:
    """Distinct tokens for duplicate detection (ASCII lower case)."""
    return F.array_distinct(F.filter(F.split(ascii_lower(x), NOT_ALNUM), lambda t: t != ""))


def rank_tokens(x: Column) -> Column:
    """Distinct tokens for ranking: Unicode lower case, two bytes at least."""
    return F.array_distinct(F.transform(F.filter(F.split(x, NOT_ALNUM), lambda t: F.octet_length(t) >= 2), lambda t: F.lower(t)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(query: Column, text: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query, text)), F.size(query)), F.lit(0.0))


def author_key(x: Column) -> Column:
    """The family name: before the comma, else the last word; ASCII lower case."""
    family = F.when(F.contains(x, F.lit(",")), F.trim(F.split(x, ",")[0])).otherwise(F.element_at(F.split(F.trim(x), r"\s+"), -1))
    return ascii_lower(family)


def metadata_score(doi: Column, pmid: Column, abstract: Column, authors: Column, year: Column, container: Column) -> Column:
    """What a record holds, weighted; presence counts, not validity."""
    has = lambda c, w: F.when(c, w).otherwise(0)
    return has(doi.isNotNull(), 4) + has(pmid.isNotNull(), 4) + has(abstract.isNotNull(), 3) + has(F.size(authors) > 0, 2) + has(year.isNotNull(), 1) + has(container.isNotNull(), 1)


def csv_escape(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def escape_mermaid(x: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "'"), ("\r", " "), ("\n", " ")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def stable_record_id(namespace: str, native: Column) -> Column:
    return F.concat(F.lit(f"{namespace}-"), F.substring(F.sha2(native, 256), 1, 16))


def year_prefix(x: Column) -> Column:
    return F.substring(x, 1, 4).try_cast("int")


def iso_date(x: Column) -> Column:
    """Is x a calendar date YYYY-MM-DD?"""
    return F.coalesce(x.rlike(r"^\d{4}-\d{2}-\d{2}$") & x.try_cast("date").isNotNull(), F.lit(False))


def rfc3339(x: Column) -> Column:
    """Does x look like a timestamp with an offset?"""
    return F.coalesce(x.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def mapped(x: Column, table: dict[str, str], other: Column) -> Column:
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[x], other)


#: Record kinds by the type names of each format.
TAGGED_KINDS = {"jour": "journal_article", "journal article": "journal_article", "article": "journal_article", "preprint": "preprint", "conf": "conference", "conference": "conference", "thes": "thesis", "thesis": "thesis", "rprt": "report", "report": "report"}
CSL_KINDS = {"article-journal": "journal_article", "paper-conference": "conference", "thesis": "thesis", "report": "report", "dataset": "dataset"}
CSL_TYPES = {"journal_article": "article-journal", "conference": "paper-conference", "thesis": "thesis", "report": "report", "dataset": "dataset"}
RIS_TYPES = {"journal_article": "JOUR", "conference": "CONF", "thesis": "THES", "report": "RPRT", "dataset": "DATA"}


def tagged_kind(x: Column) -> Column:
    return mapped(ascii_lower(x), TAGGED_KINDS, F.coalesce(ascii_lower(x), F.lit("imported")))


def csl_type(kind: Column) -> Column:
    return mapped(kind, CSL_TYPES, F.lit("article"))


def ris_type(kind: Column) -> Column:
    return mapped(kind, RIS_TYPES, F.lit("GEN"))
