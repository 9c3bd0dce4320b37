"""Reading bibliographic formats into records: JSON lines, CSL, RIS, NBIB, and provider pages.

Each reader takes a DataFrame of payloads, so files, tables and streams work alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

FIELDS = ("record_id", "native_id", "kind", "title", "abstract", "authors", "container", "year", "doi", "pmid", "subjects", "languages", "urls")
UNTITLED = "Untitled imported record"


def tag_values(pairs: Column, tags: list[str]) -> Column:
    """All values of the tags, tag by tag."""

    def of(tag: str) -> Column:
        return F.transform(F.filter(pairs, lambda p: p["tag"] == tag), lambda p: p["value"])

    return F.flatten(F.array(*map(of, tags)))


def tag_first(pairs: Column, tags: list[str]) -> Column:
    return F.get(tag_values(pairs, tags), F.lit(0))


def tagged(files: DataFrame, key: str, text: str, fmt: str) -> DataFrame:
    """Records of RIS or NBIB texts: (key, block, then FIELDS).

    A blank line ends a block that has a tag; in RIS a line that starts with ``ER  -`` ends
    any block, even an empty one. Lines without the separator are passed over.
    """
    sep, namespace = ("  - ", "ris") if fmt == "ris" else ("- ", "nbib")
    # one mark after each end line, then cut at marks and blank lines
    body = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    if fmt == "ris":
        body = F.regexp_replace(body, r"(?m)^(ER  -.*)$", "$1\n\u0001")
    lines = F.split(body, "\n")
    rows = files.select(F.col(key).alias("key"), F.posexplode(lines).alias("i", "line"))
    at = F.instr("line", sep)
    rows = rows.select("key", "i", F.trim(F.expr(f"substring(line, 1, instr(line, '{sep}') - 1)")).alias("tag"), F.trim(F.expr(f"substring(line, instr(line, '{sep}') + {len(sep)})")).alias("value"), (at > 0).alias("tagged"), (F.trim("line") == "").alias("blank"), (F.col("line") == "\u0001").alias("mark"))
    lines = W.partitionBy("key").orderBy("i")
    ends = F.sum((F.col("blank") | F.col("mark")).cast("int")).over(lines.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("part", F.coalesce(ends, F.lit(0)))
    pair = F.when(F.col("tagged"), F.struct("i", "tag", "value"))
    file = rows.groupBy("key", "part").agg(F.array_sort(F.collect_list(pair)).alias("p"), F.max("mark").alias("mark")).where("mark OR size(p) > 0")
    file = file.select("key", (F.row_number().over(W.partitionBy("key").orderBy("part")) - 1).alias("block"), "p")
    p = F.col("p")
    native = F.coalesce(tag_first(p, ["ID", "AN", "PMID"]), F.concat(F.lit("tagged-"), (F.col("block") + 1).cast("string")))
    pmid = tag_first(p, ["PMID", "AN"])
    return file.select(
        F.col("key").alias(key), "block", T.stable_record_id(namespace, native).alias("record_id"), native.alias("native_id"), T.tagged_kind(tag_first(p, ["TY", "PT"])).alias("kind"),
        F.coalesce(tag_first(p, ["TI", "T1", "BT"]), F.lit(UNTITLED)).alias("title"), tag_first(p, ["AB", "N2"]).alias("abstract"), tag_values(p, ["AU", "A1", "FAU"]).alias("authors"),
        tag_first(p, ["JO", "JF", "JT", "T2"]).alias("container"), T.year_prefix(tag_first(p, ["PY", "DP"])).alias("year"), T.extract_doi(tag_first(p, ["DO", "LID"])).alias("doi"),
        F.when(pmid.rlike("^[0-9]*$"), pmid).alias("pmid"), tag_values(p, ["KW", "MH"]).alias("subjects"), tag_values(p, ["LA"]).alias("languages"), tag_values(p, ["UR", "L2"]).alias("urls"),
    )


CSL_SCHEMA = "array<struct<id:string,type:string,title:string,abstract:string,author:array<struct<family:string,given:string>>,`container-title`:string,issued:struct<`date-parts`:array<array<int>>>,DOI:string,ISBN:string,language:string,URL:string>>"


def csl(files: DataFrame, key: str, text: str) -> DataFrame:
    """Records of CSL-JSON arrays."""
    x = files.select(F.col(key), F.posexplode(F.from_json(text, CSL_SCHEMA)).alias("block", "x"))
    native = F.coalesce("x.id", F.concat(F.lit("csl-"), (F.col("block") + 1).cast("string")))
    name = lambda a: F.trim(F.regexp_replace(F.concat(F.coalesce(a["family"], F.lit("")), F.lit(", "), F.coalesce(a["given"], F.lit(""))), "^[, ]+|[, ]+$", ""))
    authors = F.filter(F.transform(F.coalesce("x.author", F.expr("cast(array() as array<struct<family:string,given:string>>)")), name), lambda a: a != "")
    one = lambda c: F.array_compact(F.array(c))
    return x.select(
        key, "block", T.stable_record_id("csl", native).alias("record_id"), native.alias("native_id"), T.mapped(F.col("x.type"), T.CSL_KINDS, F.coalesce("x.type", F.lit("csl"))).alias("kind"), F.coalesce("x.title", F.lit(UNTITLED)).alias("title"),
        F.col("x.abstract").alias("abstract"), authors.alias("authors"), F.col("x.container-title").alias("container"), F.get(F.get(F.col("x.issued.date-parts"), F.lit(0)), F.lit(0)).alias("year"), F.col("x.DOI").alias("doi"),
        F.lit(None).cast("string").alias("pmid"), F.expr("cast(array() as array<string>)").alias("subjects"), one("x.language").alias("languages"), one("x.URL").alias("urls"),
    )


def json_lines(files: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    """(key, line, record, error): one row for each line that is not blank; error where it isn't an object of the schema."""
    x = files.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw")).where(F.trim("raw") != "")
    parsed = F.from_json("raw", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return x.select(key, (F.col("line") + 1).alias("line"), parsed.alias("record")).withColumn("error", F.col("record._corrupt_record").isNotNull())


OPENALEX_SCHEMA = "struct<meta:struct<count:bigint,next_cursor:string>,results:array<struct<id:string,doi:string,display_name:string,publication_year:int,publication_date:string,type:string,language:string,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<landing_page_url:string,source:struct<display_name:string>>,topics:array<struct<display_name:string>>>>>"


def openalex(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Records of works pages. record_id is the work's own id, so pages don't collide."""
    x = pages.select(F.col(key), F.posexplode(F.from_json(payload, OPENALEX_SCHEMA)["results"]).alias("block", "x"))
    native = F.coalesce("x.id", F.concat(F.lit("openalex-"), F.col("block").cast("string")))
    names = lambda c, f: F.coalesce(F.array_compact(F.transform(c, f)), F.expr("cast(array() as array<string>)"))
    one = lambda c: F.array_compact(F.array(c))
    return x.select(
        key, "block", F.concat(F.lit("openalex-"), native).alias("record_id"), native.alias("native_id"), F.coalesce("x.type", F.lit("openalex")).alias("kind"), F.coalesce("x.display_name", F.lit("[untitled]")).alias("title"),
        F.lit(None).cast("string").alias("abstract"), names("x.authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("x.primary_location.source.display_name").alias("container"), F.col("x.publication_year").alias("year"),
        F.regexp_replace("x.doi", "^(https://doi\\.org/)+", "").alias("doi"), F.lit(None).cast("string").alias("pmid"), names("x.topics", lambda t: t["display_name"]).alias("subjects"), one("x.language").alias("languages"), one("x.primary_location.landing_page_url").alias("urls"),
    )


CROSSREF_SCHEMA = "struct<message:struct<`next-cursor`:string,`total-results`:bigint,items:array<struct<DOI:string,type:string,title:array<string>,abstract:string,author:array<struct<family:string,given:string,name:string>>,`container-title`:array<string>,language:string,subject:array<string>,URL:string,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,issued:struct<`date-parts`:array<array<int>>>,created:struct<`date-parts`:array<array<int>>>>>>>"


def crossref(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Records of works pages; the year is that of print, online, issue or creation, the first there is."""
    x = pages.select(F.col(key), F.posexplode(F.from_json(payload, CROSSREF_SCHEMA)["message"]["items"]).alias("block", "x"))
    native = F.coalesce("x.DOI", F.concat(F.lit("crossref-"), F.col("block").cast("string")))
    year = F.coalesce(*(F.get(F.get(F.col(f"x.{c}.date-parts"), F.lit(0)), F.lit(0)) for c in ("published-print", "published-online", "issued", "created")))
    none = F.expr("cast(array() as array<string>)")
    authors = F.transform("x.author", lambda a: F.coalesce(F.nullif(F.concat_ws(", ", a["family"], a["given"]), F.lit("")), a["name"]))
    one = lambda c: F.array_compact(F.array(c))
    return x.select(
        key, "block", F.concat(F.lit("crossref-"), native).alias("record_id"), native.alias("native_id"), F.when(F.col("x.type") == "journal-article", "journal_article").otherwise(F.coalesce("x.type", F.lit("crossref"))).alias("kind"),
        F.coalesce(F.get("x.title", F.lit(0)), F.lit("[untitled]")).alias("title"), F.col("x.abstract").alias("abstract"), F.coalesce(F.array_compact(authors), none).alias("authors"), F.get("x.container-title", F.lit(0)).alias("container"),
        year.alias("year"), F.col("x.DOI").alias("doi"), F.lit(None).cast("string").alias("pmid"), F.coalesce("x.subject", none).alias("subjects"), one("x.language").alias("languages"), one("x.URL").alias("urls"),
    )


def pubmed(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Records of summary pages, in the order of their uids; a uid without an item is passed over."""
    item = "struct<title:string,fulljournalname:string,pubdate:string,sortpubdate:string,authors:array<struct<name:string>>,articleids:array<struct<idtype:string,value:string>>>"
    result = F.get_json_object(payload, "$.result")
    x = pages.select(F.col(key), F.posexplode(F.from_json(F.get_json_object(result, "$.uids"), "array<string>")).alias("block", "uid"), F.from_json(result, "map<string,string>").alias("items"))
    x = x.select(key, "block", "uid", F.from_json(F.col("items")[F.col("uid")], item).alias("x")).where("x IS NOT NULL")
    doi = F.get(F.transform(F.filter("x.articleids", lambda i: i["idtype"] == "doi"), lambda i: i["value"]), F.lit(0))
    none = F.expr("cast(array() as array<string>)")
    return x.select(
        key, "block", F.concat(F.lit("pubmed-"), F.col("uid")).alias("record_id"), F.col("uid").alias("native_id"), F.lit("journal_article").alias("kind"), F.coalesce("x.title", F.lit("[untitled]")).alias("title"), F.lit(None).cast("string").alias("abstract"),
        F.coalesce(F.transform("x.authors", lambda a: a["name"]), none).alias("authors"), F.col("x.fulljournalname").alias("container"), T.year_prefix(F.col("x.pubdate")).alias("year"), doi.alias("doi"), F.col("uid").alias("pmid"),
        none.alias("subjects"), none.alias("languages"), F.array(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("uid"), F.lit("/"))).alias("urls"),
    )


def bounded(pages: DataFrame, provider: str, page_no: str, records: str, max_pages: int, max_records: int) -> DataFrame:
    """Rows of ``pages`` within the budgets: page numbers up to max_pages, running record totals up to max_records before the page."""
    before = F.coalesce(F.sum(records).over(W.partitionBy(provider).orderBy(page_no).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    got = pages.withColumn("before", before).where((F.col(page_no) <= max_pages) & (F.col("before") < max_records))
    return got.withColumn("taken", F.least(F.col(records), F.lit(max_records) - F.col("before"))).drop("before")


EUROPEPMC_SCHEMA = "array<struct<id:string,doi:string,pmid:string,pmcid:string,title:string,abstractText:string,authorString:string,journalTitle:string,pubYear:string>>"


def europepmc(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Records of result pages, named by their own id, or by their place where there is none; a page without the list gives no record (see ``envelope``).

    The author string is one author. A year that isn't an integer is null.
    """
    x = pages.select(F.col(key), F.posexplode(F.from_json(F.get_json_object(payload, "$.resultList.result"), EUROPEPMC_SCHEMA)).alias("block", "x"))
    none = F.expr("cast(array() as array<string>)")
    year = F.when(F.col("x.pubYear").rlike("^[+-]?[0-9]+$"), F.col("x.pubYear").try_cast("int"))
    return x.select(
        key, "block", F.coalesce("x.id", F.concat(F.lit("europe-pmc-"), F.col("block").cast("string"))).alias("record_id"), F.coalesce("x.id", F.lit("")).alias("native_id"), F.lit("journal_article").alias("kind"),
        F.coalesce("x.title", F.lit("[untitled]")).alias("title"), F.col("x.abstractText").alias("abstract"), F.array_compact(F.array("x.authorString")).alias("authors"), F.col("x.journalTitle").alias("container"), year.alias("year"),
        F.col("x.doi").alias("doi"), F.col("x.pmid").alias("pmid"), F.col("x.pmcid").alias("pmcid"), none.alias("subjects"), none.alias("languages"), none.alias("urls"),
    )


_NAMES = "nctId:string,briefTitle:string,officialTitle:string"
_MODULES = f"identificationModule:struct<{_NAMES}>,conditionsModule:struct<conditions:array<string>>,descriptionModule:struct<briefSummary:string>,statusModule:struct<startDateStruct:struct<date:string>>,{_NAMES}"
CTGOV_SCHEMA = f"array<struct<protocolSection:struct<{_MODULES}>,{_MODULES}>>"


def ctgov(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Records of trial registry pages; modules may lie in a protocol section or directly in the study, names in their module or beside it."""
    x = pages.select(F.col(key), F.posexplode(F.from_json(F.get_json_object(payload, "$.studies"), CTGOV_SCHEMA)).alias("block", "x"))

    def of(path):
        return F.when(F.col("x.protocolSection").isNotNull(), F.col(f"x.protocolSection.{path}")).otherwise(F.col(f"x.{path}"))

    def named(c):
        return F.when(of("identificationModule").isNotNull(), of(f"identificationModule.{c}")).otherwise(of(c))

    native = F.coalesce(named("nctId"), F.concat(F.lit("trial-"), F.col("block").cast("string")))
    none = F.expr("cast(array() as array<string>)")
    return x.select(
        key, "block", F.concat(F.lit("clinicaltrials-"), native).alias("record_id"), native.alias("native_id"), F.lit("trial_registry").alias("kind"), F.coalesce(named("briefTitle"), named("officialTitle"), F.lit("[untitled trial]")).alias("title"),
        of("descriptionModule.briefSummary").alias("abstract"), none.alias("authors"), F.lit("ClinicalTrials.gov").alias("container"), F.lit(None).cast("int").alias("year"), of("statusModule.startDateStruct.date").alias("date"),
        named("nctId").alias("trial"), F.coalesce(F.array_compact(of("conditionsModule.conditions")), none).alias("subjects"), none.alias("languages"), F.array(F.concat(F.lit("https://clinicaltrials.gov/study/"), native)).alias("urls"),
    )


#: Where each provider's pages hold the list of records, the next cursor and the total (fixed values).
ENVELOPES = {"europe-pmc": ("$.resultList.result", "$.nextCursorMark", "$.hitCount"), "clinicaltrials-gov": ("$.studies", "$.nextPageToken", "$.totalCount")}


def envelope(pages: DataFrame, key: str, payload: str, provider: str) -> DataFrame:
    """(key, next_cursor, total_available, error): error where the page holds no list of records."""
    found, cursor, total = (F.get_json_object(payload, p) for p in ENVELOPES[provider])
    bad = F.coalesce(~F.startswith(found, F.lit("[")), F.lit(True))
    return pages.select(key, cursor.alias("next_cursor"), total.try_cast("long").alias("total_available"), F.when(bad, F.lit("response omitted the list of records")).alias("error"))
