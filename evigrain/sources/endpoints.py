"""Request URLs of the providers' search services; nothing is requested."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Address and parameters of each service (fixed values): a parameter takes a column's value, or the literal after "=".
SERVICES = {
    "europe-pmc": ("https://www.ebi.ac.uk/europepmc/webservices/rest/search", {"query": "query", "format": "=json", "resultType": "=core", "pageSize": "size", "cursorMark": "cursor"}),
    "pubmed": ("https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi", {"db": "=pubmed", "retmode": "=json", "term": "query", "retmax": "size", "retstart": "offset", "tool": "tool", "email": "email"}),
    "pubmed-summary": ("https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esummary.fcgi", {"db": "=pubmed", "retmode": "=json", "id": "ids", "tool": "tool", "email": "email"}),
    "crossref": ("https://api.crossref.org/works", {"query.bibliographic": "query", "rows": "size", "cursor": "cursor", "mailto": "email"}),
    "openalex": ("https://api.openalex.org/works", {"search": "query", "per-page": "size", "cursor": "cursor", "mailto": "email"}),
    "clinicaltrials-gov": ("https://clinicaltrials.gov/api/v2/studies", {"query.term": "query", "pageSize": "size", "format": "=json", "pageToken": "cursor"}),
}


def endpoint(service: str, **columns: Column) -> Column:
    """The URL of a request, form-encoded. Parameters without a column, or with a null value, are left out; OpenAlex begins at cursor ``*``."""
    base, parameters = SERVICES[service]
    if service == "openalex":
        columns["cursor"] = F.coalesce(columns.get("cursor", F.lit(None).cast("string")), F.lit("*"))
    values = {k: F.lit(v[1:]) if v.startswith("=") else columns.get(v) for k, v in parameters.items()}
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in values.items() if v is not None)))
