"""Redaction of receipts by a profile: texts, URLs, and JSON values at any depth, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .audit import entropy
from .events import canonical_json

#: Patterns of addresses and secrets, and the keys of the default profile.
EMAIL = r"(?U)(?<![\w.+-])[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\w.-])"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}"
ASSIGNED = r"(?i)\b(api[_-]?key|token|password|secret|client[_-]?secret)\s*[:=]\s*([^\s,;]+)"
TOKEN = "[A-Za-z0-9_~+/.=-]"
SAFE_QUERY_KEYS = ("db", "retmode", "format", "resulttype", "pagesize", "rows", "retmax", "retstart", "cursor")
SENSITIVE_KEYS = ("access_token", "api_key", "apikey", "authorization", "client_secret", "cookie", "email", "key", "mailto", "password", "proxy-authorization", "secret", "set-cookie", "signature", "token", "x-api-key")


@dataclass(frozen=True)
class Profile:
    replacement: str = "[REDACTED]"
    emails: bool = True
    bearer: bool = True
    high_entropy: bool = True
    shortest: int = 20
    safe_query: tuple[str, ...] = SAFE_QUERY_KEYS
    sensitive: tuple[str, ...] = SENSITIVE_KEYS


def literal(x: str) -> str:
    """A text as a replacement of regexp_replace."""
    return x.replace("\\", "\\\\").replace("$", "\\$")


def redact_text(x: Column, profile: Profile = Profile()) -> Column:
    """x without e-mail addresses, bearer tokens, values assigned to secret-looking names, and long tokens of high entropy with a digit."""
    to = literal(profile.replacement)
    if profile.emails:
        x = F.regexp_replace(x, EMAIL, to)
    if profile.bearer:
        x = F.regexp_replace(x, BEARER, f"Bearer {to}")
    x = F.regexp_replace(x, ASSIGNED, f"$1={to}")
    if profile.high_entropy:
        # cut before and after each run of token characters; nothing is lost between the pieces
        n = max(profile.shortest, 20)
        pieces = F.split(x, f"(?<!{TOKEN})(?={TOKEN}{{{n}}})|(?<={TOKEN}{{{n}}})(?!{TOKEN})", -1)
        secret = lambda p: p.rlike(rf"\A{TOKEN}{{{n},}}\z") & p.rlike("[0-9]") & (entropy(p) >= 3.5 - 1e-9)
        kept = F.transform(pieces, lambda p: F.when(secret(p), F.lit(profile.replacement)).otherwise(p))
        x = F.when(x.rlike(f"{TOKEN}{{{n}}}"), F.array_join(kept, "")).otherwise(x)
    return x


def quoted(x: Column) -> Column:
    """x as a form field."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def redact_url(x: Column, profile: Profile = Profile()) -> Column:
    """A URL without user, password and fragment; of its query only safe keys keep their values, redacted as texts, as are the segments of its path."""
    part = lambda i: F.regexp_extract(x, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:.*))?$", i)
    scheme, authority, path, query = F.lower(part(1)), part(2), part(3), part(4)
    place = F.regexp_replace(authority, "^.*@", "")
    host = F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:]*):([0-9]{1,5})$", 1)
    number = F.when((port != "") & (port.try_cast("int") <= 65535), F.concat(F.lit(":"), port.try_cast("int").cast("string"))).otherwise("")
    safe = [k.lower() for k in profile.safe_query if k.lower() not in {s.lower() for s in profile.sensitive}]

    def field(pair: Column) -> Column:
        key, raw = (F.try_url_decode(F.coalesce(F.get(F.split(pair, "=", 2), F.lit(i)), F.lit(""))) for i in (0, 1))
        value = F.when(F.lower(key).isin(*safe), redact_text(raw, profile)).otherwise(profile.replacement)
        return F.concat(quoted(key), F.lit("="), quoted(F.coalesce(value, F.lit(profile.replacement))))

    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), field)
    tail = F.array_join(pairs, "&")
    shown = F.array_join(F.transform(F.split(path, "/", -1), lambda s: redact_text(s, profile)), "/")
    return F.concat(F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))), F.when(authority == "", "").otherwise(F.concat(F.lit("//"), host, number)), shown, F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)))


STATE = "struct<out:array<string>,skip:int,hide:boolean>"


def redact_json(x: Column, profile: Profile = Profile()) -> Column:
    """A JSON text, in canonical form, with the values of sensitive keys replaced whole, URLs redacted as such and other strings as texts; null where x is none.

    One pass over the tokens: what opens under a sensitive key is skipped to its end.
    """
    json = canonical_json(x)
    tokens = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*":?|[{}\[\],]|[^"{}\[\],]+'), F.lit(0))
    text = lambda t: F.element_at(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), 1)
    as_json = lambda v: F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)
    hidden = as_json(F.lit(profile.replacement))
    names = [k.lower() for k in profile.sensitive]

    def step(s: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        key = t.startswith('"') & t.endswith('":')
        value = text(t)
        string = F.when(value.rlike("^https?://"), redact_url(value, profile)).otherwise(redact_text(value, profile))
        emit = F.when(s["skip"] > 0, F.lit(None)).when(s["hide"], hidden).when(key, t).when(t.startswith('"'), as_json(string)).otherwise(t)
        skip = F.when(s["skip"] > 0, s["skip"] + F.when(opens, 1).when(closes, -1).otherwise(0)).when(s["hide"] & opens, 1).otherwise(0)
        name = F.lower(text(t.substr(F.lit(1), F.length(t) - 1)))
        hide = (s["skip"] == 0) & key & name.isin(*names)
        return F.struct(F.when(emit.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(emit))).alias("out"), skip.cast("int").alias("skip"), F.coalesce(hide, F.lit(False)).alias("hide"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"), F.lit(False).alias("hide")).cast(STATE)
    return F.aggregate(tokens, start, lambda s, t: step(s, t).cast(STATE), lambda s: F.array_join(s["out"], ""))
