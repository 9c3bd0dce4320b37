"""Redaction against plain Python over the same profile."""

import json
import math
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql import functions as F

from evigrain.operators import redaction as R

EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\w.-])")


def text(x):
    x = EMAIL.sub("[REDACTED]", x)
    x = re.sub(R.BEARER, "Bearer [REDACTED]", x)
    x = re.sub(R.ASSIGNED, lambda m: f"{m[1]}=[REDACTED]", x)

    def token(m):
        t = m[0]
        bits = -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))
        return "[REDACTED]" if bits >= 3.5 and any(c.isdigit() for c in t) else t

    return re.sub(r"[A-Za-z0-9_~+/.=-]{20,}", token, x)


def url(x):
    p = urlsplit(x)
    query = [(k, text(v) if k.lower() in R.SAFE_QUERY_KEYS else "[REDACTED]") for k, v in parse_qsl(p.query, keep_blank_values=True)]
    host = f"[{p.hostname}]" if ":" in (p.hostname or "") else p.hostname or ""
    try:
        port = p.port
    except ValueError:
        port = None
    return urlunsplit((p.scheme, f"{host}:{port}" if port is not None else host, "/".join(map(text, p.path.split("/"))), urlencode(query), ""))


def value(x, key=None):
    if key is not None and key.lower() in R.SENSITIVE_KEYS:
        return "[REDACTED]"
    if isinstance(x, dict):
        return {k: value(v, k) for k, v in x.items()}
    if isinstance(x, list):
        return [value(v) for v in x]
    if isinstance(x, str):
        return url(x) if x.startswith(("http://", "https://")) else text(x)
    return x


TEXTS = ["", "plain", "mail me@example.org, or é.ü@x.co.uk!", "Bearer abcdefgh12345678 x", "bearer short", "API_KEY: abc;x token=q password = p, client-secret:zz", "id 0123456789abcdefghij0123 end", "aaaaaaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz", "a.b@c", "key $1 \\ x"]
URLS = [
    "https://user:pw@Host.Example.org:8443/a/me@example.org/b?db=pubmed&term=secret&rows=5&cursor=a b%20c#frag", "http://h", "https://h/?", "https://h/p?format=me%40x.org&empty=&db=&novalue&&x=1", "https://[2001:DB8::1]:99/x", "https://h:99999/x", "https://h:/x",
    "HTTPS://H/a%20b/0123456789abcdefghij0123?ROWS=1&Api_Key=2", "https://h/?cursor=*~._-+%2B", "https://h/p?rows=a=b",
]


def test_texts_and_urls(spark):
    rows = spark.createDataFrame([(x,) for x in TEXTS + URLS + [None]], "x string")
    got = {r.x: (r.t, r.u) for r in rows.select("x", R.redact_text(F.col("x")).alias("t"), R.redact_url(F.col("x")).alias("u")).collect()}
    assert {x: got[x][0] for x in TEXTS} == {x: text(x) for x in TEXTS}
    assert {x: got[x][1] for x in URLS} == {x: url(x) for x in URLS} and got[None] == (None, None)


def test_values(spark):
    values = [
        {"token": "x", "a": {"Secret": {"deep": [1, {"b": "c"}], "d": "]}"}, "n": [1.5, None, True, "me@example.org"]}, "url": URLS[0], "z": "token\": \"x"}, [], {}, "text", 3, None, {"cookie": [], "x": 1}, {"password": None, "key": {}, "k": {"email": 1}}, ['a "quoted" {x} [y]', {"mailto": "[", "b": "]"}],
    ]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(99, "no json"), (98, None)], "i int, x string")
    got = {r.i: r.y for r in rows.select("i", R.redact_json(F.col("x")).alias("y")).collect()}
    assert {i: json.loads(got[i]) for i in range(len(values))} == {i: value(v) for i, v in enumerate(values)}
    assert got[98] is None and got[99] is None
