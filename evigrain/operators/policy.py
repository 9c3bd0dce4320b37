"""Policy decisions and validators: one row in, violation or blocker codes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def codes(*rules: tuple[str, Column]) -> Column:
    """The codes of the conditions that hold, in order; a null condition does not hold."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in rules)))


#: Markers of untrusted text and the category of each.
MARKERS = (
    ("instruction_like", "ignore previous instructions"),
    ("instruction_like", "system prompt"),
    ("secret_request", "api key"),
    ("active_markup", "<script"),
    ("active_markup", "javascript:"),
    ("tool_invocation", "call_tool"),
)


def inspect(rows: DataFrame, subject: str, text: str, markers=MARKERS) -> DataFrame:
    """(finding_id, subject_id, category, marker) for each marker that a text holds (ASCII lower case)."""
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("category"), F.lit(m).alias("marker")) for i, (c, m) in enumerate(markers)))
    lower = T.ascii_lower(F.col(text))
    found = rows.select(F.col(subject).alias("subject_id"), F.explode(F.filter(table, lambda m: F.contains(lower, m["marker"]))).alias("m"))
    return found.select(F.concat(F.lit("content-"), F.col("subject_id").cast("string"), F.lit("-"), F.col("m.i").cast("string")).alias("finding_id"), "subject_id", "m.category", "m.marker")


def record_violations(records: DataFrame) -> DataFrame:
    """(record_id, codes) of each record."""
    blank = lambda c: F.trim(F.col(c)) == ""
    got = codes(
        ("record_id.empty", blank("record_id")), ("title.empty", blank("title")), ("year.range", ~F.col("year").between(-10000, 30000)),
        ("authors.blank", F.exists("authors", lambda a: F.trim(a) == "")), ("doi.invalid", ~T.valid_doi(T.normalise_doi(F.col("doi")))), ("container.empty", blank("container")),
    )
    return records.select("record_id", F.array_join(got, ",").alias("codes"))


def evaluate_handling(requests: DataFrame, policy: dict) -> DataFrame:
    """(request_id, permitted, blockers, warnings, human_approval_required) of data-handling requests under one policy."""
    c = F.col
    sensitive = c("classification").isin("confidential", "restricted_full_text", "sensitive_personal_data")
    regions = policy.get("permitted_regions", [])
    blockers = codes(
        ("governance.deployment_mode.denied", ~c("deployment_mode").isin(*policy["deployment_modes"])),
        ("governance.classification.denied", ~c("classification").isin(*policy["classifications"])),
        ("governance.retention.exceeds_policy", c("retention_days") > policy["maximum_retention_days"]),
        ("governance.telemetry.denied", (c("operation") == "telemetry") & F.lit(not policy.get("telemetry"))),
        ("governance.full_text_persistence.denied", (c("operation") == "full_text_persistence") & F.lit(not policy.get("full_text"))),
        ("governance.external_model.denied", (c("operation") == "external_model_processing") & F.lit(not policy.get("external_model"))),
        ("governance.cross_border_transfer.denied", c("cross_border") & F.lit(not policy.get("cross_border"))),
        ("governance.human_approval.not_recorded", sensitive & ~c("dry_run")),
        ("governance.multi_tenant.isolation_unproven", (c("deployment_mode") == "hosted_multi_tenant") & (c("classification") != "public_metadata")),
        ("governance.export.approval_not_recorded", (c("operation") == "export") & (c("classification") != "public_metadata") & ~c("dry_run")),
        ("governance.region.denied", c("region").isNotNull() & ~c("region").isin(*regions) & F.lit(bool(regions))),
        ("governance.region.required", c("region").isNull() & F.lit(bool(regions))),
    )
    warnings = codes(("governance.sensitive_data.manual_review", c("classification") == "sensitive_personal_data"), ("governance.dry_run.no_effects", c("dry_run")))
    got = requests.select("request_id", blockers.alias("b"), warnings.alias("w"), sensitive.alias("s"))
    return got.select("request_id", (F.size("b") == 0).alias("permitted"), F.array_join("b", ",").alias("blockers"), F.array_join("w", ",").alias("warnings"), ((F.size("b") > 0) | F.col("s")).alias("human_approval_required"))


def authorise_endpoint(rows: DataFrame, url: str, allowed: list[str]) -> DataFrame:
    """rows with permitted and reason: https only, host in the list."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    reason = F.when(scheme != "https", "scheme_not_https").when(~host.isin(*allowed), "host_not_allowlisted")
    return rows.withColumn("reason", reason).withColumn("permitted", F.isnull("reason"))


def private_ipv4(ip: Column) -> Column:
    """Is a dotted IPv4 address private, loopback, link-local, multicast, shared, documentation or reserved?"""

    def inside(n):
        out = F.lit(False)
        for net, bits in PRIVATE_NETS:
            a, b, c, d = map(int, net.split("."))
            lo = (a << 24) + (b << 16) + (c << 8) + d
            out = out | n.between(lo, lo + (1 << (32 - bits)) - 1)
        return out

    number = lambda part: sum((part[i].cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), part[0].cast("long") * (1 << 24))
    return T.let(F.split(ip, r"\."), lambda part: T.let(number(part), inside))


#: IPv4 networks no request may go to.
PRIVATE_NETS = (
    ("0.0.0.0", 32), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


#: IPv6 networks no request may go to: itself, unspecified, multicast, unique local, link-local, documentation.
PRIVATE_NETS_6 = (("::1", 128), ("::", 128), ("ff00::", 8), ("fc00::", 7), ("fe80::", 10), ("2001:db8::", 32))


def address_bytes(ip: Column) -> Column:
    """The 16 bytes of an IPv4 or IPv6 address, IPv4 as ::ffff:a.b.c.d; null for anything else.

    Each step names the one before it several times, so each is worked out once by ``let``: written out in full, the steps
    would multiply to thousands of regular expressions a row.
    """
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    dotted = rf"{octet}\.{octet}\.{octet}\.{octet}$"
    none = F.array().cast("array<string>")

    def words(x, tail):
        pair = lambda o, i: F.lpad(F.lower(F.hex(o[i].try_cast("int") * 256 + o[i + 1].try_cast("int"))), 4, "0")
        hexed = T.let(F.split(tail, r"\."), lambda o: F.concat(F.regexp_replace(x, dotted, ""), pair(o, 0), F.lit(":"), pair(o, 2)))
        return F.concat(F.when(x.rlike("^" + dotted), "::ffff:").otherwise(""), F.when(tail != "", hexed).otherwise(x))

    def whole(halves, left, right):
        n = F.size(left) + F.size(right)
        fill = F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0)))
        return F.when((F.size(halves) == 2) & (n < 8), F.concat(left, fill, right)).when((F.size(halves) == 1) & (n == 8), left)

    def sides(halves):
        side = lambda i: F.when(F.coalesce(F.get(halves, F.lit(i)), F.lit("")) == "", none).otherwise(F.split(F.get(halves, F.lit(i)), ":", -1))
        return T.let(side(0), lambda left: T.let(side(1), lambda right: whole(halves, left, right)))

    def packed(w):
        good = F.coalesce(F.forall(w, lambda x: x.rlike(r"^[0-9a-f]{1,4}$")), F.lit(False))
        return F.when(good, F.unhex(F.array_join(F.transform(w, lambda x: F.lpad(x, 4, "0")), "")))

    tail = lambda x: F.regexp_extract(x, rf"(?:^|:)({octet}(?:\.{octet}){{3}})$", 1)
    full = T.let(F.lower(ip), lambda x: T.let(tail(x), lambda t: words(x, t)))
    return T.let(T.let(T.let(full, lambda w: F.split(w, "::", -1)), sides), packed)


def prohibited_address(ip: Column) -> Column:
    """May no request go to this address, of either family? IPv4 addresses inside IPv6 ones count as IPv4; null if it is none."""
    import ipaddress

    nets = [ipaddress.ip_network(f"::ffff:{net}/{bits + 96}") for net, bits in PRIVATE_NETS] + [ipaddress.ip_network(f"{net}/{bits}") for net, bits in PRIVATE_NETS_6]

    def inside(at):
        out = F.lit(False)
        for net in nets:
            out = out | at.between(F.lit(net[0].packed), F.lit(net[-1].packed))
        return F.when(at.isNotNull(), out)

    return T.let(address_bytes(ip), inside)


def retry_delay(attempt: Column, base_ms: int, max_ms: int) -> Column:
    return F.least(F.lit(base_ms) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(max_ms))).cast("long")


def transitions(rows: DataFrame, entity: str, order: str, state: str, edges: list[tuple[str, str]]) -> DataFrame:
    """(entity, steps, broken): how many changes of state are not among the edges."""
    from pyspark.sql import Window as W

    before = F.lag(state).over(W.partitionBy(entity).orderBy(order))
    known = F.array(*(F.lit(f"{a}>{b}") for a, b in edges))
    step = rows.select(entity, F.concat_ws(">", before, F.col(state)).alias("step"), before.isNotNull().alias("moved"), (before != F.col(state)).alias("changed"))
    return step.groupBy(entity).agg(F.count_if("moved").alias("steps"), F.count_if(F.col("changed") & ~F.array_contains(known, F.col("step"))).alias("broken"))


#: Material that must not leave in a bundle (fixed values): names of files, and patterns over bytes.
SECRET_FILES = (".env", ".env.local", "id_rsa", "id_ed25519", "credentials", "credentials.json", "service-account.json")
SECRETS = {
    "private_key": "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "credential": r"""(?i)\b(?:password|passwd|api[_-]?key|client[_-]?secret)\s*[:=]\s*['"]?[^\s'"]{8,}""",
}


def scan_secrets(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, finding): files with a prohibited name, and each kind of secret that a file's bytes hold."""
    data = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")  # a character a byte
    named = F.lower(F.substring_index(path, "/", -1)).isin(*SECRET_FILES)
    found = F.array_compact(F.array(F.when(named, "filename"), *(F.when(data.rlike(p), name) for name, p in SECRETS.items())))
    return files.select(path, F.explode(found).alias("finding"))


def verify_approvals(claims: DataFrame, registry: DataFrame, fields: list[str], now: str) -> DataFrame:
    """claims with ``verified``: the registry holds the same record, null for null, and ``now`` (a column of claims) lies in [approved_at, expires_at).

    approval_id is unique in the registry; both have the columns in ``fields``.
    """
    held = registry.select("approval_id", F.struct(*fields).alias("held"), "approved_at", "expires_at")
    got = claims.join(held, "approval_id", "left")
    ok = F.struct(*fields).eqNullSafe(F.col("held")) & (F.col(now) >= F.col("approved_at")) & (F.col(now) < F.col("expires_at"))
    return got.withColumn("verified", F.coalesce(ok, F.lit(False))).drop("held", "approved_at", "expires_at")


def evaluate_lifecycle(requests: DataFrame, policy: dict) -> DataFrame:
    """(request_id, permitted, effects_authorized, blockers, warnings, receipt_required): may data be retained, exported or deleted.

    The approval's columns (approval_id, approval_review, approval_action, approval_digest, approval_policy, verified) are
    null without one; verified is that of ``verify_approvals``. The codes are fixed values.
    """
    c, act = F.col, lambda a: F.col("action") == a
    given, apply = c("approval_id").isNotNull(), c("execution_mode") == "apply"
    differs = lambda a, b: apply & given & ~F.coalesce(a == b, F.lit(False))
    rules = {
        "lifecycle.classification.denied": ~c("classification").isin(policy["classifications"]),
        "lifecycle.retention.exceeds_policy": act("retain") & (F.coalesce("retention_days", F.lit(0)) > policy["maximum_retention_days"]),
        "lifecycle.delete.immutable_audit_denied": act("delete") & c("includes_audit_log"),
        "lifecycle.delete.legal_hold": act("delete") & c("legal_hold"),
        "lifecycle.apply.approval_required": apply & ~given,
        "lifecycle.apply.approval_review_mismatch": differs(c("approval_review"), c("review_id")),
        "lifecycle.apply.approval_action_mismatch": differs(c("approval_action"), c("action")),
        "lifecycle.apply.approval_digest_mismatch": differs(c("approval_digest"), c("digest")),
        "lifecycle.apply.approval_policy_mismatch": differs(c("approval_policy"), F.lit(policy["policy_id"])),
        "lifecycle.apply.approval_verification_failed": apply & given & ~F.coalesce("verified", F.lit(False)),
    }
    notes = {"lifecycle.preview.no_effects": ~apply, "lifecycle.export.destination_review_required": act("export"), "lifecycle.delete.tombstones_required": act("delete")}
    codes = lambda d: F.array_join(F.array_compact(F.array(*(F.when(v, k) for k, v in d.items()))), ",")
    got = requests.select("request_id", codes(rules).alias("blockers"), codes(notes).alias("warnings"), apply.alias("receipt_required"))
    permitted = c("blockers") == ""
    return got.select("request_id", permitted.alias("permitted"), (permitted & c("receipt_required")).alias("effects_authorized"), "blockers", "warnings", "receipt_required")


def leaked_keys(rows: DataFrame, key: str, payload: str, forbidden: tuple[str, ...]) -> DataFrame:
    """(key): rows whose JSON has one of the forbidden keys at any depth; text inside strings doesn't count."""
    return rows.where(F.col(payload).rlike('(^|[^\\\\])"(' + "|".join(forbidden) + ')"\\s*:')).select(key)


def strategy_violations(strategies: DataFrame) -> DataFrame:
    """(strategy_id, codes): limits without a bound or with crossed ones, empty values, and restrictions without a rationale.

    Columns: dated (whether a date limit is given), from_year, to_year, and the arrays languages, publication_types, filters and rationale.
    """
    lists = ("languages", "publication_types", "filters", "rationale")
    values = F.concat(*(F.coalesce(F.col(c), F.expr("cast(array() as array<string>)")) for c in lists))
    some = [F.coalesce(F.size(c) > 0, F.lit(False)) for c in lists]
    rules = {
        "date.unbounded": F.col("dated") & F.col("from_year").isNull() & F.col("to_year").isNull(),
        "date.crossed": F.col("dated") & (F.col("from_year") > F.col("to_year")),
        "limits.empty_value": F.exists(values, lambda v: F.trim(v) == ""),
        "limits.no_rationale": (some[0] | some[1] | some[2] | F.col("dated")) & ~some[3],
    }
    return strategies.select("strategy_id", F.array_join(F.array_compact(F.array(*(F.when(v, k) for k, v in rules.items()))), ",").alias("codes"))


def authorise_operation(requests: DataFrame) -> DataFrame:
    """(request_id, allowed, reason) of what an agent or a human wants to do; contents never grant authority. The reasons are fixed values.

    Columns: operation, principal and receipt_id, that of a verified approval or null.
    """
    operation, c = F.col("operation"), F.coalesce(F.trim("receipt_id") != "", F.lit(False))
    human_only = operation.isin("final_exclusion", "protocol_amendment") & (F.col("principal") != "human")
    reason = F.when(operation == "draft", "non_canonical_draft").when(operation == "fixture_replay", "network_free_replay").when(human_only, "human_authority_required")
    reason = reason.when(c, "explicit_approval_verified").otherwise("explicit_approval_required")
    return requests.select("request_id", reason.isin("non_canonical_draft", "network_free_replay", "explicit_approval_verified").alias("allowed"), reason.alias("reason"))


def translation_acceptable(observed: Column, maximum: Column, approved: Column) -> Column:
    """A translation within its budget of material warnings that a human approved."""
    return (observed <= maximum) & approved


def licensed_plan(requests: DataFrame) -> DataFrame:
    """(request_id, refused, blockers, ready) of requests to licensed services.

    Columns: request_id, endpoint, allowed_hosts, dialect, strategy_dialect, credential_present, opt_in (the setting's
    text or null), review_required. A refused request has its first reason and null blockers; others have all blockers.
    """
    scheme = F.lower(F.regexp_extract("endpoint", r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract("endpoint", r"^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    refused = F.when(scheme == "", "malformed_endpoint").when(scheme != "https", "insecure_endpoint").when(host == "", "missing_host")
    refused = refused.when(~F.array_contains("allowed_hosts", host), "host_not_allowed").when(F.col("dialect") != F.col("strategy_dialect"), "dialect_mismatch")
    blockers = codes(
        ("credential_absent", ~F.col("credential_present")), ("live_opt_in_disabled", ~F.coalesce(F.col("opt_in").isin("1", "true", "TRUE", "YES", "yes"), F.lit(False))),
        ("translation_review_required", F.col("review_required")),
    )
    judged = requests.select("request_id", refused.alias("refused"), blockers.alias("b"))
    open_ = F.col("refused").isNull()
    return judged.select("request_id", "refused", F.when(open_, F.array_join("b", ",")).alias("blockers"), (open_ & (F.size("b") == 0)).alias("ready"))


def search_validation_violations(reports: DataFrame) -> DataFrame:
    """(report_id, codes) of validation reports of a search, those without breaches too.

    Columns: report_id, strategy_id, minimum_recall, press (array of structs with strategy_id, decision and findings, an
    array of messages), seeds (array of structs with seed_id and basis), translations (array of structs with
    strategy_id and dialect), approved, approver. Null arrays are empty, null texts blank.
    """
    own = F.col("strategy_id")
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    found = codes(
        ("strategy_id.blank", blank(own)), ("minimum_recall.range", (F.col("minimum_recall") < 0) | (F.col("minimum_recall") > 1) | F.isnan(F.col("minimum_recall"))),
        ("press.blank", F.exists("press", lambda p: blank(p["decision"]) | F.coalesce(F.exists(p["findings"], blank), F.lit(False)))), ("press.other_strategy", F.exists("press", lambda p: ~p["strategy_id"].eqNullSafe(own))),
        ("seed.blank", F.exists("seeds", lambda s: blank(s["seed_id"]) | blank(s["basis"]))), ("translation.blank", F.exists("translations", lambda t: blank(t["dialect"]))),
        ("translation.other_strategy", F.exists("translations", lambda t: ~t["strategy_id"].eqNullSafe(own))), ("approved.without_approver", F.col("approved") & blank(F.col("approver"))),
    )
    return reports.select("report_id", F.array_join(found, ",").alias("codes"))


def trace_violations(transitions: DataFrame) -> DataFrame:
    """(review_id, transition_id, code) of workflow transitions that break a rule, each once.

    Columns: review_id, transition_id, actor_id, occurred_at, before, after, evidence_ids (an array of texts).
    """
    blank = lambda x: F.coalesce(F.trim(F.col(x).cast("string")) == "", F.lit(True))
    none = F.coalesce(F.size("evidence_ids") < 1, F.lit(True))
    empty = F.exists("evidence_ids", lambda e: F.coalesce(F.trim(e) == "", F.lit(True)))
    rules = codes(("transition_id.blank", blank("transition_id")), ("actor.blank", blank("actor_id")), ("occurred_at.blank", blank("occurred_at")), ("state.unchanged", F.col("before").eqNullSafe(F.col("after"))), ("evidence.none", none), ("evidence.blank", empty))
    own = transitions.select("review_id", "transition_id", F.explode(rules).alias("code")).distinct()
    repeated = transitions.groupBy("review_id", "transition_id").agg(F.count("*").alias("rows")).where("rows > 1")
    return own.unionByName(repeated.select("review_id", "transition_id", F.lit("transition_id.duplicate").alias("code")))
