"""Search trees as rows: any number of strategies checked and rendered for every dialect by joins.

A node is a row (strategy_id, node, parent, ordinal, op, text, fields, vocabulary, explode, phrase,
truncation, distance, ordered); op is term, and, or, not or proximity; the root has no parent;
``not`` has what it includes at ordinal 0 and what it excludes at 1. ``problems`` reports what
is wrong with trees and terms. ``render`` works level by level from the leaves: each step joins
the parents of a level with their children's texts, gathered in order. Work and shuffles grow
with the nodes; the number of steps is the depth of the deepest tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import cut, shuffled
from . import search as S

NODES = "strategy_id string, node string, parent string, ordinal int, op string, text string, fields array<string>, vocabulary string, explode boolean, phrase boolean, truncation boolean, distance int, ordered boolean"
STRATEGIES = "strategy_id string, dialect string, from_year int, to_year int, languages array<string>, publication_types array<string>, filters array<string>"
NAMES = ("all", "title", "abstract", "title_abstract", "author", "journal", "identifier", "keyword", "subject_heading", "custom")


def term_problems() -> list[tuple[str, Column]]:
    """What can be wrong with a term; null fields are no fields, null flags false."""
    fields, vocabulary, text = fields_of(), F.col("vocabulary"), F.coalesce("text", F.lit(""))
    custom = F.filter(fields, lambda f: f.startswith("custom:"))
    blank = lambda x: ~x.rlike(r"(?U)\S")
    return [
        ("term.empty", blank(text)),
        ("term.control_character", text.rlike(r"\p{Cc}")),
        ("term.vocabulary_empty", vocabulary.isNotNull() & blank(vocabulary)),
        ("term.explode_without_vocabulary", flag("explode") & vocabulary.isNull() & ~F.array_contains(fields, "subject_heading")),
        ("term.vocabulary_field", vocabulary.isNotNull() & F.exists(fields, lambda f: f != "subject_heading")),
        ("term.duplicate_field", F.size(F.array_distinct(fields)) < F.size(fields)),
        ("term.unknown_field", F.exists(fields, lambda f: f.isNull() | ~(f.isin(*NAMES[:-1]) | f.startswith("custom:")))),
        ("term.custom_name", F.exists(custom, lambda f: ~f.rlike(r"^custom:[A-Za-z0-9_./-]+$"))),
    ]


def flag(name: str) -> Column:
    return F.coalesce(name, F.lit(False))


def fields_of() -> Column:
    return F.coalesce("fields", F.array().cast("array<string>"))


def problems(nodes: DataFrame) -> DataFrame:
    """(strategy_id, node, problem): everything that is wrong, a row each; node is null where it is about the whole tree."""
    nodes = cut(nodes)
    same = F.count("*").over(Window.partitionBy("strategy_id", "node"))
    kids = nodes.where("parent IS NOT NULL").groupBy("strategy_id", F.col("parent").alias("node")).agg(F.count("*").alias("kids"), F.collect_set("ordinal").alias("ordinals"))
    known = nodes.select("strategy_id", F.col("node").alias("parent"), F.lit(True).alias("known")).distinct()
    # by parent first, by node last: then the window, the join and the distinct rows below share one shuffle
    n = shuffled(nodes, known, ["strategy_id", "parent"], "left").withColumn("same", same)
    n = shuffled(n, kids, ["strategy_id", "node"], "left").fillna(0, ["kids"]).withColumn("places", F.coalesce(F.size("ordinals"), F.lit(0)))
    op, two = F.col("op"), F.col("op").isin("not", "proximity")
    checks = [
        ("node.unnamed", F.col("node").isNull()),
        ("node.duplicate", (F.col("same") > 1) & F.col("node").isNotNull()),
        ("node.orphan", F.col("parent").isNotNull() & F.col("known").isNull()),
        ("node.unknown_op", ~F.coalesce(op.isin("term", "and", "or", "not", "proximity"), F.lit(False))),
        ("children.fewer_than_two", op.isin("and", "or") & (F.col("kids") < 2)),
        ("children.not_two", two & (F.col("kids") != 2)),
        ("children.repeated_ordinal", F.col("places") < F.col("kids")),
        ("children.ordinals", two & (F.col("kids") == 2) & (F.col("places") == 2) & (F.array_sort("ordinals") != F.array(F.lit(0), F.lit(1)))),
        ("term.children", (op == "term") & (F.col("kids") > 0)),
        ("proximity.distance", (op == "proximity") & (F.coalesce("distance", F.lit(0)) < 1)),
        *((code, (op == "term") & wrong) for code, wrong in term_problems()),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(wrong, F.lit(False)), F.lit(code)) for code, wrong in checks)))
    own = n.select("strategy_id", "node", F.explode(found).alias("problem")).distinct()
    roots = nodes.groupBy("strategy_id").agg(F.count_if(F.col("parent").isNull()).alias("roots"))
    root = roots.where("roots <> 1").select("strategy_id", F.lit(None).cast("string").alias("node"), F.when(F.col("roots") == 0, "root.none").otherwise("root.several").alias("problem"))
    # a tree whose nodes are named once: what no walk from its root reaches hangs on a cycle or an orphan
    twice = own.where("problem IN ('node.duplicate', 'node.unnamed', 'node.orphan')").select("strategy_id").unionByName(root.where("problem = 'root.several'").select("strategy_id")).distinct()
    plain = cut(shuffled(nodes.select("strategy_id", "node", "parent"), twice, ["strategy_id"], "left_anti"))
    reached = levels(plain)
    all_ = reached[0]
    for r in reached[1:]:
        all_ = all_.unionByName(r)
    keys = ["strategy_id", "node"]
    lost = shuffled(plain.select(*keys), all_.select(*keys), keys, "left_anti").withColumn("problem", F.lit("node.unreached"))
    return own.unionByName(root).unionByName(lost)


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The nodes by their depth, from the roots on. A node has one parent, so a cycle is never reached."""
    out = [cut(nodes.where("parent IS NULL"))]
    while True:
        above = out[-1].select("strategy_id", F.col("node").alias("parent"))
        below = cut(shuffled(nodes, above, ["strategy_id", "parent"], "left_semi"))
        if below.isEmpty():
            return out
        out.append(below)


def table(values: dict[str, str | None]) -> Column:
    """A map from literal keys to literal values; missing and null values look up as null."""
    return F.create_map(*(F.lit(x) for kv in values.items() if kv[1] is not None for x in kv))


def look_up(values: dict[str, str | None], *key: Column) -> Column:
    return F.try_element_at(table(values), F.concat_ws("|", *key))


def rendered_terms(terms: DataFrame) -> DataFrame:
    """Terms, each with a dialect, and their query and warnings."""
    d, none = F.col("target"), F.array().cast("array<string>")
    text = F.replace("text", F.lit('"'), F.lit('\\"'))
    heading = F.col("vocabulary").isNotNull() | F.array_contains(fields_of(), "subject_heading")
    form = look_up({f"{x}|{str(e).lower()}": forms[e] for x, forms in S.HEADINGS.items() for e in (False, True)}, d, flag("explode").cast("string"))
    expected = look_up(S.VOCABULARIES, d)
    mismatch = F.when(F.col("vocabulary").isNotNull() & expected.isNotNull() & (F.lower(F.trim("vocabulary")) != expected), "translation.controlled_vocabulary.system_mismatch")
    as_heading = F.when(form.isNull(), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.replace(form, F.lit("{}"), text))
    heading_warnings = F.array_compact(F.array(mismatch, F.when(form.isNull(), "translation.controlled_vocabulary.degraded")))
    cut_off = F.when(flag("truncation") & ~text.endswith("*"), F.concat(text, F.lit("*"))).otherwise(text)
    quote = F.when(d == "embase", "'").otherwise('"')
    shown = F.when(flag("phrase"), F.concat(quote, cut_off, quote)).otherwise(cut_off)
    forms = {f"{x}|{name}": S.FIELDS.get(x, S.PLAIN).get(name) for x in S.DIALECTS for name in NAMES}

    def in_field(f: Column) -> Column:
        custom = f.startswith("custom:")
        own = look_up(forms, d, F.when(custom, "custom").otherwise(f))
        known = F.coalesce(own, look_up(S.DEGRADED, d), F.lit("{}"))
        query = F.replace(F.replace(known, F.lit("{field}"), F.regexp_replace(f, "^custom:", "")), F.lit("{}"), shown)
        return F.struct(query.alias("query"), F.when(own.isNull(), "translation.field.degraded").when(custom, "translation.field.custom_review").alias("warning"))

    parts = F.transform(F.when(F.size(fields_of()) == 0, F.array(F.lit("all"))).otherwise(F.col("fields")), in_field)
    got = terms.withColumn("parts", F.when(~heading, parts))
    joined = F.array_join(F.col("parts.query"), " OR ")
    joined = F.when(F.size("parts") == 1, joined).otherwise(F.concat(F.lit("("), joined, F.lit(")")))
    warnings = F.when(heading, heading_warnings).otherwise(F.coalesce(F.array_compact(F.col("parts.warning")), none))
    return got.withColumns({"query": F.when(heading, as_heading).otherwise(joined), "warnings": warnings}).drop("parts")


def rendered_parents(parents: DataFrame) -> DataFrame:
    """Inner nodes with ``kids``, their children's (ordinal, query, warnings) in order, and their own query and warnings."""
    d, op, texts = F.col("target"), F.col("op"), F.col("kids.query")
    around = lambda x: F.concat(F.lit("("), x, F.lit(")"))
    forms = {x: S.PROXIMITY.get(x, S.LOSSY) for x in S.DIALECTS}
    pick = lambda loose, strict: F.when(flag("ordered"), look_up({x: f[strict] for x, f in forms.items()}, d)).otherwise(look_up({x: f[loose] for x, f in forms.items()}, d))
    near = F.replace(pick(0, 1), F.lit("{}"), F.col("distance").cast("string"))
    query = F.when(op == "and", around(F.array_join(texts, " AND "))).when(op == "or", around(F.array_join(texts, " OR ")))
    query = query.when(op == "not", F.concat(around(texts[0]), F.lit(" NOT "), around(texts[1]))).otherwise(around(F.concat_ws(" ", texts[0], near, texts[1])))
    own = F.array_compact(F.array(F.when(op == "proximity", pick(2, 3))))
    return parents.withColumns({"query": query, "warnings": F.concat(F.flatten("kids.warnings"), own)})


DONE = ("strategy_id", "node", "parent", "ordinal", "target", "query", "warnings")


def render(nodes: DataFrame, dialects: tuple[str, ...] = S.DIALECTS) -> DataFrame:
    """(strategy_id, target, query, warnings) of the roots, for each dialect. Trees with problems give nothing or nonsense: check first."""
    done = None
    for level in reversed(levels(nodes)):
        here = level.withColumn("target", F.explode(F.array(*map(F.lit, dialects))))
        out = rendered_terms(here.where("op = 'term'")).select(*DONE)
        if done is not None:
            kids = done.groupBy("strategy_id", F.col("parent").alias("node"), "target").agg(F.sort_array(F.collect_list(F.struct("ordinal", "query", "warnings"))).alias("kids"))
            out = out.unionByName(rendered_parents(shuffled(here.where("op <> 'term'"), kids, ["strategy_id", "node", "target"])).select(*DONE))
        done = cut(out)
    return done.select("strategy_id", "target", "query", "warnings")


def compile_all(strategies: DataFrame, nodes: DataFrame, dialects: tuple[str, ...] = S.DIALECTS) -> DataFrame:
    """(strategy_id, target, query, warnings, losses, fidelity) of each strategy and dialect; strategies with problems are left out."""
    wrong = problems(nodes).select("strategy_id").distinct()
    got = shuffled(render(cut(shuffled(nodes, wrong, ["strategy_id"], "left_anti")), dialects), strategies, ["strategy_id"])
    dated = F.col("from_year").isNotNull() | F.col("to_year").isNotNull()
    pubmed = F.col("target") == "pubmed"
    year = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default))
    dates = F.concat(F.lit(' AND ("'), year("from_year", "0001"), F.lit('"[Date - Publication] : "'), year("to_year", "3000"), F.lit('"[Date - Publication])'))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    after = [
        F.when(dated & ~pubmed, "translation.date_limit.manual"),
        F.when(some("languages") | some("publication_types"), "translation.restrictions.manual"),
        F.when(some("filters"), "translation.filters.review"),
    ]
    before = F.when(F.col("dialect") != F.col("target"), "translation.target_differs_from_declared_dialect")
    warnings = F.concat(F.array_compact(F.array(before)), "warnings", F.array_compact(F.array(*after)))
    got = got.select("strategy_id", "target", F.when(dated & pubmed, F.concat("query", dates)).otherwise(F.col("query")).alias("query"), warnings.alias("warnings"))
    losses = F.filter("warnings", lambda w: F.greatest(*(w.contains(m).cast("int") for m in S.LOSS)) == 1)
    fidelity = F.when(F.size("warnings") == 0, "exact").when(F.size("losses") > 0, "degraded").otherwise("approximate")
    return got.withColumn("losses", losses).withColumn("fidelity", fidelity)
