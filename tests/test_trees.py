"""Trees as rows against the renderer of one tree, and what is wrong with trees."""

import random

from evigrain.plans import search as S
from evigrain.plans import trees

TERM = dict(text=None, fields=None, vocabulary=None, explode=None, phrase=None, truncation=None, distance=None, ordered=None)


def rows_of(strategy_id, tree):
    out = []

    def walk(node, parent, ordinal):
        name = f"n{len(out)}"
        row = dict(TERM, strategy_id=strategy_id, node=name, parent=parent, ordinal=ordinal)
        out.append(row)
        kids = ()
        match node:
            case S.Term():
                row |= dict(op="term", text=node.text, fields=list(node.fields) or None, vocabulary=node.vocabulary, explode=node.explode, phrase=node.phrase, truncation=node.truncation)
            case S.And() | S.Or():
                row["op"], kids = ("and" if isinstance(node, S.And) else "or"), node.children
            case S.Not():
                row["op"], kids = "not", (node.include, node.exclude)
            case S.Near():
                row |= dict(op="proximity", distance=node.distance, ordered=node.ordered)
                kids = node.left, node.right
        for i, kid in enumerate(kids):
            walk(kid, name, i)

    walk(tree, None, 0)
    return out


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        text = rng.choice(["heart attack", 'a "quoted" word', "stem*", "$1 \\x {} {field}", "naïve"])
        if rng.random() < 0.3:
            return S.Term(text, rng.choice([(), ("subject_heading",)]), rng.choice(["MeSH", " mesh ", "emtree", "other"]), rng.random() < 0.5)
        fields = tuple(rng.sample(["all", "title", "abstract", "title_abstract", "author", "journal", "identifier", "keyword", "custom:tw", "custom:a.b/c"], rng.randint(0, 3)))
        return S.Term(text, fields, phrase=rng.random() < 0.3, truncation=rng.random() < 0.3)
    kid = lambda: random_tree(rng, depth - 1)
    return rng.choice([lambda: S.And(tuple(kid() for _ in range(rng.randint(2, 4)))), lambda: S.Or((kid(), kid())), lambda: S.Not(kid(), kid()), lambda: S.Near(kid(), kid(), rng.randint(1, 9), rng.random() < 0.5)])()


def nodes(spark, rows):
    return spark.createDataFrame(rows, trees.NODES)


def test_every_dialect_as_one_tree_at_a_time(spark):
    rng = random.Random(0)
    strategies = [S.Strategy(f"s{i}", rng.choice(S.DIALECTS), random_tree(rng, 4), rng.choice([None, 1990]), rng.choice([None, 2001]), rng.choice([(), ("en",)]), rng.choice([(), ("review",)]), rng.choice([(), ("rct",)])) for i in range(25)]
    table = spark.createDataFrame([(s.strategy_id, s.dialect, s.from_year, s.to_year, list(s.languages), list(s.publication_types), list(s.filters)) for s in strategies], trees.STRATEGIES)
    got = {(r.strategy_id, r.target): (r.query, list(r.warnings), r.fidelity, list(r.losses)) for r in trees.compile_all(table, nodes(spark, [r for s in strategies for r in rows_of(s.strategy_id, s.query)])).collect()}
    want = {}
    for s in strategies:
        for d in S.DIALECTS:
            c = S.compile_strategy(s, d)
            want[s.strategy_id, d] = (c.query, c.warnings, c.fidelity, c.losses)
    assert got == want


def found(spark, rows):
    return sorted((r.strategy_id, r.node or "", r.problem) for r in trees.problems(nodes(spark, rows)).collect())


def node(strategy_id, name, parent, op="term", ordinal=0, **more):
    return dict(TERM, strategy_id=strategy_id, node=name, parent=parent, ordinal=ordinal, op=op, **({"text": "x"} if op == "term" else {}) | more)


def test_problems_of_trees(spark):
    rows = [
        node("cycle", "r", None), node("cycle", "a", "b", "and", ordinal=2), node("cycle", "b", "a", "and"), node("cycle", "c", "b"), node("cycle", "d", "a", ordinal=1), node("cycle", "e", "b", ordinal=1),
        node("orphan", "r", None), node("orphan", "o", "nowhere"), node("rootless", "a", "a", "and"), node("roots", "a", None), node("roots", "b", None), node("twice", "a", None), node("twice", "a", None),
        node("few", "r", None, "and"), node("few", "k", "r"), node("three", "r", None, "not"), *(node("three", f"k{i}", "r", ordinal=i) for i in range(3)), node("places", "r", None, "or"), node("places", "k", "r"), node("places", "l", "r"),
        node("order", "r", None, "proximity", distance=2), node("order", "k", "r", ordinal=1), node("order", "l", "r", ordinal=2), node("leaf", "r", None), node("leaf", "k", "r"), node("near", "r", None, "proximity", distance=0), node("near", "k", "r"), node("near", "l", "r", ordinal=1),
        node("op", "r", None, "xor"), node("good", "r", None, "and"), node("good", "k", "r"), node("good", "l", "r", ordinal=1),
    ]
    assert found(spark, rows) == sorted([
        ("cycle", "a", "node.unreached"), ("cycle", "b", "node.unreached"), ("cycle", "c", "node.unreached"), ("cycle", "d", "node.unreached"), ("cycle", "e", "node.unreached"), ("orphan", "o", "node.orphan"), ("rootless", "", "root.none"), ("rootless", "a", "children.fewer_than_two"), ("rootless", "a", "node.unreached"),
        ("roots", "", "root.several"), ("twice", "", "root.several"), ("twice", "a", "node.duplicate"), ("few", "r", "children.fewer_than_two"), ("three", "r", "children.not_two"), ("places", "r", "children.repeated_ordinal"), ("order", "r", "children.ordinals"),
        ("leaf", "r", "term.children"), ("near", "r", "proximity.distance"), ("op", "r", "node.unknown_op"),
    ])
    assert found(spark, []) == []


def test_problems_of_terms(spark):
    cases = {
        "term.empty": dict(text="  "), "term.control_character": dict(text="a\x85b"), "term.vocabulary_empty": dict(vocabulary=" "), "term.explode_without_vocabulary": dict(explode=True), "term.vocabulary_field": dict(vocabulary="mesh", fields=["title"]),
        "term.duplicate_field": dict(fields=["title", "title"]), "term.unknown_field": dict(fields=["nothing"]), "term.custom_name": dict(fields=["custom:a b"]),
    }
    good = [dict(explode=True, fields=["subject_heading"]), dict(vocabulary="mesh", fields=["subject_heading"], explode=True), dict(fields=["custom:x_y-z./9", "title"]), dict(text=None, op="term") | {"text": "ok"}]
    rows = [node(code, "r", None, **(dict(text="x") | more)) for code, more in cases.items()] + [node(f"good{i}", "r", None, **(dict(text="x") | more)) for i, more in enumerate(g if "op" not in g else {k: v for k, v in g.items() if k != "op"} for g in good)]
    assert found(spark, rows) == sorted((code, "r", code) for code in cases)
