"""Quality classifier: a sparse rule ensemble over text statistics.

``statistics`` measures each text once. ``train`` grows a small random forest (MLlib) over
the labelled rows' statistics, takes every path from a root as a conjunctive rule, fits a
lasso logistic regression (MLlib) to the rules' truth values and keeps those with a weight.
``Rules.score`` compiles them into one Spark column expression.

Defined cases: null, empty and wordless texts have statistics of 0 and are scored like any
other. Rows with a null label are not learned from. Without labelled rows, or with one
label only, the score is that label's share (0.5 without any). Rows with the same doc_id
are separate. Columns of docs other than id and text are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as t

CLASSES = {
    "upper": t.byte_table(lambda b: 0x41 <= b <= 0x5A),
    "letter": t.byte_table(lambda b: b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A),
    "digit": t.byte_table(lambda b: 0x30 <= b <= 0x39),
    "stop": t.byte_table(lambda b: chr(b) in ".,;:?"),
    "shout": t.byte_table(lambda b: chr(b) == "!"),
    "symbol": t.byte_table(lambda b: chr(b) in "#$%&*+/<=>@\\^_`|~{}[]"),
    "line": t.byte_table(lambda b: b == 0x0A),
}
STATISTICS = (*(f"{c}_share" for c in CLASSES), "n_words", "word_length", "distinct_share", "top_share", "echo_share", "plain_share", "upper_words")


def measure(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a chunk."""
    size = np.maximum(np.diff(offs), 1)
    out = [np.diff(np.concatenate(([0], np.cumsum(table[buf])))[offs]) / size for table in CLASSES.values()]
    starts, ends, first = t.words(buf, offs)
    n = np.diff(first)
    h = t.word_hashes(t.LOWER[buf], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    which = np.repeat(np.arange(len(n)), n)
    per = lambda x: np.bincount(which, x, minlength=len(n)) / np.maximum(n, 1)
    order = np.lexsort((h, which))
    w, k = which[order], h[order]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (k[1:] != k[:-1])))[: len(w)]
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, len(w)))
    top = np.zeros(len(n))
    np.maximum.at(top, w[head], times)
    echo = np.concatenate(([False], (which[1:] == which[:-1]) & (h[1:] == h[:-1])))[: len(h)]
    total = {c: np.concatenate(([0], np.cumsum(CLASSES[c][buf]))) for c in ("letter", "upper")}
    letters, capitals = (total[c][ends] - total[c][starts] for c in ("letter", "upper"))
    out += [n, per(ends - starts), np.bincount(w[head], minlength=len(n)) / np.maximum(n, 1), top / np.maximum(n, 1), per(echo), per(letters == 0), per((capitals > 1) & (2 * capitals > letters))]
    return np.stack(out, axis=1).astype(np.float64)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, one double for each of STATISTICS)."""

    def run(batches):
        for batch in batches:
            got = [measure(buf, offs) for _, _, buf, offs in t.chunks(t.column(batch, "body"))]
            got = np.concatenate(got) if got else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([t.column(batch, "id"), *(pa.array(c) for c in got.T)], names=["id", *STATISTICS])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS)).withColumnRenamed("id", doc_id)


Rule = tuple[tuple[str, bool, float], ...]


def holds(rule: Rule) -> Column:
    """The rule's conditions (statistic, at most?, bound) as one Boolean column."""
    out = F.lit(True)
    for name, low, bound in rule:
        out = out & (F.col(name) <= bound if low else F.col(name) > bound)
    return out


def paths(debug: str) -> list[Rule]:
    """The conjunctions at all nodes below the roots of a forest, from its printed form."""
    rules, above = set(), []
    for line in debug.splitlines():
        depth = len(line) - len(line.lstrip())
        if line.lstrip().startswith("Tree"):
            above = []
        elif m := re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line):
            above = [x for x in above if x[0] < depth] + [(depth, (STATISTICS[int(m[1])], m[2] == "<=", float(m[3])))]
            tightest: dict[tuple[str, bool], float] = {}
            for _, (name, low, bound) in above:
                had = tightest.get((name, low), bound)
                tightest[name, low] = min(had, bound) if low else max(had, bound)
            rules.add(tuple(sorted((*k, v) for k, v in tightest.items())))
    return sorted(rules)


@dataclass
class Rules:
    bias: float
    weights: list[tuple[Rule, float]]

    def score(self) -> Column:
        z = F.lit(self.bias)
        for rule, weight in self.weights:
            z = z + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def train(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", allowed: Column | None = None, trees: int = 12, depth: int = 3, l1: float = 0.001) -> Rules:
    """Fit on all labelled rows for which ``allowed``, a condition on labels, holds."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    known = labels.where(F.col(label).isNotNull())
    known = known.where(allowed) if allowed is not None else known
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("double")).alias("label"))
    rows = measured.join(known, measured[doc_id] == known["id"]).select("label", *STATISTICS).persist()
    try:
        share = rows.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
        if not share.n or share.p in (0.0, 1.0):
            p = min(max(share.p if share.n else 0.5, 1e-6), 1 - 1e-6)
            return Rules(math.log(p / (1 - p)), [])
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt", minInstancesPerNode=5)
        model = forest.fit(rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features")))
        rules = paths(model.toDebugString)
        if not rules:
            return Rules(math.log(share.p / (1 - share.p)), [])
        truth = rows.select("label", array_to_vector(F.array(*(holds(r).cast("double") for r in rules))).alias("features"))
        fitted = LogisticRegression(elasticNetParam=1.0, regParam=l1, maxIter=60, standardization=False).fit(truth)
        return Rules(float(fitted.intercept), [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if w])
    finally:
        rows.unpersist()
