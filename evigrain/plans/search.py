"""Portable search strategies: a Boolean and proximity tree, compiled to dialects and to Spark columns.

Trees are small driver-side values. ``compile_strategy`` renders one for a source;
``predicate`` turns it into a Boolean column over records, so that Spark evaluates the
strategy on any number of rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Term:
    text: str
    fields: tuple[str, ...] = ()
    vocabulary: str | None = None
    explode: bool = False
    phrase: bool = False
    truncation: bool = False


@dataclass(frozen=True)
class And:
    children: tuple


@dataclass(frozen=True)
class Or:
    children: tuple


@dataclass(frozen=True)
class Not:
    include: object
    exclude: object


@dataclass(frozen=True)
class Near:
    left: object
    right: object
    distance: int
    ordered: bool = False


@dataclass(frozen=True)
class Strategy:
    strategy_id: str
    dialect: str
    query: object
    from_year: int | None = None
    to_year: int | None = None
    languages: tuple[str, ...] = ()
    publication_types: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()


@dataclass
class Compiled:
    query: str
    warnings: list[str] = field(default_factory=list)

    @property
    def losses(self) -> list[str]:
        return [w for w in self.warnings if any(m in w for m in LOSS)]

    @property
    def fidelity(self) -> str:
        """Every warning asks for review, so what is neither exact nor degraded is approximate."""
        return "exact" if not self.warnings else "degraded" if self.losses else "approximate"


#: The parts of warning codes that mean a loss.
LOSS = (".lossy", ".degraded", "_degraded", ".generic", ".manual", ".fallback", ".review", "_review", "target_differs")
#: How each dialect writes a term in a field. ``{}`` is the term; a field that is not listed is degraded.
OVID = {"all": "{}", "title": "{}.ti.", "abstract": "{}.ab.", "title_abstract": "{}.ti,ab.", "author": "{}.au.", "journal": "{}.jn.", "identifier": "{}.ui.", "keyword": "{}.kw.", "subject_heading": "{}/", "custom": "{}.{field}."}
FIELDS = {
    "pubmed": {"all": "{}", "title": "{}[Title]", "abstract": "{}[Abstract]", "title_abstract": "{}[Title/Abstract]", "author": "{}[Author]", "journal": "{}[Journal]", "identifier": "{}[AID]", "keyword": "{}[Other Term]", "subject_heading": "{}[MeSH Terms]", "custom": "{}[{field}]"},
    "ovid_medline": OVID,
    "psycinfo_ovid": OVID,
    "embase": {"all": "{}:all", "title": "{}:ti", "abstract": "{}:ab", "title_abstract": "{}:ti,ab", "author": "{}:au", "journal": "{}:jt", "identifier": "{}:dn", "keyword": "{}:kw", "subject_heading": "{}/de", "custom": "{}:{field}"},
    "europe_pmc": {"all": "{}", "title": "TITLE:{}", "abstract": "ABSTRACT:{}", "title_abstract": "(TITLE:{} OR ABSTRACT:{})", "author": "AUTH:{}", "journal": "JOURNAL:{}", "identifier": "EXT_ID:{}", "subject_heading": "MESH:{}"},
    "cinahl_ebsco": {"all": "{}", "title": "TI {}", "abstract": "AB {}", "title_abstract": "(TI {} OR AB {})", "author": "AU {}", "journal": "JN {}", "subject_heading": "MH {}"},
    "scopus": {"all": "{}", "title": "TITLE({})", "abstract": "ABS({})", "title_abstract": "TITLE-ABS-KEY({})", "keyword": "TITLE-ABS-KEY({})", "author": "AUTH({})", "journal": "SRCTITLE({})"},
    "web_of_science": {"all": "TS=({})", "title": "TI=({})", "author": "AU=({})", "journal": "SO=({})", "subject_heading": "TS=({})"},
}
#: What a degraded field becomes, where that is not the bare term.
DEGRADED = {"web_of_science": "TS=({})"}
PLAIN = {"all": "{}", "title_abstract": "{}"}
#: Proximity operators (any order, in order) and the warning each brings; others fall back to AND.
PROXIMITY = {
    "ovid_medline": ("adj{}", "adj{}", None, "translation.proximity.order_degraded"),
    "psycinfo_ovid": ("adj{}", "adj{}", None, "translation.proximity.order_degraded"),
    "embase": ("NEAR/{}", "NEAR/{}", None, "translation.proximity.order_degraded"),
    "web_of_science": ("NEAR/{}", "NEAR/{}", None, "translation.proximity.order_degraded"),
    "scopus": ("W/{}", "PRE/{}", None, None),
    "cinahl_ebsco": ("N{}", "W{}", None, None),
    "generic_boolean": ("NEAR/{}", "NEAR/{}", "translation.proximity.generic", "translation.proximity.generic"),
    "pubmed": ("AND", "AND", "translation.pubmed.proximity_review", "translation.pubmed.proximity_review"),
    "europe_pmc": ("AND", "AND", "translation.europe_pmc.proximity_degraded", "translation.europe_pmc.proximity_degraded"),
}
LOSSY = ("AND", "AND", "translation.proximity.lossy", "translation.proximity.lossy")
#: Controlled-vocabulary headings (plain, exploded) and the vocabulary a dialect expects.
HEADINGS = {
    "pubmed": ('"{}"[MeSH Terms:noexp]', '"{}"[MeSH Terms]'),
    "ovid_medline": ("{}/", "exp {}/"),
    "psycinfo_ovid": ("{}/", "exp {}/"),
    "embase": ("'{}'/de", "'{}'/exp"),
    "cinahl_ebsco": ('MH "{}"', 'MH "{}+"'),
    "europe_pmc": ('MESH:"{}"', 'MESH:"{}"'),
}
VOCABULARIES = {"pubmed": "mesh", "ovid_medline": "mesh", "embase": "emtree", "psycinfo_ovid": "apa thesaurus"}
DIALECTS = (*PROXIMITY, "crossref", "openalex", "clinical_trials_gov")


def problems(node) -> list[str]:
    """What makes a tree invalid."""
    match node:
        case Term():
            out = ["term.empty"] if not node.text.strip() else []
            out += ["term.control_character"] if re.search(r"[\x00-\x1f\x7f-\x9f]", node.text) else []
            out += ["term.vocabulary_empty"] if node.vocabulary is not None and not node.vocabulary.strip() else []
            out += ["term.explode_without_vocabulary"] if node.explode and node.vocabulary is None and "subject_heading" not in node.fields else []
            out += ["term.vocabulary_field"] if node.vocabulary is not None and any(f != "subject_heading" for f in node.fields) else []
            out += ["term.duplicate_field"] if len(set(node.fields)) < len(node.fields) else []
            return out + (["term.custom_name"] if any(f.startswith("custom:") and not re.fullmatch(r"custom:[A-Za-z0-9_./-]+", f) for f in node.fields) else [])
        case And() | Or():
            return (["children.fewer_than_two"] if len(node.children) < 2 else []) + [p for c in node.children for p in problems(c)]
        case Not():
            return problems(node.include) + problems(node.exclude)
        case Near():
            return (["proximity.distance"] if node.distance < 1 else []) + problems(node.left) + problems(node.right)
    raise TypeError(node)


def compile_strategy(strategy: Strategy, dialect: str) -> Compiled:
    if found := problems(strategy.query):
        raise ValueError(", ".join(found))
    out = Compiled("", ["translation.target_differs_from_declared_dialect"] if strategy.dialect != dialect else [])
    out.query = render(strategy.query, dialect, out.warnings)
    if strategy.from_year is not None or strategy.to_year is not None:
        if dialect == "pubmed":
            years = [default if y is None else str(y) for y, default in ((strategy.from_year, "0001"), (strategy.to_year, "3000"))]
            out.query += f' AND ("{years[0]}"[Date - Publication] : "{years[1]}"[Date - Publication])'
        else:
            out.warnings.append("translation.date_limit.manual")
    if strategy.languages or strategy.publication_types:
        out.warnings.append("translation.restrictions.manual")
    if strategy.filters:
        out.warnings.append("translation.filters.review")
    return out


def render(node, dialect: str, warnings: list[str]) -> str:
    match node:
        case And() | Or():
            word = " AND " if isinstance(node, And) else " OR "
            return f"({word.join(render(c, dialect, warnings) for c in node.children)})"
        case Not():
            return f"({render(node.include, dialect, warnings)}) NOT ({render(node.exclude, dialect, warnings)})"
        case Near():
            sides = render(node.left, dialect, warnings), render(node.right, dialect, warnings)
            loose, strict, warn, warn_ordered = PROXIMITY.get(dialect, LOSSY)
            if code := (warn_ordered if node.ordered else warn):
                warnings.append(code)
            return f"({sides[0]} {(strict if node.ordered else loose).format(node.distance)} {sides[1]})"
    return render_term(node, dialect, warnings)


def render_term(term: Term, dialect: str, warnings: list[str]) -> str:
    text = term.text.replace('"', '\\"')
    if term.vocabulary is not None or "subject_heading" in term.fields:
        expected = VOCABULARIES.get(dialect)
        if term.vocabulary is not None and expected and term.vocabulary.strip().lower() != expected:
            warnings.append("translation.controlled_vocabulary.system_mismatch")
        if dialect not in HEADINGS:
            warnings.append("translation.controlled_vocabulary.degraded")
            return f'"{text}"'
        return HEADINGS[dialect][term.explode].replace("{}", text)
    if term.truncation and not text.endswith("*"):
        text += "*"
    if term.phrase:
        text = f"'{text}'" if dialect == "embase" else f'"{text}"'
    shown = [in_field(text, f, dialect, warnings) for f in term.fields or ("all",)]
    return shown[0] if len(shown) == 1 else f"({' OR '.join(shown)})"


def in_field(text: str, name: str, dialect: str, warnings: list[str]) -> str:
    table = FIELDS.get(dialect, PLAIN)
    custom = name.startswith("custom:")
    form = table.get("custom" if custom else name)
    if form is None:
        warnings.append("translation.field.degraded")
        form = DEGRADED.get(dialect, "{}")
    elif custom:
        warnings.append("translation.field.custom_review")
    return form.replace("{field}", name.removeprefix("custom:")).replace("{}", text)


# --- the same tree as a predicate over records
RECORD_FIELDS = {"title": ["title"], "abstract": ["abstract"], "title_abstract": ["title", "abstract"], "author": ["authors"], "journal": ["container"], "identifier": ["doi", "pmid"], "keyword": ["subjects"], "subject_heading": ["subjects"], "all": ["title", "abstract", "authors", "container", "subjects"]}


def words_of(name: str) -> Column:
    """A field's words in lower case, one space before and after each."""
    text = F.array_join(name, " ") if name in ("authors", "subjects") else F.col(name)
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), T.NOT_ALNUM, " "), F.lit(" "))


def pattern(term: Term) -> str:
    """A regular expression for the term's words in a row."""
    wanted = [re.escape(w) for w in re.split(r"[\W_]+", term.text.lower()) if w]
    return " ".join(wanted) + ("[^ ]*" if term.truncation else "")


def names_of(term: Term) -> list[str]:
    return list(dict.fromkeys(n for f in term.fields or ("all",) for n in RECORD_FIELDS.get(f, [])))


def predicate(node) -> Column:
    """Does a record match? A term matches whole words (beginnings with truncation) in a row; proximity looks at one field at a time."""
    match node:
        case Term():
            return any_of([words_of(n).rlike(f"(?<= ){pattern(node)}(?= )") for n in names_of(node)])
        case And():
            out = F.lit(True)
            for c in node.children:
                out = out & predicate(c)
            return out
        case Or():
            return any_of([predicate(c) for c in node.children])
        case Not():
            return predicate(node.include) & ~predicate(node.exclude)
        case Near(left=Term(), right=Term()):
            both = [n for n in names_of(node.left) if n in names_of(node.right)]
            a, b, gap = pattern(node.left), pattern(node.right), f"(?: [^ ]+){{0,{node.distance - 1}}} "
            either = f"(?<= )(?:{a}{gap}{b}" + ("" if node.ordered else f"|{b}{gap}{a}") + ")(?= )"
            return any_of([words_of(n).rlike(either) for n in both])
        case Near():
            return predicate(node.left) & predicate(node.right)
    raise TypeError(node)


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def match_records(records: DataFrame, strategy: Strategy) -> DataFrame:
    """The records that a strategy selects; year bounds and languages apply too."""
    if found := problems(strategy.query):
        raise ValueError(", ".join(found))
    cond = predicate(strategy.query)
    if strategy.from_year is not None:
        cond = cond & (F.col("year") >= strategy.from_year)
    if strategy.to_year is not None:
        cond = cond & (F.col("year") <= strategy.to_year)
    if strategy.languages:
        cond = cond & F.col("language").isin(*strategy.languages)
    return records.where(cond)


# --- native strategies, line by line
def native_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start_byte, end_byte, set_id, kind, content) of each line that is not blank; kind is combination or search."""
    line = rows.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("line", "p"))
    before = F.sum(F.octet_length("p") + 1).over(W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1))
    line = line.withColumn("start", F.coalesce(before, F.lit(0)))
    start = F.col("start")
    content = F.col("p")
    set_id = F.nullif(F.regexp_extract(content, r"^\s*#?([0-9]+)[.:)]?\s+", 1), F.lit(""))
    rest = F.trim(F.regexp_replace(content, r"^\s*#?[0-9]+[.:)]?\s+", ""))
    kind = F.when(rest.rlike(r"(?i)^[#()0-9\s]*([0-9]\s*(and|or|not)\s*#?[0-9()\s#]*)+$"), "combination").otherwise("search")
    got = line.select(key, (F.col("line") + 1).alias("line"), start.alias("start_byte"), (start + F.octet_length(content)).alias("end_byte"), set_id.alias("set_id"), kind.alias("kind"), content.alias("content"))
    return got.where(F.trim("content") != "")


def _suffix(mark: str, fields: tuple[str, ...], close: str = "") -> str:
    f = "(" + "|".join(fields) + ")"
    return f"{mark}{f}(,{f})*{close}$"


def supported_line(dialect: Column, body: Column) -> Column:
    """Whether a native line is in the part of its dialect's syntax that is understood; the marks are fixed values."""
    low = F.lower(body)
    rules = {
        "pubmed": F.contains(body, F.lit("[")) & F.contains(body, F.lit("]")) & (F.contains(low, F.lit("[mesh terms]")) | F.contains(low, F.lit("[title/abstract]"))),
        "ovid_medline": (F.startswith(low, F.lit("exp ")) & F.endswith(body, F.lit("/"))) | low.rlike(_suffix("\\.", ("ti", "ab", "kf"), "\\.")),
        "psycinfo_ovid": F.endswith(body, F.lit("/")) | low.rlike(_suffix("\\.", ("ti", "ab", "id"), "\\.")),
        "embase": (F.startswith(body, F.lit("'")) & F.contains(low, F.lit("'/exp"))) | low.rlike(_suffix(":", ("ti", "ab", "kw"))),
        "cinahl_ebsco": low.rlike('^(\\(?mh "|ti |ab )'),
        "scopus": F.startswith(low, F.lit("title-abs-key(")) & F.endswith(body, F.lit(")")),
        "web_of_science": F.startswith(low, F.lit("ts=(")) & F.endswith(body, F.lit(")")),
        "generic_boolean": F.trim(body) != "",
    }
    got = F.lit(False)
    for name, rule in rules.items():
        got = F.when(dialect == name, rule).otherwise(got)
    return got


def native_diagnostics(lines: DataFrame, dialect: str, body: str) -> DataFrame:
    """Lines outside their dialect's subset, with the diagnostic's code; all are warnings that want a review."""
    bad = lines.where(~F.coalesce(supported_line(F.col(dialect), F.col(body)), F.lit(False)))
    return bad.withColumns({"code": F.concat(F.lit("native."), dialect, F.lit(".unsupported_syntax")), "severity": F.lit("warning"), "review_required": F.lit(True)})
