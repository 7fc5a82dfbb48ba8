"""Names brought to one form: ordered rules kept as rows, folding of letters, and synonyms that hold transitively."""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components

# Letters that no decomposition takes apart, in plain letters.
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i"}


class Rule(NamedTuple):
    """One rewriting step, for names that begin with ``guard`` (all names if it is empty).

    Kinds: text and regex replace every place where the pattern stands, whole
    replaces a name that equals the pattern (with null, if there is no
    replacement), lower and fold change all letters, fill gives names that are
    null the value of the column that ``replacement`` names, and require
    raises an error for names in which the pattern isn't found.
    """

    guard: str
    kind: str
    pattern: str | None = None
    replacement: str | None = None


# The rewriting of subdivision names, in order.
VILLANOVA = Rule("", "regex", "^FRACCIONAMIENTO VILLANOVA.*", "VILLANOVA")
PORTICOS = Rule("", "regex", ".*PORTICOS DEL VALLE.*", "PORTICOS DEL VALLE")
LABELS = ("FRACCIONAMIENTO", "FRACC", "FRACCTO", "FRACTO")
PLACES = (
    Rule("COLONIA BALBUENA", "text", "DE MEXICALI BC DENTRO DE LA", ""),
    Rule("COLONIA GRANJAS AGRICOLAS", "text", "FOLIO REAL 1598810 DE MEXICALI BC", ""),
    Rule("LA RIOJA", "text", "CASTILLAUNA", "CASTILLA"),
)
SYNONYMS = (("gran foresta", "foresta residencial"), ("foresta life", "foresta residencial"))

# The rewriting of names of the older registry, whose generic ones are filled from the name of the section.
SHORT, LONG = Rule("", "regex", r"fracc\.?", ""), Rule("", "text", "fraccionamiento", "")
GENERIC = (
    Rule("", "whole", "quinta granada", None),
    Rule("", "whole", "valle de puebla", None),
    Rule("", "whole", "la condesa", None),
    Rule("", "whole", "victoria residencial", None),
)
OLDER_SYNONYMS = (
    ("des. hab. privada campestre", "privadas campestre"),
    ("camino del sol", "caminos del sol"),
    ("balbuena condominios", "colonia balbuena"),
    ("balbuena", "colonia balbuena"),
    ("corceles", "corceles residencial"),
    ("la condesa seccion fontalba", "fontalba residencial"),
    ("valle de puebla quinta etapa", "valle de puebla 5ta secc."),
    ("quinta granada primera etapa", "quinta granada"),
    ("quinta granada tercera etapa", "quinta granada 3"),
    ("desarrollo habitacional residencial natura", "residencial natura"),
)
CONDESA = (
    Rule("", "text", "la condesa", "privadas condesa"),
    Rule("", "text", "seccio0n", "seccion"),
    Rule("", "text", "leganes", "leganés"),
    Rule("privadas condesa", "regex", "^.*?privadas condesa seccion (.+)$", "privadas condesa ($1)"),
    Rule("", "whole", "fracc. victoria residencial segunda seccion", "privadas condesa (victoria segunda seccion)"),
)


def subdivision_rules(*, strict_reference: bool = False) -> list[Rule]:
    """The rules for subdivision names; :data:`SYNONYMS` come after them.

    The longest label that stands at a place is removed; ``strict_reference``
    takes the labels in the order of the fixed values, where FRACC goes before
    FRACCTO and leaves the letters TO.
    """
    labels = LABELS if strict_reference else sorted(LABELS, key=len, reverse=True)
    return [VILLANOVA, PORTICOS, Rule("FRAC", "regex", "|".join(labels), ""), *PLACES, Rule("", "lower")]


def older_rules(section: str, *, strict_reference: bool = False) -> list[Rule]:
    """The rules for names of the older registry; ``section`` is the column that fills generic names. :data:`OLDER_SYNONYMS` come after them, then :func:`condesa_rules`.

    The long label is removed before the short one; ``strict_reference`` does
    it the other way round, which leaves the letters ionamiento.
    """
    labels = (SHORT, LONG) if strict_reference else (LONG, SHORT)
    return [Rule("", "lower"), *labels, *GENERIC, Rule("", "fill", None, section), Rule("", "lower")]


def condesa_rules(*, strict_reference: bool = False) -> list[Rule]:
    """The last rules for the older registry; ``strict_reference`` raises an error for a name of this group that has no section, which otherwise stays as it is."""
    form = [Rule("privadas condesa", "require", "privadas condesa seccion .+")] if strict_reference else []
    return [*CONDESA[:3], *form, *CONDESA[3:]]


def rules_of(table: DataFrame) -> list[Rule]:
    """The rules in a table (step, guard, kind, pattern, replacement), a row for each, in the order of step; a null guard is none."""
    return [Rule(r["guard"] or "", r["kind"], r["pattern"], r["replacement"]) for r in table.orderBy("step").select("guard", "kind", "pattern", "replacement").collect()]  # a row per rule


def folded(value: Column) -> Column:
    """Small letters without the marks of any Latin letter; letters of other scripts stay."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block]
    plain = [(c, base) for c, base in found if base.isascii() and c.islower()]
    out = F.translate(F.lower(value), "".join(c for c, _ in plain), "".join(base for _, base in plain))
    for letter, letters in LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(letters))
    return F.regexp_replace(out, r"\p{M}+", "")


def _rewritten(value: Column, rule: Rule) -> Column:
    pattern, new = rule.pattern, F.lit(rule.replacement).cast("string")
    if rule.kind == "text":
        return F.replace(value, F.lit(pattern), new)
    if rule.kind == "regex":
        return F.regexp_replace(value, F.lit(pattern), new)
    if rule.kind == "whole":
        return F.when(value == pattern, new).otherwise(value)
    if rule.kind == "lower":
        return F.lower(value)
    if rule.kind == "fold":
        return folded(value)
    if rule.kind == "fill":
        return F.coalesce(value, F.col(rule.replacement))
    if rule.kind == "require":
        return F.when(value.rlike(pattern), value).otherwise(F.raise_error(F.concat(F.lit("unexpected name: "), value)))
    raise ValueError(f"unknown kind of rule: {rule.kind}")


def apply_rules(df: DataFrame, column: str, rules: list[Rule]) -> DataFrame:
    """df with the column rewritten by all rules, one after the other; each sees what those before it left, and white space at the ends goes after each.

    Nulls stay null but for the kind fill. No rules, no change. One projection
    for each rule, all in the task that reads the row.
    """
    for rule in rules:
        value = F.col(column)
        new = F.trim(_rewritten(value, rule))
        df = df.withColumn(column, F.when(value.startswith(rule.guard), new).otherwise(value) if rule.guard else new)
    return df


def synonym_classes(pairs: DataFrame) -> DataFrame:
    """(name, canonical) of all names in ``pairs`` (name, other): names joined by any chain of pairs are one class.

    The canonical name is the smallest of those that never stand as ``name``,
    so chains end at their last link; in a class without one, the smallest of
    all. Pairs with a null are ignored; repeated pairs and loops do no harm.
    """
    known = pairs.select(F.col("name"), F.col("other")).where("name is not null and other is not null")
    classes = connected_components(known, src="name", dst="other")
    variants = known.where("name <> other").select(F.col("name").alias("node"), F.lit(True).alias("variant")).distinct()
    marked = classes.join(variants, "node", "left")
    heads = marked.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("variant").isNull(), F.col("node"))), F.min("node")).alias("canonical"))
    return classes.join(heads, "component").select(F.col("node").alias("name"), "canonical")


def resolve(df: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """df with each name of the column replaced by its class's canonical name; names without synonyms and nulls stay."""
    classes = synonym_classes(pairs).select(F.col("name").alias("__name"), F.col("canonical").alias("__canonical"))
    return df.join(classes, F.col(column) == F.col("__name"), "left").withColumn(column, F.coalesce("__canonical", column)).drop("__name", "__canonical")


def subdivisions(df: DataFrame, column: str, *, strict_reference: bool = False) -> DataFrame:
    """df with the subdivision names of the column in one form."""
    return resolve(apply_rules(df, column, subdivision_rules(strict_reference=strict_reference)), column, df.sparkSession.createDataFrame(SYNONYMS, "name string, other string"))


def older_names(df: DataFrame, column: str, section: str, *, strict_reference: bool = False) -> DataFrame:
    """df with the names of the older registry in one form; ``section``: the column that fills generic names. Rows of one name are one plot: dissolve them by it."""
    first = resolve(apply_rules(df, column, older_rules(section, strict_reference=strict_reference)), column, df.sparkSession.createDataFrame(OLDER_SYNONYMS, "name string, other string"))
    return apply_rules(first, column, condesa_rules(strict_reference=strict_reference))
