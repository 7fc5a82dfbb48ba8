"""Column expressions that clean registry text, dates and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Approximate workers of each size class.
WORKERS = {
    "0 a 5 personas": 3,
    "6 a 10 personas": 8,
    "11 a 30 personas": 20,
    "31 a 50 personas": 40,
    "51 a 100 personas": 75,
    "101 a 250 personas": 175,
    "251 y m?s personas": 500,
    "251 y mas personas": 500,
    "251 y más personas": 500,
}

# Sectors, the prefix of their columns and the code prefixes they cover.
SECTORS = (
    ("manufacturing", "mfg", ("31", "32", "33")),
    ("construction", "construction", ("23",)),
    ("logistics", "logistics", ("48", "49")),
    ("commerce", "commerce", ("43", "46")),
    ("business_services", "business_services", ("51", "52", "53", "54", "55", "56")),
    ("care_education_health", "care_education_health", ("61", "62")),
    ("local_services", "local_services", ("71", "72", "81")),
    ("public_admin", "public_admin", ("92",)),
)

# Amenity types by activity code, in order; a later rule overrides an earlier one.
AMENITIES = (
    ("Consultorios médicos", "^621"),
    ("Hospital general", "^622"),
    ("Farmacia", "^46411"),
    ("Cine", "^51213"),
    ("Otros servicios recreativos", "^(71399|712|713)"),
    ("Clubs deportivos y de acondicionamiento físico", "^(71391|71394)"),
    ("Guarderia", "^6244"),
    ("Educación preescolar", "^61111"),
    ("Educación primaria", "^61112"),
    ("Educación secundaria", "^(61113|61114)"),
    ("Educación media superior", "^(61115|61116)"),
    ("Educación superior", "^(6112|6113)"),
)

# How many people an amenity of each type can attend, its radius in metres and its weight.
ATTRACTION = {
    "Hospital general": ("num_workers * 20", 5000, 0.1),
    "Consultorios médicos": ("num_workers * 2 * 8", 2000, 0.05),
    "Farmacia": ("num_workers * 10 * 12", 1000, 0.05),
    "Parques recreativos": ("area / 30 * 2", 3000, 0.05),
    "Clubs deportivos y de acondicionamiento físico": ("num_workers * 50", 2000, 0.05),
    "Cine": ("num_workers / 5 * 5 * 25", 5000, 0.03),
    "Otros servicios recreativos": ("num_workers * 200 / 7", 3000, 0.02),
    "Guarderia": ("num_workers * 8", 3000, 0.05),
    "Educación preescolar": ("num_workers * 20", 3000, 0.15),
    "Educación primaria": ("num_workers * 30", 3000, 0.15),
    "Educación secundaria": ("num_workers * 30", 3000, 0.15),
    "Educación media superior": ("num_workers * 30", 3000, 0.15),
    "Educación superior": ("num_workers * 40", 3000, 0.15),
}

# Whom an amenity of each type serves, as an expression over the columns of a census.
SERVED = {
    "Hospital general": "POBTOT",
    "Consultorios médicos": "POBTOT",
    "Farmacia": "POBTOT",
    "Parques recreativos": "POBTOT",
    "Clubs deportivos y de acondicionamiento físico": "P_12A14 + POB15_64",
    "Cine": "POBTOT",
    "Otros servicios recreativos": "P_12A14 + POB15_64",
    "Guarderia": "P_0A2 + P_3A5",
    "Educación preescolar": "P_3A5",
    "Educación primaria": "P_6A11",
    "Educación secundaria": "P_12A14",
    "Educación media superior": "P_15A17",
    "Educación superior": "P_18A24",
}

ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def excel_date(serial: Column) -> Column:
    """The date of a spreadsheet's serial day number."""
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))


def yes_flag(value: Column, *, strict: bool = False) -> Column:
    """1 for 'sí' in any case, else 0; null counts as 0 unless strict."""
    said = F.lower(value) == "sí"
    return said.cast("int") if strict else F.when(said, 1).otherwise(0)


def fold(value: Column) -> Column:
    """Small letters without accents; characters that stay outside ASCII go."""
    return F.regexp_replace(F.translate(F.replace(F.lower(value), F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def normalize_address(value: Column) -> Column:
    """A folded address without the words for a subdivision."""
    return F.trim(F.replace(F.regexp_replace(fold(value), r"fracc(\.|ionamiento)?", ""), F.lit("desarrollo urbano"), F.lit("")))


def collapse_prefix(value: Column, prefix: str) -> Column:
    """Whatever begins with the prefix becomes the prefix."""
    return F.when(value.startswith(prefix), F.lit(prefix)).otherwise(value)


def rewrite(value: Column, rules: list[tuple[str, str, dict[str, str] | str]]) -> Column:
    """The first rule that matches rewrites a text: (kind, pattern, what). Kind is prefix or contains; a dict replaces parts, a string replaces all."""
    out = None
    for kind, pattern, what in rules:
        test = value.startswith(pattern) if kind == "prefix" else value.contains(pattern)
        if isinstance(what, str):
            new = F.lit(what)
        else:
            new = value
            for a, b in what.items():
                new = F.replace(new, F.lit(a), F.lit(b))
        out = F.when(test, new) if out is None else out.when(test, new)
    return value if out is None else F.rtrim(out.otherwise(value))


def section_of(value: Column, rules: list[tuple[str, dict[str, str]]]) -> Column:
    """The private section in an address, by the first prefix that matches; null without one."""
    out = None
    for prefix, parts in rules:
        new = value
        for a, b in parts.items():
            new = F.replace(new, F.lit(a), F.lit(b))
        out = F.when(value.startswith(prefix), new) if out is None else out.when(value.startswith(prefix), new)
    return F.lit(None).cast("string") if out is None else out


def remove_label(value: Column, label: str) -> Column:
    return F.replace(value, F.lit(label), F.lit(""))


def workers(size_class: Column) -> Column:
    """Approximate workers of a size class; null for an unknown one."""
    entries = [x for k, v in WORKERS.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*entries)[size_class]


def classify(code: Column, rules: tuple[tuple[str, str], ...] = AMENITIES) -> Column:
    """The name of the last rule whose pattern matches the code; null if none does."""
    out = None
    for name, pattern in reversed(rules):
        test = code.rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(None).cast("string") if out is None else out


def formula_by_type(kind: Column, formulas: dict[str, str]) -> Column:
    """The value of the SQL expression that belongs to a row's type; null for other types."""
    out = None
    for name, expression in formulas.items():
        out = F.when(kind == name, F.expr(expression)) if out is None else out.when(kind == name, F.expr(expression))
    return F.lit(None).cast("double") if out is None else out


def restricted(access: Column) -> Column:
    """0 for LIBRE, 1 for RESTRINGIDO, else null."""
    return F.when(access == "LIBRE", 0).when(access == "RESTRINGIDO", 1)


def safe_identifier(value: Column) -> Column:
    """A text as a column name: letters, digits and underscores, none at the ends; v_ before a digit; 'unnamed' if nothing is left."""
    body = F.regexp_replace(F.regexp_replace(value, r"[^0-9A-Za-z_]+", "_"), r"^_+|_+$", "")
    return F.when(body == "", "unnamed").when(body.rlike(r"^[0-9]"), F.concat(F.lit("v_"), body)).otherwise(body)


def safe_name(value: str) -> str:
    """The same for a column's name on the driver."""
    import re

    body = re.sub(r"[^0-9A-Za-z_]+", "_", value).strip("_")
    return "unnamed" if not body else f"v_{body}" if body[0].isdigit() else body


def evidence(coefficient: Column, p_value: Column) -> Column:
    """A label from sign and p-value."""
    weight = F.when(p_value < 0.01, "strong").when(p_value < 0.05, "moderate").when(p_value < 0.1, "weak").otherwise("none")
    sign = F.when(coefficient > 0, "positive").when(coefficient < 0, "negative").otherwise("zero")
    return F.when(p_value.isNull() | coefficient.isNull(), "unknown").otherwise(F.concat_ws(" ", weight, sign))
