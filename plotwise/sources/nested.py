"""Nested responses as flat tables, by their schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.clean import safe_name


def short_names(paths: list[tuple[str, ...]]) -> list[str]:
    """For each path of field names the shortest end of it, joined by _, that no other path shares; names count as equal in any case.

    Characters that a column's name shouldn't have become _. Where whole paths
    coincide, the later ones get a number.
    """
    ends = [["_".join(safe_name(p) for p in path[-n:]) for n in range(1, len(path) + 1)] for path in paths]
    width = [1] * len(paths)
    names = [e[0] for e in ends]
    while True:
        shared: dict[str, list[int]] = {}
        for i, name in enumerate(names):
            shared.setdefault(name.lower(), []).append(i)
        longer = [i for group in shared.values() if len(group) > 1 for i in group if width[i] < len(ends[i])]
        if not longer:
            break
        for i in longer:
            width[i] += 1
            names[i] = ends[i][width[i] - 1]
    taken: set[str] = set()
    for i, name in enumerate(names):
        n = 1
        while names[i].lower() in taken:
            n += 1
            names[i] = f"{name}_{n}"
        taken.add(names[i].lower())
    return names


def flatten(df: DataFrame) -> DataFrame:
    """df with the fields of all structs as columns and a row for each item of arrays of structs, to any depth.

    Which columns there are follows from the schema alone, so fields that are
    missing in some rows, or in all, are null there. Arrays of structs that
    stand side by side go by position (the shorter is filled with nulls), so
    rows don't multiply. A null or empty array gives one row with nulls. Maps
    and arrays of anything else stay as they are; a struct without fields goes.
    Names are those of :func:`short_names`. Each level is one projection or
    explode; nothing is shuffled.
    """
    path = {f"f{i}": (name,) for i, name in enumerate(df.columns)}
    flat = df.toDF(*path)
    while True:
        structs = {f.name: f.dataType.names for f in flat.schema if isinstance(f.dataType, StructType)}
        lists = [f.name for f in flat.schema if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)]
        if structs:
            columns, paths = [], {}
            for c in flat.columns:
                if c not in structs:
                    columns.append(F.col(c))
                    paths[c] = path[c]
                    continue
                for i, field in enumerate(structs[c]):
                    columns.append(F.col(c)[field].alias(f"{c}_{i}"))
                    paths[f"{c}_{i}"] = (*path[c], field)
            flat, path = flat.select(*columns), paths
        elif lists:
            # A null array would make the whole list of tuples null.
            whole = [F.coalesce(F.col(c), F.array().cast(flat.schema[c].dataType)).alias(c) for c in lists]
            rest = [c for c in flat.columns if c not in lists]
            items = flat.select(*rest, F.explode_outer(F.arrays_zip(*whole)).alias("__item"))
            order = [F.col("__item")[c].alias(c) if c in lists else F.col(c) for c in flat.columns]
            flat = items.select(*order)
        else:
            return flat.toDF(*short_names([path[c] for c in flat.columns]))
