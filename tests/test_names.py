"""Rules for names, folding, synonyms, and flattening by schema, by hand."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from plotwise.operators import names
from plotwise.operators.names import Rule
from plotwise.sources import nested


def column(spark, values, rules):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.v for r in names.apply_rules(df, "v", rules).orderBy("i").collect()]


def test_order_of_rules(spark):
    rows = [(2, None, "text", "b", "c"), (1, "a", "text", "a", "b"), (3, "", "whole", "cc", None)]
    rules = names.rules_of(spark.createDataFrame(rows, "step int, guard string, kind string, pattern string, replacement string"))
    assert column(spark, ["ab", "a ", "xa", None, ""], rules) == [None, "c", "xa", None, ""]
    assert column(spark, ["ab"], [Rule("", "text", "b", "c"), Rule("a", "text", "a", "b")]) == ["bc"]
    assert column(spark, [" x"], []) == [" x"]
    with pytest.raises(ValueError, match="unknown kind"):
        column(spark, ["a"], [Rule("", "other")])


def test_subdivisions(spark):
    given = ["FRACCTO SAN MIGUEL", "FRACCIONAMIENTO VILLANOVA II", "X PORTICOS DEL VALLE 3", "LA RIOJA SECCION CASTILLAUNA", "FRACC FORESTA LIFE", "gran foresta", "COLONIA BALBUENA DE MEXICALI BC DENTRO DE LA", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    found = [r.v for r in names.subdivisions(df, "v").orderBy("i").collect()]
    assert found == ["san miguel", "villanova", "porticos del valle", "la rioja seccion castilla", "foresta residencial", "foresta residencial", "colonia balbuena", None]
    assert names.subdivisions(df, "v", strict_reference=True).where("i = 0").first().v == "to san miguel"


def test_older_names(spark):
    given = [("Fraccionamiento Corceles", None), ("LA CONDESA", "La Condesa Seccio0n Leganes"), ("quinta granada", "QUINTA GRANADA Tercera Etapa"), ("Fracc. Balbuena", "x"), (None, "Camino del Sol"), (None, None), ("La Condesa 5", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(given)], "i int, v string, s string")
    found = [r.v for r in names.older_names(df, "v", "s").orderBy("i").collect()]
    assert found == ["corceles residencial", "privadas condesa (leganés)", "quinta granada 3", "colonia balbuena", "caminos del sol", None, "privadas condesa 5"]
    assert names.older_names(df.where("i = 0"), "v", "s", strict_reference=True).first().v == "ionamiento corceles"
    with pytest.raises(Exception, match="unexpected name: privadas condesa 5"):
        names.older_names(df, "v", "s", strict_reference=True).collect()


def test_folding(spark):
    letters = [chr(c) for b in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in b if unicodedata.normalize("NFD", chr(c))[0].isascii() and len(chr(c).lower()) == 1]
    want = [unicodedata.normalize("NFD", c.lower())[0] for c in letters]
    assert column(spark, letters, [Rule("", "fold")]) == want
    assert column(spark, ["Łódź Straße", "été", "Ærø", "Москва", "北京"], [Rule("", "fold")]) == ["lodz strasse", "ete", "aero", "москва", "北京"]


def test_synonyms(spark):
    pairs = [("a", "b"), ("b", "c"), ("d", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("s", "s"), (None, "q"), ("q", None)]
    known = spark.createDataFrame(pairs, "name string, other string")
    assert {r.name: r.canonical for r in names.synonym_classes(known).collect()} == {"a": "c", "b": "c", "c": "c", "d": "c", "x": "x", "y": "x", "s": "s"}
    df = spark.createDataFrame([("a", 1), ("a", 2), ("zz", 3), (None, 4)], "v string, canonical int")
    assert sorted((r.canonical, r.v) for r in names.resolve(df, "v", known).collect()) == [(1, "c"), (2, "c"), (3, "zz"), (4, None)]
    assert names.synonym_classes(known.where("false")).count() == 0
    assert names.resolve(df, "v", known.where("false")).count() == 4


def test_short_names():
    assert nested.short_names([("a", "name"), ("b", "Name"), ("b", "x y")]) == ["a_name", "b_Name", "x_y"]
    assert nested.short_names([("name",), ("a", "name"), ("b", "a", "name")]) == ["name", "a_name", "b_a_name"]
    assert nested.short_names([("a-b",), ("a_b",), ("A b",)]) == ["a_b", "a_b_2", "A_b_3"]


def test_flatten(spark):
    schema = "id int, item struct<id: int, poi: struct<name: string, tags: array<string>>>, results array<struct<name: string, parts: array<struct<k: int>>>>, side array<struct<w: int>>"
    rows = [
        (1, (10, ("p", ["t"])), [("a", [(1,), (2,)]), ("b", [])], [(7,)]),
        (2, None, [], None),
        (3, (30, None), None, [(8,), (9,)]),
        (4, (40, ("q", None)), [(None, None)], []),
    ]
    flat = nested.flatten(spark.createDataFrame(rows, schema))
    assert flat.columns == ["id", "item_id", "poi_name", "tags", "results_name", "k", "w"]
    found = sorted([tuple(r) for r in flat.collect()], key=str)
    assert found == sorted(
        [
            (1, 10, "p", ["t"], "a", 1, 7), (1, 10, "p", ["t"], "a", 2, 7), (1, 10, "p", ["t"], "b", None, None),
            (2, None, None, None, None, None, None),
            (3, 30, None, None, None, None, 8), (3, 30, None, None, None, None, 9),
            (4, 40, "q", None, None, None, None),
        ],
        key=str,
    )
    assert "Exchange" not in flat._jdf.queryExecution().toString()
    empty = nested.flatten(spark.createDataFrame([], schema))
    assert empty.columns == flat.columns and empty.count() == 0
    same = nested.flatten(spark.createDataFrame([(1, (2,))], "a_b int, a struct<b: int>").select(F.col("a_b"), "a"))
    assert [tuple(r) for r in same.collect()] == [(1, 2)] and len(set(same.columns)) == 2
