"""Whole results of queries that SQL cannot state, against plain versions."""

import difflib
import os

import pytest

from tidyward.plans.catalog import QUERIES
from tidyward.plans.catalog import geocoding as G
from tidyward.plans.inputs import Tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def column(tables, sql):
    return [r[0] for r in tables.sql(sql).collect()]


def closest(name, corpus, cutoff):
    found = difflib.get_close_matches(name, corpus, n=1, cutoff=cutoff) if name else []
    return found[0] if found else None


def registry(tables):
    """name -> (code, seq) of the registry."""
    out = {}
    for r in sorted(tables.sql(G._REGISTRY).collect(), key=lambda r: r["seq"]):
        try:
            code = float(r["code"])
        except (TypeError, ValueError):
            continue
        if code > 0:
            name = r["name"].strip()
            out[name] = (int(code), out.get(name, (0, r["seq"]))[1])
    return out


def look_up(name, table, cutoff, least):
    """(official name, how) of a name: exact, by its set of words, by closeness."""
    if name in table:
        return name, "exact"
    words = set(name.split())
    if len(words) > 1:
        same = [n for n in table if set(n.split()) == words]
        if same:
            return min(same, key=lambda n: table[n][1]), "words"
    best = closest(name, list(table), cutoff) if len(name) >= least else None
    return best and (best, "close")


@pytest.mark.parametrize("name,asked,corpus,cutoff", [
    ("close_names", G._MISSPELT, "SELECT DISTINCT p_name FROM {part}", 0.78),
    ("close_articles", G.MISTYPED, G.ARTICLES, 0.85)])
def test_close_names(spark, tables, name, asked, corpus, cutoff):
    entries = column(tables, corpus)
    want = {n: closest(n, entries, cutoff) for n in set(column(tables, asked))}
    got = {r["name"]: r["match"] for r in QUERIES[name](spark, SF).collect()}
    assert got == {n: m for n, m in want.items() if m} and len(got) > 20


def test_registry(spark, tables):
    table = registry(tables)
    asked = set(column(tables, G._TWISTED)) | set(column(tables, G._MISSPELT))
    want = {n: look_up(n, table, 0.85, 3) for n in asked if n}
    got = {r["name"]: (r["official"], r["how"]) for r in QUERIES["registry_resolve_whole"](spark, SF).collect()}
    assert got == {n: m for n, m in want.items() if m}
    assert {how for _, how in got.values()} == {"exact", "words", "close"}
    codes = {r["name"]: r["code"] for r in QUERIES["registry_resolve_whole"](spark, SF).collect()}
    assert all(codes[n] == table[official][0] for n, (official, _) in got.items())


def test_variants_with_registry(spark, tables):
    table = registry(tables)
    rows = QUERIES["street_variants_whole"](spark, SF).collect()
    assert rows
    for r in rows:
        found = look_up(r["normalized"], table, 0.85, 3) or look_up(r["canonical"], table, 0.85, 3)
        assert r["registry_match"] == (found and found[0])
        assert r["spellings"] == len(r["variants"]) + 1 and (
            r["spellings"] > 1 or r["registry_match"] not in (None, r["canonical"]))


@pytest.mark.parametrize("name", ["layer_rescue", "local_pass"])
def test_part_of_the_whole(spark, name):
    """The query with an oracle returns every row of the operator, in fewer columns."""
    part, whole = QUERIES[name](spark, SF), QUERIES[f"{name}_whole"](spark, SF)
    assert set(part.columns) <= set(whole.columns)
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.select(*part.columns).collect()))
