"""Repeated and blank tickets, hot keys, and texts past the old limits."""

from pyspark.sql import functions as F

from tidyward.functions import text as T
from tidyward.operators import answers as AN
from tidyward.operators import audit as AU
from tidyward.operators.ordered import sequence_in_group
from tidyward.operators.patterns import pattern_groups, responsibility_clusters


def test_one_key_on_all_rows_is_numbered(frame):
    df = frame([("k", i % 7, i) for i in range(3000)], "k string, o int, t int")
    out = sequence_in_group(df, ["k"], ["o", "t"], "n").orderBy("o", "t").collect()
    assert [r["n"] for r in out] == list(range(1, 3001))


def test_name_with_many_numbers_is_bared(frame):
    df = frame([("רחוב הרצל " + " ".join(str(i) for i in range(1, 13)) + ", - ",)], "s string")
    assert df.select(T.bare_street("s").alias("s")).first()["s"] == "הרצל"


def test_audit_of_repeated_and_blank_tickets(frame):
    schema = "ticket string, status string"
    before = frame([("", "a")] * 100 + [("1", "a"), ("2", "a"), ("2", "b"), (None, "a")], schema)
    after = frame([("", "a")] * 100 + [("1", "b"), ("2", "c"), (None, "b")], schema)
    out = AU.change_entries(before, after, ["status"], "manual", "r", "t") if "manual" in AU.R.AUDIT_SOURCES \
        else AU.change_entries(before, after, ["status"], sorted(AU.R.AUDIT_SOURCES)[0], "r", "t")
    assert [(r["ticket"], r["old"], r["new"]) for r in out.collect()] == [("1", "a", "b")]
    assert {(r["ticket"], r["rows"]) for r in AU.repeated_keys(before).collect()} == {("", 101), ("2", 2)}


def test_last_of_several_edits_counts(frame):
    df = frame([("1", "32.1", "34.8", "x", "1", None, None), ("", None, None, "y", "2", None, None)],
               "ticket string, lat string, lon string, street string, house string, "
               "geocode_method string, precision string")
    edits = frame([(1, "1", "32.2", "34.9", "a", "3"), (2, "1", None, None, "b", "4"), (3, "", None, None, "z", "9")],
                  "seq int, ticket string, lat string, lon string, street string, house string")
    out = {r["ticket"]: r for r in AN.apply_manual_edits(df, edits).collect()}
    assert len(out) == 2 and out["1"]["street"] == "b" and out[""]["street"] == "y"


def test_groups_count_rows_not_tickets(frame):
    rows = [("c", None if i % 2 else str(i), "red apple" if i < 20 else "blue bird") for i in range(40)]
    df = frame(rows, "g string, ticket string, text string")
    minimum = frame([("c", 5)], "g string, min_rows long")
    groups, taken = pattern_groups(df, "g", "ticket", "text", minimum, letters="a-z", stop_words=[])
    assert sorted((r["term"], r["rows"]) for r in groups.collect()) == [("blue bird", 20), ("red apple", 20)]
    assert taken.count() == 40


def test_clusters_leave_no_remainder_when_tickets_are_blank(frame):
    from tidyward import rules as R
    category = sorted(R.MUNICIPAL.ambiguous)[0]
    rows = [(category, None if i % 2 else "7", "ריח חזק" if i < 20 else "פח שבור", "unresolved") for i in range(40)]
    df = frame(rows, "category string, ticket string, description string, resp_source string")
    cats, groups = responsibility_clusters(df)
    assert [(r["total"], r["unresolved"], r["remainder"]) for r in cats.collect()] == [(40, 40, 0)]
    assert sorted(r["rows"] for r in groups.collect()) == [20, 20]
    assert all(len(r["samples"]) <= 4 for r in groups.collect()) and F
