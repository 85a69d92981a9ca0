"""Steps that must not broadcast, repeat or carry more than they need."""

import datetime
import random

import pytest

from tidyward.operators import answers as A
from tidyward.operators.clean import clean
from tidyward.plans import inputs
from tidyward.plans.catalog import QUERIES
from tidyward.session import cut, stored
from tidyward.sources import writers as WR


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_beyond_the_limit_are_not_broadcast(spark, frame, monkeypatch):
    plans = []

    def seen(df):
        plans.append(plan(df))
        return cut(df)

    monkeypatch.setattr(A, "fits", lambda *_: False)
    monkeypatch.setattr(A, "cut", seen)
    monkeypatch.setattr(A, "pinned", lambda df: seen(df), raising=False)
    rows = frame([("a", "red lamp broken"), ("a", "lamp"), ("b", "lamp"), ("a", None), (None, "lamp")],
                 "category string, description string")
    terms = frame([(3, "a", "lamp", "x"), (1, "a", "red", "y"), (2, "a", "zzz", "z"), (1, "b", "red", "w")],
                  "seq long, category string, term string, answer string")
    hits = A.term_hits(rows, terms)
    plans.append(plan(hits))
    assert not [p for p in plans if "Broadcast" in p]
    assert sorted(map(tuple, hits.collect())) == [("a", "lamp", "x"), ("a", "red lamp broken", "y")]


def test_overrides_that_change_nothing_are_left_out_early(frame):
    names = ["ticket", "category", "responsibility", "street", "house", "category_source", "resp_source", "confidence"]
    rows = frame([("1", *"abcdefg"), ("2", *"abcdefg"), (None, *"abcdefg")], ", ".join(f"{n} string" for n in names))
    given = frame([(1, " 1 ", "street", "s1"), (2, "1", "street", ""), (3, "1", "other", "o"), (4, " ", "house", "h"),
                   (5, None, "house", "h"), (6, "2", "review", None), (7, "2", "house", None), (0, "1", "street", "s0")],
                  "seq int, ticket string, field string, value string")
    found = A.apply_overrides(rows, given)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    # the condition on the fields stands below the grouping of tickets
    assert "field" in text[text.rindex("Filter "):].split("\n")[0] or "review" in text.split("Aggregate", 1)[1].split("Filter", 1)[1]
    got = {r["ticket"]: (r["street"], r["house"], r["resp_source"], r["confidence"]) for r in found.collect()}
    assert got == {"1": ("s1", "d", "f", "g"), "2": ("c", "d", "manual_review", "low"), None: ("c", "d", "f", "g")}


def test_readers_of_cleaned_rows_read_their_columns(frame):
    raw = frame([("1", datetime.datetime(2024, 1, 2), "t", "s", "d", "open", "x", "Main 1")],
                "ticket string, opened_at timestamp, topic string, subtopic string, description string, status string, "
                "department string, raw_address string")
    done = clean(raw)
    assert "confidence_details" not in plan(done.select("ticket"))
    assert done.count() == 1


def test_an_export_makes_its_rows_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, i % 3, "O", 1.0, datetime.datetime(2024, 1, 1 + i % 20), "1-URGENT") for i in range(60)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, f"street {i}", "Brand#1", "LARGE", 3 + i, 1.0) for i in range(3)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
                          "p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    real, plans = WR.write_export, {}

    def seen(tables, *rest):
        plans.update({name: plan(table) for name, table in tables.items()})
        return real(tables, *rest)

    monkeypatch.setattr(WR, "write_export", seen)
    assert QUERIES["published_review"](spark, str(tmp_path)).count() == 60
    assert len(plans) == 5 and not [name for name, p in plans.items() if "Window" in p or "orders" in p]


def plain_hits(rows, terms):
    """The smallest (seq, term, answer) of each row's terms, by plain search."""
    want = {}
    for c, d in set(rows):
        hit = [(s, t, a) for s, k, t, a in terms if c is not None and c == k and t and d and t in d]
        if hit:
            want[c, d] = min(hit)[2]
    return want


def test_only_stretches_that_may_be_terms_are_rows(frame, monkeypatch):
    """Terms that stand in no text, of all lengths, and texts that share most of their letters with them."""
    rng, seen = random.Random(7), []
    number = lambda: f"{rng.randint(1, 90)}-{rng.randint(1, 9999)}"                         # noqa: E731
    rows = [("x", f"{rng.randint(1, 9)}7{number()} lamp") for _ in range(1500)] + [("y", "lamp"), ("x", "lamp")] * 20
    terms = [(i, "x", number(), f"a{i}") for i in range(3000)] + [(i, "y", number(), "b") for i in range(50)]

    def kept(df):
        out = stored(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(A, "CARRIED", 0, raising=False)
    monkeypatch.setattr(A, "stored", kept, raising=False)
    got = A.term_hits(frame(rows, "category string, description string"),
                      frame(terms, "seq int, category string, term string, answer string")).collect()
    want = plain_hits(rows, terms)
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want) > 5
    true = sum(t in d for c, d in set(rows) for _, k, t, _ in terms if c == k)
    assert len(seen) == 1 and seen[0] < 2 * true + 50


@pytest.mark.parametrize("carried", [0, 40, 10_000])
def test_terms_of_all_lengths(frame, monkeypatch, carried):
    """Long terms, ends and starts of texts, letters of several bytes, no seq, repeated terms."""
    rng = random.Random(carried)
    word = lambda n: "".join(rng.choice("ab כל.😀\n") for _ in range(n))                   # noqa: E731
    rows = [(rng.choice(["x", "y"]), word(rng.randint(1, 90))) for _ in range(120)]
    cuts = [(c, d, i, i + rng.randint(1, 80)) for c, d in rows for i in [rng.randrange(len(d))]]
    terms = [(rng.randrange(50), rng.choice([c, "x"]), d[i:j], f"a{n}") for n, (c, d, i, j) in enumerate(cuts)]
    terms += [(s + 1, c, t, a + "z") for s, c, t, a in terms[:60]] + [(1, "y", word(70), "no"), (2, "z", "a", "no")]
    monkeypatch.setattr(A, "CARRIED", carried, raising=False)
    of = lambda t: frame(t, "seq int, category string, term string, answer string")       # noqa: E731
    got = A.term_hits(frame(rows, "category string, description string"), of(terms)).collect()
    want = plain_hits(rows, terms)
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want) > 100
    # no seq comes before any, and of equal ones the term counts, then the answer; null answers first
    got = A.term_hits(frame([("x", "abc")], "category string, description string"),
                      of([(1, "x", "a", "p"), (None, "x", "c", "q"), (None, "x", "bc", "s"), (None, "x", "bc", None)])).collect()
    assert [tuple(r) for r in got] == [("x", "abc", None)]


def test_a_large_file_is_not_shuffled(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(1)
    table = pa.table({"k": [rng.getrandbits(60) for _ in range(40_000)]})
    pq.write_table(table, f"{tmp_path}/pieces.parquet", row_group_size=1000)
    pq.write_table(table, f"{tmp_path}/whole.parquet", row_group_size=40_000)
    conf = {"spark.sql.files.maxPartitionBytes": "32768", "spark.sql.files.openCostInBytes": "1024"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        many, one = (inputs.spread(spark.read.parquet(f"{tmp_path}/{n}.parquet")) for n in ("pieces", "whole"))
        assert "Exchange" not in plan(many) and "Exchange" in plan(one)
        assert many.count() == one.count() == 40_000
    finally:
        for k in conf:
            spark.conf.unset(k)
