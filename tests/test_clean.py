"""Cleaning, recurrence, context, auto-fix and answers."""

import collections
import datetime as dt
import random

from tidyward.operators.answers import apply_answers, parse_coordinate_lines, term_hits
from tidyward.operators.clean import clean, cleaning_stats
from tidyward.operators.ordered import recurrence, sequence_in_group
from tidyward.operators.resolve import auto_fix, resolve_from_context
from tidyward.schema import CLEAN_COLUMNS, RAW_COMPLAINTS


def raw(frame, rows):
    full = [dict(dict(ticket="1", opened_at=dt.datetime(2026, 1, 4, 9), raw_address="הרצל 5",
                      topic="ניקיון", subtopic="רחוב מלוכלך", description="", status="פתוח",
                      department="תברואה"), **r) for r in rows]
    return frame([tuple(r[f.name] for f in RAW_COMPLAINTS) for r in full], RAW_COMPLAINTS)


def test_columns_and_closed_sets(frame):
    out = clean(raw(frame, [
        {"ticket": "1-ב", "description": "שברו את הפח", "subtopic": "כלי אצירה פגומים"},
        {"ticket": "2", "subtopic": "", "topic": "אחר"},
        {"ticket": "3", "subtopic": "משהו", "opened_at": None, "raw_address": ""},
        {"ticket": "4", "subtopic": "אשפה מפוזרת לאחר פינוי ", "description": "052-1234567 צרו קשר"},
    ]))
    assert out.columns == CLEAN_COLUMNS
    r = {x["ticket"]: x for x in out.collect()}
    assert (r["1"]["ticket_suffix"], r["1"]["responsibility"], r["1"]["resp_source"]) == \
        ("ב", "עירייה", "keyword:עירייה")
    assert (r["2"]["category"], r["2"]["category_source"]) == ("לא מסווג", "topic_fallback")
    assert (r["3"]["category"], r["3"]["category_source"], r["3"]["date"], r["3"]["confidence"]) == \
        ("משהו", "passthrough", None, "low")
    assert (r["4"]["category"], r["4"]["wants_callback"], r["4"]["has_personal_info"]) == \
        ("תלונה על ביצוע הפינוי", 1, 1)
    assert r["1"]["weekday"] == "ראשון"


def test_stats(frame):
    s = cleaning_stats(clean(raw(frame, [{"ticket": str(i)} for i in range(4)]))).first()
    assert (s["rows"], s["recurring_rate"], s["unknown_resp_rate"]) == (4, 75.0, 100.0)


def _numbers(rows):
    seen, out = collections.Counter(), {}
    for k, o, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[2])):
        seen[k] += 1
        out[t] = seen[k]
    return out


def test_hot_groups_number_the_same_as_plain_ones(frame):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(20), i) for i in range(3000)]
    df = frame(rows, "k string, o int, t int").repartition(5)
    want = {**{t: None for k, _, t in rows if k is None}, **_numbers(rows)}
    for hot in (None, 100, 10_000):
        got = sequence_in_group(df, ["k"], ["o", "t"], "n", hot_rows=hot, slices=16)
        assert got.count() == len(rows)
        assert {r["t"]: r["n"] for r in got.collect()} == want


def test_recurrence_skips_null_keys(frame):
    df = frame([("s", "1", 1), ("s", "1", 2), (None, "1", 3), (None, "1", 4)],
               "street string, house string, o int")
    out = recurrence(df, ["street", "house"], ["o"]).orderBy("o").collect()
    assert [(r["recurrence_no"], r["is_recurring"]) for r in out] == \
        [(1, 0), (2, 1), (None, 0), (None, 0)]


def test_result_does_not_depend_on_partitions(frame):
    rows = raw(frame, [{"ticket": str(i), "raw_address": f"הרצל {i % 3}"} for i in range(40)])
    one = sorted(map(str, clean(rows.coalesce(1)).collect()))
    assert one == sorted(map(str, clean(rows.repartition(8)).collect()))


def test_context(frame):
    out = resolve_from_context(clean(raw(frame, [
        {"ticket": "1", "subtopic": "פח שנעלם", "status": "טופל"},
        {"ticket": "2", "raw_address": "חוף הים", "description": "חול בכל מקום"},
        {"ticket": "3", "raw_address": "הרצל 1", "description": "סתם"},
    ]))).collect()
    r = {x["ticket"]: x for x in out}
    assert (r["1"]["responsibility"], r["1"]["resp_source"], r["1"]["confidence"]) == \
        ("עירייה", "context_resolve", "medium")
    assert r["2"]["responsibility"] == "טבעי"
    assert r["3"]["resp_source"] == "unresolved"


def test_auto_fix(frame):
    rows = clean(raw(frame, [
        {"ticket": "1", "raw_address": "10(בית הראשונים)"},
        {"ticket": "2", "raw_address": "(גינת כיבוש)"},
        {"ticket": "3", "raw_address": "מקום רע"},
        {"ticket": "4", "raw_address": "הרצל 5"},
    ]))
    known = frame([("מקום רע",)], "name string")
    r = {x["ticket"]: x for x in auto_fix(rows, known).collect()}
    assert (r["2"]["street"], r["2"]["loc_type"]) == ("גינת כיבוש", "ציון דרך")
    assert r["3"]["loc_type"] == "ציון דרך"
    assert (r["4"]["street"], r["4"]["house"], r["4"]["loc_type"]) == ("הרצל", "5", "כתובת")


def test_answers(frame):
    rows = clean(raw(frame, [
        {"ticket": "1", "description": "ריח רע"}, {"ticket": "2", "description": "כתם"},
        {"ticket": "3", "subtopic": "חדש"}, {"ticket": "4", "description": "שברו"},
    ]))
    answers = frame([
        (1, "resp_term", "משטח מלוכלך", "ריח", "טבעי"),
        (2, "resp_default", "משטח מלוכלך", None, "עירייה"),
        (3, "subtopic", None, "חדש", "פגר"),
        (4, "street", None, "הרצל", "הרצל בנימין"),
        (5, "resp_default", "פגר", None, "__skip__"),
    ], "seq int, kind string, category string, term string, answer string")
    r = {x["ticket"]: x for x in apply_answers(rows, answers).collect()}
    assert (r["1"]["responsibility"], r["1"]["resp_source"], r["1"]["confidence"]) == \
        ("טבעי", "user_resp_term", "high")
    assert (r["2"]["responsibility"], r["2"]["resp_source"]) == ("עירייה", "user_resp_default")
    assert (r["3"]["category"], r["3"]["category_source"], r["3"]["resp_source"]) == \
        ("פגר", "user_map", "map")
    assert r["4"]["resp_source"] == "keyword:עירייה"
    assert all(x["street"] == "הרצל בנימין" for x in r.values())


def test_term_hits_equal_a_plain_search(frame):
    import random
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choice("abכ\n. 😀") for _ in range(rng.randint(a, b)))
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, "", word(1, 12), word(3, 40)])) for _ in range(300)]
    rows += [("x", "one text for many rows abכ")] * 50
    terms = [(i % 40, rng.choice(["x", "x", "y", "z", None]), rng.choice([None, "", word(1, 2), word(3, 7)]), f"a{i}")
             for i in range(150)]
    # of one term's answers that of the smallest seq counts, then the smallest
    want = {}
    for c, d in set(rows):
        hit = [(s, t, a) for s, k, t, a in terms if c is not None and c == k and t and d and t in d]
        if hit:
            want[c, d] = min(hit)[2]
    got = term_hits(frame(rows, "category string, description string"),
                    frame(terms, "seq int, category string, term string, answer string")).collect()
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want) > 20
    none = frame([], "seq int, category string, term string, answer string")
    assert term_hits(frame(rows, "category string, description string"), none).count() == 0


def test_large_answer_tables_join_the_same(frame, monkeypatch):
    from tidyward import session
    from tidyward.operators import answers as A
    monkeypatch.setattr(A, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(session.broadcast_within, "__defaults__", (-1,))
    monkeypatch.setattr(A, "fits", lambda table: False)
    test_answers(frame)
    test_term_hits_equal_a_plain_search(frame)


def test_coordinate_lines(frame):
    df = frame([(1, "5,32.1,34.8"), (2, "5, 32.2 ,34.9"), (3, "6,x,34"), (4, "7,1"), (5, "")],
               "line_no int, line string")
    assert [tuple(r) for r in parse_coordinate_lines(df).collect()] == [("5", 32.2, 34.9)]
