"""Flags, sampling, comparison, audit and phrases."""

import collections
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidyward import rules as R
from tidyward.operators import audit as AU
from tidyward.operators import flags as FL
from tidyward.operators import quality as Q
from tidyward.operators import report as RP
from tidyward.operators.compare import compare_tables
from tidyward.operators.patterns import pattern_groups
from tidyward.sources import readers as RD
from tidyward.sources import writers as WR

SCHEMA = ("ticket string, date string, street string, house string, loc_type string, lat double, "
          "lon double, geocode_method string, category string, status string")


def _rows(n=300):
    rng = random.Random(1)
    return [(rng.choice([str(i), "", None]) if i % 7 == 0 else str(i),
             rng.choice(["2026-01-05", "2025-01-01", "2027-01-01", None, "nan"]),
             rng.choice(["הרצל", "", None, "12", " "]), rng.choice(["5", "", None]),
             rng.choice(["כתובת", "ציון דרך", "ללא רחוב", "צומת", None]),
             rng.choice([None, 32.15, 32.5]), rng.choice([None, 34.785, 34.82]),
             rng.choice([None, "manual", "flagged_description"]),
             rng.choice(["פגר", "אחר", "", None]), rng.choice(["פתוח", "", None])) for i in range(n)]


def _naive(r, stage):
    blank = lambda v: v is None or v.strip().lower() in ("", "nan", "none")
    ticket, date, street, house, kind, lat, lon, method, cat, status = r
    has = lat is not None and lon is not None
    geo = stage != "clean"
    out = []
    if blank(date): out.append("no_date")
    if blank(ticket): out.append("no_id")
    if not blank(date) and date < "2025-06-01": out.append("date_early")
    if not blank(date) and date > "2026-12-31": out.append("date_late")
    if blank(street):
        out.append({"ללא רחוב": "addr_empty!", "ציון דרך": "addr_desc"}.get(
            kind, "addr_empty" + ("" if geo and has else "!")))
    elif street.strip().isdigit():
        out.append("addr_junk" + ("" if geo and has else "!"))
    if kind == "כתובת" and blank(house): out.append("no_house")
    if cat and cat not in R.RESPONSIBILITY: out.append("cat_unknown")
    if blank(status): out.append("no_status")
    if geo:
        inside = has and 32.14 <= lat <= 32.2 and 34.78 <= lon <= 34.87
        if not has and kind not in ("ציון דרך", "ללא רחוב") and method != "flagged_description":
            out.append("geo_fail!")
        if has and not inside: out.append("geo_outside")
        if inside and lon < 34.79: out.append("geo_sea")
    return out


@pytest.mark.parametrize("stage", ["clean", "geocode", "all"])
def test_flags_equal_a_row_loop(frame, stage):
    rows = _rows()
    out = FL.detect_flags(frame(rows, SCHEMA), "2025-06-01", "2026-12-31", stage)
    hard = {"no_date", "no_id"}
    got = [([f["code"] + ("!" if f["severity"] == "block" and f["code"] not in hard else "")
             for f in r["flags"]], r["flag_severity"], len(r["flag_labels"].split("; ")) if r["flag_labels"] else 0)
           for r in out.collect()]
    want = []
    for r in rows:
        codes = _naive(r, stage)
        block = any(c.endswith("!") or c in hard for c in codes)
        want.append((codes, "block" if block else "warn" if codes else "", len(codes)))
    assert got == want


def test_triage_partitions_the_table(frame):
    out = FL.detect_flags(frame(_rows(), SCHEMA), stage="all")
    summary = {r["triage"]: r["rows"] for r in FL.triage_summary(out).collect()}
    assert list(summary) == ["blocking", "review", "info", "clean"]
    assert sum(summary.values()) == out.count() and summary["info"] == 0
    assert summary["blocking"] == FL.triage_group(out, "blocking").count() == \
        FL.severity_counts(out).first()["blocking"]


def test_absent_columns_do_not_flag(frame):
    out = FL.detect_flags(frame([("1", "הרצל")], "ticket string, street string"))
    assert out.first()["flag_severity"] == ""


def test_fingerprint_follows_content_not_order(frame):
    rows = _rows(50)
    a = FL.content_fingerprint(frame(rows, SCHEMA))
    b = FL.content_fingerprint(frame(rows[::-1], SCHEMA).repartition(7))
    c = FL.content_fingerprint(frame([rows[1], *rows[1:]], SCHEMA))
    assert a.first() == b.first() != c.first()
    assert FL.needs_rerun(a, b).first()[0] is False
    assert FL.needs_rerun(a, c).first()[0] is True
    assert FL.needs_rerun(a, a.limit(0)).first()[0] is True


def test_sample_sizes_and_bad_rates():
    assert Q.full_size(0.05) == 47 and Q.full_size(1.0) == 3
    for bad in ((0, .1), (1.1, .1), (.1, 0), (.1, 1)):
        with pytest.raises(ValueError):
            Q.full_size(*bad)


def test_sampling_plan(frame):
    good = [(f"a{i}", "address", 32.15, 34.80, "x") for i in range(100)]
    bad = [(f"s{i}", "street", None, None, "x") for i in range(5)]
    out = {r["tier"]: r for r in Q.sampling_plan(frame(
        good + bad, "ticket string, precision string, lat double, lon double, street string")).collect()}
    assert (out["address"]["lot_size"], out["address"]["sample_n"], out["address"]["verdict"]) == (100, 47, R.ACCEPT)
    assert (out["street"]["sample_n"], out["street"]["defects"], out["street"]["defect_pct"]) == (5, 5, 100.0)
    whole = Q.sampling_plan(frame(good, "ticket string, p string, lat double, lon double, s string")).first()
    assert (whole["tier"], whole["sample_n"]) == ("(all)", 24)


def test_plan_tally_and_card(frame):
    rows = [(str(i), "map", "map") for i in range(60)] + [("x", None, "map"), ("y", "passthrough", "map")]
    plan = Q.sample_plan(frame(rows, "ticket string, category_source string, resp_source string"), Q.CLEAN_STRATA)
    got = plan.collect()
    assert [(r["lot_size"], r["sample_n"], len(r["sample_tickets"])) for r in got] == [(60, 47, 47), (2, 2, 2)]
    assert got[1]["stratum"] == Q.OTHER
    verdicts = frame([(got[0]["stratum"], i, v) for i, v in enumerate(["correct", "unsure", "wrong", "wrong"])]
                     + [(Q.OTHER, 0, "correct"), (Q.OTHER, 1, "correct")],
                     "stratum string, position int, verdict string")
    tally = Q.curtailed_tally(verdicts)
    assert {r["stratum"]: (r["reviewed"], r["defects"], r["verdict"]) for r in tally.collect()} == \
        {got[0]["stratum"]: (2, 1, "fail"), Q.OTHER: (2, 0, "pass")}
    card = Q.acceptance_card(plan, tally, "clean", "t")
    c = card.first()
    assert (c["passed"], c["total_lot"], c["total_reviewed"], c["total_defects"]) == (False, 62, 4, 1)
    assert [r["stratum"] for r in Q.card_rows(card).collect()] == [got[0]["stratum"], Q.OTHER, "סה״כ"]


def test_comparison(frame):
    a = frame([("1", "A ", 1.0), ("2", None, 2.0), ("3", "c", 3.0)], "ticket string, s string, n double")
    b = frame([("1", "a", 1.0), ("2", None, 5.0), ("9", "c", 3.0)], "ticket string, s string, n double")
    out = compare_tables(a, b)
    assert tuple(out["keys"].first()) == (2, 1, 1)
    assert {r["column"]: (r["agree"], r["differ"], r["missing"], r["agree_pct"]) for r in
            out["per_column"].collect()} == {"n": (1, 1, 0, 50.0), "s": (2, 0, 1, 100.0)}
    with pytest.raises(ValueError, match="repeated"):
        compare_tables(a.union(a), b)
    with pytest.raises(ValueError, match="no column"):
        compare_tables(a.drop("ticket"), b)


def test_audit_round_trip(frame, spark):
    a = frame([("1", "x", "p"), ("2", None, "q")], "ticket string, street string, house string")
    b = frame([("1", "y", "p"), ("2", "z", None)], "ticket string, street string, house string")
    path = tempfile.mkdtemp(prefix="tidyward-audit-") + "/log"
    WR.append_audit(AU.change_entries(a, b, ["street", "house"], "auto_fix", "run1", "2026-01-01"), path)
    WR.append_audit(AU.change_entries(a, b, ["house"], "waive", "run2", "2026-01-02"), path)
    batch = WR.append_audit(AU.change_entries(a, b, ["house"], "waive", "run2", "2026-01-02"), path)
    assert WR.append_audit(AU.change_entries(a, b, ["street"], "waive", "run3", "t"), path, batch) == batch
    with open(f"{path}/entries/batch={batch}/run_id=run2/bad.json", "w") as f:
        f.write("{not json\n")
    # a run that broke off before its marker: not seen, then written anew
    os.makedirs(f"{path}/entries/batch=late/run_id=run4")
    with open(f"{path}/entries/batch=late/run_id=run4/part.json", "w") as f:
        f.write('{"ticket":"9","field":"street"}\n')
    assert RD.read_audit(spark, path, "run4").count() == 0
    assert [tuple(r) for r in RD.read_audit_rejects(spark, path).collect()] == [(batch, "run2", "{not json")]
    got = {(r["ticket"], r["field"], r["old"], r["new"]) for r in RD.read_audit(spark, path, "run1").collect()}
    assert got == {("1", "street", "x", "y"), ("2", "street", "", "z"), ("2", "house", "q", "")}
    assert [(r["run_id"], r["entries"]) for r in RD.audit_runs(RD.read_audit(spark, path)).collect()] == \
        [("run2", 1), ("run1", 3)]
    late = AU.change_entries(a, b, ["street"], "waive", "run4", "2026-01-03")
    WR.append_audit(late, path, "late")
    assert {r["ticket"] for r in RD.read_audit(spark, path, "run4").collect()} == {"1", "2"}
    assert RD.read_audit(spark, path + "-none").count() == 0
    with pytest.raises(ValueError, match="batch id"):
        WR.append_audit(late, path, "../x")
    with pytest.raises(ValueError, match="source must"):
        WR.append_audit(late.withColumn("source", F.lit(None).cast("string")), path)
    with pytest.raises(ValueError):
        AU.change_entries(a, b, ["house"], "someone", "r", "t")


def test_provenance(frame):
    df = frame([("1", "map")], "ticket string, category_source string")
    assert AU.provenance_status(df) == ("partial", ["resp_source", "addr_route"])
    assert AU.provenance_status(df.drop("category_source"))[0] == "none"
    assert tuple(AU.provenance_counts(df).first()) == (1, None)


def test_readers(spark):
    folder = tempfile.mkdtemp(prefix="tidyward-read-")
    with open(folder + "/zones.csv", "w", encoding="utf-8-sig") as f:
        f.write("lat,lon,zone\n32.1,34.8,מרכז\n")
    assert [tuple(r)[1:] for r in RD.read_zone_reference(spark, folder + "/zones.csv").collect()] == \
        [(32.1, 34.8, "מרכז")]
    with open(folder + "/raw.csv", "w", encoding="utf-8-sig") as f:
        f.write("מס' פניה,תאריך ושעת פתיחה,כתובת ואתר/מוסד,תת נושא\n5,2026-01-01,הרצל 5,גראפיטי\n")
    row = RD.read_raw(spark, folder + "/raw.csv", "csv").first()
    assert (row["ticket"], row["raw_address"], row["subtopic"], row["status"]) == ("5", "הרצל 5", "גראפיטי", None)
    with open(folder + "/short.csv", "w") as f:
        f.write("ticket\n5\n")
    with pytest.raises(ValueError, match="opened_at"):
        RD.read_raw(spark, folder + "/short.csv", "csv")


def test_exports(frame, spark):
    flagged = FL.detect_flags(frame(_rows(40), SCHEMA).withColumns(
        {"confidence": F.lit("low"), "confidence_details": F.lit("d")}), stage="all")
    log = AU.correction_log(flagged)
    path = tempfile.mkdtemp(prefix="tidyward-out-")
    WR.write_export(WR.review_export(flagged, log), path)
    back = spark.read.parquet(path + "/rows")
    assert back.columns[:5] == RD.REVIEW_COLUMNS and back.count() == 40
    assert spark.read.parquet(path + "/summary").count() == 7
    assert not set(RD.REVIEW_COLUMNS) & set(RD.read_corrected(spark, path + "/rows").columns)


def test_published_runs_are_whole_or_absent(frame, spark):
    path = tempfile.mkdtemp(prefix="tidyward-out-")
    a, b = frame([(1, "x\ny")], "n int, s string"), frame([], "n int")
    for fmt in ("parquet", "csv"):
        WR.publish_export(spark, {"a": a, "b": b}, path, fmt, fmt)
        WR.publish_export(spark, {"a": a.union(a)}, path, fmt, fmt)      # a retry changes nothing
        back = RD.read_export(spark, path, fmt)
        assert set(back) == {"a", "b"} and back["b"].count() == 0
        assert [(str(r["n"]), r["s"]) for r in back["a"].collect()] == [("1", "x\ny")]
    WR.write_export({"a": a}, path + "/runs/broken")      # ended before its manifest
    with pytest.raises(FileNotFoundError):
        RD.read_export(spark, path, "broken")
    WR.publish_export(spark, {"a": b}, path, "broken")
    assert RD.read_export(spark, path, "broken")["a"].count() == 0
    with pytest.raises(ValueError):
        WR.publish_export(spark, {"a/b": a}, path, "r")


def test_search_is_literal(frame):
    df = frame([("a.b", 1), ("axb", 2)], "s string, n int")
    assert [r["n"] for r in RP.search(df, "A.B").collect()] == [1]
    assert len(RP.search(df, "a.b", pattern=True).collect()) == 2


def _greedy(texts, minimum, most):
    words = lambda t: t.split()
    uni, bi = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in enumerate(texts):
        w = words(t)
        for x in w: uni[x].add(i)
        for x in zip(w, w[1:]): bi[" ".join(x)].add(i)
    often = {b: r for b, r in bi.items() if len(r) >= minimum}
    covered = {w for b in often for w in b.split()}
    cand = [(-2 * len(r), b, r) for b, r in often.items()]
    cand += [(-len(r), u, r) for u, r in uni.items() if len(r) >= minimum and u not in covered]
    used, out = set(), []
    for _, term, r in sorted(cand, key=lambda c: c[:2]):
        if len(out) >= most:
            break
        free = r - used
        if len(free) >= minimum:
            out.append((term, len(free)))
            used |= free
    return out, used


def test_pattern_groups_equal_sequential_greedy(frame):
    rng = random.Random(8)
    words = ["אב", "גד", "הו", "זח", "טי", "כל", "מן", "סע"]
    rows = [(g, i, " ".join(rng.choice(words[: 4 + 2 * (g == "b")]) for _ in range(rng.randint(0, 5))))
            for g in "ab" for i in range(80)]
    df = frame(rows, "g string, id int, text string")
    minimum = frame([("a", 5), ("b", 7)], "g string, min_rows long")
    groups, assigned = pattern_groups(df, "g", "id", "text", minimum, 6, stop_words=())
    got = groups.orderBy("g", "position").collect()
    taken = assigned.collect()
    for g, m in (("a", 5), ("b", 7)):
        want, used = _greedy([t for gg, _, t in rows if gg == g], m, 6)
        assert [(r["term"], r["rows"]) for r in got if r["g"] == g] == want
        assert {r["id"] for r in taken if r["g"] == g} == used


def test_pattern_rounds_follow_chains_not_groups(frame, monkeypatch):
    """300 phrases that share no row are settled together, and so is a chain of candidates."""
    from tidyward.operators import patterns as P
    rounds = []
    real = P._union
    monkeypatch.setattr(P, "_union", lambda frames: rounds.append(len(frames)) or real(frames))
    letters = "אבגדהוזחטיכלמנסעפצקר"
    rows = [("a", 5 * i + k, letters[i // 20] + letters[i % 20] + "ת") for i in range(300) for k in range(5)]
    chain = ["שש תת"] * 3 + ["תת מם"] * 4 + ["מם נן"] * 5
    rows += [("b", 9000 + i, t) for i, t in enumerate(chain)]
    df = frame(rows, "g string, id int, text string")
    minimum = frame([("a", 3), ("b", 3)], "g string, min_rows long")
    groups, assigned = pattern_groups(df, "g", "id", "text", minimum, stop_words=())
    got = groups.orderBy("g", "position").collect()
    assert max(rounds) <= 2 and len(got) == 300 + 3 and assigned.count() == len(rows)
    want, _ = _greedy([t for g, _, t in rows if g == "b"], 3, 99)
    assert [(r["term"], r["rows"]) for r in got if r["g"] == "b"] == want
