"""Close matches and street-name resolution against plain statements."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tidyward.operators import streets as ST
from tidyward.session import cut
from tidyward.sources.readers import parse_corrections

LETTERS = "אבגדהו "


def _name(rng):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 11))).strip() or "א"


@pytest.mark.parametrize("cutoff", [0.6, 0.78, 0.85])
def test_close_matches_equal_the_standard_library(frame, cutoff):
    rng = random.Random(int(cutoff * 100))
    corpus = sorted({_name(rng) for _ in range(120)})
    names = sorted({_name(rng) for _ in range(60)} | {c[:-1] + "ו" for c in corpus[:40]} - {""})
    got = {r["name"]: r["match"] for r in ST.close_matches(
        frame([(n,) for n in names], "name string"),
        frame([(c,) for c in corpus], "name string"), cutoff).collect()}
    want = {}
    for n in names:
        best = difflib.get_close_matches(n, corpus, n=1, cutoff=cutoff)
        if best:
            want[n] = best[0]
    assert got == want
    assert want


REGISTRY = [("רובינא חנה", "10.0", 1), ("הרצל", "20", 2), ("הרצל", "21", 3), ("ויצמן", "0", 4),
            ("סוקולוב נחום", "x", 5), ("בן גוריון", "30", 6)]


@pytest.fixture
def registry(frame):
    return ST.registry_table(frame(REGISTRY, "name string, code string, seq long"))


def test_registry_keeps_positive_codes_and_the_last_row(registry):
    assert {r["name"]: r["code"] for r in registry.collect()} == \
        {"רובינא חנה": 10, "הרצל": 21, "בן גוריון": 30}


def test_registry_resolution(frame, registry):
    out = ST.resolve_registry(frame([(n,) for n in ["חנה רובינא", "הרצל", "בן גוריוןן", "זר", "הר"]],
                                    "name string"), registry)
    assert {r["name"]: (r["official"], r["code"], r["how"]) for r in out.collect()} == {
        "חנה רובינא": ("רובינא חנה", 10, "words"), "הרצל": ("הרצל", 21, "exact"),
        "בן גוריוןן": ("בן גוריון", 30, "close")}


DOC = '''{"אור חיים": {"status": "resolvable", "note": "", "nominatim": "אור החיים", "gis": "אור החיים"},
 "אלמוג": {"status": "resolvable", "note": "", "nominatim": null, "gis": "אלומות"},
 "פינה": {"status": "resolvable", "note": "description of", "nominatim": null, "gis": "__INTERSECTION__א__ב"},
 "רע": {"status": "unresolvable", "note": "", "nominatim": null, "gis": null}}'''


def test_forms_of_a_name(frame, registry):
    corrections = parse_corrections(frame([(DOC,)], "value string"))
    streets = frame([("אור החיים", 1, 1), ("אלומות", 2, 2), ("יגאל אלון", 3, 3), ("נורדאו", 4, 4),
                     ("פינסקר", 5, 5)], "name string, code int, seq long")
    asked = {"אור חיים": 1, "אלמוג": 2, "יגאל אלון סוקולוב": 3, "נורדאו 18 כניסה ב": 4,
             "פינסקר פ זבוטינסקי": 5, "נורדאו (מקלט)": 4, "נורדאו 5,7": 4, "אלון יגאל": 3,
             "נורדאו -מתחם א": 4, "חנה רובינא": 10, "xyzw": None}
    out = ST.resolve_street_codes(frame([(n,) for n in asked], "name string"), streets, registry,
                                  corrections)
    got = {r["name"]: r["code"] for r in out.collect()}
    assert got == {k: v for k, v in asked.items() if v is not None}


def test_layer_names(frame, registry):
    corrections = parse_corrections(frame([(DOC,)], "value string"))
    layer = frame([("אלומות",), ("רובינא חנה",), ("פינסקר",)], "name string")
    out = ST.resolve_layer_names(
        frame([(n,) for n in ["אלמוג", "חנה רובינא", "פינסקר ליד הבית", "פינה", "רע", "פינסק"]],
              "name string"), layer, registry, corrections)
    assert {r["name"]: r["layer_name"] for r in out.collect()} == {
        "אלמוג": "אלומות", "חנה רובינא": "רובינא חנה", "פינסקר ליד הבית": "פינסקר",
        "פינה": "__INTERSECTION__א__ב", "פינסק": "פינסקר"}


def test_variants(frame, registry):
    rows = [("רחוב הרצל 5", "a")] * 3 + [("הרצל", "b")] * 2 + [('הר"צל 7', "c")] * 2 + [("יחיד", "d")]
    out = ST.street_variants(frame(rows, "street string, raw_address string"), registry).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["canonical"], r["total"], r["registry_match"], r["samples"]) == \
        ("הרצל", 7, "הרצל", ["b"])
    assert [(v["spelling"], v["rows"]) for v in r["variants"]] == [('הר"צל', 2)]


def test_variants_are_not_cut(frame):
    rows = [(f"בן{i} גוריון{i}",) for i in range(40) for _ in range(4)] + [(f"הר{q}צל",) for q in ("", '"', "'", "״", "׳", "''", '""', "״״")]
    rows += [(f'בן{i} גו"ריון{i}',) for i in range(40)]
    out = {r["normalized"]: r for r in ST.street_variants(frame(rows, "street string")).collect()}
    assert len(out) == 41 and out["הרצל"]["spellings"] == 8 and len(out["הרצל"]["variants"]) == 7
    assert len(ST.street_variants(frame(rows, "street string"), top=30, max_variants=2).collect()) == 30


def _best(names, corpus, cutoff):
    """The standard library's closest entry of each name, by its own bounds and ratio."""
    out = {}
    for n in names:
        best = difflib.get_close_matches(n, corpus, n=1, cutoff=cutoff) if n else []
        if best:
            out[n] = best[0]
    return out


@pytest.fixture(scope="module")
def articles(spark):
    """A few thousand names that share most of their words."""
    from tidyward.plans.catalog.geocoding import ARTICLES
    from tidyward.plans.inputs import Tables
    return [r["name"] for r in Tables(spark, "/root/testdata/sf0.01").sql(ARTICLES).collect()]


@pytest.mark.parametrize("cutoff", [0.78, 0.85])
def test_few_pairs_are_compared(spark, articles, cutoff):
    rng = random.Random(4)
    names = []
    for n in rng.sample(articles, 500):
        i = rng.randrange(len(n))
        names.append(n[:i] + rng.choice("xyz") + n[i + rng.randrange(2):])
    frames = [spark.createDataFrame([(n,) for n in x], "name string") for x in (names, articles)]
    pairs = {(r.a, r.b) for r in ST.close_candidates(*frames, cutoff).collect()}
    assert len(pairs) < 0.05 * len(set(names)) * len(articles)
    few = sorted(set(names))[:25]
    got = {r["name"]: r["match"] for r in ST.close_matches(frames[0].where(F.col("name").isin(few)), frames[1],
                                                           cutoff).collect()}
    assert got == _best(few, articles, cutoff) and got


def test_keys_of_common_tokens_are_salted(spark):
    """One word in all names: no key holds more than its share, and nothing is lost."""
    names = [f"main street {i:04d}" for i in range(1500)]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    asked = spark.createDataFrame([(n + "x",) for n in names[:40]], "name string")
    found = {r["name"]: r["match"] for r in ST.close_matches(asked, frame, 0.85).collect()}
    assert found == _best([n + "x" for n in names[:40]], names, 0.85)
    plain = {(r.a, r.b) for r in ST.close_candidates(asked, frame, 0.85).collect()}
    salted = {(r.a, r.b) for r in ST.close_candidates(asked, frame, 0.85, share=100_000).collect()}
    assert plain == salted


def test_letters_beyond_the_first_plane_and_short_names(frame):
    corpus = ["a", "ab", "abc", "abcd", "\U0001F600\U0001F601x", "ab\U0001F600", "é", "aaaa", "aaab", "b" * 40]
    names = corpus + ["abx", "xab", "ba", "aa", "\U0001F601\U0001F600x", "b" * 37 + "c", ""]
    for cutoff in (0.6, 0.78, 0.85):
        got = {r["name"]: r["match"] for r in ST.close_matches(
            frame([(n,) for n in names] + [(None,)], "name string"),
            frame([(c,) for c in corpus] + [(None,), ("",)], "name string"), cutoff).collect()}
        assert got == _best(names, corpus, cutoff)
    assert ST.close_matches(frame([], "name string"), frame([], "name string"), 0.7).count() == 0


def test_variants_clean_each_spelling_once(spark, monkeypatch):
    """Rows are counted before their spellings are cleaned and composed: no plan does both."""
    rows = spark.range(4000).selectExpr(
        "concat('רחוב הרצוג', if(id % 2 = 0, ' ב\"ה', ' בה'), ' ', id % 40) AS street", "'א' || id AS raw_address")
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(ST, "cut", seen)
    registry = spark.createDataFrame([("הרצוג בה", 7, 1)], "name string, code int, seq int")
    found = ST.street_variants(rows, registry, min_total=1)
    seen(found)
    assert not [p for p in plans if "Range (" in p and "ArrowEvalPython" in p]
    assert any("ArrowEvalPython" in p for p in plans)
    assert [(r["total"], r["spellings"]) for r in found.collect()] == [(4000, 2)]


def test_closest_names_are_settled_first(spark, frame, monkeypatch):
    """Names with a very close entry don't meet the candidates of the lower cutoffs; the answers stay the same."""
    rng = random.Random(5)
    corpus = sorted({"".join(rng.choice("abcdefgh ") for _ in range(24)) for _ in range(60)})
    asked = sorted({n[:5] + n[6:] for n in corpus[:40]} | {n[:4] + "xyz" + n[9:] for n in corpus[30:]} | {"q" * 20, corpus[0]})
    want = {n: m[0] for n in asked if (m := difflib.get_close_matches(n, corpus, n=1, cutoff=0.78))}
    real, seen = ST.close_candidates, []

    def counted(names, *rest, **more):
        seen.append(names.count())
        return real(names, *rest, **more)

    monkeypatch.setattr(ST, "MANY_PAIRS", 1, raising=False)
    monkeypatch.setattr(ST, "close_candidates", counted)
    names = lambda values: frame([(v,) for v in [*values, None, ""]], "name string")      # noqa: E731
    got = {r["name"]: r["match"] for r in ST.close_matches(names(asked), names(corpus), 0.78).collect()}
    assert got == want and len(want) > 60
    assert seen[0] == len(asked) and seen[-1] < len(asked) / 2


@pytest.mark.parametrize("spread", [False, True])
def test_pairs_are_judged_where_they_meet(spark, frame, monkeypatch, spread):
    """No join makes rows of pairs with their tokens; bits that stand for several tokens and small steps lose nothing."""
    monkeypatch.setattr(ST, "TOKEN_BITS", 64, raising=False)
    monkeypatch.setattr(ST, "CHUNK", 3, raising=False)
    rng = random.Random(9)
    word = lambda a, b: "".join(rng.choice("abcd e\U0001F600") for _ in range(rng.randint(a, b)))      # noqa: E731
    corpus = sorted({word(1, 4) for _ in range(30)} | {word(12, 30) for _ in range(60)} | {"a" * 70} - {""})
    asked = sorted({c[:i] + "x" + c[i + 1:] for c in corpus for i in [rng.randrange(len(c))]} | {"a" * 69, "zz"})
    for cutoff in (0.6, 0.9):
        pairs = ST.close_candidates(frame([(n,) for n in asked], "name string"), frame([(c,) for c in corpus], "name string"),
                                    cutoff, spread=spread)
        assert "array_intersect" not in pairs._jdf.queryExecution().executedPlan().toString()
        found = [(r.a, r.b) for r in pairs.collect()]
        assert len(found) == len(set(found))
        assert set(found) >= {(n, c) for n in asked for c in corpus if difflib.SequenceMatcher(None, c, n).ratio() >= cutoff}


def test_rounds_end_when_all_names_are_settled(frame, monkeypatch):
    corpus = [f"street of the {w} lamps in the north" for w in ("old", "new", "red", "blue", "seven")]
    real, seen = ST.close_candidates, []

    def counted(names, *rest, **more):
        seen.append(names.count())
        return real(names, *rest, **more)

    monkeypatch.setattr(ST, "MANY_PAIRS", 1)
    monkeypatch.setattr(ST, "close_candidates", counted)
    rows = lambda values: frame([(v,) for v in values], "name string")      # noqa: E731
    got = {r["name"]: r["match"] for r in ST.close_matches(rows([c + "s" for c in corpus]), rows(corpus), 0.8).collect()}
    assert got == {c + "s": c for c in corpus} and seen == [5]
