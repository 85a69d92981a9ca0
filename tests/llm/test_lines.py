"""Line templates by brute force, and the query against DuckDB."""

import random
import re
from collections import defaultdict

import pytest

from tidyward.llm import queries
from tidyward.llm.lines import drop_templates

SF = "/root/testdata/sf0.01"


def brute(rows, k, depth=3, least=3, share=0.6, keep_first=False):
    lines, seen = [], defaultdict(set)
    for i, (doc, text) in enumerate(rows):
        for at, line in enumerate((text if text is not None else "").split("\n")) if text is not None else ():
            t = tuple("<*>" if re.search("[0-9]", x) else x for x in re.sub(r"[ \t\r\f\v]+", " ", line).strip(" ").split(" "))
            if len(t) >= least and t != ("",):
                lines.append((i, doc, text, at, t))
                seen[len(t), t[:depth]].add(text)
    lines = [x for x in lines if len(seen[len(x[4]), x[4][:depth]]) >= k]
    weight = defaultdict(set)
    for _, _, text, _, t in lines:
        for p, token in enumerate(t):
            weight[len(t), t[:depth], p, token].add((text, t))
    found = defaultdict(list)
    for x in lines:
        t = x[4]
        made = tuple(w if w != "<*>" and len(weight[len(t), t[:depth], p, w]) >= k else "<*>" for p, w in enumerate(t))
        if sum(w != "<*>" for w in made) >= share * len(t):
            found[made].append(x)
    gone = set()
    for members in found.values():
        if len({m[2] for m in members}) >= k:
            first = min((m[1] for m in members if m[1] is not None), default=None)
            gone |= {(m[0], m[3]) for m in members if not (keep_first and m[1] == first)}
    out = []
    for i, (_, text) in enumerate(rows):
        out.append(None if text is None else "\n".join(
            line for at, line in enumerate(text.split("\n")) if (i, at) not in gone))
    return out


def make_texts(seed):
    r = random.Random(seed)
    words = "the of and to in a is it".split()
    frames = ["Page {0} of 12 of {1}", "All rights  reserved.", "Posted by {1} on 2020-0{2} in news",
              "one\ttwo three", "short {0}", "{0} {2} {0}", "same start here {1} {1} {1} {1} {1}"]
    out = []
    for i in range(60):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 5))]
        for f in frames:
            if r.random() < 0.4:
                lines.insert(r.randint(0, len(lines)), f.format(r.randint(1, 99), r.choice("xyz") + str(i) * (i % 2), i % 9))
        out.append("\n".join(lines))
    out += ["only in copies of this text"] * 30 + ["", None, "\n\n", "x" * 5000 + " 1" * 50]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("keep_first", [False, True])
def test_equal_to_brute_force(docs, keep_first):
    rows = make_texts(1)
    got = {r.doc_id: r for r in drop_templates(docs(rows), min_texts=5, keep_first=keep_first).collect()}
    want = brute(rows, 5, keep_first=keep_first)
    assert [got[i].text for i, _ in rows] == want
    assert any("Page" in (t or "") for _, t in rows) and sum("rights" in (w or "") for w in want) <= 1
    assert "only in copies of this text" in want
    for i, t in rows:
        assert got[i].n_lines == (0 if t is None else t.count("\n") + 1)


def test_odd_rows(docs):
    rows = [(None, f"a b c d\n{i}") for i in range(6)] + [(3, "a b c d\nx"), (3, "a b c d\nx"), (4, None)]
    out = drop_templates(docs(rows), min_texts=5).collect()
    assert len(out) == 9 and not any("a b c d" in (r.text or "") for r in out)
    assert out[0].lang == "en" and "row" in out[0] and "size" in out[0]
    kept = drop_templates(docs(rows), min_texts=5, keep_first=True).collect()
    assert [r.doc_id for r in kept if "a b c d" in (r.text or "")] == [3, 3]
    assert drop_templates(docs([])).count() == 0


def test_query(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(queries.EXPECTED["op5_log_templates"]).fetchall())
    got = sorted(map(tuple, queries.op5_log_templates(spark, SF).select(
        "doc_id", "n_lines", "n_dropped", "kept_sha256").collect()))
    assert got == want and sum(r[2] for r in got) > 0


def test_whole_lines_of_few_tokens_or_many_digits(docs):
    short = ["版权所有不得转载", "Les.", "1 2 3 call"]
    texts = ["\n".join([f"own{i} word", *short, "", f"n {i}"]) for i in range(6)]
    for r in drop_templates(docs(texts), min_texts=5, whole_lines=True).collect():
        assert r.text == f"own{r.doc_id} word\n\nn {r.doc_id}" and r.n_dropped == 3
    first = drop_templates(docs(texts), min_texts=5, whole_lines=True, keep_first=True).collect()
    assert [r.doc_id for r in first if "Les." in r.text] == [0]
    few = drop_templates(docs(texts[:4]), min_texts=5, whole_lines=True).collect()
    assert sorted(r.text for r in few) == sorted(texts[:4])
