"""Templates and chat formatting, nearest neighbours, dated URL lists."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.llm import ann, chat, template, url_lists


def text_of(source, **names):
    return "".join(t for t, _ in template.compile_template(source)(names))


def test_template_language():
    assert text_of("{% for x in xs %}{{ loop.index }}{{ x.a | upper }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == "1P,2Q"
    assert text_of("{% if a == 'x' and not b %}1{% elif b %}2{% else %}3{% endif %}", a="y", b=1) == "2"
    assert text_of("{% set y = x ~ '!' %}{{ y + 'z' }}{{ missing }}{{ x['k'] }}", x="v") == "v!z"
    pieces = list(template.compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")({"x": "y"}))
    assert pieces == [("a", False), ("b", True), ("y", True), ("c", False)]


def test_constants_are_folded():
    tree = template.fold(template.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}x{% else %}c{% endif %}{{ 'd' | upper }}"))
    assert tree == ("block", [("text", "ab1cD")])


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ _x }}", "{{ f() }}", "{% for x in %}", "{% if x %}", "{% endif %}", "{{ x | open }}", "{% import os %}", "{{ }}"])
def test_sandbox(source):
    with pytest.raises(template.TemplateError):
        template.compile_template(source)


def test_only_mappings_have_keys():
    assert text_of("{{ x.real }}{{ x.upper }}", x="s") == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\\.", "<", "[", "a", "|", "\n", "s>"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(s in escaped for s in chat.CONTROLS)


CONV = "conv_id long, turn long, role string, text string, part int, formatted string"


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_conversations_read_back(spark, part):
    rows = [(1, 0, "system", None), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "a\\.b<|end|>c" * 9), (1, None, "<|text|>", "first"),
            (2, 0, None, ""), (2, 0, "assistant", ""), (3, 5, "assistant", "é😀" * 50), (3, 5, "assistant", "é😀" * 50), (None, 1, "user", "x")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], CONV)
    got = {r.conv_id: r for r in chat.digest_formatted(chat.format_conversations(df, part_chars=part)).collect()}
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r or "", x or "", r))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort(key=lambda t: (t[0], t[1], t[4] is not None, t[2], t[3]))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digest_formatted(chat.format_conversations(df.limit(0))).count() == 0


def test_own_templates(spark):
    df = spark.createDataFrame([(1, 0, "user", "q", 0, ""), (1, 1, "assistant", "r", 0, "")], CONV)
    own = "{% for t in turns %}{{ t.role | upper }}: {% if t.role == 'assistant' %}{% generation %}{{ t.text }}{% endgeneration %}{% else %}{{ t.text }}{% endif %}\n{% endfor %}"
    row = chat.format_conversations(df, own).first()
    assert row.formatted == "USER: q\nASSISTANT: r\n" and [tuple(s) for s in row.loss_spans] == [(19, 20)]


VEC = "vec_id long, embedding array<float>, rank int, score double"


def test_neighbours_against_brute_force(spark):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((20, 16))
    x = (centres[draw.integers(0, 20, 1500)] + 0.3 * draw.standard_normal((1500, 16))).astype(np.float32)
    x[40:100] = x[40]
    df = spark.createDataFrame([(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)], VEC)
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d, recall = x.astype(float), []
    for q in range(0, 1500, 20):
        s = d @ d[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -np.array([(d[i] * d[q]).sum() if i != q else -np.inf for i in range(1500)])))[:10]
        recall.append(len({i for i, _ in got[q]} & set(best.tolist())) / 10)
        assert all(v == pytest.approx(s[i], abs=1e-12) for i, v in got[q]) and sorted(got[q], key=lambda p: (-p[1], p[0])) == got[q]
    assert np.mean(recall) >= 0.9
    for q in (40, 60, 80):  # of equal vectors the smaller ids
        equal = [i for i, _ in got[q] if 40 <= i < 100]
        assert equal == [i for i in range(40, 100) if i != q][: len(equal)]


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0, 0.0) for r in rows], VEC)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_lists_as_of_the_fetch(spark):
    day = datetime(2024, 1, 1)
    events = [("spam", "domain", "Bad.example", "add", 10), ("spam", "domain", "bad.example", "remove", 20), ("spam", "domain", "bad.example", "add", 30),
              ("spam", "domain", "bad.example", "remove", 20), ("mal", "url", "http://ok.example/x/", "add", 5), ("good", "domain", "fine.bad.example", "add", 0),
              ("spam", "domain", "both.example", "add", 1), ("spam", "domain", "both.example", "remove", 1), ("spam", None, "x.example", "add", 1)]
    lists = spark.createDataFrame([(a, b, c, d, day + timedelta(days=n), "u") for a, b, c, d, n in events], "list string, kind string, entry string, action string, at timestamp, url string")
    asked = [(1, "https://a.bad.example:8080/p?q=1#f", 9), (2, "https://a.bad.example/p", 10), (3, "https://u@BAD.example/", 20), (4, "http://bad.example", 40), (5, "https://OK.example/x?y", 6),
             (6, "https://ok.example/x/y", 6), (7, "http://fine.bad.example/", 15), (8, "http://both.example", 2), (9, None, 3), (10, "not a url", 3), (11, "http://bad.example", None), (2, "https://a.bad.example/p", 10)]
    captures = spark.createDataFrame([(i, u, None if n is None else day + timedelta(days=n), "z") for i, u, n in asked], "page_id long, url string, fetched_at timestamp, key string")
    got = sorted((r.page_id, r.blocked, len(r.hits)) for r in url_lists.judge(captures, lists, allow=("good",)).collect())
    assert got == [(1, False, 0), (2, True, 1), (2, True, 1), (3, False, 0), (4, True, 1), (5, True, 1), (6, False, 0), (7, False, 2), (8, False, 0), (9, False, 0), (10, False, 0), (11, False, 0)]
    assert url_lists.judge(captures.limit(0), lists).count() == 0
    assert not any(r.blocked for r in url_lists.judge(captures, lists.limit(0)).collect())


@pytest.mark.parametrize("spread, most", [(None, 2.0), (0.3, 0.3)])
def test_measured_share_of_opened_leaves(spread, most):
    """5,000 vectors without structure and in 40 clusters: recall of queries outside the sample, and the share that it takes."""
    draw = np.random.default_rng(12)
    rows = draw.standard_normal((5000, 64))
    if spread:
        rows = draw.standard_normal((40, 64))[draw.integers(0, 40, 5000)] + spread * rows
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    forest = ann.Forest.fit(rows[:4096])
    share = forest.share_for(rows[:4096], 20)
    leaves = forest.leaves(rows)
    sizes = np.stack([np.bincount(leaves[:, t], minlength=1 << forest.depth) for t in range(leaves.shape[1])])
    found = []
    for i in range(4100, 5000, 30):
        scores = rows @ rows[i]
        scores[i] = -np.inf
        near = np.argsort(-scores)[:20]
        opened = set(forest.open_leaves(forest.margins(rows[i : i + 1])[0], sizes, share * len(rows)))
        found.append(np.mean([any((t, leaves[j, t]) in opened for t in range(leaves.shape[1])) for j in near]))
    assert np.mean(found) >= 0.9 and share < most
