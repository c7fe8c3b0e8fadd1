"""Exact and near de-duplication, mixing: against brute force on awkward rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quantloom.llm import exact_dedup, mixing, near_dups
from quantloom.llm.common import components


def test_exact_copies(awkward, nothing):
    rows = awkward.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(-1 if r.doc_id is None else r.doc_id)
    got = exact_dedup.find_copies(awkward, digest_all=True).collect()
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_digest[r.text_sha256]
        assert (r.group_size, -1 if r.keep_id is None else r.keep_id) == (len(ids), max(ids))
        kept[r.text_sha256] += r.kept
        if r.kept:
            assert r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert exact_dedup.find_copies(nothing).count() == 0


def test_exact_copies_dropped(awkward, nothing):
    left = exact_dedup.drop_copies(awkward)
    assert left.columns == awkward.columns
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in awkward.collect()})
    assert exact_dedup.drop_copies(nothing).count() == 0


def brute_targets(sizes, weights, stop):
    """Reshare what is above a limit until nothing is."""
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in held]
        if not free:
            return held
        rest, weight = total - sum(held.values()), sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / weight > stop * sizes[s]]
        if not over:
            return held | {s: rest * weights[s] / weight for s in free}
        held |= {s: float(stop * sizes[s]) for s in over}


def test_mix(awkward, nothing):
    got = mixing.mix(awkward).collect()
    rows = awkward.select("doc_id", "source", "text").collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    expected = brute_targets(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source])
        taken[r.source] += r.taken
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 2  # half a word, and the share of repeated rows at the cut
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(awkward.repartition(5)).collect()))
    assert mixing.mix(nothing).count() == 0


def test_mixed_documents_hold_the_words_taken(awkward, nothing):
    plan = Counter()
    for r in mixing.mix(awkward).collect():
        plan[r.doc_id] += r.taken
    mixed = mixing.mixed_documents(awkward)
    assert mixed.columns == awkward.columns
    words = Counter()
    originals = {r.doc_id: r.text for r in awkward.collect()}
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert originals[r.doc_id].startswith(r.text) or r.doc_id is None
        assert r.n_chars == len(r.text)
    assert words == +plan
    assert mixing.mixed_documents(nothing).count() == 0


def brute_links(rows):
    shingler = near_dups.Shingler(1, 1)
    sets = [(r.doc_id, shingler.shingles(r.text)) for r in rows]
    sets = [(i, set(s.tolist())) for i, s in sets if s is not None]
    links, root = Counter(), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x][1] & sets[y][1])
            if both >= 0.8 * len(sets[x][1] | sets[y][1]):
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    members = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        members[find(x)].append(i)
    smallest = {x: min((i for i in members[find(x)] if i is not None), default=None) for x in range(len(sets))}
    return Counter((i, smallest[x], links[x]) for x, (i, _) in enumerate(sets))


@pytest.mark.parametrize("block", [128, 4])
def test_near_copies(awkward, nothing, block):
    rows = awkward.select("doc_id", "text").collect()
    got = near_dups.join_similar(awkward, block=block).collect()
    assert len(got) == len(rows)
    wordless = {100, 101, 102, None}
    found = Counter((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id not in wordless)
    assert found == Counter({k: n for k, n in brute_links(rows).items() if k[0] is not None})
    assert all(r.n_links == 0 for r in got if r.doc_id in wordless)
    assert near_dups.join_similar(nothing).count() == 0


def test_one_of_each_class_stays(awkward):
    left = near_dups.keep_one(awkward)
    assert left.columns == awkward.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert 130 in ids and not {131, 140, 111} & set(ids) and 110 in ids and ids[None] == 2


def test_null_and_repeated_ids_are_judged_row_by_row(spark, words):
    def text(at, changed=""):
        return " ".join([*words[at : at + 59], changed or words[at + 59]])

    rows = [(1, text(0)), (None, text(0, "changed")), (None, text(60)),  # a null-id copy takes no other row along
            (5, text(0, "other")), (5, text(120)),  # nor does a copy under an id of its own
            (None, text(180)), (None, text(180)), (None, text(180, "changed")),  # one of a class without ids stays
            (7, text(240)), (7, text(240)), (7, text(240, "changed")), (7, text(300)),
            (None, None), (None, ""), (7, "")]
    left = Counter((r.doc_id, (r.text or "").split(" ")[0]) for r in near_dups.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first = [words[at] for at in range(0, 360, 60)]
    assert left == Counter([(1, first[0]), (None, first[1]), (5, first[2]), (None, first[3]), (7, first[4]), (7, first[5]), (None, ""), (None, ""), (7, "")])


def test_bands_reach_the_recall():
    bands, rows = near_dups.choose_bands(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 103)} == {100} and {got[i] for i in range(200, 260)} == {200}


def test_length_of_words_is_counted_in_sql(spark):
    df = spark.createDataFrame([("a  b\tc\x0b d e",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(mixing.words(F.col("text"))).collect()] == [4, 0, 0]


@pytest.mark.parametrize("hot", [None, 7])
def test_rows_that_share_an_id_are_judged_one_by_one(spark, hot):
    import random

    draw = random.Random(6)
    rows = []
    for i in range(600):
        words = [f"w{draw.randrange(5000)}" for _ in range(40)]
        rows += [(hot, " ".join(words), "a"), (hot, " ".join([*words, f"end{i}"]), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = near_dups.keep_one(docs)
    kept = [r.text for r in left.collect()]
    assert len(kept) == 600 and len({t.split(" end")[0] for t in kept}) == 600
    repeated = spark.createDataFrame([(hot, "same text of all", s) for s in "abc"] + [(hot, "another text", "a")], "doc_id long, text string, source string")
    assert sorted(r.text for r in exact_dedup.drop_copies(repeated).collect()) == ["another text", "same text of all"]
