"""WARC normaliser, periodic runs and hard negatives: against brute force and round trips on awkward rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import hard_negatives, periodic, warc
from quantloom.llm.common import stage

PAGES = "page_id long, url string, html string, payload string, digest string, type string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://a.example/{i}", f"<p>page {i}</p>") for i in range(40)]
    rows += [(100 + i, f"http://copy.example/{i}", "<p>the same of all</p>") for i in range(30)]
    rows += [(200, None, "no url"), (None, "http://x/", "no id"), (None, None, None), (201, "http://e/", ""), (202, "http://n/", None)]
    rows += [(203, "http://twice/", "twice the row")] * 2 + [(204, "http://long/", "<i>långt</i>" * 300_000), (205, "http://line\r\nbreak/", "WARC/1.1\r\n\r\n" * 3)]
    return spark.createDataFrame([(*r, "clash", "x", None) for r in rows], PAGES).repartition(3)


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_pages_come_back_from_archives(spark, pages):
    got = warc.archive_pages(pages, archive_bytes=1 << 20).collect()
    rows = pages.select("page_id", "html").collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    groups = {}
    for r in rows:
        groups.setdefault(b32(r.html), []).append((r.page_id is not None, r.page_id or 0))
    want = []
    for digest, ids in groups.items():
        ids.sort(reverse=True)
        size = next(len((r.html or "").encode()) for r in rows if b32(r.html) == digest)
        for n, (known, i) in enumerate(ids):
            want.append((i if known else None, size, digest, "revisit" if n else "response", ids[0][1] if n and ids[0][0] else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_members_offsets_and_sidecar(spark, pages):
    raw = warc.write_archives(warc.page_records(pages), warc.new_folder(spark), archive_bytes=1 << 18)
    folder = warc.new_folder(spark)
    index = warc.normalise(raw, folder)
    before = sorted(gzip.decompress(open_bytes(a.archive)) for a in raw.select("archive").collect())
    files = sorted({r.archive for r in index.collect()})
    assert sorted(gzip.decompress(open_bytes(f)) for f in files) == before and len(files) > 1
    for f in files:
        data, end = open_bytes(f), 0
        for r in index.where(F.col("archive") == f).orderBy("start").collect():
            assert r.start == end
            end += r["size"]
            member = zlib.decompressobj(31)
            text = member.decompress(data[r.start : end])
            assert member.eof and not member.unused_data and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        assert end == len(data)
    side = warc.sidecar_index(spark, folder).drop("archive")
    assert sorted(map(str, side.collect())) == sorted(map(str, index.drop("archive").collect()))
    again = warc.normalise(stage(index.select("archive").distinct().selectExpr("archive", "0L as records")), warc.new_folder(spark))
    assert sorted(map(str, again.drop("archive", "start").collect())) == sorted(map(str, index.drop("archive", "start").collect()))
    long_page = warc.read_records(index.where("page_id = 204"), with_payload=True).first()
    assert bytes(long_page.payload).decode() == "<i>långt</i>" * 300_000


def open_bytes(address):
    system, path = warc.opened(address)
    with system.open_input_stream(path, compression=None) as file:
        return file.read()


def rewritten(data):
    sink = pa.BufferOutputStream()
    return list(warc.rewrite(pa.PythonFile(io.BytesIO(data), mode="r"), sink)), sink.getvalue().to_pybytes()


def test_damage_is_reported():
    record = b"".join(warc.record_bytes("ab" * 16, "response", 1, "http://a/", hashlib.sha1(b"x").hexdigest(), None, b"x"))
    whole = gzip.compress(record * 3)
    rows, out = rewritten(whole)
    assert [r[2]["x-page-id"] for r in rows] == ["1"] * 3 and gzip.decompress(out) == record * 3
    rows, out = rewritten(gzip.compress(record * 2 + record[:-20]))
    assert [r[1] is None for r in rows] == [False, False, True] and gzip.decompress(out) == record * 2
    assert rewritten(whole[:-12])[0][-1][1] is None and rewritten(b"no gzip")[0][0][1] is None
    assert rewritten(gzip.compress(b"HTTP/1.1 200\r\n\r\n"))[0][0][2] == "no WARC version line" and rewritten(b"")[0] == []
    assert rewritten(gzip.compress(record.replace(b"Content-Length: ", b"Content-Length: x")))[0][0][2] == "no content length"


# ---- periodic runs -------------------------------------------------------------------


def brute_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i : i + length]
            if length >= max(6, 4 * q) and not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    draw = random.Random(8)
    for _ in range(150):
        texts = []
        for _ in range(draw.randint(1, 6)):
            kinds = draw.choice([1, 2, 2, 3, 6])
            words = [draw.randrange(kinds) for _ in range(draw.randint(0, 90))]
            root = [draw.randrange(kinds) for _ in range(draw.randint(1, 13))]
            at = draw.randint(0, len(words))
            words[at:at] = (root * 9)[: draw.randint(0, 9 * len(root))]
            texts.append(words)
        for words, got in zip(texts, periodic.runs_of([np.array(t, np.int64) for t in texts])):
            assert [tuple(r) for r in got.tolist()] == brute_runs(words)


def test_wavelet_matrix():
    draw = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        values = draw.permutation(n)
        matrix = periodic.WaveletMatrix(values)
        low = draw.integers(0, n, 50)
        high = np.minimum(n, low + draw.integers(1, n + 1, 50))
        bound = draw.integers(0, n, 50)
        assert matrix.below(low, high, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, bound)]
        k = draw.integers(0, high - low)
        assert matrix.kth(low, high, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(low, high, k)]


def test_runs_of_documents(spark, awkward, nothing):
    loops = spark.createDataFrame([
        (500, "x " * 7 + "y", 1, "c"), (501, "intro " + "a b c " * 5 + "a end", 1, "c"), (502, "one\ttwo\none two " + "é " * 6, 1, "c"), (503, "w " * 200_000, 1, "c"),
        (504, "a b " * 4 + "c d e " * 4, 1, "c")], "doc_id long, text string, runs int, best string")
    docs = awkward.unionByName(loops, allowMissingColumns=True)
    texts = {r.doc_id: r.text for r in loops.collect()}
    got = periodic.find_runs(docs)
    assert got.count() == docs.count() and "key" in got.columns and "text" not in got.columns
    found = {r.doc_id: r for r in got.where("doc_id >= 500").collect()}
    for i, text in texts.items():
        words = text.encode().split()
        runs = brute_runs(words) if i != 503 else [(0, 200_000, 1)]
        assert [(r.start, r.length, r.period) for r in found[i].runs] == runs and found[i].n_words == len(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert found[i].collapsed == b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
    assert found[501].best.asDict() == {"start": 1, "length": 16, "period": 3} and found[504].best.start == 0
    plain = got.where("doc_id = 101").first()
    assert (plain.n_words, plain.runs, plain.best, plain.collapsed) == (0, [], None, "")
    assert periodic.find_runs(nothing).count() == 0


def test_registered_runs_match_brute_force(spark):
    from quantloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_periodic_runs"](spark, sf).collect()
    assert len(got) == len(docs)
    periodic_ones = 0
    for r in got:
        words, h = (docs[r.doc_id] or "").encode().split(), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) > 1500:
            continue  # the brute force takes the square of the length
        runs = brute_runs(words)
        periodic_ones += bool(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (best[1] * 1000 // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
    assert periodic_ones > 5


# ---- hard negatives ------------------------------------------------------------------


def brute_negatives(rows, anchors, low=80, high=100):
    out = []
    for a, (i, label, v) in enumerate(rows):
        if not anchors(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, m != label) for b, (j, m, w) in enumerate(rows) if b != a]
        for s, j, other in sorted(x for x in scored if not x[2])[:5]:
            fits = sorted(x for x in scored if x[2] and low * -s <= 100 * -x[0] <= high * -s)
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k, _) in enumerate(fits[:5])]
    return sorted(out)


def test_intervals_hold():
    draw = np.random.default_rng(3)
    for dims, scale in ((1, 9), (3, 100), (64, 256), (130, 20)):
        rows = draw.integers(-scale, scale + 1, (200, dims))
        rows[:3] = 0
        lower, upper = hard_negatives.intervals(rows[:20], *hard_negatives.coded(rows))
        exact = rows[:20] @ rows.T
        assert (lower <= exact).all() and (exact <= upper).all()


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(5)
    centres = draw.integers(-40, 41, (4, 16))
    rows = [(int(i), int(m), (centres[m] + draw.integers(-30, 31, 16)).tolist()) for i, m in enumerate(draw.integers(0, 4, 700))]
    rows += [(800 + i, 1, rows[10][2]) for i in range(60)] + [(900 + i, 2, rows[10][2]) for i in range(9)]  # equal vectors
    rows += [(10, rows[10][1], rows[10][2])] * 2 + [(950, 0, [0] * 16), (1000, 3, [0] * 16)]
    odd = [(None, 1, [1] * 16), (1100, None, [1] * 16), (1200, 1, None), (1300, 1, [None] * 16), (1400, 1, [1, 2])]
    table = spark.createDataFrame([(*r, "clash", 7) for r in rows + odd], "vec_id long, label int, vector array<long>, block string, score int").repartition(3)
    for block, group in ((4096, 16), (50, 2)):
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        monkeypatch.setattr(hard_negatives, "GROUP", group)
        got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0).collect()
        assert sorted(tuple(r) for r in got) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
