"""Brute force for periodic runs, license scans and vector codes, and the odd cases that their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickwell.llm import license_scan, periodic_runs, queries, vector_codes
from tickwell.llm.common import text_buffer, word_hashes

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


# ---------------------------------------------------------------- periodic runs


def runs_of(words, least):
    """(start, length, period) of every run, each period tried on each place."""
    x = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int)
    out = []
    for q in range(1, len(x) // 2 + 1):
        same = np.concatenate(([0], (x[q:] == x[:-q]).astype(int), [0]))
        for i, j in np.flatnonzero(np.diff(same)).reshape(-1, 2).tolist():
            length = j - i + q
            if length >= max(least, 2 * q) and not any((x[i + p : i + length] == x[i : i + length - p]).all() for p in range(1, q)):
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_texts(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        kinds = [str(k) for k in range(r.choice([1, 2, 3, 5, 60]))]
        w = [r.choice(kinds) for _ in range(r.choice([0, 1, 5, 12, 20, 40, 90, 160]))]
        if w and r.random() < 0.7:
            a = r.randrange(len(w))
            p = 1 + (len(w) - a) // r.randrange(2, 11)
            w = [w[i if i < a else a + (i - a) % p] for i in range(len(w))]
        if len(w) > 30 and r.random() < 0.5:
            w = w[:10] + w[3 : 3 + r.randrange(4, 25)] * r.randrange(1, 5) + w[10:]
            w[r.randrange(len(w))] = "zz"
        yield w


@pytest.mark.parametrize("least", [2, 12])
def test_runs_equal_every_period_tried(least):
    texts = list(odd_texts(700, 3))
    codes, at = word_hashes(*text_buffer(pa.array([" ".join(w) for w in texts])), lower=False)
    found = periodic_runs.find_runs(codes, at, least)
    assert len(found) > 200
    for k, w in enumerate(texts):
        assert [tuple(r) for r in found[found[:, 0] == k][:, 1:].tolist()] == runs_of(w, least), w


def test_refinement_work_stays_near_linear():
    """A text of 40,000 words with period 100 and one of 40,000 equal words: no square of the length is done."""
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefgh") + str(k) for k in range(100)) + " "] * 1
    column = pa.array([texts[0] * 400, "x " * 40_000])
    codes, at = word_hashes(*text_buffer(column), lower=False)
    assert periodic_runs.find_runs(codes, at, 12).tolist() == [[0, 0, 40_000, 100], [1, 0, 40_000, 1]]


def expected_runs(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = runs_of(w, 12)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(rows)
    assert all(got[r.doc_id] == expected_runs(r.doc_id, r.text) for r in rows if len((r.text or "").split()) < 4000)
    assert sum(x[1] > 0 for x in got.values()) > 5


def test_runs_odd_rows(spark):
    long = "alpha beta gamma " * 60_000 + "end"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A a " * 8), (5, "A a " * 8), (None, "x " * 20), (6, long), (7, "ä b " * 13), (8, "a\x1fb " * 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("_text", F.lit("x")).withColumn("collapsed", F.lit(2))
    got = periodic_runs.digest(periodic_runs.periodic_runs(docs, ["doc_id"])).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    empty = hashlib.sha256(b"").hexdigest()
    assert all((by[k].n_runs, by[k].start, by[k].runs_sha256, by[k].collapsed_sha256) == (0, None, empty, empty) for k in (1, 2, 3))
    assert by[5].period == 2 and by[5].length == 16 and sum(r.doc_id == 5 for r in got) == 2
    assert (by[None].length, by[None].period, by[None].exponent_milli) == (20, 1, 20_000)
    assert (by[6].start, by[6].length, by[6].period) == (0, 180_000, 3)
    assert by[7].period == by[8].period == 1  # neither U+00A0 nor U+001F parts words
    kept = periodic_runs.periodic_runs(docs.select("doc_id", "text"), ["doc_id"]).filter("doc_id = 6").first()
    assert kept.collapsed == "alpha beta gamma end"
    assert periodic_runs.digest(periodic_runs.periodic_runs(docs.limit(0), ["doc_id"])).count() == 0


# ---------------------------------------------------------------- license scans


def places_of(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    found = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_places_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op12_license_scan(spark, SF).collect()
    assert len(got) == len(rows) and sum(r.n_base for r in got) > 20
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == places_of(rows[r.doc_id]) for r in got)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_license_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    cursor = con.execute(license_scan.oracle())
    names = [x[0] for x in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in queries.op12_license_scan(spark, SMALL).collect()) == want


def test_license_notices_with_edits_and_odd_rows(spark):
    mit = license_scan.NOTICES[0][0].split()
    edited = mit[:12] + ["and", "every"] + mit[12:30] + mit[32:]
    far = mit[:8] + ["filler"] * 60 + mit[8:14] + ["filler"] * 60 + mit[30:]
    rows = [
        (1, " ".join(edited)), (2, " ".join(far)), (3, "MIT-License, MIT\nLicense; the GNU General  Public\tLicense"), (4, None), (5, ""), (6, "mit"), (7, "mit license"), (7, "mit license"),
        (None, "apache license"), (8, "general public licenses general public"), (9, "word mit license " * 20_000), (10, "Licensed under CC BY-NC 4.0."), (11, "mit license ümit license"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(1)).withColumn("places", F.lit(1)).withColumn("template", F.lit(1))
    got = license_scan.digest(license_scan.scan(docs, ["doc_id"])).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].labels == "mit" and by[1].base_labels == "" and 0.8 <= by[1].score < 1
    assert by[2].labels == "" and by[2].score == 0
    assert (by[3].n_base, by[3].first_word, by[3].last_word, by[3].base_labels) == (3, 0, 6, "gpl,mit")
    assert all((by[k].n_base, by[k].first_word, by[k].labels, by[k].score) == (0, None, "", 0) for k in (4, 5, 6, 8))
    assert by[6].n_words == 1 and by[5].n_words == 0
    assert sum(r.doc_id == 7 for r in got) == 2 and by[None].labels == "apache"
    assert (by[9].n_base, by[9].last_word) == (20_000, 59_998)
    assert by[10].labels == "cc,cc-nc"
    assert by[11].n_base == 0
    assert license_scan.digest(license_scan.scan(docs.limit(0), ["doc_id"])).count() == 0
    kept = license_scan.scan(docs.filter("doc_id = 1"), ["_row", "template", "doc_id"]).first()
    assert (kept._row, kept.template, kept.places[0].start, kept.places[0].end) == (1, 1, 0, len(edited))


# ---------------------------------------------------------------- vector codes


def brute_codes(ids, vectors, labels, entries=256, rounds=4):
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64)
    width = x.shape[1] // 4
    parts = [x[:, k * width : (k + 1) * width] for k in range(4)]
    first = np.argsort(ids, kind="stable")[:entries]
    books = [p[first].copy() for p in parts]

    def assign(k):
        d = ((parts[k][:, None] - books[k][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for k in range(4):
            own, _ = assign(k)
            for e in set(own.tolist()):
                books[k][e] = parts[k][own == e].sum(0) // (own == e).sum()
    done = [assign(k) for k in range(4)]
    error = sum(d for _, d in done).tolist()
    by = defaultdict(int)
    for label, e in zip(labels, error, strict=True):
        by[label] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return sorted(((i, "".join(f"{done[k][0][j]:02x}" for k in range(4)), error[j], by[labels[j]], sha) for j, i in enumerate(ids)), key=repr)


def test_codes_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = brute_codes([r.vec_id for r in rows], [r.embedding for r in rows], [r.label for r in rows])
    assert sorted(map(tuple, queries.op13_vector_codes(spark, SF).collect()), key=repr) == want


@pytest.mark.parametrize("seed", range(6))
def test_nearest_entry_is_the_lowest_of_the_nearest(seed):
    r = np.random.default_rng(seed)
    width, most = [1, 2, 4, 5, 16, 33][seed], [3, 2, 4, 1000, 500, 1 << 27][seed]
    rows, book = r.integers(-most, most, (300, width)), r.integers(-most, most, (256, width))
    book[100:110] = book[5:15]
    rows[:50] = book[90:140]
    index, distance = vector_codes.nearest(rows, book)
    d = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), -0.3, 0.25, i / 3], None if i % 3 else 1) for i in range(20)]
    bad = [(100, None, 1), (101, [1.0, None, 2.0, 3.0], 1), (102, [nan, 0.0, 0.0, 0.0], 1), (103, [inf, 0.0, 0.0, 0.0], None)]
    docs = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit(1)).withColumn("error", F.lit(1)).withColumn("id", F.lit(1))
    got = sorted(map(tuple, vector_codes.vector_codes(docs).collect()), key=repr)
    f32 = [np.array(v, np.float32) for _, v, _ in good]
    assert got == brute_codes([i for i, _, _ in good], f32, [x for _, _, x in good])
    # a repeated row is one first entry and two result rows; another length or a null id takes no part or comes last
    more = [(3, good[3][1], 1), (None, [1.0, 1.0, 1.0, 1.0], 2), (7, [1.0, 2.0], 2)]
    told = vector_codes.vector_codes(spark.createDataFrame(good + more, "vec_id long, embedding array<float>, label int")).collect()
    assert len(told) == 23 and sum(r.vec_id == 3 for r in told) == 2
    assert [(r.code, r.error) for r in told if r.vec_id == 7].count((None, None)) == 1
    assert vector_codes.vector_codes(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1), (2, [], 1)], "vec_id long, embedding array<float>, label int")
    assert [r.code for r in vector_codes.vector_codes(odd).collect()] == [None, None]
    with pytest.raises(Exception, match="outgrow"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [3e5, 0.0, 0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")).count()
