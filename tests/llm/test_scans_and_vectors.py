"""License scans, whitening and vector codes against plain versions, on small tables with every awkward row."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tracelab.llm import licenses, queries, vector_codes, whitening
from tracelab.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def phrase_places(text):
    """Every place of every phrase, by comparing words."""
    words, found = plain_words(text), []
    for label, phrase in licenses.PHRASES:
        own = phrase.split()
        found += [(i, label) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    return sorted(found)


MIT = dict(licenses.NOTICES[::-1])["mit"], [t for x, t in licenses.NOTICES if x == "mit"][1]
LONG = MIT[1].split()
TEXTS = [
    None,
    "",
    " \n",
    "MIT license",
    "mit\x00LICENSE.mit-license",
    "smit license, mit licenses",
    "GNU General Public Licenses and the gnu general public license, gnu general public",
    "CC BY isn't cc by; É cc-by",
    "日本 cc by 語 apache license mit license apache",
    "Licensed under CC BY-NC 4.0. " * 9,
    "word " * 255 + "apache license " + "x " * 253 + "gnu general public license",
    "apache license " * 3000,
    " ".join(LONG),
    " ".join([*LONG[:9], "really", "truly", *LONG[9:]]),
    " ".join(LONG[:8] + LONG[10:]),
    " ".join(LONG[:6]),
    " ".join(w for x in LONG for w in (x, "and")),
    "one " * 50 + " ".join(LONG) + " two" * 50 + " " + " ".join(LONG[:12]),
    "Licensed under the Apache License, Version 2.0",
    "license " * 10,
]


def license_rows():
    rows = [(i, t, 1, "a", True, i) for i, t in enumerate(TEXTS)]
    return [*rows, rows[3], rows[3], (None, "mit license", 0, "", None, None), (None, None, None, None, None, None)]


def test_license_scan(spark):
    """Phrases against a plain scan, all columns against SQL; columns that clash with names used inside."""
    frame = spark.createDataFrame(license_rows(), "doc_id long, text string, uid long, label string, base boolean, n_words long").repartition(3)
    got = licenses.scan(frame).collect()
    want = []
    for r in license_rows():
        places = phrase_places(r[1])
        starts = [i for i, _ in places]
        want.append((r[0], len(plain_words(r[1])), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    local = frame.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("own", local)
    con.sql("create view documents as select cast(doc_id as bigint) as doc_id, text from own")
    assert sorted(map(str, con.sql(queries.LICENSE_SQL).fetchall())) == sorted(str(tuple(r)) for r in got)
    labels = {r.doc_id: (r.labels, r.score) for r in got if r.doc_id is not None}
    assert labels[9] == ("cc-by,cc-by-nc-4.0", 1.0) and labels[12] == ("mit", 1.0) and labels[18] == ("apache,apache-2.0", 1.0)
    # words added or left out; not enough of it; every other word another one
    assert labels[13][0] == labels[14][0] == "mit" and 0.6 <= labels[14][1] < 1
    assert labels[15][0] == "" and 0 < labels[15][1] < 0.6 and labels[16] == ("", 0.0) and labels[0] == ("", 0.0)


def test_license_scan_of_other_templates(spark):
    frame = spark.createDataFrame([("a", "see the X11 terms of use, x11 terms"), ("b", None)], "name string, body string")
    got = {r.name: (r.n_base, r.first_word, r.last_word, r.labels) for r in licenses.scan(frame, "name", "body", [("x11", "x11 terms")], [("use", "the x11 terms of use")]).collect()}
    assert got == {"a": (2, 2, 6, "use,x11"), "b": (0, None, None, "")}
    with pytest.raises(ValueError, match="at least"):
        licenses.scan(frame, "name", "body", [("one", "one")])
    assert licenses.scan(frame.limit(0), "name", "body").collect() == []


def whitened_plainly(vectors, top):
    """n, deviations, whitened vectors and explained shares by an eigendecomposition of the whole covariance."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], np.int64)
    own = np.unique(x, axis=0)
    n, s = len(own), own.sum(0)
    mean = lambda m: (m - s // n) - (s % n) / n
    v = mean(own).T @ mean(own) / n
    values, u = np.linalg.eigh(v)
    values, u = values[::-1][:top], u[:, ::-1][:, :top]
    return n, [int(sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s, strict=True))) for row in x], mean(x) @ u / np.sqrt(values), values / np.trace(v)


@pytest.mark.parametrize(("d", "top"), [(64, 16), (200, 16), (5, 16), (40, 3)])
def test_whitening(spark, d, top):
    """Narrow and wide vectors (the latter take restarts), far from zero, with repeats and rows that are dropped."""
    rng = np.random.default_rng(d)
    x = (rng.normal(size=(500, d)) * np.geomspace(3, 0.3, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + 400).astype(np.float32).astype(float).tolist()
    rows = [(i, v, i, 1.0) for i, v in enumerate(x)]
    odd = [(9001, None, 0, 0.0), (9002, [float("nan")] * d, 0, 0.0), (9003, [None, *[1.0] * (d - 1)], 0, 0.0), (9004, [float("-inf")] * d, 0, 0.0), (9005, [], 0, 0.0)]
    frame = spark.createDataFrame([*rows, *rows[:50], (None, x[0], None, None), *odd], "vec_id long, embedding array<double>, component long, x double").repartition(5)
    got = whitening.whiten(frame, top).collect()
    k = min(d, top)
    n, deviations, want, explained = whitened_plainly(x, top)
    assert Counter(r.vec_id for r in got) == Counter({i: k * (1 + (i < 50)) for i in range(500)}) + Counter({None: k})
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    own = np.zeros((500, k))
    for r in got:
        if r.vec_id is not None:
            own[r.vec_id, r.component - 1] = r.whitened
            assert r.deviation == deviations[r.vec_id] and abs(r.explained / explained[r.component - 1] - 1) < 1e-10
    assert np.abs(own * np.sign((own * want).sum(0)) - want).max() < 1e-7
    assert np.allclose([r.whitened for r in sorted((r for r in got if r.vec_id is None), key=lambda r: r.component)], own[0])


def test_whitening_of_few(spark):
    """One vector has no component, three have two, those of another dimension are apart; huge ones have exact or no deviations."""
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.5]), (2, [3.0, 1.0, 0.0]), (3, [1.5, 0.0, 9.0]), (4, [5.0]), (5, [7.0])], kind)).collect()
    assert Counter(r.vec_id for r in got) == {1: 2, 2: 2, 3: 2, 4: 1, 5: 1} and all(abs(abs(r.whitened) - 1) < 1e-12 and r.n == 2 for r in got if r.vec_id > 3)
    big = whitening.whiten(spark.createDataFrame([(1, [1e6, 1.0]), (2, [-1e6, 0.5]), (3, [1e30, 0.5])], kind)).collect()
    assert {r.vec_id for r in big if r.deviation is None} == {1, 2, 3}
    some = whitening.whiten(spark.createDataFrame([(1, [3e6, 1.0]), (2, [-3e6, 0.5])], kind)).collect()
    assert {r.deviation for r in some} == {(2 * 192_000_000) ** 2 + 32**2}
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []


def test_components_of_a_flat_spectrum():
    """Equal and nearly equal eigenvalues, more places than are kept at once."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(150, 150)))[0]
    want = np.r_[9.0, 9.0, 8.999, np.linspace(5, 4, 147)]
    values, u = whitening.components(lambda b: (q * want) @ (q.T @ b), 150, 16)
    assert np.allclose(values, want[:16], rtol=1e-12) and np.abs(u.T @ u - np.eye(16)).max() < 1e-12
    assert np.linalg.norm((q * want) @ (q.T @ u) - u * values, axis=0).max() < 1e-12


def codes_plainly(rows):
    """Ids, codes, errors and the digest by comparing all entries; rows are (id, vector) in order of id."""
    x = [[int(np.floor(256 * c)) for c in v] for _, v in rows]
    d = len(x[0])
    width = [d // 16 + (p < d % 16) for p in range(16)]
    cuts = [(sum(width[:p]), sum(width[: p + 1])) for p in range(16)]
    parts = [[v[a:b] for a, b in cuts] for v in x]
    books = [[list(own[p]) for own in parts[:64]] for p in range(16)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(own[p], books[p][e]), e)) for p in range(16)] for own in parts]

    for _ in range(2):
        codes = assign()
        for p in range(16):
            for e in range(len(books[p])):
                mine = [own[p] for own, c in zip(parts, codes, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(z) // len(mine) for z in zip(*mine, strict=True)]
    codes = assign()
    errors = [sum(far(own[p], books[p][c[p]]) for p in range(16)) for own, c in zip(parts, codes, strict=True)]
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return [("".join(f"{c:02x}" for c in own), e) for own, e in zip(codes, errors, strict=True)], digest


@pytest.mark.parametrize(("d", "n", "scale"), [(32, 300, 1.0), (32, 20, 1.0), (37, 100, 0.01), (10, 90, 1.0), (16, 100, 3e13), (48, 200, 0.004)])
def test_vector_codes(spark, d, n, scale):
    """Against all entries: ties (small steps), few rows, uneven parts, values beyond 64-bit squares; labels and dropped rows."""
    rng = np.random.default_rng(d * n)
    x = (rng.normal(size=(n, d)) * scale).tolist()
    x[7] = x[3]
    labels = [["a", None, "b", ""][i % 4] for i in range(n)]
    rows = [(i * 3 - 50, v, label, "y") for i, (v, label) in enumerate(zip(x, labels, strict=True))]
    odd = [(-9, None, "a", ""), (-8, [float("nan")] * d, "a", ""), (-7, [None] * d, None, ""), (-6, [float("inf")] * d, "a", ""), (-5, [1e300] * d, "a", "")]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, label string, code string").repartition(4)
    got = {r.vec_id: r for r in vector_codes.compress(frame).collect()}
    want, digest = codes_plainly([(r[0], r[1]) for r in rows])
    assert set(got) == {r[0] for r in rows} and {r.codebooks_sha256 for r in got.values()} == {digest}
    long = lambda v: v if v < 2**63 else None
    assert [(got[r[0]].code, got[r[0]].error) for r in rows] == [(c, long(e)) for c, e in want]
    for r, (_, e) in zip(rows, want, strict=True):
        same = [b for a, (_, b) in zip(rows, want, strict=True) if a[2] == r[2]]
        assert got[r[0]].label_error == (long(sum(same)) if all(b < 2**63 for b in same) else None)


def test_vector_codes_of_odd_rows(spark):
    """No rows, one row, repeated rows and rows without ids, another dimension, empty vectors."""
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], kind)).collect() == []
    one = [1.0, *[0.0] * 15]
    got = vector_codes.compress(spark.createDataFrame([(1, one, 1), (1, one, 1), (None, one, None), (5, [2.0] * 32, 1), (6, [], 1)], kind)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == [(i, "00" * 16, 0, 0) for i in ("1", "1", "5", "6", "None")]
    assert len({r.codebooks_sha256 for r in got}) == 3


def test_vector_codes_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(con.sql(queries.codebook_sql()).fetchall()) == sorted(map(tuple, vector_codes.compress(table(spark, SF, "embeddings")).collect()))


def test_scan_needs_few_entries():
    """The radius is sufficient and prunes: from the nearest entry, most others are never looked at."""
    rng = np.random.default_rng(0)
    centres = rng.integers(-5000, 5000, (16, 64, 4))
    x = centres.transpose(1, 0, 2)[rng.integers(0, 64, 400)] + rng.integers(-20, 20, (400, 16, 4))
    books = vector_codes.Books(centres)
    far = ((x[:, :, None] - centres[None]) ** 2).sum(3)
    for start in (np.zeros((400, 16), np.uint8), far.argmin(2).astype(np.uint8)):
        codes, errors = books.assign(x, start)
        assert (codes == far.argmin(2)).all() and (errors == far.min(2)).all()
    looked = (books.far[np.arange(16), codes] <= 4 * errors[:, :, None]).sum()
    assert looked < 1.1 * codes.size
