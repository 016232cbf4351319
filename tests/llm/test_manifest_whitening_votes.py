"""Merkle manifest, whitening and quality votes against brute force; nulls, ties, repeats, long texts, empty tables, clashing names."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from linkloom.llm import merkle, quality_votes, whitening
from linkloom.llm.queries import LLM_QUERIES

F = pytest.importorskip("pyspark.sql.functions")
SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def level_up(nodes):
    return [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]


def siblings_of(nodes, place):
    """[(left, right)] from a node of a tree up, and its root."""
    way = []
    while len(nodes) > 1:
        run = nodes[place // 8 * 8 : place // 8 * 8 + 8]
        way.append(("".join(run[: place % 8]), "".join(run[place % 8 + 1 :])))
        nodes, place = level_up(nodes), place // 8
    return way, nodes[0]


def brute_manifest(rows):
    """doc_id, source, lang, n_chars, text -> sorted result rows, by lists."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    leaf = lambda r, text: sha("".join(map(written, (*r[:4], text))))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for x in langs}
    subroots = [siblings_of([leaf(r, r[4]) for r in trees[x]], 0)[1] for x in langs]
    out = []
    for number, x in enumerate(langs):
        leaves = [leaf(r, r[4]) for r in trees[x]]
        for place, r in enumerate(trees[x]):
            way = siblings_of(leaves, place)[0] + siblings_of(subroots, number)[0]
            root = siblings_of(subroots, number)[1]
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if altered else r[4]
            node = leaf(r, text)
            for left, right in way:
                node = sha(left + node + right)
            out.append((r[0], leaves[place], subroots[number], root, sha("".join(a + b for a, b in way)), node, node == root))
    return sorted(out, key=str)


def manifest_of(spark, folder, rows, columns="doc_id long, source string, lang string, n_chars long, text string, tree string, path long, node string, size long"):
    spark.createDataFrame([(*r, "t", 1, "n", 2) for r in rows], columns).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = LLM_QUERIES["op11_merkle"](spark, str(folder))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.columns == names
    return sorted((tuple(r) for r in got.collect()), key=str)


TEXTS = [None, "", " ", "Été NAÏVE \U0001f600", "lower", "UPPER\nCase", "Z" * 300_000]


@pytest.mark.parametrize("count", [0, 1, 2, 8, 9, 75, 600])
def test_manifest_against_lists(spark, tmp_path, count):
    langs = ["en", "é", None, "de", "a", "b", "c", "d", "e", "f"]
    rows = [(i if i % 13 else None, None if i % 5 == 0 else f"s{i}", langs[0] if i % 3 else langs[i % 10], i or None, TEXTS[i % 7] if i % 50 else TEXTS[6]) for i in range(count)]
    rows += rows[:3]  # repeated rows are leaves of their own
    assert manifest_of(spark, tmp_path, rows) == brute_manifest(rows)


def test_registered_manifest_of_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in LLM_QUERIES["op11_merkle"](spark, SMALL).collect()), key=str)
    assert got == brute_manifest(rows)


def test_a_changed_row_is_found(spark):
    docs = spark.range(100).select(F.col("id"), F.concat(F.lit("Text "), F.col("id")).alias("text"), (F.col("id") % 2).cast("string").alias("g"))
    leaf = lambda text: merkle.leaf_digest(F.col("id"), text)
    made = merkle.manifest(docs, F.col("g"), F.col("id"), leaf(F.col("text")), {"id": F.col("id"), "other": leaf(F.upper("text"))})
    checked = made.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (merkle.folded(F.col("other"), F.col("path")) == F.col("root")).alias("changed"))
    assert checked.distinct().collect() == [(True, False)]


# whitening


def brute_whitening(vectors):
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, values[::-1], vectors[:, ::-1].T


def check_whitening(got, vectors, components):
    """``vectors``: {vec_id: entries} of the fit list, ids unique."""
    n, deviation, centred, values, directions = brute_whitening(list(vectors.values()))
    assert len(got) == n * components
    table = {(r["vec_id"], r["component"]): r for r in got}
    for number in range(1, components + 1):
        expected = centred @ directions[number - 1] / np.sqrt(values[number - 1])
        found = np.array([table[v, number]["whitened"] for v in vectors])
        if (np.abs(np.delete(values, number - 1) - values[number - 1]) > 1e-6 * values[0]).all():  # else the vector is a choice
            assert min(np.abs(found - expected).max(), np.abs(found + expected).max()) < 1e-7
        for (v, d) in zip(vectors, deviation, strict=True):
            r = table[v, number]
            assert (r["n"], r["deviation"]) == (n, d)
            assert r["explained"] == pytest.approx(values[number - 1] / values.sum(), rel=1e-9)
            assert r["identity_error"] < 1e-9
    spread = np.array([[table[v, k]["whitened"] for k in range(1, components + 1)] for v in vectors])
    assert np.abs(spread.T @ spread / n - np.eye(components)).max() < 1e-9


def test_whitening_of_the_small_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    check_whitening(LLM_QUERIES["op12_whitening"](spark, SMALL).collect(), {r["vec_id"]: r["embedding"] for r in rows}, 8)


VECTORS = "vec_id long, embedding array<double>, component string, n string, _vector long, key string"


def test_whitening_with_bad_rows_ties_and_clashes(spark):
    random = np.random.default_rng(1)
    good = {i: [float(c) for c in random.normal(size=5) * [1, 2, 3, 4, 5] + 1e4] for i in range(60)}
    good |= {i + 60: good[i] for i in range(20)}  # repeated vectors
    rows = [(i, v, "x", "y", 0, "k") for i, v in good.items()]
    bad = [None, [], [1.0, None, 3.0, 4.0, 5.0], [float("nan")] * 5, [float("inf"), 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], [1e300] * 5]
    rows += [(1000 + i, v, None, None, None, None) for i, v in enumerate(bad)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    check_whitening(got, good, 5)
    no_key = whitening.whiten(spark.createDataFrame([(None, *r[1:]) for r in rows[:10]], VECTORS)).collect()
    assert len(no_key) == 50 and all(r["vec_id"] is None for r in no_key)


def test_whitening_of_degenerate_tables(spark):
    table = lambda vectors: spark.createDataFrame([(i, v, "", "", 0, "") for i, v in enumerate(vectors)], VECTORS)
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 7, [[]] * 3):
        got = whitening.whiten(table(vectors))
        assert got.columns[:2] == ["vec_id", "component"] and got.count() == 0
    assert whitening.whiten(table([[1.0, 0.0], [2.0, 0.0], [4.0, 0.0]])).count() == 3  # one component with spread
    equal = [[float(s if k == d else 0) for k in range(4)] for d in range(4) for s in (-1, 1)]  # four equal eigenvalues
    check_whitening(whitening.whiten(table(equal)).collect(), dict(enumerate(equal)), 4)


def test_deviation_beyond_a_long_is_null(spark):
    big = [(i, [float(2.0**41 * (i % 2)), float(i)], "", "", 0, "") for i in range(64)]
    assert {r["deviation"] for r in whitening.whiten(spark.createDataFrame(big, VECTORS)).collect()} == {None}


def test_inertia_counts_and_components_against_eigvalsh():
    random = np.random.default_rng(7)
    for size in (1, 2, 3, 10, 40):
        for kind in range(4):
            a = random.normal(size=(size, size))
            a = a + a.T if kind < 2 else a @ a.T
            a[np.abs(a) < 0.5 * (kind % 2)] = 0.0
            values = np.linalg.eigvalsh(a)
            for shift in (*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1, 0.1234):
                if np.abs(values - shift).min() > 1e-9:
                    assert whitening.inertia(a, shift) == (values < shift).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    for spectrum in ([9, 9, 9, 4, 1], [1 + 1e-9, 1, 0.5, 0.25], [5, 1e-3, 1e-6], [3, 2, 0, 0, 0]):
        basis = np.linalg.qr(random.normal(size=(len(spectrum), len(spectrum))))[0]
        matrix = basis * spectrum @ basis.T
        values, vectors = whitening.leading_components((matrix + matrix.T) / 2, 4)
        positive = [s for s in sorted(spectrum, reverse=True) if s > 0][:4]
        assert np.allclose(values, positive, rtol=1e-12, atol=1e-14 * max(spectrum))
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-13)
        assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-13 * max(spectrum) * 10


# quality votes


def slow_terms(body):
    """The terms of a short text by a dictionary."""
    found = Counter()
    padded = b" " + body + b" "
    kind = lambda b: 5 if b == 10 else 4 if b in b" \t\r\x0b\x0c" else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 1 if 97 <= b <= 122 or b >= 128 else 6 if b in b".," else 7
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        mixed = (a * 2654435761 + b * 2246822519 + c * 3266489917) % 2**32 * 668265263 % 2**32
        found["g", mixed >> 21] += 1
        found["s", kind(a) * 64 + kind(b) * 8 + kind(c)] += 1
    words = body.split()
    seen, last = set(), None
    for word in words:
        found["r", 0 if word not in seen else 1] += 1
        found["r", 2 if last == word else 3] += 1
        seen.add(word)
        last = word
    values = np.zeros(quality_votes.WIDTH)
    for name, first in zip("gsr", quality_votes.BOUNDS, strict=False):
        total = sum(n for (k, _), n in found.items() if k == name)
        for (k, place), n in found.items():
            if k == name:
                values[first + place] = np.sqrt(n / total)
    values[quality_votes.BOUNDS[3] + len(words).bit_length()] = quality_votes.LENGTH_WEIGHT
    return values / np.linalg.norm(values)


def test_terms_against_a_dictionary():
    for text in ("", "a", "The THE the the The", "Été, naïve 12 | x\n\ny", "spam spam spam spam"):
        assert np.allclose(quality_votes.text_terms(text.encode()), slow_terms(text.encode()))
    long = ("word other " * 200_000).encode()
    assert np.isclose(np.linalg.norm(quality_votes.text_terms(long)), 1.0)
    assert not np.allclose(quality_votes.text_terms(long), quality_votes.text_terms(long[: len(long) // 2] + b"!!! " * 100_000))


def test_votes_against_one_text_at_a_time():
    random = np.random.default_rng(5)
    vectors = random.normal(size=(300, 6))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels, weights = (random.random(300) < 0.7).astype(float), random.integers(1, 4, 300).astype(float)
    voters = quality_votes.Voters(np.eye(6), vectors, labels, weights, 5, 8)
    texts = random.normal(size=(40, 6))
    texts[0] = 0.0
    scores = voters.scores(texts)
    assert scores[0] == pytest.approx((labels * weights).sum() / weights.sum())
    for text, score in zip(texts[1:], scores[1:], strict=True):
        near = sorted(((max(0.0, round(float(v @ text / np.linalg.norm(text)), 6)), n) for n, v in enumerate(vectors)), reverse=True)[:5]
        total = sum(s**8 * weights[n] for s, n in near)
        assert score == pytest.approx(sum(s**8 * weights[n] * labels[n] for s, n in near) / total, rel=1e-6)


def test_latent_directions_against_svd(spark):
    random = np.random.default_rng(2)
    rows = random.normal(size=(50, 5)) * [9, 5, 3, 0.01, 0.01] @ random.normal(size=(5, quality_votes.WIDTH))
    found = quality_votes._directions(spark.createDataFrame([([float(v) for v in r],) for r in rows], "terms array<double>"), 2, 5)
    expected = np.linalg.svd(rows, full_matrices=False)[2][1:3].T
    assert np.allclose(np.abs(found.T @ expected), np.eye(2), atol=1e-6)


DOCS = "doc_id long, text string, score string, row long, predicted string, _key long, _label string"


def test_votes_on_odd_rows(spark):
    good, junk = "a calm text about the sea and the hills, written in whole words. ", "BUY!! BUY!! $$$ ### NOW!! "
    texts = [None, "", " \n", "x" * 700_000, good * 3, good * 3, *[good * (i % 5 + 1) for i in range(40)], *[junk * (i % 5 + 1) for i in range(40)]]
    docs = spark.createDataFrame([(i or None, t, "clash", 7, "clash", 8, "clash") for i, t in enumerate(texts)], DOCS)
    marks = [(i, 1 if i < 46 else 0, "clash") for i in range(4, len(texts), 2)] + [(None, 0, ""), (9_999, 1, ""), (8, 5, ""), (10, None, ""), (4, 1, "")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, text string")
    voters = quality_votes.fit(docs, labels)
    got = quality_votes.vote(docs, voters, "text", 0.7).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["row"]["score"] == "clash" and r["row"]["row"] == 7 and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        if r["row"]["doc_id"] and r["row"]["doc_id"] >= 4:
            assert r["predicted"] == (r["row"]["doc_id"] < 46)
    nothing = quality_votes.fit(docs, labels.limit(0))
    assert nothing is None
    assert {(r["score"], r["predicted"]) for r in quality_votes.vote(docs, nothing, "text", 0.7).collect()} == {(0.5, 0)}
    assert quality_votes.vote(docs.limit(0), voters, "text", 0.7).count() == 0
    both = quality_votes.fit(docs, labels.where("quality = 1"))  # one label only
    assert {r["score"] for r in quality_votes.vote(docs, both, "text", 0.7).collect()} == {1.0}


def test_held_out_quality(spark):
    got = LLM_QUERIES["op13_quality_votes"](spark, "/root/testdata/sf0.01").collect()
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    judged = [(r["predicted"], marks[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in marks]
    assert len(judged) > 50 and sum(a == b for a, b in judged) / len(judged) >= 0.97
