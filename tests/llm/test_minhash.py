"""Fingerprints, successors and near documents against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from laudospark.llm import minhash, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_chars string, range int, ahead int, id int"


def frame(spark, rows):
    """Rows with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS)


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    size = min(n, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def by_force(rows):
    """``(id, n_chars, sha256, edited text, text, next text)`` by one sort."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), edit, t, after))
    return out


def texts(rnd, n):
    words = [f"w{i}" for i in range(60)] + ["ção", "日本", "X", "naïve"]
    made = [(i * 3, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 4, 5, 6, 40, 120])))) for i in range(n)]
    return made + [(100_000, None), (100_001, ""), (100_002, " \t\n"), (100_003, "ONE two"), (100_004, "one  TWO"), (100_005, "x" * 5000)]


@pytest.mark.parametrize("parts", [1, 6])
def test_compare_with_next_equals_brute_force(spark, parts):
    rnd = random.Random(4)
    rows = texts(rnd, 150)
    rows += [(None, "a row without identifier"), rows[10], (rows[20][0], "another text of the same identifier"), rows[20]]
    rnd.shuffle(rows)
    want = by_force(rows)
    got = minhash.compare_with_next(frame(spark, rows).repartition(parts)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((str(w[0]), w[1], w[2]) for w in want)
    made = {(str(r.doc_id), r.n_chars, r.edited_sha256): r for r in got}
    of = minhash.signatures([minhash.ngram_set(w[k]) for w in want for k in (3, 4, 5)]).reshape(len(want), 3, -1)
    for (edit, mine, after), w in zip(of, want):
        r = made[(str(w[0]), w[1], w[2])]
        assert (r.fingerprint, r.edited_fingerprint) == tuple(minhash.printed(np.stack([mine, edit])))
        assert r.near_edited == (mine == edit).mean() and r.near_next == (mine == after).mean()
        assert abs(r.near_edited - jaccard(w[3], w[4])) < 0.2 and abs(r.near_next - jaccard(w[4], w[5])) < 0.2


def test_one_row_and_none(spark):
    assert minhash.compare_with_next(frame(spark, [])).collect() == []
    (row,) = minhash.compare_with_next(frame(spark, [(7, "one two three four five six")])).collect()
    assert row.near_next == 1.0 and row.n_chars == 27
    (row,) = minhash.compare_with_next(frame(spark, [(None, None)])).collect()
    assert (row.doc_id, row.n_chars, row.near_edited, row.near_next) == (None, 0, 1.0, 1.0)


def test_a_range_of_one_identifier_is_followed_by_the_next_one(spark):
    rows = [(5, f"t {i} a b c d e f") for i in range(40)] + [(9, "z z z z z z")]
    got = minhash.compare_with_next(frame(spark, rows).repartition(3)).collect()
    assert sorted(r.edited_sha256 for r in got) == sorted(w[2] for w in by_force(rows))


def test_signatures_are_least_images():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, k, np.uint64) for k in (0, 1, 5, 3000, 0, 700)]
    got = minhash.signatures(sets)
    for s, row in zip(sets, got):
        for k in (0, 17, 127):
            a, b = int(minhash._A[k, 0]), int(minhash._B[k, 0])
            images = [(a * (int(x) % minhash.PRIME) + b) % minhash.PRIME for x in s]
            assert int(row[k]) % minhash.PRIME == min(images) if images else row[k] == minhash.NOTHING
    assert (minhash.parsed(minhash.printed(got)[3]) == got[3]).all()


def test_likeness_estimates_similarity():
    rng = np.random.default_rng(6)
    errors = []
    for share in (0.2, 0.5, 0.75, 0.95):
        pool = rng.integers(0, 1 << 63, 600, np.uint64)
        both = int(600 * share)
        a, b = pool[: both + (600 - both) // 2], np.concatenate([pool[:both], pool[both + (600 - both) // 2 :]])
        errors.append(float(minhash.likeness(*(minhash.signatures([x]) for x in (a, b)))[0]) - both / 600)
    assert max(map(abs, errors)) < 0.15


def test_near_documents_equal_brute_force(spark):
    rnd = random.Random(8)
    base = [[f"v{rnd.randrange(400)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(160):  # near copies of few texts, some far from the others of their group
        words = list(base[0] if i < 90 else rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rnd.randrange(60)] = f"new{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A  B"), rows[3], (rows[7][0], "other text under an identifier that is there already"), (None, rows[5][1])]
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    linked = [(i, k) for i in range(len(rows)) for k in range(i) if sets[i] and 100 * len(sets[i] & sets[k]) >= 75 * len(sets[i] | sets[k])]
    while any(label[i] != label[k] for i, k in linked):
        for i, k in linked:
            label[i] = label[k] = min(label[i], label[k])
    ids = lambda of: min((rows[k][0] for k in of if rows[k][0] is not None), default=None)
    want = sorted(
        str((rows[i][0], ids(k for k in range(len(rows)) if k == i or sets[i] and sets[k] == sets[i]), ids(k for k in range(len(rows)) if label[k] == label[i]))) for i in range(len(rows))
    )
    got = minhash.near_documents(frame(spark, rows).repartition(4))
    assert got.columns == ["doc_id", "class_id", "component_id"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert minhash.near_documents(frame(spark, [])).collect() == []


def test_fingerprints_query(spark):
    got = queries.QUERIES["op13_document_fingerprints"](spark, SF)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = {r.doc_id: r for r in got.collect()}
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {i: (r.n_chars, r.edited_sha256) for i, r in rows.items()} == {w[0]: (w[1], w[2]) for w in by_force(source)}
    plain = minhash.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r.doc_id: r.fingerprint for r in plain} == {i: r.fingerprint for i, r in rows.items()}
    by_text = {}
    assert all(by_text.setdefault(t or "", rows[i].fingerprint) == rows[i].fingerprint for i, t in source)
