"""Exact and near duplicates against brute force."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from laudospark.llm import exact_dedup, jaccard_join
from laudospark.llm.common import LOWER, UPPER, shared_folder

FOLD = str.maketrans(UPPER, LOWER)
SCHEMA = "doc_id long, text string, lang string, id long, row long, body string, cls long, n int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, 2, "b", 3, 4) for i, t in rows], SCHEMA).repartition(parts)


def rows_for_exact():
    rnd = random.Random(1)
    texts = ["", None, "A", "a", "É", "é", "ab", "abc", "aBd", "abd" * 500, "abd" * 500 + "x", "\n", "k" * 3000]
    rows = [(i, rnd.choice(texts)) for i in range(120)]
    return [*rows, (3, rows[3][1]), (None, "ab"), (None, "only here")]


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("memory", [exact_dedup.TRIE_BYTES, 3000])
def test_exact_groups(spark, largest, memory):
    rows = rows_for_exact()
    got = exact_dedup.exact_groups(frame(spark, rows), keep_largest=largest, trie_bytes=memory).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    owner = {}
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        owner[t] = ((max if largest else min)(known) if known and (largest or None not in ids) else None, len(ids))
    import hashlib

    want = sorted((str(i), str(owner[(t or "").translate(FOLD)][0]), owner[(t or "").translate(FOLD)][1], hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_trie_spills_and_keeps_everything():
    rnd = random.Random(2)
    trie = exact_dedup.Trie(lambda a, b: a + b, 4000)
    want = {}
    for _ in range(3000):
        text = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) * rnd.randint(1, 3)
        want[text] = want.get(text, 0) + 1
        trie.insert(text, 1)
    assert trie.spills
    got = list(trie.items())
    assert len(got) == len(want) and dict(got) == want


def test_drop_copies_keeps_rows_as_they_are(spark):
    docs = frame(spark, [(1, "a"), (2, "A"), (2, "A"), (3, None), (4, ""), (5, "z")])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n) for r in kept.collect()) == [(2, "A", 4), (4, "", 4), (5, "z", 4)]
    assert exact_dedup.drop_copies(docs.where("false")).count() == 0


def brute_components(rows, n=5, threshold=75):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((str(doc), len(sets[i]), str(least.get(find(i)))) for i, (doc, _) in enumerate(rows))


def near_rows(seed, copies):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["lo", "Mi", "na", "é", "ru"]) + str(rnd.randint(0, 400))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(6):
        base = [word() for _ in range(rnd.randint(30, 120))]
        for _ in range(copies if g == 0 else rnd.randint(1, 6)):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 12))):
                text[rnd.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rows += [" ".join([word() for _ in range(rnd.randint(5, 40))] + passage + [word() for _ in range(20)]) for _ in range(12)]
    rows += ["", None, "one two", "ONE two", "one two three four five", "x", "  \n ", rows[0].upper(), rows[0], "É a b c d", "é a b c d"]
    ids = list(range(len(rows)))
    rnd.shuffle(ids)
    return [*zip(ids, rows), (ids[0], rows[0]), (None, rows[1])]


@pytest.mark.parametrize("seed, copies, frequent", [(1, 8, jaccard_join.FREQUENT), (2, 40, 6), (3, 90, 10)])
def test_near_duplicates(spark, monkeypatch, seed, copies, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rows = near_rows(seed, copies)
    got = jaccard_join.near_duplicates(frame(spark, rows)).collect()
    mine = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)
    want = [(d, n, d if d == "None" or not n else c) if c == "None" else (d, n, c) for d, n, c in brute_components(rows)]
    assert mine == want


def test_near_duplicates_of_little(spark):
    empty = frame(spark, [])
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert [tuple(r) for r in jaccard_join.near_duplicates(frame(spark, [(4, None)])).collect()] == [(4, 0, 4)]
    kept = jaccard_join.drop_near_duplicates(frame(spark, [(4, "a b"), (2, "A b"), (9, "")]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "A b"), (9, "")] and kept.columns[-1] == "n"


def test_prefixes_of_similar_sets_share_what_the_bound_says(spark):
    rnd = random.Random(6)
    for _ in range(300):
        union = rnd.sample(range(10_000), rnd.randint(4, 60))
        a = {x for x in union if rnd.random() < 0.95}
        b = {x for x in union if rnd.random() < 0.95}
        if not a or not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        pa, pb = (set(sorted(x)[: jaccard_join.prefix_length(len(x))]) for x in (a, b))
        overlap = -(-75 * (len(a) + len(b)) // 175)
        rest = max(-(-75 * len(x) // 100) - 1 for x in (a, b))
        assert len(pa & pb) >= max(1, overlap - rest)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i % 977}é" for i in range(5000))
    whole = jaccard_join.ngram_set(text)
    monkeypatch.setattr(jaccard_join, "SPAN", 100)
    assert (jaccard_join.ngram_set(text) == whole).all()
    assert len(whole) == len({tuple(text.split()[k : k + 5]) for k in range(4996)})
    assert F is not None


def test_sets_that_differ_too_much_are_not_compared_across_regions(spark, monkeypatch):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"
    passages = [[word() for _ in range(9)] for _ in range(24)]
    rows = [(i, " ".join(w for p in rnd.sample(passages, 6) for w in [*p, word()])) for i in range(150)]
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    met, written = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "FREQUENT", 6)
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: (out := written(df, name), name == "ngram-across" and met.append(out.count()))[0])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect())
    assert got == sorted((d, n, c) for d, n, c in brute_components(rows))
    assert met == [0]
    left = {re.sub("-[0-9a-f]+$", "", name) for name in set(os.listdir(folder)) - before}
    assert "llm-ngram-sets" in left and not left & {"llm-ngram-meetings", "llm-ngram-shares"}


def test_odd_bits_bound_the_difference():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ({rnd.randrange(1 << 64) for _ in range(rnd.randint(1, 90))} for _ in range(2))
        a |= set(rnd.sample(sorted(b), len(b) // 2))
        bits = [jaccard_join.odd_bits(jaccard_join.np.array(sorted(x), "u8")) for x in (a, b)]
        assert sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(*bits)) <= len(a ^ b)
