"""Source mixing, vector search, the pipeline and the registered queries."""

import math
import random
import re

import duckdb
import numpy as np
import pytest

from laudospark.llm import ann, mixing, queries

SF = "/root/testdata/sf0.001"


def mix_rows(rnd):
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 400))), rnd.choice(["b", "a", None, "c", "b", "b"])) for i in range(120)]
    return [*rows, (3, *rows[3][1:]), (None, "x y", "a"), (200, None, "a"), (201, "", "empty"), (202, "lone\x0bword\xa0here", "z")]


def brute_targets(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted((s for s in sizes), key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    level = 1.5 * sum(sizes.values())
    low, high = 0.0, 2 * level
    for _ in range(200):  # the level at which capped shares add up
        middle = (low + high) / 2
        if sum(min(middle * weights[s], 2 * sizes[s]) for s in names) < level:
            low = middle
        else:
            high = middle
    return sizes, {s: min(high * weights[s], 2 * sizes[s]) for s in names}


@pytest.mark.parametrize("block", [1, 16, 1024])
def test_mix(spark, block):
    rows = mix_rows(random.Random(1))
    docs = spark.createDataFrame([(*r, 5, 6, 7) for r in rows], "doc_id long, text string, source string, size int, slot int, offset int")
    documents, schedule, pieces = mixing.mix(docs, block_words=block)
    got = mixing.taken_words(documents, pieces).collect()
    sizes, target = brute_targets(rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.taken <= 2 * r["size"] and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], abs=1e-6)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.taken_words(*[x for i, x in enumerate(mixing.mix(docs.repartition(5), block_words=block)) if i != 1]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # Pieces are the words of the schedule, each slot's once.
    words = {r.slot: r.words for r in schedule.collect()}
    laid = {r.slot: r.n for r in pieces.groupBy("slot").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert laid == words


def test_mix_is_even_at_every_prefix():
    counts = np.array([500, 300, 150, 50])
    of = mixing.golden_slots(counts, 0, 1000)
    for n in (50, 200, 777, 1000):
        assert all(abs((of[:n] == s).sum() - n * c / 1000) <= 4 for s, c in enumerate(counts))


def test_mix_of_little(spark):
    schema = "doc_id long, text string, source string"
    for rows in ([], [(1, None, None)], [(1, "one", "s")]):
        documents, _, pieces = mixing.mix(spark.createDataFrame(rows, schema))
        got = mixing.taken_words(documents, pieces).collect()
        assert len(got) == len(rows) and all(r.taken == math.floor(1.5 * r["size"] + 0.5) for r in got)
    kept = mixing.keep_taken(spark.createDataFrame([(1, "one", "s"), (2, "", "s"), (3, None, None)], schema))
    assert [tuple(r) for r in kept.collect()] == [(1, "one", "s")]


@pytest.mark.parametrize("block", [1, 16, 1024])
def test_mixed_texts_follow_the_targets(spark, block):
    rnd = random.Random(4)
    rows = [(i, " \n".join(f"d{i}w{j}" for j in range(rnd.randint(1, 400))) + "\n", rnd.choice(["b", "a", None, "b"]), i) for i in range(80)]
    # Same identifier, source and size with different texts; no identifier; equal rows; nothing to take.
    rows += [(7, "x y z", "a", 1), (7, "p q r", "a", 2), (None, "k  l", "b", 3), (None, "m\tn", "b", 4), (9, "t u", "b", 5), (9, "t u", "b", 5), (300, None, "a", 6), (301, " ", "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(5)
    out = mixing.mixed_texts(docs, block_words=block)
    got = out.collect()
    assert out.columns == docs.columns
    words = re.compile(r"[^\x20\x09-\x0D]+")
    sizes, target = brute_targets([r[:3] for r in rows])
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + len(words.findall(r.text))
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    # Every row is the start of its own document; at most one document of a source is cut short within an epoch.
    visits, cut = {}, {}
    for r in got:
        mine = [d for d in rows if d[0] == r.doc_id and d[2:] == (r.source, r.n_chars)]
        assert mine and all(d[1].startswith(r.text) for d in mine)
        visits[r.doc_id, r.n_chars] = visits.get((r.doc_id, r.n_chars), 0) + 1
        cut[r.source] = cut.get(r.source, 0) + (r.text != mine[0][1])
    assert set(visits) <= {(r[0], r[3]) for r in rows if (r[1] or "").strip()} and max(visits.values()) <= 4
    assert max(visits[k] for k in visits if k != (9, 5)) == 2 and max(cut.values()) <= 1
    assert sorted(map(str, mixing.mixed_texts(docs.repartition(3), block_words=block).collect())) == sorted(map(str, got))


def test_the_pipeline_mixes_to_weight(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, target = brute_targets([(r.doc_id, r.text, r.source) for r in docs.collect()])
    taken = {}
    for r in P.mixed(spark, docs, SF).collect():
        taken[r.source] = taken.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in sizes) and sum(taken.values()) > 1.4 * sum(sizes.values())


def brute_search(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = []
    for q, a in good:
        if q % 50:
            continue
        near = {}
        for i, b in good:
            if i != q:
                near[i] = max(near.get(i, -2), round(float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), 12))
        out += [(q, rank, i) for rank, (i, _) in enumerate(sorted(near.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(set(out))


def test_search_is_exact_where_all_is_probed(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 420)]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [None, *[1.0] * 7]), (504, [float("nan")] * 8), (505, [float("inf"), *[1.0] * 7]), (506, [1.0] * 9), (None, [1.0] * 8), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, part int").repartition(3)
    got = ann.search(df, lambda c: c % 50 == 0, k=5)
    mine = sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect())
    assert mine == brute_search(rows, 5)
    assert ann.search(df.where("false"), lambda c: c % 50 == 0).count() == 0
    few = ann.search(df.where("vec_id in (0, 1, 2)"), lambda c: c % 50 == 0)
    assert sorted((r["rank"] for r in few.collect())) == [1, 2]


def test_ties_by_the_thousand_take_little_memory():
    import tracemalloc

    import pandas as pd

    v = np.random.default_rng(3).standard_normal(64)
    ids = np.random.default_rng(4).permutation(20_000)
    for scale in (lambda i: 1.0, lambda i: 1.0 + i % 7):  # equal vectors, and multiples, which are as near
        rows = pd.DataFrame({"id": ids, "v": [v * scale(i) for i in ids]})
        tracemalloc.start()
        got = ann.best(rows[rows["id"] % 100 == 0], rows, 5)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 600 << 20
        exact = {i: ((v * scale(0)) * (v * scale(i))).sum() / (np.sqrt(((v * scale(0)) ** 2).sum()) * np.sqrt(((v * scale(i)) ** 2).sum())) for i in range(1, 60)}
        first = got[got["query_id"] == 0]
        if scale(1) == 1.0:
            assert list(first["vec_id"]) == [1, 2, 3, 4, 5] and list(got[got["query_id"] == 100]["vec_id"]) == [0, 1, 2, 3, 4]
        assert len(got) == 1000 and abs(first["score"].to_numpy() - max(exact.values())).max() < 1e-12


def test_search_recall_with_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(df, lambda c: c % 50 == 0, k=5, rows_per_partition=250).toPandas()
    table = df.toPandas()
    x = np.array(table.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = table.vec_id.to_numpy()
    hits = n = 0
    for q, found in got.groupby("query_id"):
        near = x @ x[np.flatnonzero(ids == q)[0]]
        near[ids == q] = -2
        hits += len(set(ids[np.argsort(-near)[:5]]) & set(found.vec_id))
        n += 5
        assert sorted(found["rank"]) == [1, 2, 3, 4, 5] and (found.sort_values("rank").score.diff().dropna() <= 0).all()
    assert n == 5 * (ids % 50 == 0).sum() and hits / n >= 0.9


@pytest.mark.parametrize("n", [300, 2000])
def test_small_tables_have_learned_partitions(n):
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((12, 32))[rng.integers(0, 12, n)] * 2 + rng.standard_normal((n, 32)))
    router = ann.fit(x, n, 5)
    parts = router.w2.shape[1]
    assert parts == math.isqrt(n) >= 8 and 1 <= router.probes < parts and router.w1.any()
    u = ann.unit(x)
    filed = router.route(u.astype(np.float32), 1)[:, 0]
    near = ann.graph(u, 5)
    probed = router.route(u.astype(np.float32), router.probes)
    assert (filed[near][:, :, None] == probed[:, None, :]).any(axis=2).mean() >= ann.RECALL


def test_probes_are_calibrated_on_rows_held_out(monkeypatch):
    seen = []
    learn, calibrate = ann.learn, ann.calibrate
    monkeypatch.setattr(ann, "learn", lambda x, *a: seen.append(x) or learn(x, *a))
    monkeypatch.setattr(ann, "calibrate", lambda router, held, *a: seen.append(held) or calibrate(router, held, *a))
    ann.fit(np.random.default_rng(7).standard_normal((400, 16)), 400, 5)
    trained, held = seen
    assert len(trained) == 300 and len(held) == 100 and not {r.tobytes() for r in trained} & {r.tobytes() for r in held}


def test_balanced_partitions_and_router():
    rng = np.random.default_rng(2)
    x = ann.unit((rng.standard_normal((8, 16))[rng.integers(0, 8, 1600)] * 2 + rng.standard_normal((1600, 16))).astype(np.float32))
    label = ann.balanced_partition(x, ann.graph(x, 10), 8)
    assert np.bincount(label, minlength=8).max() <= math.ceil(1.15 * 200)
    router = ann.learn(x, label, 8)
    assert (router.route(x, 1)[:, 0] == label).mean() > 0.8


@pytest.mark.parametrize("name", queries.ORACLES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    mine = sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert mine == sorted(con.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    planted = spark.createDataFrame([(10_000, before[1], "en", "src1", 5), (10_001, before[1].upper(), "en", "src1", 5), (10_002, None, "en", None, 0)], docs.schema)
    frame = docs.unionByName(planted)
    for _, stage in P.STAGES:
        out = stage(spark, frame, SF)
        if stage is not P.packed:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / stage.__name__))
        frame = spark.read.parquet(str(tmp_path / stage.__name__))
    rows = {s.__name__: {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / s.__name__)).select("doc_id", *(["text"] if s is not P.packed else [])).selectExpr("doc_id", "text" if s is not P.packed else "'' AS text").collect()} for _, s in P.STAGES}
    assert 1 not in rows["one_of_equal"] and 10_001 in rows["one_of_equal"]
    folded = [(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in rows["one_of_equal"].values()]
    assert len(set(folded)) == len(folded)
    assert set(rows["one_of_equal"]) >= set(rows["one_of_near"]) >= set(rows["mixed"]) == set(rows["packed"])
    assert 10_002 not in rows["mixed"]
    again = P.run(spark, SF)
    assert again.select("doc_id").distinct().count() > 100


def test_every_query_is_registered():
    import __spark_entry__ as E

    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(queries.ORACLES) <= set(E.oracle_sql())
    assert [f"op{i}_" in " ".join(queries.QUERIES) for i in range(1, 11)] == [True] * 10


def test_texts_of_the_mix_are_shuffled_twice(spark):
    """For numbering and join together, and into the mix's order; before, numbering and join each shuffled them."""
    docs = spark.createDataFrame([(i, f"word {i} " * (1 + i % 5), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.mixed_texts(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "__same" in line]
    assert len(dealt) == 1, dealt  # the places beside them are dealt by a grouping expression
