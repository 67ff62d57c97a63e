"""Language identification, token counts, quality scores and packing, each against a plainer way."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from laudospark.llm import language_id, packing, quality, token_count

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ALPHABET = "abcdefgthe'sinTRELLΣσİéèçñ日本語١٢٣  \n\t\ŕ　\x1c\x85!#.'_😀👍🏽ﬁ½"
CLASHING = "doc_id long, text string, score double, row long, key long, lang string, body string, n int"


def texts_with_oddities():
    rnd = random.Random(5)
    out = ["", " ", "\n", "a" * 300, "<|endoftext|>", "x<|startoftext|> y<|endoftext|>", "Don't we'Ll'S 12a", "word " * 4000]
    return out + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(400)]


def clashing(spark, texts):
    rows = [(i, t, 0.5, -1, -2, "en", "b", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING)


def test_token_counts_are_the_library_s(spark):
    texts = texts_with_oddities()
    library, machine = Tokenizer.from_file(WORD), token_count.Transducer(WORD)
    for t in texts:
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert [machine.count(t, chunk) for chunk in (1, 3, 1 << 15)] == [want] * 3, t
    rows = token_count.count_tokens(clashing(spark, [*texts, None, texts[7]]), WORD, limit=100).orderBy("doc_id").collect()
    assert rows[0].n_tokens == rows[-2].n_tokens == rows[-2].n_bytes == 0
    assert rows[7].over_limit and rows[-1][1:] == rows[7][1:]
    assert [r.n_bytes for r in rows[:-2]] == [len(t.encode()) for t in texts]


def test_token_counts_of_nothing(spark):
    assert token_count.count_tokens(clashing(spark, []), WORD).count() == 0


def test_transducer_forgets_but_counts(monkeypatch):
    monkeypatch.setattr(token_count, "MOST_STATES", 20)
    monkeypatch.setattr(token_count, "MOST_WORDS", 5)
    machine, library = token_count.Transducer(WORD), Tokenizer.from_file(WORD)
    for t in ("several words that are all different", "and again several different words", "z" * 200):
        assert machine.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_unit_encoder_gives_the_library_s_ids():
    library, ours = Tokenizer.from_file(BYTE), packing.UnitEncoder(BYTE)
    for t in texts_with_oddities():
        assert ours.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


def sequences(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == out.get(r.sequence_id, 0)
        out[r.sequence_id] = r.offset + r.length
    return out


def test_packing_covers_every_token_once(spark):
    import zlib

    library = Tokenizer.from_file(BYTE)
    texts = [*texts_with_oddities(), None, "same", "same", "long text " * 900]
    rows = packing.pack_texts(clashing(spark, texts).repartition(3), BYTE).collect()
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    seen = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(piece.tobytes())
        seen[r.doc_id] = r.start + r.length
    assert seen == {i: len(x) for i, x in enumerate(ids)}
    lengths = list(sequences(rows).values())
    assert max(lengths) <= 1024
    padding = sum(1024 - n for n in lengths if n & (n - 1))
    assert padding < 0.02 * sum(map(len, ids))
    assert packing.pack_texts(clashing(spark, []), BYTE).count() == 0


@pytest.mark.parametrize("cutting", [True, False])
def test_packer_keeps_every_limit(cutting):
    rnd = random.Random(2)
    placed = []
    packer = packing.Packer((100, 5, 60), cutting, lambda *x: placed.append(x), pool=16)
    sizes = [rnd.randint(1, 90) for _ in range(300)]
    loss = lambda a, b: b // 2 - a // 2
    for i, n in enumerate(sizes):
        packer.add(i, n, loss)
    packer.finish()
    by = {}
    for example, start, length, sequence, offset in placed:
        by.setdefault(sequence, []).append((start, length, offset))
    for parts in by.values():
        assert sum(p[1] for p in parts) <= 100 and len(parts) <= 5
        assert sum(loss(p[0], p[0] + p[1]) for p in parts) <= 60
        assert [p[2] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))]
    assert sum(p[2] for p in placed) == sum(sizes)


def words(rnd, letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def test_language_id_learns_and_handles_edges(spark):
    rnd = random.Random(1)
    train = [(i, words(rnd, "abcde" if i % 2 else "vwxyz", 30), "one" if i % 2 else "two") for i in range(60)]
    rows = [*train, (100, None, "one"), (101, "123 !!", "one"), (102, "", None), (103, "abc dea", None), (104, "zyx vvw", None), (104, "zyx vvw", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS key", "3 AS kept_x")
    model = language_id.train(docs.where("doc_id < 60"))
    assert model[0] == ["one", "two"]
    got = {(r.doc_id): (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in train)
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == "one" and got[104][0] == "two" and 0 <= got[103][1] <= 1
    nothing = language_id.train(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.where("false"), model).count() == 0


def test_ngrams_do_not_depend_on_how_a_text_is_cut():
    rnd = random.Random(3)
    text = words(rnd, "abcdé ŁX.1", 400)
    whole = np.sort(language_id.ngram_buckets([text], 1 << 20)[0])
    parts = list(language_id.cut(text, 50))
    assert "".join(parts) == text and len(parts) > 10
    assert (np.sort(language_id.ngram_buckets(parts, 1 << 20)[0]) == whole).all()


def test_ngram_scores_equal_a_plain_sum(spark):
    texts = ["ab ba", "ÁB  ba!"]
    b, owner = language_id.ngram_buckets(texts, 1 << 30)
    assert (np.sort(b[owner == 0]) == np.sort(language_id.ngram_buckets(["ab ba"], 1 << 30)[0])).all()
    # Letters alone, pairs with their blanks, and triples whose inner code point is a letter.
    plain = [c for c in "abba"] + [" a", "ab", "b ", " b", "ba", "a "] + [" ab", "ab ", " ba", "ba "]
    assert len(b[owner == 0]) == len(plain)


def test_quality_votes_like_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, words(rnd, "abcdef", 40) if i % 3 else words(rnd, "#$%&X", 40)) for i in range(90)]
    docs = spark.createDataFrame([*rows, (90, None), (91, ""), (5, rows[5][1])], "doc_id long, text string").selectExpr("*", "9 AS score", "1 AS key")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(61, None, 0), (None, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 3 > 0) for i in range(90))
    assert got[90] == got[91] == pytest.approx(model.mean)
    # The vote again, one document and one neighbour at a time.
    raw = quality.counts([rows[70][1]])
    x = quality.unit(quality.weighted(raw, model.idf) @ model.basis)[0]
    near = sorted(((float(x @ v), y) for v, y in zip(model.vectors, model.labels)), reverse=True)[: quality.NEIGHBOURS]
    weight = [max(s, 0) ** quality.SHARPNESS for s, _ in near]
    votes = sum(w * y for w, (_, y) in zip(weight, near)) + quality.MEAN_VOTES * model.mean
    assert got[70] == pytest.approx(votes / (sum(weight) + quality.MEAN_VOTES), abs=1e-4)
    empty = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score_documents(docs, empty).collect()} == {0.5}
    assert quality.score_documents(docs.where("false"), model).count() == 0


def test_shapes_see_whole_words():
    start = "ab1-" * 60
    one, other = (quality.counts([start + end])[0, quality.WORDS :] for end in ("tail" * 50, "TAIL9" * 50))
    assert (one != other).any() and one.sum() == other.sum() == 1
    kept = quality.Cells()
    assert kept["x" * 201] != kept["y" + "X-" * 100] and not kept and kept["short"] >= 0 and len(kept) == 1


def test_many_short_rows_are_packed_without_padding(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("a b")).otherwise(F.lit("")).alias("text")).repartition(2)
    rows = packing.pack_texts(docs, BYTE, max_segments=256).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        size = sum(n for _, n in pieces)
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert size & (size - 1) == 0 and size <= 1024 and len(pieces) <= 256
    assert sum(r.length for r in rows) == 1000 * 3 + 2000 and len({r.doc_id for r in rows}) == 3000
