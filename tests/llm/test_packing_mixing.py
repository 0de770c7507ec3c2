"""Packing and mixing, by exact checks of what they promise."""

import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest

from voxelgrain.llm import mixing, packing

from .conftest import ROWS


@cache
def tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference_ids(text):
    return tokenizer_file().encode(text, add_special_tokens=False).ids


def own_ids(text):
    return packing.encoder(packing.default_vocabulary())(text).tolist()


TEXTS = ["", " ", "  ", "plain words, 12 of them", "naïve café — “quoted”…", "tabs\tand\r\n\n  runs   ", " it's we'll 'S", "日本 🙂   x", "a <|endoftext|> b", "<|endoftext|><|endoftext|> inside", "ab\u200bć Ａ", "a\u00a0 b \u00a0c \u2003d\u3000 e \x85 f", "x \u180e y\u180e z", "\x1c \x1d a \x1e", "word " * 3000]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_file_s(text):
    assert own_ids(text) == reference_ids(text) and own_ids(text) == reference_ids(text)


def test_ids_of_random_texts():
    rng = random.Random(2)
    parts = ["a", "Bc", "'s", "'ll", "9", "12", " ", "  ", "\n", "\t", "\r\n", ".", "!?", "é", "日", "\u00a0", "\u2009", "\u180e", "\x85", "\x1f", "<|endoftext|>", "🙂", "\u0301", "٣", "\ufeff"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))
        assert own_ids(text) == reference_ids(text), repr(text)


def test_ids_on_corpus(corpus):
    for row in corpus.select("text").collect():
        assert own_ids(row["text"]) == reference_ids(row["text"])


def check_packed(rows, sources, capacity):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for ident, text in sources:
        want[ident].append([*reference_ids(text or ""), 2])
    assert set(want) == set(by_doc)
    for ident, copies in want.items():
        ids, times = copies[0], len(copies)
        assert copies == [ids] * times  # rows of this id are all alike here, and so are their pieces
        every = sorted(by_doc[ident], key=lambda r: r["piece"])
        assert len(every) % times == 0
        own = every[::times]
        assert sorted((r["piece"], r["ids_crc32"]) for r in every) == sorted((r["piece"], r["ids_crc32"]) for r in own for _ in range(times))
        assert sum(r["length"] for r in own) == len(ids)
        for k, r in enumerate(own):
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert r["piece"] == k and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
            assert (r["length"] == capacity or k == 0) if len(ids) > capacity else len(own) == 1
    return by_sequence


def test_pieces_tile_documents_and_sequences(docs, empty):
    rows = packing.pack_documents(docs).collect()
    by_sequence = check_packed(rows, [r[:2] for r in ROWS], 1024)
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // 1024) + 1
    assert packing.pack_documents(empty).count() == 0


def test_packing_is_tight_on_corpus(corpus):
    rows = packing.pack_documents(corpus, keep_ids=False).collect()
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 1024) + 2


def test_sequences_hold_their_tokens(spark):
    frame = spark.createDataFrame([(k, f"some words of document {k} " * (k + 1)) for k in range(30)], "doc_id long, text string")
    packed = packing.pack_documents(frame, capacity=64).cache()
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.packed_sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tobytes() == bytes(r["ids"])


def test_plan_uses_every_piece_and_finds_complements():
    plan = packing.plan_sequences({7: 5, 3: 5, 5: 2, 2: 3, 4: 3, 10: 2}, 10)
    used = defaultdict(int)
    for lengths, times in plan:
        assert sum(lengths) <= 10
        for x in lengths:
            used[x] += times
    assert dict(used) == {7: 5, 3: 5, 5: 2, 2: 3, 4: 3, 10: 2}
    assert sum(times for _, times in plan) == 2 + 5 + 1 + 2
    assert packing.ComplementIndex({4: 2, 3: 1, 1: 1}, 10).exact(8) == (4, 4)
    assert sorted(packing.ComplementIndex({4: 1, 3: 1, 1: 1}, 10).exact(8)) == [1, 3, 4]
    assert packing.ComplementIndex({4: 1}, 10).exact(8) is None


def water_level(sizes, weights):
    """Targets by resharing the excess until no source is above its cap."""
    left, open_sources, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_sources:
        total = sum(weights[i] for i in open_sources)
        over = [i for i in open_sources if left * weights[i] / total > 3 * sizes[i]]
        if not over:
            for i in open_sources:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            open_sources.discard(i)
        left -= sum(target[i] for i in over)
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [1, 1000, 10, 500], [0, 0, 5], [0, 0], [3, 900, 2, 1, 40]])
def test_targets_match_repeated_resharing(spark, sizes):
    rows = [(k, f"s{k}" if k else None, n) for k, n in enumerate(sizes)]
    names = sorted((r[1] for r in rows if r[1]), key=str) + [None]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()}
    ordered = [next(r[2] for r in rows if r[1] == n) for n in names]
    want = water_level(ordered, [(5, 2, 1)[k % 3] for k in range(len(names))])
    assert [got[n] for n in names] == pytest.approx(want)


def test_mix_meets_targets_and_repeats(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7919 % 60)), "hot" if k % 3 else f"s{k % 11}") for k in range(9000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(frame).collect()
    again = mixing.mix_sources(frame.repartition(7)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    source = {k: s for k, _, s in rows}
    taken, target = defaultdict(int), {}
    for r in out:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in out))
    for s, t in target.items():
        assert abs(taken[s] - t) <= 61


def test_mix_defined_cases(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert {r["size"] for r in rows if r["doc_id"] == 7} == {40_001}
    out = mixing.take_mixture(docs)
    assert out.columns == docs.columns
    assert mixing.mix_sources(empty).count() == 0 and mixing.take_mixture(empty).count() == 0


def test_mix_draws_rows_without_ids_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 50)
    rows = [(None, f"text number {k}", "a") for k in range(300)] + [(None, "the same words", "a")] * 200 + [(k, "b words " * 9, "b") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sizes = mixing.mix_sources(frame)
    target = {r["source_size"]: r["target"] for r in sizes.collect()}
    out = [tuple(r) for r in mixing.take_mixture(frame).collect()]
    for source in "ab":
        taken, size = (sum(len(r[1].split()) for r in x if r[2] == source) for x in (out, rows))
        assert abs(taken - target[size]) <= 20
    same = sum(r[1] == "the same words" for r in out)
    share = target[300 * 3 + 200 * 3] / 1500
    assert abs(same - 200 * share) < 40 and len({r[1] for r in out if r[0] is None}) > 200


def test_settling_keeps_the_weighted_sum():
    rows = [[1 + k % 17, 0.37] for k in range(500)]
    before = sum(s * p for s, p in rows)
    mixing._settle(rows, "seed")
    assert sum(s * p for s, p in rows) == pytest.approx(before)
    assert sum(1 for _, p in rows if 0 < p < 1) <= 1
