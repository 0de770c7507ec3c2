"""The corpus pipeline stage by stage, and the registered queries."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxelgrain.llm import langid
from voxelgrain.llm import queries as registered

from .test_dedup import brute_exact, brute_near
from .test_packing_mixing import reference_ids, water_level


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "mix_sources", "best_fit_packing"]


def test_stages_return_documents_and_only_shrink_or_repeat(spark, corpus):
    docs = corpus
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert after.columns == docs.columns
        assert after.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
        if name != "mix_sources":
            assert 0 < after.count() <= docs.count()
        docs = after


def test_stages_take_empty_tables(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_stages_take_awkward_rows(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_each_stage_has_the_results_that_it_states(spark, docs):
    """Nulls, repeated rows, ties and clashing names, stage by stage."""
    run = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)
    known = run["language_id"](spark, docs, "")
    assert known.columns == docs.columns and not set(ids(known)) & {3, 4, 5, 12}
    assert run["language_id"](spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == 0
    exact = run["exact_dedup"](spark, docs, "").cache()
    assert exact.columns == docs.columns and ids(exact) == sorted([1, 3, 5, 6, 7, None, 9, 10, 11, 12, 13], key=str)
    near = run["minhash_near_dedup"](spark, docs, "").cache()
    # copies, also of other white space, are near copies, and 11 shares most of its shingles with 10; wordless and unlike rows stay
    assert near.columns == docs.columns and set(ids(near)) == {1, 3, 4, 5, 6, 7, None, 9, 10, 12, 13} and ids(near).count(6) == 1
    mixed = run["mix_sources"](spark, docs, "").cache()
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(docs))
    assert mixed.join(docs.select("doc_id", "source"), ["doc_id"], "left_semi").count() == mixed.where("doc_id is not null").count()
    packed = run["best_fit_packing"](spark, docs, "").cache()
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.where("doc_id in (3, 4)").agg(F.min("length"), F.max("length")).first()[:] == (1, 1)
    pieces = Counter((r["doc_id"], r["piece"]) for r in packed.collect())
    assert pieces[6, 0] == 2 and pieces[None, 0] == 1
    for name in ("language_id", "exact_dedup", "minhash_near_dedup", "mix_sources"):
        with pytest.raises(ValueError, match="kept for this library"):
            run[name](spark, docs.withColumn("__vg_id", F.lit(1)), "")


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").cache()
    assert out.agg(F.max("length")).first()[0] <= 1024 and out.count() > 0


def test_stages_match_brute_force(spark, corpus):
    run = {name: stage for name, stage in corpus_pipeline.STAGES}
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    given = rows(corpus)
    # language: what the classifier's own scores say
    known = run["language_id"](spark, corpus, "").cache()
    scores = {r["doc_id"]: r for r in langid.predict_languages(corpus).collect()}
    classes = len({r["lang_pred"] for r in scores.values()} - {"und"})
    bound = 1 / classes + 0.07 * (1 - 1 / classes) - 1e-6
    kept = rows(known)
    assert sorted(kept) == sorted(r for r in given if scores[r[0]]["lang_pred"] != "und" and scores[r[0]]["score"] >= bound)
    # exact and near copies
    exact = run["exact_dedup"](spark, known, "").cache()
    owners = {r[0] for r in brute_exact([r[:2] for r in kept]) if r[3]}
    assert sorted(rows(exact)) == sorted(r for r in kept if r[0] in owners)
    near = run["minhash_near_dedup"](spark, exact, "").cache()
    firsts = {r[0] for r in brute_near([r[:2] for r in rows(exact)], 5, 80) if r[3]}
    assert sorted(rows(near)) == sorted(r for r in rows(exact) if r[0] in firsts)
    # the mix: whole copies, three at most, words of each source at its target but for one document's
    mixed = run["mix_sources"](spark, near, "").cache()
    copies, source, size = Counter(r[0] for r in rows(mixed)), {r[0]: r[2] for r in rows(near)}, {r[0]: len(r[1].split()) for r in rows(near)}
    assert set(copies) <= set(source) and max(copies.values()) <= 3
    names = sorted(set(source.values()))
    held = {s: sum(size[i] for i in source if source[i] == s) for s in names}
    targets = dict(zip(names, water_level([held[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])))
    for s in names:
        taken = sum(size[i] * n for i, n in copies.items() if source[i] == s)
        assert abs(taken - targets[s]) <= max(size[i] for i in source if source[i] == s)
    # packing: sequences without gaps, and of each document's tokens as many copies as were drawn
    packed = run["best_fit_packing"](spark, mixed, "").collect()
    pieces, places = defaultdict(Counter), defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]][r["start"], bytes(r["ids"])] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for one in places.values():
        one.sort()
        assert [o for o, _ in one] == [sum(n for _, n in one[:k]) for k in range(len(one))] and sum(n for _, n in one) <= 1024
    texts = {r[0]: r[1] for r in rows(near)}
    assert set(pieces) == set(copies)
    for ident, n in copies.items():
        whole = b"".join(ids for _, ids in sorted(pieces[ident]))
        assert np.frombuffer(whole, "<u4").tolist() == [*reference_ids(texts[ident]), 2] and set(pieces[ident].values()) == {n}


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_has_one_query(n):
    assert sum(name.startswith(f"op{n}_") for name in registered.queries()) == 1
    assert set(registered.oracle_sql()) <= set(registered.queries())
