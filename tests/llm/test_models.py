"""Classifiers by held-out accuracy, fingerprints by true similarity, rollups by recounting."""

import hashlib
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain.llm import fingerprints, langid, quality, token_rollup
from voxelgrain.llm.shared import shared_dir

from .conftest import ROWS
from .test_dedup import words_of


def test_language_held_out_accuracy(corpus, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.95


def test_language_defined_cases(docs, empty):
    rows = langid.predict_languages(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (3, 4, 5, 12))
    assert by_id[13]["lang_pred"] != "und" and by_id[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = langid.keep_identified(docs, least=0.0)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 6, 7, 8, None, 9, 10, 11, 13}
    assert langid.predict_languages(empty).count() == 0
    assert {r["lang_pred"] for r in langid.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_junk_and_unlearnt_texts_go_and_mixed_ones_stay(spark):
    """The bound of production: what the network can't tell goes, texts of the corpus stay whole or mixed."""
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = corpus.where("lang is not null and length(text) between 300 and 3000").limit(60).collect()
    mixed = [(10_000 + k, a["text"] + "\n" + b["text"][: len(a["text"]) // 3], None, "m", 1) for k, (a, b) in enumerate(zip(rows[::2], rows[1::2], strict=True))]
    junk = [(20_000, "12345 67890 " * 30, None, "j", 1), (20_001, None, None, "j", 1), (20_002, "", None, "j", 1), (20_003, "?!.,;:" * 50, None, "j", 1), (20_004, " \n\t", None, "j", 1)]
    more = spark.createDataFrame(mixed + junk, corpus.schema)
    kept = {r["doc_id"] for r in langid.keep_identified(corpus.unionByName(more)).select("doc_id").collect()}
    assert not kept & {r[0] for r in junk} and sum(r[0] in kept for r in mixed) >= 0.9 * len(mixed)
    plain = {r["doc_id"] for r in corpus.where("lang is not null and text rlike '[a-z]{3}'").select("doc_id").collect()}
    assert len(plain & kept) > 0.98 * len(plain)


def test_own_column_names_are_refused(spark, docs):
    from voxelgrain.llm import exact_dedup, mixing
    from voxelgrain.llm.shared import keyed_documents

    for name in ("__vg_lang", "__VG_doc", "__vg_sha"):
        odd = docs.withColumn(name, F.lit(1))
        for operator in (langid.keep_identified, exact_dedup.keep_first_copies, mixing.take_mixture, keyed_documents):
            with pytest.raises(ValueError, match="kept for this library"):
                operator(odd)


def test_stages_need_a_folder_that_machines_share():
    from voxelgrain.stages import _shared_warehouse

    for path in ("file:/home/me/spark-warehouse", "/home/me/spark-warehouse"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            _shared_warehouse(path)
    assert _shared_warehouse("hdfs://store/warehouse/") == "hdfs://store/warehouse"


def test_language_scores_match_a_plain_network(docs):
    """Every window of every text through the layers one number at a time."""
    config = langid.LanguageConfig(window=24, filters=3, embedding=2, epochs=1)
    model = langid.fit_language_model(docs.select("doc_id", "text", "lang"), config)
    w = {k: v.astype(float) for k, v in model.w.items()}
    got = {r["doc_id"]: r for r in langid.with_language(docs.where("length(text) < 500 or text is null"), model).collect()}
    letters = set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
    checked = 0
    for ident, text in {r[0]: r[1] for r in ROWS}.items():
        body = (text or "").encode()
        if ident not in got or not any(c.isalpha() for c in text or ""):
            continue
        total = np.zeros(len(model.classes))
        for at in range(0, len(body), 24):
            window = [b + 32 if 65 <= b < 91 else b for b in body[at : at + 24].ljust(24, b"\0")]
            hidden = []
            for n, k in enumerate(config.widths):
                for f in range(3):
                    best = max(sum(w["embed"][window[p + q], e] * w[f"conv{k}"][q * 2 + e, f] for q in range(k) for e in range(2)) for p in range(24 - k + 1))
                    hidden.append(max(best + w["bias"][n * 3 + f], 0))
            z = np.array(hidden) @ w["out"] + w["out_bias"]
            share = np.exp(z - z.max())
            total += share / share.sum() * sum(b in letters for b in body[at : at + 24])
        total /= total.sum()
        assert abs(got[ident]["__vg_score"] - total.max()) < 1e-4 and model.classes[int(total.argmax())] == got[ident]["__vg_lang"]
        checked += 1
    assert checked > 5


def test_windows_cover_texts():
    data = np.frombuffer(b"a" * 300 + b"b" * 10, np.uint8)
    windows, owner = langid.windows_of(data, np.array([0, 300, 300, 310]), 256)
    assert owner.tolist() == [0, 0, 2] and (windows != 0).sum(axis=1).tolist() == [256, 44, 10]


def test_gradients_against_differences():
    config = langid.LanguageConfig(window=12, filters=3, embedding=2)
    net = langid.ByteCNN(["x", "y"], config)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    windows, target = rng.integers(97, 110, (5, 12)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    weight = np.ones(5)

    def loss():
        hidden, _, _ = net._pool(windows)
        z = hidden @ net.w["out"] + net.w["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(5), target]).mean())

    grads = net._gradients(windows, target, weight)
    for name, g in grads.items():
        at = tuple(np.unravel_index(np.abs(g).argmax(), g.shape))
        old = net.w[name][at]
        net.w[name][at] = old + 1e-6
        up = loss()
        net.w[name][at] = old - 1e-6
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / 2e-6 - g[at]) < 1e-4


def test_quality_separates_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score_quality(docs, labels).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = [r[0] for r in got if r[1] == 1], [r[0] for r in got if r[1] == 0]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(s >= 0.3 for s in good) / len(good) > 0.98


def test_quality_defined_cases(docs, labels, empty, spark):
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(docs, nulls).collect()} == {0.5}
    own = spark.createDataFrame([(1, 1), (1, 0), (9, 0), (10, 1), (6, 1)], "doc_id long, quality int")
    assert quality.score_quality(docs, own).count() == len(ROWS)
    assert quality.score_quality(empty, labels).count() == 0
    assert quality.keep_quality(docs, own).columns == docs.columns


def test_quality_votes_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    config = quality.QualityConfig(neighbours=5)
    model = quality.fit_quality(docs, labels, config)
    rows = [tuple(r) for r in docs.select("doc_id", "text").limit(40).collect()] + [(-1, ""), (-2, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs.select("doc_id", "text").union(frame.where("doc_id < 0")), labels, config).collect()}
    slots, vectors = quality._slots(config), model.vectors.astype(float)
    for ident, text in rows:
        counts = np.zeros(config.features)
        codes = [int(quality._CLASSES[b]) for b in (text or "").encode()]
        for x, y, z in zip(codes, codes[1:], codes[2:]):
            counts[slots[(x * quality._N + y) * quality._N + z]] += 1
        if not counts.any():
            assert abs(got[ident] - model.labels.mean()) < 1e-6
            continue
        v = (np.sqrt(counts / counts.sum()) * model.weights) @ model.directions
        cosines = [float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)) for w in vectors]
        least = sorted(cosines)[-5]
        chosen = [k for k, c in enumerate(cosines) if c >= least - 1e-6]
        votes = [max(cosines[k], 0) ** 4 + 1e-9 for k in chosen]
        assert abs(got[ident] - sum(w * model.labels[k] for w, k in zip(votes, chosen)) / sum(votes)) < 1e-3


def test_trigram_counts_do_not_cross_documents():
    import pyarrow as pa

    config = quality.QualityConfig()
    joined = np.concatenate(list(quality.trigram_counts(pa.array(["ab", None, "A1! x" * 3, "yz"]), config)))
    alone = np.concatenate([np.concatenate(list(quality.trigram_counts(pa.array([t], pa.string()), config))) for t in ["ab", None, "A1! x" * 3, "yz"]])
    assert (joined == alone).all() and joined.sum(axis=1).tolist() == [0, 0, 13, 0]


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (ident, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((ident, len(text), text[: len(text) - half] + after[:half]))
    return out


def test_edited_texts_follow_the_order(docs, empty, spark):
    single = docs.dropDuplicates(["doc_id", "text"])
    want = {i: (n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in edited({r[:2] for r in ROWS})}
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in fingerprints.edited_fingerprints(single).collect()}
    assert got == want
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(5, "only a few words here now")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def shingles5(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_likeness_is_near_the_truth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    texts = dict(rows)
    after = {i: t for i, _, t in edited(rows)}
    errors = []
    got = fingerprints.edited_fingerprints(docs).collect()
    for r in got:
        a, b = shingles5(texts[r["doc_id"]]), shingles5(after[r["doc_id"]])
        errors.append(abs(r["near_edited"] - len(a & b) / max(len(a | b), 1)))
    assert len(got) == len(rows) and np.mean(errors) < 0.04 and np.quantile(errors, 0.99) < 0.15


def test_fingerprints_of_equal_short_and_empty_texts(docs):
    got = [(r["doc_id"], r["fingerprint"]) for r in fingerprints.document_fingerprints(docs).collect()]
    by_id = dict(got)
    assert by_id[7] == by_id[8] and by_id[3] == by_id[4] == by_id[5] == "" and by_id[1] == by_id[2]
    assert len(by_id[9]) == 512 and by_id[9] != by_id[13]


def plain_fingerprint(text, config):
    """One-permutation MinHash in plain Python; Spark's xxhash64 is XXH64 with seed 42, chained over its arguments."""
    import xxhash

    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not words:
        return ""

    def chained(values, h=42):
        for v in values:
            h = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), h)
        return h

    k, mask = config.width, (1 << 63) - 1
    if len(words) >= k:
        hashes = [chained(words[i : i + k]) & mask for i in range(len(words) - k + 1)]
    else:
        hashes = [xxhash.xxh64_intdigest(b"whole", chained(words)) & mask]
    least = [None] * config.bins
    for h in hashes:
        b = h >> config.shift
        least[b] = h if least[b] is None else min(least[b], h)
    rng, filled = np.random.default_rng(config.seed), list(least)
    for _ in range(config.probes):
        target = rng.integers(0, config.bins, config.bins).tolist()
        filled = [least[target[b]] if x is None else x for b, x in enumerate(filled)]
    full = [x for x in least if x is not None]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def first(i):
        return min((signed(xxhash.xxh64_intdigest(i.to_bytes(4, "little"), chained([y >> config.shift]))), y) for y in full)[1]

    low = [(first(i) if x is None else x) & 255 for i, x in enumerate(filled)]
    return "".join(f"{low[i] + (low[i + 1] << 8) + (low[i + 2] << 16) + (low[i + 3] << 24):08x}" for i in range(0, config.bins, 4))


def test_fingerprints_match_brute_force(docs, corpus):
    config = fingerprints.FingerprintConfig()
    got = [(r["doc_id"], r["fingerprint"]) for r in fingerprints.document_fingerprints(docs.select("doc_id", "text").union(corpus.select("doc_id", "text").limit(30))).collect()]
    texts = [(r[0], r[1]) for r in ROWS] + [(r["doc_id"], r["text"]) for r in corpus.limit(30).collect()]
    want = [(i, plain_fingerprint(t, config)) for i, t in texts]
    assert sorted(got, key=str) == sorted(want, key=str)


def recount(rows, version):
    out = {}
    for ident, text, lang, source in rows:
        key = (source, lang, version)
        n, t = out.get(key, (0, 0))
        out[key] = (n + 1, t + token_rollup.count_tokens(text or "", version))
    return out


def totals(rollup):
    return {(r["source"], r["lang"], r["version"]): (r["documents"], r["tokens"]) for r in rollup.totals().collect()}


def test_rollup_follows_inserts_deletes_and_revisions(spark, docs):
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/roll-{uuid.uuid4().hex}")
    columns = ("doc_id", "source", "lang", "text")
    inserts = docs.select(F.lit("insert").alias("op"), *columns)
    assert rollup.apply("one", inserts) and not rollup.apply("one", inserts)
    rows = list(ROWS)
    expect = lambda: recount(rows, "byte_bpe_50k") | recount(rows, "byte_bpe_multi_50k")
    assert totals(rollup) == expect()
    changes = spark.createDataFrame([("delete", 1, None, None, None), ("revise", 2, "c", "en", "new words here"), ("revise", 99, "c", "de", "neu"), ("delete", 1000, None, None, None)], "op string, doc_id long, source string, lang string, text string")
    assert rollup.apply("two", changes) and not rollup.apply("two", changes)
    rows = [r for r in rows if r[0] not in (1, 2)] + [(2, "new words here", "en", "c"), (99, "neu", "de", "c")]
    assert totals(rollup) == expect()
    assert rollup.apply("three", changes.limit(0)) and totals(rollup) == expect()


CHANGE = "op string, doc_id long, source string, lang string, text string, seq long"


def test_rollup_equals_a_recount_after_random_changes(spark):
    rng = random.Random(12)
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/roll-{uuid.uuid4().hex}", ("byte_bpe_50k",))
    held = []  # (id, text, lang, source)
    for batch in range(6):
        changes = []
        for seq in range(rng.randrange(1, 12)):
            op, ident = rng.choice(["insert", "insert", "delete", "revise"]), rng.choice([1, 2, 3, 4, None])
            row = (ident, " ".join(["word"] * rng.randrange(4)) or None, rng.choice(["en", None]), rng.choice("ab"))
            changes.append((op, ident, row[3], row[2], row[1], seq))
            if op != "insert" and ident is not None:
                held = [r for r in held if r[0] != ident]
            if op == "insert" or op == "revise":
                held.append(row)
        frame = spark.createDataFrame(rng.sample(changes, len(changes)), CHANGE)
        assert rollup.apply(f"batch {batch}", frame) and not rollup.apply(f"batch {batch}", frame)
        assert totals(rollup) == recount(held, "byte_bpe_50k")
        if batch % 2:
            assert rollup.compact() and totals(rollup) == recount(held, "byte_bpe_50k")
    assert sum(r["documents"] for r in rollup.ledger().collect()) == len(held)


def test_rollup_orders_changes_without_a_sequence(spark):
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/roll-{uuid.uuid4().hex}", ("byte_bpe_50k",))
    insert, delete = ("insert", 1, "a", "en", "one two", None), ("delete", 1, None, None, None, None)
    assert rollup.apply("a", spark.createDataFrame([insert, insert], CHANGE)) and rollup.apply("b", spark.createDataFrame([insert], CHANGE))
    assert totals(rollup) == {("a", "en", "byte_bpe_50k"): (3, 6)}
    assert rollup.apply("c", spark.createDataFrame([delete, insert], CHANGE)) and totals(rollup) == {}
    revise = ("revise", 1, "a", "en", "one", None)
    assert rollup.apply("d", spark.createDataFrame([revise, revise, insert], CHANGE)) and totals(rollup) == {("a", "en", "byte_bpe_50k"): (1, 1)}


def test_rollup_takes_counts_that_are_brought(spark):
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/roll-{uuid.uuid4().hex}", ("byte_bpe_50k",))
    rows = [("insert", 1, "a", "en", "one two", None, None), ("insert", 2, "a", "en", None, None, {"byte_bpe_50k": 40}), ("insert", 3, "b", None, "x", None, {"other": 9})]
    assert rollup.apply("a", spark.createDataFrame(rows, CHANGE + ", counts map<string, long>"))
    assert totals(rollup) == {("a", "en", "byte_bpe_50k"): (2, 42), ("b", None, "byte_bpe_50k"): (1, 0)}
    assert rollup.apply("b", spark.createDataFrame([("revise", 2, "b", None, None, None, {"byte_bpe_50k": 5})], CHANGE + ", counts map<string, long>"))
    assert totals(rollup) == {("a", "en", "byte_bpe_50k"): (1, 2), ("b", None, "byte_bpe_50k"): (2, 5)}


def test_rollup_commits_one_of_two_writers(spark):
    path = f"{shared_dir(spark)}/roll-{uuid.uuid4().hex}"
    one, two = (token_rollup.TokenRollup(spark, path, ("byte_bpe_50k",)) for _ in range(2))
    commit, rivals = one._commit, [("insert", 5, "a", "en", "three words here", None)]

    def late(number, batch, folder):
        if rivals:  # another writer is faster, with the same batch
            assert two.apply("same", spark.createDataFrame([rivals.pop()], CHANGE))
        return commit(number, batch, folder)

    one._commit = late
    assert not one.apply("same", spark.createDataFrame([("insert", 6, "a", "en", "two words", None)], CHANGE))
    assert totals(one) == {("a", "en", "byte_bpe_50k"): (1, 3)} and one.apply("next", spark.createDataFrame([("delete", 5, None, None, None, None)], CHANGE))
    assert totals(two) == {}


def test_compacted_rollups_remember_batches_and_can_be_cleaned(spark):
    path = f"{shared_dir(spark)}/roll-{uuid.uuid4().hex}"
    rollup = token_rollup.TokenRollup(spark, path, ("byte_bpe_50k",))
    row = lambda ident, text: spark.createDataFrame([("insert", ident, "a", "en", text, None)], CHANGE)
    assert rollup.apply("a", row(1, "one")) and rollup.apply("b", row(2, "one two")) and rollup.compact()
    assert rollup.clean() == 2 and rollup.clean() == 0 and totals(rollup) == {("a", "en", "byte_bpe_50k"): (2, 3)}
    assert not rollup.apply("a", row(1, "one")) and rollup.apply("c", row(3, "x")) and rollup.compact() and rollup.clean() == 2
    assert [rollup.applied(b) for b in "abcd"] == [True, True, True, False] and len(rollup._log()) == 1
    assert not rollup.apply("b", row(2, "one two")) and rollup.apply("d", row(4, "one")) and totals(rollup) == {("a", "en", "byte_bpe_50k"): (4, 5)}
    folders = {f.getPath().getName() for f in rollup._fs.listStatus(rollup._hadoop.Path(f"{path}/data"))}
    assert folders == {r["folder"] for r in rollup._log()}


def test_revisions_count_their_own_texts(spark):
    """After a revision whose text differs, totals are those of a recount, not of what was known before."""
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/roll-{uuid.uuid4().hex}")
    rng = random.Random(3)
    words = ["alpha", "beta gamma", "delta-epsilon", "zeta  eta", "<|endoftext|>", "日本", "x\ny"]
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(0, 9)))
    rows = {k: (text(), rng.choice("ab"), rng.choice(["en", None])) for k in range(60)}
    frame = lambda op: spark.createDataFrame([(op, k, s, lang, t, None) for k, (t, s, lang) in rows.items()], CHANGE)
    assert rollup.apply("load", frame("insert"))
    for k in range(0, 60, 2):
        rows[k] = (text() + " changed", rng.choice("ab"), "de")
    assert rollup.apply("revise", frame("revise"))
    held = [(k, t, lang, s) for k, (t, s, lang) in rows.items()]
    assert totals(rollup) == recount(held, "byte_bpe_50k") | recount(held, "byte_bpe_multi_50k")


def test_revising_query_counts_texts_twice(spark, docs, monkeypatch):
    """The registered query's revisions come with texts, not with counts taken from its own ledger."""
    seen = []
    apply = token_rollup.TokenRollup.apply
    monkeypatch.setattr(token_rollup.TokenRollup, "apply", lambda self, batch, changes: (seen.append((batch, changes)), apply(self, batch, changes))[1])
    token_rollup.token_counts(docs, f"{shared_dir(spark)}/roll-{uuid.uuid4().hex}").count()
    batch, changes = seen[-1]
    assert batch == "second" and "counts" not in changes.columns
    assert changes.where("op = 'revise' and text is not null").count() == sum(1 for r in ROWS if r[1] is not None and r[0] not in (6, None))


def test_rollup_query_equals_a_recount(spark, docs, empty):
    found = token_rollup.token_counts(docs, f"{shared_dir(spark)}/roll-{uuid.uuid4().hex}")
    want = recount(ROWS, "byte_bpe_50k") | recount(ROWS, "byte_bpe_multi_50k")
    assert {(r["source"], r["lang"], r["version"]): (r["documents"], r["tokens"]) for r in found.collect()} == want
    assert token_rollup.token_counts(empty, f"{shared_dir(spark)}/roll-{uuid.uuid4().hex}").count() == 0


def test_words_are_counted_as_defined():
    assert words_of("A b\tC\n") == ["a", "b", "c"]
