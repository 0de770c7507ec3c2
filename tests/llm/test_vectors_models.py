"""Vector codes, tokenizer alignment and language-model scores against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelgrain.llm import alignment, lm_scoring, vector_codes
from voxelgrain.llm.queries import oracle_sql

from .conftest import ROWS

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long"


def brute_codes(rows, config=vector_codes.CodeConfig()):
    rows = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(config.scale * float(v)) for v in r[1]] for r in rows]).reshape(len(rows), config.parts, -1)
    books = x[: config.entries].transpose(1, 0, 2).copy()
    assign = lambda: np.stack([((x[:, p][:, None] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(config.parts)], axis=1)
    for _ in range(config.rounds):
        code = assign()
        for p in range(config.parts):
            for e in range(books.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    books[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    code = assign()
    error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(axis=1) for p in range(config.parts))
    by_label = Counter()
    for r, e in zip(rows, error.tolist(), strict=True):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((r[0], bytes(c).hex(), e, by_label[r[2]], digest) for r, c, e in zip(rows, code.astype(np.uint8), error.tolist(), strict=True)), key=str)


def coded(df, config=vector_codes.CodeConfig()):
    return sorted((tuple(r) for r in vector_codes.compressed_vectors(df, config).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_match_lloyd_with_ties_nulls_and_repeats(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(16)], rng.choice([1, 2, None]), "c", 7) for k in range(300)]
    rows += [rows[5], (None, [0.25] * 16, None, "c", 7), (400, None, 1, "c", 7), (401, [float("nan")] * 16, 1, "c", 7), (402, [None] * 16, 1, "c", 7), (403, [float("-inf")] + [0.0] * 15, 1, "c", 7)]
    df = spark.createDataFrame(rows, VECTORS)
    for parts in (3, 11):
        assert coded(df.repartition(parts)) == brute_codes(rows)


def test_codes_of_large_components_fewer_rows_and_none(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-2000, 2000) for _ in range(16)], 1, "c", 7) for k in range(9)]
    df = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    assert coded(df) == brute_codes(rows)
    assert coded(df.limit(0)) == []
    with pytest.raises(Exception, match="components must stay within"):
        coded(spark.createDataFrame([(1, [1e30] * 16, 1, "c", 7)], VECTORS))
    short = spark.createDataFrame([*rows, (50, [1.0] * 8, 1, "c", 7)], VECTORS.replace("float", "double"))
    assert [r[1:3] for r in coded(short) if r[0] == 50] == [(None, None)]


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(1)
    heads = rng.integers(-4000, 4000, (16, 4))
    x = (heads[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 4)))[:, None]
    before = heads[None].astype(np.int64)
    group = vector_codes.entry_groups(before, 4)
    code, bounds = vector_codes.YinyangKernel(before, group).first(x)
    for _ in range(4):
        entries = before + rng.integers(-40, 40, before.shape)
        kernel = vector_codes.YinyangKernel(entries, group, before)
        code, bounds = kernel.again(x, code, bounds.astype(np.float32))
        assert (code[:, 0] == vector_codes.squared_distances(x[:, 0], entries[0]).argmin(axis=1)).all()
        assert kernel.scanned < 0.2 * len(x) * 16
        before = entries


def test_codes_match_their_sql(spark, tmp_path):
    import duckdb

    path = "/root/testdata/sf0.001/embeddings.parquet"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    want = db.sql(oracle_sql()["op11_vector_codes"]).select("vec_id, code, error, label_error, codebooks_sha256").fetchall()
    assert coded(spark.read.parquet(path)) == sorted(want, key=str)


def plain_alignment(rows):
    """Straight from the definitions: token spans, overlaps, counts over all texts."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_file.encode_special_tokens = True
    b_file = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    from tokenizers import decoders

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends[:-1]], ends, strict=True))

    table = alignment._byte_of()
    assert decoders.ByteLevel().decode(["".join(c for c, b in sorted(table.items(), key=lambda t: t[1]) if b in range(32, 127))]) == "".join(map(chr, range(32, 127)))
    documents, counts = [], Counter()
    for ident, text in rows:
        found = None
        if text:
            raw = (" " + text).encode()
            a, b = a_file.encode(" " + text, add_special_tokens=False).ids, b_file.encode(text)
            of_a = [bytes(table[c] for c in a_file.id_to_token(i)) for i in a]
            of_b = [bytes([int(b_file.id_to_piece(i)[3:5], 16)]) if b_file.is_byte(i) else b_file.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(of_a) == raw and b"".join(of_b) == raw:
                sa, sb = spans(of_a), spans(of_b)
                links, j = [], 0
                for i, (s, e) in enumerate(sa):
                    while sb[j][1] <= s:
                        j += 1
                    links += [(a[i], b[k]) for k in range(j, len(sb)) if sb[k][0] < e] if len(sb) < 200 else [(a[i], b[k]) for k in range(j, min(j + 40, len(sb))) if sb[k][0] < e]
                groups, i, j = [], 0, 0
                for stop in sorted({e for _, e in sa} & {e for _, e in sb}):
                    own_a, own_b = [], []
                    while i < len(sa) and sa[i][1] <= stop:
                        own_a.append(str(a[i]))
                        i += 1
                    while j < len(sb) and sb[j][1] <= stop:
                        own_b.append(str(b[j]))
                        j += 1
                    groups.append(",".join(own_a) + "|" + ",".join(own_b))
                found = len(a), len(b), groups, links
                counts.update(links)
        documents.append((ident, found))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for ident, found in documents:
        if found is None:
            out.append((ident, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = found
            out.append((ident, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def align(df, config=alignment.AlignConfig()):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in alignment.align_tokenizers(df, config).select(names).collect()), key=str)


def test_alignment_of_awkward_rows(docs, empty):
    assert align(docs) == plain_alignment([r[:2] for r in ROWS])
    assert align(empty) == []


def test_alignment_at_any_block_and_split(spark):
    rng = random.Random(5)
    signs = "ab é ßñ \n\t  xyz▁<|endoftext|>日本🙂 　 \x00\x85 's12.,"
    rows = [(k, "".join(rng.choice(signs) for _ in range(rng.randrange(0, 40)))) for k in range(1500)]
    rows += [(None, "a b"), (7, None), (9, " "), (10, "▁"), (11, "a ▁ b"), (12, "\n"), (13, "the the " * 2000), (14, "a<|endoftext|> b"), (15, "Hello\n world\nfoo  bar")]
    want = plain_alignment(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # tiny blocks, sides split over many tasks, sums passed on at once, stretches forgotten
    for parts, config in ((2, alignment.AlignConfig()), (5, alignment.AlignConfig(block_bytes=2000, split_bytes=400, hold=2000, known=100))):
        assert align(df.repartition(parts), config) == want


def test_alignment_on_corpus(corpus):
    assert align(corpus) == plain_alignment([tuple(r) for r in corpus.select("doc_id", "text").collect()])


def test_posts_of_many_occurrences_round_trip():
    at, codes = np.array([0] * 1000 + [3] * 2), np.array([5 << 16 | 9] * 1000 + [5 << 16 | 9, 6 << 16 | 1])
    (sides, posts), pairs, counts = alignment._postings(at, codes)
    docs, a, times = alignment.unpack_posts(posts[0])
    assert sides.tolist() == [5, 6] and docs.tolist() == [0, 0, 0, 0, 3] and times.sum() == 1001 and set(a.tolist()) == {9}
    assert dict(zip(pairs.tolist(), counts.tolist(), strict=True)) == {5 << 16 | 9: 1001, 6 << 16 | 1: 1}


def plain_base(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, words in split if i is not None and not out(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    score = lambda w: math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))
    return sorted(((i, out(i), len(words), sum(counts[w] > 0 for w in words), n, round(sum(map(score, words)), 4)) for i, words in split), key=str)


def scored(df, config=lm_scoring.LMConfig()):
    rows = lm_scoring.score_documents(df, config).collect()
    assert all(r["score"] < 0 for r in rows)
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows), key=str), rows


def test_base_scores_of_awkward_rows(docs, empty):
    assert scored(docs)[0] == plain_base([r[:2] for r in ROWS])
    assert scored(empty)[0] == []


def test_base_scores_in_small_blocks_and_scores_of_held_out_texts(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_base([tuple(r) for r in corpus.select("doc_id", "text").collect()])
    got, rows = scored(corpus.repartition(3), lm_scoring.LMConfig(block_bytes=20_000, known=2000))
    assert got == want
    # far better than subwords by their counts alone, and near words that are known whole
    held = [r for r in rows if r["held_out"]]
    per_token = lambda c: sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)
    assert per_token("score") > 1.06 * per_token("base_score")


def small_model(slots=40):
    config = lm_scoring.LMConfig(slots=slots, shared=8, classes=8, singles=3, width=4, hidden=5, window=8, stride=6)
    rng = np.random.default_rng(3)
    counts = np.zeros(lm_scoring.IDS, np.int64)
    counts[:200] = rng.integers(0, 50, 200)
    lexicon = lm_scoring.Lexicon(counts, config).with_neighbours(rng.integers(0, 9, (slots, slots)))
    model = lm_scoring.CausalAttention(lexicon, config)
    return model.with_flat(rng.normal(0, 0.3, model.flat().size)), rng


def test_probabilities_of_what_follows_add_up_to_one():
    model, rng = small_model()
    c = model.config
    before = rng.integers(0, 200, c.window)
    scores = lm_scoring.Scorer(model).windows(np.stack([np.append(before, k) for k in range(lm_scoring.IDS)]))[:, -1]
    assert np.exp(scores).sum() == pytest.approx(1, abs=1e-4)


def test_later_ids_change_nothing_and_each_is_scored_once():
    model, rng = small_model()
    scorer, c = lm_scoring.Scorer(model), model.config
    text = np.append(rng.integers(0, 200, 50), lm_scoring.END)
    whole = scorer.texts([text])[0] * math.log(10)
    # each id by itself, with the context that its window gives it
    full, n = lm_scoring.padded(text, c)
    alone = 0.0
    for k in range(len(text)):
        window = lm_scoring.windows_at(full, np.array([k // c.stride]), c).copy()
        window[0, c.window - c.stride + k % c.stride + 2 :] = 7  # what comes after it
        alone += scorer.windows(window)[0, k % c.stride]
    assert whole == pytest.approx(alone, rel=1e-5)
    many = [text[:3], text, text[:1], np.tile(text, 900)]
    assert scorer.texts(many)[:3] == pytest.approx([scorer.texts([t])[0] for t in many[:3]])


def test_gradients_are_those_of_the_loss():
    model, rng = small_model()
    c = model.config
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    windows, weight = rng.integers(0, c.slots, (5, c.window + 1)), rng.integers(0, 2, (5, c.stride)) > 0
    weight[0] = True

    def loss():
        scorer = lm_scoring.Scorer(model)
        slots = model.lexicon.slot
        ids = np.array([np.flatnonzero(slots == k)[0] for k in range(c.slots)])[windows]
        found = scorer.windows(ids) - model.lexicon.log_id[ids[:, -c.stride :]] - model.lexicon.log_slot[windows[:, -c.stride - 1 : -1], windows[:, -c.stride :]]
        return -(found * weight).sum() / weight.sum()

    grads = model.gradients(windows, weight)
    for name, g in grads.items():
        at = tuple(rng.integers(0, n) for n in g.shape) if name != "emb" else (windows[0, -2], 1)
        model.w[name][at] += 1e-4
        up = loss()
        model.w[name][at] -= 2e-4
        down = loss()
        model.w[name][at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(g[at], rel=2e-2, abs=2e-5), name


def test_fitting_lowers_the_loss_and_reruns_agree(spark):
    model, rng = small_model()
    windows = np.cumsum(rng.integers(1, 3, (400, model.config.window + 1)), axis=1) % model.config.slots
    weight = np.ones((400, model.config.stride), bool)
    target = model.lexicon.klass[windows[:, -model.config.stride :]]

    def loss():
        ids = np.array([np.flatnonzero(model.lexicon.slot == k)[0] for k in range(model.config.slots)])[windows]
        return -(lm_scoring.Scorer(model).windows(ids) - model.lexicon.log_slot[windows[:, -model.config.stride - 1 : -1], windows[:, -model.config.stride :]]).mean()

    before = loss()
    for turn in range(6):
        model.fit(windows, weight, 1e-2, turn)
    assert loss() < before - 0.3 and target.max() < model.config.classes
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    once, again = (sorted((r["doc_id"], r["score"]) for r in lm_scoring.score_documents(corpus).collect()) for _ in range(2))
    assert once == again


def test_every_window_of_a_text_is_fitted_in_one_of_the_rounds():
    import pyarrow as pa

    config = lm_scoring.LMConfig(part=5)
    lexicon = lm_scoring.Lexicon(np.arange(lm_scoring.IDS), config)
    texts = [np.arange(n) % 500 for n in (1, 24, 25, 700, 4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.astype("<u2").tobytes() for t in texts])], ["at", "ids"])
    scored = [sum(int(c.sum()) for _, c in lm_scoring._training_windows(iter([batch]), lexicon, config, turn, 3)) for turn in range(3)]
    assert sum(scored) == sum(map(len, texts)) and min(scored) > 0
    sizes = [len(w) for w, _ in lm_scoring._training_windows(iter([batch]), lexicon, config, 0, 1)]
    assert max(sizes) <= config.part and sum(sizes) == sum(-(-len(t) // config.stride) for t in texts)


def test_words_are_shuffled_once_for_their_counts(corpus, monkeypatch):
    plans = []

    def kept(df, name, cut=lm_scoring.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(lm_scoring, "cut", kept)
    lm_scoring.score_documents(corpus.limit(20))
    assert sum(plan.count("Exchange hashpartitioning(name") for plan in plans) == 1 and not any("Join" in plan for plan in plans)


def test_words_are_numbered_as_they_come_and_encoded_alone():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known, (encode, _) = lm_scoring.WordIds(path), lm_scoring.ranked(path)
    for words in (["the", "\xa0a", "\x1cb", "don't", "日本", "the", "c　", "᠎x"], ["d\x1f", "new", "the"], []):
        places = np.array([known.index[w.encode()] for w in words], np.int64)
        known.learn()
        assert [known.names[k].decode() for k in places] == words
        assert [x.tolist() for x in known.of_texts(places, np.ones(len(words), np.int64))] == [[*encode(" " + w), lm_scoring.END] for w in words]


def test_words_of_a_block_travel_in_few_rows(corpus, monkeypatch):
    rows = {}

    def kept(df, name, cut=lm_scoring.cut):
        out = cut(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(lm_scoring, "cut", kept)
    docs, groups = corpus.limit(20).coalesce(1), int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lm_scoring.score_documents(docs)
    assert rows["word-counts"] <= 2 * groups and rows["encoded"] <= 21 + groups


def test_words_of_several_blocks_are_remembered():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known, (encode, _) = lm_scoring.WordIds(path), lm_scoring.ranked(path)
    words = [b"one", b"unheardof", b"three", b"of"]
    for w in words:
        known.index[w]
    known.learn()
    known.seen[:] = [2, 1, 3, 2]
    known.forget(3)
    assert known.names == [b"one", b"three", b"of"] and dict(known.index) == {b"one": 0, b"three": 1, b"of": 2}
    places = np.array([known.index[w] for w in words], np.int64)
    known.learn()
    assert [x.tolist() for x in known.of_texts(places, np.ones(4, np.int64))] == [[*encode(" " + w.decode()), lm_scoring.END] for w in words]
    known.seen[:] = 2
    known.forget(3)
    assert known.names == [] and len(known.ids) == len(known.index) == 0


def test_attention_costs_few_products_a_window():
    config = lm_scoring.LMConfig()
    graph = lm_scoring._forward(config, np.dtype(np.float32))
    # keys and values have no products of their own over all positions of a window
    assert sum(b"MatMul" in node or b"Gemm" in node for node in graph.nodes) == 7


def test_tables_and_groups_of_words_do_not_grow_with_few_partitions_or_many_tasks(spark, monkeypatch):
    words = [f"word{k}" for k in range(3000)]
    rows = [(k, " ".join(words[k % 50 :: 50] + words[:500])) for k in range(200)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string").repartition(200)
    kept, tables, cut, summed = {}, [], lm_scoring.cut, lm_scoring._summed
    monkeypatch.setattr(lm_scoring, "cut", lambda df, name: kept.setdefault(name, cut(df, name)) if name == "encoded" else cut(df, name))
    monkeypatch.setattr(lm_scoring, "_summed", lambda df, kind: tables.append(df.rdd.getNumPartitions()) or summed(df, kind))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got, _ = scored(corpus, lm_scoring.LMConfig(rounds=1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_base(rows)
    # a block's words are dealt to many groups, so that no task holds a large share of all words
    share = kept["encoded"].where("name_group is not null").agg(F.max(F.octet_length("places")) / 4).first()[0]
    assert share <= 20  # of about 560 words
    assert tables[1] <= max(32, 4 * spark.sparkContext.defaultParallelism) < 200


def test_batches_end_at_so_many_bytes(spark):
    from voxelgrain.llm.shared import bounded_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 100_000).cast("binary").alias("data"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    with bounded_batches(spark, 1 << 20):
        assert max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect()) <= 12
    assert spark.conf.get(key, None) == before
