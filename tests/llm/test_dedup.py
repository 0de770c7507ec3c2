"""Exact and near duplicates, repeated lines and passages, against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelgrain.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from voxelgrain.llm.textkernel import shingle_sets

from .conftest import LONG, ROWS

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_exact(rows):
    groups = defaultdict(list)
    for ident, text in rows:
        groups[SPACE.sub(" ", text or "")].append(ident)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        seen = set()
        for i in ids:
            out.append((i, keep, len(ids), i == keep and i not in seen, hashlib.sha256(norm.encode()).hexdigest()))
            seen.add(i)
    return sorted(out, key=str)


def test_exact_matches_brute_force(docs):
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == brute_exact([r[:2] for r in ROWS])


def test_exact_on_corpus(corpus):
    rows = [tuple(r) for r in corpus.select("doc_id", "text").collect()]
    got = [tuple(r) for r in exact_dedup.exact_duplicates(corpus).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == brute_exact(rows)


def test_exact_keeps_columns_and_first_rows(docs, empty):
    out = exact_dedup.keep_first_copies(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(ids, key=str) == sorted([1, 3, 5, 6, 7, None, 9, 10, 11, 12, 13], key=str)
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.keep_first_copies(empty).count() == 0


def test_trie_against_dictionary():
    rng = random.Random(5)
    trie, want = exact_dedup.PatriciaTrie(), {}
    for _ in range(3000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9)))
        ident = rng.choice([None, rng.randrange(1000)])
        trie.insert(key, ident, 1)
        low, n = want.get(key, (None, 0))
        want[key] = (ident if low is None else low if ident is None else min(low, ident), n + 1)
    before = trie.size
    part = {k: (i, n) for k, i, n in trie.spill_subtrees(before - 1)}
    assert set(part) == {k for k in want if k[:1] == b"a"} and 0 < trie.size < before
    trie.insert(b"abba", 7, 2)
    rest = {k: (i, n) for k, i, n in trie.spill()}
    assert rest.pop(b"abba") == (7, 2) and part | rest == want and trie.size == 0


def _trie_batch(rows):
    types = (pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=False)], ["body", "ident", "copies"][: len(rows[0])])


def test_trie_shares_prefixes_and_spills_by_subtree(monkeypatch):
    trie, stem = exact_dedup.PatriciaTrie(), b"a long beginning that all of these texts have, " * 4
    for k in range(50):
        trie.insert(stem + bytes([65 + k]) * 3, k, 1)
    assert trie.size == len(stem) + 150  # the stem is held once
    before = {k: (i, n) for k, i, n in trie.spill_before(stem + b"FFF")}
    assert before == {stem + bytes([65 + k]) * 3: (k, 1) for k in range(5)} and trie.size == len(stem) + 135
    rng = random.Random(4)
    texts = [stem[: rng.randrange(len(stem))] + bytes(rng.choice(b"xyz") for _ in range(rng.randrange(4))) for _ in range(2000)]
    want = {}
    for k, body in enumerate(texts):
        low, n = want.get(body, (k, 0))
        want[body] = (min(low, k), n + 1)
    monkeypatch.setattr(exact_dedup, "SPILL_BYTES", 200)
    partial = [tuple(r.values()) for b in exact_dedup._collapse(iter([_trie_batch([(t, k) for k, t in enumerate(texts)])])) for r in b.to_pylist()]
    assert len(partial) > len(want) and sum(r[2] for r in partial) == 2000
    final = [tuple(r.values()) for b in exact_dedup._own(iter([_trie_batch(sorted(partial[:900] + partial[900:]))])) for r in b.to_pylist()]
    assert len(final) == len(want) and {k: (i, n) for k, i, n in final} == want


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SPACE.split(low) if w]


def shingles_of(text, width):
    w = words_of(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_near(rows, width, percent):
    sets = [(i, shingles_of(t, width)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    groups = defaultdict(list)
    for k in range(len(sets)):
        groups[find(k)].append(k)
    out = []
    for members in groups.values():
        known = [sets[k][0] for k in members if sets[k][0] is not None]
        low = min(known) if known else None
        out += [(sets[k][0], len(sets[k][1]), low, sets[k][0] == low) for k in members]
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_matches_brute_force(spark, docs, width, percent):
    rng = random.Random(width)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [r[:2] for r in ROWS]
    ident = 100
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 160))]
        rows.append((ident, " ".join(base)))
        for _ in range(rng.randrange(1, 9)):
            ident += 1
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((ident, " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
        ident += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dedup.near_duplicates(frame, near_dedup.ForestConfig(width=width, percent=percent))
    got = sorted([tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)
    assert got == brute_near(rows, width, percent)


def test_near_keeps_one_of_a_large_group(spark):
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(300):
        copy = list(base)
        copy[(k * 37) % 120] = f"edit{k}"
        rows.append((k, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    config = near_dedup.ForestConfig(width=3, percent=85, reach=16)
    out = near_dedup.near_duplicates(frame, config)
    got = sorted(tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted(brute_near(rows, 3, 85))


def test_near_links_pairs_in_a_dense_family(spark):
    rows = []
    for k in range(400):  # 120 words in common: 0.75 alike; each of the last 20 shares 12 more words with one other
        own = [f"own{k}-{x}" for x in range(20)]
        if k >= 380:
            own[:12] = [f"pair{k // 2}-{x}" for x in range(12)]
        rows.append((k, " ".join([f"t{x}" for x in range(120)] + own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = near_dedup.near_duplicates(frame, near_dedup.ForestConfig(width=1, percent=85, trees=4, near=1, reach=4))
    got = sorted(tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted(brute_near(rows, 1, 85)) and sum(not r[3] for r in got) == 10


@pytest.mark.parametrize("percent", [80, 85])
def test_near_verifies_nearly_all_pairs_at_the_bound(percent):
    config, p = near_dedup.ForestConfig(percent=percent), percent / 100
    missed = sum(math.comb(config.hashes, x) * p**x * (1 - p) ** (config.hashes - x) for x in range(config.hashes + 1) if x / config.hashes < config.likely)
    assert missed < 1e-7


def test_near_proposes_the_likeliest_neighbour_in_another_component():
    config = near_dedup.ForestConfig()
    one = np.random.default_rng(4).integers(0, 256, config.hashes).astype(np.uint8)
    close, closest = one.copy(), one.copy()
    close[[8, *range(45, 240, 40)]] += 1
    closest[[9]] += 1
    columns = [[0] * 4, [b"headhd"] * 4, [b"a", b"b", b"c", b"d"], [100] * 4, [1, 2, 3, 3], [x.tobytes() for x in (one, close, one, closest)]]
    types = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["tree", "head", "digest", "n", "comp", "sig"])
    got = [(r["digest"], r["other"]) for b in near_dedup._neighbours(config, config.reach)(iter([batch])) for r in b.to_pylist()]
    assert got == [(b"b", b"a"), (b"c", b"a"), (b"d", b"a")]


@pytest.mark.parametrize("partitions", [4, 32])
def test_near_finds_every_pair_of_a_family_just_under_the_bound(spark, partitions):
    """100 pairs at 0.869 among 200 documents whose other similarities are 0.849: neighbours can't tell them apart."""
    rng = random.Random(6)
    rows = []
    for k in range(200):
        own = [f"own{k}-{x}" for x in range(16)]
        if k % 2:
            own[:2] = [f"own{k - 1}-{x}" for x in range(2)]
        words = [f"t{x}" for x in range(184)] + own
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    assert (lambda a, b, c: (len(a & b) / len(a | b) > 0.85, len(a & c) / len(a | c) < 0.852))(*(shingles_of(rows[k][1], 1) for k in (0, 1, 2))) == (True, True)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        out = near_dedup.near_duplicates(frame, near_dedup.ForestConfig(width=1, percent=86, reach=16))
        got = [tuple(r) for r in out.select("doc_id", "component_id").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got) == [(k, k - k % 2) for k in range(200)]


def test_near_keeps_unique_texts_of_repeated_ids(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:30], "other", *base[31:]])
    rows = [(1, " ".join(base)), (7, near), (7, "a text of its own that nothing repeats"), (7, "and one more that stands alone here"), (None, near), (None, "alone without an id"), (None, "alone without an id"), (9, "same row"), (9, "same row")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    config = near_dedup.ForestConfig(width=1, percent=80)
    kept = sorted((tuple(r) for r in near_dedup.keep_representatives(frame, config).collect()), key=str)
    assert kept == sorted([rows[k] for k in (0, 2, 3, 5, 7)], key=str)


def test_near_links_rows_without_ids(spark):
    base = [[f"{c}{k}" for k in range(120)] for c in "pqrs"]
    edit = lambda words, *at: " ".join(f"edit{k}" if k in at else w for k, w in enumerate(words))
    rows = [(1, edit(base[0])), (None, edit(base[0], 5, 6, 7)), (2, edit(base[0], 5, 6, 7, 60, 61, 62, 63)), (None, edit(base[0])), (-3, edit(base[3]))]
    rows += [(None, edit(base[1])), (None, edit(base[1], 9)), (None, edit(base[2])), (None, edit(base[2], 50)), (None, "alone"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    config = near_dedup.ForestConfig(width=3, percent=85)
    out = near_dedup.near_duplicates(frame, config).select("doc_id", "n_shingles", "component_id", "kept")
    want = brute_near(rows, 3, 85)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want and (2, 118, 1, False) in want
    kept = [tuple(r) for r in near_dedup.keep_representatives(frame, config).collect()]
    assert len(kept) == 6 and {rows[0], rows[4], rows[9], rows[10]} < set(kept)
    assert len({rows[5], rows[6]} & set(kept)) == 1 and len({rows[7], rows[8]} & set(kept)) == 1


def test_near_keeps_columns(docs, empty):
    out = near_dedup.keep_representatives(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {1, 3, 4, 5, 6, 7, None, 9, 10, 12, 13}
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.keep_representatives(empty).count() == 0


@pytest.mark.parametrize("width", [1, 3, 5])
def test_shingles_have_the_sizes_of_true_sets(width):
    texts = [r[1] for r in ROWS] + ["a b c a b c a b c", "A b C", "\x0b x\x0c y \x85 z", "tail " * 3]
    kernel = list(shingle_sets(pa.array(texts, pa.string()), width, lower=True))
    assert [len(s) for s in kernel] == [len(shingles_of(t, width)) for t in texts]
    for a, x in zip(kernel, texts, strict=True):
        for b, y in zip(kernel, texts, strict=True):
            assert len(np.intersect1d(a, b)) == len(shingles_of(x, width) & shingles_of(y, width))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("bound", [0, 1, 2])
def test_lines_match_brute_force(spark, bound):
    rng = random.Random(3 + bound)
    letters = "abcdéfgh ij🙂"
    lines = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30 if bound < 2 else 9))) for _ in range(30)]
    for line in list(lines):
        for _ in range(rng.randrange(1, 1 + max(bound, 1))):
            at = rng.randrange(len(line) + 1)
            line = rng.choice([line[:at] + line[at + 1 :], line[:at] + "Z" + line[at:], line[:at] + "Q" + line[at + 1 :], line[:-1], "x" + line, line])
        lines.append(line)
    lines += ["", "  ", "short", "short", "shorty", "a", "b", "aa", "abab", "baba", "aaaa", "aaa", "ab" * 40, "ab" * 40 + "a", "ba" * 40]
    rng.shuffle(lines)
    rows = [(n, "\n".join(lines[3 * n : 3 * n + 3])) for n in range(-(-len(lines) // 3))]
    flat = [(n, k, line) for n, text in rows for k, line in enumerate(text.split("\n"))]
    want = []
    for at, (n, k, line) in enumerate(flat):
        before = {x[2] for x in flat[:at]}
        first = min(x[:2] for x in flat if x[2] == line)
        blank = not line.strip(" ")
        near = any(x.strip(" ") and x != line and distance(x, line) <= bound for x in {y[2] for y in flat if (y[0], y[1]) < first})
        want.append((n, k, not blank and line in before, near and not blank))
    out = line_dedup.line_decisions(spark.createDataFrame(rows, "doc_id long, text string"), line_dedup.LineConfig(distance=bound))
    assert sorted(tuple(r) for r in out.select("doc_id", "line_no", "equal", "near").collect()) == sorted(want)


def test_one_very_long_line(spark):
    body = "".join(random.Random(1).choice("abcdefgh") for _ in range(120_000))
    rows = [(1, body), (2, body[:60_000] + body[60_001:]), (3, body[:40_000] + "Z" + body[40_001:] + "\nother words"), (4, body[::-1])]
    out = line_dedup.line_decisions(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["line_no"]) for r in out.where("near").collect()) == [(2, 0), (3, 0)]


def test_line_cleaning_keeps_texts_without_or_with_repeated_ids(spark):
    copy = "a line that two of these texts have"
    rows = [(1, copy), (None, f"unique first line\n{copy}"), (None, f"{copy}\nunique second line"), (5, "five has two texts, this one"), (5, f"and that one\n{copy}"), (5, "five has two texts, this one")]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [rows[0], (None, "unique first line"), (None, "unique second line"), rows[3], (5, "and that one"), rows[3]]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)


def test_line_report_and_cleaning(docs, empty):
    got = {r["doc_id"]: r.asDict() for r in line_dedup.line_report(docs).collect()}
    assert got[8]["equal_dropped"] == 1 and got[7]["kept_lines"] == 1 and got[3]["n_lines"] == 1 and got[None]["kept_lines"] == 1
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[8] == "" and texts[7] == LONG and texts[3] is None
    assert line_dedup.line_report(empty).count() == 0


def own_chunks(text, config):
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, counts = substring_dedup.passage_words(data, np.array([0, len(data)]))
    at, stop, _ = substring_dedup.chunk_places(data, starts, ends, counts, config)
    return [(int(a), int(b), data[starts[a] : starts[b]].tobytes()) for a, b in zip(at, stop)]


@pytest.mark.parametrize("least_words", [20, 50, 51])
def test_every_passage_holds_a_chunk_of_its_own(least_words):
    config = substring_dedup.PassageConfig(least_words)
    rng = random.Random(least_words)
    some = lambda n, letters: [rng.choice(letters) for _ in range(n)]
    for trial in range(300):
        letters = ["alpha", "bräu", "日本", "x", "the", "of"] if trial % 3 else [f"w{k}" for k in range(400)]
        passage = some(least_words, letters)
        held = []
        for _ in range(3):
            left, right = rng.randrange(40), rng.randrange(40)
            text = " ".join([*some(left, letters), *passage, *some(right, letters)])
            held.append({body for a, b, body in own_chunks(text, config) if a >= left and b < left + least_words})
        assert held[0] & held[1] & held[2]


def test_chunks_are_variable_and_survive_insertions():
    config = substring_dedup.PassageConfig()
    rng = random.Random(8)
    words = [rng.choice(["alpha", "bräu", "日本", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(900)]
    one = own_chunks(" ".join(words), config)
    two = {body for _, _, body in own_chunks(" ".join([*words[:300], "some", "words", *words[300:600], *words[601:]]), config)}
    sizes = [b - a for a, b, _ in one]
    assert min(sizes) >= config.least and max(sizes) < config.least + 3 * config.reach and len(set(sizes)) > 5
    assert sum(body in two for _, _, body in one) > 0.85 * len(one)
    assert own_chunks("few words", config) == [] and own_chunks("", config) == []


def test_gear_hash_is_the_rolling_one():
    data = np.random.default_rng(1).integers(0, 256, 200).astype(np.uint8)
    begin = np.concatenate([np.arange(120), np.arange(80)])
    h, want = 0, []
    for k, b in enumerate(data.tolist()):
        h = (0 if begin[k] == 0 else h << 1) + int(substring_dedup._GEAR[b]) & 0xFFFFFFFF
        want.append(h)
    assert substring_dedup.gear_hash(data, begin).tolist() == want


def test_passages_find_the_planted_one_only(docs):
    got = {r["doc_id"] for r in substring_dedup.repeated_passages(docs).collect()}
    assert 11 in got and 8 in got and not got & {1, 2, 3, 4, 5, 6, 9, 10, 12, 13, None}
    out = substring_dedup.cut_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[11].startswith("second start") and texts[11].endswith("another tail") and len(texts[11]) < 400
    assert texts[3] is None and texts[13] == ROWS[-1][1]


def test_passages_on_corpus(corpus):
    rows = [tuple(r) for r in corpus.select("doc_id", "text").collect()]
    got = defaultdict(set)
    for r in substring_dedup.repeated_passages(corpus).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["start"] + r["bytes"]))
    want = brute_passages([(i, t or "") for i, t in rows], 50)
    assert want and dict(got) == want


def brute_passages(rows, least):
    """Bytes of each text that lie in a window of ``least`` words seen before."""
    seen, out = set(), {}
    for ident, text in sorted(rows):
        body = text.encode()
        places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", body)]
        marked = set()
        for k in range(len(places) - least + 1):
            a, b = places[k][0], places[k + least - 1][1]
            if body[a:b] in seen:
                marked |= set(range(a, b))
            seen.add(body[a:b])
        if marked:
            out[ident] = marked
    return out


def test_passages_of_51_short_words_are_all_found_to_their_ends(spark, empty):
    rng = random.Random(51)
    letters = "abcdefghij"
    some = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(n))
    rows = []
    for k in range(200):
        passage = some((51, 51, 55, 49)[k % 4])
        rows += [(2 * k, f"{some(60)} {passage} {some(60)}"), (2 * k + 1, f"{some(rng.randrange(80))} {passage} {some(70)}")]
    # the anchors of this passage are first seen in two shorter ones, and it repeats across later rows
    mixed = some(60).split()
    rows += [(900, some(20) + " " + " ".join(mixed[:40]) + " " + some(20)), (901, some(20) + " " + " ".join(mixed[20:]) + " " + some(20))]
    rows += [(902, some(9) + " " + " ".join(mixed) + " " + some(9)), (903, some(30) + " " + " ".join(mixed))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = defaultdict(set)
    for r in substring_dedup.repeated_passages(frame).collect():
        assert r["words"] >= 50
        got[r["doc_id"]] |= set(range(r["start"], r["start"] + r["bytes"]))
    assert dict(got) == brute_passages(rows, 50)
    assert len(got) == 151 and substring_dedup.repeated_passages(empty).count() == 0


def test_cutting_keeps_texts_without_or_with_repeated_ids(spark):
    rng = random.Random(9)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passage, unique = some(60), [some(90) for _ in range(4)]
    rows = [(1, some(5) + " " + passage), (7, passage + " tail of seven"), (7, unique[0]), (None, unique[1]), (None, "before " + passage + " after"), (None, unique[2]), (7, unique[3]), (7, unique[3])]
    out = substring_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([rows[0], (7, " tail of seven"), rows[2], rows[3], (None, "before  after"), rows[5], rows[6], rows[7]], key=str)


def test_passages_without_spaces_are_found(spark):
    rng = random.Random(7)
    some = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = some(120)
    frame = spark.createDataFrame([(1, some(80) + passage + some(80)), (2, some(55) + passage + some(40)), (3, some(200))], "doc_id long, text string")
    (found,) = substring_dedup.repeated_passages(frame).collect()
    assert found["doc_id"] == 2 and found["first_doc_id"] == 1 and found["bytes"] >= 350


@pytest.mark.parametrize(("n", "size"), [(150_000, 12), (150_000, 40), (60_000, 400)])
def test_tries_count_their_memory(n, size):
    """What a trie says it holds is what Python allocates for it, for short texts too."""
    import tracemalloc

    rng = random.Random(size)
    keys = [bytes(rng.choices(b"abcdefgh", k=rng.randrange(1, 2 * size))) for _ in range(n)]
    tracemalloc.start()
    trie = exact_dedup.PatriciaTrie()
    for k, key in enumerate(keys):
        trie.insert(key, 10**12 + k, 1)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert 0.7 * used < trie.memory < 1.8 * used
    held = trie.memory
    out = list(trie.spill_subtrees(held // 2, memory=True))
    assert trie.memory <= held // 2 or not out
    rest = list(trie.spill())
    assert trie.memory == 0 and {k for k, _, _ in out} | {k for k, _, _ in rest} == set(keys) and sum(c for _, _, c in out + rest) == n


def test_short_texts_stay_within_the_bound(monkeypatch):
    """A million short texts through both sides: no trie grows past the bound by more than a text, nothing is lost."""
    monkeypatch.setattr(exact_dedup, "SPILL_BYTES", 2 << 20)
    most = []
    insert = exact_dedup.PatriciaTrie.insert

    def watched(self, key, ident, count):
        insert(self, key, ident, count)
        most.append(self.memory)

    monkeypatch.setattr(exact_dedup.PatriciaTrie, "insert", watched)
    rng = random.Random(8)
    bodies = [b"%d" % rng.randrange(150_000) for _ in range(200_000)]
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(bodies[i : i + 5000], pa.binary()), pa.array(range(i, i + 5000), pa.int64())], ["body", "ident"]) for i in range(0, len(bodies), 5000)])
    partial = [r for b in exact_dedup._collapse(batches()) for r in b.to_pylist()]
    partial.sort(key=lambda r: r["body"])
    rows = pa.RecordBatch.from_pylist(partial, pa.schema([("body", pa.binary()), ("ident", pa.int64()), ("copies", pa.int64())]))
    owned = [r for b in exact_dedup._own(iter([rows])) for r in b.to_pylist()]
    want = defaultdict(list)
    for k, body in enumerate(bodies):
        want[body].append(k)
    assert {r["body"]: (r["ident"], r["copies"]) for r in owned} == {b: (min(k), len(k)) for b, k in want.items()} and len(owned) == len(want)
    assert max(most) < (2 << 20) + 2000


def test_one_of_many_rows_without_an_id_stays(spark):
    rows = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same").alias("text")).repartition(7)
    out = exact_dedup.exact_duplicates(rows)
    assert [tuple(r) for r in out.groupBy("kept", "keep_id", "group_size").count().orderBy("kept").collect()] == [(False, None, 5000, 4999), (True, None, 5000, 1)]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
