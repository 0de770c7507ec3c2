"""Alignment of two tokenizers over one corpus by a cogroup of postings.

Texts are read once. In each block of documents an occurrence pair of overlapping tokens of sides A and B is counted: a
posting says how often a document links an id pair. Postings of one B id and block are one row. Rows are shuffled by B
id and sorted there, behind the B id's pair counts, so a task streams them: it learns a B id's counts and their maximum,
then reads its postings, however many, and adds what they contribute to documents. Contributions are shuffled by block and
added up there. Spark's sorts spill; a task holds one B id's counts (no more than A has ids) and some megabytes of sums. A
B id with many postings is dealt to several tasks by blocks, each of which gets its counts.

Both tokenizers begin anew at a single space, or line feed, between two visible characters, so texts are encoded in
stretches between such places; what a stretch gives is worked out once and remembered.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import cut
from .packing import _ranges


@dataclass(frozen=True)
class AlignConfig:
    """``block_bytes`` of text make a block (or one document); B ids are split where their postings pass ``split_bytes``;
    ``hold`` bytes of sums are held before they are passed on, ``known`` stretches are remembered."""

    block_bytes: int = 4 << 20
    split_bytes: int = 4 << 20
    hold: int = 16 << 20
    known: int = 400_000
    side_a: str | None = None
    side_b: str | None = None


_JOINT = re.compile(r"(?<=[^\s᠎▁])(?=[ \n][^\s᠎▁])")
_SPACE = "▁"
#: A stretch that can stand beside others: no white space at its end, one sign of it at its beginning.
_PLAIN = re.compile(r"[ \n][^\s᠎▁](?:[^▁]*[^\s᠎▁])?\Z")
_TOKENS = "kind int, block long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, side int, posts binary, pair_a array<int>, pair_n array<long>"
_NAMES = [x.split()[0] for x in _TOKENS.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
_DOCUMENT, _POSTS, _PAIRS = 0, 1, 2
_SUMS = "block long, sums binary"
_TOTALS = "block long, at int, n_best long, count_sum long"
#: Occurrences one entry of a posting can say; more take several entries.
_MOST = 255


@cache
def _byte_of() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: visible Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def side_a(path: str) -> tuple[Callable[[str], list[int]], Callable[[int], bytes]]:
    """Ids of a text by a byte-level vocabulary (special tokens' strings are plain text), and an id's bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    file = Tokenizer.from_file(path)
    file.encode_special_tokens = True
    table = _byte_of()
    return lambda text: file.encode_batch_fast([text], add_special_tokens=False)[0].ids, cache(lambda i: bytes(table[c] for c in file.id_to_token(i)))


@cache
def side_b(path: str) -> tuple[Callable[[str], list[int]], Callable[[int], bytes]]:
    """The same for a sentence-piece vocabulary, which puts a space before what it encodes."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)

    def bytes_of(i: int) -> bytes:
        piece = file.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if file.is_byte(i) else piece.replace(_SPACE, " ").encode()

    return lambda text: file.encode(text, num_threads=1), cache(bytes_of)


class Aligner:
    """Alignments of stretches, remembered by their text: links (B id << 16 | A id), groups as text, and numbers."""

    def __init__(self, path_a: str, path_b: str, known: int) -> None:
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = side_a(path_a), side_b(path_b)
        self.known = known
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}  # -1: bytes differ
        self.groups: list[str] = []
        self.numbers = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.links, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _tokens(self, text: str) -> tuple[list[int], list[int], np.ndarray, np.ndarray] | None:
        """Ids of both sides and where each token ends; None if a side's bytes differ from the text."""
        a = self.encode_a(text)
        b = self.encode_b(text[1:] if text[0] == " " else text)
        if text[0] != " ":  # the space that side B puts in front is a token of its own there
            if not b or self.bytes_b(b[0]) != b" ":
                return None
            b = b[1:]
        parts_a, parts_b, raw = list(map(self.bytes_a, a)), list(map(self.bytes_b, b)), text.encode()
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return None
        return a, b, np.cumsum(np.fromiter(map(len, parts_a), np.int64, len(a))), np.cumsum(np.fromiter(map(len, parts_b), np.int64, len(b)))

    def _learn(self, stretches: list[str]) -> bool:
        """Align stretches that were joined into one text; False if they can't be told apart or bytes differ."""
        found = self._tokens("".join(stretches))
        if found is None:
            return False
        a, b, end_a, end_b = found
        stops = np.cumsum(np.fromiter((len(x.encode()) for x in stretches), np.int64, len(stretches)))
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_stops = np.searchsorted(common, stops)
        if group_stops[-1] >= len(common) or (common[group_stops] != stops).any():
            return False
        first = np.searchsorted(end_b, np.concatenate([[0], end_a[:-1]]), "right")  # the first B token that ends behind an A token's start
        n = np.searchsorted(end_b, end_a, "left") - first + 1  # up to the one that holds its last byte
        of_a = np.repeat(np.arange(len(a)), n)
        of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        links = np.asarray(b, np.int64)[of_b] << 16 | np.asarray(a, np.int64)[of_a]
        names_a, names_b = list(map(str, a)), list(map(str, b))
        cut_a, cut_b = (np.searchsorted(e, common) + 1 for e in (end_a, end_b))
        texts, i, j = [], 0, 0
        for s, t in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
            texts.append(f"{names_a[i]}|{names_b[j]}" if s - i == 1 and t - j == 1 else f"{','.join(names_a[i:s])}|{','.join(names_b[j:t])}")
            i, j = s, t
        edges = [0, *(group_stops + 1).tolist()]
        upto = np.stack([cut_a[group_stops], cut_b[group_stops], group_stops + 1, np.cumsum(n)[cut_a[group_stops] - 1]], axis=1)
        for k, x in enumerate(stretches):
            self.index[x] = len(self.groups)
            self.groups.append(";".join(texts[edges[k] : edges[k + 1]]))
        self.starts = np.concatenate([self.starts, len(self.links) + np.concatenate([[0], upto[:-1, 3]])])
        self.links = np.concatenate([self.links, links])
        self.numbers = np.concatenate([self.numbers, np.diff(upto, axis=0, prepend=0)])
        return True

    def learn(self, stretches: list[str]) -> None:
        """Remember new stretches: those that begin and end like words as one text, the rest by themselves."""
        alone = []
        plain = [x for x in stretches if _PLAIN.match(x) or alone.append(x)]
        for i in range(0, len(plain), 50_000):
            part = plain[i : i + 50_000]
            if not self._learn(part):
                alone += part
        for x in alone:
            if (_SPACE in x) or not self._learn([x]):  # side B reads U+2581 as a space
                self.index[x] = -1

    def block(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Numbers of each text's stretches; None for a text without tokens."""
        split = [_JOINT.split(" " + x) if x else None for x in texts]
        new = dict.fromkeys(x for parts in split if parts for x in parts if x not in self.index)
        self.learn(list(new))
        at = self.index
        places = [np.array([at[x] for x in parts]) if parts else None for parts in split]
        return [p if p is not None and p.min() >= 0 else None for p in places]


def _lines(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def pack_posts(docs: np.ndarray, a: np.ndarray, times: np.ndarray) -> bytes:
    """Postings as bytes: documents (as steps), A ids, and occurrences."""
    return b"".join([np.diff(docs, prepend=0).astype("<u2").tobytes(), a.astype("<u2").tobytes(), times.astype(np.uint8).tobytes()])


def unpack_posts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 5
    return np.cumsum(np.frombuffer(data, "<u2", n), dtype=np.int64), np.frombuffer(data, "<u2", n, 2 * n), np.frombuffer(data, np.uint8, n, 4 * n)


def _postings(at: np.ndarray, codes: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Rows of postings of one block from its links (document's place, B id << 16 | A id), and the pair counts."""
    keys, times = np.unique((codes >> 16) << 32 | at << 16 | codes & 0xFFFF, return_counts=True)
    pairs, where = np.unique((keys >> 32) << 16 | keys & 0xFFFF, return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, where, times)
    entries = -(-times // _MOST)  # more occurrences than one entry can say take several
    if (entries > 1).any():
        rest = np.repeat(times, entries) - _MOST * (np.arange(entries.sum()) - np.repeat(np.cumsum(entries) - entries, entries))
        keys, times = np.repeat(keys, entries), np.minimum(rest, _MOST)
    side = keys >> 32
    edges = np.flatnonzero(np.diff(side, prepend=-1, append=-1))
    docs, a = keys >> 16 & 0xFFFF, keys & 0xFFFF
    posts = [pack_posts(docs[i:j], a[i:j], times[i:j]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return (side[edges[:-1]], posts), pairs, counts


def _token_pass(config: AlignConfig, path_a: str, path_b: str):
    """Documents, postings and pair counts of each task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b, config.known)
        task, blocks = TaskContext.get().partitionId(), 0
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def pair_rows() -> pa.RecordBatch:
            sides, edges = np.unique(pairs >> 16, return_index=True)
            offsets = pa.array(np.append(edges, len(pairs)), pa.int32())
            columns = {"pair_a": pa.ListArray.from_arrays(offsets, pa.array(pairs & 0xFFFF, pa.int32())), "pair_n": pa.ListArray.from_arrays(offsets, pa.array(counts))}
            return _lines({"kind": pa.array([_PAIRS] * len(sides), pa.int32()), "side": pa.array(sides, pa.int32())} | columns, len(sides))

        for texts in _blocks(batches, config.block_bytes):
            block = task << 32 | blocks
            blocks += 1
            rows, held = [], []
            for k, ((ident, _), places) in enumerate(zip(texts, aligner.block([t for _, t in texts]), strict=True)):
                if places is None:
                    rows.append((ident, 0, 0, 0, 0, ""))
                    continue
                digest = hashlib.sha256(";".join([aligner.groups[p] for p in places.tolist()]).encode()).hexdigest()
                rows.append((ident, *aligner.numbers[places].sum(axis=0).tolist(), digest))
                held.append((k, places))
            n = len(rows)
            named = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), (pa.array(c, pa.string() if i == 5 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))), strict=True))
            yield _lines({"kind": pa.array([_DOCUMENT] * n, pa.int32()), "block": pa.array([block] * n), "at": pa.array(range(n), pa.int32())} | named, n)
            if held:
                places = np.concatenate([p for _, p in held])
                sizes = aligner.numbers[places, 3]
                at = np.repeat(np.repeat([k for k, _ in held], [len(p) for _, p in held]), sizes)
                links = aligner.links[_ranges(aligner.starts[places], sizes, np.cumsum(sizes))]
                (sides, posts), own_pairs, own_counts = _postings(at, links)
                n = len(sides)
                yield _lines({"kind": pa.array([_POSTS] * n, pa.int32()), "block": pa.array([block] * n), "side": pa.array(sides, pa.int32()), "posts": pa.array(posts, pa.binary())}, n)
                both = np.concatenate([pairs, own_pairs])
                pairs, where = np.unique(both, return_inverse=True)
                sums = np.zeros(len(pairs), np.int64)
                np.add.at(sums, where, np.concatenate([counts, own_counts]))
                counts = sums
                if len(pairs) > 1 << 20:
                    yield pair_rows()
                    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(aligner.index) > config.known:
                aligner.forget()
        if len(pairs):
            yield pair_rows()

    return run


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """(doc_id, text) in lists of at most ``most`` bytes of text or one document, and of fewer than 65,536 documents."""
    held, size = [], 0
    for batch in batches:
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            if held and (size + len(text) > most or len(held) > 60_000):
                yield held
                held, size = [], 0
            held.append((ident, text))
            size += len(text)
    if held:
        yield held


def _contributions(hold: int):
    """Streams (side, part, kind, block, posts, pair_a, pair_n), counts before postings, and emits sums by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        size, key, a, n, best = 0, None, None, None, 0

        def emitted() -> pa.RecordBatch:
            rows = []
            for block, (s, t) in sums.items():
                docs = np.flatnonzero(s)
                rows.append((block, b"".join([docs.astype("<u2").tobytes(), t[docs].astype("<i8").tobytes(), s[docs].astype("<i8").tobytes()])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["block", "sums"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for row, (side, part, kind, block, posts) in enumerate(zip(*columns, strict=True)):
                if kind == _DOCUMENT:  # the counts of what follows
                    key = side, part
                    a, n = (np.asarray(batch.column(k)[row].values) for k in (5, 6))
                    order = np.argsort(a)
                    a, n = a[order], n[order]
                    best = n.max()
                    continue
                if key != (side, part):
                    raise RuntimeError("postings without counts")
                docs, own, times = unpack_posts(posts)
                count = n[np.searchsorted(a, own)]
                held = sums.get(block)
                if held is None or held.shape[1] <= docs[-1]:
                    wider = np.zeros((2, int(docs[-1]) + 64), np.int64)
                    if held is not None:
                        wider[:, : held.shape[1]] = held
                        size -= held.nbytes
                    held = sums[block] = wider
                    size += held.nbytes
                np.add.at(held[0], docs, count * times)
                np.add.at(held[1], docs, np.where(count == best, times, 0).astype(np.int64))
                if size > hold:
                    yield emitted()
                    sums.clear()
                    size = 0
        if sums:
            yield emitted()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each document from the contributions of a block, which come together."""
    now, held = None, np.zeros((2, 0), np.int64)

    def rows() -> pa.RecordBatch:
        at = np.flatnonzero(held[0])
        return pa.RecordBatch.from_arrays([pa.array([now] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(held[1][at]), pa.array(held[0][at])], ["block", "at", "n_best", "count_sum"])

    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if block != now:
                if now is not None:
                    yield rows()
                now, held = block, np.zeros((2, 1 << 16), np.int64)
            n = len(data) // 18
            docs = np.frombuffer(data, "<u2", n)
            held[1][docs] += np.frombuffer(data[2 * n : 10 * n], "<i8")
            held[0][docs] += np.frombuffer(data[10 * n :], "<i8")
    if now is not None:
        yield rows()


def align_tokenizers(docs: DataFrame, config: AlignConfig = AlignConfig()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A is a byte-level vocabulary over a space and the text, B a sentence-piece vocabulary over the text, to which it adds that
    space. Defined cases: null and empty texts, and texts whose tokens' bytes on a side are not the space and the text (one
    with U+2581, say), have no tokens: zeros and ''; null and repeated ids are rows like others; ties for a B id's highest
    count all count as best; an empty table gives no rows; other columns are not read.
    """
    import public_tokenizers

    path_a, path_b = config.side_a or public_tokenizers.path("byte_bpe_50k.json"), config.side_b or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = cut(rows.mapInArrow(_token_pass(config, path_a, path_b), _TOKENS), "postings")
    pairs = tokens.where(F.col("kind") == _PAIRS).select("side", F.inline(F.arrays_zip("pair_a", "pair_n")))
    counts = pairs.groupBy("side", "pair_a").agg(F.sum("pair_n").alias("pair_n"))
    counts = counts.groupBy("side").agg(F.collect_list(F.struct("pair_a", "pair_n")).alias("pairs"))  # no longer than A has ids
    posts = tokens.where(F.col("kind") == _POSTS).select("side", "block", "posts")
    sizes = posts.groupBy("side").agg(F.sum(F.octet_length("posts")).alias("bytes"))
    split = cut(sizes.select("side", F.ceil(F.col("bytes") / config.split_bytes).cast("int").alias("split")), "splits", slim=True)
    split = F.broadcast(split)  # no more rows than B has ids
    none = F.lit(None)
    heads = counts.join(split, "side").select("side", F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("part"), F.lit(_DOCUMENT).alias("kind"), none.cast("long").alias("block"), none.cast("binary").alias("posts"), F.col("pairs.pair_a").alias("pair_a"), F.col("pairs.pair_n").alias("pair_n"))
    tails = posts.join(split, "side").select("side", F.pmod(F.xxhash64("block"), F.col("split")).cast("int").alias("part"), F.lit(_POSTS).alias("kind"), "block", "posts", none.cast("array<int>").alias("pair_a"), none.cast("array<long>").alias("pair_n"))
    dealt = heads.unionByName(tails).repartition("side", "part").sortWithinPartitions("side", "part", "kind")
    sums = dealt.mapInArrow(_contributions(config.hold), _SUMS)
    totals = sums.repartition("block").sortWithinPartitions("block").mapInArrow(_added, _TOTALS)
    known = tokens.where(F.col("kind") == _DOCUMENT).select("block", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    joined = known.join(totals, ["block", "at"], "left")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
