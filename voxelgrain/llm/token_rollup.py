"""Token counts as delta-maintained rollups.

A batch of changes (insert, delete, revise) becomes signed rows of a per-document ledger: what comes with its count, what
goes as the negative of all that the ledger holds of it. Sums by source, language and tokenizer version are the batch's
delta, and totals are the sum of all deltas. Ledger rows and delta of a batch are written aside and become part of the
rollup by one entry of a log. Entries are numbered, and an entry is made by a rename that fails where the number is taken:
of two writers one commits and the other begins anew from what is there then. A batch that the log names is not applied
again, so a replay changes nothing. ``compact`` folds the entries so far into one, which also names their batches, and
``clean`` deletes what was folded.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import Encoder, default_vocabulary, encoder
from .shared import cut

_LEDGER = "doc_id long, source string, lang string, version string, documents long, tokens long"
_DELTA = "source string, lang string, version string, documents long, tokens long"
_COUNTED = "doc_id long, source string, lang string, seq long, place int, which long, version string, documents long, tokens long"
_ENTRY = "number long, batch string, folder string, base boolean"


@cache
def _ranked(path: str) -> Encoder:
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return Encoder(tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, lengths)


def version_encoder(version: str) -> Encoder:
    """Of a tokenizer version: a name of the public byte-level vocabularies without its suffix."""
    import public_tokenizers

    return encoder(default_vocabulary()) if version == "byte_bpe_50k" else _ranked(public_tokenizers.path(f"{version}.tiktoken"))


def count_tokens(text: str, version: str) -> int:
    """Tokens of a text under a tokenizer version."""
    return len(version_encoder(version)(text))


#: Vocabularies counted by default.
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")


class TokenRollup:
    """Totals by source, language and tokenizer version, kept in ``path`` (a folder that all executors share)."""

    def __init__(self, spark: SparkSession, path: str, versions: tuple[str, ...] = VERSIONS) -> None:
        self.spark, self.path, self.versions = spark, path.rstrip("/"), versions
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        where = self._hadoop.Path(self.path)
        self._fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = self._hadoop.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())

    def _log(self) -> list:
        """Entries by number, from the last base on if older ones were cleaned away; the driver holds one small row for each."""
        top = f"{self.path}/log"
        if not self._fs.exists(self._hadoop.Path(top)):
            return []
        return sorted(self.spark.read.schema(_ENTRY).json(top).collect(), key=lambda r: r["number"])

    def applied(self, batch_id: str, log: list | None = None) -> bool:
        """Whether an entry, or a base that entries were folded into, names the batch."""
        log = self._log() if log is None else log
        if any(r["batch"] == batch_id for r in log):
            return True
        return any(r["base"] for r in log) and self._folded(log).where(F.col("batch") == batch_id).limit(1).count() > 0

    def _folded(self, log: list) -> DataFrame:
        """Batches that the last base stands for."""
        base = next(r for r in reversed(log) if r["base"])
        return self.spark.read.schema("batch string").parquet(f"{self.path}/data/{base['folder']}/batches")

    def _commit(self, number: int, batch: str | None, folder: str) -> bool:
        """Make the entry, unless its number is taken."""
        aside = self._hadoop.Path(f"{self.path}/data/{folder}/entry")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps({"number": number, "batch": batch, "folder": folder, "base": batch is None}).encode()))
        out.close()
        self._fs.mkdirs(self._hadoop.Path(f"{self.path}/log"))
        try:
            self._context.rename(aside, self._hadoop.Path(f"{self.path}/log/{number:012d}.json"), self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0))
        except Exception as error:  # noqa: BLE001 - a taken number shows as a Java exception
            if "FileAlreadyExistsException" not in str(error):
                raise
            return False
        return True

    def _read(self, log: list, kind: str, schema: str) -> DataFrame:
        """Rows of the last base and of what came after it."""
        since = max((k for k, r in enumerate(log) if r["base"]), default=0)
        folders = [f"{self.path}/data/{r['folder']}/{kind}" for r in log[since:]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    @staticmethod
    def _summed(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def ledger(self, log: list | None = None) -> DataFrame:
        """doc_id, source, lang, version, documents (how often it is in) and tokens (of all of these)."""
        return self._summed(self._read(self._log() if log is None else log, "ledger", _LEDGER), "doc_id", "source", "lang", "version")

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens over all applied batches; groups that became empty are left out."""
        return self._summed(self._read(self._log(), "delta", _DELTA), "source", "lang", "version")

    def _counted(self, docs: DataFrame) -> DataFrame:
        """Counts of all versions: those that a row brings with it, else those of its text."""
        if "counts" in docs.columns:
            brought = docs.where("counts is not null").drop("text")
            version = F.explode(F.array(*[F.lit(v) for v in self.versions])).alias("version")
            brought = brought.select("*", version).select(*brought.columns[:6], "version", F.lit(1).cast("long").alias("documents"), F.coalesce(F.try_element_at("counts", "version"), F.lit(0)).cast("long").alias("tokens"))
            return brought.unionByName(self._counted(docs.where("counts is null").drop("counts")))
        versions = self.versions
        names = [x.split()[0] for x in _COUNTED.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, texts = batch.num_rows, batch.column(6)
                for version in versions:
                    tokens = [len(ids) for ids in version_encoder(version).column(texts)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([version] * n, pa.string()), pa.array([1] * n, pa.int64()), pa.array(tokens, pa.int64())], names)

        return docs.mapInArrow(run, _COUNTED)

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once. ``changes``: op ('insert', 'delete' or 'revise'), doc_id, source, lang, text; if they are to be
        ordered, seq; and, where tokens are known, counts (a map from version to tokens; 0 for a version that it lacks).

        Changes of one id take effect by seq (null first); at one seq inserts come first, then revisions, then deletes, and
        of several revisions one stands. An insert adds a document, also to an id that is there; a delete removes all
        documents of its id, a revision replaces them by one, and either may name an unknown id. Null text counts 0
        tokens; null sources and languages are groups of their own; documents without an id can be inserted only, so
        their revisions insert and their deletes do nothing; an empty batch is remembered. False if the batch was there.
        """
        if self.applied(batch_id):
            return False
        kinds = {r["op"] for r in changes.select("op").distinct().limit(5).collect()}
        if unknown := kinds - {"insert", "delete", "revise"}:
            raise ValueError(f"unknown change: {sorted(map(str, unknown))}")
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(None).cast("long")
        place = F.when(F.col("op") == "insert", 0).when(F.col("op") == "revise", 1).otherwise(2)
        which = F.xxhash64("source", "lang", "text", *([F.to_json("counts")] if "counts" in changes.columns else []))
        ident, at = F.col("doc_id").cast("long").alias("doc_id"), F.struct("seq", "place", "which")
        source, lang = (F.col(c).cast("string").alias(c) for c in ("source", "lang"))
        folder = uuid.uuid4().hex
        staged = f"{self.path}/data/{folder}"
        coming = changes.where("op <> 'delete'").select(ident, source, lang, seq.alias("seq"), place.alias("place"), which.alias("which"), "text", *(["counts"] if "counts" in changes.columns else []))
        self._counted(coming).write.parquet(f"{staged}/new")
        counted = self.spark.read.schema(_COUNTED).parquet(f"{staged}/new")
        resets = None
        if kinds - {"insert"}:
            # what an id's last delete or revision leaves behind it, and that revision itself, once
            deletes = changes.where("op = 'delete'").select(ident, seq.alias("seq"), place.alias("place"), F.lit(0).cast("long").alias("which"))
            ends = counted.where((F.col("place") == 1) & (F.col("version") == self.versions[0])).select("doc_id", "seq", "place", "which").unionByName(deletes)
            resets = cut(ends.where("doc_id is not null").groupBy("doc_id").agg(F.max(at).alias("last")), "resets")
            known = resets.select(F.col("doc_id").alias("_id"), "last")
            found = counted.join(known, F.col("doc_id") == F.col("_id"), "left")
            stays = found.where(F.col("last").isNull() | (at > F.col("last")))
            counted = stays.unionByName(found.where(at == F.col("last")).dropDuplicates(["doc_id", "version"]))
        counted = counted.select([x.split()[0] for x in _LEDGER.split(", ")])
        while True:
            log = self._log()
            if self.applied(batch_id, log):
                self._fs.delete(self._hadoop.Path(staged), True)
                return False
            rows = counted
            if resets is not None:
                gone = self.ledger(log).join(resets.select("doc_id"), "doc_id", "left_semi")
                rows = rows.unionByName(gone.select("doc_id", "source", "lang", "version", (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens")))
            rows.write.mode("overwrite").parquet(f"{staged}/ledger")
            written = self.spark.read.schema(_LEDGER).parquet(f"{staged}/ledger")
            self._summed(written, "source", "lang", "version").write.mode("overwrite").parquet(f"{staged}/delta")
            if self._commit(_next(log), batch_id, folder):
                self._fs.delete(self._hadoop.Path(f"{staged}/new"), True)
                return True

    def compact(self) -> bool:
        """Fold all entries so far into one, so that later reads take that and what follows. False if another writer was
        first; nothing is lost then."""
        log = self._log()
        folder = uuid.uuid4().hex
        self.ledger(log).write.parquet(f"{self.path}/data/{folder}/ledger")
        self._summed(self._read(log, "delta", _DELTA), "source", "lang", "version").write.parquet(f"{self.path}/data/{folder}/delta")
        names = self.spark.createDataFrame([(r["batch"],) for r in log if not r["base"]], "batch string")
        if any(r["base"] for r in log):
            names = names.unionByName(self._folded(log)).distinct()
        names.write.parquet(f"{self.path}/data/{folder}/batches")
        if not self._commit(_next(log), None, folder):
            self._fs.delete(self._hadoop.Path(f"{self.path}/data/{folder}"), True)
            return False
        return True

    def clean(self) -> int:
        """Delete the entries before the last base and their files; how many. Readers that began before the base was made must have
        ended: they read what goes."""
        log = self._log()
        last = max((k for k, r in enumerate(log) if r["base"]), default=0)
        for r in log[:last]:
            self._fs.delete(self._hadoop.Path(f"{self.path}/log/{r['number']:012d}.json"), False)
            self._fs.delete(self._hadoop.Path(f"{self.path}/data/{r['folder']}"), True)
        return last


def _next(log: list) -> int:
    return log[-1]["number"] + 1 if log else 1


def token_counts(docs: DataFrame, path: str, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """Totals of ``docs`` in a fresh rollup in ``path``, whose every document sees every kind of change.

    One batch inserts all rows, and its replay changes nothing. A second one, over all ids that stand on one row, deletes
    each, inserts it without a text and revises it to its text, which is counted again. So the totals are those of all rows;
    rows without an id, and rows that share one, are inserted only.
    """
    rollup = TokenRollup(docs.sparkSession, path, versions)
    rows = docs.select("doc_id", "source", "lang", "text")
    inserts = rows.withColumn("op", F.lit("insert"))
    rollup.apply("load", inserts)
    rollup.apply("load", inserts)
    ids = rollup.ledger().where("doc_id is not null").groupBy("doc_id")
    several = cut(ids.agg(F.max("documents").alias("most"), F.count("*").alias("n")).where((F.col("most") > 1) | (F.col("n") > len(versions))).select("doc_id"), "several", slim=True)
    alone = rows.where("doc_id is not null").join(several, "doc_id", "left_anti")
    steps = [("delete", F.lit(None).cast("string")), ("insert", F.lit(None).cast("string")), ("revise", F.col("text"))]
    parts = [alone.withColumns({"op": F.lit(op), "seq": F.lit(k), "text": text}) for k, (op, text) in enumerate(steps)]
    rollup.apply("second", parts[0].unionByName(parts[1]).unionByName(parts[2]))
    rollup.compact()
    rollup.clean()
    return rollup.totals()
