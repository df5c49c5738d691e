"""Operator 8, token counts: delta-maintained totals by source, language and tokenizer version."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, scratch_dir

KEY = ["source", "lang", "tokenizer_version"]
WS = "[\\x20\\x09-\\x0D]+"


def count_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null; no Python."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WS}|{WS}$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS))).cast("long")


class TokenRollup:
    """Additive totals that follow signed changes without a recount.

    Changes have ``op`` (insert, revise or delete), doc_id, source, lang, tokenizer_version, tokens. ``apply`` turns a
    batch into deltas against the ledger of live counts: an insert or a revision adds the new count and takes back
    the old one, a delete takes back the old one (one for an unknown document changes nothing). Of several changes
    to one (doc_id, tokenizer_version) in a batch, delete wins, then the largest count. Null keys group as null;
    null tokens count 0; changes with a null doc_id or an unknown op are ignored.

    The ledger lies in buckets of doc_ids, and a batch reads only the buckets that it touches. A batch counts once its
    marker is there: the file of the next number, written aside and then named for one writer only, so of two writers at once
    one starts again from the other's ledger, a writer that dies leaves no marker, and a retried driver cannot count twice: a batch id that has a marker changes
    nothing. ``compact`` folds all batches into one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = path or f"{scratch_dir(spark)}/rollup-{uuid.uuid4().hex}"
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._markers: dict[str, dict] = {}
        self._none = spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)

    def _hpath(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _marker(self, name: str) -> dict:
        """A marker's content; an empty one, which no writer completes any more, commits nothing."""
        if name not in self._markers:
            stream = self._fs.open(self._hpath(f"{self.path}/commits/{name}"))
            text = str(self._jvm.java.lang.String(stream.readAllBytes(), "UTF-8"))
            stream.close()
            self._markers[name] = json.loads(text) if text.endswith("\n") else {"batch": None, "folder": None, "folds": False}
        return self._markers[name]

    def _log(self) -> list[dict]:
        root = self._hpath(f"{self.path}/commits")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []
        return [self._marker(n) for n in names if n.isdigit()]

    def _commit(self, number: int, content: dict) -> bool:
        """False if another writer has that number. The marker is written aside and then gets its name in one step that never replaces another."""
        aside, final = self._hpath(f"{self.path}/aside/{uuid.uuid4().hex}"), self._hpath(f"{self.path}/commits/{number:010d}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray((json.dumps(content) + "\n").encode()))
        stream.close()
        try:
            self._fs.mkdirs(final.getParent())
            if self._fs.getUri().getScheme() == "file":  # renaming a local file may replace another, a link never does
                at = lambda p: self._jvm.java.nio.file.Path.of(self._fs.makeQualified(p).toUri().getPath(), self._none)
                self._jvm.java.nio.file.Files.createLink(at(final), at(aside))
            else:
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, final, options)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            self._fs.delete(aside, False)
        return True

    def batches(self) -> list[str]:
        return [m["batch"] for m in self._log() if m["batch"] is not None]

    def _read(self, log: list[dict], kind: str, schema: str) -> DataFrame:
        """What was committed since the last fold, that included."""
        folds = [i for i, m in enumerate(log) if m["folds"]]
        paths = [f"{self.path}/data/{m['folder']}/{kind}" for m in log[folds[-1] if folds else 0 :] if m["folder"]]
        frames = [self.spark.read.schema(schema).parquet(p) for p in paths]  # each has its buckets as folders
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def _ledger(self, log: list[dict]) -> DataFrame:
        return self._read(log, "ledger", "doc_id long, source string, lang string, tokenizer_version string, tokens long, live boolean, seq long, old struct<source:string,lang:string,tokens:long>, bucket int")

    def ledger(self) -> DataFrame:
        return self._ledger(self._log())

    def _deltas(self, log: list[dict]) -> DataFrame:
        return self._read(log, "delta", "source string, lang string, tokenizer_version string, d_docs long, d_tokens long")

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits a batch; False if it was there already."""
        if batch_id in self.batches():
            return False
        rank = F.when(F.col("op") == "delete", 1).otherwise(0)
        new = (
            changes.where(F.col("doc_id").isNotNull() & F.col("op").isin("insert", "revise", "delete"))
            .groupBy("doc_id", "tokenizer_version")
            .agg(F.max(F.struct(rank.alias("gone"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), "source", "lang")).alias("c"))
            .select("doc_id", "tokenizer_version", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int").alias("bucket"), "c.*")
        )
        with Scratch() as scratch:
            new = scratch.table(new, "rollup-changes")  # may be used twice, and the documents behind it are read once
            while True:
                log = self._log()
                if any(m["batch"] == batch_id for m in log):
                    return False
                folder = self._write(new, log)
                if self._commit(len(log), {"batch": batch_id, "folder": folder, "folds": False}):
                    return True
                self._fs.delete(self._hpath(f"{self.path}/data/{folder}"), True)

    def _write(self, new: DataFrame, log: list[dict]) -> str:
        """Writes ledger rows and deltas of a batch against the ledger of these commits; the folder's name."""
        if log:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
            old = (
                self._ledger(log).where(F.col("bucket").isin(touched)).withColumnRenamed("tokenizer_version", "v").withColumnRenamed("doc_id", "d")
                .groupBy("d", "v").agg(F.max(F.struct("seq", "live", "tokens", "source", "lang")).alias("o"))
            )
            both = new.join(old, (new.doc_id == old.d) & new.tokenizer_version.eqNullSafe(old.v), "left").drop("d", "v")
        else:
            both = new.withColumn("o", F.lit(None).cast("struct<seq:long,live:boolean,tokens:long,source:string,lang:string>"))
        was = F.coalesce(F.col("o.live"), F.lit(False))
        both = both.where(~((F.col("gone") == 1) & ~was))
        rows = both.select(
            "doc_id", F.when(F.col("gone") == 1, F.col("o.source")).otherwise(F.col("source")).alias("source"),
            F.when(F.col("gone") == 1, F.col("o.lang")).otherwise(F.col("lang")).alias("lang"), "tokenizer_version",
            F.col("tokens"), (F.col("gone") == 0).alias("live"), F.lit(len(log)).cast("long").alias("seq"),
            F.when(was, F.struct("o.source", "o.lang", "o.tokens")).alias("old"), "bucket",
        )
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{at}/ledger")
        done = self.spark.read.schema(rows.schema).parquet(f"{at}/ledger")
        plus = done.where("live").select(*KEY, F.lit(1).alias("sign"), "tokens")
        minus = done.where("old IS NOT NULL").select("old.source", "old.lang", "tokenizer_version", F.lit(-1).alias("sign"), "old.tokens")
        (
            plus.unionByName(minus).groupBy(*KEY)
            .agg(F.sum("sign").cast("long").alias("d_docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("d_tokens"))
            .write.parquet(f"{at}/delta")
        )
        return folder

    def compact(self) -> None:
        """Folds all batches into one ledger without dead rows and one table of totals; later readers start there."""
        while log := self._log():
            folder = uuid.uuid4().hex
            at = f"{self.path}/data/{folder}"
            live = self._ledger(log).groupBy("doc_id", "tokenizer_version", "bucket").agg(F.max(F.struct("seq", "live", "tokens", "source", "lang")).alias("o")).where("o.live")
            none = F.lit(None).cast("struct<source:string,lang:string,tokens:long>").alias("old")
            live.select("doc_id", "o.source", "o.lang", "tokenizer_version", "o.tokens", "o.live", "o.seq", none, "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{at}/ledger")
            self._deltas(log).groupBy(*KEY).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.parquet(f"{at}/delta")
            if self._commit(len(log), {"batch": None, "folder": folder, "folds": True}):
                return
            self._fs.delete(self._hpath(at), True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens: sums of the committed deltas, never of the documents."""
        return (
            self._deltas(self._log()).groupBy(*KEY).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
            .where("n_docs <> 0 OR n_tokens <> 0")
        )
