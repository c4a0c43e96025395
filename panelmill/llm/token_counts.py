"""Token counts as delta-maintained rollups: signed changes, additive totals, idempotent batch commits.

A ledger is a folder in the shared file system. Committing a batch looks up what the ledger holds of the batch's
documents, turns inserts, deletes and revisions into rows of sign +1 or -1, and writes these and their sums by source,
language and tokenizer version. Totals are the sums over all committed batches; no batch is ever read twice for them.
A batch counts once its sums are complete (Spark's _SUCCESS file). Committing it again changes nothing, and what a
failed attempt has left behind is overwritten. compact() writes what is held and its sums as a snapshot, after which
only that and later batches are read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import column, materialize, shared_dir, spread, written
from panelmill.llm.tokens import ByteLevel, encoder, texts

#: Tokenizer version that counts runs of anything but space and \t..\r; the others are files of public_tokenizers.
WORDS = "words-1"
KEYS = ["source", "lang", "tokenizer"]
_ROWS = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint"
_SUMS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def count_tokens(docs: DataFrame, versions: dict[str, tuple[type, str] | None]) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens for each row and version. A version without a tokenizer counts words.

    Null and empty texts have 0 tokens; null ids, sources and languages stay null. Repeated rows count each. An empty table
    gives no rows. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {v: how and encoder(*how) for v, how in versions.items()}
        for batch in batches:
            counts: dict[str, list[int]] = {v: [] for v in versions}
            for text in texts(batch, "text"):
                for v, encode in encoders.items():
                    counts[v].append(len(encode(text)) // 4 if encode else len(_SPLIT.findall(text)))
            for v, n in counts.items():
                names = ["doc_id", "source", "lang"]
                yield pa.RecordBatch.from_arrays([column(batch, c) for c in names] + [pa.array([v] * len(n), pa.string()), pa.array(n, pa.int64())], [*names, "tokenizer", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    return spread(rows).mapInArrow(work, _ROWS)


class Ledger:
    """Totals by source, language and tokenizer version under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        p, fs = self._path(name)
        return fs.exists(p)

    def _complete(self, kind: str) -> list[str]:
        """Names under kind whose sums are complete, in order."""
        top, fs = self._path(kind)
        names = sorted(s.getPath().getName() for s in fs.listStatus(top)) if fs.exists(top) else []
        return [n for n in names if self._there(f"{kind}/{n}/sums/_SUCCESS")]

    def batches(self) -> list[str]:
        """Committed batches, in the order of their names."""
        return self._complete("batches")

    def _read(self, kind: str, schema: str) -> DataFrame:
        """Rows or sums of the last snapshot and of the batches that it doesn't hold."""
        snapshots, done = self._complete("snapshots"), set()
        paths = []
        if snapshots:
            last = f"{self.folder}/snapshots/{snapshots[-1]}"
            done = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{last}/batches").collect()}  # names
            paths = [f"{last}/{kind}"]
        paths += [f"{self.folder}/batches/{b}/{kind}" for b in self.batches() if b not in done]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def held(self) -> DataFrame:
        """The rows that count at present, with n, how often each is held."""
        rows = self._read("rows", _ROWS + ", sign int")
        return rows.groupBy("doc_id", *KEYS, "n_tokens").agg(F.sum("sign").alias("n")).where("n > 0")

    def compact(self) -> str:
        """Write a snapshot of all committed batches and return its name. Its rows carry how often they are held as their sign."""
        name, batches = f"{len(self._complete('snapshots')):08d}", self.batches()
        where = f"{self.folder}/snapshots/{name}"
        self.spark.createDataFrame([(b,) for b in batches], "batch string").write.mode("overwrite").parquet(f"{where}/batches")
        self.held().withColumn("sign", F.col("n").cast("int")).drop("n").write.mode("overwrite").parquet(f"{where}/rows")
        self._read("sums", _SUMS).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.mode("overwrite").parquet(f"{where}/sums")
        return name

    def commit(self, batch: str, inserts: DataFrame | None = None, revisions: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply a batch; False if it is committed already.

        inserts and revisions have the columns of count_tokens(); a revision replaces all that the ledger holds of its
        document and tokenizer, if anything, and if one batch repeats it all its rows count. deletes has doc_id and
        removes all that is held of a document. An insert of a held document counts beside what is held. Null ids are
        documents like others. ValueError if a document is in both deletes and another of the three, or in inserts and revisions.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch is named by letters, digits, '.', '_' and '-'")
        if self._there(f"batches/{batch}/sums/_SUCCESS"):
            return False
        given = [x.select("doc_id").distinct() for x in (inserts, revisions, deletes) if x is not None]
        if len(given) > 1:
            every = given[0]
            for x in given[1:]:
                every = every.unionAll(x)
            if every.groupBy("doc_id").count().where("count > 1").limit(1).count():
                raise ValueError("a document is in more than one of inserts, revisions and deletes")
        names = ["doc_id", *KEYS, "n_tokens"]
        parts = [x.select(*names, F.lit(1).alias("sign")) for x in (inserts, revisions) if x is not None]
        for gone, keys in ((revisions, ["doc_id", "tokenizer"]), (deletes, ["doc_id"])):
            if gone is not None:
                held, keyed = self.held().alias("h"), gone.select(*keys).distinct().alias("g")
                same = [F.col(f"h.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
                parts.append(held.join(keyed, same, "left_semi").select(*names, F.explode(F.array_repeat(F.lit(-1), F.col("n").cast("int"))).alias("sign")))
        rows = parts[0] if parts else self.spark.createDataFrame([], _ROWS + ", sign int")
        for more in parts[1:]:
            rows = rows.unionByName(more)
        found = written(rows.select(*names, "sign"), f"{self.folder}/batches/{batch}/rows", "overwrite")
        sums = found.groupBy(*KEYS).agg(F.sum("sign").cast("bigint").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("bigint").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/batches/{batch}/sums")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches, where any document is left."""
        sums = self._read("sums", _SUMS)
        return sums.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")


def copies(docs: DataFrame) -> DataFrame:
    """doc_id of the documents whose text a document with a smaller id has as well."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("sha"))
    return rows.join(rows.groupBy("sha").agg(F.min("doc_id").alias("first")), "sha").where("doc_id > first").select("doc_id")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents in which a line repeats an earlier one to the letter, with such lines taken out."""
    once = F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")
    return docs.withColumn("text", once).where(docs["text"] != F.col("text"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """A ledger of all documents, inserted in one batch; a second deletes exact copies and revises the documents in which lines repeat, counted without them.

    Both batches are committed once more after that, which must not count, and the totals come from a snapshot and what follows it.
    """
    import public_tokenizers

    versions = {WORDS: None, "byte_bpe_50k": (ByteLevel, public_tokenizers.path("byte_bpe_50k.json"))}
    ledger = Ledger(spark, f"{shared_dir(spark)}/mill-{uuid.uuid4().hex}/ledger")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger.commit("load", inserts=count_tokens(docs, versions))
    ledger.compact()
    gone = materialize(copies(docs), "copies")
    fewer = without_repeated_lines(docs.join(gone, "doc_id", "left_anti"))
    revised = materialize(count_tokens(fewer, versions), "revised")
    for _ in range(2):
        ledger.commit("update", revisions=revised, deletes=gone)
        ledger.commit("load", inserts=revised)
    return ledger.totals()
