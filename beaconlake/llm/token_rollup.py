"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A batch of changes is summed to one signed row per group and committed under its batch id by
renaming a finished folder into place.  A batch that is already there is left alone, so a retry
or a second delivery changes nothing, and a job that dies before the rename leaves no trace.
Totals are the sum of all committed deltas.  :meth:`Rollup.compact` folds them into a new base that
lists the batches it took in, which the next compaction moves aside; a batch is looked up by its name
alone, however many there have been.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.llm.scratch import Scratch

GROUP = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"

#: Word patterns by tokenizer version; both engines read them alike.
PATTERNS = {"words@1": "[^\\x20\\x09-\\x0D]+", "words@2": "[A-Za-z0-9]+|[^\\x20\\x09-\\x0DA-Za-z0-9]"}


def token_count(text: Column, version: str) -> Column:
    """Tokens of a text under a pattern version; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("bigint")


class Rollup:
    """The rollup stored in ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _there(self, where: str) -> bool:
        return self._files.exists(self._hadoop(where))

    def _children(self, where: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._hadoop(where))) if self._there(where) else []

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before.

        ``changes`` has op ('insert', 'delete' or 'revise'), source, lang, tokenizer, n_tokens and
        old_tokens (read for 'revise' only).  A null count is 0, null group values form groups of
        their own, rows with another or null op are rejected by an error.  Extra columns are ignored.
        """
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ only")
        home = f"{self.path}/deltas/batch={batch_id}"
        if self._there(home) or self._there(f"{self.path}/folded/batch={batch_id}"):
            return False
        n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.lit("unknown op in a batch of changes")))
        signed = changes.select(
            *GROUP,
            F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0).cast("bigint").alias("n_docs"),
            F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).otherwise(n - old).cast("bigint").alias("n_tokens"),
        )
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        signed.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(staged)
        self._files.mkdirs(self._hadoop(f"{self.path}/deltas"))
        # Renaming onto a folder would move into it, so a commit that lost the race is looked for first.
        if self._there(home) or not self._files.rename(self._hadoop(staged), self._hadoop(home)):
            self._files.delete(self._hadoop(staged), True)
            return False
        return True

    def _base(self) -> str | None:
        """The newest complete base."""
        done = [b for b in self._children(f"{self.path}/bases") if self._there(f"{self.path}/bases/{b}/batches/_SUCCESS")]
        return f"{self.path}/bases/{done[-1]}" if done else None

    def _listing(self) -> tuple[str | None, set[str], list[str]]:
        """One view of the store: the newest base, the batches folded into it that are not yet aside, and the other deltas."""
        base = self._base()
        # The list of one compaction: what was committed since the one before, a row per batch.
        taken = {r.batch for r in self.spark.read.parquet(f"{base}/batches").collect()} if base else set()
        deltas = self._children(f"{self.path}/deltas")
        return base, taken & {d.removeprefix("batch=") for d in deltas}, [d for d in deltas if d.removeprefix("batch=") not in taken]

    def _sum(self, base: str | None, deltas: list[str]) -> DataFrame:
        parts = [f"{base}/rows"] if base else []
        parts += [f"{self.path}/deltas/{d}" for d in deltas]
        rows = self.spark.read.schema(_DELTA).parquet(*parts) if parts else self.spark.createDataFrame([], _DELTA)
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs != 0 OR n_tokens != 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups whose documents are all gone are left out."""
        base, _, deltas = self._listing()
        return self._sum(base, deltas)

    def compact(self) -> None:
        """Fold the committed deltas into a new base; one compaction runs at a time.

        Sums and the list of batches come from one listing, so that a batch committed meanwhile is in
        neither.  What a base took in is moved aside when the next compaction begins: who reads the
        totals before a compaction is not disturbed by it.
        """
        base, taken, deltas = self._listing()
        self._set_aside(taken)
        if not deltas:
            return
        target = f"{self.path}/bases/{len(self._children(f'{self.path}/bases')):08d}"
        self._sum(base, deltas).write.mode("overwrite").parquet(f"{target}/rows")
        batches = {d.removeprefix("batch=") for d in deltas}
        self.spark.createDataFrame([(b,) for b in sorted(batches)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{target}/batches")

    def _set_aside(self, batches: set[str]) -> None:
        if batches:
            self._files.mkdirs(self._hadoop(f"{self.path}/folded"))
        for b in sorted(batches):
            self._files.rename(self._hadoop(f"{self.path}/deltas/batch={b}"), self._hadoop(f"{self.path}/folded/batch={b}"))


def op7_token_rollup(docs: DataFrame) -> DataFrame:
    """Totals after four batches over all documents: all are inserted under words@1 with an estimate
    from their length, the same documents under words@2 with their counts, every estimate is revised
    to the count, and texts that a smaller doc_id also has are deleted from both.  The rollup is
    compacted after the second batch and after the third; then all are delivered again, which changes
    nothing.  Null texts count as empty; without a doc_id no row is a copy."""
    scratch = Scratch(docs.sparkSession, "rollup")
    text = F.col("text")
    estimate = F.coalesce(F.expr("char_length(text) div 6"), F.lit(0)).cast("bigint").alias("estimate")
    counted = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"), estimate, *(token_count(text, v).alias(v) for v in PATTERNS))
    counted = scratch.table(counted, "counted")
    first = scratch.table(counted.groupBy(F.col("digest").alias("_d")).agg(F.min("doc_id").alias("_first")), "first")
    copies = counted.join(first, F.col("digest") == F.col("_d")).filter("doc_id != _first")

    def changes(rows: DataFrame, op: str, version: str, tokens: str | None = None, old: str | None = None) -> DataFrame:
        before = F.col(old) if old else F.lit(None).cast("bigint")
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), F.col(f"`{tokens or version}`").alias("n_tokens"), before.alias("old_tokens"))

    batches = {
        "load-1": changes(counted, "insert", "words@1", tokens="estimate"),
        "load-2": changes(counted, "insert", "words@2"),
        "counts-1": changes(counted, "revise", "words@1", old="estimate"),
        "copies": changes(copies, "delete", "words@1").unionByName(changes(copies, "delete", "words@2")),
    }
    rollup = Rollup(docs.sparkSession, scratch.folder("totals"))
    for name, batch in batches.items():
        rollup.commit(name, batch)
        if name in ("load-2", "counts-1"):
            rollup.compact()
    for name, batch in batches.items():
        rollup.commit(name, batch)
    return rollup.totals()


OP7_SQL = """
WITH counted AS (
  SELECT source, lang, doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS w1,
         coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\\x20\\x09-\\x0DA-Za-z0-9]')), 0) AS w2
  FROM documents
)
SELECT source, lang, v AS tokenizer, CAST(count(*) AS BIGINT) AS n_docs,
       CAST(sum(CASE v WHEN 'words@1' THEN w1 ELSE w2 END) AS BIGINT) AS n_tokens
FROM counted, (VALUES ('words@1'), ('words@2')) AS t(v)
WHERE doc_id = first_id
GROUP BY source, lang, v
"""
