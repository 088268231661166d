"""Lines that many documents share, found with levelled sorted runs of line hashes.

Documents come in batches, more of them the larger the table. A batch's line hashes are counted and merge-anti-joined
with the run of hashes that are settled already (seen in enough documents); the rest is written as a new sorted run
of level 0. Once a level holds `fanout` runs they are compacted into one run of the next level, and what has reached
the threshold moves to the settled run. A run is a table bucketed and sorted by hash, and all have the same buckets:
batches meet the settled run, and runs each other, bucket by bucket, without a shuffle of what is stored.

All of it is DataFrame code: no Python runs on the executors.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm.common import SPACE, ascii_lower, drop_path, stored, table_path, text_or_empty

HASH = ["h1", "h2"]
#: Batches: this many at least, and the root of so-many-document parts of the table.
LEAST_BATCHES, BATCH_DOCS = 9, 1 << 15
#: Keys in at least one document of so many are joined by broadcast: at most this number times the mean lines of a document.
HOT_SHARE = 2000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def key_hash(key: Column) -> list[Column]:
    """Two 64-bit hashes of a line's key."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key, F.length(key)).alias("h2")]


def row_key() -> list[Column]:
    """128 bits of (doc_id, text): rows with both equal have equal results, so they may share them."""
    t = text_or_empty()
    return [F.xxhash64(F.col("doc_id"), t).alias("r1"), F.xxhash64(F.lit(7), t, F.col("doc_id")).alias("r2")]


class Run:
    """A table (h1, h2, n) in the shared folder, bucketed and sorted by hash."""

    def __init__(self, rows: DataFrame, buckets: int) -> None:
        self.spark = rows.sparkSession
        self.path, self.name = table_path(self.spark, "run"), f"terrasift_run_{uuid.uuid4().hex}"
        rows.select(*HASH, "n").write.bucketBy(buckets, *HASH).sortBy(*HASH).option("path", self.path).format("parquet").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        # All counts are positive. The filter has scans give rows: a union of columnar scans loses their buckets (Spark 4.1).
        return self.spark.table(self.name).where("n > 0")

    def drop(self) -> None:
        self.spark.sql(f"drop table {self.name}")
        drop_path(self.spark, self.path)


class SortedRuns:
    """Runs of hashes by level; n is the number of documents of a hash."""

    def __init__(self, spark: SparkSession, threshold: int, fanout: int = 3) -> None:
        self.threshold, self.fanout = threshold, fanout
        # As many as a shuffle has partitions: counted batches are dealt like the runs then.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Spark otherwise takes buckets for files where only a union of runs needs them, and then fails to zip the two sides.
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        self.levels: list[list[Run]] = [[]]
        self.settled: Run | None = None
        self.compactions = 0

    def _unsettled(self, counts: DataFrame) -> DataFrame:
        """counts less the settled hashes: a merge of two sorted sides. As left_anti the join would move below the count, and all of a key's lines to one task."""
        if self.settled is None:
            return counts
        old = self.settled.rows().select(*HASH, F.lit(True).alias("old")).hint("merge")
        return counts.join(old, HASH, "left").where(F.col("old").isNull()).select(*HASH, "n")

    def add(self, counts: DataFrame) -> None:
        """A batch's (h1, h2, n), each hash once."""
        self.levels[0].append(Run(self._unsettled(counts), self.buckets))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        """One run of the next level in place of a level's, less what is settled now. Later batches may add to hashes of either."""
        runs, old = self.levels[level], self.settled
        merged = Run(self._merged(runs), self.buckets)
        full = merged.rows().where(F.col("n") >= self.threshold)
        self.settled = Run(full if old is None else full.unionByName(old.rows()), self.buckets)
        rest = Run(merged.rows().where(F.col("n") < self.threshold), self.buckets)
        for run in [*runs, merged, *([old] if old else [])]:
            run.drop()
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(rest)
        self.compactions += 1

    def _merged(self, runs: list[Run]) -> DataFrame:
        """Counts of runs added up; a hash that has settled since its run was written is left out."""
        out = runs[0].rows()
        for run in runs[1:]:
            out = out.unionByName(run.rows())
        return self._unsettled(out.groupBy(*HASH).agg(F.sum("n").alias("n")))

    def frequent(self) -> DataFrame:
        """(h1, h2, n) of the hashes at the threshold; n is a lower bound where later batches were not counted."""
        runs = [r for level in self.levels for r in level]
        found = self._merged(runs).where(F.col("n") >= self.threshold) if runs else None
        if self.settled is None:
            return found
        return self.settled.rows() if found is None else self.settled.rows().unionByName(found)

    def drop(self) -> None:
        for run in [r for level in self.levels for r in level] + ([self.settled] if self.settled else []):
            run.drop()


def text_key(keys: Column) -> list[Column]:
    """128 bits of the keys of a text's lines that are not empty: texts that differ in case or outer white space share them."""
    full = F.filter(keys, lambda k: k != "")
    return [F.xxhash64(full).alias("t1"), F.xxhash64(F.lit(7), full).alias("t2")]


def shared_lines(docs: DataFrame, min_docs: int = 10, n_batches: int | None = None, by_text: bool = False) -> DataFrame:
    """docs' rows as r1, r2, and drop: the sorted positions of the lines to drop (only rows that lose a line).

    Each row of docs counts as one document, a line once in each. With by_text, rows of equal text_key() count as one
    document together.
    """
    spark = docs.sparkSession
    n_docs = docs.count()
    n_batches = n_batches or max(LEAST_BATCHES, math.isqrt(n_docs // BATCH_DOCS))
    of = ["t1", "t2"] if by_text else ["r1", "r2"]
    keys = ["r1", "r2", *(of if by_text else [])]
    split = F.split(text_or_empty(), "\n", -1)
    if by_text:
        # A column of its own, so that the keys are computed once.
        rows = docs.select(*row_key(), F.transform(split, line_key).alias("lines")).select("r1", "r2", *text_key(F.col("lines")), "lines")
        each = rows.select(*keys, F.posexplode("lines").alias("pos", "key"))
    else:
        each = docs.select(*row_key(), F.posexplode(split).alias("pos", "line")).select(*keys, "pos", line_key(F.col("line")).alias("key"))
    lines = each.where(F.length("key") > 0).select(*keys, "pos", *key_hash(F.col("key")), F.pmod(F.col(of[0]), F.lit(n_batches)).cast("int").alias("batch"))
    lines = stored(lines, "lines", ("batch",))
    runs = SortedRuns(spark, min_docs)
    if by_text:
        of_docs = lines.groupBy("batch", *HASH, *of).agg(F.lit(1).cast("long").alias("docs"))
    else:
        # A row repeated as a whole holds each of its lines at one position as often as it is repeated.
        of_docs = lines.groupBy("batch", *HASH, *of).agg((F.count("*") / F.countDistinct("pos")).cast("long").alias("docs"))
    for k in range(n_batches):
        runs.add(of_docs.where(F.col("batch") == k).groupBy(*HASH).agg(F.sum("docs").alias("n")))
    frequent = stored(runs.frequent(), "frequent")
    runs.drop()
    # A key in a large share of all documents, to be dropped or not, would fill one task of a shuffled join; there are few such keys.
    often = F.col("n") >= max(min_docs, n_docs // HOT_SHARE)
    many = stored(lines.groupBy(*HASH).agg(F.count("*").alias("n")).where(often).select(*HASH), "many")
    hot = stored(many.join(frequent.select(*HASH), HASH, "left_semi"), "hot")
    cold = frequent.join(F.broadcast(hot), HASH, "left_anti").select(*HASH)
    rare = lines.join(F.broadcast(many), HASH, "left_anti")
    gone = lines.join(F.broadcast(hot), HASH, "left_semi").unionByName(rare.join(cold, HASH, "left_semi"))
    return gone.groupBy("r1", "r2").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def without_shared_lines(docs: DataFrame, min_docs: int = 10, n_batches: int | None = None, by_text: bool = False) -> DataFrame:
    """docs with `text` less the lines whose key at least min_docs documents hold, and columns n_lines, n_dropped.

    A null or empty text is one empty line and stays; an empty key is never dropped. A text that loses all its
    lines becomes empty. Repeated rows count as documents each and keep equal results; null ids are ids like
    others. Columns n_lines and n_dropped of docs are replaced, all others stay. An empty table stays empty.
    With by_text, rows of equal text (but for case and white space around lines) count as one document.
    """
    gone = shared_lines(docs, min_docs, n_batches, by_text).withColumnsRenamed({"r1": "__r1", "r2": "__r2", "drop": "__drop"})
    r1, r2 = row_key()
    kept = docs.drop("n_lines", "n_dropped")
    out = kept.join(gone, (r1 == F.col("__r1")) & (r2 == F.col("__r2")), "left")
    lines = F.split(text_or_empty(), "\n", -1)
    n, drop = F.size(lines), F.coalesce(F.col("__drop"), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), drop)
    text = F.when(F.size(drop) > 0, F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n")).otherwise(F.col("text"))
    return out.select(*[(text if c == "text" else F.col(f"`{c}`")).alias(c) for c in kept.columns], n.cast("long").alias("n_lines"), F.size(drop).cast("long").alias("n_dropped"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row, lines in 10 documents or more dropped."""
    out = without_shared_lines(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(text_or_empty(), 256).alias("kept_sha256"))
