"""Lines that many documents share go, by levelled sorted runs of line hashes.

A run is a table of (line, docs): the hash of a line's key and how many documents of some batches hold it, bucketed by the hash
and sorted in each bucket, so runs are joined and merged bucket by bucket without an exchange. Documents come in batches. A
batch is first counted by itself; the hashes that a run has already found in enough documents are decided, and an anti-join
with each run takes them out; what is left is written as a run of level 0. Two runs of a level are merged into one of the next
level, so a hash is rewritten once a level, and after n batches there are at most log2(n) + 1 runs to meet. All runs merged give
the decided hashes, and every document, of whatever batch, loses the lines that have one.

The key of a line is the line without spaces and control blanks at its ends, A-Z in lower case; keys shorter than `least` code
points never count and stay. A document counts once for a key. Keys are hashed to 64 bits: a rare line that shared its hash with a
frequent one would go with it.

Null and empty texts are one empty line. Rows that repeat an id or a text are documents of their own. Dropped lines are
found by place for each distinct text, and what stays is put together from the stretches between them, in time linear in the text.
Columns of the documents are nested in `row`, so they clash with nothing; an empty table gives no rows. Only DataFrame functions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xpanel.llm.common import delete, materialise, nested, shared_dir

BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCHES = 8


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hash(line: Column, least: int = 1) -> Column:
    """The hash of a line's key; null for a key shorter than `least`."""
    key = F.btrim(line, F.lit(BLANK))
    low = F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, UPPER, UPPER.lower()))  # lower() alone changes other letters too
    return F.when(F.length(key) >= least, F.xxhash64(low))


def line_hashes(text: Column, least: int = 1) -> Column:
    return F.transform(lines_of(text), lambda x: line_hash(x, least))


class LineRuns:
    """The runs of one corpus, as tables below `path` in the shared folder."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = 10):
        self.spark, self.path, self.min_docs = spark, path, min_docs
        self.levels: list[list[str]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "line").sortBy("line").option("path", f"{self.path}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, one: str, other: str) -> DataFrame:
        """Two runs as one: a merge join, bucket by bucket."""
        a, b = (self.spark.table(name) for name in (one, other))
        docs = F.coalesce(a["docs"], F.lit(0)) + F.coalesce(b["docs"], F.lit(0))
        return a.join(b, a["line"] == b["line"], "full").select(F.coalesce(a["line"], b["line"]).alias("line"), docs.alias("docs"))

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        delete(self.spark, [f"{self.path}/{name}" for name in names])

    def add(self, counts: DataFrame) -> None:
        """A batch: (line, docs), a row per hash."""
        for name in self.live():
            decided = self.spark.table(name).filter(F.col("docs") >= self.min_docs).select("line")
            counts = counts.join(decided, "line", "left_anti")
        self._write(counts, 0)
        for level, names in enumerate(self.levels):  # a merge may make two of the next level, which comes next
            if len(names) == 2:
                self._merge(level)

    def _merge(self, level: int) -> None:
        pair, self.levels[level] = self.levels[level], []
        self._write(self._merged(*pair), level + 1)
        self._drop(pair)

    def live(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def decided(self) -> DataFrame:
        """The hashes that enough documents hold; first merges what runs there are into one."""
        for level, names in enumerate(self.levels):
            rest = [n for above in self.levels[level + 1 :] for n in above]
            if len(names) == 2:
                self._merge(level)
            elif names and rest:  # alone on its level: it goes up
                self.levels[level] = []
                self.levels[level + 1].append(names[0])
        rows = [self.spark.table(name) for name in self.live()] or [self.spark.createDataFrame([], "line long, docs long")]
        return rows[0].filter(F.col("docs") >= self.min_docs).select("line")

    def close(self) -> None:
        self._drop(self.live())
        self.levels = []


def batch_counts(docs: DataFrame, batches: int, least: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(batch, line, docs): documents of a batch that hold a hash; ids are dealt into batches by hash."""
    batch = F.pmod(F.xxhash64(key), F.lit(batches)).cast("int").alias("batch")
    held = docs.select(batch, F.explode(F.array_distinct(line_hashes(F.col(text), least))).alias("line")).filter("line IS NOT NULL")
    return held.groupBy("batch", "line").agg(F.count("*").alias("docs"))


def frequent_lines(docs: DataFrame, min_docs: int = 10, least: int = 1, batches: int = BATCHES, text: str = "text") -> DataFrame:
    """The hashes of the keys that at least `min_docs` documents hold."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    batch_counts(docs, batches, least, text).write.partitionBy("batch").parquet(f"{path}/counts")
    counts = spark.read.schema("line long, docs long, batch int").parquet(f"{path}/counts")
    runs = LineRuns(spark, path, min_docs)
    for b in range(batches):
        runs.add(counts.filter(F.col("batch") == b).select("line", "docs"))
    out = materialise(runs.decided())
    runs.close()
    delete(spark, [path])
    return out


def without(text: Column, dropped: Column) -> Column:
    """The text without the lines at the places (from 0, ascending)."""
    lines, n = lines_of(text), F.size(dropped)
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(dropped, i - 1) + 1)
    stop = lambda i: F.when(i == n, F.size(lines)).otherwise(F.get(dropped, i))
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, start(i) + 1, stop(i) - start(i)))
    return F.when(n > 0, F.array_join(F.flatten(kept), "\n")).otherwise(F.coalesce(text, F.lit("")))


def dedup_lines(docs: DataFrame, min_docs: int = 10, least: int = 1, batches: int = BATCHES, text: str = "text") -> DataFrame:
    """row (the columns of docs), n_lines, n_dropped and kept, the text without the lines that `min_docs` documents or more share."""
    frequent = frequent_lines(docs, min_docs, least, batches, text=text)
    # two hashes of a text stand for it: what goes from a text is found once for all its copies
    own = [F.xxhash64(F.coalesce(text, F.lit(""))).alias("_k"), F.xxhash64(F.coalesce(text, F.lit("")), F.lit(1)).alias("_l")]
    places = docs.select(*own, F.posexplode(line_hashes(F.col(text), least)).alias("_pos", "line")).filter("line IS NOT NULL")
    # written first, so the join below has an exchange on either side and nothing else, and Spark can split a text with many copies
    dropped = materialise(places.join(frequent, "line", "left_semi").groupBy("_k", "_l").agg(F.sort_array(F.collect_set("_pos")).alias("_dropped")))
    out = docs.select(nested(docs).alias("row"), *own).join(dropped, ["_k", "_l"], "left")
    gone, whole = F.coalesce("_dropped", F.array().cast("array<int>")), F.col("row").getField(text)
    return out.select("row", F.size(lines_of(whole)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), without(whole, gone).alias("kept"))


def dedup_report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def oracle(min_docs: int = 10, least: int = 1) -> str:
    """dedup_report in SQL."""
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANK)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS i, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT i, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
    k AS (SELECT *, translate(trim(line, {blanks}), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
    f AS (SELECT key FROM k WHERE length(key) >= {least} GROUP BY key HAVING count(DISTINCT i) >= {min_docs}),
    m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m JOIN d USING (i) GROUP BY i, doc_id"""
