"""A stored inverted index: postings with positions, document frequencies and totals, written once and read by term.

Postings lie in folders by a hash of the term, in files sorted by term: a query lists the folders of its terms, and row
groups without them are skipped by their statistics. What a search reads grows with its terms' postings, not with the
corpus. Building shuffles every posting once for its group and once for its place; a term that is in a third of all
documents is spread over several files by the range partition, since documents are part of the range's key.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import TOKEN, tokens
from lodestrata.operators import fts
from lodestrata.scratch import scratch_dir

#: Folders of postings; more of them let a larger index be listed in smaller parts.
BUCKETS = 16


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def build(docs: DataFrame, id_col: str, text_cols: dict[str, str], path: str, buckets: int = BUCKETS) -> TextIndex:
    """Writes the index of the fields (name -> column) of docs to path. A null text has no tokens and length 0."""
    parts, totals = None, None
    for name, column in text_cols.items():
        w = docs.select(F.col(id_col).alias("id"), F.lit(name).alias("field"), F.coalesce(tokens(F.col(column)), F.array().cast("array<string>")).alias("w"))
        one = w.select("id", "field", F.size("w").cast("long").alias("dl"), F.posexplode("w").alias("pos", "term"))
        total = docs.agg(F.lit(name).alias("field"), F.count("*").alias("n"), F.avg(F.regexp_count(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(TOKEN)).cast("long")).alias("avgdl"))
        parts, totals = (one, total) if parts is None else (parts.unionByName(one), totals.unionByName(total))
    grouped = parts.groupBy("term", "field", "id", "dl").agg(F.array_sort(F.collect_list("pos")).alias("pos")).withColumn("tf", F.size("pos").cast("long"))
    placed = grouped.withColumn("bucket", _bucket(F.col("term"), buckets)).repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "field", "id")
    placed.write.partitionBy("bucket").parquet(f"{path}/postings")
    spark = docs.sparkSession
    df = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term", "field").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("dl").alias("longest"))
    df.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    totals.coalesce(1).write.parquet(f"{path}/totals")
    return TextIndex(spark, path, buckets)


@dataclass
class TextIndex:
    """Searches over a stored index. Each match gives (id); scores are those of fts.bm25."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def __post_init__(self):
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        one = self.spark.read.parquet(f"{self.path}/totals")
        self.totals = {r["field"]: (r["n"], r["avgdl"]) for r in one.collect()}  # a row for each field
        ids = self.spark.read.parquet(f"{self.path}/postings").schema["id"].dataType.simpleString()
        self._postings = read("postings", f"term string, field string, id {ids}, dl bigint, pos array<int>, tf bigint, bucket int")
        self._terms = read("terms", "term string, field string, df bigint, cf bigint, longest bigint, bucket int")

    def _of(self, table: DataFrame, terms: list[str], field: str) -> DataFrame:
        buckets = sorted({_crc(t) % self.buckets for t in terms})
        return table.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms) & (F.col("field") == field))

    def postings(self, terms: list[str], field: str = "text") -> DataFrame:
        """(term, id, dl, pos, tf) of the terms."""
        return self._of(self._postings, list(dict.fromkeys(terms)), field).select("term", "id", "dl", "pos", "tf")

    def frequencies(self) -> DataFrame:
        """(term, field, df, cf, longest) of every term."""
        return self._terms.select("term", "field", "df", "cf", "longest")

    def bm25(self, terms: list[str], field: str = "text", k1: float = fts.K1, b: float = fts.B) -> DataFrame:
        """(id, score) of documents that hold any term, from the terms' postings only."""
        terms = list(dict.fromkeys(terms))
        n, avgdl = self.totals.get(field, (0, None))
        known = F.broadcast(self._of(self._terms, terms, field).select("term", "df"))  # a row for each of the query's terms
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
        each = [F.sum(F.when(F.col("term") == t, F.col("part"))).alias(f"p{i}") for i, t in enumerate(terms)]
        sums = self.postings(terms, field).join(known, "term").withColumn("part", part).groupBy("id").agg(*each)
        score = F.lit(0.0)  # in order of the terms, so that the sum doesn't depend on that of the rows
        for i in range(len(terms)):
            score = score + F.coalesce(f"p{i}", F.lit(0.0))
        return sums.select("id", F.round(score, 6).alias("score"))

    def match_any(self, terms: list[str], field: str = "text") -> DataFrame:
        return self.postings(terms, field).select("id").distinct()

    def match_all(self, terms: list[str], field: str = "text") -> DataFrame:
        n = len(set(terms))
        return self.postings(terms, field).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == n).select("id")

    def match_prefix(self, prefix: str, field: str = "text") -> DataFrame:
        """All folders, but only row groups whose terms may begin so."""
        return self._postings.filter(F.startswith("term", F.lit(prefix)) & (F.col("field") == field)).select("id").distinct()

    def match_phrase(self, terms: list[str], field: str = "text") -> DataFrame:
        """Consecutive tokens: positions less the word's place in the phrase agree."""
        places = {t: [i for i, x in enumerate(terms) if x == t] for t in terms}
        at = F.create_map(*[x for t, p in places.items() for x in (F.lit(t), F.array(*map(F.lit, p)))])
        starts = F.flatten(F.transform(F.element_at(at, F.col("term")), lambda i: F.transform("pos", lambda p: p - i)))
        found = self.postings(terms, field).select("id", F.explode(starts).alias("start"))
        return found.groupBy("id", "start").agg(F.count("*").alias("n")).filter(F.col("n") == len(terms)).select("id").distinct()

    def match_near(self, terms: list[str], gap: int, field: str = "text") -> DataFrame:
        """Every term within a stretch with at most `gap` tokens between the first and the last, in any order."""
        terms = list(dict.fromkeys(terms))
        both = self.match_all(terms, field)
        at = self.postings(terms, field).join(both, "id", "left_semi").select("id", "term", F.explode("pos").alias("pos"))
        back = W.partitionBy("id").orderBy("pos").rangeBetween(-(gap + len(terms) - 1), 0)
        return at.withColumn("held", F.size(F.collect_set("term").over(back))).filter(F.col("held") == len(terms)).select("id").distinct()

    def match(self, clause: fts.Clause) -> DataFrame:
        fields = [clause.field] if clause.field else list(self.totals)
        found = None
        for f in fields:
            one = {
                "phrase": lambda f=f: self.match_phrase(list(clause.terms), f),
                "near": lambda f=f: self.match_near(list(clause.terms), clause.gap, f),
                "all": lambda f=f: self.match_all(list(clause.terms), f),
                "any": lambda f=f: self.match_any(list(clause.terms), f),
                "prefix": lambda f=f: self.match_prefix(clause.terms[0], f),
            }[clause.kind]()
            found = one if found is None else found.union(one).distinct()
        return found

    def cascade(self, clauses: list[fts.Clause], each: int = 300, field: str = "text") -> DataFrame:
        """(list_no, id, rank): every clause's matches by BM25 of its terms, the best `each` of them."""
        out = None
        for i, c in enumerate(clauses):
            scored = self.bm25(list(c.terms), field) if c.kind != "prefix" else self.match(c).select("id", F.lit(0.0).alias("score"))
            hits = fts.top(scored if c.kind == "any" else scored.join(self.match(c), "id", "left_semi"), each, "id")
            ranked = hits.select(F.lit(i).alias("list_no"), "id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"))  # at most `each` rows
            out = ranked if out is None else out.unionByName(ranked)
        return out


def _crc(term: str) -> int:
    import zlib

    return zlib.crc32(term.encode("utf-8"))


_opened: dict[tuple, TextIndex] = {}


def stored(docs: DataFrame, id_col: str, text_cols: dict[str, str], buckets: int = BUCKETS) -> TextIndex:
    """The index of a table of files, built in the scratch folder where it isn't there yet.

    Its name comes from the files, their sizes and times, and the fields, so a changed table gets a new index.
    """
    spark = docs.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stamp = []
    for name in sorted(docs.inputFiles()):
        where = jvm.org.apache.hadoop.fs.Path(name)
        status = where.getFileSystem(conf).getFileStatus(where)
        stamp.append((name, status.getLen(), status.getModificationTime()))
    key = hashlib.sha256(json.dumps([stamp, id_col, text_cols, buckets]).encode()).hexdigest()[:32]
    path = f"{scratch_dir(spark)}/text-index-{key}"
    known = (spark.sparkContext.applicationId, path)
    if known not in _opened:
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/totals/_SUCCESS")  # the part that is written last
        fs = done.getFileSystem(conf)
        if not fs.exists(done):
            fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
            build(docs, id_col, text_cols, path, buckets)
        _opened[known] = TextIndex(spark, path, buckets)
    return _opened[known]
