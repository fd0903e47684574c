"""A written index of the nodes by the three-letter pieces of their texts, for searches that read only what can match."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from specloom.functions import text as T
from specloom.functions.vocabulary import Domain
from specloom.operators import domains as D
from specloom.operators import explore, search
from specloom.operators.domains import Domains

GRAM = 3
FIELDS = ("name", "title", "text", "id", "section_number")  # what a search looks at
RAREST = 4  # pieces of a search word that are looked up; what has them all is then compared with the whole word
BUCKETS = 64


def pieces(c: Column) -> Column:
    """The distinct pieces of a text: from each of its characters on three, or what is left at its end."""
    chars = F.split(c, "")
    at = lambda i: F.coalesce(F.get(chars, i), F.lit(""))
    found = F.transform(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: F.concat(at(i), at(i + 1), at(i + 2)))
    return F.when(F.coalesce(c, F.lit("")) != "", F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class NodeIndex:
    """The nodes by buckets of documents, their pieces in order of the piece, and how many nodes have each piece.

    The postings of a piece that very many nodes have are cut over files, as they are in order of piece, document and node.
    """

    spark: SparkSession
    folder: str
    schema: StructType | None = None  # of the nodes, where the caller knows it; a table without rows has no file to read it from

    @classmethod
    def build(cls, nodes: DataFrame, folder: str, buckets: int = BUCKETS) -> NodeIndex:
        spark = nodes.sparkSession
        rows = nodes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
        rows.repartitionByRange("bucket", "doc_id", "node_ord").sortWithinPartitions("bucket", "doc_id", "node_ord").write.partitionBy("bucket").parquet(f"{folder}/nodes")
        found = F.array_distinct(F.flatten(F.array(*[pieces(F.lower(c)) for c in FIELDS])))
        postings = rows.select(F.explode(found).alias("piece"), "bucket", "doc_id", "node_ord")
        postings.repartitionByRange("piece", "doc_id", "node_ord").sortWithinPartitions("piece", "doc_id", "node_ord").write.parquet(f"{folder}/postings")
        made = cls(spark, folder, rows.select(*nodes.columns, "bucket").schema)
        made.postings.groupBy("piece").agg(F.count("*").alias("n")).repartitionByRange("piece").sortWithinPartitions("piece").write.parquet(f"{folder}/counts")
        return made

    @property
    def nodes(self) -> DataFrame:
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(f"{self.folder}/nodes")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema("piece string, bucket int, doc_id long, node_ord int").parquet(f"{self.folder}/postings")

    def candidates(self, words: Sequence[str]) -> DataFrame:
        """bucket, doc_id, node_ord: the nodes that may hold one of the words (lower case, not empty), each once.

        A word of three letters or more is looked up by its rarest pieces; a shorter one begins a piece wherever it stands. Only the counts
        of the words' own pieces come to the driver.
        """
        words = list(dict.fromkeys(words))
        own = {w: {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)} for w in words if len(w) >= GRAM}
        every = sorted(set().union(*own.values())) if own else []
        counts = self.spark.read.schema("piece string, n long").parquet(f"{self.folder}/counts")
        n = {r["piece"]: r["n"] for r in counts.filter(F.col("piece").isin(every)).collect()} if every else {}
        chosen = [(w, p, min(len(ps), RAREST)) for w, ps in own.items() if all(p in n for p in ps) for p in sorted(ps, key=lambda p: (n[p], p))[:RAREST]]
        place = ["bucket", "doc_id", "node_ord"]
        asked = D.local(self.spark, chosen, "word string, piece string, k int")
        some = self.postings.filter(F.col("piece").isin(sorted({p for _, p, _ in chosen}))) if chosen else self.postings.limit(0)
        rows = some.join(F.broadcast(asked), "piece").groupBy("word", "k", *place).agg(F.count("*").alias("n")).filter("n = k").select(*place)
        for w in words:
            if len(w) < GRAM:
                rows = rows.unionByName(self.postings.filter(F.startswith("piece", F.lit(w))).select(*place))
        return rows.distinct()

    def _of(self, words: Sequence[str]) -> DataFrame:
        """The nodes that may hold one of the words; buckets without any are not read."""
        return self.nodes.join(self.candidates(words), ["bucket", "doc_id", "node_ord"], "left_semi").drop("bucket")

    def containing(self, query: str) -> DataFrame:
        """What :func:`explore.containing` finds among all nodes."""
        return explore.containing(self._of([query.lower()]) if query else self.nodes.drop("bucket"), query)

    def top(self, questions: Sequence[str], domain: Domain | Domains, n: int = search.TARGETS) -> DataFrame:
        """What :func:`search.top` finds among all nodes."""
        return search.top(self._of(self._words(questions)), questions, domain, n)

    def targets(self, questions: Sequence[str], domain: Domain | Domains) -> DataFrame:
        """What :func:`search.targets` finds among all nodes: what a question names or, by its words, what it finds."""
        names = search.names_of(self.spark, questions).select(F.lower("id").alias("id")).filter("id <> ''").distinct()
        return search.targets(self._of(self._words(questions) + [r["id"] for r in names.collect()]), questions, domain)

    def _words(self, questions: Sequence[str]) -> list[str]:
        """The words of the questions, stop words of some domain included, as they may be none in another."""
        asked = D.local(self.spark, [(q,) for q in dict.fromkeys(questions)], "query string")
        words = asked.select(F.explode(search.question_words(T.strip(F.col("query")))).alias("w")).filter("length(w) > 1").distinct()
        return sorted(r["w"] for r in words.collect())
