"""Inputs as pages: the ``documents`` table, files of several formats, and a projected normative corpus.

The corpus is not natural text: it spells requirement documents from ``part`` and ``nation``, 80 parts to
a document, so that every kind of line, modality and reference occurs. Its statement is plain SQL that
Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_SQL = """
SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY k, j) - 1 AS INT) AS line_idx, raw
FROM (
  SELECT b.*, j, CASE j
      WHEN 0 THEN 'IEEE Std 2030 draft'
      WHEN 1 THEN CAST(page_number AS STRING)
      WHEN 2 THEN CASE CAST(floor(k / 8.0) AS BIGINT) % 5
          WHEN 0 THEN CAST(r AS STRING) || '.0 Scope of ' || n_name
          WHEN 1 THEN CAST(r AS STRING) || '.' || CAST(c AS STRING) || ' Duties of ' || n_name
          WHEN 2 THEN CAST(r AS STRING) || '.' || CAST(c AS STRING) || '.' || CAST(k % 3 + 1 AS STRING) || ' Limits of ' || n_name
          WHEN 3 THEN 'Annex A (informative) - Notes on ' || n_name
          ELSE 'A.' || CAST(c AS STRING) || ' General terms' END
      WHEN 3 THEN CASE
          WHEN k % 9 = 4 THEN ''
          WHEN k % 17 = 6 THEN 'Operators are to ensure the ' || obj || ' is necessary.'
          ELSE CASE k % 11 WHEN 3 THEN '• ' WHEN 5 THEN '1) ' ELSE '' END || 'The ' || noun || ' ' || modal || ' use the ' || obj || ' timeout'
            || CASE k % 6
                 WHEN 0 THEN ' as defined in Section ' || CAST(r AS STRING) || '.' || CAST(c AS STRING)
                 WHEN 1 THEN ' and rely on Clause ' || CAST(r AS STRING) || ' or Annex A'
                 WHEN 2 THEN ' since they depend on REQ-00' || CAST(k % 9 + 1 AS STRING)
                 WHEN 3 THEN ' to replace REQ-00' || CAST(k % 5 + 1 AS STRING) || ' or REQ-900'
                 ELSE '' END
            || '. It follows vs. The old ' || lower(p_type) || ' rule, e.g. Part ' || CAST(k % 10 AS STRING) || ' (std. B).' END
      WHEN 4 THEN 'and the telemetry payload ' || CASE WHEN k % 2 = 0 THEN 'shall' ELSE 'shall not' END || ' stay valid.'
      WHEN 5 THEN noun || ' | ' || obj || ' | ' || CAST(k % 100 AS STRING)
      WHEN 6 THEN 'load   ' || CAST(k % 100 AS STRING)
      ELSE 'Prepared by ' || n_name END AS raw
  FROM (
    SELECT p_partkey AS k, p_type, n_name,
      CAST(floor(p_partkey / 80.0) AS BIGINT) AS doc_id, CAST(floor((p_partkey % 80) / 20.0) AS INT) + 1 AS page_number,
      CAST(floor(p_partkey / 80.0) AS BIGINT) % 5 + CASE WHEN p_partkey % 80 < 48 THEN 1 ELSE 2 END AS r, p_partkey % 3 + 1 AS c,
      CASE p_partkey % 7 WHEN 0 THEN 'server' WHEN 1 THEN 'client' WHEN 2 THEN 'gateway' WHEN 3 THEN 'register' WHEN 4 THEN 'interface' WHEN 5 THEN 'protocol' ELSE 'process' END AS noun,
      CASE (p_partkey + 3) % 5 WHEN 0 THEN 'payload' WHEN 1 THEN 'heartbeats' WHEN 2 THEN 'storage' WHEN 3 THEN 'frequency' ELSE 'buffer' END AS obj,
      CASE p_size % 6 WHEN 0 THEN 'shall' WHEN 1 THEN 'must' WHEN 2 THEN 'shall not' WHEN 3 THEN 'should' WHEN 4 THEN 'may' ELSE 'should not' END AS modal
    FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25) b
  CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) lines
  WHERE j = 3 OR (j < 2 AND k % 20 = 0) OR (j = 2 AND k % 8 = 0) OR (j = 4 AND k % 5 = 1) OR (j IN (5, 6) AND k % 13 = 5) OR (j = 7 AND k % 20 = 19)
) x
"""


def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, text of the projected corpus."""
    sql = CORPUS_SQL.format(part=f"parquet.`{sf_dir}/part.parquet`", nation=f"parquet.`{sf_dir}/nation.parquet`")
    parts = F.array_sort(F.collect_list(F.struct("line_idx", "raw")))
    return spark.sql(sql).groupBy("doc_id", "page_number").agg(F.array_join(F.transform(parts, lambda p: p["raw"]), "\n").alias("text"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table with each document as its only page."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page_number"), "text")


PAGES = "doc_id long, page_number int, text string"


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Pages from parquet, json or csv with the columns of PAGES; or from text files, one a document, with form feeds between pages."""
    if kind == "parquet":
        return spark.read.parquet(path).selectExpr("CAST(doc_id AS BIGINT) doc_id", "CAST(page_number AS INT) page_number", "text")
    if kind == "json":
        return spark.read.schema(PAGES).json(path)
    if kind == "csv":
        return spark.read.schema(PAGES).csv(path, header=True, multiLine=True, escape='"')
    if kind == "text":
        files = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.posexplode(F.split("value", "\f", -1)).alias("i", "text"))
        return files.select("doc_id", (F.col("i") + 1).alias("page_number"), "text")
    raise ValueError(f"unknown kind of pages: {kind}")


def extract_pages(files: DataFrame, extract) -> DataFrame:
    """Pages of binary files (path, content) by any function from bytes to a list of page texts.

    A file that fails gives one page with a null text and the failure in the column error.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids, numbers, texts, errors = [], [], [], []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                failure = None
                try:
                    pages = list(extract(content.as_py()))
                except Exception as e:  # noqa: BLE001  one unreadable file must not stop the others
                    pages, failure = [None], f"{type(e).__name__}: {e}"
                ids += [doc] * len(pages)
                numbers += range(1, len(pages) + 1)
                texts += pages
                errors += [failure] * len(pages)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["doc_id", "page_number", "text", "error"])

    return files.select(F.xxhash64("path").alias("doc_id"), "content").mapInArrow(run, PAGES + ", error string")
