"""Two captures of one site and its links, derived from the table ``documents``.

The statements are SQL that Spark and DuckDB read alike; document 1 is the root page,
2 to 21 are section heads, the others lie below them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import simhash
from .scratch import spread

URLS = """
select doc_id, text, case when doc_id = 1 then 'http://example.org/'
  when doc_id between 2 and 21 then 'http://example.org/s' || cast(doc_id % 20 as string)
  when doc_id < 200 then 'http://example.org/s' || cast(doc_id % 20 as string) || '/' || cast(doc_id as string)
  else 'http://example.org/s' || cast(doc_id % 20 as string) || '/' || cast(40 + doc_id % 160 as string) || '/' || cast(doc_id as string) end as url
from {documents}"""

CAPTURE_A = """
select doc_id as line_no, url, '2024-01-01T00:00:00Z' as capture_date,
  case when doc_id % 17 = 16 then 404 when doc_id % 13 = 12 then 301 else 200 end as status,
  case when doc_id % 10 = 7 then 'image/png' when doc_id % 10 = 8 then 'application/pdf' else 'text/html; charset=UTF-8' end as mime_type,
  md5(text) as md5, cast(null as string) as redir_location, text,
  case when doc_id % 3 = 0 then null else 'http://example.org/s' || cast(doc_id % 20 as string) end as section
from {u}"""

CAPTURE_B = """
select doc_id as line_no, url, '2024-06-01T00:00:00Z' as capture_date,
  case when doc_id % 17 = 16 then 404 else 200 end as status,
  case when doc_id % 10 = 7 then 'image/png' else 'text/html; charset=UTF-8' end as mime_type,
  md5(t2) as md5, cast(null as string) as redir_location, t2 as text,
  case when doc_id % 3 = 0 then null else 'http://example.org/s' || cast(doc_id % 20 as string) end as section
from (select doc_id, url, case when doc_id % 4 = 0 then substring(text, 1, 200) else text end as t2 from {u} where doc_id % 5 <> 3) v"""

LINKS = """
select r.url as src, h.url as dst, 'L' as link_type from {u} r join {u} h on h.doc_id between 2 and 21 where r.doc_id = 1
union all select r.url, h.url, 'L' from {u} r join {u} h on h.doc_id between 2 and 21 and h.doc_id % 2 = 0 where r.doc_id = 1
union all select h.url, d.url, 'L' from {u} h join {u} d on h.doc_id between 2 and 21 and d.doc_id between 22 and 199 and d.doc_id % 20 = h.doc_id % 20
union all select p.url, d.url, 'L' from {u} d join {u} p on d.doc_id >= 200 and p.doc_id = 40 + d.doc_id % 160
union all select d.url, r.url, 'L' from {u} d join {u} r on r.doc_id = 1
union all select d.url, h.url, 'L' from {u} d join {u} h on h.doc_id between 2 and 21 and h.doc_id % 20 = (d.doc_id * 3) % 20 and d.doc_id % 3 <> 1
union all select d.url, x.url, d.link_type
  from (select url, case when doc_id % 5 = 0 then 'I' else 'L' end as link_type, (doc_id * 7 + 3) % (select count(*) from {u}) as target from {u}) d join {u} x on x.doc_id = d.target"""

COLUMNS = ["url", "capture_date", "status", "mime_type", "md5", "redir_location", "simhash", "simhash_main_text", "section"]


def urls_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(URLS, documents=spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def _measured(rows: DataFrame) -> DataFrame:
    page = F.when(F.col("mime_type").startswith("text/html"), F.col("text"))
    return rows.withColumn("simhash", simhash(page)).withColumn("simhash_main_text", F.lit(None).cast("long")).drop("text")


def capture_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url_info rows of the first capture, with fingerprints of html pages, and line_no."""
    return _measured(spark.sql(CAPTURE_A, u=urls_of(spark, sf_dir)))


def capture_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark.sql(CAPTURE_B, u=urls_of(spark, sf_dir)))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spark.sql(LINKS, u=spark.sql(URLS, documents=documents).drop("text"))
