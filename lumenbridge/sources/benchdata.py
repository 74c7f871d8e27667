"""The driver's tables as a corpus: orders are papers, parts of their lines are terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KnownTerm, Ranking, Split, Study

STUDY = Study(
    splits=(Split("dev", 1997, 1998, 1999), Split("test", 1999, 2000, 2001)),
    anchors_a=("Brand#8 red plate",), anchors_c=("Brand#16 hot rod",),
    ranking=Ranking(),
    known=(
        KnownTerm("plate", "Brand#8 red plate; Brand#8 blue plate"), KnownTerm("rod", "Brand#16 hot rod;;Brand#1 hot rod "), KnownTerm("widget", "Brand#17 red widget;Brand#2 red widget"),
        KnownTerm("ring", "Brand#2 small ring;Brand#3 small ring"), KnownTerm("gear", "Brand#3 hot gear"), KnownTerm("gizmo", "Brand#25 small gizmo;Brand#4 small gizmo"), KnownTerm("absent", "No such term"),
    ),
)
OPEN_RANKING = Ranking(df_min=2)

#: An order's article as JSON, in several shapes; reads the same in Spark's and in other SQL.
RAW_ARTICLE = """
CASE o_orderkey % 7
  WHEN 6 THEN concat('{"MedlineCitation":{"PMID":"', CAST(o_orderkey AS VARCHAR(20)), '"}}')
  ELSE concat('{"MedlineCitation":{"PMID":"', CAST(o_orderkey AS VARCHAR(20)), '",',
    CASE o_orderkey % 7 WHEN 5 THEN concat('"DateRevised":{"Year":"', CAST(year(o_orderdate) AS VARCHAR(4)), '"},') ELSE '' END,
    '"MeshHeadingList":[{"DescriptorName":"', o_orderpriority, '"},{"DescriptorName":"', o_orderpriority, '"},{"DescriptorName":""}],"Article":{"ArticleTitle":"Order ', o_orderstatus, '","Abstract":{"AbstractText":',
    CASE o_orderkey % 3 WHEN 0 THEN concat('["Part ', o_orderstatus, '","  ","end "]') WHEN 1 THEN concat('" about ', o_orderpriority, ' "') ELSE '""' END,
    '},"Journal":{"Title":"Journal","JournalIssue":{"PubDate":{',
    CASE o_orderkey % 7
      WHEN 0 THEN concat('"Year":"', CAST(year(o_orderdate) AS VARCHAR(4)), '","Month":"', CAST(month(o_orderdate) AS VARCHAR(2)), '","Day":"', CAST(day(o_orderdate) AS VARCHAR(2)), '"')
      WHEN 1 THEN concat('"Year":"', CAST(year(o_orderdate) AS VARCHAR(4)), '","Month":"March","Day":"x1"')
      WHEN 2 THEN concat('"Year":"', CAST(year(o_orderdate) AS VARCHAR(4)), '"')
      WHEN 3 THEN concat('"MedlineDate":"', CAST(year(o_orderdate) AS VARCHAR(4)), ' Winter"')
      WHEN 4 THEN concat('"Year":"', CAST(year(o_orderdate) AS VARCHAR(4)), '","Month":"Foo","Day":"5"')
      ELSE '' END,
    '}}}}}}') END
"""

#: A part's extraction answer: fenced, plain, no JSON, no list, fenced without a newline, a list with items that are no objects, text after the object.
ANSWER = """
CASE p_partkey % 7
  WHEN 2 THEN concat('no relations in ', p_name)
  WHEN 3 THEN '{"relations": "none"}'
  WHEN 5 THEN concat('{"relations":[7,"', p_brand, '",null,["x"],{"subject":"', p_name, '","predicate":"binds","object":"', p_type, '","evidence":"e"},{"subject":"s"}]}')
  WHEN 6 THEN CASE p_partkey % 2 WHEN 0 THEN '{"relations":[]} trailing' ELSE '{"relations":[]}, {"relations":[]}' END
  ELSE concat(CASE p_partkey % 7 WHEN 0 THEN concat('```json', chr(10)) WHEN 4 THEN '```json ' ELSE '' END,
    '{"relations":[{"subject":" ', p_name, '","predicate":"inhibits","object":"', p_type, '","evidence":""},{"subject":"', p_brand, '","predicate":"  ","object":"x","evidence":"e"}]}',
    CASE p_partkey % 7 WHEN 0 THEN concat(chr(10), '```') WHEN 4 THEN '```' ELSE '' END) END
"""

#: A part's stored payload: with token counts, with none, with an incomplete triple.
PAYLOADS = """
concat('{"model":"m","relations":[{"subject":"', p_name, '","predicate":"is","object":"', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END, '"}]',
  CASE p_partkey % 3 WHEN 0 THEN concat(',"usage":{"prompt_tokens":', CAST(p_size AS VARCHAR(9)), ',"output_tokens":7},"parse_ok":false') WHEN 1 THEN ',"usage":null' ELSE ',"parse_ok":true' END, '}')
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pmid, pub_date, pub_year (also as yr), abstract, fetched_at, in_a, in_c."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    key = F.col("o_orderkey")
    abstract = F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, "").otherwise(F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
    year = F.year("o_orderdate")
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left").select(
        key.cast("string").alias("pmid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub_date"), year.alias("pub_year"), year.alias("yr"), abstract.cast("string").alias("abstract"),
        F.col("o_orderdate").alias("fetched_at"), (F.col("o_orderpriority") == "1-URGENT").alias("in_a"), F.coalesce(F.col("c_mktsegment") == "BUILDING", F.lit(False)).alias("in_c"))


def corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, corridor) rows."""
    sides = F.filter(F.array(F.when(F.col("in_a"), "A"), F.when(F.col("in_c"), "C")), lambda s: s.isNotNull())
    return papers(spark, sf_dir).select("pmid", F.explode(sides).alias("corridor"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corridor, pub_year, pub_date, pmid) of both corridors."""
    return corridor(spark, sf_dir).join(papers(spark, sf_dir).select("pmid", "pub_year", "pub_date"), "pmid").select("corridor", "pub_year", "pub_date", "pmid")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, partkey, term, p_type, mentioned) of every line."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").cast("string").alias("pmid"), F.col("l_partkey").cast("string").alias("partkey"), F.concat_ws(" ", "p_brand", "p_name").alias("term"), "p_type", (F.col("l_returnflag") == "R").alias("mentioned"))


def terms(spark: SparkSession, sf_dir: str, term: str = "term", without: tuple[str, ...] = ()) -> DataFrame:
    """(pmid, term, grounded): grounded by the mention flag of a line; the terms ``without`` (anchors) are left out, whatever column names them."""
    rows = lines(spark, sf_dir)
    return (rows.filter(~F.col("term").isin(*without)) if without else rows).groupBy("pmid", F.col(term).alias("term")).agg(F.max("mentioned").alias("grounded"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, relations) of papers with a returned line: subject the term, object the part's type."""
    triple = F.struct(F.col("term").alias("subject"), F.lit("is").alias("predicate"), F.col("p_type").alias("object"), F.lit("").alias("evidence"))
    return lines(spark, sf_dir).filter("mentioned").groupBy("pmid").agg(F.collect_set(triple).alias("relations"))


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(descriptor, forms): the descriptor and the part's name without its brand."""
    part = table(spark, sf_dir, "part")
    term = F.concat_ws(" ", "p_brand", "p_name")
    return part.select(term.alias("descriptor"), F.array(term, F.col("p_name")).alias("forms")).distinct()


def extractions(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """(pmid, model, prompt_hash, payload, created_at): some papers have two; with ``gaps``, a quarter of them has none yet."""
    orders = table(spark, sf_dir, "orders")
    orders = orders.filter(F.col("o_orderkey") % 4 != 0) if gaps else orders
    n = F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1)
    rows = orders.withColumn("try", F.explode(F.sequence(F.lit(1), n)))
    return rows.select(
        F.col("o_orderkey").cast("string").alias("pmid"), F.when(F.col("o_orderkey") % 9 == 0, "other").otherwise("extractor-1").alias("model"),
        F.md5(F.concat_ws("/", "o_orderkey", "try")).alias("prompt_hash"), F.concat_ws(" ", "o_orderstatus", "try").alias("payload"), F.col("o_orderdate").alias("created_at"))
