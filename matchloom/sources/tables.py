"""Entity tables, ground truth and exports; views of the test tables in the entity shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from .shared import checkpointed

ENTITY = T.StructType([T.StructField(x, T.StringType()) for x in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(x, T.StringType()) for x in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = ENTITY) -> DataFrame:
    """A tab-separated file with a header; doubled quotes in quoted fields, only '' is null ("NA" stays a name)."""
    return spark.read.schema(schema).options(sep="\t", header=True, escape='"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A comma-separated file with a header."""
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_source(entities: DataFrame) -> DataFrame:
    """Adds ``source``, the prefix of the id."""
    return entities.withColumn("source", F.substring_index("entity_id", "-", 1))


def shard_rows(df: DataFrame, order: str, part: int, parts: int) -> DataFrame:
    """Rows [(part - 1) n / parts, part n / parts) in the given order, part from 1; the last takes the rest.

    Row numbers come from counts of range partitions, so no task sees all rows.
    """
    n = df.count()
    each = n // parts
    begin = (part - 1) * each
    return slice_rows(df, [F.col(order)], begin, (n if part == parts else part * each) - begin)


def slice_rows(df: DataFrame, keys: list[Column], offset: int, length: int) -> DataFrame:
    """``length`` rows from place ``offset`` on, in the order of ``keys``."""
    numbered = positions(df, keys)
    return numbered.where((F.col("position") >= offset) & (F.col("position") < offset + length)).drop("position")


def positions(df: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """Adds the 0-based place of every row in the order of ``keys``, without a one-task window.

    Rows are dealt by range; each is numbered in its range, and the ranges' totals, one row each, give
    the numbers before it.  Equal keys may come in any order, so give a total order where that matters.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys, strict=True)))
    # Range bounds come from samples, so the ranges are written once; both plans below read the same ones.
    ranged = checkpointed(keyed.repartitionByRange(*names).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(*names)
    numbered = ranged.withColumn("_i", F.row_number().over(within) - 1).join(F.broadcast(bases), "_part")
    return numbered.withColumn(name, F.col("_i") + F.col("_base")).drop(*names, "_part", "_i", "_base", "_n")


def parse_truth(raw: DataFrame) -> DataFrame:
    """(s1, o) pairs of comma-joined lists; blanks go, repeats count once."""
    each = raw.select(F.col("source1_entity_id").alias("s1"), F.explode(F.split("matched_entity_ids", ",")).alias("o"))
    return each.select("s1", F.trim("o").alias("o")).where("o <> '' and lower(o) <> 'nan'").distinct()


def comma_lists(pairs: DataFrame, spine: DataFrame, name: str) -> DataFrame:
    """One row per id of the spine: its partners, sorted and comma-joined, '' if none."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.sort_array(F.collect_set("o")), ",").alias(name))
    ids = spine.select(F.col("entity_id").alias("s1")).distinct()
    return ids.join(lists, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def export_candidates(pairs: DataFrame, spine: DataFrame) -> DataFrame:
    return comma_lists(pairs, spine, "candidate_entity_ids")


def export_matches(pairs: DataFrame, spine: DataFrame) -> DataFrame:
    return comma_lists(pairs, spine, "matched_entity_ids")


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of tab-separated files with headers; empty lists stay empty, nothing is quoted."""
    df.write.mode("overwrite").options(sep="\t", header=True, emptyValue="", nullValue="", quote="\u0000").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """The report, a row per blocking pass, as one comma-separated file with a header."""
    report.coalesce(1).write.mode("overwrite").options(header=True).csv(path)


def write_parameters(spark: SparkSession, values: dict[str, float], path: str) -> None:
    """Tuned parameters, such as a threshold, as one JSON row."""
    row = spark.createDataFrame([tuple(map(float, values.values()))], [*values])
    row.coalesce(1).write.mode("overwrite").json(path)


def read_parameters(spark: SparkSession, path: str) -> dict[str, float]:
    return spark.read.json(path).first().asDict()


def check_export(exported: DataFrame, spine: DataFrame, others: DataFrame, column: str) -> DataFrame:
    """One row: ids missing from the export, ids twice in it, partners that don't exist."""
    each = exported.select("source1_entity_id", F.explode(F.split(column, ",")).alias("o")).where("o <> ''")
    ids = exported.groupBy("source1_entity_id").count()
    missing = spine.join(exported, spine["entity_id"] == exported["source1_entity_id"], "left_anti").agg(F.count("*").alias("missing"))
    twice = ids.agg(F.count_if(F.col("count") > 1).alias("repeated"))
    wrong = each.join(others, each["o"] == others["entity_id"], "left_anti").agg(F.count("*").alias("unknown"))
    return missing.crossJoin(twice).crossJoin(wrong)


def docs_er(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities: words 1 to 6 are the name, 7 to 18 the address, the language is the country."""
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    src = 1 + F.col("doc_id") % 3
    return read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        src.cast("int").alias("src"),
        F.col("doc_id").alias("row_pos"),
        F.array_join(F.slice(words, 1, 6), " ").alias("business_name"),
        F.array_join(F.slice(words, 7, 12), " ").alias("business_address"),
        F.col("lang").alias("country"),
        F.xxhash64("text").alias("truth_key"),
    )


def party_er(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as parties: short names with legal forms, addresses with postal codes, some countries null."""
    k = F.col("p_partkey")
    ending = F.when(k % 4 == 0, " Pvt. Ltd.").when(k % 4 == 1, " Inc").when(k % 4 == 2, " LLC").otherwise("")
    code = 10000 + F.col("p_size") * 100 + F.ascii(F.left("p_name", F.lit(1)))
    address = F.concat(
        F.col("p_size").cast("string"), F.lit(" "), F.when(k % 2 == 0, "M.G. Rd").otherwise("MG Road"), F.lit(", "),
        F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" "))), F.lit(" "), code.cast("string"),
    )
    src = 1 + k % 3
    return read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("S"), src.cast("string"), F.lit("-"), k.cast("string")).alias("entity_id"),
        src.cast("int").alias("src"),
        k.alias("row_pos"),
        F.concat("p_name", F.lit(" "), F.lower("p_type"), ending).alias("business_name"),
        address.alias("business_address"),
        F.when(k % 7 != 0, F.concat(F.lit("C"), (F.length("p_name") % 3).cast("string"))).alias("country"),
        F.xxhash64("p_name", "p_size", "p_type").alias("truth_key"),
    )


def split_sources(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Query side (source 1) and reference side (the others)."""
    return entities.where("src = 1"), entities.where("src in (2, 3)")


def truth_pairs(entities: DataFrame) -> DataFrame:
    """(s1, o) of query and reference rows with equal truth keys."""
    s1, other = split_sources(entities)
    return s1.select(F.col("entity_id").alias("s1"), "truth_key").join(
        other.select(F.col("entity_id").alias("o"), "truth_key"), "truth_key"
    ).select("s1", "o")
