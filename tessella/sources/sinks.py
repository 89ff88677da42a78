"""Sinks: JSON lines, and idempotent upserts of chunks into partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def json_lines(df: DataFrame, order: str) -> DataFrame:
    """(value): one JSON object for each row, in order; null fields are left out."""
    return df.orderBy(order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("value"))


def write_json_lines(df: DataFrame, order: str, path: str) -> None:
    json_lines(df, order).write.mode("overwrite").text(path)


def merged(old: DataFrame, new: DataFrame, key: str, seq: Column) -> DataFrame:
    """All rows of ``old`` whose key ``new`` lacks, and the last row of each key of ``new``. Doing it twice changes nothing."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(seq.desc()))).filter("_n = 1").drop("_n")
    return old.join(last, key, "left_anti").unionByName(last)


def write_partitions(df: DataFrame, by: str, path: str) -> None:
    """Overwrite only the partitions (knowledge bases) that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def workbooks(df: DataFrame, by: str, sheets: dict[str, list[str]], order: str) -> DataFrame:
    """(by, content): an .xlsx workbook for each value of a column, whose sheets have the columns named, as text, rows in order.
    A workbook's rows meet in one task, as they are one file."""
    import pandas as pd

    from tessella.sources.readers import workbook

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_order")
        return pd.DataFrame({by: [rows[by].iloc[0]], "content": [workbook({name: rows[columns].to_numpy().tolist() for name, columns in sheets.items()})]})

    texts = sorted({c for columns in sheets.values() for c in columns})
    named = df.select(F.col(by), F.col(order).alias("_order"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in texts))
    return named.groupBy(by).applyInPandas(run, f"`{by}` {df.schema[by].dataType.simpleString()}, content binary")


def index_embeddings(chunks: DataFrame, table: str, model: str, buckets: int = 32, size: int = 200) -> int:
    """Bring a catalog table (id, hash, embedding) up to date with ``chunks`` (id, text), and give the number of chunks embedded:
    those that are new or whose text has changed, in batches of ``size``. The table is bucketed by id, so that neither this
    nor a later join by id shuffles it; unchanged rows are taken over as they are, and chunks that are not named stay.

    Of chunks that share an id the text with the least hash counts; those without an id are left out. Each version is a table of
    its own that ``table``, a view, is switched to once it is whole: a run that is cut off changes nothing, and one without
    changes writes nothing."""
    from tessella.operators.models import applied
    from tessella.session import materialise, new_path, release

    spark = chunks.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    own = chunks.filter("id is not null").groupBy("id").agg(F.min(F.struct(F.sha2(text, 256).alias("hash"), text.alias("text"))).alias("c")).select("id", "c.hash", "c.text")
    there = spark.catalog.tableExists(table)
    if there:
        changed = own.join(spark.table(table).select("id", F.col("hash").alias("old")), "id", "left").filter("old is null or old <> hash").select("id", "hash", "text")
    else:
        changed = own
    new = materialise(applied(changed, model, "text", "embedding", "array<double>", size).select("id", "hash", "embedding"), "embedded")
    n = new.count()
    if n or not there:
        rows = new
        if there:
            fresh = new.select("id", F.struct("hash", "embedding").alias("n"))
            now = F.coalesce("n", F.struct("hash", "embedding"))
            rows = spark.table(table).join(fresh, "id", "full").select("id", now.alias("c")).select("id", "c.hash", "c.embedding")
        path = new_path(spark, "embeddings")
        version = f"{table}_{path.rsplit('-', 1)[-1]}"
        rows.write.bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(version)
        spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {version}")
    release(new)
    return n
