"""Reading and writing: tables, page text, product JSON, sessions and the job log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_UPLOAD, MOST_JSON, MOST_PRODUCTS = 30 << 20, 10 << 20, 5000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def select(df: DataFrame, columns: list[str] | None = None, limit: int | None = None, **equal) -> DataFrame:
    """Rows where each of equal holds, pruned to columns; filters and columns reach the scan."""
    for k, v in equal.items():
        df = df.filter(F.col(k) == v)
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit is not None else df


def append(df: DataFrame, path: str) -> DataFrame:
    """Appends and returns what was appended."""
    df.write.mode("append").parquet(path)
    return df


def update(df: DataFrame, condition, **values) -> tuple[DataFrame, DataFrame]:
    """A new snapshot with values set where condition holds, and the rows that it changed, as they are now."""
    hit = F.coalesce(condition, F.lit(False))
    new = {k: F.lit(v) for k, v in values.items()}
    return df.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}), df.filter(hit).withColumns(new)


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """Pages from text files, a form feed between pages; doc_id is the file's path."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_name").alias("file_name"), "value")
    return whole.select("doc_id", "file_name", F.posexplode(F.split("value", "\f")).alias("page_ord", "text")).withColumn("page_number", F.col("page_ord") + 1)


def uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files within the size limit, and the others with a reason; contents aren't read. Spark's listing has no empty files,
    so these are in neither."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    judged = files.withColumn("reason", F.when(F.col("length") > MOST_UPLOAD, "file too large"))
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def product_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """import_id (the file's path) and json text of files within the size limit, and (import_id, message) of the others."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("import_id"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("json"))
    large = whole.filter(F.col("size") > MOST_JSON).select("import_id", F.lit("Product payload exceeds the 10 MB import limit.").alias("message"))
    return whole.filter(F.col("size") <= MOST_JSON).select("import_id", "json"), large


def import_guard(products: DataFrame, confirmed: bool, content_type: str = "application/json", content_length: int = 0) -> str | None:
    """Why an import may not run, or None. Size, type, confirmation and number are tested in this order."""
    if content_length > MOST_JSON:
        return "Product payload exceeds the 10 MB import limit."
    if "application/json" not in content_type:
        return "Preview the JSON products before saving them for review."
    n = products.limit(MOST_PRODUCTS + 1).count() if confirmed else 0
    if not n:
        return "At least one confirmed product is required."
    return f"A maximum of {MOST_PRODUCTS} products can be queued at once." if n > MOST_PRODUCTS else None


def save_session(df: DataFrame, path: str, session_id: str) -> None:
    """Replaces the session's rows and leaves other sessions alone."""
    df.withColumn("upload_session_id", F.lit(session_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_session_id").parquet(path)


def load_session(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("upload_session_id") == session_id)


def reset_session(spark: SparkSession, path: str, session_id: str, to: str) -> DataFrame:
    """Writes the sessions under path but this one to another folder, so that readers of the old one see no half state."""
    others = spark.read.parquet(path).filter(F.col("upload_session_id") != session_id)
    others.write.mode("overwrite").partitionBy("upload_session_id").parquet(to)
    return others


def active_documents(documents: DataFrame) -> DataFrame:
    """Documents that can be shown: with a session, a file name and a result, and with all three lists, be they empty."""
    named = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("upload_session_id", "file_name")]
    there = [F.col(c).isNotNull() for c in ("extraction_result", "material_list", "product_matches", "missing_products")]
    return documents.filter(reduce(lambda a, b: a & b, named + there))


JOB_COLUMNS = ("file_name", "status", "total_records", "imported_records", "failed_records", "error_message")


def job_rows(summary: DataFrame, file_name: str, import_type: str) -> DataFrame:
    """An import's summary as a row of the job log."""
    name = F.left(F.lit(file_name), F.lit(255)).alias("file_name")
    return summary.select(F.uuid().alias("id"), name, F.lit(import_type).alias("import_type"), "status", F.col("total").alias("total_records"), F.col("queued").alias("imported_records"), F.col("failed").alias("failed_records"), "error_message", F.current_timestamp().alias("created_at"))


def log_job(summary: DataFrame, path: str, file_name: str, import_type: str = "json_review_queue", write=append) -> str | None:
    """Appends an import's summary to the job log, of fewer columns if that fails; returns the last error's text instead of
    raising it, as the log must not fail the import."""
    whole = job_rows(summary, file_name, import_type)
    last = None
    for row in (whole, whole.select(*JOB_COLUMNS)):
        try:
            write(row, path)
            return None
        except Exception as error:
            last = error
    return f"extraction_jobs logging failed: {last}"
