"""Writers: CSV with exact headers, JSON documents, append-only history, numbered batches, state tables.

Spark commits each write as a whole. A single named file, a BOM or CRLF lines need one step on the driver after
the job; they are for exports of bounded size, and every writer can leave a folder of parts instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkforge.functions.text import joined
from linkforge.operators.schema import Schema, validate

CSV = {"header": True, "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "encoding": "UTF-8"}


def flat(df: DataFrame, sep: str = "||") -> DataFrame:
    """All columns as text: NULL is '', arrays of text are joined, other nested values are JSON."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            c = joined(c, sep)
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, headers: list[str] | None = None, sep: str = "||", mode: str = "overwrite") -> None:
    """A folder of CSV parts with the columns in the given order; repeated headers are an error."""
    headers = headers or df.columns
    if len(set(headers)) != len(headers):
        raise ValueError("repeated headers")
    flat(df.select(*headers), sep).write.mode(mode).options(**CSV).csv(path)


def write_single_csv(df: DataFrame, path: str, headers: list[str] | None = None, sep: str = "||", bom: bool = True, crlf: bool = True) -> None:
    """One CSV file of bounded size: written as a folder of one part beside it, then put in place by a rename."""
    spark, folder = df.sparkSession, f"{path}.parts"
    options = CSV | {"lineSep": "\r\n" if crlf else "\n"}
    headers = headers or df.columns
    if len(set(headers)) != len(headers):
        raise ValueError("repeated headers")
    flat(df.select(*headers), sep).coalesce(1).write.mode("overwrite").options(**options).csv(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = parts.getFileSystem(conf)
    part = next(s.getPath() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-"))
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = fs.create(staged, True)
    if bom:
        out.write(bytearray(b"\xef\xbb\xbf"))
    source = fs.open(part)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, True)
    fs.delete(target, False)
    fs.rename(staged, target)
    fs.delete(parts, True)


def write_valid_csv(df: DataFrame, schema: Schema, path: str) -> None:
    """Refuse the whole write if one row is invalid."""
    if not validate(df, schema).where("size(errors) > 0").isEmpty():
        raise ValueError("refusing to write rows with validation failures")
    write_csv(df, path, schema.names)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one document a row; nested columns stay nested."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_history(df: DataFrame, path: str) -> None:
    flat(df).write.mode("append").options(**CSV).csv(path)


def next_number(spark: SparkSession, folder: str, prefix: str = "batch_") -> int:
    """One more than the greatest number among the folder's entries."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return max([int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()], default=0) + 1


def write_batch(df: DataFrame, folder: str, overwrite: int | None = None, confirmed: bool = False) -> str:
    """Write as the next numbered batch, or over an existing one if that is confirmed."""
    if overwrite is not None and not confirmed:
        raise ValueError("overwriting a batch needs confirmation")
    number = overwrite if overwrite is not None else next_number(df.sparkSession, folder)
    path = f"{folder}/batch_{number:03d}"
    df.write.mode("overwrite" if overwrite is not None else "errorifexists").parquet(path)
    return path


def replace_state(df: DataFrame, path: str) -> None:
    """Swap a state table: the new version is written beside the old one, the old one is set aside, the new one
    takes its place. After a crash at any point ``state_table`` finds one whole version."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.next")
    jvm = spark.sparkContext._jvm
    state, new, old = (jvm.org.apache.hadoop.fs.Path(f"{path}{x}") for x in ("", ".next", ".old"))
    fs = state.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(state):
        fs.delete(old, True)
        fs.rename(state, old)
    fs.rename(new, state)
    fs.delete(old, True)


def people_cell(c) -> object:
    """People structs as 'name (role) [0.90]', joined by ' | '."""
    shown = F.transform(c, lambda x: F.concat(x["name"], F.lit(" ("), x["role"], F.lit(") ["), F.format_string("%.2f", F.bround(x["confidence"], 2)), F.lit("]")))
    return joined(shown, " | ")


def write_report(results: DataFrame, folder: str) -> None:
    """Verification outputs: report CSV, results JSON, image manifest (rows with an image), summary."""
    from linkforge.plans.verify import summary

    results = results.cache()
    write_csv(results.drop("images"), f"{folder}/report", sep=" | ")
    write_json(results, f"{folder}/results")
    write_json(results.where("size(images) > 0").select("project_title", "archive_uid", "archive_url", "images"), f"{folder}/image_manifest")
    write_json(summary(results), f"{folder}/summary")
    results.unpersist()


def markdown_table(counts: list[tuple[str, object]], title: str) -> str:
    return "\n".join([f"# {title}", "", "| Field | Value |", "|---|---|", *[f"| {k} | {v} |" for k, v in counts], ""])
