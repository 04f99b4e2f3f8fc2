"""Readers and writers: manifests, prediction logs, annotation trees, batch requests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def find_files(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """Path, size and time of files below a folder; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).drop("content")


def find_kinds(spark: SparkSession, folder: str, kinds: Sequence[str] = ("mp4", "avi", "mkv")) -> DataFrame:
    """Files below a folder whose names end in one of ``kinds``, in any case, in the order of their paths."""
    ends = "|".join(k.lower() for k in kinds)
    return find_files(spark, folder, "*").where(F.lower("path").rlike(rf"\.({ends})$")).orderBy("path")


def wanted_files(found: DataFrame, least_mb: float = 0, most_mb: float = 0, main_only: bool = False, limit: int = 0) -> DataFrame:
    """Files (``path``, ``length``) within limits of size, of the main cameras alone if asked, the first of them by path.

    A limit of 0 is none; both limits of size are included.
    """
    mb = F.col("length") / (1024 * 1024)
    kept = found
    if main_only:
        kept = kept.where(F.element_at(F.split("path", "/"), -1).contains("_main_"))
    if most_mb > 0:
        kept = kept.where(mb <= most_mb)
    if least_mb > 0:
        kept = kept.where(mb >= least_mb)
    return kept.orderBy("path").limit(limit) if limit > 0 else kept


def id_list(rows: DataFrame, text: str, name: str = "clip_id") -> DataFrame:
    """The distinct ids of JSON lists; null ids and damaged lists give none."""
    ids = F.explode(F.from_json(text, "array<string>"))
    return rows.select(ids.alias(name)).where(F.col(name).isNotNull()).distinct()


def write_sheets(df: DataFrame, path: str, by: str) -> None:
    """One folder of CSV files for each value of ``by``."""
    df.write.mode("overwrite").option("header", True).partitionBy(by).csv(path)


def append_manifest(df: DataFrame, path: str) -> None:
    """Rows added to a CSV manifest; every part has the header."""
    df.write.mode("append").option("header", True).csv(path)


def write_split(df: DataFrame, good: Column, path: str) -> tuple[str, str]:
    """Rows that pass to ``path/valid``, all others, null verdicts too, to ``path/quarantine``; gives both paths."""
    ok = F.coalesce(good, F.lit(False))
    paths = f"{path}/valid", f"{path}/quarantine"
    for where, rows in zip(paths, (df.where(ok), df.where(~ok))):
        rows.write.mode("overwrite").parquet(where)
    return paths


def data_url(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def object_url(root: str, *parts: Column) -> Column:
    """An address below ``root``, its parts escaped."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), *(F.url_encode(p) for p in parts))


def read_manifest(spark: SparkSession, path: str, numbers: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV manifest. Named columns become doubles, null where they don't parse; with ``columns``, a missing file is empty."""
    if columns is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.createDataFrame([], T.StructType([T.StructField(c, T.DoubleType() if c in numbers else T.StringType()) for c in columns]))
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({c: F.col(c).try_cast("double") for c in numbers}) if numbers else df


def read_predictions(spark: SparkSession, path: str, schema: str, key: str = "clip_id", strict: bool = False) -> DataFrame:
    """The last successful record of each key in JSON lines; blank and damaged lines are skipped, unless ``strict``."""
    lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
    return last_success(lines, "value", schema, key, ["_file", "_at"], strict)


def last_success(lines: DataFrame, text: str, schema: str, key: str, order: Sequence[str], strict: bool = False) -> DataFrame:
    """As ``read_predictions``, for lines that are already rows with an order."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    parsed = lines.where(F.trim(text) != "").withColumn("_r", F.from_json(text, f"{schema}, _bad string", {"mode": mode, **({} if strict else {"columnNameOfCorruptRecord": "_bad"})}))
    good = parsed.where(F.col("_r._bad").isNull() & F.col("_r.success")).select(*order, "_r.*").drop("_bad")
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return good.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place", *order)


def read_annotation_tree(spark: SparkSession, folder: str, schema: str, active: Sequence[str] | None = None, lines: bool = False) -> DataFrame:
    """JSON documents at ``folder/<annotator>/<clip>.json``, one a file or, with ``lines``, one a line; hidden folders are
    left out, and annotators not ``active``."""
    df = spark.read.schema(schema).option("multiLine", not lines).json(f"{folder}/*/*.json")
    df = df.withColumn("annotator_id", F.element_at(F.split("_metadata.file_path", "/"), -2))
    df = df.where(~F.col("annotator_id").startswith("."))
    return df.where(F.col("annotator_id").isin(*active)) if active is not None else df


def frame_counts(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """(folder, n) of frame files."""
    return find_files(spark, folder, pattern).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def with_frames(clips: DataFrame, counts: DataFrame, key: str, wanted: int = 8, least: int = 2) -> DataFrame:
    """Clips with ``frames`` (0 without a folder), whether these are ``complete``, and whether there are enough to be ``usable``.
    ``counts`` is (folder, n), a folder being named by its clip."""
    n = F.coalesce("n", F.lit(0).cast("long"))
    named = counts.select(F.element_at(F.split("folder", "/"), -1).alias("_clip"), "n")
    found = clips.join(named, F.col(key).cast("string") == F.col("_clip"), "left").withColumn("frames", n).drop("_clip", "n")
    return found.withColumn("complete", F.col("frames") == wanted).withColumn("usable", F.col("frames") >= least)


def write_tiers(df: DataFrame, path: str, tier: str = "tier") -> None:
    """CSV by tier; arrays are joined with commas and private columns (``_...``) are left out."""
    kinds = dict(df.dtypes)
    out = df.select(*(F.concat_ws(",", c).alias(c) if kinds[c].startswith("array") else F.col(c) for c in df.columns if not c.startswith("_")))
    out.write.mode("overwrite").option("header", True).partitionBy(tier).csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with values of ``changes`` where these have any; write the result to a new path and swap."""
    cols = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in cols))
    return rows.join(renamed, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in cols}).drop(*(f"_new_{c}" for c in cols))


#: Forms in which services take batches of requests, by the fields that they name.
FORMS = ("plain", "chat", "params", "record")


def batch_requests(rows: DataFrame, key: str, model: str, frames: int, prompt: str, form: str = "plain") -> DataFrame:
    """(custom_id, request): a JSON request for each row, with the addresses of its frames.

    ``plain`` has a flat body; ``chat`` a body with messages of text and image parts and the address of the call; ``params``
    and ``record`` hold the same messages as parameters of a named request or as the input of a record.
    """
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}")
    images = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: F.concat(F.col(key).cast("string"), F.lit("/frame_"), F.lpad(i.cast("string"), 2, "0"), F.lit(".jpg")))
    safe = F.substring(F.regexp_replace(F.col(key).cast("string"), "[^a-zA-Z0-9_-]", "_"), 1, 64)
    if form == "plain":
        request = F.to_json(F.struct(safe.alias("custom_id"), F.lit("POST").alias("method"), F.struct(F.lit(model).alias("model"), F.lit(prompt).alias("prompt"), images.alias("images")).alias("body")))
        return rows.select(safe.alias("custom_id"), request.alias("request"))
    texts = F.to_json(F.struct(F.lit("text").alias("type"), F.lit(prompt).alias("text")))
    pictures = F.transform(images, lambda u: F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(u.alias("url")).alias("image_url"))))
    body = F.concat(F.lit('{"model":"'), F.lit(model), F.lit('","messages":[{"role":"user","content":['), F.array_join(F.concat(F.array(texts), pictures), ","), F.lit("]}]}"))
    head = {
        "chat": F.concat(F.lit('{"custom_id":"'), safe, F.lit('","method":"POST","url":"/v1/chat/completions","body":')),
        "params": F.concat(F.lit('{"custom_id":"'), safe, F.lit('","params":')),
        "record": F.concat(F.lit('{"recordId":"'), safe, F.lit('","modelInput":')),
    }[form]
    return rows.select(safe.alias("custom_id"), F.concat(head, body, F.lit("}")).alias("request"))


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Replace a Parquet table by what a function makes of it: written beside it, then put in its place by renaming.

    Until the old table has been moved aside it can be read; if a run ends between the two renames, it is at ``path.old``.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    here, new, old = (fs_path(p) for p in (path, f"{path}.new", f"{path}.old"))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(here) and fs.exists(old):
        fs.rename(old, here)
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if not (fs.rename(here, old) and fs.rename(new, here)):
        raise OSError(f"{path} couldn't be replaced; the old table is at {path}.old")
    fs.delete(old, True)


def batch_results(results: DataFrame, ids: DataFrame, key: str = "clip_id") -> DataFrame:
    """Results with their key: by custom id, or that id itself where the map has none."""
    return results.join(ids, "custom_id", "left").withColumn(key, F.coalesce(key, "custom_id"))
