"""Stores of episodes, facts and index state, session transcripts, note folders and the log, as Spark sources and sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from memloom.config import DEFAULT, Config
from memloom.operators import continuity, memory_files
from memloom.operators import messages as M
from memloom.sources import changed, shared

EPISODE = S.StructType().add("uuid", "string", False).add("name", "string").add("labels", S.ArrayType(S.StringType())).add("created_at", "string").add("source", "string").add("source_description", "string").add("content", "string").add("valid_at", "string").add("entity_edges", S.ArrayType(S.StringType())).add("group_id", "string")
#: Folders of a store, outermost first, and its columns with them.
FOLDERS = ["group_id", "day", "batch"]
LAID_OUT = S.StructType([*EPISODE.fields, S.StructField("day", S.StringType()), S.StructField("batch", S.StringType())])
FACT = S.StructType().add("uuid", "string", False).add("name", "string").add("fact", "string").add("valid_at", "string").add("invalid_at", "string").add("created_at", "string").add("expired_at", "string").add("group_id", "string")
STATE = S.StructType().add("path", "string").add("last_modified", "string").add("last_indexed", "string")


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def read(spark: SparkSession, path: str, schema: S.StructType) -> DataFrame:
    """A store's rows; a missing store has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", False).parquet(path).select(*schema.names)


def as_episodes(captured: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Captured rows as stored episodes; the uuid follows from name, time and content, so a repeated write can be told."""
    hexed = F.sha2(F.concat_ws("\x1f", "name", "timestamp", F.sha2("content", 256)), 256)
    dashed = F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    none = F.array().cast("array<string>")
    return captured.select(dashed.alias("uuid"), "name", none.alias("labels"), F.col("timestamp").alias("created_at"), F.lit("message").alias("source"), "source_description", "content", F.col("timestamp").alias("valid_at"), none.alias("entity_edges"), F.lit(config.group).alias("group_id"))


def _laid_out(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumns({"day": F.left("created_at", F.lit(10)), "batch": F.lit(key)})


def append_episodes(captured: DataFrame, path: str, config: Config = DEFAULT) -> None:
    """Captured rows appended as episodes; folders by group, day and batch, as for streams, so both can share a store."""
    _laid_out(as_episodes(captured, config), "appended").write.mode("append").partitionBy(*FOLDERS).parquet(path)


def write_batch(captured: DataFrame, path: str, key: str, config: Config = DEFAULT) -> None:
    """The episodes of one micro-batch under its key; a repeated batch replaces itself, and episodes that other batches have stored stay there.

    An episode's uuid comes with its time, so only the folders of the batch's own days are read to tell what is there.
    """
    rows = _laid_out(as_episodes(captured, config), key)
    if exists(captured.sparkSession, path):
        days = [r[0] for r in rows.select("day").distinct().collect()]  # a micro-batch has one or two
        there = read(captured.sparkSession, path, LAID_OUT).where(F.col("day").isin(days) if days else F.lit(False)).where(F.col("batch") != key)
        rows = rows.join(there.select("uuid", "created_at"), ["uuid", "created_at"], "left_anti").select(*LAID_OUT.names)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(path)


def delete_episodes(spark: SparkSession, path: str, uuids: DataFrame) -> int:
    """Deletes the episodes of uuids (uuid) and gives the number of folders that were written anew: those that hold any of them.

    Finding them reads one column. What stays of these folders is put aside in the shared folder first, then
    takes their place folder by folder; folders of which nothing stays go. One writer at a time.
    """
    if not exists(spark, path):
        return 0
    rows, gone = read(spark, path, LAID_OUT), uuids.select("uuid").distinct()
    hit = rows.select("uuid", *FOLDERS).join(gone, "uuid", "left_semi").groupBy(*FOLDERS).count().collect()  # folders, not rows
    if not hit:
        return 0
    folders = spark.createDataFrame([tuple(r[c] for c in FOLDERS) for r in hit], S.StructType([LAID_OUT[c] for c in FOLDERS]))
    one_of = [F.col(c).isin([*{r[c] for r in hit}]) for c in FOLDERS]  # prunes folders
    held = rows.where(one_of[0] & one_of[1] & one_of[2]).join(F.broadcast(folders), FOLDERS, "left_semi")
    kept = shared.settled(held.join(gone, "uuid", "left_anti").select(*LAID_OUT.names), "kept")
    left = {tuple(r) for r in kept.select(*FOLDERS).distinct().collect()}
    if left:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(path)
    for row in hit:
        key = tuple(row[c] for c in FOLDERS)
        if key not in left:
            files, place = _place(spark, f"{path}/" + "/".join(f"{c}={_escaped(spark, v)}" for c, v in zip(FOLDERS, key, strict=True)))
            files.delete(place, True)
    return len(hit)


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition's value as Spark writes it into a folder's name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def _snapshots(spark: SparkSession, folder: str) -> list[str]:
    files, place = _place(spark, folder)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
    return sorted(n for n in names if exists(spark, f"{folder}/{n}/_SUCCESS"))


def current(spark: SparkSession, folder: str, schema: S.StructType) -> DataFrame:
    """The rows of the newest whole snapshot of a folder; none if there is none."""
    found = _snapshots(spark, folder)
    return read(spark, f"{folder}/{found[-1]}" if found else f"{folder}/none", schema)


def replace(rows: DataFrame, folder: str) -> str:
    """Writes the next snapshot beside the old ones and gives its path; what is being read is never overwritten.

    A snapshot counts once its success mark is there, so a failed write leaves the last one in force. One writer at a time.
    """
    found = _snapshots(rows.sparkSession, folder)
    path = f"{folder}/{int(found[-1]) + 1 if found else 1:012d}"
    rows.write.mode("overwrite").parquet(path)
    return path


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """(session_key, idx, role, content, blocks) from JSONL session files; lines that are no message are passed over.

    Files are read line by line and may be split: lines are ordered by their split's start and their place in it. The
    session key is the file's name without its ending.
    """
    key = F.regexp_extract("_metadata.file_name", r"([^/]+?)(\.[^./]*)?$", 1)
    lines = spark.read.text(path).select(key.alias("session_key"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    return _messages(M.numbered(lines, "idx", F.col("at"), ["row"]))


def _messages(lines: DataFrame) -> DataFrame:
    """(session_key, idx, role, content, blocks) of the lines (session_key, idx, line) that are messages."""
    parsed = lines.withColumn("v", F.try_parse_json("line"))
    get = lambda p, t: F.try_variant_get("v", p, t)
    rows = parsed.where(get("$.type", "string") == "message")
    kind = F.schema_of_variant(F.try_variant_get("v", "$.message.content", "variant"))
    content = F.when(kind == "STRING", get("$.message.content", "string"))
    blocks = F.when(kind.startswith("ARRAY"), get("$.message.content", "array<struct<type string, text string>>"))
    return rows.select("session_key", "idx", get("$.message.role", "string").alias("role"), content.alias("content"), blocks.alias("blocks"))


def _ends(tail_bytes: int):
    """A function of batches (path, length) to (path, idx, line, read): the lines of the last tail_bytes of each file, and how many bytes were read for it."""

    def run(batches):
        for batch in batches:
            for path, length in zip(*(batch.column(c).to_pylist() for c in ("path", "length")), strict=True):
                system, name = changed.opened(path)
                with system.open_input_file(name) as file:
                    file.seek(max(0, length - tail_bytes))
                    raw = file.read(min(length, tail_bytes))
                lines = [x.strip() for x in raw.decode(errors="replace").split("\n")]
                kept = [(i, x) for i, x in enumerate(lines) if x]
                n = len(kept)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([i for i, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.string()), pa.array([len(raw)] * n, pa.int64())], ["path", "idx", "line", "read"])

    return run


def file_ends(spark: SparkSession, path: str, tail_bytes: int = DEFAULT.tail_bytes) -> DataFrame:
    """(path, idx, line, read): the lines of the last bytes of every file, the first of them cut where the bytes begin.

    Spark lists the files and deals them to tasks; each task seeks in its files, so what is read does not grow with them.
    File systems are those that Arrow opens (local, S3, GCS, HDFS); other ones are read whole by `transcript`.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInArrow(_ends(tail_bytes), "path string, idx long, line string, read long")


def transcript_tail(spark: SparkSession, path: str, budget: int = DEFAULT.continuity_budget, tail_bytes: int = DEFAULT.tail_bytes) -> DataFrame:
    """(session_key, text): each session file's newest messages within the budget, from the file's last bytes. Files without any have no row."""
    lines = file_ends(spark, path, tail_bytes)
    rows = _messages(lines.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("session_key"), "idx", "line"))
    kept = F.filter("blocks", lambda b: (b["type"] == "text") & (F.length(b["text"]) > 1))
    text = F.coalesce("content", F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda b: b["text"]), "\n")))
    return continuity.session_tail(rows.select("session_key", "idx", "role", text.alias("content")), budget)


def memory_folder(spark: SparkSession, folder: str, prefix: str = "memory", config: Config = DEFAULT) -> DataFrame:
    """(path, last_modified, size, excerpt) of all files below a folder; too large ones are unreadable."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    system, place = _place(spark, folder)
    root = system.makeQualified(place).toString().rstrip("/")
    name = F.concat(F.lit(f"{prefix}/"), F.expr(f"substring(path, {len(root) + 2})")).alias("path")
    stamp = F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    fits = files.where(F.col("length") <= config.file_max_bytes)
    rows = fits.select(name, stamp.alias("last_modified"), F.col("length").alias("size"), memory_files.excerpt(F.col("content"), config).alias("excerpt"))
    # Of larger files only the names are read.
    large = files.where(F.col("length") > config.file_max_bytes).select(name, *[F.lit(None).cast(t).alias(c) for c, t in (("last_modified", "string"), ("size", "long"), ("excerpt", "string"))])
    return rows.union(large)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of text files as wholes; paths as they are named, what is no UTF-8 as replacement characters."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def append_log(lines: DataFrame, path: str) -> int:
    """Log lines (line) appended as text under the next sequence number, which is returned; two writers never share one.

    The lines of one call are few, and one file; a column `nth` orders them if there is one.
    """
    spark = lines.sparkSession
    rows = lines.orderBy("nth") if "nth" in lines.columns else lines
    number = max(_appends(spark, path), default=0) + 1
    while True:
        try:
            rows.select("line").coalesce(1).write.mode("errorifexists").text(f"{path}/{number:012d}")
            return number
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            number += 1


def _appends(spark: SparkSession, path: str) -> list[int]:
    """The sequence numbers of a log, newest first."""
    files, place = _place(spark, path)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
    return sorted((int(n) for n in names if n.isdigit() and exists(spark, f"{path}/{n}/_SUCCESS")), reverse=True)


def tail_log(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """(seq, nth, line): the n lines that came last, in the order of their arrival whatever their time stamps; none if there is no log."""
    newest = _appends(spark, path)[:n]  # every append has a line
    if not newest:
        return spark.createDataFrame([], "seq long, nth long, line string")
    rows = spark.read.text([f"{path}/{k:012d}" for k in newest])
    seq = F.regexp_extract("_metadata.file_path", r"/(\d{12})/[^/]*$", 1).cast("long")
    rows = rows.select(seq.alias("seq"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line")).where("line != ''")
    return rows.orderBy(F.desc("seq"), F.desc("_at"), F.desc("nth")).limit(n).select("seq", "nth", "line").orderBy("seq", "nth")


def clear_log(spark: SparkSession, path: str) -> None:
    """Removes all lines."""
    files, place = _place(spark, path)
    files.delete(place, True)
