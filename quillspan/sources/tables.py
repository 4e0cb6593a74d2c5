"""Scans. Paths go to Spark as they are, so any store that it reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; one of this machine only where Spark runs on it alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import atexit
        import shutil
        import tempfile

        named = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quillspan-"))
        atexit.register(shutil.rmtree, named, True)
    return named.rstrip("/")


_OWN: dict[str, str] = {}


def nested_qa(spark: SparkSession, path: str) -> DataFrame:
    """qid, question, answers … of ``data[].qas[]`` JSON; a reused id gets #n."""
    schema = "data array<struct<passage_id:string,context:string,title:string,qas:array<struct<question_id:string,question_text:string,is_answerable:string,question_type:string,answers:struct<answer_text:array<string>,answer_type:array<string>>>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    p = raw.select(F.posexplode("data").alias("i", "p")).select("i", "p.*").select("i", "passage_id", "context", "title", F.posexplode("qas").alias("j", "q"))
    q = p.select("i", "j", "passage_id", "context", "title", "q.*")
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy("i", "j"))
    return q.withColumn("n", nth).select(
        F.when(F.col("n") > 1, F.concat_ws("#", "question_id", F.col("n").cast("string"))).otherwise(F.col("question_id")).alias("qid"), F.col("question_id").alias("source_qid"),
        "question_text", F.lower("is_answerable").isin("true", "1", "yes").alias("is_answerable"), "question_type", "passage_id", "context", "title", "answers",
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with ``_bad``: the line where it does not parse."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def csv_column(spark: SparkSession, path: str, column: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(column)
    return rows.limit(limit) if limit else rows


def verified_files(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """path, digest, ok of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"), (F.sha2("content", 256) == sha256).alias("ok"))


def refused_unless(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """path, digest of binary files; reading it fails where a digest is another."""
    f = verified_files(spark, path, sha256)
    return f.select("path", F.when(F.col("ok"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("sha256 mismatch: "), "path", F.lit(" has "), "digest"))).alias("digest"))


def zipped_lines(spark: SparkSession, path: str, schema: str, member: str = r"\.jsonl$") -> DataFrame:
    """archive, member, line (number), bad, row: the JSON lines of the members that match, blank ones left out. An archive
    is one task's work, its members are read in turn as streams; lines that do not parse have bad set."""

    def lines(batches):
        import io
        import re
        import zipfile

        import pandas as pd

        for b in batches:
            for archive, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if re.search(member, name):
                            with z.open(name) as f:
                                while chunk := f.readlines(1 << 20):
                                    rows = [(archive, name, x.decode("utf-8", "replace").strip()) for x in chunk]
                                    yield pd.DataFrame([r for r in rows if r[2]], columns=["archive", "member", "raw"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "archive string, member string, raw string")
    row = F.from_json("raw", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return raw.select("archive", "member", row.alias("row")).withColumn("bad", F.col("row._bad").isNotNull() | F.col("row").isNull())


def folder_grade(member, classes: dict[str, int]):
    """The grade that the member's folder names, from a map of folder names; null for others."""
    first = F.regexp_extract(member, r"(?:^|/)([^/]+)/[^/]*$", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), first)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, config_hash: str, seed: int) -> None:
    """CSV with the hash of the settings and the seed on every row."""
    df.withColumns({"config_hash": F.lit(config_hash), "seed": F.lit(seed)}).write.mode("overwrite").option("header", True).csv(path)


def suffix_tiers(spark: SparkSession, path: str) -> DataFrame:
    """tier, suffix, line of a text of ``[tier]`` headers and suffixes below them; # starts a comment. One small file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "raw")).select("line", F.trim(F.regexp_replace("raw", "#.*", "")).alias("s")).filter("s <> ''")
    head = F.regexp_extract("s", r"^\[(.+)\]$", 1)
    tier = F.last(F.when(head != "", head), ignorenulls=True).over(Window.orderBy("line"))  # a lexicon, not a corpus
    return rows.select("line", "s", head.alias("h"), tier.alias("tier")).filter("h = ''").select("tier", F.col("s").alias("suffix"), "line")


def index_scan(manifest: DataFrame, passages: DataFrame, size: int) -> DataFrame:
    """The passages of an index in its order; manifest: size, pid, pos."""
    return manifest.filter(F.col("size") == size).select("pid", "pos").join(passages, "pid").orderBy("pos")


def query_set(queries: DataFrame, split: str, limit: int | None = None, answerable_only: bool = True) -> DataFrame:
    q = queries.filter(F.col("split") == split)
    q = q.filter("is_answerable") if answerable_only else q
    return q.orderBy("qid").limit(limit) if limit else q


def save_model(model, path: str, features: list[str]) -> None:
    """A fitted pipeline model and the names of what it was fitted on."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(i, f) for i, f in enumerate(features)], "i int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str, features: list[str]):
    """The model; refused if it was fitted on other features or on these in another order."""
    from pyspark.ml import PipelineModel

    held = [r.feature for r in spark.read.parquet(f"{path}/features").orderBy("i").collect()]  # a few names
    if held != features:
        raise ValueError(f"model at {path} was fitted on {held}, not on {features}")
    return PipelineModel.load(f"{path}/model")


def log_result(spark: SparkSession, path: str, section: str, key: str, payload: dict, config_hash: str, seed: int) -> None:
    """Append a result row; latest_results reads the last of each key."""
    import json
    import time

    row = [(section, key, json.dumps(payload, sort_keys=True, ensure_ascii=False), config_hash, seed, time.time())]
    spark.createDataFrame(row, "section string, key string, payload string, config_hash string, seed int, written_at double").coalesce(1).write.mode("append").parquet(path)


def latest_results(ledger: DataFrame) -> DataFrame:
    others = ["payload", "config_hash", "seed"]
    last = ledger.groupBy("section", "key").agg(F.max(F.struct("written_at", *others)).alias("r"))
    return last.select("section", "key", *[f"r.{c}" for c in others])


def stale_results(ledger: DataFrame, config_hash: str) -> DataFrame:
    """section, key of the results of another configuration."""
    return latest_results(ledger).filter(F.col("config_hash") != config_hash).select("section", "key")


def pruned_results(ledger: DataFrame, config_hash: str) -> DataFrame:
    """The results without stale ones, to be written elsewhere or in place of a ledger that is read no more."""
    return latest_results(ledger).filter(F.col("config_hash") == config_hash)


def write_receipts(receipts: DataFrame, path: str) -> None:
    """One JSON line a receipt, with a name for it in which no # stands."""
    receipts.withColumn("name", F.replace(F.col("qid").cast("string"), F.lit("#"), F.lit("_dup"))).write.mode("overwrite").json(path)


def counted_rows(ledger: DataFrame, counts: DataFrame) -> DataFrame:
    """The provenance ledger (name, …, rows) with new row counts; counts: name, rows."""
    return ledger.join(counts.select("name", F.col("rows").alias("_r")), "name", "left").withColumn("rows", F.coalesce("_r", "rows")).drop("_r")


def latest_by_name(ledger: DataFrame, name: str = "name", at: str = "written_at") -> DataFrame:
    """The last row of each name: the state of an append-only ledger."""
    others = [c for c in ledger.columns if c not in (name, at)]
    last = ledger.groupBy(name).agg(F.max(F.struct(at, *others)).alias("r"))
    return last.select(name, "r.*")
