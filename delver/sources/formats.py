"""Readers and writers of the text formats, and tables that flip atomically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tagged(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Documents of `<DOCID>`-style property files: one row a document, one column a property; null, "null" and "(null)" are dropped as values."""
    rows = spark.read.option("lineSep", "<DOCID>").text(path).where(F.trim("value") != "")
    text = F.concat(F.lit("<DOCID>"), F.col("value"))
    pick = lambda n: F.trim(F.regexp_extract(text, rf"(?s)<{n}>(.*?)(?=<[A-Za-z]+>|\z)", 1), F.lit(" \t\r\n"))
    clean = lambda c: F.when(~c.isin("null", "(null)", ""), c)
    return rows.select(*[clean(pick(n)).alias(n.lower()) for n in names])


def valid_share(df: DataFrame, ok: Column, least: float = 0.8) -> DataFrame:
    """One row: share of valid documents and whether it passes the gate."""
    return df.agg(F.avg(ok.cast("double")).alias("share")).withColumn("passes", F.col("share") >= least)


def read_itemsets(spark: SparkSession, path: str, most: int = 99_999) -> DataFrame:
    """(tx_id, item) of lines `id i1 i2 ... 0`; longer sets than `most` are refused."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.element_at(p, 1).cast("long").alias("tx_id"), F.filter(F.slice(p, 2, 2147483646), lambda x: x != "0").alias("items"))
    rows = rows.withColumn("items", F.when(F.size("items") <= most, F.col("items")).otherwise(F.raise_error(F.lit("itemset too long")).cast("array<string>")))
    return rows.select("tx_id", F.explode(F.col("items").cast("array<long>")).alias("item"))


def read_itemsets_binary(spark: SparkSession, path: str, most: int = 99_999) -> DataFrame:
    """(tx_id, item) of files of little-endian (id, size, items...) records of 32-bit integers; truncation is an error that says where."""
    import numpy as np
    import pandas as pd

    def run(frames):  # noqa: ANN001, ANN202
        for f in frames:
            for name, raw in zip(f.path, f.content, strict=True):
                if len(raw) % 4:
                    raise ValueError(f"{name}: truncated integer")
                x, at, out = np.frombuffer(raw, "<u4"), 0, []
                while at < len(x):
                    if at + 2 > len(x):
                        raise ValueError(f"{name}: truncated header")
                    tx, n = int(x[at]), int(x[at + 1])
                    if n > most:
                        raise ValueError(f"{name}: set of {n} items")
                    if at + 2 + n > len(x):
                        raise ValueError(f"{name}: truncated items")
                    out += [(tx, int(v)) for v in x[at + 2 : at + 2 + n]]
                    at += 2 + n
                yield pd.DataFrame(out, columns=["tx_id", "item"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "tx_id long, item long")


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, y, col, val) of lines `y c v c v ...` or `y c:v c:v ...`; row_id orders by file and line."""
    p = F.filter(F.split(F.trim("value"), r"[\s:]+"), lambda x: x != "")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("row_id"), p.alias("p"))
    y = F.element_at("p", 1).cast("double")
    pair = F.expr("transform(sequence(2, size(p) - 1, 2), i -> struct(cast(p[i - 1] as long) as col, cast(p[i] as double) as val))")
    return rows.select("row_id", y.alias("y"), F.explode_outer(F.when(F.size("p") >= 3, pair)).alias("x")).select("row_id", "y", "x.col", "x.val")


def target_range(sparse: DataFrame) -> DataFrame:
    return sparse.agg(F.min("y").alias("low"), F.max("y").alias("high"), F.countDistinct("col").alias("features"))


def write_sparse(sparse: DataFrame, path: str) -> None:
    items = F.array_sort(F.collect_list(F.struct("col", "val")))
    line = F.concat_ws(" ", F.first("y").cast("string"), F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["col"].cast("string"), x["val"].cast("string"))), " "))
    sparse.groupBy("row_id").agg(line.alias("value")).select("value").write.text(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(n, outcome, context) of lines `count outcome k (predicate value)*`."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(p.alias("p"))
    return rows.select(F.element_at("p", 1).cast("long").alias("n"), F.element_at("p", 2).alias("outcome"), F.expr("transform(sequence(4, size(p), 2), i -> p[i - 1])").alias("context"))


def read_char_map(spark: SparkSession, path: str) -> tuple[str, str]:
    """Source and target characters of a `S T` map, as translate() takes them; a few thousand by nature."""
    rows = [r.value.split() for r in spark.read.text(path).collect()]
    rows = [r for r in rows if len(r) == 2 and len(r[0]) == len(r[1]) == 1]
    return "".join(r[0] for r in rows), "".join(r[1] for r in rows)


def redirects(page: DataFrame, redirect: DataFrame) -> DataFrame:
    """(title, target) of page(page_id, page_title) and redirect(rd_from, rd_title)."""
    return page.join(redirect, F.col("page_id") == F.col("rd_from")).select(F.col("page_title").alias("title"), F.col("rd_title").alias("target"))


class Switch:
    """Two versions of a table under one root: readers see the current one while the next is built, then a pointer flips."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self.at = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        return self.spark.read.text(f"{self.root}/CURRENT").first().value if self.fs.exists(self.at) else None

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.current()}")

    def replace(self, df: DataFrame) -> None:
        """Writes df to the version that isn't current, then flips."""
        to = "b" if self.current() == "a" else "a"
        df.write.mode("overwrite").parquet(f"{self.root}/{to}")
        out = self.fs.create(self.at, True)
        out.write(bytearray(to.encode()))
        out.close()


def to_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key columns, json) of whole rows; from_json undoes it."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("json"))


def save_model(model: DataFrame, path: str, kind: str = "parquet") -> None:
    """A model table as Parquet, JSON lines or tab-separated text."""
    w = model.write.mode("errorifexists")
    w.option("sep", "\t").csv(path) if kind == "text" else w.format(kind).save(path)


def load_model(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    r = spark.read.schema(schema)
    return r.option("sep", "\t").csv(path) if kind == "text" else r.format(kind).load(path)


def write_events(events: DataFrame, path: str) -> None:
    """events(n, outcome, context, values) as lines `count outcome k (predicate value)*`."""
    pairs = F.transform(F.arrays_zip("context", "values"), lambda x: F.concat_ws(" ", x["context"], x["values"].cast("string")))
    events.select(F.concat_ws(" ", F.col("n").cast("string"), "outcome", F.size("context").cast("string"), F.array_join(pairs, " ")).alias("value")).write.text(path)


def read_event_values(spark: SparkSession, path: str) -> DataFrame:
    """(n, outcome, context, values): as read_events, with the values."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(p.alias("p"))
    each = lambda start: F.expr(f"transform(filter(sequence({start}, size(p), 2), i -> i <= size(p)), i -> p[i - 1])")
    some = F.size("p") > 3
    none = F.array().cast("array<string>")
    return rows.select(F.element_at("p", 1).cast("long").alias("n"), F.element_at("p", 2).alias("outcome"), F.when(some, each(4)).otherwise(none).alias("context"), F.when(some, each(5)).otherwise(none).cast("array<double>").alias("values"))


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(term) of a list, one a line; `#` begins a comment."""
    t = F.trim(F.regexp_replace("value", "#.*", ""))
    return spark.read.text(path).select(F.lower(t).alias("term")).where("term <> ''").distinct()


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of binary files: three little-endian 32-bit integers (size of a number, rows, dimension), then rows of floats."""
    import numpy as np
    import pandas as pd

    def run(frames):  # noqa: ANN001, ANN202
        for f in frames:
            for name, raw in zip(f.path, f.content, strict=True):
                size, n, dim = np.frombuffer(raw[:12], "<u4").tolist()
                if size != 4 or len(raw) != 12 + 4 * n * dim:
                    raise ValueError(f"{name}: truncated matrix")
                x = np.frombuffer(raw[12:], "<f4").reshape(n, dim)
                for a in range(0, n, 4096):
                    yield pd.DataFrame({"id": range(a, min(a + 4096, n)), "v": [r.tolist() for r in x[a : a + 4096]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "id long, v array<float>")


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rank, nn_id, dist) of lines `query k id distance id distance ...`."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(p.alias("p"))
    pair = F.expr("transform(sequence(3, size(p) - 1, 2), i -> struct(cast(p[i - 1] as long) as nn_id, cast(p[i] as double) as dist))")
    return rows.select(F.element_at("p", 1).cast("long").alias("query_id"), F.posexplode(pair).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.nn_id", "x.dist")


def write_topics(topics: DataFrame, path: str) -> None:
    """topics(topic, start, series) as JSON lines under json, and as day-by-day columns for plotting under dat."""
    topics.select(F.to_json(F.struct("topic", "start", "series")).alias("value")).write.text(f"{path}/json")
    topics.select("topic", F.posexplode("series").alias("day", "freq")).select(F.concat_ws(" ", "topic", F.col("day").cast("string"), F.col("freq").cast("string")).alias("value")).write.text(f"{path}/dat")


def write_split(df: DataFrame, path: str, rows: int) -> None:
    """Parquet files of at most `rows` rows."""
    df.write.option("maxRecordsPerFile", rows).parquet(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of the pages of an XML dump."""
    rows = spark.read.option("lineSep", "</page>").text(path).where(F.col("value").contains("<title>"))
    pick = lambda tag: F.regexp_extract("value", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return rows.select(pick("title").alias("title"), pick("text").alias("text"))
