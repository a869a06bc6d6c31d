"""Scans: files to canonical, ordered event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions.scalar import number
from causeway.sources.shared import discard, materialize
from causeway.spec import DAY


def read(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet table, just the columns asked for; raises if the path is missing."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Rows of a key and two short columns that may be sent to every task.
SENT = 1_500_000


def few(df: DataFrame) -> DataFrame:
    """``df`` to be sent to every task of a join, where its files hold at most ``SENT`` rows."""
    return F.broadcast(df) if df.count() <= SENT else df


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str | None = None, required: list[str] = (), max_rows: int | None = None) -> DataFrame:
    """A CSV with a header, under a declared schema or as text; ``max_rows`` is taken before any sort."""
    given = spark.read.csv(path, header=True)
    require(given, list(required))
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False) if schema else given
    return df.limit(max_rows) if max_rows is not None else df


def coerced(df: DataFrame, numbers: list[str], zero: list[str] = ()) -> DataFrame:
    """Columns as numbers: what is none is null, or 0 for those of ``zero`` (a time that cannot be read sorts first)."""
    return df.withColumns({c: number(df, c, 0.0 if c in zero else None) for c in dict.fromkeys([*numbers, *zero])})


def glob_results(spark: SparkSession, pattern: str, kind: str = "csv", window: str = r"window_([0-9]+)") -> DataFrame:
    """All small result files that match a path pattern, with ``window`` read from the path; no file, an error that says so."""
    df = spark.read.csv(pattern, header=True, inferSchema=True) if kind == "csv" else spark.read.json(pattern, multiLine=True)
    return df.withColumn("window", F.regexp_extract(F.col("_metadata.file_path"), window, 1).cast("int"))


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join that raises if ``key`` repeats on either side."""
    for name, side in (("left", left), ("right", right)):
        if side.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} is not unique on the {name} side")
    return left.join(right, key, "left")


def with_row_order(df: DataFrame, time: str, ties: list[str], out: str = "row_ord", bucket: int = DAY, part: int = 0, parts: int = 1) -> DataFrame:
    """Adds the 1-based rank by ``time`` then ``ties`` without a sort in one task.

    Rows are counted by time bucket; a bucket's rows are ranked in one partition each and
    shifted by the rows of the buckets before, a table of one row for each bucket.  Of several ``parts``, to which
    buckets are dealt in turn, only one is given back; ranks are those of the whole table.
    """
    df = df.withColumn("__bucket", F.floor(F.col(time) / bucket))
    counts = df.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(time, *ties))
    if parts > 1:
        df = df.where(F.pmod("__bucket", F.lit(parts)) == part)
    return df.join(shift, "__bucket").withColumn(out, (F.col("__shift") + inside).cast("long")).drop("__bucket", "__shift")


def with_number(df: DataFrame, column: str, out: str, buckets: int = 1024) -> DataFrame:
    """Adds a dense number, from 0, for each distinct value of a column, the same for any partitioning; null stays null.

    Values are dealt to buckets by hash and numbered in each; a bucket starts where those before end, a table of a row for each.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("__v")).distinct().withColumn("__b", F.pmod(F.xxhash64("__v"), F.lit(buckets)))
    counts = values.groupBy("__b").agg(F.count("*").alias("__n"))
    shift = counts.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__v")) - 1
    numbers = values.join(F.broadcast(shift), "__b").select("__v", (F.col("__s") + inside).alias(out))  # at most ``buckets`` rows
    return df.join(numbers, F.col(column) == F.col("__v"), "left").drop("__v")


def chronological_split(df: DataFrame, order: str = "row_ord", train: float = 0.6, valid: float = 0.2, n: int | None = None, out: str = "split") -> DataFrame:
    """``train``, ``valid`` or ``test`` by rank, with floors as bounds; ``n`` is counted if not given."""
    n = df.count() if n is None else n
    a, b = int(n * train), int(n * (train + valid))
    at = F.col(order) - 1
    return df.withColumn(out, F.when(at < a, "train").when(at < b, "valid").otherwise("test"))


def with_window(df: DataFrame, size: int, order: str = "row_ord", out: str = "window") -> DataFrame:
    """Windows of ``size`` rows that later state treats as independent."""
    return df.withColumn(out, F.floor((F.col(order) - 1) / size).cast("long"))


def step_split(step: Column, train_to: int = 30, valid_to: int = 40) -> Column:
    return F.when(step <= train_to, "train").when(step <= valid_to, "valid").otherwise("test")


#: Lines that are joined and ranked by one shuffle each; more go in ``PARTS``, whose shuffles are not on disk together.
AT_ONCE, PARTS = 2_000_000, 4


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line-item event table: who bought which brand from whom, when, and whether it came back.

    The joined lines are written once: counting days and ranking within them read them again, and the shuffles of the joins go.
    Of more than ``AT_ONCE`` lines orders are joined and days ranked in parts, and the ranked lines are written, too.
    ``shared.discard`` deletes what was written once the result is not read any more.
    """
    li = read(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"])
    li = li.select(
        *["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_linestatus"],
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("t"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
    od = read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    cu = few(read(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"]))
    pa = few(read(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_size"]))
    od = od.join(cu, od.o_custkey == cu.c_custkey).select("o_orderkey", "o_custkey", "c_mktsegment")
    parts = 1 if li.count() <= AT_ONCE else PARTS
    mine = lambda df, c, k: df.where(F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(parts)) == k) if parts > 1 else df
    joined = []
    for k in range(parts):
        x, y = mine(li, "l_orderkey", k), mine(od, "o_orderkey", k)
        joined.append(x.join(y, x.l_orderkey == y.o_orderkey).join(pa, x.l_partkey == pa.p_partkey).drop("o_orderkey", "p_partkey"))
    written = materialize(joined[0], "lines", *joined[1:])
    ranked = [with_row_order(written, "t", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], part=k, parts=parts) for k in range(parts)]
    df = ranked[0]
    if parts > 1:
        df = materialize(ranked[0], "ranked", *ranked[1:])
        discard(written)
        written = df
    out = df.select(
        "row_ord",
        F.col("row_ord").alias("tx_id"),
        "t",
        F.col("l_extendedprice").alias("amount"),
        "label",
        F.col("o_custkey").alias("cust"),
        F.col("l_suppkey").alias("supp"),
        F.nullif(F.col("p_brand"), F.lit("Brand#11")).alias("brand"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
        F.col("l_linestatus").alias("status"),
        F.col("p_size").alias("size"),
    )
    out._causeway_path = written._causeway_path
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a table, times in microseconds."""
    ev = read(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    ev = ev.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    ev = with_row_order(ev, "t", ["event_id"], bucket=DAY * 1_000_000)
    return ev.select(
        "row_ord",
        F.col("event_id").alias("tx_id"),
        "t",
        F.col("value").alias("amount"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").alias("k"),
    )


def bipartite(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as an address graph: ``(tx, step, cls)`` and the distinct ``(tx, address)`` of inputs and outputs."""
    od = read(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate", "o_orderstatus"])
    months = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    first = od.agg(F.min(months)).first()[0]
    tx = od.select(
        F.col("o_orderkey").alias("tx"),
        (months - F.lit(first) + 1).cast("int").alias("step"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("cls"),
    )
    li = read(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_partkey"])
    ins = li.select(F.col("l_orderkey").alias("tx"), F.concat(F.lit("s"), "l_suppkey").alias("address")).distinct()
    outs = li.select(F.col("l_orderkey").alias("tx"), F.concat(F.lit("p"), "l_partkey").alias("address")).distinct()
    return tx, ins, outs


def address_files(spark: SparkSession, transactions: str, actors: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(tx, ins, outs, features)`` of an address graph in four CSV files with the published names and columns.

    ``tx`` is ``(tx, step, cls)``, a transaction without a class unknown (3); edges whose transaction is not in
    the features are dropped, repeated ones count once.
    """
    features = read_csv(spark, f"{transactions}/txs_features.csv", required=["txId", "Time step"])
    classes = read_csv(spark, f"{transactions}/txs_classes.csv", required=["txId", "class"])
    numbers = [c for c in features.columns if c not in ("txId", "Time step")]
    features = coerced(features, numbers).withColumns({"txId": F.col("txId").cast("bigint"), "Time step": F.col("`Time step`").cast("int")})
    cls = classes.select(F.col("txId").cast("bigint").alias("tx"), F.col("class").try_cast("int").alias("cls"))
    tx = features.select(F.col("txId").alias("tx"), F.col("`Time step`").alias("step")).join(cls, "tx", "left").withColumn("cls", F.coalesce("cls", F.lit(3)))
    side = lambda name, column: read_csv(spark, f"{actors}/{name}.csv", required=["txId", column]).select(F.col("txId").cast("bigint").alias("tx"), F.col(column).alias("address")).distinct().join(tx.select("tx"), "tx", "left_semi")
    return tx, side("AddrTx_edgelist", "input_address"), side("TxAddr_edgelist", "output_address"), features.withColumnRenamed("txId", "tx").withColumnRenamed("Time step", "step")
