"""The star-schema tables seen as works, payments, verifications and versions, so that every operator has input."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import canonical, duplicates, hazard, models, peers, planting, signals
from .sources.tables import settled, stored

PEER_LEVELS = [["activity_category", "state_name"], ["activity_category"], ["state_name"]]
MIN_PEERS = 120
HORIZON = 2_400  # days; works of these tables take years


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a work: its customer's nation the state, nation and segment the agency, its lines the stages."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    records = placed.select(
        F.col("o_orderkey").alias("serial"), F.concat(F.lit("MP"), "o_custkey", F.lit("-W"), "o_orderkey").alias("work_ref"), F.col("o_custkey").alias("mp_id"),
        F.col("n_name").alias("state_name"), F.concat("n_name", F.lit("/"), "c_mktsegment").alias("implementing_agency"), F.col("o_orderpriority").alias("activity_category"),
        F.col("o_totalprice").alias("recommended_amount"), F.col("o_orderdate").cast("date").alias("recommendation_date"), F.col("o_orderstatus").alias("status"),
    )
    last = F.max_by(F.struct(F.col("l_shipdate").cast("date").alias("day"), F.col("l_extendedprice").alias("amount")), F.struct("l_shipdate", "l_linenumber", "l_extendedprice"))
    known = stored(lines.groupBy(F.col("l_orderkey").alias("serial")).agg(F.bool_or(F.col("l_linestatus") == "F").alias("is_sanctioned"), last.alias("last")))  # the lines are read once
    stages = known.select("serial", "is_sanctioned")
    finished = known.join(orders.where("o_orderstatus = 'F'"), F.col("serial") == F.col("o_orderkey"), "left_semi")
    completions = finished.select("serial", F.col("last.day").alias("completion_date"), F.col("last.amount").alias("actual_amount"))
    known = known.select("serial", F.lit(True).alias("_line"))
    out = canonical.assembled(records, records, stages, completions, "serial").join(known, "serial", "left")
    text = F.when(F.col("_line"), F.concat_ws(" ", "activity_category", "implementing_agency"))
    return out.withColumns({"is_orphan": F.col("_line").isNull(), "work_description": text}).drop("_line")


#: Frames that many queries start from, by session, name and the state of the tables they were made of.
_kept: dict[tuple, tuple[str, DataFrame]] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The result of ``build``, stored once in a session while neither the tables under it nor its own folder change."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    state = []
    for t in ("orders", "lineitem", "customer", "nation", "documents"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            state.append((t, fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
    key = (spark.sparkContext.applicationId, sf_dir, name, tuple(state))
    if key in _kept:
        folder = jvm.org.apache.hadoop.fs.Path(_kept[key][0])
        if folder.getFileSystem(conf).exists(folder):
            return _kept[key][1]
    out = settled(spark, lambda: build(spark, sf_dir), last=True)
    _kept[key] = (out.inputFiles()[0].rpartition("/")[0], out) if out.inputFiles() else (sf_dir, out)
    return out


def conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "conformed", _conformed)


def _conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = works(spark, sf_dir)
    last = table(spark, sf_dir, "orders").select(F.max("o_orderdate").cast("date")).scalar()
    return canonical.featured(canonical.flagged(w, last), last).withColumn("is_completed", F.col("is_completed").cast("int"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "scored", _scored)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with peers, signals, checks and warnings.

    Stand-ins for the fitted models, so that SQL can say the same: the risk of an open work is its age as a share of
    4,000 days, and outliers lie over three robust deviations from their peers' median.
    """

    def signalled() -> DataFrame:
        w = based(conformed(spark, sf_dir))
        age = F.least(F.lit(1.0), F.coalesce(F.col("duration_days"), F.lit(0)) / 4000)
        w = w.withColumns({"risk": F.when(F.col("is_open") == 1, age).otherwise(0.0), "outlier": F.abs("amount_z") > 3, "similarity": F.lit(None).cast("double")})
        return signals.ruled(signals.fused(w))

    return signals.early_warning(settled(spark, signalled), ["activity_category", "state_name"])


def based(w: DataFrame) -> DataFrame:
    """Works with peers, ranks among them and their agency's change point.  Of the tables on the way only one stays at a time."""

    def compared() -> DataFrame:
        out = stored(peers.backed_off(w, PEER_LEVELS, min_peers=MIN_PEERS))
        out = peers.leave_one_out_percentile(out, ["peer_group"], "recommended_amount", "amount_pct")
        out = peers.robust_z(out, ["peer_group"], "recommended_amount", "amount_z")
        return out.withColumn("_open_days", F.when(F.col("is_open") == 1, F.col("duration_days")))

    def ranked() -> DataFrame:
        out = settled(w.sparkSession, compared)
        return peers.leave_one_out_percentile(out, ["peer_group", "is_open"], "_open_days", "open_pct").drop("_open_days")

    out = settled(w.sparkSession, ranked)
    steps = signals.change_points(out, "implementing_agency", F.year("recommendation_date"), "recommended_amount").select("implementing_agency", "change")
    return out.join(steps, "implementing_agency", "left")


#: Fitted hazards by the stored works that they were fitted to.
_fitted: dict[str, hazard.Hazard] = {}


def risk_model(spark: SparkSession, sf_dir: str) -> hazard.Hazard:
    """Proportional hazards of completion on amount, sanction, the commonest states and kinds of work."""
    w = conformed(spark, sf_dir)
    if (folder := str(w.inputFiles()[:1])) in _fitted:
        return _fitted[folder]
    frame = hazard.framed(w, "recommended_amount", "is_sanctioned", {"state_name": 15, "activity_category": 20})
    _fitted[folder] = hazard.fit(w, frame, "work_ref", "duration_days", "is_event")
    return _fitted[folder]


def text_pairs(spark: SparkSession, sf_dir: str, exact: bool = True) -> DataFrame:
    """Pairs of similar documents of a language, by counts of words hashed to 256 places: documents as works' descriptions."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL")
    counts = HashingTF(numFeatures=256, inputCol="words", outputCol="counts").transform(docs.select("doc_id", "lang", F.split("text", " ").alias("words")))
    vectors = stored(counts.select("doc_id", "lang", vector_to_array("counts").alias("v")))
    return duplicates.block_pairs(vectors, "doc_id", ["lang"], "v", least=0.97, exact=exact)


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar document of each that has a similar one."""
    return kept(spark, sf_dir, "partners", lambda spark, d: duplicates.best_partner(stored(text_pairs(spark, d))))


def modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "modelled", _modelled)


def _modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``scored``, with the fitted models in place of its stand-ins.

    The risk is that of the fitted hazards within ``HORIZON``, outliers are those of an isolation forest on log amount and age,
    and a work's similarity is that of the document of its number to the one most like it.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("serial")).distinct()
    w = conformed(spark, sf_dir).join(docs.withColumn("document", F.col("serial")), "serial", "left")
    return judged(w, risk_model(spark, sf_dir), partners(spark, sf_dir))


def judged(w: DataFrame, model: hazard.Hazard, nearest: DataFrame) -> DataFrame:
    """``modelled`` for conformed works with a ``document``; works of the same document are as similar as can be."""
    spark = w.sparkSession

    def flagged() -> DataFrame:
        base = hazard.at_horizon(settled(spark, lambda: based(w)), model, "duration_days", "is_open", HORIZON)
        flags = models.isolation(base.select("work_ref", "log_amount", "age_days"), ["log_amount", "age_days"], "work_ref").select("work_ref", "outlier")
        shared = base.where("document IS NOT NULL").groupBy("document").agg(F.count("*").alias("_sharing"))
        like = shared.join(nearest.select(F.col("key").alias("document"), F.col("similarity").alias("_near")), "document", "left")
        like = like.select("document", F.when(F.col("_sharing") > 1, 1.0).otherwise(F.col("_near")).alias("similarity"))
        return base.join(flags, "work_ref").join(like, "document", "left")

    joined = settled(spark, flagged)
    return signals.early_warning(settled(spark, lambda: signals.ruled(signals.fused(joined))), ["activity_category", "state_name"])


def planted(spark: SparkSession, sf_dir: str, each: int = 250) -> DataFrame:
    """``modelled`` works with planted anomalies, judged again from their changed fields by the model fitted before."""
    before = modelled(spark, sf_dir)
    changed = planting.planted(before, "work_ref", ["state_name", "activity_category"], each, ("document",), "document IS NOT NULL")
    last = table(spark, sf_dir, "orders").select(F.max("o_orderdate").cast("date")).scalar()
    kept_columns = [*conformed(spark, sf_dir).columns, "document", "planted"]
    w = changed.select(*kept_columns).withColumn("is_completed", F.col("is_completed").cast("boolean"))
    w = stored(canonical.featured(canonical.flagged(w, last), last).withColumn("is_completed", F.col("is_completed").cast("int")))
    return judged(w, risk_model(spark, sf_dir), partners(spark, sf_dir))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is a payment: by the customer's nation to the supplier."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    d = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return d.select(F.col("n_name").alias("authority"), F.col("l_suppkey").alias("vendor"), amount.alias("amount"), F.col("l_shipdate").cast("date").alias("paid_on"), F.col("l_orderkey").alias("serial"))


def verifications(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels as outcomes of visits, and bands by the length of the document."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    outcome = F.when(F.col("quality") == 1, "VERIFIED_COMPLETE").otherwise("RECORD_MISMATCH")
    visits = labels.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("work"), outcome.alias("outcome"), F.col("doc_id").alias("created_at"))
    band = F.when(F.col("n_chars") >= 3000, "HIGH").when(F.col("n_chars") >= 1000, "MEDIUM")
    return visits, docs.select(F.col("doc_id").alias("work"), band.alias("band")).where("band is not null")


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(picture, owner, first, second): each document as a picture of its source, with two 64-bit similarity hashes of its words.

    A bit is set if it is in over half of the MD5 sums of the document's distinct words: near copies differ in few bits.
    """
    # dealt out once, as texts by picture and owner: neither the words nor their sums are shuffled after that
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("picture"), F.col("source").alias("owner"), "text").repartition("picture", "owner")
    words = docs.select("picture", "owner", F.explode(F.array_distinct(F.split("text", " "))).alias("w")).where("w <> ''").distinct()
    sums = words.select("picture", "owner", *[F.conv(F.substring(F.md5("w"), 8 * i + 1, 8), 16, 10).cast("long").alias(f"x{i}") for i in range(4)])
    ones = [F.sum(F.expr(f"shiftright(x{i // 32}, {i % 32}) & 1")).alias(f"n{i}") for i in range(128)]
    counted = sums.groupBy("picture", "owner").agg(F.count("*").alias("n"), *ones)
    bits = lambda at: reduce(lambda x, y: x.bitwiseOR(y), [F.when(2 * F.col(f"n{at + i}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)])
    return counted.select("picture", "owner", bits(0).alias("first"), bits(64).alias("second"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of their user's record."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", k.alias("k"))
