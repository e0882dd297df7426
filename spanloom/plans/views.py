"""Interval-domain views of the given tables.

The tables hold orders, events and vectors; here they are read as recordings,
intervals, observations and vectors of tracked objects.  ``SQL`` spells the same
views for DuckDB.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Label lists by position; the view picks one by a key's remainder.
RELATIONS = (
    "physical_altercation", "gunshot_visible", "explosion_visible", "carrying",
    "suspicious_near_vehicle", "vehicle_collision", "running", "enter_or_exit_vehicle",
)
SOUNDS = (
    "shout", "impact", "gunshot_or_explosion", "engine",
    "tire_squeal", "glass_breaking", "horn", "skidding",
)
CLASSES = ("person", "vehicle", "object")
# Keywords over the words of part names.
PART_KEYWORDS = {
    "fastener": ["bolt", "rod", "rods"],
    "round": ["ring", "gear"],
    "heavy": ["anvil", "plate"],
    "heat": ["hot", "red_widget"],
    "gadget": ["widget", "gizmos"],
}


def by_remainder(key: Column, names: tuple[str, ...]) -> Column:
    table = F.array(*[F.lit(n) for n in names])
    return F.element_at(table, (F.pmod(key, F.lit(len(names))) + 1).cast("int"))


def sql_list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def literals(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def iv(self) -> DataFrame:
        """lineitem as labelled intervals, about 30 per recording."""
        start = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
        return self.table("lineitem").select(
            F.col("l_partkey").alias("analysis_id"), F.col("l_returnflag").alias("pred"),
            F.col("l_suppkey").alias("arg1"), F.col("l_orderkey").alias("arg2"),
            start.alias("sf"), (start + F.col("l_quantity").cast("long")).alias("ef"))

    def side(self, pred: str, prefix: str) -> DataFrame:
        rows = self.iv.where(F.col("pred") == pred)
        return rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns])

    @cached_property
    def visual(self) -> DataFrame:
        """lineitem as relation intervals with two participants (four frames a day)."""
        start = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long") * 4
        first = F.pmod("l_suppkey", F.lit(7)).cast("int")
        second = F.pmod(F.col("l_linenumber") + 3, F.lit(7)).cast("int")

        def member(i: Column) -> Column:
            return F.struct(i.alias("class_id"), by_remainder(i, CLASSES).alias("class"))

        return self.table("lineitem").select(
            F.col("l_partkey").alias("analysis_id"),
            by_remainder(F.col("l_orderkey"), RELATIONS).alias("relation_type"),
            start.alias("sf"), (start + F.col("l_quantity").cast("long") * 4).alias("ef"),
            F.array_distinct(F.array(member(first), member(second))).alias("participants"))

    @cached_property
    def audio(self) -> DataFrame:
        start = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long") * 4
        return self.table("lineitem").select(
            F.col("l_partkey").alias("analysis_id"),
            by_remainder(F.col("l_suppkey"), SOUNDS).alias("audio_class"),
            start.alias("sf"), (start + F.col("l_quantity").cast("long") * 4).alias("ef"),
            (F.lit(1.0) - F.col("l_discount")).alias("confidence"))

    @cached_property
    def observed(self) -> DataFrame:
        """events with their recording, hour frame and second participant."""
        hour = (F.datediff("ts", F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("long")
        return self.table("events").select(
            "event_id", "user_id", "event_type", "value",
            F.pmod("user_id", F.lit(10)).alias("analysis_id"), hour.alias("frame"),
            F.get_json_object("props", "$.k").cast("int").alias("k"))

    @cached_property
    def relations(self) -> DataFrame:
        """One row per participant of an observed relation."""
        ids = F.array(F.col("user_id").cast("int"), F.col("k") + 10000)
        return self.observed.select(
            "analysis_id", "frame", F.col("event_id").alias("relation_id"),
            F.col("event_type").alias("relation_type"), F.explode(ids).alias("class_id"))

    @cached_property
    def frame_rel(self) -> DataFrame:
        return self.observed.select(
            "analysis_id", F.col("event_type").alias("relation_type"),
            F.col("user_id").alias("class_id"), "frame").distinct()

    @cached_property
    def objects(self) -> DataFrame:
        """Detected objects: one per event, in order inside the frame."""
        return self.observed.select(
            "analysis_id", "frame", F.col("event_id").cast("int").alias("ordinal"),
            by_remainder(F.col("user_id"), CLASSES).alias("class"),
            F.array((F.pmod("k", F.lit(8)) + 1).cast("int")).alias("blocks"),
            F.when(F.pmod("k", F.lit(4)) == 0, (F.pmod("user_id", F.lit(40)) + 1).cast("string"))
            .otherwise("new").alias("raw_id"))

    @cached_property
    def seen(self) -> DataFrame:
        """The detected objects, those with a vector of their number with it."""
        looks = self.table("embeddings").select(F.col("vec_id").cast("int").alias("ordinal"), "embedding")
        return self.objects.join(looks, "ordinal", "left")

    @cached_property
    def memory(self) -> DataFrame:
        """embeddings as the remembered objects of recordings of a million vectors each."""
        return self.table("embeddings").select(
            F.floor(F.col("vec_id") / 1000000).alias("analysis_id"), F.col("vec_id").alias("frame"),
            F.col("label").alias("class_id"), by_remainder(F.col("label"), CLASSES).alias("class"),
            "embedding")

    @cached_property
    def runs(self) -> DataFrame:
        """One run per recording of ``iv``; the frame rate varies."""
        return self.table("part").select(
            F.col("p_partkey").alias("analysis_id"),
            (F.pmod("p_size", F.lit(4)) * 6 + 12).cast("int").alias("fps"),
            F.concat((F.pmod("p_size", F.lit(4)) * 6 + 12).cast("string"), F.lit("/"),
                     F.pmod("p_partkey", F.lit(2)).cast("string")).alias("rate"))

    @cached_property
    def synonyms_source(self) -> DataFrame:
        rows = [(c, k, i) for i, (c, k) in enumerate(
            (c, k) for c, ks in PART_KEYWORDS.items() for k in ks)]
        return self.literals(rows, "class string, keyword string, ordinal int")


_DAY = "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))"


def _sql_class(expr: str) -> str:
    return f"{sql_list(CLASSES)}[CAST(({expr}) % 3 + 1 AS INT)]"


# The same views for DuckDB, as CTE bodies.  "who" has a row for each participant of an interval, "whose" for
# each two of them (itself among them).
SQL = {
    "iv": f"""SELECT l_partkey AS analysis_id, l_returnflag AS pred, l_suppkey AS arg1,
        l_orderkey AS arg2, CAST({_DAY} AS BIGINT) AS sf,
        CAST({_DAY} AS BIGINT) + CAST(l_quantity AS BIGINT) AS ef FROM lineitem""",
    "vpi": f"""SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity)
        AS relation_id, l_partkey AS analysis_id,
        {sql_list(RELATIONS)}[CAST(l_orderkey % 8 + 1 AS INT)] AS relation_type,
        CAST({_DAY} AS BIGINT) * 4 AS sf,
        CAST({_DAY} AS BIGINT) * 4 + CAST(l_quantity AS BIGINT) * 4 AS ef,
        CAST(l_suppkey % 7 AS INT) AS p1, CAST((l_linenumber + 3) % 7 AS INT) AS p2 FROM lineitem""",
    "vp": f"""SELECT DISTINCT relation_id, class_id, {_sql_class('class_id')} AS class FROM (
        SELECT relation_id, p1 AS class_id FROM vpi UNION ALL SELECT relation_id, p2 FROM vpi)""",
    "who": f"""SELECT *, {_sql_class('arg1')} AS class1 FROM (
        SELECT analysis_id, relation_type, sf, ef, ids, unnest(ids) AS arg1 FROM (
          SELECT l_partkey AS analysis_id, {sql_list(RELATIONS)}[CAST(l_orderkey % 8 + 1 AS INT)] AS relation_type,
            CAST({_DAY} AS BIGINT) * 4 AS sf, CAST({_DAY} AS BIGINT) * 4 + CAST(l_quantity AS BIGINT) * 4 AS ef,
            list_distinct([CAST(l_suppkey % 7 AS INT), CAST((l_linenumber + 3) % 7 AS INT)]) AS ids FROM lineitem))""",
    "whose": f"""SELECT *, {_sql_class('arg2')} AS class2 FROM (SELECT *, unnest(ids) AS arg2 FROM who)""",
    "api": f"""SELECT l_partkey AS analysis_id,
        {sql_list(SOUNDS)}[CAST(l_suppkey % 8 + 1 AS INT)] AS audio_class,
        CAST({_DAY} AS BIGINT) * 4 AS sf,
        CAST({_DAY} AS BIGINT) * 4 + CAST(l_quantity AS BIGINT) * 4 AS ef,
        1.0::DOUBLE - l_discount AS confidence FROM lineitem""",
    "observed": """SELECT event_id, user_id, event_type, value, user_id % 10 AS analysis_id,
        CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS BIGINT) AS frame,
        CAST(json_extract(props, '$.k') AS INT) AS k FROM events""",
    "relations": """SELECT analysis_id, frame, event_id AS relation_id, event_type AS relation_type,
        unnest([CAST(user_id AS INT), k + 10000]) AS class_id FROM observed""",
    "frame_rel": """SELECT DISTINCT analysis_id, event_type AS relation_type, user_id AS class_id,
        frame FROM observed""",
    "objects": f"""SELECT analysis_id, frame, CAST(event_id AS INT) AS ordinal,
        {_sql_class('user_id')} AS class, CAST(k % 8 + 1 AS INT) AS block,
        CASE WHEN k % 4 = 0 THEN CAST(user_id % 40 + 1 AS VARCHAR) ELSE 'new' END AS raw_id
        FROM observed""",
    "memory": f"""SELECT vec_id // 1000000 AS analysis_id, vec_id AS frame, label AS class_id,
        {_sql_class('label')} AS class, embedding FROM embeddings""",
    "runs": """SELECT p_partkey AS analysis_id, CAST(p_size % 4 * 6 + 12 AS INT) AS fps,
        CAST(p_size % 4 * 6 + 12 AS VARCHAR) || '/' || CAST(p_partkey % 2 AS VARCHAR) AS rate
        FROM part""",
}


def with_views(*names: str) -> str:
    """``WITH`` clause for the named views, their own inputs first."""
    needs = {"vp": ["vpi"], "whose": ["who"], "relations": ["observed"], "frame_rel": ["observed"],
             "objects": ["observed"]}
    order: list[str] = []
    for name in names:
        for n in [*needs.get(name, []), name]:
            if n not in order:
                order.append(n)
    # Numbered rows must be numbered once, however often they are read.
    once = {"vpi", "vp"}
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in once else ''}({SQL[n]})" for n in order)
