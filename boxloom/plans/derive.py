"""Detection tables derived from the given star-schema tables, in Spark and as SQL text.

Every derivation is integer arithmetic over whole tables, so both engines build equal rows and
the work grows with the inputs. The SQL strings are common table expressions: ``with_sql("gt",
"pred")`` gives the ``WITH`` head a reference query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.operators.splits import hash_split_of

IMAGE_WIDTH, IMAGE_HEIGHT = 464, 364
CODE_BITS = 64
#: Ids of the touched-up copies of ``codes``: of each vector one with 0 to 6 other bits.
COPY = 1_000_000


def bit_sql(at: str) -> str:
    """Bit ``at`` (0 to 63) of a signed 64-bit number."""
    return f"CASE WHEN {at} = 63 THEN -9223372036854775808 ELSE 1::BIGINT << least({at}, 62)::INTEGER END"


CTE = {
    "gt": """gt AS (
  SELECT image_id,
    CAST(row_number() OVER (PARTITION BY image_id
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS gt_index,
    CAST(l_partkey % 4 AS INTEGER) AS class_id,
    CAST((l_orderkey * 131 + l_linenumber * 197 + l_suppkey * 3) % 400 AS DOUBLE) AS x1,
    CAST((l_partkey * 53) % 300 AS DOUBLE) AS y1,
    CAST((l_orderkey * 131 + l_linenumber * 197 + l_suppkey * 3) % 400 + 4 + (l_partkey * 7) % 60 AS DOUBLE) AS x2,
    CAST((l_partkey * 53) % 300 + 4 + (l_suppkey * 11) % 60 AS DOUBLE) AS y2,
    image_id % 29 AS group_id,
    CASE WHEN sha256('boxloom|' || CAST(image_id % 29 AS VARCHAR)) <= 'b333333333333333333333333333333333333333333333333333333333333333' THEN 'train'
         WHEN sha256('boxloom|' || CAST(image_id % 29 AS VARCHAR)) <= 'd999999999999999999999999999999999999999999999999999999999999999' THEN 'val'
         ELSE 'test' END AS split
  FROM (SELECT *, l_orderkey // 8 AS image_id FROM lineitem))""",
    # every truth box is predicted twice, by two of its three variants
    "pred": """pred AS (
  SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY gt_index, v) - 1 AS INTEGER) AS pred_index,
    CAST(CASE WHEN v = 2 THEN (class_id + 1) % 4 ELSE class_id END AS INTEGER) AS class_id,
    CAST((image_id * 17 + gt_index * 31 + v * 211) % 100 AS DOUBLE) / 100.0 AS score,
    x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 + dy AS y2, group_id, split
  FROM (SELECT *, CASE v WHEN 0 THEN gt_index % 5 - 2 WHEN 1 THEN gt_index % 9 - 4 ELSE 1 END AS dx,
                  CASE v WHEN 0 THEN gt_index % 3 - 1 ELSE 0 END AS dy
        FROM (SELECT gt.*, (3 - (gt_index + image_id) % 3 + step) % 3 AS v
              FROM gt, (VALUES (1), (2)) AS s(step))))""",
    "excluded": """excluded AS (
  SELECT image_id,
    CAST(row_number() OVER (PARTITION BY image_id
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS source_index,
    CASE WHEN l_linenumber = 1 THEN 'unknown' ELSE
      ['pins','pads','text','fuse','inductor','ferrite bead','button','led'][l_partkey % 8 + 1] END AS source_type,
    CAST((l_orderkey * 131 + l_linenumber * 197 + l_suppkey * 3) % 400 + 5 AS DOUBLE) AS x1,
    CAST((l_partkey * 53) % 300 + 5 AS DOUBLE) AS y1,
    CAST((l_orderkey * 131 + l_linenumber * 197 + l_suppkey * 3) % 400 + 9 + (l_partkey * 7) % 60 AS DOUBLE) AS x2,
    CAST((l_partkey * 53) % 300 + 9 + (l_suppkey * 11) % 60 AS DOUBLE) AS y2
  FROM (SELECT *, l_orderkey // 8 AS image_id FROM lineitem WHERE l_returnflag = 'R'))""",
    "images": f"""images AS (
  SELECT DISTINCT image_id, {IMAGE_WIDTH} AS width, {IMAGE_HEIGHT} AS height, group_id, split FROM gt)""",
    "codes": f"""signs AS (
  SELECT vec_id, label, CAST(list_sum(list_transform(range(0, {CODE_BITS}),
    lambda i: CASE WHEN embedding[i + 1] > 0 THEN {bit_sql('i')} ELSE 0::BIGINT END)) AS BIGINT) AS code,
    CAST(list_sum(list_transform(range(0, 7),
    lambda j: CASE WHEN j < vec_id % 7 THEN {bit_sql('((vec_id * 5 + j * 11) % 64)')} ELSE 0::BIGINT END)) AS BIGINT) AS other
  FROM embeddings),
codes AS (
  SELECT vec_id, label, code FROM signs
  UNION ALL SELECT vec_id + {COPY}, (label + vec_id) % 10, xor(code, other) FROM signs)""",
    "records": """records AS (
  SELECT d.doc_id, sha256(d.text) AS sha, d.source, d.lang, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "candidates": """candidates AS (
  SELECT 'c' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS candidate_id,
    CASE WHEN s_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS arm,
    s_suppkey % 3 AS pipeline, s_suppkey // 6 AS epoch, 'val' AS split,
    round(avg(l_discount), 3) AS ap300, round(avg(l_tax), 3) AS ap100,
    round(avg(l_quantity), 1) AS p50_ms, count(*) AS optimizer_calls
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY s_suppkey, s_nationkey)""",
    "frames": """frames AS (
  SELECT user_id AS camera, event_id AS frame_number, ts, event_type AS class_name, value,
    value % 1.0 AS score FROM events)""",
}
NEEDS = {"pred": ["gt"], "images": ["gt"]}


def with_sql(*names: str, recursive: bool = False) -> str:
    """``WITH`` head holding the named derivations and what they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(CTE[n] for n in ordered)


class Tables:
    """The given tables of one folder and the frames derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _items(self, kept: str = "true") -> DataFrame:
        """Line items with their place in the image and their box, made after the shuffle of the four numbers they come from."""
        keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
        rows = self.read("lineitem").filter(kept).select(F.expr("l_orderkey div 8").alias("image_id"), *keys)
        place = F.col("l_orderkey") * 131 + F.col("l_linenumber") * 197 + F.col("l_suppkey") * 3
        return (
            rows.withColumn("nr", (F.row_number().over(W.partitionBy("image_id").orderBy(*keys)) - 1).cast("int"))
            .withColumn("ox", place % 400)
            .withColumn("oy", (F.col("l_partkey") * 53) % 300)
            .withColumn("bw", (F.col("l_partkey") * 7) % 60 + 4)
            .withColumn("bh", (F.col("l_suppkey") * 11) % 60 + 4)
        )

    def gt(self) -> DataFrame:
        return self._items().select(
            "image_id",
            F.col("nr").alias("gt_index"),
            (F.col("l_partkey") % 4).cast("int").alias("class_id"),
            F.col("ox").cast("double").alias("x1"),
            F.col("oy").cast("double").alias("y1"),
            (F.col("ox") + F.col("bw")).cast("double").alias("x2"),
            (F.col("oy") + F.col("bh")).cast("double").alias("y2"),
            (F.col("image_id") % 29).alias("group_id"),
            hash_split_of(F.col("image_id") % 29, seed="boxloom").alias("split"),
        )

    def pred(self) -> DataFrame:
        g = F.col("gt_index")
        v = F.col("v")
        one, two = ((F.lit(3) - (g + F.col("image_id")) % 3 + s) % 3 for s in (1, 2))
        # both predictions of a truth box in order of their variant; those of earlier boxes stand before them
        each = [F.struct(F.lit(i).alias("second"), f(one, two).alias("v")) for i, f in enumerate((F.least, F.greatest))]
        gt = self.gt()
        rows = (
            gt.select(*gt.columns, F.inline(F.array(*each)))
            .withColumn("dx", F.when(v == 0, g % 5 - 2).when(v == 1, g % 9 - 4).otherwise(1))
            .withColumn("dy", F.when(v == 0, g % 3 - 1).otherwise(0))
        )
        return rows.select(
            "image_id",
            (g * 2 + F.col("second")).cast("int").alias("pred_index"),
            F.when(v == 2, (F.col("class_id") + 1) % 4).otherwise(F.col("class_id")).cast("int").alias("class_id"),
            (((F.col("image_id") * 17 + g * 31 + v * 211) % 100).cast("double") / 100.0).alias("score"),
            (F.col("x1") + F.col("dx")).alias("x1"),
            (F.col("y1") + F.col("dy")).alias("y1"),
            (F.col("x2") + F.col("dx")).alias("x2"),
            (F.col("y2") + F.col("dy")).alias("y2"),
            "group_id",
            "split",
        )

    def excluded(self) -> DataFrame:
        names = F.array(*[F.lit(n) for n in EXCLUDED_TYPES])
        return self._items("l_returnflag = 'R'").select(
            "image_id",
            F.col("nr").alias("source_index"),
            F.when(F.col("l_linenumber") == 1, "unknown")
            .otherwise(F.get(names, (F.col("l_partkey") % 8).cast("int")))
            .alias("source_type"),
            (F.col("ox") + 5).cast("double").alias("x1"),
            (F.col("oy") + 5).cast("double").alias("y1"),
            (F.col("ox") + F.col("bw") + 5).cast("double").alias("x2"),
            (F.col("oy") + F.col("bh") + 5).cast("double").alias("y2"),
        )

    def images(self) -> DataFrame:
        image_id = F.expr("l_orderkey div 8")
        return (
            self.read("lineitem")
            .select(image_id.alias("image_id"))
            .distinct()
            .select(
                "image_id",
                F.lit(IMAGE_WIDTH).alias("width"),
                F.lit(IMAGE_HEIGHT).alias("height"),
                (F.col("image_id") % 29).alias("group_id"),
                hash_split_of(F.col("image_id") % 29, seed="boxloom").alias("split"),
            )
        )

    def codes(self) -> DataFrame:
        """Sign bits of each vector, and of a touched-up copy of it under another label."""
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        signs = F.transform(
            F.slice("embedding", 1, CODE_BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(zero)
        )
        others = F.transform(
            F.array(*(F.lit(j) for j in range(7))),
            lambda j: F.when(
                j < F.col("vec_id") % 7, F.call_function("shiftleft", one, ((F.col("vec_id") * 5 + j * 11) % 64).cast("int"))
            ).otherwise(zero),
        )
        rows = self.read("embeddings").select(
            "vec_id", F.col("label").cast("long").alias("label"),
            F.aggregate(signs, zero, lambda acc, b: acc + b).alias("code"), F.aggregate(others, zero, lambda acc, b: acc + b).alias("other"),
        )
        touched = F.struct(
            (F.col("vec_id") + COPY).alias("vec_id"), ((F.col("label") + F.col("vec_id")) % 10).alias("label"),
            F.col("code").bitwiseXOR(F.col("other")).alias("code"),
        )
        return rows.select(F.inline(F.array(F.struct("vec_id", "label", "code"), touched)))

    def records(self) -> DataFrame:
        docs = self.read("documents")
        return docs.join(self.read("labels"), "doc_id", "left").select(
            "doc_id", F.sha2("text", 256).alias("sha"), "source", "lang", "n_chars", "quality", "toxic"
        )

    def candidates(self) -> DataFrame:
        items = self.read("lineitem").groupBy("l_suppkey").agg(
            F.round(F.avg("l_discount"), 3).alias("ap300"),
            F.round(F.avg("l_tax"), 3).alias("ap100"),
            F.round(F.avg("l_quantity"), 1).alias("p50_ms"),
            F.count("*").alias("optimizer_calls"),
        )
        s = self.read("supplier")
        return items.join(s, items.l_suppkey == s.s_suppkey).select(
            F.concat(F.lit("c"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("candidate_id"),
            F.when(F.col("s_nationkey") % 2 == 0, "a").otherwise("b").alias("arm"),
            (F.col("s_suppkey") % 3).alias("pipeline"),
            F.expr("s_suppkey div 6").alias("epoch"),
            F.lit("val").alias("split"),
            "ap300", "ap100", "p50_ms", "optimizer_calls",
        )

    def frames(self) -> DataFrame:
        return self.read("events").select(
            F.col("user_id").alias("camera"),
            F.col("event_id").alias("frame_number"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_type").alias("class_name"),
            "value",
            (F.col("value") % 1.0).alias("score"),
        )


# fixed values: names given to excluded objects
EXCLUDED_TYPES = ["pins", "pads", "text", "fuse", "inductor", "ferrite bead", "button", "led"]
