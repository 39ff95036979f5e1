"""Distance joins of points: an equi join on grid cells, then the exact distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.plans.tables import table


def tasks(spark: SparkSession) -> int:
    """Of a join by cells. Its few bytes make many pairs, so Spark may not put its partitions together by their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def distance_join(left: DataFrame, right: DataFrame, distance: float, left_xy: tuple[str, str], right_xy: tuple[str, str], rows_a_task: int = 10_000) -> DataFrame:
    """All pairs of rows within the distance. Cells are as wide as the distance, so partners are in one of nine; the right side is copied to them, and the left side is not copied.

    Left rows are counted by cell first. A cell of more than rows_a_task goes in pieces, by a hash of the row, to each of
    which its right rows are copied; there is a task for about so many left rows, however few bytes they have. The driver
    gets a row for each cell in pieces. Left rows that are equal in all columns stay in one piece."""
    if distance <= 0:
        raise ValueError("distance must be positive")

    def cell(x: Column) -> Column:
        return F.floor(x / distance)

    cells = ["__cx", "__cy"]
    near = [F.struct((cell(F.col(right_xy[0])) + i).alias("cx"), (cell(F.col(right_xy[1])) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    spread = right.withColumn("__c", F.explode(F.array(*near))).withColumns({"__cx": F.col("__c.cx"), "__cy": F.col("__c.cy")}).drop("__c")
    placed = left.withColumns({"__cx": cell(F.col(left_xy[0])), "__cy": cell(F.col(left_xy[1]))})
    sizes = placed.where("__cx is not null and __cy is not null").groupBy(*cells).agg(F.count("*").alias("n"))
    pieces = F.struct(*cells, F.ceil(F.col("n") / rows_a_task).alias("__pieces"))
    rows, large = sizes.agg(F.sum("n"), F.collect_list(F.when(F.col("n") > rows_a_task, pieces))).first()
    if large:
        told = F.broadcast(left.sparkSession.createDataFrame([tuple(x) for x in large], "__cx long, __cy long, __pieces long"))
        of = F.xxhash64(*[F.col(f"`{c}`") for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind])
        placed = placed.join(told, cells, "left").withColumn("__piece", F.pmod(of, F.coalesce("__pieces", F.lit(1)))).drop("__pieces")
        spread = spread.join(told, cells, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__pieces", F.lit(1)) - 1))).drop("__pieces")
        cells = [*cells, "__piece"]
    n = max(tasks(left.sparkSession), (rows or 0) // rows_a_task)
    dx, dy = F.col(left_xy[0]) - F.col(right_xy[0]), F.col(left_xy[1]) - F.col(right_xy[1])
    return placed.join(spread.repartition(n, *cells).hint("merge"), cells).where(dx * dx + dy * dy <= distance * distance).drop(*cells)


def grid_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as points, those within 3 of each other."""
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 97).cast("double").alias("px"), F.col("p_size").cast("double").alias("py"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 89).cast("double").alias("sx"), F.col("s_nationkey").cast("double").alias("sy"))
    return distance_join(part, supplier, 3.0, ("px", "py"), ("sx", "sy")).select("p_partkey", "s_suppkey")


GRID_JOIN_SQL = "SELECT p_partkey, s_suppkey FROM part, supplier WHERE (p_partkey % 97 - s_suppkey % 89) ** 2 + (p_size - s_nationkey) ** 2 <= 9"
