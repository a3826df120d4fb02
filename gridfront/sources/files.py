"""Readers and writers of result tables, vectors and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numeric columns of summary files.
NUMERIC = ["runtime_ms", "peak_memory_kib", "n_expanded", "n_generated", "solution_count", "best_f1_time_s", "best_f2_nav_deficit_s", "best_f3_visibility_deficit_s", "reference_f1", "reference_f2", "reference_f3", "hypervolume", "normalized_hypervolume", "union_front_recall", "additive_epsilon"]


def summary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries; blanks are null, ``feasible`` is boolean and the known columns are numbers."""
    d = spark.read.option("header", True).csv(path)
    for c in d.columns:
        blank = F.when(F.trim(c) == "", None).otherwise(F.col(c))
        d = d.withColumn(c, F.lower(c) == "true" if c == "feasible" else blank.cast("double") if c in NUMERIC or c.startswith("coverage_of_") else blank)
    return d


def characteristics_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ("route_id", "selected", "rank")) -> DataFrame:
    """Route characteristics; ids must run from 0, exactly one route be selected, ranks be a permutation."""
    d = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if missing := [c for c in required if c not in d.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    s = d.agg(F.count("*").alias("n"), F.countDistinct("route_id").alias("ids"), F.min("route_id").alias("lo"), F.max("route_id").alias("hi"), F.sum(F.col("selected").cast("boolean").cast("int")).alias("picked"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("first"), F.max("rank").alias("last")).first()
    if s.n and not (s.ids == s.n and s.lo == 0 and s.hi == s.n - 1 and s.picked == 1 and s.ranks == s.n and s["first"] == 1 and s["last"] == s.n):
        raise ValueError("route ids, selection or ranks are inconsistent")
    return d


def features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features: ``id, properties, type, coordinates`` (coordinates as JSON text), ``crs``."""
    schema = "crs struct<properties:struct<name:string>>, features array<struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"
    d = spark.read.schema(schema).json(path, multiLine=True)
    crs = F.regexp_extract(F.coalesce("crs.properties.name", F.lit("EPSG::32635")), r"(\d+)$", 1).cast("int")
    return d.select(crs.alias("crs"), F.posexplode("features").alias("id", "f")).select("id", "crs", "f.properties", "f.geometry.type", "f.geometry.coordinates")


def rings(d: DataFrame) -> DataFrame:
    """``id, ring``: the outer rings of polygons and multipolygons; other geometries are an error."""
    if bad := d.filter(~F.col("type").isin("Polygon", "MultiPolygon")).limit(1).count():
        raise ValueError(f"{bad} feature is not a polygon")
    many = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", "array<array<array<double>>>"))).otherwise(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    return d.select("id", F.explode(many).alias("p")).select("id", F.expr("transform(p[0], c -> struct(c[0] as x, c[1] as y))").alias("ring"))


def points(d: DataFrame) -> DataFrame:
    """``id, role, x, y`` of points; a multipoint gives its first point."""
    c = F.when(F.col("type") == "Point", F.from_json("coordinates", "array<double>")).when(F.col("type") == "MultiPoint", F.from_json("coordinates", "array<array<double>>")[0])
    return d.select("id", F.col("properties")["role"].alias("role"), c[0].alias("x"), c[1].alias("y")).filter("x is not null")


def aoi_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row an area and mission; there must be five areas with two missions each."""
    schema = "aois array<struct<id:string, land_cover:string, archive:string, missions:array<struct<id:string, start:array<int>, goal:array<int>>>>>"
    d = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("aois").alias("a")).select("a.*")
    s = d.agg(F.count("*").alias("n"), F.min(F.size("missions")).alias("lo"), F.max(F.size("missions")).alias("hi"), F.count(F.when(F.col("id").isNull() | F.col("archive").isNull() | F.col("land_cover").isNull(), 1)).alias("gaps")).first()
    if s.n != 5 or s.lo != 2 or s.hi != 2 or s.gaps:
        raise ValueError("the manifest needs five complete areas with two missions each")
    return d.withColumn("m", F.explode("missions")).select(F.col("id").alias("aoi"), "land_cover", "archive", F.col("m.id").alias("mission"), F.struct(F.col("m.start")[0].alias("x"), F.col("m.start")[1].alias("y")).alias("start"), F.struct(F.col("m.goal")[0].alias("x"), F.col("m.goal")[1].alias("y")).alias("goal"))


def pixels_in(pixels: DataFrame, extent: tuple[float, float, float, float]) -> DataFrame:
    """Pixels ``east, north`` inside the extent (xmin, xmax, ymin, ymax); a plain range filter, so it is pushed to the scan."""
    xmin, xmax, ymin, ymax = extent
    return pixels.filter(F.col("east").between(xmin, xmax) & F.col("north").between(ymin, ymax))


def band_file(spark: SparkSession, folder: str, suffix: str) -> str | None:
    """The first file name, in order, that ends with the suffix."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).agg(F.min("path")).first()[0]


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """A Parquet table with its format version; an existing one is an error unless it is to be overwritten."""
    w = df.withColumn("format_version", F.lit(1)).write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_table``; another format version is an error."""
    d = spark.read.parquet(path)
    if d.filter(F.col("format_version") != 1).limit(1).count():
        raise ValueError("unknown format version")
    return d.drop("format_version")


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with its columns in order of their names."""
    df.select(*sorted(df.columns)).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns; what a table lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def run_json(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, json``: each run as one document with its routes in order; an infeasible one has none."""
    s = F.array_sort(F.coalesce("solutions", F.from_json(F.lit("[]"), runs.schema["solutions"].dataType)))
    rest = [c for c in runs.columns if c not in (*keys, "solutions")]
    return runs.select(*keys, F.to_json(F.struct(*keys, *rest, s.alias("solutions")), {"ignoreNullFields": "false"}).alias("json"))


def manifest(spark: SparkSession, cases: list[dict], methods: tuple[str, ...], profiles: dict) -> DataFrame:
    """One row ``json``: the versions, methods, weights and cases of a benchmark, with the hash of each case's file."""
    import json
    import platform

    held = []
    for c in cases:
        source = c.get("source") or ""
        found = content_hashes(spark, source).first() if source and not source.startswith("synthetic:") else None
        held.append(c | ({"sha256": found.sha256} if found else {}))
    text = json.dumps({"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "methods": list(methods), "profiles": profiles, "cases": held}, sort_keys=True)
    return spark.range(1).select(F.lit(text).alias("json"))
