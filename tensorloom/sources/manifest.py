"""Manifests of archives: one row per animated property; scans, filters, look-ups, differences and replacement plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import base_name, bin_name
from ..tables import shared_table

SCHEMA = "abc string, path string, mpu double, components array<struct<path: string, type: string, samples: int, size: int, extent: int, bin: string>>"
#: Numeric component types and their bits.
TYPES = {"bool_t": 8, "uint8_t": 8, "int8_t": 8, "uint16_t": 16, "int16_t": 16, "uint32_t": 32, "int32_t": 32, "uint64_t": 64, "int64_t": 64, "float16_t": 16, "float32_t": 32, "float64_t": 64}
DEFAULT_MPU = 0.01


def flattened(documents: DataFrame) -> DataFrame:
    """Rows with SCHEMA as a row per component, in order: archive, mpu, ordinal, path, type, samples, size (1 for scalars), extent, bin.

    Components of any type stay; bits gives the width of numeric ones (a type may be given as bits of a float).
    """
    whole = documents.select(F.coalesce("abc", "path", F.lit("")).alias("archive"), F.coalesce("mpu", F.lit(DEFAULT_MPU)).alias("mpu"), F.posexplode("components").alias("ordinal", "c"))
    kind = F.when(F.col("c.type").rlike("^(16|32|64)$"), F.concat(F.lit("float"), F.col("c.type"), F.lit("_t"))).otherwise(F.col("c.type"))
    return whole.select("archive", "mpu", "ordinal", "c.path", kind.alias("type"), "c.samples", F.coalesce("c.size", F.lit(1)).alias("size"), "c.extent", F.coalesce("c.bin", bin_name(F.col("c.path"))).alias("bin"), _bits(kind).alias("bits"))


def _bits(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[kind]


def read(spark: SparkSession, path: str) -> DataFrame:
    return flattened(spark.read.schema(SCHEMA).option("multiLine", True).json(path))


def parse(rows: DataFrame, column: str) -> DataFrame:
    """Manifests that are JSON text in a column."""
    return flattened(rows.select(F.from_json(column, SCHEMA).alias("m")).select("m.*"))


def to_json(components: DataFrame) -> DataFrame:
    """archive, json: a document per archive, components in order."""
    one = F.struct("path", "type", "samples", "size", "extent", "bin")
    grouped = components.groupBy("archive").agg(F.first("mpu").alias("mpu"), F.array_sort(F.collect_list(F.struct("ordinal", one.alias("c")))).alias("all"))
    return grouped.select("archive", F.to_json(F.struct(F.col("archive").alias("abc"), "mpu", F.transform("all", lambda x: x["c"]).alias("components"))).alias("json"))


def numeric(components: DataFrame, kind: str | None = None) -> DataFrame:
    """Components of numeric types, or of one."""
    return components.where(F.col("type").isin(*([kind] if kind else TYPES)))


def numbytes(components: DataFrame) -> DataFrame:
    """components with numbytes: what a file of the declared shape has."""
    return components.withColumn("numbytes", (F.col("bits") / 8).cast("long") * F.col("size") * F.col("extent") * F.col("samples"))


def misshapen(components: DataFrame, files: DataFrame) -> DataFrame:
    """Components whose file (bin, length) is missing or is not of the declared size."""
    return numbytes(components).join(files, "bin", "left").where("length is null or length <> numbytes")


def look_up(components: DataFrame, key: str) -> DataFrame:
    """The first component whose path, file or file's last part is the key; no row where none is."""
    k = F.lit(key)
    return components.where((F.col("path") == k) | (F.col("bin") == k) | (base_name(F.col("bin")) == base_name(k))).orderBy("archive", "ordinal").limit(1)


def animated(samples: DataFrame) -> DataFrame:
    """path, nsamples of properties (path, sample, size, value hash) that change and have one size throughout."""
    per = samples.groupBy("path").agg(F.count("*").alias("nsamples"), F.count_distinct("hash").alias("values"), F.count_distinct("size").alias("sizes"))
    return per.where("values > 1 and sizes = 1").select("path", "nsamples")


def exportable(samples: DataFrame) -> DataFrame:
    """path, exportable: one rank and one dimension throughout."""
    return samples.groupBy("path").agg(((F.count_distinct("rank") == 1) & (F.count_distinct("dim") == 1)).alias("exportable"))


def path_parts(path: Column) -> tuple[Column, Column]:
    """Object and property part of a path such as a/b//c/d."""
    return F.substring_index(path, "//", 1), F.when(F.instr(path, "//") > 0, F.substring_index(path, "//", -1)).otherwise("")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, change: '-' missing in b, '+' missing in a, '~' different; equal ones are left out.

    Rows have path, kind, nsamples, constant, type, dims, hash. A constant counts as one sample. Strings are compared too.
    """
    known = ("kind", "nsamples", "type", "dims", "hash")
    side = lambda df, s: df.select("path", F.struct("kind", F.when(F.col("constant"), 1).otherwise(F.col("nsamples")).alias("nsamples"), *known[2:]).alias(s))
    change = F.when(F.col("b").isNull(), "-").when(F.col("a").isNull(), "+").when(~F.col("a").eqNullSafe(F.col("b")), "~")
    return side(a, "a").join(side(b, "b"), "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("path").join(b.select("path"), "path", "left_anti")


def replacement_plan(components: DataFrame, overrides: DataFrame, files: DataFrame) -> DataFrame:
    """path, source: the file that replaces each component: an override by path, else by file name, else its own file; only files that exist.

    overrides: key, file. files: file.
    """
    by_path = overrides.select(F.col("key").alias("path"), F.col("file").alias("by_path"))
    by_bin = overrides.select(F.col("key").alias("bin"), F.col("file").alias("by_bin"))
    wanted = components.join(by_path, "path", "left").join(by_bin, "bin", "left").select("path", F.coalesce("by_path", "by_bin", "bin").alias("source"))
    return wanted.join(files.select(F.col("file").alias("source")), "source", "left_semi").select("path", "source")


def replaced(archive: DataFrame, replacements: DataFrame) -> DataFrame:
    """archive rows (path, content, ...) with content replaced where replacements (path, content) has the path; siblings of any kind stay."""
    new = replacements.select("path", F.col("content").alias("new"))
    return archive.join(new, "path", "left").withColumn("content", F.coalesce("new", "content")).drop("new")


def paths(nodes: DataFrame) -> DataFrame:
    """id, path, depth of a hierarchy (id, parent, name; roots have no parent), level by level, however deep it is.

    Each level is one join, and is written to the shared folder once. A hierarchy is at most as deep as it has nodes: a
    deeper one goes in circles, which is an error.
    """
    done = level = shared_table(nodes.where("parent is null").select("id", F.col("name").alias("path"), F.lit(0).alias("depth")), "level")
    most, depth = nodes.count(), 0
    while not level.isEmpty():
        depth += 1
        if depth > most:
            raise ValueError("the hierarchy goes in circles")
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("above"))
        level = shared_table(nodes.join(up, "parent").select("id", F.concat("above", F.lit("/"), "name").alias("path"), F.lit(depth).alias("depth")), "level")
        done = done.unionByName(level)
    return done
