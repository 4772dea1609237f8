"""Sources and sinks: manifests, embedded crops, annotations, corpora, profiles, submissions, lock files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "slice_name string, image_path string, left int, top int, width int, height int, weight double"
LINES = "image_id string, paragraphs array<struct<lines:array<struct<vertices:array<array<int>>,text:string,legible:boolean,vertical:boolean,handwritten:boolean>>>>"
WORDS = "imgs map<string,struct<id:string>>, anns map<string,struct<points:array<double>,utf8_string:string>>, imgToAnns map<string,array<string>>"
PROFILE = "crop_height struct<quantiles:array<double>>, aspect_ratio struct<quantiles:array<double>>, sharpness struct<quantiles:array<double>>, ink_spread struct<quantiles:array<double>>, grayscale_share double, sample_size int"
FONTS = "path string, scripts array<string>, coverage array<int>"


def conform_manifest(df: DataFrame) -> DataFrame:
    """The manifest's columns and types; a missing weight is 1, any other missing column raises."""
    schema = T.StructType.fromDDL(MANIFEST)
    missing = [f.name for f in schema if f.name not in df.columns and f.name != "weight"]
    if missing:
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in df.columns else F.lit(1.0)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema if f.name != "weight"], weight.alias("weight"))


def with_boxes(df: DataFrame) -> DataFrame:
    return df.withColumns({"right": F.col("left") + F.col("width"), "bottom": F.col("top") + F.col("height"), "aspect": F.col("width") / F.col("height")})


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return conform_manifest(spark.read.parquet(path))


def write_manifest(df: DataFrame, path: str) -> None:
    """A manifest of the known columns, the weight filled in."""
    conform_manifest(df).write.mode("overwrite").parquet(path)


def manifest_from_records(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    if not rows:
        raise ValueError("a manifest needs at least one row")
    return spark.createDataFrame(rows, MANIFEST)


def take_slice(manifest: DataFrame, name: str, strict: bool = False) -> DataFrame:
    """Rows of one slice; strict raises, with the slices there are, if it has none."""
    out = manifest.where(F.col("slice_name") == name)
    if strict and out.isEmpty():
        raise ValueError(f"no rows of slice {name}; there are {sorted(r[0] for r in manifest.select('slice_name').distinct().collect())}")
    return out


def with_weights(manifest: DataFrame, weights: DataFrame, key: list[str]) -> DataFrame:
    """Replace the weight by key, never by position; keys without one keep theirs."""
    new = weights.select(*key, F.col("weight").alias("new_weight"))
    return manifest.join(new, key, "left").withColumn("weight", F.coalesce("new_weight", "weight")).drop("new_weight")


def read_embedded_crops(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Parquet with images as bytes or as a struct with bytes, and an optional text column."""
    df = spark.read.parquet(path)
    image = F.col("image.bytes") if isinstance(df.schema["image"].dataType, T.StructType) else F.col("image")
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in df.columns else F.lit("")
    out = df.select(image.alias("image"), text.alias("text"))
    return out.limit(limit) if limit is not None else out


def number_crops(crops: DataFrame, slice_col: str, order: list[str]) -> DataFrame:
    """Usable crops (height 10 or more, aspect 1.1 or more), numbered densely, with their file names."""
    from plumbago.operators.mixing import dense_number

    usable = crops.where((F.col("height") >= 10) & (F.col("width") / F.greatest(F.col("height"), F.lit(1)) >= 1.1))
    return dense_number(usable, [slice_col], order).withColumn("file", F.format_string("%05d.png", F.col("number")))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """PNG images of a folder with their ids (file stems), ordered by path."""
    from plumbago.functions.text import file_stem

    df = spark.read.format("image").option("pathGlobFilter", "*.png").load(folder)
    return df.select(file_stem(F.col("image.origin")).alias("image_id"), "image").orderBy("image.origin")


def sample_paths(df: DataFrame, path: str, n: int | None, seed: int = 0) -> DataFrame:
    """n paths without replacement, in order; all where n is None."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(path)), path).limit(n).orderBy(path) if n is not None else df.orderBy(path)


def read_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Files below a folder by suffix in any case, with their SHA-256."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return df.where(F.lower("path").rlike("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$")).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_line_annotations(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document (gzip by its name) whose annotations list becomes rows."""
    df = spark.read.schema(f"annotations array<struct<{LINES.replace(' string,', ':string,', 1).replace(' array', ':array', 1)}>>").json(path, multiLine=True)
    return df.select(F.explode("annotations").alias("a")).select("a.*")


def read_word_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORDS).json(path, multiLine=True)


def read_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Trimmed lines of two code points or more."""
    out = spark.read.text(path).select(F.trim("value").alias("line")).where(F.char_length("line") >= 2)
    if strict and out.isEmpty():
        raise ValueError("the corpus has no line")
    return out


def write_lines(df: DataFrame, line: str, order: list[str], path: str) -> None:
    df.orderBy(*order).select(line).write.mode("overwrite").text(path)


def lines_digest(df: DataFrame, line: str, number: str, group_rows: int = 100_000) -> DataFrame:
    """SHA-256 of a numbered corpus, as a tree: lines of a group of bounded size, then the groups' digests."""
    def ordered(value: str, order: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value]), "\n")

    groups = df.groupBy(F.floor(F.col(number) / group_rows).alias("block")).agg(F.sha2(ordered(line, number), 256).alias("digest"))
    return groups.agg(F.sha2(ordered("digest", "block"), 256).alias("sha256"), F.count(F.lit(1)).alias("blocks"))


def parts_digest(folder: str) -> str:
    """SHA-256 of a written corpus, as of one file: its part files in order of their names, read piece by piece.

    A digest depends on all bytes before, so this is one stream; ``lines_digest`` is the distributed one.
    """
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    out = hashlib.sha256()
    for f in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.path):
        if f.is_file and not f.base_name.startswith(("_", ".")):
            with system.open_input_stream(f.path, compression=None) as source:
                while piece := source.read(1 << 20):
                    out.update(piece)
    return out.hexdigest()


def write_fonts(df: DataFrame, path: str) -> None:
    """A font index, coverage ranges flat again."""
    flat = F.flatten(F.transform("coverage", lambda r: F.array(r["lo"], r["hi"])))
    df.select("path", "scripts", flat.alias("coverage")).write.mode("overwrite").json(path)


def read_fonts(spark: SparkSession, path: str) -> DataFrame:
    """Font index with its flat coverage list as ranges."""
    df = spark.read.schema(FONTS).json(path, multiLine=True)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("coverage") / 2 - 1, F.lit(0)).cast("int")), lambda i: F.struct(F.get("coverage", 2 * i).alias("lo"), F.get("coverage", 2 * i + 1).alias("hi")))
    return df.select("path", "scripts", pairs.alias("coverage"))


def read_profile(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A profile document; strict raises unless each distribution has 101 quantiles."""
    df = spark.read.schema(PROFILE).json(path, multiLine=True)
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StructType)]
    out = df.select(*[F.col(f"{c}.quantiles").alias(c) for c in names], "grayscale_share", "sample_size")
    if strict and out.where(" or ".join(f"coalesce(size({c}), 0) <> 101" for c in names)).limit(1).count():
        raise ValueError("a distribution needs 101 quantiles")
    return out


def write_profile(df: DataFrame, path: str) -> None:
    names = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    df.select(*[F.struct(F.col(c).alias("quantiles")).alias(c) for c in names], *[c for c in df.columns if c not in names]).write.mode("overwrite").json(path)


def write_submission(df: DataFrame, path: str, id_col: str = "image_id", p: str = "p") -> None:
    from plumbago.operators.metrics import submission_rows

    submission_rows(df, id_col, p).orderBy(id_col).write.mode("overwrite").option("header", True).csv(path)
