"""Label files of recognition corpora: readers, filters and the joint sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions.text import normalize_label, strip


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as column ``value``."""
    return spark.read.text(path)


def _label_length_ok(label: Column) -> Column:
    return F.length(label).between(fv.LABEL_MIN_CHARS, fv.LABEL_MAX_CHARS)


def word_index_labels(lines: DataFrame, value: str = "value") -> DataFrame:
    """Parse word-index lines to ``(word_id, transcript)``.

    Blank and ``#`` lines are skipped; a line needs nine fields; only entries of
    status ``ok`` with a transcript of 2 to 60 characters stay.
    """
    stripped = strip(F.col(value))
    fields = F.split(stripped, " ")
    parsed = lines.filter((stripped != "") & ~stripped.startswith("#")).select(
        F.get(fields, F.lit(0)).alias("word_id"),
        F.get(fields, F.lit(1)).alias("status"),
        F.element_at(fields, -1).alias("transcript"),
        F.size(fields).alias("_n"),
    )
    return parsed.filter(
        (F.col("_n") >= 9) & (F.col("status") == "ok") & _label_length_ok(F.col("transcript"))
    ).select("word_id", "transcript")


def file_name_labels(paths: DataFrame, path: str = "path") -> DataFrame:
    """Labels held in file names: the parts after the fourth dash of the stem.

    Only ``.tif`` and ``.png`` files with five parts or more, whose label has 2 to
    60 characters of the allowed set.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    parts = F.split(F.regexp_replace(name, r"\.(tif|png)$", ""), "-")
    joined = F.array_join(F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0))), "-")
    label = strip(F.get(F.split(joined, r"\."), F.lit(0)))
    return (
        paths.filter(name.rlike(r"\.(tif|png)$") & (F.size(parts) >= 5))
        .select(*paths.columns, label.alias("transcript"))
        .filter(_label_length_ok(F.col("transcript")) & F.col("transcript").rlike(fv.LABEL_CHARSET))
    )


def tab_labels(lines: DataFrame, value: str = "value", normalise: bool = False) -> DataFrame:
    """Lines with a tab as ``(file_name, label)``, split at the first tab."""
    stripped = strip(F.col(value))
    parts = F.split(stripped, "\t", 2)
    label = F.element_at(parts, -1)
    rest = [c for c in lines.columns if c != value]
    return lines.filter(stripped.contains("\t")).select(
        *rest,
        F.get(parts, F.lit(0)).alias("file_name"),
        (normalize_label(label) if normalise else strip(label)).alias("label"),
    )


def usable_samples(samples: DataFrame, min_size: tuple[int, int] = fv.LOADER_MIN_SIZE) -> DataFrame:
    """Mark samples ``usable``: a label and an image of at least the given size."""
    wide, high = min_size
    big = (F.col("width") >= wide) & (F.col("height") >= high)
    labelled = F.coalesce(F.length(strip(F.col("label"))) > 0, F.lit(False))
    return samples.withColumn("usable", labelled & F.coalesce(big, F.lit(False)))


def sample_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(
        F.count_if("usable").alias("kept"), F.count_if(~F.col("usable")).alias("skipped")
    )


def joint_labels(*sources: DataFrame, limit: int = 0) -> DataFrame:
    """One label table from several sources; ``limit`` 0 means all rows."""
    joint = sources[0]
    for other in sources[1:]:
        joint = joint.unionByName(other)
    return joint.limit(limit) if limit else joint


def write_tab_labels(labels: DataFrame, path: str) -> None:
    """Write ``file_name<TAB>label`` lines without quoting."""
    labels.select(F.concat_ws("\t", "file_name", "label").alias("value")).write.mode(
        "overwrite"
    ).text(path)


def upload_manifest(spark: SparkSession, path: str) -> DataFrame:
    """File names and sizes below a folder; file contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("path").alias("file_name"), F.col("length").alias("size_bytes"), F.lit("").alias("content_type")
    )


def check_uploads(manifest: DataFrame) -> DataFrame:
    """Add the effective ``content_type`` and ``problem`` (null when accepted)."""
    suffix = F.lower(F.regexp_extract(F.col("file_name"), r"(\.[^./]+)$", 1))
    from_suffix = None
    for ext, kind in fv.UPLOAD_TYPES.items():
        hit = suffix == ext
        from_suffix = F.when(hit, kind) if from_suffix is None else from_suffix.when(hit, kind)
    known = sorted(set(fv.UPLOAD_TYPES.values()))
    kind = F.when(F.col("content_type").isin(known), F.col("content_type")).otherwise(from_suffix)
    return manifest.withColumn("content_type", kind).withColumn(
        "problem",
        F.when(F.col("content_type").isNull(), "unsupported type").when(
            F.col("size_bytes") > fv.UPLOAD_MAX_BYTES, "too large"
        ),
    )
