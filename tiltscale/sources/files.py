"""Score files: tables with a header, and variant call text."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Wanted column: how its header name is recognised, lower-cased, and the default where it is absent.
_COLUMNS = (
    ("chrom", lambda h: h.startswith(("#chr", "chr")), None),
    ("start", lambda h: h.startswith(("start", "pos")), None),
    ("ref_count", lambda h: h.startswith("ref") and "count" in h, None),
    ("alt_count", lambda h: h.startswith("alt") and "count" in h, None),
    ("ref", lambda h: h.startswith("ref"), None),
    ("alt", lambda h: h.startswith("alt"), None),
    ("qual", lambda h: h.startswith("qual"), "Infinity"),
    ("id", lambda h: h in ("id", "name"), ""),
    ("db", lambda h: h == "db", "false"),
    ("bad", lambda h: h == "bad", "0"),
)
_TYPES = {"start": "long", "ref_count": "int", "alt_count": "int", "qual": "double", "db": "boolean", "bad": "double"}


def header_map(names: list[str]) -> dict[str, str] | None:
    """The file's name of each wanted column; None if a mandatory one is missing."""
    left, found = list(names), {}
    for want, fits, default in _COLUMNS:
        name = next((n for n in left if fits(n.lower())), None)
        if name is not None:
            left.remove(name)
            found[want] = name
        elif default is None:
            return None
    return found


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("sep", "\t").option("header", True).csv(path).columns


def headers(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, ...]]:
    """The column names of each file or folder; unreadable ones have none. Threads overlap the small reads."""

    def one(path: str) -> tuple[str, ...]:
        try:
            return tuple(_header(spark, path))
        except Exception:  # an unreadable file is reported, not fatal
            return ()

    with ThreadPoolExecutor(min(32, max(1, len(paths)))) as pool:
        return dict(zip(paths, pool.map(one, paths), strict=True))


def read_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of tab-separated files; ``scorefile`` is the file's folder or name.

    Files of one header are one scan; other headers, with columns in another order or
    missing, are further scans.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path, names in headers(spark, paths).items():
        by_header.setdefault(names, []).append(path)
    out = None
    for names, group in by_header.items():
        found = header_map(list(names))
        if found is None:
            raise ValueError(f"a mandatory column is missing in {group}")
        schema = ", ".join(f"`{n}` string" for n in names)
        raw = spark.read.option("sep", "\t").option("header", True).schema(schema).csv(group)
        columns = [(F.col(f"`{found[w]}`") if w in found else F.lit(d)).cast(_TYPES.get(w, "string")).alias(w) for w, _, d in _COLUMNS]
        part = raw.select(*columns, F.col("_metadata.file_path").alias("scorefile"))
        out = part if out is None else out.unionByName(part)
    return out


def sort_readable(spark: SparkSession, paths: list[str]) -> tuple[list[str], DataFrame]:
    """Paths with a sound header, sorted, and a table of the others; only headers are read."""
    names = headers(spark, sorted(paths))
    good = [p for p, h in names.items() if header_map(list(h))]
    return good, spark.createDataFrame([(p,) for p in names if p not in set(good)], "path string")


def read_bad_map(spark: SparkSession, path: str) -> DataFrame:
    """Intervals chrom, start, end, bad, or positions chrom, pos, bad, with ``map_order``.

    Column names: one that holds ``chr``, one that holds ``start``, one that holds ``end``
    if the map has intervals, and ``bad``, in any case. Rows keep the file's order: a later
    one overrides an earlier one.
    """
    names = _header(spark, path)
    pick = lambda fits: next((n for n in names if fits(n.lower())), None)
    chrom, start, end, bad = pick(lambda n: "chr" in n), pick(lambda n: "start" in n), pick(lambda n: "end" in n), pick(lambda n: n == "bad")
    if not (chrom and start and bad):
        raise ValueError(f"{path} has no columns chr, start and bad")
    rows = spark.read.option("sep", "\t").option("header", True).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    place = [F.col(f"`{start}`").cast("long").alias("start"), F.col(f"`{end}`").cast("long").alias("end")] if end else [F.col(f"`{start}`").cast("long").alias("pos")]
    return rows.select(F.col(f"`{chrom}`").alias("chrom"), *place, F.col(f"`{bad}`").cast("double").alias("bad"), order.alias("map_order"))


def resolve_inputs(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """file_id and path of the files that the patterns name, sorted by path, each once.

    ``m:`` begins a mask; a folder names its files but indexes (.tbi); a table of one
    column whose entries are paths is a list of files, relative to its own folder; any
    other file names itself.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: list[str] = []
    for pattern in patterns:
        mask = pattern.startswith("m:")
        at = jvm.org.apache.hadoop.fs.Path(pattern[2:] if mask else pattern)
        fs = at.getFileSystem(conf)
        if mask:
            found += [s.getPath().toString() for s in fs.globStatus(at) or []]
        elif not fs.exists(at):
            raise FileNotFoundError(pattern)
        elif fs.getFileStatus(at).isDirectory():
            found += [s.getPath().toString() for s in fs.listStatus(at) if s.isFile() and not s.getPath().getName().endswith(".tbi")]
        else:
            found += _listed(spark, fs, at) or [fs.getFileStatus(at).getPath().toString()]
    rows = [(i, p) for i, p in enumerate(sorted(set(found)))]
    return spark.createDataFrame(rows, "file_id int, path string")


def _listed(spark: SparkSession, fs, at) -> list[str]:
    """The paths that a list file holds; none if it is no list."""
    if at.getName().endswith((".gz", ".vcf", ".bam", ".bcf")):
        return []
    first = [r.value for r in spark.read.text(at.toString()).limit(2).collect()]
    if not first or any("\t" in line for line in first):
        return []
    whole = lambda line: spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), line.strip())
    if not fs.exists(whole(first[-1])):  # the first line may be a header
        return []
    lines = [r.value.strip() for r in spark.read.text(at.toString()).collect() if r.value.strip()]
    return [fs.getFileStatus(p).getPath().toString() for p in map(whole, lines) if fs.exists(p)]


def read_vcf(lines: DataFrame) -> DataFrame:
    """Records, one per line and sample, from lines ``value`` of variant call text (with ``scorefile``)."""
    rows = lines.where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t"))
    at = lambda i: F.get("f", F.lit(i))
    fields = F.split(at(8), ":")
    base = rows.select(
        at(0).alias("chrom"), (at(1).cast("long") - 1).alias("start"), at(2).alias("id"), at(3).alias("ref"), F.split(at(4), ",").alias("alts"), at(5).cast("double").alias("qual"),
        F.array_contains(F.split(at(7), ";"), "DB").alias("db"), F.array_position(fields, "GT").cast("int").alias("gt_at"), F.array_position(fields, "AD").cast("int").alias("ad_at"),
        F.posexplode(F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0)))).alias("sample", "s"), "scorefile",
    )
    part = lambda i: F.get(F.split("s", ":"), F.col(i) - 1)
    gt = F.transform(F.split(part("gt_at"), "[/|]"), lambda x: F.when(x != ".", x.cast("int")))
    return base.withColumn("gt", gt).withColumn("ad", F.transform(F.split(part("ad_at"), ","), lambda x: x.cast("int"))).withColumn("db", F.when(F.col("db"), True)).drop("gt_at", "ad_at", "s")
