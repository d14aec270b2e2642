"""Reading and writing: sensor logs, aligned trips, reports, calibrations, replay bundles and shared tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.angles import seconds_of_day

CALIBRATION = (
    "timestamp string, is_calibrated boolean, is_stand_calibrated boolean, is_mounting_aligned boolean, mounting_yaw_offset_deg double, "
    "gyro_bias_rad_s struct<gx:double,gy:double,gz:double>, resting_gravity_vector struct<x:double,y:double,z:double,magnitude:double>, "
    "rotation_matrix array<array<double>>"
)
REPORT_ROW = (
    "start long, end long, duration_s double, distance_m double, mean_speed_mps double, valid boolean, err_start_m double, "
    "err_end_m double, err_max_m double, drift_pct double, dr_fraction double, switch_latency_s double"
)


def shared_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that the cluster shares and read again, which cuts its lineage.

    The table goes when :func:`drop_table` is called or the driver's interpreter ends.
    """
    path = f"{shared_root(spark)}/driftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftline_path = path
    _tables.append(out)
    return out


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.split("[")[0] == "local":
        root = f"file://{tempfile.mkdtemp(prefix='driftline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    # the warehouse is shared by all executors too
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_driftline").rstrip("/")


_tables: list[DataFrame] = []
_folders: list[tuple[SparkSession, str]] = []


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver's interpreter ends."""
    _folders.append((spark, path))


@atexit.register
def _drop_tables() -> None:
    for df in _tables[:]:
        try:
            drop_table(df)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return
    for spark, path in _folders:
        try:
            drop_folder(spark, path)
        except Exception:  # noqa: BLE001  as above
            return


def drop_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`shared_table` that nothing reads any more."""
    path = getattr(df, "_driftline_path", None)
    if path:
        drop_folder(df.sparkSession, path)
        _tables[:] = [t for t in _tables if t is not df]


def read_log(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """A sensor log in CSV; names of columns are trimmed, values stay as texts and are cast by the caller."""
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    return raw.toDF(*[c.strip() for c in raw.columns])


def column_starting(df: DataFrame, prefix: str) -> str:
    """The first column whose name starts with ``prefix``."""
    found = next((c for c in df.columns if c.startswith(prefix)), None)
    if found is None:
        raise KeyError(f"no column starts with {prefix!r}")
    return found


def trip_folders(spark: SparkSession, root: str) -> DataFrame:
    """``folder, trip`` of the folders under ``root`` that hold both a phone log ``S-*.csv`` and a vehicle log ``V-*.csv``."""
    def listed(pattern: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        return files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()

    both = listed("S-*.csv").join(listed("V-*.csv"), "folder", "left_semi")
    return both.withColumn("trip", trip_name(F.col("folder"))).orderBy("folder")


def trip_name(folder: Column) -> Column:
    base = F.regexp_extract(folder, r"([^/]+)/?$", 1)
    base = F.regexp_replace(base, "%20", " ")
    return F.when(F.contains(folder, F.lit("Driver B")) | F.contains(folder, F.lit("Driver%20B")), "M").otherwise(base)


def write_trips(trips: DataFrame, path: str, key: str = "trip") -> None:
    trips.write.mode("overwrite").partitionBy(key).parquet(path)


def parse_logs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Phone and vehicle logs of all trips under ``root``, as ``operators.trips.prepare`` takes them.

    ``row`` is the place in the file, from the offset of its block and the order within, since files are read by line.
    """
    def rows(pattern: str) -> DataFrame:
        raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root)
        named = raw.toDF(*[c.strip() for c in raw.columns])
        path = F.col("_metadata.file_path")
        return named.select("*", trip_name(F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).alias("trip"), F.monotonically_increasing_id().alias("row"))

    phone, vehicle = rows("S-*.csv"), rows("V-*.csv")
    number = lambda d, c: F.col(f"`{column_starting(d, c)}`").cast("double")
    phone = phone.select(
        "trip", "row", seconds_of_day(F.trim(F.col("`DATE (YYYY-MO-DD HH-MI-SS_SSS)`"))).alias("t"),
        *[number(phone, f"ACCELEROMETER {c.upper()}").alias(f"a{c}") for c in "xyz"], *[number(phone, f"GYROSCOPE {c}").alias(f"g_{c.lower()}") for c in ("Yaw", "Roll", "Pitch")],
        number(phone, "GPS LATITUDE").alias("lat"), number(phone, "GPS LONGITUDE").alias("lon"), number(phone, "GPS SPEED").alias("kmh"),
        number(phone, "GPS ACCURACY").alias("accuracy"), number(phone, "GPS ORIENTATION").alias("bearing"),
    )
    vehicle = vehicle.select(
        "trip", "row", number(vehicle, "Time Since Start of Day").alias("t"), number(vehicle, "Yaw Rate").alias("yaw_deg"), number(vehicle, "Velocity").alias("kmh"),
        number(vehicle, "Latitude").alias("lat"), number(vehicle, "Longitude").alias("lon"), number(vehicle, "Heading").alias("heading"),
    )
    return phone, vehicle


def write_metadata(meta: DataFrame, path: str) -> None:
    """One line of JSON for each trip."""
    meta.write.mode("overwrite").json(path)


def read_trips(spark: SparkSession, path: str, trip: str | None = None) -> DataFrame:
    """Aligned trips; one trip reads its own partition only."""
    df = spark.read.parquet(path)
    return df if trip is None else df.where(F.col("trip") == trip)


def read_normalisation(spark: SparkSession, path: str) -> DataFrame:
    """One row of the normalisation contract: channel names, means, deviations, scalar scales, splits."""
    schema = (
        "version int, channel_names array<string>, mean array<double>, std array<double>, window_size int, sampling_rate_hz double, "
        "scalar_names array<string>, scalar_scale array<double>, t_since_ref_max_s double, stationary_speed_mps double, splits map<string,array<string>>, frame_convention string"
    )
    return spark.read.schema(schema).option("multiLine", True).json(path)


def calibration_problem(c: Column) -> Column:
    """Why a parsed calibration is not acceptable; null if it is."""
    bias = [c["gyro_bias_rad_s"][f] for f in ("gx", "gy", "gz")]
    gravity = [c["resting_gravity_vector"][f] for f in ("x", "y", "z")]
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    every = lambda cs, f: f(cs[0]) & f(cs[1]) & f(cs[2])
    size = F.sqrt(gravity[0] * gravity[0] + gravity[1] * gravity[1] + gravity[2] * gravity[2])
    return F.coalesce(
        F.when(c.isNull(), "not an object"),
        F.when(~F.coalesce(every(bias, finite), F.lit(False)), "gyro bias is not finite"),
        F.when(~F.coalesce(every(gravity, finite), F.lit(False)), "gravity is not finite"),
        F.when(~size.between(5.0, 15.0), "gravity is out of range"),
        F.when(~every(bias, lambda v: F.abs(v) < 0.5), "gyro bias is out of range"),
    )


def vertical_bias(c: Column) -> Column:
    """The gyro bias about the vertical: the bias projected on the resting gravity."""
    bias, gravity = c["gyro_bias_rad_s"], c["resting_gravity_vector"]
    size = F.sqrt(gravity["x"] * gravity["x"] + gravity["y"] * gravity["y"] + gravity["z"] * gravity["z"])
    return (bias["gx"] * gravity["x"] + bias["gy"] * gravity["y"] + bias["gz"] * gravity["z"]) / size


def report_rows(reports: DataFrame, report: str = "report", keep: tuple[str, ...] = ()) -> DataFrame:
    """``trip, scenario, config`` and the score columns of nested reports in JSON, after the columns to ``keep``.

    A report that is no JSON, or lacks a level, has no rows.
    """
    schema = f"struct<trips:map<string,map<string,map<string,struct<outages:array<struct<{REPORT_ROW.replace(' ', ':').replace(',:', ',')}>>>>>>>"
    parsed = reports.select(*keep, F.from_json(report, schema).alias("r"))
    rows = parsed.select(*keep, F.explode("r.trips").alias("trip", "a")).select(*keep, "trip", F.explode("a").alias("scenario", "b"))
    rows = rows.select(*keep, "trip", "scenario", F.explode("b").alias("config", "c")).select(*keep, "trip", "scenario", "config", F.explode("c.outages").alias("o"))
    return rows.select(*keep, "trip", "scenario", "config", "o.*")


def write_reports(reports: DataFrame, path: str) -> None:
    """Nested reports ``run, report`` as lines of text, a folder for each run; runs that are there already are replaced."""
    reports.select("run", "report").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``run, report`` of what :func:`write_reports` wrote; the folder's name is the run."""
    return spark.read.schema("report string, run string").text(path)


def nested_report(rows: DataFrame) -> DataFrame:
    """Flat scores as one JSON text for each trip, scenarios and configurations nested in it."""
    columns = [c for c in rows.columns if c not in ("trip", "scenario", "config")]
    outages = rows.groupBy("trip", "scenario", "config").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("outages"))
    configs = outages.groupBy("trip", "scenario").agg(F.map_from_entries(F.collect_list(F.struct("config", F.struct("outages")))).alias("configs"))
    scenarios = configs.groupBy("trip").agg(F.map_from_entries(F.collect_list(F.struct("scenario", "configs"))).alias("scenarios"))
    return scenarios.select("trip", F.to_json(F.struct(F.create_map("trip", "scenarios").alias("trips"))).alias("report"))


def markdown_rows(summary: DataFrame) -> DataFrame:
    """One line of a Markdown table for each summary row."""
    line = F.format_string("| %s | %d | %.1f | %.1f | %.0f %% |", "config", "n", "drift_pct_median", "drift_pct_p90", 100 * F.col("pass_rate_10pct"))
    return summary.select(line.alias("line"))


#: The columns of a report's table, and how their numbers are written: digits and what follows.
REPORT_COLUMNS = {
    "drift median": ("drift_pct_median", 1, " %"), "drift mean": ("drift_pct_mean", 1, " %"), "drift p90": ("drift_pct_p90", 1, " %"),
    "pass < 10 %": ("pass_rate_10pct", 0, "%"), "end error median": ("err_end_m_median", 1, " m"), "ms/frame": ("frame_latency_ms_mean", 2, ""),
}


def markdown_tables(summary: DataFrame, configs: dict[str, str] | None = None, scenarios: dict[str, str] | None = None) -> DataFrame:
    """``trip, scenario, position, line``: a Markdown table for each trip and scenario of a summary by configuration.

    A summary has ``trip, scenario, config, n`` and the columns of ``operators.outages.summarise``; one that it lacks, a
    null, and all numbers of a configuration without outages are dashes. Configurations are in order of their names
    (null first); ``configs`` and ``scenarios`` give labels in place of names. Halves are rounded away from zero.
    """
    labelled = lambda c, labels: F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col(c)], F.col(c)) if labels else F.col(c)

    def cell(name: str, digits: int, unit: str) -> Column:
        # a unit after a blank stands after a dash too
        dash = F.lit("–" + (unit if unit.startswith(" ") else ""))
        if name not in summary.columns:
            return F.lit("–")
        value = F.round((100 if name == "pass_rate_10pct" else 1) * F.col(name), digits)
        return F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, "–").when(value.isNull(), dash).otherwise(F.format_string(f"%.{digits}f{unit.replace('%', '%%')}", value))

    cells = [cell(*how) for how in REPORT_COLUMNS.values()]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.coalesce(labelled("config", configs), F.lit("–")), F.coalesce(F.col("n"), F.lit(0)).cast("string"), *cells), F.lit(" |"))
    title = F.concat(F.lit("**"), F.coalesce("trip", F.lit("–")), F.lit(" – "), F.coalesce(labelled("scenario", scenarios), F.lit("–")), F.lit("**"))
    head = F.lit("| Engine | n | " + " | ".join(REPORT_COLUMNS) + " |"), F.lit("|---|" + "---:|" * (len(REPORT_COLUMNS) + 1))
    rows = summary.withColumns({"trip": F.col("trip").cast("string"), "scenario": F.col("scenario").cast("string"), "config": F.col("config").cast("string")})
    rows = rows.groupBy("trip", "scenario").agg(F.array_sort(F.collect_list(F.struct(F.col("config").isNotNull().alias("named"), "config", line.alias("line")))).alias("lines"))
    lines = F.concat(F.array(title, *head), F.transform("lines", lambda x: x["line"]))
    return rows.select("trip", "scenario", F.posexplode(lines).alias("position", "line"))


def replay_bundle(frames: DataFrame, key: str, index: str, low: int, high: int, stride: int = 10) -> DataFrame:
    """Per trip the flat inertial list, the fixes and every ``stride``-th true position of a slice of frames."""
    part = frames.where(F.col(index).between(low, high - 1)).withColumn("_i", F.col(index) - low)
    imu = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.array(*[F.round(c, 4) for c in ("ax", "ay", "az", "gx", "gy", "gz")]).alias("v")))), lambda x: x["v"]))
    fixes = F.array_sort(F.collect_list(F.when(F.col("fix_lat").isNotNull(), F.struct("_i", "fix_lat", "fix_lon", "fix_speed", "fix_heading", "fix_accuracy"))))
    truth = F.array_sort(F.collect_list(F.when(F.col("_i") % stride == 0, F.struct("_i", "lat", "lon"))))
    return part.groupBy(key).agg(imu.alias("imu"), fixes.alias("gnss"), truth.alias("gt"))


def bundle_frames(bundles: DataFrame, key: str) -> DataFrame:
    """The frames of replay bundles: six values each of the flat list, with the fix of their index."""
    six = F.transform(F.sequence(F.lit(0), F.floor(F.size("imu") / 6).cast("int") - 1), lambda i: F.slice("imu", i * 6 + 1, 6))
    rows = bundles.select(key, F.posexplode(six).alias("idx", "v")).select(key, "idx", *[F.col("v")[i].alias(c) for i, c in enumerate(("ax", "ay", "az", "gx", "gy", "gz"))])
    fixes = bundles.select(key, F.explode("gnss").alias("f")).select(key, F.col("f._i").cast("int").alias("idx"), "f.fix_lat", "f.fix_lon", "f.fix_speed", "f.fix_heading", "f.fix_accuracy")
    return rows.join(fixes, [key, "idx"], "left")
