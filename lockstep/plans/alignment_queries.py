"""Registered queries of the alignment operators, with their SQL.

No table of the driver holds video. Events stand in for frames (a view is an event type, the order is time), conversations
for groups of numbered frames, parts for texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import align, manifest, presence
from ..operators.registry import FPS, registry
from ..sources import frames as frame_files
from . import extract

#: Stand-ins: event types with the offsets of the three views; the one with offset 0 is the reference.
STAND_INS = (("click", "click", 3), ("error", "error", 0), ("purchase", "purchase", 1))
REFERENCE, SIZE = "error", "360x288"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _views(spark: SparkSession) -> DataFrame:
    return registry(spark, STAND_INS)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    # renamed below the window, so that filters on the view reach the scan
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("view"), "event_id", "ts")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.number_frames(_frames(spark, sf_dir), ["ts", "event_id"]).drop("ts")


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    # views that aren't registered are dropped before numbering, which is per view
    own = _frames(spark, sf_dir).where(F.col("view").isin([v[0] for v in STAND_INS]))
    return align.trim(align.number_frames(own, ["ts", "event_id"]).drop("ts"), _views(spark))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.kept_counts(_frames(spark, sf_dir), _views(spark))


def frame_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select("view", "event_id", "n")


def offset_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("view", "event_id", "n")


def frame_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("view", "event_id", "frame_idx")


def frame_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("view", "frame_idx", text.frame_name(F.col("frame_idx")).alias("file_name"))


def frame_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("view", "frame_count")


def time_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", text.time_offset(F.col("turn"), FPS).alias("time_offset_sec"))


def alignment_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", text.note(F.col("turn"), REFERENCE).alias("notes"))


def _named_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # order keys have gaps, as frames of an extraction that broke off
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderpriority").alias("view"), text.frame_number(text.frame_name(F.col("o_orderkey"))).alias("frame_idx"))


def frame_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _named_orders(spark, sf_dir)
    return presence.gaps(presence.presence(named), named.groupBy("view").agg((F.max("frame_idx") + 100).alias("frame_count")))


def frame_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.runs(presence.presence(_named_orders(spark, sf_dir)))


def frames_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged from two listings, of which each has a part of the frames and some are in both."""
    named = _named_orders(spark, sf_dir)
    parts = [presence.presence(named.where(c)) for c in ("frame_idx % 3 < 2", "frame_idx % 3 > 0")]
    return presence.counts(presence.merged(*parts))


def frames_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as wanted frames of the order priorities, of which those go that are there."""
    wanted = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.element_at(F.array(*map(F.lit, PRIORITIES)), (F.col("event_id") % 5 + 1).cast("int")).alias("view"), F.col("event_id").alias("frame_idx"))
    return presence.missing(wanted, presence.presence(_named_orders(spark, sf_dir)))


def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_partkey", text.resolution(F.col("p_size"), F.col("p_partkey")).alias("resolution"))


def alignment_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.alignment(_counts(spark, sf_dir), F.lit(SIZE), REFERENCE)


def inspection_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    probe = F.format_string("codec_name=%s\nwidth=%d\nheight=288\nr_frame_rate=25/1", "p_type", "p_size")
    return manifest.parse_probe(parts.select("p_partkey", probe.alias("text"))).drop("text")


def existing_frame_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n") % 7 == 0, F.format_string("tmp_%d.jpg", "n")).otherwise(text.frame_name(F.col("n")))
    files = _numbered(spark, sf_dir).withColumn("file_name", name)
    return align.frame_counts(files, _views(spark), text.is_frame_name(F.col("file_name"))).select("view", "frame_count")


def extract_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    # stand-in for what is on disk: groups above 1990 rows count as extracted, a source with offset 1 as missing
    counts = _counts(spark, sf_dir).withColumn("frame_count", F.greatest(F.col("frame_count") - 1990, F.lit(0)))
    return extract.actions(counts, F.col("offset") != 1).select("view", "action")


def probe_last_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    # blanks around the whole, lines of every kind of end, lines without a value, and keys that come twice
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    probe = F.format_string(" \t\r\ncodec_name=%s\r\nwidth=%d\nheight=1\rnb_frames\nheight=%d\nwidth=%d=x \n ", "p_type", "p_size", "p_size", "p_partkey")
    return manifest.parse_probe(parts.select("p_partkey", probe.alias("text"))).select("p_partkey", "codec_name", "width", "height", "nb_frames")


def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each part a view with a size of its own: the reference's is on every row
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("view"), F.col("p_size").cast("string").alias("width"), F.lit("288").alias("height"))
    return parts.select("view").crossJoin(F.broadcast(manifest.reference_resolution(parts, "7")))


def frame_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # names as a listing gives them, in folders of views: what counts as a frame, and its number
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("frameX"), F.col("turn"), F.lit(".jpg"))).otherwise(text.frame_name(F.col("turn")))
    listed = frame_files.listed(turns.select(F.concat(F.lit("file:/data/view"), F.col("conv_id"), F.lit("/"), name).alias("path"), F.length("text").cast("long").alias("length")))
    return listed.select("view", "file_name", text.frame_number(F.col("file_name")).alias("n"), "length")


def group_offset_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    return align.trim_groups(turns, "conv_id", "turn", F.col("conv_id") % 4).select("conv_id", "turn", "frame_idx")


def aligned_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(_kept(spark, sf_dir), [v[0] for v in STAND_INS], "event_id", "id")


def aligned_views_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned_full(_kept(spark, sf_dir), [v[0] for v in STAND_INS], "event_id", "id")


def manifest_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("view")).agg(F.count("*").alias("nb_frames"))
    header = frames.withColumn("duration_sec", F.lit("")).withColumn("r_frame_rate", F.lit("25/1"))
    checked = manifest.consistency(header, _counts(spark, sf_dir))
    return checked.select("view", "nb_frames", "frame_offset", "frame_count", "consistent")


def manifest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment manifest's lines in the registry's order, here of views by falling offset."""
    views = registry(spark, sorted(STAND_INS, key=lambda v: -v[2]))
    counts = align.kept_counts(_frames(spark, sf_dir), views)
    lines = manifest.alignment(counts, F.lit(SIZE), REFERENCE).coalesce(1)
    return lines.select((F.monotonically_increasing_id() + 1).alias("line"), "view", "frame_count")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        frame_numbering, offset_trim, frame_reindex, frame_file_name, frame_count, time_offset, alignment_note, resolution, alignment_manifest,
        inspection_manifest, existing_frame_count, extract_action, group_offset_trim, aligned_views, aligned_views_full, manifest_consistency,
        probe_last_key, reference_resolution, frame_listing, frame_gaps, frame_runs, frames_present, frames_missing, manifest_order,
    )
}

_CTES = """
WITH views AS (SELECT view, CAST(off AS INT) AS off FROM (VALUES ('click', 3), ('error', 0), ('purchase', 1)) t(view, off)),
numbered AS (
  SELECT event_type AS view, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS n FROM events),
kept AS (
  SELECT a.view, a.event_id, a.n, CAST(a.n - v.off AS BIGINT) AS frame_idx FROM numbered a JOIN views v ON a.view = v.view WHERE a.n >= v.off),
counts AS (
  SELECT v.view, v.off, count(k.event_id) AS frame_count FROM views v LEFT JOIN kept k ON v.view = k.view GROUP BY v.view, v.off)
"""
_TIME = "round_even(off / CAST(25.0 AS DOUBLE), 4) AS time_offset_sec"
_NOTE = "CASE WHEN off = 0 THEN 'Reference view' ELSE 'Aligned to error (reference); offset +' || CAST(off AS VARCHAR) || ' frames' END AS notes"
_PICKS = "max(CASE WHEN view = 'click' THEN event_id END) AS click_id, max(CASE WHEN view = 'error' THEN event_id END) AS error_id, max(CASE WHEN view = 'purchase' THEN event_id END) AS purchase_id"

ORACLES: dict[str, str] = {
    "frame_numbering": f"{_CTES} SELECT view, event_id, n FROM numbered",
    "offset_trim": f"{_CTES} SELECT view, event_id, n FROM kept",
    "frame_reindex": f"{_CTES} SELECT view, event_id, frame_idx FROM kept",
    "frame_file_name": f"{_CTES} SELECT view, frame_idx, printf('frame_%04d.jpg', frame_idx) AS file_name FROM kept",
    "frame_count": f"{_CTES} SELECT view, frame_count FROM counts",
    "time_offset": "SELECT conv_id, turn, round_even(turn / CAST(25.0 AS DOUBLE), 4) AS time_offset_sec FROM conversations",
    "alignment_note": "SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'Reference view' ELSE 'Aligned to error (reference); offset +' || CAST(turn AS VARCHAR) || ' frames' END AS notes FROM conversations",
    "frame_gaps": """
        WITH named AS (SELECT DISTINCT o_orderpriority AS view, o_orderkey AS k FROM orders),
        edges AS (SELECT view, k, false AS past FROM named UNION ALL SELECT view, -1, false FROM named GROUP BY view UNION ALL SELECT view, max(k) + 100, true FROM named GROUP BY view),
        pairs AS (SELECT view, k, lead(k) OVER (PARTITION BY view ORDER BY k) AS next FROM edges)
        SELECT view, k + 1 AS first, next - 1 AS last FROM pairs WHERE next > k + 1""",
    "frame_runs": """
        WITH named AS (SELECT DISTINCT o_orderpriority AS view, o_orderkey AS k FROM orders),
        placed AS (SELECT view, k, k - row_number() OVER (PARTITION BY view ORDER BY k) AS run FROM named)
        SELECT view, min(k) AS first, max(k) AS last FROM placed GROUP BY view, run""",
    "frames_present": "SELECT o_orderpriority AS view, count(DISTINCT o_orderkey) AS frame_count FROM orders GROUP BY o_orderpriority",
    "manifest_order": f"{_CTES} SELECT row_number() OVER (ORDER BY off DESC) AS line, view, frame_count FROM counts",
    "frames_missing": """
        WITH wanted AS (SELECT (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[CAST(event_id % 5 + 1 AS INT)] AS view, event_id AS frame_idx FROM events)
        SELECT view, frame_idx FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = w.view AND o.o_orderkey = w.frame_idx)""",
    "resolution": "SELECT p_partkey, CAST(p_size AS VARCHAR) || 'x' || CAST(p_partkey AS VARCHAR) AS resolution FROM part",
    "alignment_manifest": f"{_CTES} SELECT view, CAST(25.0 AS DOUBLE) AS fps, off AS frame_offset, {_TIME}, '{SIZE}' AS resolution, frame_count, {_NOTE} FROM counts",
    "inspection_manifest": r"""
        WITH probe AS (SELECT p_partkey, 'codec_name=' || p_type || chr(10) || 'width=' || p_size || chr(10) || 'height=288' || chr(10) || 'r_frame_rate=25/1' AS t FROM part)
        SELECT p_partkey, regexp_extract(t, '(?m)^codec_name=(.*)$', 1) AS codec_name, regexp_extract(t, '(?m)^width=(.*)$', 1) AS width,
          regexp_extract(t, '(?m)^height=(.*)$', 1) AS height, regexp_extract(t, '(?m)^r_frame_rate=(.*)$', 1) AS r_frame_rate,
          regexp_extract(t, '(?m)^duration=(.*)$', 1) AS duration_sec, regexp_extract(t, '(?m)^nb_frames=(.*)$', 1) AS nb_frames FROM probe""",
    "existing_frame_count": rf"""{_CTES}, files AS (
          SELECT view, CASE WHEN n % 7 = 0 THEN printf('tmp_%d.jpg', n) ELSE printf('frame_%04d.jpg', n) END AS name FROM numbered)
        SELECT v.view, count(f.name) AS frame_count FROM views v LEFT JOIN files f ON v.view = f.view AND f.name LIKE 'frame\_%.jpg' ESCAPE '\' GROUP BY v.view""",
    "extract_action": f"{_CTES} SELECT view, CASE WHEN frame_count > 1990 THEN 'skip' WHEN off = 1 THEN 'error_missing_source' ELSE 'extract' END AS action FROM counts",
    "group_offset_trim": "SELECT conv_id, turn, CAST(turn - conv_id % 4 AS BIGINT) AS frame_idx FROM conversations WHERE turn >= conv_id % 4",
    "probe_last_key": r"""
        WITH probe AS (
          SELECT p_partkey, ' ' || chr(9) || chr(13) || chr(10) || 'codec_name=' || p_type || chr(13) || chr(10) || 'width=' || p_size || chr(10) || 'height=1' || chr(13) || 'nb_frames' || chr(10)
            || 'height=' || p_size || chr(10) || 'width=' || p_partkey || '=x ' || chr(10) || ' ' AS t FROM part),
        split AS (SELECT p_partkey, string_split_regex(trim(t, ' ' || chr(9) || chr(10) || chr(13)), '\r\n|[\n\r]') AS l FROM probe),
        last AS (SELECT p_partkey, k, list_filter(l, lambda x: x = k OR starts_with(x, k || '='))[-1] AS line FROM split, unnest(['codec_name', 'width', 'height', 'nb_frames']) u(k))
        SELECT p_partkey, max(CASE WHEN k = 'codec_name' THEN substr(line, 12) END) AS codec_name, max(CASE WHEN k = 'width' THEN substr(line, 7) END) AS width,
          max(CASE WHEN k = 'height' THEN substr(line, 8) END) AS height, max(CASE WHEN k = 'nb_frames' THEN substr(line, 11) END) AS nb_frames FROM last GROUP BY p_partkey""",
    "reference_resolution": "SELECT CAST(p_partkey AS VARCHAR) AS view, (SELECT CAST(p_size AS VARCHAR) || 'x288' FROM part WHERE p_partkey = 7) AS resolution FROM part",
    "frame_listing": r"""SELECT 'view' || conv_id AS view, printf('frame_%04d.jpg', turn) AS file_name, turn AS n, CAST(length(text) AS BIGINT) AS length FROM conversations WHERE turn % 3 <> 0""",
    "aligned_views": f"{_CTES} SELECT c.frame_idx, c.event_id AS click_id, e.event_id AS error_id, p.event_id AS purchase_id FROM kept c JOIN kept e ON c.frame_idx = e.frame_idx AND e.view = 'error' JOIN kept p ON c.frame_idx = p.frame_idx AND p.view = 'purchase' WHERE c.view = 'click'",
    "aligned_views_full": f"{_CTES} SELECT frame_idx, {_PICKS} FROM kept GROUP BY frame_idx",
    "manifest_consistency": f"{_CTES}, nb AS (SELECT event_type AS view, count(*) AS nb_frames FROM events GROUP BY event_type) SELECT c.view, nb.nb_frames, c.off AS frame_offset, c.frame_count, nb.nb_frames - c.off = c.frame_count AS consistent FROM counts c JOIN nb ON c.view = nb.view",
}
