"""The two programs: inspecting the sources, and extracting aligned frames with skip, force and metadata-only modes.

All views are one DataFrame, parallel by file and by parts of a file. Manifests are written last, after every view succeeded, in one action
each. An existing frame count above 0 skips a view unless force is given; a view's folder may exist and
be empty. With force, new frames are written beside the old ones and take their place in one commit: none is counted that the offset has
dropped, and a job that fails leaves the old ones.
"""

from __future__ import annotations

import argparse
import json
import logging
import shlex
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import frame_number
from ..operators import align, manifest, presence
from ..operators.registry import REFERENCE, registry
from ..sources import frames as frame_files
from ..sources import datasource, video
from ..sources.config import Roots, roots

log = logging.getLogger("lockstep")


def actions(counts: DataFrame, sources_present, force: bool = False, broken: Sequence[str] = ()) -> DataFrame:
    """counts (view, frame_count, ...) with action: skip, extract, or error_missing_source. Skipping is tested first.

    sources_present: a column that says whether a view's source is there; broken: views that are not skipped.
    """
    skip = (F.col("frame_count") > 0) & ~F.lit(force) & ~F.col("view").isin(*broken, "")
    return counts.withColumn("action", F.when(skip, "skip").when(~sources_present, "error_missing_source").otherwise("extract"))


def unfinished(spark: SparkSession, at: Roots, views: DataFrame, counts: DataFrame) -> list[str]:
    """The views whose frames are not as many as their headers and offsets say."""
    own = counts.join(views.select("view"), "view", "left_semi")
    checked = manifest.consistency(manifest.inspection(video.headers(spark, views, at.raw_videos), views), own)
    return [r["view"] for r in checked.where("NOT coalesce(consistent, false)").collect()]  # a row per view at most


def present(spark: SparkSession, at: Roots) -> DataFrame:
    """The presence index of the frames on disk."""
    return presence.presence(frame_files.list_frames(spark, at.data).withColumn("frame_idx", frame_number(F.col("file_name"))))


def states(wanted: DataFrame, index: DataFrame, counts: DataFrame) -> dict[str, str]:
    """By view: whole, missing (some of wanted (view, frame_idx) aren't there), or stale (others are there too)."""
    expected = counts.join(wanted.groupBy("view").agg(F.count("*").alias("__n")), "view", "left").select("view", "frame_count", F.coalesce("__n", F.lit(0)).alias("n"))
    open_ = presence.gaps(index, expected.select("view", F.col("n").alias("frame_count"))).groupBy("view").agg(F.sum(F.expr("last - first + 1")).alias("gone"))
    both = expected.join(open_, "view", "left").fillna(0, ["gone"])
    state = F.when(F.col("frame_count") > F.col("n") - F.col("gone"), "stale").when(F.col("gone") > 0, "missing").otherwise("whole")
    return {r["view"]: r["state"] for r in both.select("view", state.alias("state")).collect()}  # a row per view


def inspect(spark: SparkSession, at: Roots, views: DataFrame, to: str) -> DataFrame:
    """Header fields of all sources, written as the inspection manifest."""
    found = manifest.inspection(video.headers(spark, views, at.raw_videos), views)
    manifest.write_manifest(found, to)
    return manifest.read_manifest(spark, to, manifest.INSPECTION)


def extract(spark: SparkSession, at: Roots, views: DataFrame, to: str, reference: str = REFERENCE, force: bool = False,
            metadata_only: bool = False, decode: video.Decoder = video.read_frames, complete: bool = False, by_key: bool = False) -> DataFrame:
    """Extract what has to be, count what is there, and write the alignment manifest; returns it as read back.

    With complete, a view is skipped only if its mark, or else its file's index, says that it has all its frames; of an extraction that broke
    off, just the frames that are missing are made, and frames that don't belong there go. With a decoder such a view is made anew. Without complete, any frame
    will do.
    """
    datasource.register(spark)
    for folder in (at.logs, at.data):
        frame_files.make_folder(spark, folder)
    rows = views.collect()  # a row per view
    # the reference view's size is asked for first, in every mode
    only = views.where(F.col("view") == reference)
    size = manifest.reference_resolution(manifest.inspection(video.headers(spark, only, at.raw_videos), only), reference)
    size = size.first()["resolution"]
    if not metadata_only:
        have = align.frame_counts(frame_files.list_frames(spark, at.data), views)
        found = {r["view"]: frame_files.exists(spark, at.source(r["source"])) for r in rows}
        there = F.col("view").isin([v for v, yes in found.items() if yes] or [""])
        native = decode is video.read_frames
        state: dict[str, str] = {}
        if complete and not force:
            held = {r["view"]: r["frame_count"] for r in have.collect()}
            sure = [r["view"] for r in rows if held[r["view"]] and datasource.promised(at.frames(r["view"])) == {"frames": held[r["view"]], "note": r["offset"]}]
            open_ = views.where(there & ~F.col("view").isin([*sure, ""]))
            if native and not open_.isEmpty():
                state = states(align.trim(video.entries(spark, open_, at.raw_videos), open_), present(spark, at), have.join(open_.select("view"), "view", "left_semi"))
            elif not open_.isEmpty():
                state = dict.fromkeys(unfinished(spark, at, open_, have), "stale")
        broken = [v for v, what in state.items() if what != "whole"]
        todo = {r["view"]: (r["action"], r["frame_count"]) for r in actions(have, there, force, broken).collect()}
        missing = [v for v, (what, _) in todo.items() if what == "error_missing_source"]
        if missing:
            raise FileNotFoundError(f"no source video for {', '.join(missing)}")
        for view, (what, count) in todo.items():
            log.info("%s: %s (%d frames present)", view, what, count)
        chosen = [v for v, (what, _) in todo.items() if what == "extract"]
        part = [v for v in chosen if state.get(v) == "missing" and todo[v][1]]
        for mode, own in (("overwrite", [v for v in chosen if v not in part]), ("append", part)):
            if own:
                some = views.where(F.col("view").isin(own))
                if mode == "append":
                    gone = presence.missing(align.trim(video.entries(spark, some, at.raw_videos), some), present(spark, at))
                    kept = align.trim(video.frames(spark, some, at.raw_videos, only=gone.select("view", "n")), some)
                else:
                    kept = align.trim(video.frames(spark, some, at.raw_videos, decode, trimmed=True, by_key=by_key), some)
                notes = json.dumps({r["view"]: r["offset"] for r in rows if r["view"] in own})
                kept.select("view", "frame_idx", "image").write.format("frame_files").option("views", notes).mode(mode).save(at.data)
    counts = align.frame_counts(frame_files.list_frames(spark, at.data), views)
    manifest.write_manifest(manifest.alignment(counts, F.lit(size), reference), to)
    return manifest.read_manifest(spark, to, manifest.ALIGNMENT)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lockstep", description="Inspect videos, or extract frames that are aligned across views.")
    parser.add_argument("program", choices=["probe", "extract"])
    parser.add_argument("--root", help="project folder; DRIVE_ROOT of the environment if not given")
    parser.add_argument("--manifests", default="data_manifests")
    parser.add_argument("--force", action="store_true", help="extract again where frames are present")
    parser.add_argument("--metadata-only", action="store_true", help="count frames and write the manifest, nothing else")
    parser.add_argument("--complete", action="store_true", help="skip only views that have all their frames, and make the frames that are missing")
    parser.add_argument("--by-key", action="store_true", help="decode a video by several tasks, from key frame to key frame; for streams whose frames refer to nothing before the last key frame")
    parser.add_argument("--decoder", help="a command on the executors that reads a video and writes its frames as JPEG images, for codecs other than Motion JPEG: ffmpeg -i pipe:0 -f image2pipe -c:v mjpeg -vsync 0 pipe:1")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="[%(levelname)s] %(message)s")
    spark = SparkSession.builder.appName("lockstep").getOrCreate()
    views, at = registry(spark), roots(given.root)
    if given.program == "probe":
        done = inspect(spark, at, views, f"{given.manifests}/video_inspection.csv")
    else:
        decode = video.external_decoder(shlex.split(given.decoder)) if given.decoder else video.read_frames
        done = extract(spark, at, views, f"{given.manifests}/metadata.csv", force=given.force, metadata_only=given.metadata_only, decode=decode, complete=given.complete, by_key=given.by_key)
    done.show(truncate=False)
    if given.program == "extract" and not given.metadata_only:
        log.info("done; check by eye that frames of one number show one instant in all views")


if __name__ == "__main__":
    main()
