"""A pipeline's options, what they imply, and the DataFrame that they make (CFG01-CFG11, SRC16, SRC17)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import suggest
from ..functions.rates import check_trim, rationalise, trim_end, trim_start
from ..operators import cuts, dedup, resample
from ..operators.clips import with_position

#: Dispatch order: the first that is on runs, and only that one (CFG01).
PRIORITY = ("autoclip", "depth", "segment", "detect", "stabilize", "motion_blur")
#: An option that turns on the capability it belongs to (CFG06).
IMPLIES = {
    "interpolate_method": "interpolate",
    "interpolate_factor": "interpolate",
    "upscale_method": "upscale",
    "upscale_factor": "upscale",
    "dedup_method": "dedup",
    "dedup_sens": "dedup",
    "smooth_dedup_method": "smooth_dedup",
    "smooth_dedup_sens": "smooth_dedup",
    "smooth_dedup_max_span": "smooth_dedup",
    "restore_method": "restore",
    "segment_method": "segment",
    "stabilize_method": "stabilize",
    "depth_method": "depth",
    "obj_detect_method": "obj_detect",
    "resize_factor": "resize",
    "moblur_method": "moblur",
    "moblur_factor": "moblur",
    "moblur_strength": "moblur",
    "moblur_shutter_angle": "moblur",
}


def dedup_threshold(method: str, sensitivity: float) -> float:
    """CFG02."""
    if method.startswith("ssim"):
        return 1 - sensitivity / 1000
    if method.startswith("vmaf"):
        return 100 - sensitivity / 10
    return sensitivity / 100 if method.startswith("flownet") else sensitivity


def cut_threshold(method: str, sensitivity: float) -> float:
    """CFG03."""
    if method.startswith("ssim"):
        return sensitivity / 100
    return (100 - sensitivity) * 50 if method.startswith("mse") else 1 - sensitivity / 100


def job_thresholds(method: Column, sensitivity: Column) -> tuple[Column, Column]:
    """The dedup and cut thresholds of many jobs, each with its own method and sensitivity (CFG02, CFG03)."""
    kind, s = F.lower(method), sensitivity.cast("double")
    dedup = F.when(kind.startswith("ssim"), 1 - s / 1000).when(kind.startswith("vmaf"), 100 - s / 10).when(kind.startswith("flownet"), s / 100).otherwise(s)
    return dedup, F.when(kind.startswith("ssim"), s / 100).when(kind.startswith("mse"), (100 - s) * 50).otherwise(1 - s / 100)


def job_options(text: Column, schema: str) -> Column:
    """The options of a job from its JSON text, null where it isn't any; unknown ones are left out (SRC16)."""
    return F.from_json(text, schema)


def autoclip_threshold(method: str, sensitivity: float) -> float:
    """CFG04."""
    return max(0.5, 3 * (100 - sensitivity) / 50) if method == "adaptive" else 1 - sensitivity / 100


@dataclass(frozen=True)
class Pipeline:
    """Options of a run over one table of clips."""

    clip: str
    order: tuple[str, ...]
    payload: str
    dedup: str | None = None
    dedup_sens: float = 35.0
    smooth_dedup: bool = False
    max_span: int = 6
    scene_change: str | None = None
    scene_sens: float = 50.0
    interpolate: bool = False
    factor: float = 2.0
    in_sec: float = 0.0
    out_sec: float = 0.0
    fps: float = 0.0

    def normalised(self) -> Pipeline:
        """What the options imply: smooth dedup interpolates (CFG05), cuts matter to interpolation only, nothing on is an error (CFG10)."""
        check_trim(self.in_sec, self.out_sec)
        rationalise(self.factor)
        spec = self
        if spec.smooth_dedup:
            spec = replace(spec, interpolate=True, dedup=spec.dedup or "ssim")
        if spec.scene_change and not spec.interpolate:
            spec = replace(spec, scene_change=None)
        if spec.dedup and spec.dedup not in dedup.METHODS:
            raise ValueError(f"unknown method {spec.dedup}; near it: {', '.join(suggest(spec.dedup, list(dedup.METHODS)))}")
        if not (spec.dedup or spec.interpolate or spec.out_sec or spec.in_sec):
            raise ValueError("no operation is on")
        return spec

    def run(self, df: DataFrame) -> DataFrame:
        """Trim, dedup, cuts, resampling, as far as they are on; (clip, slot, kind, value) if resampled."""
        spec = self.normalised()
        rows = with_position(df, spec.clip, list(spec.order))
        if spec.in_sec or spec.out_sec:
            fps = F.lit(float(spec.fps or 1.0))
            start, end = trim_start(fps, spec.in_sec), trim_end(fps, spec.in_sec, spec.out_sec)
            rows = rows.filter((F.col("pos") - 1 >= start) & (end.isNull() | (F.col("pos") - 1 < end)))
            rows = with_position(rows.withColumnRenamed("pos", "_source"), spec.clip, ["_source"]).drop("_source")
        rows = rows.select(spec.clip, "pos", spec.payload)
        tail = None
        if spec.dedup:
            marked = dedup.mark_repeats(rows, spec.clip, ["pos"], spec.payload, spec.dedup, dedup_threshold(spec.dedup, spec.dedup_sens))
            rows = marked.filter("kept").drop("kept")
            if spec.smooth_dedup:
                tail = dedup.trailing_repeats(marked, spec.clip)
            elif spec.interpolate:  # gaps stay one wide (INT06)
                rows = with_position(rows.withColumnRenamed("pos", "_source"), spec.clip, ["_source"]).drop("_source")
        if spec.scene_change:
            method = spec.scene_change
            if not dict(rows.dtypes)[spec.payload].startswith("array"):
                if method != "mse":
                    raise ValueError(f"numbers have no {method}; cuts between them are by mse")
                method = "squared"
            rows = cuts.mark_cuts(rows, spec.clip, ["pos"], spec.payload, method, cut_threshold(spec.scene_change, spec.scene_sens))
        if not spec.interpolate:
            return rows
        n, d = rationalise(spec.factor)
        span = spec.max_span if spec.smooth_dedup else 0
        return resample.interpolate(rows, spec.clip, "pos", spec.payload, n, d, "is_cut" if spec.scene_change else None, span, tail)


def capability(options: dict[str, bool]) -> str:
    """Which of the exclusive capabilities runs; the frame loop if none is on (CFG01)."""
    return next((name for name in PRIORITY if options.get(name)), "frames")


#: What these options are where nobody gives them (CFG06).
DEFAULTS = {
    "interpolate_method": "rife4.6",
    "interpolate_factor": 2.0,
    "upscale_method": "shufflecugan",
    "upscale_factor": 2,
    "dedup_method": "ssim",
    "dedup_sens": 35.0,
    "smooth_dedup_method": "ssim",
    "smooth_dedup_sens": 35.0,
    "smooth_dedup_max_span": 6,
    "restore_method": ["anime1080fixer"],
    "segment_method": "anime",
    "stabilize_method": "classic",
    "depth_method": "small_v2",
    "obj_detect_method": "yolov9_small-directml",
    "resize_factor": 2,
    "moblur_method": "rife4.25",
    "moblur_factor": 8,
    "moblur_strength": "gaussian_sym",
    "moblur_shutter_angle": 180.0,
}


def with_implied(options: dict, given: set[str] | None = None) -> dict:
    """Options with the capabilities that they turn on (CFG06).

    given: the options that somebody gave, all of them if not told; the others turn something on only if they differ from their default. A capability that
    was given as false stays off.
    """
    given, out = set(options) if given is None else given, dict(options)
    for name, value in options.items():
        parent = IMPLIES.get(name)
        if parent and not (parent in given and not options.get(parent)) and (name in given or value != DEFAULTS[name]):
            out[parent] = True
    return out


def job_capabilities(options: Column) -> Column:
    """The capabilities, in order of their names, that a job's options (a map of texts, all given) turn on, or were given as true (CFG06)."""
    parents = F.create_map(*(F.lit(x) for pair in IMPLIES.items() for x in pair))
    own = F.map_keys(F.map_filter(options, lambda k, v: F.array_contains(F.array(*map(F.lit, sorted(set(IMPLIES.values())))), k) & (F.lower(v) == "true")))
    implied = F.filter(F.transform(F.map_keys(options), lambda k: F.try_element_at(parents, k)), lambda p: p.isNotNull() & ~F.coalesce(F.lower(F.try_element_at(options, p)) == "false", F.lit(False)))
    return F.array_sort(F.array_distinct(F.concat(own, implied)))


def unknown_options(options: Column, known: list[str]) -> Column:
    """The options of a job that nobody knows, in order (SET04)."""
    return F.array_sort(F.array_except(F.map_keys(options), F.array(*map(F.lit, known))))


#: Suffixes of a method's variants, the first that is there first; interpolation has its own order.
FALL_BACKS = {"": ("-directml", "-ncnn"), "interpolate": ("-ncnn", "-directml")}


def fall_back(name: str, available: set[str], capability: str = "") -> str:
    """A method's variant by the first suffix that is available, or its own name (CFG08)."""
    return next((v for s in FALL_BACKS.get(capability, FALL_BACKS[""]) if (v := f"{name.lower()}{s}") in available), name)


def load_spec(text: str, **explicit) -> Pipeline:
    """A pipeline from JSON; explicit options win over it, unknown ones are an error with suggestions (SRC16, SRC17)."""
    known = {f.name for f in fields(Pipeline)}
    options = json.loads(text) | explicit
    for name in options:
        if name not in known:
            raise ValueError(f"unknown option {name}; near it: {', '.join(suggest(name, sorted(known))) or 'none'}")
    if "order" in options:
        options["order"] = tuple(options["order"])
    return Pipeline(**options)


def dump_spec(spec: Pipeline) -> str:
    """JSON without the trim, which belongs to an input (SRC17)."""
    return json.dumps({k: v for k, v in asdict(spec).items() if k not in ("in_sec", "out_sec")}, sort_keys=True)
