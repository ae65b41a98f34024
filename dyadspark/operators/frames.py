"""Post-processing of detections, keypoints, probabilities, depths, flows and tracks: rows a frame in, a row a recording out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadspark.functions.columns import clip, normalized_entropy

#: Action units as slope times (first minus second) region intensity; None stands for 0.
ACTION_UNITS = {
    "AU1": ("eye", "mean", 2.0), "AU2": ("eye", "mean", 1.8), "AU4": ("mean", "eye", 1.5), "AU5": ("eye", None, 1.2), "AU6": ("cheek", None, 1.3), "AU7": ("mean", "eye", 1.1), "AU9": ("std", None, 0.8), "AU10": ("mouth", "mean", 1.4), "AU12": ("mouth", None, 1.5),
    "AU14": ("cheek", None, 1.1), "AU15": ("mean", "mouth", 1.2), "AU17": ("mouth", None, 0.9), "AU20": ("mouth", None, 1.1), "AU23": ("mean", "mouth", 0.8), "AU25": ("mouth", None, 1.3), "AU26": ("mouth", None, 1.4), "AU45": ("mean", "eye", 1.0),
}


def frame_means(frames: DataFrame, within: list[str], columns: list[str]) -> DataFrame:
    """Mean over frames of each column, missing counted as 0."""
    return frames.groupBy(*within).agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in columns])


def detection_rate(points: DataFrame, within: list[str], frame: str, score: str, threshold: float) -> DataFrame:
    """Share and number of frames with a point over the threshold, mean and most such points a frame."""
    per = points.groupBy(*within, frame).agg(F.count_if(F.col(score) > threshold).alias("n"))
    return per.groupBy(*within).agg(F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)).alias("detection_rate"), F.count_if(F.col("n") > 0).alias("frames_detected"), F.avg("n").alias("avg_active"), F.max("n").alias("max_active"))


def best_row(rows: DataFrame, within: list[str], by: list[Column]) -> DataFrame:
    """The first row of each group in the given order: largest face, most central face, best instance, heatmap peak."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where("__k = 1").drop("__k")


def central_distance(x: Column, width: Column, image_width: Column) -> Column:
    return F.abs(x + width / 2 - image_width / 2)


def action_units(mean: Column, std: Column, eye: Column, mouth: Column, cheek: Column) -> Column:
    """Map of each action unit to its activation, 0 to 1, by linear rules on region intensities."""
    of = {"mean": mean, "std": std, "eye": eye, "mouth": mouth, "cheek": cheek}
    items = []
    for name, (plus, minus, slope) in ACTION_UNITS.items():
        items += [F.lit(name), clip((of[plus] - of[minus] if minus else of[plus]) * slope, 0.0, 1.0)]
    return F.create_map(*items)


def intensity_levels(activation: Column) -> Column:
    """Weights of the levels 0, 33, 66 and 99."""
    a = activation
    level = lambda *v: F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in v])
    low, mid, high, top = (a - k for k in (0.0, 0.25, 0.5, 0.75))
    return F.when(a < 0.25, level(1 - low * 2, low * 2, 0, 0)).when(a < 0.5, level(0, 1 - mid * 4, mid * 4, 0)).when(a < 0.75, level(0, 0, 1 - high * 4, high * 4)).otherwise(level(0, 0, 1 - top * 4, top * 4))


def part_means(points: DataFrame, parts: DataFrame, within: list[str], score: str, least: float = 0.1) -> DataFrame:
    """Mean score of each body part's joints; parts: part, joint."""
    return points.join(parts, "joint").groupBy(*within, "part").agg(F.avg(score).alias("confidence")).withColumn("counted", F.col("confidence") > least)


def confidence_bands(points: DataFrame, within: list[str], score: str) -> DataFrame:
    """Mean score, shares over 0.5 and 0.75, means of the middle (0.3, 0.7] and upper band."""
    s = F.col(score)
    return points.groupBy(*within).agg(
        F.avg(s).alias("AP"), F.avg((s > 0.5).cast("double")).alias("AP_50"), F.avg((s > 0.75).cast("double")).alias("AP_75"), F.coalesce(F.avg(F.when((s > 0.3) & (s <= 0.7), s)), F.lit(0.0)).alias("AP_M"), F.coalesce(F.avg(F.when(s > 0.7, s)), F.lit(0.0)).alias("AP_L"),
    )


def visibility(points: DataFrame, within: list[str], joint: str, frame: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Mean score, share at the threshold, mean absolute change of a joint from frame to frame, joints ever active."""
    w = Window.partitionBy(*within, joint).orderBy(frame)
    x = points.withColumn("__d", F.abs(F.col(score) - F.lag(score).over(w)))
    return x.groupBy(*within).agg(F.avg(score).alias("AP"), F.avg((F.col(score) >= threshold).cast("double")).alias("AR"), F.coalesce(F.avg("__d"), F.lit(0.0)).alias("AU"), F.count_distinct(F.when(F.col(score) >= threshold, F.col(joint))).alias("active_joints"))


def class_means(frames: DataFrame, within: list[str], probabilities: str, n: int) -> DataFrame:
    """Mean probability of each class, the greatest (first on ties), its mean, and the normalised entropy of the means."""
    out = frames.groupBy(*within).agg(F.array(*[F.avg(F.col(probabilities)[k].cast("double")) for k in range(n)]).alias("means"), F.avg(F.array_max(probabilities).cast("double")).alias("mean_confidence"))
    return out.withColumn("dominant", (F.array_position("means", F.array_max("means")) - 1).cast("int")).withColumn("entropy", normalized_entropy(F.col("means")))


def depth_errors(pixels: DataFrame, within: list[str], predicted: str, truth: str, least: float = 0.01) -> DataFrame:
    """abs_rel, sq_rel, rmse, rmse_log and shares with a ratio under 1.25, 1.25**2, 1.25**3, where the truth exceeds `least`."""
    p, t = F.greatest(F.col(predicted), F.lit(1e-6)), F.col(truth)
    ratio = F.greatest(p / t, t / p)
    return pixels.where(t > least).groupBy(*within).agg(
        F.avg(F.abs(p - t) / t).alias("abs_rel"), F.avg(F.pow(p - t, 2) / t).alias("sq_rel"), F.sqrt(F.avg(F.pow(p - t, 2))).alias("rmse"), F.sqrt(F.avg(F.pow(F.ln(p) - F.ln(t), 2))).alias("rmse_log"),
        *[F.avg((ratio < 1.25**k).cast("double")).alias(f"delta_{k}") for k in (1, 2, 3)],
    )


def depth_proxies(pixels: DataFrame, within: list[str], depth: str) -> DataFrame:
    """Stand-ins for the depth errors where there is no truth, from the variance and range of depths of 0 to 255."""
    d = F.col(depth) / F.lit(255.0)
    x = pixels.groupBy(*within).agg(F.var_pop(d).alias("v"), (F.max(d) - F.min(d)).alias("r"))
    held = lambda low, high, c: F.greatest(F.lit(low), F.least(F.lit(high), c))
    v, r = F.col("v"), F.col("r")
    # fixed values: bounds and weights of each
    return x.select(
        *within, held(0.1, 0.5, 2 * v).alias("abs_rel"), held(0.05, 0.3, 1.5 * v).alias("sq_rel"), held(0.2, 1.0, 0.8 * r).alias("rmse"), held(0.1, 0.4, 1.2 * v).alias("rmse_log"),
        held(0.5, 0.95, 1 - v).alias("delta_1"), held(0.7, 0.98, 1 - 0.8 * v).alias("delta_2"), held(0.8, 0.99, 1 - 0.6 * v).alias("delta_3"),
    )


def edge_score(pixels: DataFrame, within: list[str], row: str, column: str, depth: str) -> DataFrame:
    """Mean gradient by Sobel's 3 x 3 kernels over 50, 1 at most; borders are mirrored about the outermost pixels."""
    along, down = Window.partitionBy(*within, row).orderBy(column), Window.partitionBy(*within, column).orderBy(row)
    d = F.col(depth).cast("double")
    left, right = F.coalesce(F.lag(d).over(along), F.lead(d).over(along), d), F.coalesce(F.lead(d).over(along), F.lag(d).over(along), d)
    x = pixels.withColumn("__slope", right - left).withColumn("__smooth", left + 2 * d + right)
    near = lambda c, a, b: F.coalesce(a(c).over(down), b(c).over(down), F.col(c))
    gx = near("__slope", F.lag, F.lead) + 2 * F.col("__slope") + near("__slope", F.lead, F.lag)
    gy = near("__smooth", F.lead, F.lag) - near("__smooth", F.lag, F.lead)
    x = x.withColumn("__edge", F.sqrt(gx * gx + gy * gy))
    return x.groupBy(*within).agg(F.least(F.lit(1.0), F.avg("__edge") / 50).alias("depth_discontinuity_score"))


def split_at_quantile(pixels: DataFrame, within: list[str], depth: str, motion: str, q: float = 0.7) -> DataFrame:
    """Mean motion, the shares in it of motion before and behind the depth quantile, and how even the former is: a tenth of
    mean over sd, 1 at most; nothing before or behind counts 0."""
    limit = pixels.groupBy(*within).agg(F.percentile(depth, F.lit(q)).alias("limit"))
    x = pixels.join(limit, within)
    front, back = F.when(F.col(depth) > F.col("limit"), F.col(motion)), F.when(F.col(depth) <= F.col("limit"), F.col(motion))
    out = x.groupBy(*within).agg(F.avg(motion).alias("m"), F.avg(front).alias("f"), F.stddev_pop(front).alias("sd"), F.avg(back).alias("b"))
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / (F.col("m") + 1e-8)
    even = F.when(F.col("f").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("f") / (F.col("sd") + 1e-8) / 10))
    return out.select(*within, F.col("m").alias("avg_motion_magnitude"), share("f").alias("foreground_motion_ratio"), share("b").alias("background_motion_ratio"), even.alias("object_interaction_score"))


def temporal_consistency(frames: DataFrame, within: list[str], order: str, value: str) -> DataFrame:
    """1 - min(1, sd of changes / (mean + 1e-8)), and the mean of the positive values."""
    d = F.col(value) - F.lag(value).over(Window.partitionBy(*within).orderBy(order))
    x = frames.withColumn("__d", d)
    return x.groupBy(*within).agg((1 - F.least(F.lit(1.0), F.coalesce(F.stddev_pop("__d"), F.lit(0.0)) / (F.avg(value) + 1e-8))).alias("temporal_consistency"), F.avg(F.when(F.col(value) > 0, F.col(value))).alias("positive_mean"))


def flow_direction(pixels: DataFrame, within: list[str], magnitude: str, angle: str) -> DataFrame:
    """Mean, sd and greatest magnitude, magnitude-weighted direction, and 1 / (1 + sd) as consistency."""
    m = F.col(magnitude)
    return pixels.groupBy(*within).agg(F.avg(m).alias("mean_magnitude"), F.stddev_pop(m).alias("std_magnitude"), F.max(m).alias("max_magnitude"), F.coalesce(F.try_divide(F.sum(F.col(angle) * m), F.sum(m)), F.lit(0.0)).alias("direction"), (1 / (1 + F.stddev_pop(m))).alias("consistency"))


def track_speeds(tracks: DataFrame, within: list[str], order: str, x: str, y: str, dynamic: float, n_segments: int) -> DataFrame:
    """Mean speed and share of moving steps in each even segment of a track."""
    w = Window.partitionBy(*within).orderBy(order)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    t = tracks.withColumn("segment", F.ntile(n_segments).over(w) - 1).withColumn("__v", step)
    return t.where("__v IS NOT NULL").groupBy(*within, "segment").agg(F.avg("__v").alias("mean_speed"), F.avg((F.col("__v") > dynamic).cast("double")).alias("dynamic_share"))


def motion_norms(tracks: DataFrame, within: list[str], order: str, axes: list[str]) -> DataFrame:
    """Mean lengths of first and second differences, with smoothness scores exp(-v) and 1 / (1 + v)."""
    w = Window.partitionBy(*within).orderBy(order)
    v = tracks.withColumns({f"__v{a}": F.col(a) - F.lag(a).over(w) for a in axes})
    v = v.withColumns({f"__a{a}": F.col(f"__v{a}") - F.lag(f"__v{a}").over(w) for a in axes})
    length = lambda p: F.sqrt(sum((F.pow(F.col(f"__{p}{a}"), 2) for a in axes), F.lit(0.0)))
    out = v.groupBy(*within).agg(F.avg(length("v")).alias("velocity"), F.avg(length("a")).alias("acceleration"))
    return out.withColumn("smoothness", F.exp(-F.coalesce("acceleration", F.lit(0.0)))).withColumn("stability", 1 / (1 + F.coalesce("velocity", F.lit(0.0))))


def pose_quality(joints: DataFrame, within: list[str], frame: str, joint: str, x: str, y: str, score: str, active: float) -> DataFrame:
    """Of joints by frame: share of frames with any score above 0, mean score, mean number of joints at or over `active`, and the
    mean over joints and axes of the variance (population) over frames."""
    by_frame = joints.groupBy(*within, frame).agg((F.max(score) > 0).cast("double").alias("valid"), F.count_if(F.col(score) >= active).alias("active"))
    by_joint = joints.groupBy(*within, joint).agg(((F.var_pop(x) + F.var_pop(y)) / 2).alias("v"), F.sum(score).alias("s"), F.count(score).alias("n"))
    a = by_frame.groupBy(*within).agg(F.avg("valid").alias("valid_ratio"), F.avg("active").alias("active_joints"))
    b = by_joint.groupBy(*within).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("joint_confidence"), F.avg("v").alias("keypoint_variance"))
    return a.join(b, within)


def coherence_scores(velocity_before: Column, velocity_after: Column) -> list[Column]:
    """Scores of speeds before and after smoothing: exp(-after), 1 / (1 + before), and 1 / (1 + their difference)."""
    return [F.exp(-velocity_after).alias("pose_stability"), (1 / (1 + F.greatest(velocity_before, F.lit(1e-6)))).alias("motion_coherence"), (1 / (1 + F.abs(velocity_before - velocity_after))).alias("temporal_consistency")]


def heat_density(maps: DataFrame, within: list[str], image: str, heat: str) -> DataFrame:
    """The mean over heat maps of their mean; each map counts alike, whatever its size."""
    return maps.groupBy(*within, image).agg(F.avg(heat).alias("m")).groupBy(*within).agg(F.avg("m").alias("heatmap_density"))


def predicted_errors(tracks: DataFrame, within: list[str], step: str, x: str, y: str, observed: int, scales: list[float], miss: float) -> DataFrame:
    """Constant-velocity prediction from the last observed step: average and final displacement and miss, best of the scales."""
    w = Window.partitionBy(*within).orderBy(step)
    t = tracks.withColumn("__vx", F.col(x) - F.lag(x).over(w)).withColumn("__vy", F.col(y) - F.lag(y).over(w))
    last = t.where(F.col(step) == observed).select(*within, F.col(x).alias("x0"), F.col(y).alias("y0"), F.col("__vx").alias("vx"), F.col("__vy").alias("vy"))
    p = t.where(F.col(step) > observed).join(last, within).withColumn("scale", F.explode(F.array(*map(F.lit, scales)))).withColumn("k", F.col(step) - observed)
    d = F.sqrt(F.pow(F.col("x0") + F.col("vx") * F.col("scale") * F.col("k") - F.col(x), 2) + F.pow(F.col("y0") + F.col("vy") * F.col("scale") * F.col("k") - F.col(y), 2))
    per = p.withColumn("d", d).groupBy(*within, "scale").agg(F.avg("d").alias("ade"), F.max_by("d", F.col("k")).alias("fde"))
    return per.groupBy(*within).agg(F.min("ade").alias("minADE"), F.min("fde").alias("minFDE"), (F.min("fde") > miss).alias("missed"))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x, y, width, height)."""
    inter = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    return F.coalesce(F.try_divide(inter, a[2] * a[3] + b[2] * b[3] - inter), F.lit(0.0))


def matches_previous(boxes: DataFrame, within: list[str], frame: str, box: list[str], least: float = 0.3) -> DataFrame:
    """Whether any box of the frame before overlaps by more than `least`: an equality join on the frame number."""
    before = boxes.select(*within, (F.col(frame) + 1).alias(frame), *[F.col(c).alias(f"p_{c}") for c in box])
    both = boxes.join(before, [*within, frame], "left")
    iou = box_iou([F.col(c).cast("double") for c in box], [F.col(f"p_{c}").cast("double") for c in box])
    return both.groupBy(*within, frame).agg(F.coalesce(F.max(iou) > least, F.lit(False)).alias("matched"))


def detection_consistency(frames: DataFrame, within: list[str], order: str, value: str, span: int = 10) -> DataFrame:
    """clip(1 - sd / mean, 0, 1) over the last `span` frames."""
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(1 - span, 0)
    return frames.withColumn("consistency", clip(F.coalesce(1 - F.try_divide(F.stddev_pop(value).over(w), F.avg(value).over(w)), F.lit(0.0)), 0.0, 1.0))


def majority(frames: DataFrame, within: list[str], label: str, flag: str) -> DataFrame:
    """Most frequent label, the least on ties, and whether the flag holds in more than half."""
    counts = frames.groupBy(*within, label).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("int")).alias("t"))
    return counts.groupBy(*within).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("mode"), (F.sum("t") > F.sum("n") / 2).alias("flagged"))


def color_histogram(pixels: DataFrame, within: list[str], channels: list[str], bins: int = 8) -> DataFrame:
    """Normalised counts of the joint bins of 8-bit channels."""
    size = 256 // bins
    b = pixels.select(*within, *[F.floor(F.col(c) / size).cast("int").alias(f"bin_{c}") for c in channels])
    keys = [f"bin_{c}" for c in channels]
    out = b.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def mask_overlap(pixels: DataFrame, within: list[str], mask: str, box: str) -> DataFrame:
    """Share of the frame in the mask, and intersection over union of mask and box."""
    m, b = F.col(mask), F.col(box)
    return pixels.groupBy(*within).agg(F.avg(m.cast("double")).alias("coverage"), F.coalesce(F.try_divide(F.count_if(m & b).cast("double"), F.count_if(m | b).cast("double")), F.lit(0.0)).alias("iou"))


def normalized_coordinates(points: DataFrame, within: list[str], axes: list[str]) -> DataFrame:
    """Coordinates over the greatest absolute one of the recording, in [-1, 1]."""
    w = Window.partitionBy(*within)
    scale = F.greatest(*[F.max(F.abs(a)).over(w) for a in axes])
    return points.withColumns({a: F.coalesce(F.try_divide(F.col(a), scale), F.lit(0.0)) for a in axes})


def densified_frames(frames: DataFrame, recordings: DataFrame, within: list[str], frame: str, n: str, columns: list[str]) -> DataFrame:
    """All frames 0 to n - 1 of a recording, zeros where a frame is missing."""
    grid = recordings.select(*within, F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))).alias(frame))
    return grid.join(frames.select(*within, F.col(frame).cast("int").alias(frame), *columns), [*within, frame], "left").fillna(0, columns)


def flow_totals(flows: DataFrame, within: list[str], order: str, value: str, pairs: int = 10) -> DataFrame:
    """Total and mean over the first `pairs` of each recording."""
    k = F.row_number().over(Window.partitionBy(*within).orderBy(order))
    return flows.withColumn("__k", k).where(F.col("__k") <= pairs).groupBy(*within).agg(F.sum(value).alias("total_motion"), F.avg(value).alias("average_motion"))


def smoothed_by_overlap(frames: DataFrame, within: list[str], pos: str, value: str, width: int, step: int) -> DataFrame:
    """Means of windows laid back on their frames and averaged where they overlap; the last window ends with the series."""
    n = F.max(pos).over(Window.partitionBy(*within)) + 1
    last = F.greatest(F.lit(0), F.col("__n") - width)
    lo = F.greatest(F.lit(0), F.ceil((F.col(pos) - width + 1) / F.lit(step))).cast("long")
    hi = F.floor(F.col(pos) / step)
    starts = F.filter(F.transform(F.when(lo <= hi, F.sequence(lo, hi)), lambda k: k * step), lambda s: s <= last)
    with_last = F.array_distinct(F.concat(F.coalesce(starts, F.array().cast("array<bigint>")), F.when(F.col(pos) >= last, F.array(last.cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    x = frames.withColumn("__n", n).withColumn("__s", F.explode(with_last))
    x = x.withColumn("__m", F.avg(value).over(Window.partitionBy(*within, "__s")))
    return x.groupBy(*within, pos).agg(F.avg("__m").alias("smoothed"))


def heatmap_keypoints(cells: DataFrame, within: list[str], x: str, y: str, value: str, threshold: float, scale: float = 1.0) -> DataFrame:
    """Place, scaled, and value of each heatmap's greatest cell, the first by rows on ties; zeros where it isn't over the threshold."""
    top = cells.groupBy(*within).agg(F.max_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), F.struct(F.col(value), -F.col(y), -F.col(x))).alias("__at"), F.max(value).alias("__v"))
    of = lambda c: F.when(F.col("__v") > threshold, c.cast("double")).otherwise(F.lit(0.0))
    return top.select(*within, of(F.col("__at.x") * scale).alias("x"), of(F.col("__at.y") * scale).alias("y"), of(F.col("__v")).alias("confidence"))


def activation_summary(rows: DataFrame, within: list[str], value: str, threshold: float) -> DataFrame:
    """Number of activations over the threshold and mean of all."""
    return rows.groupBy(*within).agg(F.count_if(F.col(value) > threshold).alias("total_activations"), F.avg(value).alias("avg_intensity"))


#: Regions of a frame by foreground (f) and motion (d); None takes both.
FLOW_REGIONS = {"fg_static": (True, False), "fg_dynamic": (True, True), "bg_static": (False, False), "bg_dynamic": (False, True), "fg_avg": (True, None), "bg_avg": (False, None), "avg": (None, None)}


def region_flow(pixels: DataFrame, within: list[str], frame: str, u: str, v: str, foreground: Column, dynamic: float) -> DataFrame:
    """Mean length of the flow (epe) and its alignment with its own mean direction (r2, 0 to 1) in each region, over frames.

    The mean of dot products with the mean direction m is |m|^2 / (|m| + 1e-6), so one aggregation a frame will do. A region without
    pixels counts 0 in its frame.
    """
    length = F.sqrt(F.pow(F.col(u), 2) + F.pow(F.col(v), 2))
    x = pixels.withColumns({"__m": length, "__f": foreground}).withColumns({"__u": F.col(u) / (F.col("__m") + 1e-6), "__w": F.col(v) / (F.col("__m") + 1e-6), "__d": F.col("__m") > dynamic})
    sums = []
    for name, (f, d) in FLOW_REGIONS.items():
        inside = (F.lit(True) if f is None else F.col("__f") == f) & (F.lit(True) if d is None else F.col("__d") == d)
        sums += [F.avg(F.when(inside, F.col(c))).alias(f"{c}_{name}") for c in ("__m", "__u", "__w")]
    per = x.groupBy(*within, frame).agg(*sums)
    out = []
    for name in FLOW_REGIONS:
        mean = F.sqrt(F.pow(F.col(f"__u_{name}"), 2) + F.pow(F.col(f"__w_{name}"), 2))
        out += [F.avg(F.coalesce(F.col(f"__m_{name}"), F.lit(0.0))).alias(f"of_{name}_epe_st"), F.avg(F.coalesce((mean * mean / (mean + 1e-6) + 1) / 2, F.lit(0.0))).alias(f"of_{name}_r2_st")]
    return per.groupBy(*within).agg(*out)


def array_moments(rows: DataFrame, within: list[str], vector: str) -> DataFrame:
    """Mean and population sd of each element over rows, with the number of rows."""
    x = rows.select(*within, F.posexplode(vector).alias("pos", "__x"))
    return x.groupBy(*within, "pos").agg(F.avg(F.col("__x").cast("double")).alias("mean"), F.stddev_pop(F.col("__x").cast("double")).alias("std"), F.count("__x").alias("n"))


#: The range of hue, and least saturation and brightness, of skin in 8-bit HSV.
SKIN_HUE, SKIN_SATURATION, SKIN_VALUE = (0, 20), 48, 80


def skin_luminance(pixels: DataFrame, within: list[str], hsv: list[str], channels: list[str]) -> DataFrame:
    """Mean and population sd of the channels' mean over skin pixels; 0 without any."""
    h, s, v = map(F.col, hsv)
    light = F.when(h.between(*SKIN_HUE) & (s >= SKIN_SATURATION) & (v >= SKIN_VALUE), sum(map(F.col, channels), F.lit(0.0)) / len(channels))
    return pixels.groupBy(*within).agg(F.coalesce(F.avg(light), F.lit(0.0)).alias("skin_mean"), F.coalesce(F.stddev_pop(light), F.lit(0.0)).alias("skin_std"))


def frame_maximum_bands(points: DataFrame, within: list[str], frame: str, score: str) -> DataFrame:
    """confidence_bands of the greatest score of each frame."""
    return confidence_bands(points.groupBy(*within, frame).agg(F.max(score).alias(score)), within, score)


def consistency_strings(frames: DataFrame, within: list[str], order: str, flag: Column, span: int = 10) -> DataFrame:
    """In how many of the last `span` frames the flag holds, as 'k/span'."""
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(1 - span, 0)
    return frames.withColumn("consistency", F.concat(F.count_if(flag).over(w).cast("string"), F.lit(f"/{span}")))


def instance_score(score: Column, box: Column, keypoints: Column) -> Column:
    """An instance's score: its own, else its box's, else the mean of its keypoints', else 0."""
    return F.coalesce(score, box, F.try_divide(F.aggregate(keypoints, F.lit(0.0), lambda s, x: s + x), F.size(keypoints)), F.lit(0.0))


def to_unit(x: Column, size: Column) -> Column:
    """Pixels to [-1, 1]."""
    return F.coalesce(F.try_divide(2 * x, size) - 1, F.lit(0.0))


def from_unit(x: Column, size: Column) -> Column:
    return (x + 1) / 2 * size
