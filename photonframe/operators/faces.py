"""Face geometry and weights without the networks: boxes from priors, suppression, the
aligning transform, masks and the factors that decide how much of a restored face is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonframe.functions.pixel import clip
from photonframe.operators.joins import suppress
from photonframe.operators.stats import masked_correlation
from photonframe.operators.stencil import gaussian

# Detector steps with their box sizes, variances, thresholds, mask ellipse.
STEPS = ((8, (16, 32)), (16, (64, 128)), (32, (256, 512)))
VARIANCES = (0.1, 0.2)
LEAST_SCORE, SURE_SCORE, LEAST_EYE_DISTANCE, OVERLAP = 0.9, 0.97, 5.0, 0.4
ELLIPSE = (256.0, 292.0, 152.0, 188.0)


def priors(images: DataFrame) -> DataFrame:
    """(image_id, prior, cx, cy, w, h) in shares of the picture, for width and height rows."""
    parts = []
    for step, sizes in STEPS:
        rows, columns = F.ceil(F.col("height") / step), F.ceil(F.col("width") / step)
        cells = images.withColumn("_y", F.explode(F.sequence(F.lit(0).cast("long"), rows - 1))).withColumn("_x", F.explode(F.sequence(F.lit(0).cast("long"), columns - 1)))
        cells = cells.withColumn("_s", F.explode(F.array(*map(F.lit, sizes))))
        parts.append(cells.select("image_id", F.concat_ws(":", F.lit(step), "_y", "_x", "_s").alias("prior"), ((F.col("_x") + 0.5) * step / F.col("width")).alias("cx"), ((F.col("_y") + 0.5) * step / F.col("height")).alias("cy"), (F.col("_s") / F.col("width")).alias("w"), (F.col("_s") / F.col("height")).alias("h")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def decode(rows: DataFrame) -> DataFrame:
    """Adds the box x0, y0, x1, y1 (shares) that offsets l0..l3 make of a prior."""
    v0, v1 = VARIANCES
    cx, cy = F.col("cx") + F.col("l0") * v0 * F.col("w"), F.col("cy") + F.col("l1") * v0 * F.col("h")
    w, h = F.col("w") * F.exp(F.col("l2") * v1), F.col("h") * F.exp(F.col("l3") * v1)
    return rows.withColumns({"x0": cx - w / 2, "y0": cy - h / 2, "x1": cx + w / 2, "y1": cy + h / 2})


def detected(boxes: DataFrame) -> DataFrame:
    """Of (image_id, box_id, x0, y0, x1, y1, score, eye_distance) those that count as faces."""
    kept = suppress(boxes.where(F.col("score") > LEAST_SCORE), OVERLAP)
    return kept.where(F.col("eye_distance") >= LEAST_EYE_DISTANCE)


def similarity_transform(points: DataFrame, key: str) -> DataFrame:
    """(key, a, b, c, d): least-squares rotation, uniform scale and translation of points
    (sx, sy) onto (tx, ty), as x' = a x - b y + c, y' = b x + a y + d. One aggregate."""
    s = points.groupBy(key).agg(*(F.avg(n).alias(n) for n in ("sx", "sy", "tx", "ty")), F.avg(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")).alias("q"), F.avg(F.col("sx") * F.col("tx") + F.col("sy") * F.col("ty")).alias("p"), F.avg(F.col("sx") * F.col("ty") - F.col("sy") * F.col("tx")).alias("r"))
    var = F.greatest(F.col("q") - F.col("sx") * F.col("sx") - F.col("sy") * F.col("sy"), F.lit(1e-12))
    a = (F.col("p") - F.col("sx") * F.col("tx") - F.col("sy") * F.col("ty")) / var
    b = (F.col("r") - F.col("sx") * F.col("ty") + F.col("sy") * F.col("tx")) / var
    s = s.withColumns({"a": a, "b": b})
    return s.select(key, "a", "b", (F.col("tx") - F.col("a") * F.col("sx") + F.col("b") * F.col("sy")).alias("c"), (F.col("ty") - F.col("b") * F.col("sx") - F.col("a") * F.col("sy")).alias("d"))


def ellipse_mask(y: Column, x: Column) -> Column:
    """Soft mask of the face in the aligned crop."""
    cx, cy, rx, ry = ELLIPSE
    t = clip((1 - F.sqrt(F.pow((x - cx) / rx, F.lit(2.0)) + F.pow((y - cy) / ry, F.lit(2.0)))) / 0.2)
    return t * t * (3 - 2 * t)


def base_weight(mode: Column, fidelity: Column) -> Column:
    a = clip(fidelity / 100.0)
    return F.when(mode == "off", F.lit(0.0)).when(mode == "strong", 0.6 + 0.4 * a).otherwise(0.35 + 0.55 * a)


def size_factor(eye_distance: Column) -> Column:
    return clip((eye_distance - 5.0) / 11.0, 0.3, 1.0)


def score_factor(score: Column) -> Column:
    return clip(0.5 + 0.5 * (score - LEAST_SCORE) / (SURE_SCORE - LEAST_SCORE), 0.5, 1.0)


def detail_factor(gain: Column) -> Column:
    """gain: masked detail energy of the restored face by that of the original."""
    return clip((gain - 0.9) / 0.6, 0.15, 1.0)


def identity_factor(rows: DataFrame, original: str, restored: str, mask: str) -> DataFrame:
    """(image_id, identity): lower as the restored face departs from the photo; a face
    without features is not trusted."""
    corr = masked_correlation(rows, original, restored, mask)
    w, v = F.col(mask), F.col(original)
    spread = rows.groupBy("image_id").agg((F.sum(w * v * v) / F.sum(w) - F.pow(F.sum(w * v) / F.sum(w), F.lit(2.0))).alias("va"))
    return corr.join(spread, "image_id").select("image_id", F.when(F.col("va") < 1e-5, 0.25).otherwise(clip((F.col("correlation") - 0.55) / 0.3, 0.25, 1.0)).alias("identity"))


def face_report(faces: DataFrame) -> DataFrame:
    """(image_id, found, restored, protected) from the faces of pictures with their factors
    identity, size and weight: a face is restored from a weight of 0.02 up, and held back
    where identity and size together are below 0.75."""
    return faces.groupBy("image_id").agg(F.count("*").alias("found"), F.count_if(F.col("weight") > 0.02).alias("restored"), F.count_if(F.col("identity") * F.col("size") < 0.75).alias("protected"))


def harmonise(crops: DataFrame, original: str, restored: str, strong: bool, out: str) -> DataFrame:
    """The restored crop with the original's low frequencies (image_id names the crop)."""
    sigma = 48.0 if strong else 6.0
    crops = crops.withColumn("_low", F.col(original) - F.col(restored))
    return gaussian(crops, "_low", sigma).withColumn(out, F.col(restored) + F.col("_low")).drop("_low")


def paste_faces(px: DataFrame, faces: DataFrame, change: DataFrame, side: int = 512) -> DataFrame:
    """8-bit pixels with the changes of their faces added.

    faces: (image_id, face_id, a, b, c, d), as of ``similarity_transform`` from picture to
    crop. change: (face_id, y, x, r, g, b, alpha) on the crop, alpha the mask by the weight. A
    pixel meets the faces of its picture whose crop it falls into, and the four samples of the
    change around its place there; samples outside the crop count as nothing, so the change
    fades at the border. Faces that overlap add up."""
    x, y = F.col("x"), F.col("y")
    at = px.select("image_id", "y", "x").join(faces, "image_id")
    at = at.withColumns({"_u": F.col("a") * x - F.col("b") * y + F.col("c"), "_v": F.col("b") * x + F.col("a") * y + F.col("d")})
    at = at.where(f"_u > -1 and _v > -1 and _u < {side} and _v < {side}")
    fx, fy = F.col("_u") - F.floor("_u"), F.col("_v") - F.floor("_v")
    corner = lambda i, j: F.struct((F.floor("_v") + i).cast("int").alias("sy"), (F.floor("_u") + j).cast("int").alias("sx"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w"))
    need = at.select("image_id", "face_id", "y", "x", F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("q")).select("image_id", "face_id", "y", "x", "q.*")
    source = change.select("face_id", F.col("y").alias("sy"), F.col("x").alias("sx"), *(F.col(c).alias(f"_{c}") for c in "rgb"), F.col("alpha").alias("_a"))
    sampled = need.join(source, ["face_id", "sy", "sx"]).groupBy("image_id", "face_id", "y", "x").agg(*(F.sum(F.col("w") * F.col(f"_{c}")).alias(f"_{c}") for c in "rgba"))
    total = sampled.groupBy("image_id", "y", "x").agg(*(F.sum(F.col("_a") * F.col(f"_{c}")).alias(f"_{c}") for c in "rgb"))
    new = {c: F.floor(clip(F.col(c) + F.coalesce(f"_{c}", F.lit(0.0)), 0.0, 255.0) + 0.5).cast("int") for c in "rgb"}
    return px.join(total, ["image_id", "y", "x"], "left").withColumns(new).select(*px.columns)
