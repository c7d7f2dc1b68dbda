"""Losses over labelled cells, as plain aggregates."""

from pyspark.sql import functions as F

from pairscreen.functions import bce_logits, focal_cell


def _agg(df, by, *cols):
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def contact_bce(cells, by=(), logit="logit", target="target", out="bce"):
    """Mean binary cross-entropy; 0 when there is no cell."""
    mean = F.avg(bce_logits(logit, target))
    return _agg(cells, by, F.coalesce(mean, F.lit(0.0)).alias(out))


def contact_focal(cells, by=(), logit="logit", target="target", gamma=2.0, alpha=0.25, out="focal"):
    """Focal loss summed and divided by the positives, if there are any."""
    total = F.coalesce(F.sum(focal_cell(logit, target, gamma, alpha)), F.lit(0.0))
    positives = F.coalesce(F.sum(F.col(target).cast("double")), F.lit(0.0))
    return _agg(cells, by, (total / F.greatest(positives, F.lit(1.0))).alias(out))


def total_loss(clip, contact, clip_weight=1.0, contact_weight=1.0):
    """The weighted loss that is minimised and the plain sum that is logged."""
    clip = F.col(clip) if isinstance(clip, str) else clip
    contact = F.col(contact) if isinstance(contact, str) else contact
    weighted = F.lit(float(clip_weight)) * clip + F.lit(float(contact_weight)) * contact
    return weighted.alias("loss_weighted"), (clip + contact).alias("loss_total")
