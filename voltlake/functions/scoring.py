"""The 0-100 score: weight, blend of two percent ranks, recommendation text."""

from pyspark.sql import Column, functions as F

from voltlake import settings
from voltlake.functions.numbers import banded


def amplify_weight(weight: Column | float) -> Column:
    """Clamp a cost share to 0..1 and push it away from one half.

    Works on a column (one weight per user) as well as on a number.
    """
    share = weight if isinstance(weight, Column) else F.lit(float(weight))
    offset = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) - 0.5
    return 0.5 + F.signum(offset) * F.least(F.lit(0.5), F.abs(offset) * settings.WEIGHT_GAIN)


def blended_score(price_rank: Column, carbon_rank: Column, weight: Column) -> Column:
    """100 is cheapest and cleanest. Ties of the rounding go to the even number."""
    blend = weight * price_rank + (1 - weight) * carbon_rank
    return F.rint((1 - blend) * 100).cast("int")


def recommendation(score: Column) -> Column:
    return banded(
        score, settings.RECOMMENDATION_BANDS, settings.RECOMMENDATION_REST, at_least=True
    )
