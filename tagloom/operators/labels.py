"""The label tag: what users declared, and what the model says of the others."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.values import decode_label
from tagloom.operators.features import declared_users

# The words written for a label.
LABEL_WORDS = {"F": "女"}
OTHER_WORD = "男"


def declared_label_tag(
    users: DataFrame,
    words: Mapping[str, str] = LABEL_WORDS,
    default: str = OTHER_WORD,
    label: str = "gender",
    treat_empty_as_missing: bool = False,
) -> DataFrame:
    """``(uid, tag_value)`` of the users who gave a label."""
    given = declared_users(users, label, treat_empty_as_missing)
    return given.select(
        F.col("id").cast("string").alias("uid"),
        decode_label(F.col(label), words, default).alias("tag_value"),
    )


def predicted_label_tag(
    predicted: DataFrame,
    users: DataFrame,
    words: Mapping[str, str] = LABEL_WORDS,
    default: str = OTHER_WORD,
    label: str = "gender",
    treat_empty_as_missing: bool = False,
) -> DataFrame:
    """``(uid, tag_value)``: predicted labels and declared ones together."""
    guessed = predicted.select(
        F.col("user_id").cast("string").alias("uid"),
        decode_label(F.col("prediction_origin"), words, default).alias("tag_value"),
    )
    return guessed.unionByName(declared_label_tag(users, words, default, label, treat_empty_as_missing))
