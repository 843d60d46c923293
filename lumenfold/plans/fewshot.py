"""From class vectors to few-shot prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import classes as cls
from lumenfold.operators import episodes
from lumenfold.operators.neighbour_bins import drawn_neighbours
from lumenfold.session import materialise


def class_vectors(image_vectors: DataFrame, text_vectors: DataFrame, n: int = cls.VECTORS, seed: int = 0) -> DataFrame:
    """`class_id, image_vec, text_vec` from one vector per image and modality."""
    mean = lambda df, name: cls.class_embedding(df, n, seed).select("class_id", F.col("embedding").alias(name))
    return mean(image_vectors, "image_vec").join(mean(text_vectors, "text_vec"), "class_id")


def train_records(
    vectors: DataFrame, images: DataFrame, bins: int = cls.NEIGHBOURS, samples: int = cls.SAMPLES, seed: int = 0
) -> DataFrame:
    """Class records with similarity-ranked neighbours, kept as a table: episodes read them twice.

    Class vectors are kept first, one row per class. The neighbours are found by their ranks alone:
    neither the similarity matrix nor the ranking is a table.
    """
    vectors = materialise(vectors)
    return materialise(cls.pair_records(drawn_neighbours(vectors, bins, seed), images, bins, samples, seed))


def episode_prompts(
    vectors: DataFrame, images: DataFrame, templates: Sequence[str], shot: int,
    bins: int = cls.NEIGHBOURS, samples: int = cls.SAMPLES, seed: int = 0, epoch: int = 0,
) -> DataFrame:
    """One prompt per class: similar classes as hard negatives, `shot` examples per side, one query."""
    records = train_records(vectors, images, bins, samples, seed)
    return episodes.prompts(episodes.two_way_weight(records, templates, shot, seed, epoch))
