"""Opening a frozen manifest for training: proofs first, then one table per partition."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import ARABIC, TextProfile
from labelloom.operators import integrity

PARTS = ("train", "val", "test")


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """Digest of the whole manifest by partition, to be stored beside it."""
    return integrity.content_digest(manifest, sorted(manifest.columns), ["split"])


def load_task(
    manifest: DataFrame, label: str, labels: Sequence[str], *, recorded: DataFrame | None = None,
    keep: Sequence[str] = (), without_flag: str | None = None, fatal_all: bool = False,
    profile: TextProfile = ARABIC, stop_words: Iterable[str] = (),
) -> dict[str, DataFrame]:
    """``{partition: (uid, text, y, keep...)}`` of a manifest whose contents are proven first.

    Raises when the digest differs from the ``recorded`` one, when a ``uid`` repeats, when two partitions
    share a text under a strict representation, or when a label is not among ``labels`` (their
    order gives the codes).  ``without_flag`` names a 0/1 column whose marked rows leave the training
    partition (auxiliary corpora that collide with another one's held-out texts).  Runs jobs that bring back
    counts only.
    """
    if recorded is not None:
        changed = integrity.digest_changes(recorded, manifest_digest(manifest), ["split"]).count()
        if changed:
            raise ValueError(f"{changed} partitions of the manifest differ from the recorded digest")
    repeated = integrity.repeated_keys(manifest).first().n_repeated
    if repeated:
        raise ValueError(f"{repeated} ids stand in the manifest more than once")
    keys = integrity.representation_keys("text", profile, stop_words)
    integrity.assert_no_leakage(integrity.leakage_matrix(manifest, keys, "split", PARTS), fatal_all)
    code = F.array_position(F.array(*[F.lit(name) for name in labels]), F.col(label)).cast("int") - 1
    rows = manifest.withColumn("y", code)
    unknown = rows.where(F.coalesce(F.col("y"), F.lit(-1)) < 0).count()
    if unknown:
        raise ValueError(f"{unknown} rows have a label that is not declared")
    if without_flag is not None:
        rows = rows.where(~((F.col("split") == "train") & (F.coalesce(F.col(without_flag), F.lit(0)) == 1)))
    return {part: rows.where(F.col("split") == part).select("uid", "text", "y", *keep) for part in PARTS}
