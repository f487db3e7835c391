"""Search parameters as one row of doubles, so a sweep is a table of rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """The published settings of the ranked search."""

    sequence_weight: float = 1.0
    run_weight: float = 2.0
    transcript_repeat_weight: float = 0.25
    description_repeat_weight: float = 0.0
    repeat_variety: float = 1.0
    rarity_exponent: float = 1.25
    transcript_coverage_floor: float = 0.4
    description_coverage_floor: float = 0.05
    transcript_length_forgiveness: float = 1.0
    description_length_forgiveness: float = 1.0
    transcript_literal_share: float = 0.2
    description_literal_share: float = 0.2
    description_min_mass: float = 2.5
    description_mass_normalization: float = 1.0
    transcript_length_normalization: float = 0.0
    description_length_normalization: float = 0.1
    transcript_idf_floor: float = 0.5
    description_idf_floor: float = 1.0
    transcript_inflection_weight: float = 0.0
    description_inflection_weight: float = 0.7
    description_preference: float = 0.7
    agreement_bonus: float = 0.15

    def but(self, **changes: float) -> Params:
        return replace(self, **changes)


DEFAULT = Params()


@dataclass(frozen=True)
class Settings:
    """Several settings searched at once: tables that depend on one have its number in a column named setting."""

    rows: tuple[Params, ...] = (DEFAULT,)

    def of(self, name: str) -> Column:
        """The value of a parameter in the row's setting, a literal where all settings have the same."""
        values = [float(getattr(p, name)) for p in self.rows]
        return F.lit(values[0]) if len(set(values)) == 1 else F.get(F.array(*map(F.lit, values)), F.col("setting"))

    def by_corpus(self, name: str) -> Column:
        """transcript_name or description_name, as the row's corpus says."""
        return F.when(F.col("corpus") == "transcript", self.of(f"transcript_{name}")).otherwise(self.of(f"description_{name}"))

    def spread(self, df: DataFrame) -> DataFrame:
        """df once for every setting."""
        return df.withColumn("setting", F.explode(F.array(*map(F.lit, range(len(self.rows))))))


def settings(p: Params | Settings) -> Settings:
    return p if isinstance(p, Settings) else Settings((p,))


#: What a sweep tries for each knob, and whose rank it is judged by.
GRID: dict[str, tuple[str, tuple[float, ...]]] = {
    "sequence_weight": ("recited", (0, 0.5, 1, 2, 3)),
    "run_weight": ("recited", (0, 1, 2, 4, 8)),
    "transcript_repeat_weight": ("recited", (0, 0.25, 0.5, 1)),
    "description_repeat_weight": ("described", (0, 0.1, 0.25, 0.5, 1)),
    "repeat_variety": ("combined", (0, 0.25, 0.5, 0.75, 1)),
    "rarity_exponent": ("combined", (1, 1.25, 1.5, 2)),
    "transcript_coverage_floor": ("recited", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7)),
    "description_coverage_floor": ("described", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7)),
    "transcript_length_forgiveness": ("recited", (0.25, 0.4, 0.55, 0.7, 0.85, 1)),
    "description_length_forgiveness": ("described", (0.25, 0.4, 0.55, 0.7, 0.85, 1)),
    "transcript_literal_share": ("recited", (0, 0.2, 0.3, 0.4, 0.5)),
    "description_literal_share": ("described", (0, 0.2, 0.3, 0.4, 0.5)),
    "description_min_mass": ("described", (0, 1, 1.5, 2.5, 4)),
    "description_mass_normalization": ("described", (0, 0.5, 1)),
    "transcript_length_normalization": ("recited", (0, 0.25, 0.5, 0.75, 1)),
    "description_length_normalization": ("described", (0, 0.25, 0.5, 0.75, 1)),
    "description_idf_floor": ("described", (0.25, 0.5, 1, 1.5, 2)),
    "transcript_inflection_weight": ("recited", (0, 0.5, 0.7, 0.85, 1)),
    "description_inflection_weight": ("described", (0, 0.5, 0.7, 0.85, 1)),
    "description_preference": ("combined", (0.4, 0.55, 0.7, 0.85, 1)),
    "agreement_bonus": ("combined", (0, 0.15, 0.3, 0.6)),
}
#: The least gain of an accepted move, and how much the combined score may seem to fall by rounding.
LEAST_GAIN, ROUNDING = 0.005, 1e-9


def params_table(spark: SparkSession, rows: list[tuple[str, Params]]) -> DataFrame:
    """One row per named setting."""
    names = list(asdict(DEFAULT))
    data = [(label, *(float(asdict(p)[n]) for n in names)) for label, p in rows]
    return spark.createDataFrame(data, "label string, " + ", ".join(f"{n} double" for n in names))
