"""Gaps of all pairs of dimensions in one scan against one pair at a time."""

from pyspark.sql import functions as F

from hyperloom import schema
from hyperloom.operators import gaps


def test_equal_to_one_pair_at_a_time(spark):
    """Experiments with several values of a dimension, and with none of another."""
    entity = lambda kind, v: {"type": kind, "value": v}
    rows = [
        ("1", [entity("Material", "a"), entity("Material", "b"), entity("Facility", "x")], [entity("Process", "p")], "RU"),
        ("2", [entity("Material", "a"), entity("Facility", "y")], [], "Россия"), ("3", [entity("Material", "a"), entity("Facility", "x")], [entity("Process", "p"), entity("Process", "q")], "RU"),
        ("4", [], [entity("Process", "q")], None), ("5", [entity("Material", "c"), entity("Facility", "x")], [entity("Process", "p")], "Chile"),
    ]
    df = spark.createDataFrame(rows, f"id string, input_entities array<{schema.ENTITY}>, process_entities array<{schema.ENTITY}>, geography string")
    dimensions = ["Material", "Facility", "Process"]
    got = {tuple(r) for r in gaps.of_pairs(df, dimensions, 2, 2).collect()}
    want = set()
    for first, second in (("Material", "Facility"), ("Material", "Process"), ("Facility", "Process")):
        alone = gaps.analyze(df, [first, second], 2, 2)
        want |= {(first, second, r.d0, r.d1, r.experiments, r.gap_type) for r in alone.collect()}
    assert got == want and len({g[:2] for g in got}) == 3
    assert gaps.of_pairs(df.where(F.lit(False)), dimensions).count() == 0
