"""Six experiments to try the operators on: three pairs that differ in one input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hyperloom import schema

_NICKEL, _COPPER, _ORE = "nickel chloride electrolyte", "copper sulphate electrolyte", "low-grade Cu-Ni ore"
#: id, material, process, facility, varied conditions, outputs, year, geography, sensitive
_ROWS = [
    ("EXP-NI-01", _NICKEL, "electrowinning", "Kola", ["pH: 2.0", "density: 300 A/m2"], ["current yield: 95.5 %"], 2023, "RU", True),
    ("EXP-NI-02", _NICKEL, "electrowinning", "Kola", ["pH: 1.0", "density: 300 A/m2"], ["current yield: 91.2 %"], 2023, "RU", True),
    ("EXP-NI-03", _NICKEL, "electrowinning", "Kola", ["pH: 2.0", "density: 500 A/m2"], ["current yield: 93.8 %"], 2023, "RU", True),
    ("EXP-CU-01", _COPPER, "electrowinning", "Long Harbour", ["temp: 45 C", "density: 250 A/m2"], ["current yield: 97.0 %"], 2017, "Global", False),
    ("EXP-HL-01", _ORE, "heap leaching", "Kayerkan", ["temp: 5 C"], ["recovery: 45 %"], 2017, "RU", True),
    ("EXP-HL-02", _ORE, "heap leaching", "Kayerkan", ["temp: 20 C"], ["recovery: 62 %"], 2017, "RU", True),
]


def seed(spark: SparkSession) -> DataFrame:
    rows = []
    for i, (id_, material, process, facility, conditions, outputs, year, geography, sensitive) in enumerate(_ROWS):
        inputs = [("Material", material), ("Facility", facility), *(("Property", c) for c in conditions)]
        relations = [(process, "uses_material", material), (process, "located_at", facility)]
        rows.append((id_, i, id_, inputs, [("Process", process)], [("Property", o) for o in outputs], relations, [f"report {year}.docx"], 1.0, year, geography, "report", sensitive))
    return spark.createDataFrame(rows, schema.EXPERIMENT)
