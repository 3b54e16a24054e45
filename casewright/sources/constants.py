"""Constant tables of the game, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Clusters left out of the graph (cluster, cite, name, why).
EXCLUSIONS = [
    (96405, "200 U.S. 321", "United States v. Detroit Timber & Lumber Co.", "cited by every syllabus"),
    (112790, "506 U.S. 1", "Martin v. District of Columbia Court of Appeals", "cited in every order against an abusive filer"),
    (111075, "464 U.S. 928", "Brown v. Herald Co.", "cited in the same orders"),
    (109532, "428 U.S. 153", "Gregg v. Georgia", "cited by hundreds of dissents from denials in capital cases"),
]
# Well-known cases that a graph must hold (label, cite).
WELL_KNOWN = [
    ("Twombly", "550 U.S. 544"), ("Iqbal", "556 U.S. 662"), ("Celotex", "477 U.S. 317"), ("Liberty Lobby", "477 U.S. 242"),
    ("Chevron", "467 U.S. 837"), ("Erie", "304 U.S. 64"), ("Marbury", "5 U.S. 137"), ("Brown v. Board", "347 U.S. 483"),
]


def exclusions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXCLUSIONS, "id long, cite string, name string, reason string")


def well_known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WELL_KNOWN, "label string, cite string")
