"""Urban-mobility analytics on Spark: every operator is DataFrame in, DataFrame out."""

from viario.config import default_config
from viario.plans.cleaning import CsvCleaner
from viario.plans.detection import AnomalyDetector
from viario.plans.run import run

__all__ = ["AnomalyDetector", "CsvCleaner", "default_config", "run"]
