"""Loan-default datasets and models as Spark jobs."""

from riskmart.config import Config

__all__ = ["Config"]
