"""Sensitive-text scoring and text data processing on Spark."""

from .config import Config, config_of, load_config
from .plans.pipeline import Analysis, analyze_text

__all__ = ["Analysis", "Config", "analyze_text", "config_of", "load_config"]
