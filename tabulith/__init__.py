"""Tabulith: profiling and cleaning of Spark DataFrames, and operators for training data (`tabulith.llm`)."""

from . import clean, datasets, plots, utils
from .clean import clean_column_names
from .operators.profile import xray
from .operators.selection import quantiles
from .plots import cat_plot, convert_datatypes, corr_heatmap, corr_plot, data_cleaning, dist_plot, drop_missing, missingval_plot
from .utils import save_fig

__all__ = [
    "cat_plot",
    "clean",
    "clean_column_names",
    "convert_datatypes",
    "corr_heatmap",
    "corr_plot",
    "data_cleaning",
    "datasets",
    "dist_plot",
    "drop_missing",
    "missingval_plot",
    "plots",
    "quantiles",
    "save_fig",
    "utils",
    "xray",
]
__version__ = "0.1.0"
