"""Built-in data sets."""

from .sources.datasets import dataset_info, diabetes, list_datasets, load_diabetes, load_titanic, titanic

__all__ = ["dataset_info", "diabetes", "list_datasets", "load_diabetes", "load_titanic", "titanic"]
