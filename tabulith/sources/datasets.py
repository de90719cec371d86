"""Built-in data sets, read with explicit schemas from a folder that the session or the caller names."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Session setting that names the folder with titanic.csv and diabetes.csv.
FOLDER = "spark.tabulith.datasets"

# The columns of the two data sets.
SCHEMAS = {
    "titanic": "PassengerId int, Survived int, Pclass int, Name string, Sex string, Age double, SibSp int, Parch int, Ticket string, Fare double, Cabin string, Embarked string",
    "diabetes": "Pregnancies int, Glucose int, BloodPressure int, SkinThickness int, Insulin int, BMI double, DiabetesPedigreeFunction double, Age int, Outcome int",
}
_ABOUT = {
    "titanic": "titanic: 156 passengers of the Titanic, 12 columns; Age, Cabin and Embarked have missing values. For classification, missing values and categories.",
    "diabetes": "diabetes: 768 patients, 9 columns of diagnostic measurements, no missing values (zeros may stand for them). For prediction and statistical tests.",
}


def dataset_path(name: str, folder: str | None = None, spark: SparkSession | None = None) -> str:
    if name not in SCHEMAS:
        raise ValueError(f"unknown data set {name!r}")
    folder = folder or (spark or SparkSession.active()).conf.get(FOLDER, None)
    if not folder:  # beside the package, or where the program was started
        near = [p / "datasets" for p in (Path(__file__).resolve().parents[1], Path(__file__).resolve().parents[2], Path.cwd())]
        folder = next((str(p) for p in near if (p / f"{name}.csv").is_file()), None)
    if not folder:
        raise FileNotFoundError(f"no folder 'datasets' with {name}.csv beside the package or here: name one, or set {FOLDER}")
    return f"{folder.rstrip('/')}/{name}.csv"


def _load(name: str, as_frame: bool, folder: str | None, spark: SparkSession | None) -> DataFrame | str:
    path = dataset_path(name, folder, spark)
    if not as_frame:
        return path
    return (spark or SparkSession.active()).read.schema(SCHEMAS[name]).csv(path, header=True, quote='"', escape='"')


def load_titanic(return_frame: bool = True, *, folder: str | None = None, spark: SparkSession | None = None) -> DataFrame | str:
    """The frame, or with return_frame=False the path."""
    return _load("titanic", return_frame, folder, spark)


def load_diabetes(return_frame: bool = True, *, folder: str | None = None, spark: SparkSession | None = None) -> DataFrame | str:
    """The frame, or with return_frame=False the path."""
    return _load("diabetes", return_frame, folder, spark)


titanic = load_titanic
diabetes = load_diabetes


def list_datasets() -> list[str]:
    return list(SCHEMAS)


def dataset_info(name: str) -> str:
    """What a data set is; for an unknown name, which there are."""
    return _ABOUT.get(name.lower(), f"{name!r} isn't built in; there are {' and '.join(SCHEMAS)}")


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
