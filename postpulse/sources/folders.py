"""Folder names and renames on whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, sorted; none if it does not exist.  Hidden ones are left out."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(place) if entry.isDirectory()]
    # as for Spark, a leading underscore hides a name unless it is a partition column's
    return sorted(name for name in names if name[0] != "." and (name[0] != "_" or "=" in name))


def move_folder(spark: SparkSession, path: str, target: str) -> None:
    """Rename a folder; the target must not exist."""
    system, place = _file_system(spark, path)
    _, goal = _file_system(spark, target)
    system.mkdirs(goal.getParent())
    if not system.rename(place, goal):
        raise OSError(f"cannot rename {path} to {target}")
