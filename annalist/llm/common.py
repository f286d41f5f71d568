"""What the operators share: work tables in the shared folder, and sizes of small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: whatever stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of up to so many rows of a few numbers may be broadcast, once they are counted.
FEW = 400_000
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests, one machine), a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="annalist-")
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read again: it cuts the lineage and outlives executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_key_row(rows: DataFrame, keyed: DataFrame, key: str | list[str], size: str, total: int, how: str = "inner", few: int = 0) -> DataFrame:
    """rows joined with keyed, which has one row a key; `size` is its count of the key's rows, `total` counts all rows.

    Rows of a common key stay where they are: keys with more than 1,000 rows and a thousandth of all rows, of which there
    are fewer than a thousand, are broadcast. The other keys' rows meet by key. Rows without a key have no match.
    few: up to so many rows, keyed is broadcast whole, after it was counted. how: inner or left. keyed is read twice: it should be a table, or a sum whose exchange Spark can use again.
    """
    keys = [key] if isinstance(key, str) else key
    if few and keyed.count() <= few:
        return rows.join(F.broadcast(keyed), keys, how)
    common = F.col(size) > max(1_000, total // 1_000)
    hot, rest = keyed.where(common), keyed.where(~common)
    there = rows.dropna(subset=keys)
    out = there.join(F.broadcast(hot), keys).unionByName(there.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how))
    if how == "left":
        out = out.unionByName(rows.where(" or ".join(f"{k} is null" for k in keys)), allowMissingColumns=True)
    return out


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(column):
    """A-Z in lower case; other letters stay."""
    return F.translate(column, A_Z, a_z)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
