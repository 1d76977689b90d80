"""Files of a git revision, and the revision that a working tree is at."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def head(repo: str) -> str | None:
    """The commit a working tree is at; None outside of one."""
    got = subprocess.run(["git", "-C", repo, "rev-parse", "HEAD"], capture_output=True, text=True)
    return got.stdout.strip() if got.returncode == 0 else None


def scan(spark: SparkSession, repo: str, ref: str, into: str) -> DataFrame:
    """The files of `ref`, unpacked to the folder `into` that all executors can read, with git_ref and commit_sha."""
    if ref.startswith("-"):
        raise ValueError("not a revision")
    sha = subprocess.run(["git", "-C", repo, "rev-parse", "--verify", f"{ref}^{{commit}}"], capture_output=True, text=True, check=True).stdout.strip()
    folder = f"{into}/{sha}"
    if not os.path.isdir(folder):
        os.makedirs(folder)
        tar = subprocess.run(["git", "-C", repo, "archive", sha], capture_output=True, check=True).stdout
        subprocess.run(["tar", "-x", "-C", folder], input=tar, check=True)
    return files.scan(spark, folder).withColumn("git_ref", F.lit(ref)).withColumn("commit_sha", F.lit(sha))
