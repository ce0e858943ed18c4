"""Source files worth extracting: those that hold a proof keyword outside comments and literals."""

from __future__ import annotations

import random
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

_WORD = re.compile(r"[^\W\d][\w'!?.]*")


def words_outside(src: str) -> set[str]:
    """Identifiers outside nested ``/- -/`` comments, ``--`` comments, strings, raw strings, characters and ``«»`` names."""
    out, i, n = set(), 0, len(src)
    while i < n:
        two = src[i : i + 2]
        if two == "/-":
            depth, i = 1, i + 2
            while i < n and depth:
                two = src[i : i + 2]
                depth += (two == "/-") - (two == "-/")
                i += 2 if two in ("/-", "-/") else 1
        elif two == "--":
            i = src.find("\n", i) % (n + 1) if "\n" in src[i:] else n
        elif m := re.compile(r'r(#*)"').match(src, i):
            end = src.find('"' + m[1], m.end())
            i = n if end < 0 else end + 1 + len(m[1])
        elif src[i] == '"':
            i += 1
            while i < n and src[i] != '"':
                i += 2 if src[i] == "\\" else 1
            i += 1
        elif m := re.compile(r"'(\\.[^']*|[^'\\])'").match(src, i):
            i = m.end()
        elif src[i] == "«":
            end = src.find("»", i)
            i = n if end < 0 else end + 1
        elif m := _WORD.match(src, i):
            out.add(m[0])
            i = m.end()
        else:
            i += 1
    return out


@pandas_udf(BooleanType())
def has_proof(content: pd.Series) -> pd.Series:
    def one(b) -> bool:
        w = words_outside(bytes(b).decode("utf-8", "replace"))
        return "by" in w and bool(w & {"theorem", "lemma", "example"})

    return content.map(one)


def find_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root`` of ``*.lean`` files with proofs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lean").option("recursiveFileLookup", "true").load(root)
    return files.where(has_proof("content")).select("path")


def parse_file_list(text: str) -> list[str]:
    """Lines that are neither blank nor comments; a path listed twice is an error."""
    out = [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    if len(set(out)) != len(out):
        raise ValueError("a file is listed twice")
    return out


def sample_names(names: list[str], k: int, seed: int) -> list[str]:
    """A seeded sample without replacement, in the given order."""
    picked = set(random.Random(seed).sample(range(len(names)), min(k, len(names))))
    return [x for i, x in enumerate(names) if i in picked]
