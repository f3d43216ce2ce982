"""Names in texts by a word-level automaton.

Names and texts are runs of letters and digits, lower-cased; a name is mentioned where its
words stand one after another as whole words. All names of a share of the dictionary
are one Aho-Corasick automaton over word numbers, so a text is read once for the
share, whatever the number and lengths of its names, and mentions may overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofly.session import scratch_path

#: Bytes of names in one automaton; a larger dictionary is dealt into shares of about that size.
SHARE_BYTES = 16 << 20
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def spoken(name: Column | str) -> Column:
    """A name as its words, lower-cased, with single spaces."""
    c = F.col(name) if isinstance(name, str) else name
    return F.array_join(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")


@lru_cache(maxsize=1)
def _automaton(folder: str):
    """The automaton of a share and its words' numbers; a worker keeps the last one."""
    import ahocorasick
    from pyarrow import dataset, fs

    store, path = fs.FileSystem.from_uri(folder)
    names = dataset.dataset(path, filesystem=store, format="parquet").to_table(columns=["name"]).column(0).to_pylist()
    numbers: dict[str, int] = {}
    made = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for name in names:
        # number 0 is any word that no name has
        key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in name.split(" "))
        made.add_word(key, (len(key), name))
    made.make_automaton()
    return made, numbers


def _find(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, numbers = _automaton(folder)
        place = numbers.get
        for batch in batches:
            rows: list[tuple[int, str, int, int]] = []
            for i, text in enumerate(batch.column(1)):
                found: dict[str, list[int]] = {}
                for end, (length, name) in made.iter(tuple([place(w, 0) for w in words_of(text.as_py() or "")])) if len(made) else ():
                    known = found.setdefault(name, [0, end - length + 1])
                    known[0] += 1
                rows += [(i, name, n, first) for name, (n, first) in found.items()]
            at, names, n, first = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(first, pa.int64())], names=["key", "name", "n", "first_word"])

    return run


def text_mentions(texts: DataFrame, text: str, key: str, names: DataFrame, name: str, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """(key, name, n, first_word): how often each text mentions each name, and the word at which the first mention begins.

    ``name`` comes back as its words (``spoken``). The dictionary is dealt by a hash of the name
    into shares of about ``share_bytes``, written to the shared folder and read by the tasks: memory is
    bounded by a share and each share reads the texts once. Null and empty texts and names
    mention nothing; repeated names are one; repeated keys are answered row by row.
    """
    spark = texts.sparkSession
    known = names.select(spoken(name).alias("name")).where("name <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0
    n = max(1, -(-int(size) // share_bytes))
    folder = scratch_path(spark, "dictionary", keep=True)
    known.withColumn("share", F.pmod(F.xxhash64("name"), F.lit(n))).repartition(n, "share").write.partitionBy("share").parquet(folder)
    shares = [r["share"] for r in spark.read.parquet(folder).select("share").distinct().collect()] if size else []
    source = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    out = spark.createDataFrame([], f"key {kind}, name string, n long, first_word long")
    for share in shares:
        out = out.unionByName(source.mapInArrow(_find(f"{folder}/share={share}"), f"key {kind}, name string, n long, first_word long"))
    return out.withColumnRenamed("key", key) if key != "key" else out


def confirmed_hits(hits: DataFrame, candidates: DataFrame, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """(hit_id, candidate_id, n): hits of a full-text search that really name their candidate, and how often.

    hits: hit_id, candidate_id, text; candidates: candidate_id, name (several rows for several names).
    """
    texts = hits.groupBy("hit_id").agg(F.any_value("text", True).alias("text"))  # a hit of several candidates is one text
    found = text_mentions(texts, "text", "hit_id", candidates, "name", share_bytes).select("hit_id", F.col("name").alias("_name"), "n")
    own = hits.select("hit_id", "candidate_id").distinct().join(candidates.select("candidate_id", spoken("name").alias("_name")).distinct(), "candidate_id")
    return own.join(found, ["hit_id", "_name"]).groupBy("hit_id", "candidate_id").agg(F.sum("n").alias("n"))
